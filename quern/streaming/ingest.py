"""Incremental ingest: articles that arrive as files become chunks and postings, each once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions import text as X
from quern.operators import corpus as C

ARTICLES = "source string, source_article_id string, title string, text string"


def article_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(ARTICLES).option("maxFilesPerTrigger", files_per_trigger).json(path)


def _existing(spark: SparkSession, path: str, schema) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


#: Parts of the table of keys; a batch reads those of its own keys.
KEY_PARTS = 64
KEYS = ["source", "source_article_id"]


def ingest(stream: DataFrame, chunks_path: str, checkpoint: str, min_chars: int = X.MIN_CHUNK_CHARS, ends: str = X.SENTENCE_ENDS, report: Callable[[int, dict], None] | None = None) -> StreamingQuery:
    """Write chunks and postings of articles that aren't there yet, then stop; a further call goes on where this one ended.

    A batch writes below its own number and overwrites it, so a batch that is run again leaves nothing twice. Of articles
    with one key the first stays, within a batch and over batches. Which are known is read from a table of keys, a row per
    article in parts by hash, not from the chunks. report is called after each batch with its number and what it wrote
    (articles, chunks, characters), which are observed while it is written; a batch that is run again is reported again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64(*KEYS), F.lit(KEY_PARTS)).cast("int").alias("part")
        rows = C.clean_articles(batch).dropDuplicates(KEYS)
        keys = rows.select(*KEYS, part)
        own = [r["part"] for r in keys.select("part").distinct().collect()]  # KEY_PARTS at most
        known = _existing(spark, f"{chunks_path}/keys", keys.withColumn("batch", F.lit(0).cast("int")).schema).where((F.col("batch") != number) & F.col("part").isin(own))
        fresh = rows.join(known.select(*KEYS), KEYS, "left_anti").persist()
        chunks = C.chunk_articles(fresh, min_chars, ends).persist()
        wrote, keyed = Observation(), Observation()
        chunks.observe(wrote, F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("char_count"), F.lit(0)).alias("characters")).write.mode("overwrite").parquet(f"{chunks_path}/chunks/batch={number}")
        C.postings(chunks.withColumn("chunk", F.struct(*KEYS, "chunk_index")), "chunk").write.mode("overwrite").parquet(f"{chunks_path}/postings/batch={number}")
        # last, so that keys are known only when what they stand for is written
        fresh.select(*KEYS, part).observe(keyed, F.count(F.lit(1)).alias("articles")).write.mode("overwrite").partitionBy("part").parquet(f"{chunks_path}/keys/batch={number}")
        chunks.unpersist()
        fresh.unpersist()
        if report:
            report(number, keyed.get | wrote.get)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_per_key(stream: DataFrame, keys: list[str], time_col: str, delay: str) -> DataFrame:
    """The first row of each key, remembered for the watermark's delay."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time_col: str, by: list[str], size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts per tumbling or sliding window. Not part of the reference's operators; an extension."""
    window = F.window(time_col, size, slide) if slide else F.window(time_col, size)
    return stream.withWatermark(time_col, delay).groupBy(window, *by).agg(F.count(F.lit(1)).alias("n"))


def session_counts(stream: DataFrame, time_col: str, by: list[str], gap: str, delay: str = "1 hour") -> DataFrame:
    """Counts per session. An extension too."""
    return stream.withWatermark(time_col, delay).groupBy(F.session_window(time_col, gap), *by).agg(F.count(F.lit(1)).alias("n"))
