"""Resampling towards a target distribution: hashed word features, gains per bucket, an exact draw of highest scores.

Texts are read twice: once for counts of features per bucket, added up inside each task, and once for each text's sum of
gains, which are an array of BUCKETS integers. Scores are integers, so the draw works on a histogram of them: counts
summed from the highest score down say where the draw ends and at which rank each score begins, and only documents of
drawn scores are ordered, within their score, by id.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import words as W
from quern.llm.common import Stored, bound_arrow, spans_by_bytes, text_bytes

CALL_BYTES = 1 << 19
BUCKETS = 10_000
#: Documents with fewer words are not drawn; this many in a hundred of the others are.
LEAST_WORDS, PERCENT = 20, 10
SEED = "2024"
#: Features of more bytes are hashed one by one.
LONG_BYTES = 96
#: Rows that repeat an id and a score are written out by tasks of at most so many.
COPIES = 10_000


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC = _crc_table()


def crc32_of(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The CRC-32 of each run of bytes, a byte of all runs at a time."""
    out, length = np.full(len(first), 0xFFFFFFFF, np.uint32), last - first
    order = np.argsort(-np.minimum(length, LONG_BYTES + 1), kind="stable")
    order = order[np.searchsorted(-length[order], -LONG_BYTES) :]
    at, crc, size = first[order], out[order], length[order]
    for k in range(int(size[0]) if len(size) else 0):
        live = np.searchsorted(-size, -k)  # runs stand by length, so those that go on come first
        crc[:live] = CRC[(crc[:live] ^ raw[at[:live] + k]) & np.uint32(255)] ^ (crc[:live] >> np.uint32(8))
    out[order] = crc
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > LONG_BYTES).tolist():
        out[i] = zlib.crc32(raw[first[i] : last[i]].tobytes())
    return out


def features_of(raw: np.ndarray, offsets: np.ndarray, width: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bucket and row of each feature (runs of 1 to width words), and the number of words of each row.

    A-Z are lower-cased; words are runs of 0-9, a-z and bytes above 127, which is every other character.
    """
    low = W.lower_ascii(raw)
    first, last = W.runs(((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 122)) | (low >= 128), offsets)
    bounds = np.searchsorted(first, offsets)
    row, size = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds)), last - first
    if width > 1 and len(first):
        # words joined by one space, so that a run of them is a run of bytes
        begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
        within = np.arange(int(size.sum())) - np.repeat(np.concatenate([[0], np.cumsum(size)])[:-1], size)
        joined[np.repeat(begin, size) + within] = low[np.repeat(first, size) + within]
        low, first, last = joined, begin, begin + size
    found = [(crc32_of(low, first, last), row)]
    for k in range(1, width):
        same = np.flatnonzero(row[: max(0, len(row) - k)] == row[k:])
        found.append((crc32_of(low, first[same], last[same + k]), row[same]))
    return np.concatenate([c for c, _ in found]).astype(np.int64) % buckets, np.concatenate([r for _, r in found]), np.diff(bounds)


def bucket_counts(texts: DataFrame, text_col: str = "text", width: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket. A task sends one row of buckets at most, whatever it has read."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            for lo, hi in spans_by_bytes(offsets, CALL_BYTES):
                o = offsets[lo : hi + 1]
                total += np.bincount(features_of(raw[o[0] : o[-1]], o - o[0], width, buckets)[0], minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["bucket", "n"])

    rows = texts.select(texts[text_col].cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: 1000 times the log of its smoothed share in the target over that in the source, rounded down."""
    s, t, b = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(float(int(y) + 1) * float(s + b) / (float(int(x) + 1) * float(t + b)))) for x, y in zip(source, target, strict=True)], np.int64)


def noise(id_col: Column, seed: str = SEED) -> Column:
    """A whole-number Gumbel variate from a hash of seed and id; a null id counts as an empty one."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


@dataclass(frozen=True)
class Draw:
    """Scores of a table and where its draw ends: drawn are scores above cutoff, and of cutoff itself the first by id."""

    gain: np.ndarray
    scored: DataFrame
    offsets: DataFrame
    cutoff: int | None
    size: int


def weigh(rows: DataFrame, gain: np.ndarray, width: int = 1) -> DataFrame:
    """rows (any columns, then text) with text replaced by n_words, n_features and weight."""
    kept = rows.columns[:-1]
    schema = T.StructType([*(rows.schema[c] for c in kept), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])

    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column(len(kept)))
            for lo, hi in spans_by_bytes(offsets, CALL_BYTES):
                o = offsets[lo : hi + 1]
                bucket, row, words = features_of(raw[o[0] : o[-1]], o - o[0], width, len(gain))
                weight = np.zeros(hi - lo, np.int64)
                np.add.at(weight, row, gain[bucket])
                new = (words.astype(np.int64), np.bincount(row, minlength=hi - lo).astype(np.int64), weight)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(len(kept))), *map(pa.array, new)], names=schema.names)

    return rows.mapInArrow(run, schema)


def _draw(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, width: int, buckets: int, least_words: int, percent: int, seed: str) -> Draw:
    spark = docs.sparkSession
    bound_arrow(spark)
    store = Stored(spark, "importance")
    gain = gains(bucket_counts(docs, text_col, width, buckets), bucket_counts(target, text_col, width, buckets))
    rows = weigh(docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")), gain, width)
    scored = store.keep(rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "scored")
    # scores stand in order over partitions, each with its share of the distinct ones
    counts = scored.where(F.col("n_words") >= least_words).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    counts = store.keep(counts.repartitionByRange(F.desc("score")).withColumn("part", F.spark_partition_id()), "histogram")
    ahead, parts = 0, []
    for r in sorted(counts.groupBy("part").agg(F.sum("n").alias("n")).collect()):  # a row per partition
        parts.append((r["part"], ahead))
        ahead += r["n"]
    size = percent * ahead // 100
    down = Window.partitionBy("part").orderBy(F.desc("score"))
    begins = F.broadcast(spark.createDataFrame(parts, "part int, ahead long"))
    offsets = counts.join(begins, "part").select("score", (F.col("ahead") + F.sum("n").over(down) - F.col("n")).alias("ahead"))
    offsets = store.keep(offsets.where(F.col("ahead") < size), "offsets")
    return Draw(gain, scored, offsets, offsets.agg(F.min("score")).first()[0], size)


def _ranks(draw: Draw, rows: DataFrame) -> DataFrame:
    """rows (of drawn scores: id, n_features, weight, score) with rank, null beyond the draw. Rows alike in all are counted first and written out last."""
    key = ["id", "n_features", "weight", "score"]
    alike = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).join(draw.offsets, "score")
    order = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "n_features", "weight")
    alike = alike.withColumn("before", F.col("ahead") + F.sum("copies").over(order) - F.col("copies"))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    several = alike.where("copies > 1").select(*key, "before", "copies", F.explode(F.sequence(zero, F.col("copies") - 1, F.lit(COPIES).cast("long"))).alias("from"))
    several = several.repartition("id", "score", "from").select(*key, "before", F.explode(F.sequence(F.col("from") + 1, F.least(F.col("from") + COPIES, "copies"))).alias("nth"))
    rank = F.col("before") + F.col("nth")
    found = alike.where("copies = 1").select(*key, "before", one.alias("nth")).unionByName(several)
    return found.select(*key, F.when(rank <= draw.size, rank).alias("rank"))


def importance(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """How docs would be drawn towards the distribution of features in target, a table with the same text_col.

    Result: id_col, n_features, weight, score, rank, all long but the id, a row per input row. Features are runs of 1 to
    width words. Of the documents with at least least_words words, percent in a hundred (rounded down) are drawn, those of
    highest score; ties go to the smaller id, a null id last. rank counts drawn rows from 1, and is null for others.

    A null or empty text has no features and weight 0. Rows that repeat an id share its random part and are rows of their
    own: where they tie in all, ranks go to them in any order, which no column tells apart. Very long texts are counted
    whole, long words too. Without documents or without target texts all is defined by the smoothed shares: an empty table
    gives no rows, an empty target gives gains of the source's shares alone. Other columns are not read.
    """
    draw = _draw(docs, target, id_col, text_col, width, buckets, least_words, percent, seed)
    key = ["id", "n_features", "weight", "score"]
    if draw.cutoff is None:
        rows = draw.scored.select(*key, F.lit(None).cast("long").alias("rank"))
    else:
        reached = (F.col("n_words") >= least_words) & (F.col("score") >= draw.cutoff)
        rows = _ranks(draw, draw.scored.where(reached)).unionByName(draw.scored.where(~reached).select(*key, F.lit(None).cast("long").alias("rank")))
    return rows.select(F.col("id").alias(id_col), *key[1:], "rank")


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """The rows of docs that importance draws, all columns. Scores above the last one drawn are told in the scan, without a join.

    Of rows that tie at the last score by id, as many stay as the draw has room for, by weight and then in any order.
    """
    draw = _draw(docs, target, id_col, text_col, width, buckets, least_words, percent, seed)
    if draw.cutoff is None:
        return docs.limit(0)
    rows = docs.select(F.struct(*docs.columns).alias("row"), docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    rows = weigh(rows, draw.gain, width).withColumn("score", F.col("weight") + noise(F.col("id"), seed)).where(F.col("n_words") >= least_words)
    room = draw.size - draw.offsets.where(F.col("score") == draw.cutoff).first()["ahead"]
    last = rows.where(F.col("score") == draw.cutoff).orderBy(F.col("id").asc_nulls_last(), "n_features", "weight").limit(room)
    out = rows.where(F.col("score") > draw.cutoff).select("row").unionByName(last.select("row"))
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
