"""Whole jobs: a corpus from text collections, a dictionary from its sources."""

from __future__ import annotations

import threading
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import corpus as C
from quern.operators import dialects as D
from quern.operators import lexicon as L
from quern.sources import dictionaries as R
from quern.sources import texts as S


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def collect_articles(spark: SparkSession, base: str, sources: list[str], limit: int | None = None) -> DataFrame:
    """Articles of registered sources below a folder, with their source and order of arrival."""
    frames = []
    for i, name in enumerate(sources):
        reader, folder = S.REGISTRY[name]
        rows = reader(spark, f"{base}/{folder}")
        frames.append((rows.limit(limit) if limit else rows).withColumns({"source": F.lit(name), "arrival": F.struct(F.lit(i).alias("source_no"), F.monotonically_increasing_id().alias("row"))}))
    return union(frames)


def build_corpus(articles: DataFrame, path: str, min_chars: int = X.MIN_CHUNK_CHARS, ends: str = X.SENTENCE_ENDS) -> DataFrame:
    """Write chunks by source and give the true counts per source, summed over all that arrived."""
    rows = C.rename_sources(C.clean_articles(articles))
    chunks = C.chunk_articles(rows, min_chars, ends, keep=("source", "source_article_id", "title", "arrival"))
    # a source can hold most rows: chunks are numbered by ranges, which split it
    C.number_chunks(C.merge_chunks(chunks)).write.mode("overwrite").partitionBy("source").parquet(path)
    return C.source_counts(articles.sparkSession.read.parquet(path))


def cedict_imports(spark: SparkSession, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """Entries of files in CEDICT form: paths maps a source to (language, path)."""
    frames = [R.read_dictionary(spark, path).select("traditional", "simplified", "pinyin", "pos", F.lit(lang).alias("lang"), "definition", F.lit(source).alias("source")) for source, (lang, path) in paths.items()]
    return union(frames)


def wiktextract_imports(entries: DataFrame, source: str = "wiktextract") -> DataFrame:
    """Definitions of entries: English glosses and translations, joined by slashes."""
    texts = F.map_concat(F.create_map(F.lit("en"), F.col("glosses_en")), F.map_filter("translations", lambda k, _: k != "en"))
    rows = entries.select("traditional", "simplified", "pinyin", "pos", F.explode(texts).alias("lang", "words"))
    return rows.select("traditional", "simplified", "pinyin", "pos", "lang", F.array_join("words", "/").alias("definition"), F.lit(source).alias("source"))


def jmdict_imports(entries: DataFrame, headwords: DataFrame, source: str = "jmdict") -> DataFrame:
    """The reading as the Japanese definition of the first headword with the form, or of a new one with the reading as pinyin."""
    first = L.headword_keys(headwords).groupBy(F.col("word").alias("kanji")).agg(F.min("headword_id").alias("id"))
    rows = entries.join(first, "kanji", "left").join(headwords.select("id", F.col("traditional").alias("t"), F.col("simplified").alias("s"), F.col("pinyin").alias("p")), "id", "left")
    return rows.select(F.coalesce("t", "kanji").alias("traditional"), F.coalesce("s", "kanji").alias("simplified"), F.coalesce("p", "reading").alias("pinyin"), F.nullif("pos", F.lit("")).alias("pos"), F.lit("ja").alias("lang"), F.col("glosses_ja").alias("definition"), F.lit(source).alias("source"))


def assemble(imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headwords and definitions of imported entries: first part of speech, last definition of each source."""
    rows = imports.withColumns({"arrival": F.monotonically_increasing_id(), "pinyin": X.strip_toneless_suffix(F.coalesce("pinyin", F.lit("")))})
    words = L.upsert_headwords(rows).withColumn("id", F.xxhash64(*L.KEY)).select("id", *L.KEY, "pos")
    defs = L.upsert_definitions(rows.select(F.xxhash64(*L.KEY).alias("headword_id"), "lang", "source", "definition", "arrival"))
    return words, defs.withColumn("id", F.xxhash64("headword_id", "lang", "source")).drop("arrival")


def merge(headwords: DataFrame, definitions: DataFrame, forms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Variants reconciled, then parts of speech filled in."""
    words, defs, said = L.reconcile(headwords, definitions, forms)
    return L.fill_pos(words, defs), defs, said


def cantonese_imports(rows: DataFrame, headwords: DataFrame, source: str = "cccanto") -> tuple[DataFrame, DataFrame]:
    """Headwords with those that rows add, and forms of all rows, with their glosses joined by slashes."""
    rows = rows.withColumn("pinyin", X.strip_toneless_suffix(F.col("pinyin")))
    new = D.new_headwords(rows, headwords).withColumn("id", F.xxhash64(*L.KEY)).select("id", *L.KEY, "pos")
    words = headwords.select("id", *L.KEY, "pos").unionByName(new)
    gloss = F.nullif(F.array_join("definitions", "/"), F.lit(""))
    found = L.match_exact(rows, words).select("headword_id", F.lit("yue").alias("dialect"), F.lit(None).cast("string").alias("native_chars"), F.col("jyutping").alias("pronunciation"), gloss.alias("gloss"), F.lit(source).alias("source"), "line_no")
    return words, L.upsert_forms(found, "line_no").select(*D.FORM)


def reading_overlay(rows: DataFrame, headwords: DataFrame, source: str = "cccedict-readings") -> DataFrame:
    return D.forms_by_key(rows.withColumnRenamed("jyutping", "pronunciation"), headwords, "yue", source)


def single_character_forms(rows: DataFrame, headwords: DataFrame, dialect: str, source: str) -> DataFrame:
    """Forms of the first reading of each single character."""
    one = D.single_characters(rows.where(F.length("word") == 1)).withColumns({"native_chars": F.lit(None).cast("string"), "gloss": F.lit(None).cast("string")})
    return D.forms_by_word(one, headwords, dialect, source)


def word_forms(rows: DataFrame, headwords: DataFrame, dialect: str, source: str) -> DataFrame:
    """Forms of words of two characters and more, by their last reading."""
    many = D.single_characters(rows.where(F.length("word") >= 2), "last").withColumns({"native_chars": F.lit(None).cast("string"), "gloss": F.lit(None).cast("string")})
    return D.forms_by_word(many, headwords, dialect, source)


def forms_by_dialect(rows: DataFrame, headwords: DataFrame, source: str, place_col: str | None = None) -> DataFrame:
    """Forms of rows that name their dialect, and their place for the source's name."""
    name = F.lit(source) if place_col is None else F.concat(F.lit(f"{source}-"), F.lower(place_col))
    found = L.match_words(rows.withColumn("source", name), headwords)
    return L.upsert_forms(found.select(*D.FORM, "line_no"), "line_no").select(*D.FORM)


def timed(df: DataFrame, seconds: float) -> tuple[list | None, float]:
    """Rows of a small result and the time it took; None if it took longer than seconds and its jobs were cancelled."""
    sc, group = df.sparkSession.sparkContext, uuid.uuid4().hex
    late = threading.Event()

    def cancel():
        late.set()
        sc.cancelJobGroup(group)

    timer, began = threading.Timer(seconds, cancel), time.perf_counter()
    sc.setJobGroup(group, "timed", interruptOnCancel=True)
    timer.start()
    try:
        return df.collect(), time.perf_counter() - began
    except Exception:
        if not late.is_set():
            raise
        return None, time.perf_counter() - began
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
