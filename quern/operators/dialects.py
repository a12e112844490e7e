"""Dialect readings: matching of source rows to headwords, and readings derived from compounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.lexicon import KEY, headword_keys, last_wins, match_exact, match_words, upsert_forms, upsert_headwords

FORM = ["headword_id", "dialect", "native_chars", "pronunciation", "gloss", "source"]


def most_common(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """by, value, n: the most frequent value of each group; of those that tie, the one that comes first."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    rank = Window.partitionBy(*by).orderBy(F.desc("n"), "_first")
    return counts.withColumn("_k", F.row_number().over(rank)).where("_k = 1").drop("_k", "_first")


def forms_by_word(rows: DataFrame, headwords: DataFrame, dialect: str, source: str) -> DataFrame:
    """Forms of rows (word, native_chars, pronunciation, gloss, line_no) for all headwords with the word; the last of each stays."""
    found = match_words(rows, headwords).withColumns({"dialect": F.lit(dialect), "source": F.lit(source)})
    return upsert_forms(found.select(*FORM, "line_no"), "line_no").select(*FORM)


def forms_by_key(rows: DataFrame, headwords: DataFrame, dialect: str, source: str) -> DataFrame:
    """Forms of rows that agree with a headword in all three fields."""
    found = match_exact(rows, headwords).withColumns({"dialect": F.lit(dialect), "source": F.lit(source), "native_chars": F.lit(None).cast("string"), "gloss": F.lit(None).cast("string")})
    return upsert_forms(found.select(*FORM, "line_no"), "line_no").select(*FORM)


def new_headwords(rows: DataFrame, headwords: DataFrame) -> DataFrame:
    """Headwords that rows have and the dictionary doesn't."""
    return match_exact(upsert_headwords(rows.withColumn("pos", F.lit(None).cast("string")), "line_no"), headwords, "left_anti")


def single_characters(rows: DataFrame, which: str = "first") -> DataFrame:
    """One reading per character, the first or the last by line."""
    pick = F.min_by if which == "first" else F.max_by
    return rows.groupBy("word").agg(pick(F.struct("pronunciation", "line_no"), "line_no").alias("x")).select("word", "x.*")


def derive_from_compounds(headwords: DataFrame, forms: DataFrame, dialect: str = "nan", least: int = 1, limit: int | None = None, source: str = "derived") -> DataFrame:
    """Readings of single characters from words of two: the most frequent part, for characters without a reading.

    Words have two Han characters and a pronunciation with one hyphen and no slash, and no characters of their own.
    limit bounds the forms given, most frequent readings first.
    """
    words = forms.where((F.col("dialect") == dialect) & F.col("native_chars").isNull()).join(headwords.withColumnRenamed("id", "headword_id"), "headword_id")
    sound = F.col("pronunciation")
    words = words.where((F.length("traditional") == 2) & sound.contains("-") & ~sound.contains("/") & (F.size(F.split(sound, "-")) == 2))
    pairs = words.select("headword_id", F.posexplode(F.arrays_zip(F.array(F.substring("traditional", 1, 1), F.substring("traditional", 2, 1)).alias("c"), F.split(sound, "-").alias("r"))).alias("i", "x"))
    pairs = pairs.select((F.col("headword_id") * 2 + F.col("i")).alias("o"), F.col("x.c").alias("word"), F.trim("x.r").alias("pronunciation")).where((F.col("word") >= "一") & (F.col("pronunciation") != ""))
    best = most_common(pairs, ["word"], "pronunciation", "o").where(F.col("n") >= least)
    covered = forms.where(F.col("dialect") == dialect).select("headword_id").join(headword_keys(headwords), "headword_id").where(F.length("word") == 1).select("word").distinct()
    found = match_words(best.join(covered, "word", "left_anti"), headwords)
    if limit is not None:
        # each word has a form at least, so the first limit words are enough
        ranks = found.groupBy("word").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("k")).orderBy(F.desc("n"), "word").limit(limit)
        before = F.coalesce(F.sum("k").over(Window.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = found.join(ranks.withColumn("before", before).where(F.col("before") < limit).select("word"), "word", "left_semi")
    none = F.lit(None).cast("string")
    return found.select("headword_id", F.lit(dialect).alias("dialect"), none.alias("native_chars"), "pronunciation", none.alias("gloss"), F.lit(source).alias("source"))


__all__ = ["KEY", "FORM", "derive_from_compounds", "forms_by_key", "forms_by_word", "last_wins", "most_common", "new_headwords", "single_characters"]
