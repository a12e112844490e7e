"""Phrase search over chunks: samples spread over sources, capped counts, context, examples.

chunks has chunk_id, source, source_article_id, title, chunk_index, text (and char_count where it says so). Order is
always explicit: by chunk_id.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X


def phrase_hits(chunks: DataFrame, term: str) -> DataFrame:
    """Chunks that have the term's tokens next to each other."""
    return chunks.where(X.phrase(F.col("text"), term))


def all_character_hits(chunks: DataFrame, term: str) -> DataFrame:
    """Chunks that have all characters of the term anywhere."""
    return chunks.where(X.every_character(F.col("text"), term))


def sample_per_source(hits: DataFrame, per_source: int) -> DataFrame:
    """The first hits of each source. Spark limits groups before the shuffle, so a hot source sends few rows."""
    order = Window.partitionBy("source").orderBy("chunk_id")
    return hits.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_source)


def search(chunks: DataFrame, term: str, limit: int = 20, snippet_tokens: int = 64, sources: int | None = None, compat: bool = False) -> DataFrame:
    """chunk_id, text, source, title, rank (0.0), snippet, source_article_id, chunk_index of hits spread over sources.

    Each source gives its first max(2, ceil(limit / sources)) hits. Results take turns over sources, so that none of the
    later ones is cut off; compat cuts the plain order by chunk_id instead. sources is counted if not given.
    """
    n = sources if sources is not None else chunks.select("source").distinct().count()
    per_source = max(2, math.ceil(limit / n)) if n else 2
    found = sample_per_source(phrase_hits(chunks, term), per_source)
    found = found.orderBy("chunk_id") if compat else found.orderBy("nth", "chunk_id")
    return found.limit(limit).select("chunk_id", "text", "source", "title", F.lit(0.0).alias("rank"), X.snippet(F.col("text"), snippet_tokens).alias("snippet"), "source_article_id", "chunk_index")


def search_simple(chunks: DataFrame, term: str, limit: int = 20) -> DataFrame:
    """The first hits whatever their sources."""
    return phrase_hits(chunks, term).orderBy("chunk_id").limit(limit)


def clamp_limit(limit: int) -> int:
    return min(100, max(1, limit))


def capped_count(hits: DataFrame, cap: int) -> DataFrame:
    """One row: hits, at most cap. Each partition stops at cap hits, and counting needs no more."""
    return hits.select(F.lit(1).alias("one")).limit(cap).agg(F.count("one").alias("hits"))


def count_hits(chunks: DataFrame, term: str, cap: int = 10_000) -> DataFrame:
    """One row: hits, capped."""
    return capped_count(phrase_hits(chunks, term), cap)


def count_by_source(hits: DataFrame, cap_per_source: int = 1000) -> DataFrame:
    """source, hits (capped), most first; sources without hits don't appear."""
    return hits.groupBy("source").agg(F.least(F.count(F.lit(1)), F.lit(cap_per_source)).alias("hits")).orderBy(F.desc("hits"), "source")


#: From so many terms on, phrases are looked up among a text's runs of tokens instead of being searched for one by one.
MANY_TERMS = 16


def term_hits(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """chunks by term: a row for each of terms that a chunk has, in one pass over the chunks.

    Few terms are tested one by one on a token line made once. Many terms are matched by their tokens: runs of as many
    tokens as some term has are looked up in a map of terms, so the cost doesn't grow with their number.
    """
    spark, columns = chunks.sparkSession, [F.col(c) for c in chunks.columns]
    known = [t for t in dict.fromkeys(terms) if t.strip()]
    if not known:
        return chunks.withColumn("term", F.lit(None).cast("string")).limit(0)
    if len(known) < MANY_TERMS:
        tests = F.transform(F.array(X.token_line(F.col("text"))), lambda line: F.array_compact(F.array(*(F.when(X.has_phrase(line, t), F.lit(t)) for t in known))))[0]
        return chunks.select(*columns, F.explode(tests).alias("term"))
    table = spark.createDataFrame([(t,) for t in known], "term string").select("term", X.tokens(F.col("term")).alias("tokens"))
    table = table.where(F.size("tokens") > 0).select("term", F.size("tokens").alias("size"), F.array_join("tokens", " ").alias("phrase")).collect()  # the terms asked for
    sizes = sorted({r["size"] for r in table})
    if not sizes:
        return chunks.withColumn("term", F.lit(None).cast("string")).limit(0)

    def runs(tokens, size):
        starts = F.sequence(F.lit(1), F.size(tokens) - (size - 1))
        return F.when(F.size(tokens) >= size, tokens if size == 1 else F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, size), " "))).otherwise(F.array().cast("array<string>"))

    phrases = F.array(*(F.lit(p) for p in sorted({r["phrase"] for r in table})))
    found = F.transform(F.array(X.tokens(F.col("text"))), lambda tokens: F.array_intersect(F.concat(*(runs(tokens, n) for n in sizes)), phrases))[0]
    rows = chunks.select(*columns, F.explode(found).alias("_phrase"))
    names = spark.createDataFrame([(r["phrase"], r["term"]) for r in table], "_phrase string, term string")
    return rows.join(F.broadcast(names), "_phrase").drop("_phrase")  # a row per term asked for


def count_terms_by_source(chunks: DataFrame, terms: list[str], cap_per_source: int = 1000) -> DataFrame:
    """term, source, hits (capped) for many terms in one pass over the chunks."""
    return term_hits(chunks.select("source", "text"), terms).groupBy("term", "source").agg(F.least(F.count(F.lit(1)), F.lit(cap_per_source)).alias("hits"))


def context(chunks: DataFrame, hits: DataFrame, before: int = 2, after: int = 2) -> DataFrame:
    """For each hit: chunk_id, source, title, hit_text, context, hit_index, chunk_count.

    Neighbours are those of the same article whose index is in range, whatever gaps there are. hit_index is the hit's
    place in the window, 0 if it isn't there. Articles without a hit are dropped by the join before texts are gathered.
    """
    low = F.greatest(F.lit(0), F.col("h.chunk_index") - before)
    near = (F.col("c.source") == F.col("h.source")) & (F.col("c.source_article_id") == F.col("h.source_article_id")) & F.col("c.chunk_index").between(low, F.col("h.chunk_index") + after)
    rows = hits.select("chunk_id", "source", "source_article_id", "title", "chunk_index", "text").alias("h").join(chunks.select("source", "source_article_id", "chunk_index", "text").alias("c"), near)
    window = F.sort_array(F.collect_list(F.struct(F.col("c.chunk_index").alias("i"), F.col("c.text").alias("t"))))
    rows = rows.groupBy("h.chunk_id", "h.source", "h.title", F.col("h.text").alias("hit_text"), "h.chunk_index").agg(window.alias("w"))
    at = F.greatest(F.lit(0), F.array_position(F.transform("w", lambda x: x["i"]), F.col("chunk_index")) - 1).cast("int")
    return rows.select("chunk_id", "source", "title", "hit_text", F.array_join(F.transform("w", lambda x: x["t"]), "\n").alias("context"), at.alias("hit_index"), F.size("w").alias("chunk_count"))


def example_sentences(chunks: DataFrame, word: str, limit: int = 2) -> DataFrame:
    """Up to limit texts with all characters of a word, of the first 5 * limit ones: those of 20 to 100 characters first.

    Texts under 10 and over 200 characters, and the word alone, are none.
    """
    first = all_character_hits(chunks, word).orderBy("chunk_id").limit(5 * limit)
    size = F.length("text")
    fine = first.where(size.between(10, 200) & (X.strip(F.col("text")) != word))
    return fine.withColumn("bucket", F.when(size.between(20, 100), 0).otherwise(1)).orderBy("bucket", "chunk_id").limit(limit).select("chunk_id", "source", "text")


def sample_sentences(chunks: DataFrame, term: str, limit: int = 3) -> DataFrame:
    """The first text of 8 to 30 characters with all characters of a term, per source in order of their first chunk; kept if it has the term itself."""
    starts = chunks.groupBy("source").agg(F.min("chunk_id").alias("start"))
    picked = sample_per_source(all_character_hits(chunks.where(F.col("char_count").between(8, 30)), term), 1)
    return picked.where(F.col("text").contains(term)).join(starts, "source").orderBy("start").limit(limit).select("source", "chunk_id", "text")


def longest_per_source(chunks: DataFrame, term: str, pool: int = 200, keep: int = 3) -> DataFrame:
    """Of the first pool hits, the longest keep texts of each source."""
    first = all_character_hits(chunks, term).orderBy("chunk_id").limit(pool)
    order = Window.partitionBy("source").orderBy(F.desc(F.length("text")), "chunk_id")
    return first.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= keep)


def passages(results: DataFrame, top: int = 5) -> DataFrame:
    """One row: numbered passages for a prompt, or a note that there are none."""
    first = results.orderBy("chunk_id").limit(top)
    listed = F.sort_array(F.collect_list(F.struct("chunk_id", "source", "text")))
    return first.agg(listed.alias("x")).select(F.when(F.size("x") == 0, "(No corpus passages found)").otherwise(F.array_join(F.transform("x", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". ["), x["source"], F.lit("] "), x["text"])), "\n")).alias("passages"))
