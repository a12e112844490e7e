"""The corpus: articles to chunks, keys and conflicts, counts, the token index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X

# Sources that go by another name in the corpus.
SOURCE_NAMES = {"chid_train": "chid", "chid_test": "chid", "chid_validation": "chid"}


def rename_sources(articles: DataFrame, names: dict[str, str] = SOURCE_NAMES) -> DataFrame:
    out = F.col("source")
    for old, new in names.items():
        out = F.when(F.col("source") == old, new).otherwise(out)
    return articles.withColumn("source", out)


def clean_articles(articles: DataFrame) -> DataFrame:
    """Articles (source, source_article_id, title, text) with nulls as '', marked blanks taken out, and none without text."""
    text = F.when(F.col("source").startswith("chid"), X.clean_idiom_markers(F.col("text"))).otherwise(F.col("text"))
    out = articles.withColumns({"title": F.coalesce("title", F.lit("")), "source_article_id": F.col("source_article_id").cast("string"), "text": F.coalesce(text, F.lit(""))})
    return out.where(~X.blank(F.col("text")))


def chunk_articles(articles: DataFrame, min_chars: int = X.MIN_CHUNK_CHARS, ends: str = X.SENTENCE_ENDS, keep: tuple[str, ...] = ("source", "source_article_id", "title")) -> DataFrame:
    """A row per chunk: keep, chunk_index, text, char_count, content_hash. No shuffle."""
    rows = articles.select(*keep, F.posexplode(X.chunks(F.col("text"), min_chars, ends)).alias("chunk_index", "text"))
    return rows.withColumns({"char_count": F.length("text"), "content_hash": X.content_hash(F.col("text"))})


def first_articles(articles: DataFrame, arrival: str = "arrival") -> DataFrame:
    """One article per (source, source_article_id): the one that arrived first."""
    return articles.groupBy("source", "source_article_id").agg(F.min_by(F.struct("title", "text"), arrival).alias("a"), F.min(arrival).alias(arrival)).select("source", "source_article_id", "a.*", arrival)


def merge_chunks(chunks: DataFrame, arrival: str = "arrival") -> DataFrame:
    """One chunk per (source, source_article_id, chunk_index): the first to arrive. A longer later article so adds its tail."""
    key = ["source", "source_article_id", "chunk_index"]
    rest = [c for c in chunks.columns if c not in (*key, arrival)]
    return chunks.groupBy(*key).agg(F.min_by(F.struct(*rest), arrival).alias("c")).select(*key, "c.*")


def number_chunks(chunks: DataFrame) -> DataFrame:
    """chunk_id in order of source, article and index.

    Ids are a range partition's number and a place in it, so numbering needs no single task; they ascend, with gaps.
    """
    ordered = chunks.repartitionByRange("source", "source_article_id", "chunk_index").sortWithinPartitions("source", "source_article_id", "chunk_index")
    return ordered.withColumn("chunk_id", F.monotonically_increasing_id())


def source_counts(chunks: DataFrame) -> DataFrame:
    """source, article_count, chunk_count, most chunks first. Counts are true ones over all runs."""
    return chunks.groupBy("source").agg(F.count_distinct("source_article_id").alias("article_count"), F.count(F.lit(1)).alias("chunk_count")).orderBy(F.desc("chunk_count"), "source")


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row per source, and totals where source is null."""
    return chunks.rollup("source").agg(F.count_distinct("source_article_id").alias("article_count"), F.count(F.lit(1)).alias("chunk_count"))


def source_ranges(chunks: DataFrame) -> DataFrame:
    """name, min_chunk_id, max_chunk_id of each source, by its own column."""
    return chunks.groupBy(F.col("source").alias("name")).agg(F.min("chunk_id").alias("min_chunk_id"), F.max("chunk_id").alias("max_chunk_id"))


def postings(chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """token, id, pos: the inverted index."""
    return chunks.select(id_col, F.posexplode(X.tokens(F.col("text"))).alias("pos", "token")).select("token", id_col, "pos")


def vocabulary(index: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """token, doc (texts with it), cnt (occurrences)."""
    per = index.groupBy("token", id_col).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("token").agg(F.count(F.lit(1)).alias("doc"), F.sum("n").alias("cnt"))


def vocabulary_of(chunks: DataFrame) -> DataFrame:
    """vocabulary of texts as they are read: a text's first occurrences are told inside the row, so tokens are shuffled once, combined before."""
    ordered = chunks.select(F.sort_array(X.tokens(F.col("text"))).alias("t"))
    rows = ordered.select(F.explode(F.transform("t", lambda x, i: F.struct(x.alias("token"), ((i == 0) | (F.get("t", i - 1) != x)).alias("new")))).alias("x"))
    return rows.groupBy("x.token").agg(F.count_if("x.new").alias("doc"), F.count(F.lit(1)).alias("cnt"))


def doc_count(vocab: DataFrame, token: str) -> int:
    found = vocab.where(F.col("token") == token.lower()).select("doc").first()
    return found["doc"] if found else 0


def bm25(index: DataFrame, terms: list[str], id_col: str = "chunk_id", k1: float = 1.2, b: float = 0.75, limit: int = 20) -> DataFrame:
    """Ranked retrieval over the index: id, score, best first. Texts must have all of terms."""
    sizes = index.groupBy(id_col).agg(F.count(F.lit(1)).alias("size"))
    n, mean = sizes.agg(F.count(F.lit(1)), F.avg("size")).first()
    wanted = [t.lower() for t in dict.fromkeys(terms)]
    hits = index.where(F.col("token").isin(*wanted)).groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("tf"))
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rows = hits.join(F.broadcast(df), "token").join(sizes, id_col)  # df has a row per term
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / (mean or 1)))
    out = rows.groupBy(id_col).agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("met")).where(F.col("met") == len(wanted))
    return out.orderBy(F.desc("score"), id_col).limit(limit).drop("met")


def _is(term: str):
    return lambda x: x == term


def ranked(chunks: DataFrame, terms: list[str], id_col: str = "chunk_id", k1: float = 1.2, b: float = 0.75, limit: int = 20) -> DataFrame:
    """bm25 of texts as they are read: terms are counted inside the row, and no token is shuffled.

    Two scans, one for a row of statistics and one for the scores; no job runs before the result is asked for.
    """
    wanted = [t.lower() for t in dict.fromkeys(terms)]
    # all figures of a text come from its tokens at once; filters on what explode gives aren't moved below it
    figures = lambda tokens: F.struct(F.size(tokens).alias("size"), *(F.size(F.filter(tokens, _is(t))).alias(f"tf{i}") for i, t in enumerate(wanted)))
    rows = chunks.select(id_col, F.explode(F.transform(F.array(X.tokens(F.col("text"))), figures)).alias("x")).select(id_col, "x.*").where("size > 0")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))))
    rows = rows.where(F.forall(F.array(*(F.col(f"tf{i}") for i in range(len(wanted)))), lambda x: x > 0)).join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(wanted)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        score += F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    return rows.select(id_col, score.alias("score")).orderBy(F.desc("score"), id_col).limit(limit)


def full_article(chunks: DataFrame) -> DataFrame:
    """source, source_article_id, text: chunks in order, joined by line ends."""
    parts = F.sort_array(F.collect_list(F.struct("chunk_index", "text")))
    return chunks.groupBy("source", "source_article_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))


def group_lines(lines: DataFrame, size: int = 5, order: str = "line_no", by: tuple[str, ...] = (), numbered: bool = False) -> DataFrame:
    """Groups of size consecutive lines, the last one shorter: by, group_no, text, title (first 50 characters of the first).

    Numbering within by needs its lines together; without by, all lines. With numbered, order counts from 0 within by
    already, and only the lines of a group come together.
    """
    nth = F.col(order) if numbered else F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    grouped = lines.withColumn("n", nth).groupBy(*by, F.floor(F.col("n") / size).alias("group_no")).agg(F.sort_array(F.collect_list(F.struct("n", "text"))).alias("x"))
    texts = F.transform("x", lambda x: x["text"])
    return grouped.select(*by, "group_no", F.array_join(texts, "\n").alias("text"), F.substring(texts[0], 1, 50).alias("title"))
