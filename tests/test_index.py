"""The stored index against a scan of the texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import corpus as C
from quern.operators import index as I
from quern.operators import search as S
from tests.conftest import rows


def chunks(spark, n=120):
    random = np.random.default_rng(9)
    words = "a b c aa 银 行 The the x1".split()
    data = [(i, f"s{i % 7}", str(i), f"t{i}", 0, " ".join(random.choice(words, int(random.integers(0, 30))))) for i in range(n)]
    data += [(900, "s0", "900", "t", 0, None), (901, "s1", "901", "t", 0, ""), (902, "s2", "902", "t", 0, "a a a a b a b"), (903, "s9", "903", "t", 0, "银行 a")]
    return spark.createDataFrame(data, "chunk_id long, source string, source_article_id string, title string, chunk_index int, text string")


def test_index_equals_a_scan(spark, tmp_path):
    docs = chunks(spark)
    index = I.build(docs, str(tmp_path / "index"), buckets=5)
    for term in ("a", "a b", "a a b", "银行", "THE the", "x1", "absent", "a absent", "!", "aa 银"):
        want = rows(S.phrase_hits(docs, term).select("chunk_id", "source"))
        assert rows(index.hits(term)) == want, term
        assert S.capped_count(index.hits(term), 3).first()["hits"] == min(3, len(want))
        assert [r["chunk_id"] for r in index.search(term, 9).collect()] == [r["chunk_id"] for r in S.search(docs, term, 9).collect()]
    terms = ["a b", "a a b", "银行", "the", "absent", " ", "a b", "b a b"]
    assert rows(index.count_terms_by_source(terms, 4).select("term", "source", "hits")) == rows(S.count_terms_by_source(docs, terms, 4).select("term", "source", "hits"))
    plan = index.postings(["a"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    empty = I.build(docs.limit(0), str(tmp_path / "none"), buckets=2)
    assert empty.hits("a b").count() == 0 and empty.search("a").count() == 0


def test_row_counts_equal_postings(spark):
    docs = chunks(spark)
    assert rows(C.vocabulary_of(docs)) == rows(C.vocabulary(C.postings(docs)))
    for terms in (["a"], ["a", "the"], ["absent"]):
        found = [tuple(r) for r in C.ranked(docs, terms).withColumn("score", F.round("score", 9)).collect()]
        assert found == [tuple(r) for r in C.bm25(C.postings(docs), terms).withColumn("score", F.round("score", 9)).collect()]


def turned(spark):
    """Chunks of several to an article."""
    random = np.random.default_rng(4)
    words = "a b c aa 银 行 the x1 rare".split()
    data = [(i, f"s{i // 50}", str(i // 4), f"t{i}", i % 4, " ".join(random.choice(words, int(random.integers(1, 20)), p=[0.3, 0.2, 0.1, 0.1, 0.05, 0.05, 0.15, 0.04, 0.01]))) for i in range(400)]
    return spark.createDataFrame(data, "chunk_id long, source string, source_article_id string, title string, chunk_index int, text string")


def files(index):
    out = {}
    for table in I.TABLES:
        for bucket, segments in index.state.segments[table].items():
            out[table, bucket] = {f"{s}/{n}" for s in segments for n in I._Files(index.spark, index.path).names(f"{table}/bucket={bucket}/segment={s}")}
    return out


def same(index, final, terms=("the a", "银行", "new words", "a absent"), ranked=True):
    assert rows(index.chunks) == rows(final.select(index.chunks.columns))
    for term in terms:
        want = rows(S.phrase_hits(final, term).select("chunk_id", "source"))
        assert rows(index.hits(term)) == want, term
        assert index.count_hits(term, 7) == min(7, len(want)) and index.count_hits(term) == len(want)
        assert rows(index.count_by_source(term, 5)) == rows(S.count_by_source(S.phrase_hits(final, term), 5))
    assert rows(index.vocabulary()) == rows(C.vocabulary_of(final))
    want = final.groupBy("source").agg(F.count(F.lit(1)).alias("c"), F.count_distinct("source_article_id").alias("a"), F.min("chunk_id"), F.max("chunk_id"))
    assert rows(index.sources.select("source", "chunk_count", "article_count", "min_chunk_id", "max_chunk_id")) == rows(want)
    for terms in (["a"], ["rare", "the", "a"]) if ranked else ():
        got = [tuple(r) for r in index.ranked(terms, 6).withColumn("score", F.round("score", 9)).collect()]
        assert got == [tuple(r) for r in C.ranked(final, terms, limit=6).withColumn("score", F.round("score", 9)).collect()], terms


def test_batches_of_changes(spark, tmp_path):
    docs = turned(spark).persist()
    names = docs.columns
    index = I.build(docs.where("chunk_id < 300"), str(tmp_path / "index"), buckets=64)
    moved = docs.where("chunk_id in (7, 120, 299)").withColumn("text", F.lit("new words a")).withColumn("source", F.lit("s9"))
    index = index.apply(1, docs.where("chunk_id >= 300"))
    index = index.apply(2, moved, docs.where("chunk_id in (0, 399, 60) or source_article_id = '30'").select("chunk_id"))
    final = docs.where("chunk_id not in (0, 399, 60, 7, 120, 299) and source_article_id <> '30'").unionByName(moved.where("source_article_id <> '30'").select(names)).persist()
    kept = files(index)
    same(index, final)
    assert index.apply(2, docs) is index  # a batch that comes again
    assert I.open_index(spark, index.path).state == index.state
    merged = index.merge()
    assert rows(merged.chunks) == rows(final.select(merged.chunks.columns)) and rows(merged.vocabulary()) == rows(C.vocabulary_of(final))
    now = files(merged)
    touched = {k for k in kept if now.get(k) != kept[k]}
    for table, bucket in touched:
        assert len(index.state.segments[table][bucket]) > 1 or int(bucket) in index.state.dirty[table]
    assert any(t == "chunks" for t, _ in kept.keys() - touched) and any(t == "postings" for t, _ in touched)
    merged.vacuum()
    same(merged, final, ("new words",), False)
    one = merged.apply(3, deletes=docs.select("chunk_id"))
    assert one.chunks.count() == 0 and one.hits("a").count() == 0 and one.sources.count() == 0 and one.state.n == 0 == one.state.size
    again = one.apply(4, docs.where("chunk_id < 5")).merge()
    assert rows(again.chunks) == rows(docs.where("chunk_id < 5"))


def test_context_and_rows_are_read_by_key(spark, tmp_path):
    docs = turned(spark)
    index = I.build(docs, str(tmp_path / "index"), buckets=32)
    ids = [3, 17, 250]
    assert rows(index.context(ids, 1, 2)) == rows(S.context(docs, docs.where(F.col("chunk_id").isin(ids)), 1, 2))
    assert [r["chunk_id"] for r in index.article("s1", "13").collect()] == [52, 53, 54, 55]
    plan = index.rows_of(ids)._jdf.queryExecution().executedPlan().toString()
    assert "In(chunk_id, [17,250,3])" in plan or "In(chunk_id, [3,17,250])" in plan
    assert "bucket" in plan.split("PartitionFilters")[1] and len(index.rows_of(ids).inputFiles()) <= 3


def test_searches_read_a_part(spark, tmp_path, monkeypatch):
    docs = spark.range(20_000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.col("id").cast("string").alias("source_article_id"), F.lit("t").alias("title"), F.lit(0).alias("chunk_index"),
        F.when(F.col("id") % 50 == 0, "the the the rare").otherwise(F.concat(F.lit("the cat "), F.repeat(F.lit("x "), (F.col("id") % 40).cast("int")))).alias("text"))
    monkeypatch.setattr(I, "STEP_ROWS", 600)
    index = I.build(docs, str(tmp_path / "index"), buckets=4)
    read = []
    phrase, tokens = I.Index._phrase, I.Index._of_tokens
    monkeypatch.setattr(I.Index, "_phrase", lambda self, rows, *a: read.append(rows.count()) or phrase(self, rows, *a))
    assert {r["hits"] for r in index.count_by_source("the cat", 50).collect()} == {50}
    assert sum(read) < 0.2 * 2 * 20_000  # a part of the slices
    read.clear()
    tables = []
    monkeypatch.setattr(I.Index, "_of_tokens", lambda self, table, t: tables.append(table) or tokens(self, table, t))
    assert sorted(tuple(r) for r in index.count_by_source("cat", 10**6).collect()) == sorted((r["source"], r["n"]) for r in docs.where("chunk_id % 50 <> 0").groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect())
    assert not read and set(tables) == {"totals"}
    best = index.ranked(["the"], 5)
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    levels = {r["level"]: r["n"] for r in index._of_tokens("levels", ["the"]).groupBy("level").agg(F.sum("n").alias("n")).collect()}
    assert [r["chunk_id"] for r in best.collect()] == [0, 50, 100, 150, 200] and len(levels) > 1 and "level" in plan
    wanted = max(levels)
    assert f"(level#" in plan and levels[wanted] < 0.1 * sum(levels.values()) and index.postings(["the"]).where(F.col("level") == wanted).count() == 400


def test_stream_of_changes(spark, tmp_path):
    docs = turned(spark).where("chunk_id < 40")
    index = I.build(docs.where("chunk_id < 20"), str(tmp_path / "index"), buckets=8)
    changes = docs.where("chunk_id >= 20").withColumn("deleted", F.lit(False)).unionByName(docs.where("chunk_id < 4").withColumn("deleted", F.lit(True)))
    changes.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(changes.schema).json(str(tmp_path / "in"))
    I.follow(stream, index.path, str(tmp_path / "checkpoint")).awaitTermination()
    now = I.open_index(spark, index.path)
    assert rows(now.chunks) == rows(docs.where("chunk_id >= 4")) and now.state.last_batch == 1


def test_texts_are_split_once_and_postings_stay(spark, tmp_path, monkeypatch):
    made, plans = [], {}
    postings, put = I._postings, I.Index._put
    monkeypatch.setattr(I, "_postings", lambda chunks, buckets: made.append(1) or postings(chunks, buckets))

    def noted(self, rows, table, segment):
        plans.setdefault(table, []).append(rows._jdf.queryExecution().executedPlan().toString())
        return put(self, rows, table, segment)

    monkeypatch.setattr(I.Index, "_put", noted)
    docs = chunks(spark)
    index = I.build(docs, str(tmp_path / "index"), buckets=3)
    assert len(made) == 1 and "Exchange" not in plans["postings"][0] and plans["chunks"][0].count("Exchange hashpartitioning") == 1
    index.apply(1, docs.where("chunk_id < 50").withColumn("text", F.lit("new a"))).merge()
    assert len(made) == 3  # the batch's texts, and those that it replaces
    assert all("REPARTITION" not in p for p in plans["postings"])  # ids of dead rows may be shuffled
    kept = index.postings(["a"]).where("chunk_id = 902").first()
    assert (kept["size"], kept["tf"], list(kept["positions"])) == (7, 5, [0, 1, 2, 3, 5])


def test_blocks_of_postings(monkeypatch):
    import pyarrow as pa

    random = np.random.default_rng(3)
    texts = [None, []] + [[f"w{x}" for x in random.integers(0, 30, random.integers(0, 60))] for _ in range(50)]
    batch = pa.RecordBatch.from_pydict({"chunk_id": pa.array(range(52)), "source": pa.array(["s"] * 52), "slice": pa.array(random.integers(0, 9, 52).astype(np.int32)), "tokens": pa.array(texts, pa.list_(pa.string()))})
    want = sorted((t, i, len(x), [k for k, u in enumerate(x) if u == t]) for i, x in enumerate(texts) if x for t in set(x))
    for most in (10**6, 100):  # whole, and in parts
        monkeypatch.setattr(I, "BLOCK_TOKENS", most)
        found = [r for b in I._block(batch) for r in b.to_pylist()]
        assert sorted((r["token"], r["chunk_id"], r["size"], r["positions"]) for r in found) == want and all(r["tf"] == len(r["positions"]) for r in found)
        if most > 100:
            assert [(r["token"], r["slice"]) for r in found] == sorted((r["token"], r["slice"]) for r in found)


def test_deferred_index_equals_a_scan(spark, tmp_path, monkeypatch):
    docs = turned(spark).persist()
    split = []
    monkeypatch.setattr(I, "_split", lambda chunks, *a, of=I._split: split.append(sorted(r["chunk_id"] for r in chunks.select("chunk_id").collect())) or of(chunks, *a))
    index = I.build(docs.where("chunk_id < 300").withColumn("text", F.concat(F.lit("old "), "text")), str(tmp_path / "index"), buckets=2, deferred=True)
    index = index.apply(1, docs.where("chunk_id >= 40")).apply(2, deletes=docs.where("chunk_id % 9 = 0").select("chunk_id"))
    final = docs.where("chunk_id % 9 <> 0").withColumn("text", F.when(F.col("chunk_id") < 40, F.concat(F.lit("old "), "text")).otherwise(F.col("text")))
    assert not split and rows(index.chunks) == rows(final.select(index.chunks.columns))
    for read in (lambda: index.hits("a"), lambda: index.vocabulary(), lambda: index.ranked(["a"])):
        with pytest.raises(ValueError):
            read()
    now = index.refresh("postings")  # texts that are gone are not split
    assert split == [sorted(r["chunk_id"] for r in final.collect())] and now.behind("totals")
    assert rows(now.count_by_source("the", 5)) == rows(S.count_by_source(S.phrase_hits(final, "the"), 5))
    assert rows(now.hits("the a")) == rows(S.phrase_hits(final, "the a").select("chunk_id", "source"))
    now = now.refresh()
    assert rows(now.vocabulary()) == rows(C.vocabulary_of(final))
    assert I.open_index(spark, now.path).state == now.state and now.refresh() is now
    split.clear()
    now = now.apply(3, docs.where("chunk_id in (9, 10, 11)").withColumns({"text": F.lit("new words a"), "source": F.lit(None).cast("string")}), docs.where("chunk_id in (0, 50, 51)").select("chunk_id"))
    assert now.behind("postings") and not split
    final = final.where("chunk_id not in (9, 10, 11, 50, 51)").unionByName(docs.where("chunk_id in (9, 10, 11)").withColumns({"text": F.lit("new words a"), "source": F.lit(None).cast("string")}))
    half = now.refresh("totals")
    assert split == [[10, 11, 50, 51], [9, 10, 11]] and rows(half.vocabulary()) == rows(C.vocabulary_of(final))
    same(half.merge(), final, ("the a",))  # brings the others up first


def test_texts_in_latin_letters_are_split_as_others(spark):
    letters = "".join(map(chr, range(1, 0x600))) + "ẞKſ①Ⅷ銀İ_"
    texts = [f"{c}" for c in letters] + [f"A{c}b{c}{c}C" for c in letters] + ["Der Größe_nach: ÉCOLE, l'été 3½x²", "ab İ ab", None, "", "The the THE 银行"]
    docs = spark.createDataFrame([(i, "s" if i % 3 else None, t) for i, t in enumerate(texts)], "chunk_id long, source string, text string")
    want = docs.select("chunk_id", "source", F.posexplode(X.tokens(F.col("text"))).alias("at", "token"))
    found = I._postings(docs, 4).select("chunk_id", "source", F.explode("positions").alias("at"), "token")
    assert rows(found) == rows(want)
    counted = want.groupBy("token", "source").agg(F.count_distinct("chunk_id").alias("docs"), F.count(F.lit(1)).alias("uses"))
    assert rows(I._counts(docs, 4).groupBy("token", "source").agg(F.sum("docs"), F.sum("uses"))) == rows(counted)


def test_deferred_batches_shuffle_only_ids_that_come_again(spark, tmp_path, monkeypatch):
    docs, plans, put = turned(spark), [], I.Index._put

    def noted(self, rows, table, segment):
        if table == "chunks":
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return put(self, rows, table, segment)

    monkeypatch.setattr(I.Index, "_put", noted)
    index = I.build(docs, str(tmp_path / "index"), buckets=4, deferred=True)
    assert "Exchange" not in plans[0] and ".zstd." in index._read("chunks").inputFiles()[0]
    some = docs.where("chunk_id < 9").unionByName(docs.where("chunk_id < 9").withColumn("text", F.concat("text", F.lit(" more"))))
    nulls = docs.where("chunk_id < 3").withColumn("chunk_id", F.lit(None).cast("long"))
    index = index.apply(1, docs.where("chunk_id < 20").where("chunk_id >= 9").unionByName(some).unionByName(nulls))
    assert plans[1].count("Exchange hashpartitioning") == 1
    more = docs.withColumn("text", F.when(F.col("chunk_id") < 9, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    assert rows(index.chunks.where("chunk_id is not null")) == rows(more.select(index.chunks.columns)) and index.chunks.where("chunk_id is null").count() == 1
    assert [r["text"] for r in index.chunks.where("chunk_id is null").collect()] == [max(tuple(r) for r in nulls.select("source", "source_article_id", "title", "chunk_index", "text").collect())[-1]]


def test_words_of_bytes():
    import re

    import pyarrow as pa

    random = np.random.default_rng(5)
    letters = [chr(c) for c in range(1, 0x180) if c != 0x130] + list(" _aé9Z" * 40)
    texts = ["", "a", "b", "é", "", " x", "_", "Ÿab", ""] + ["".join(random.choice(letters, int(random.integers(0, 90)))) for _ in range(300)]
    for own in (texts, texts[4:5], ["", ""], ["_ "], []):
        sizes, words = I._words(pa.array(["left out"] + own, pa.string()).slice(1))
        want = [re.findall(r"[^\W_]+", t.lower()) for t in own]
        assert sizes.tolist() == [len(w) for w in want] and words.to_pylist() == [w for x in want for w in x]
