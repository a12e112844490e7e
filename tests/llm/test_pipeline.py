"""The pipeline's stages on awkward tables and against plain versions of what they do."""

import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm.common import Stored
from tests.conftest import rows
from tests.llm.test_operators import BPE, awkward, plain_components, plain_cut, prose, table  # noqa: F401


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """A small corpus: prose of two sources, shouting junk, near-copies and a shared passage, with labels of quality."""
    base = tmp_path_factory.mktemp("sf")
    texts = [t + " " + u for t, u in zip(prose("en", 120, 21), prose("de", 120, 22), strict=True)]
    passage = "this exact passage of well over fifty bytes stands in several of the documents."
    texts += [f"{t} {passage} {u}" for t, u in zip(texts[:8], texts[40:48], strict=True)]
    texts += [t + " end" for t in texts[:5]]
    junk = [" ".join(f"{w.upper()}!!" for w in t.split()) for t in prose("en", 40, 23)]
    data = list(enumerate(texts + junk))
    table(spark, data).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "b").otherwise("a")).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(base / "documents.parquet"))
    spark.createDataFrame([(i, int(i < len(texts)), 0) for i, _ in data if i % 2], "doc_id long, quality int, toxic int").write.parquet(str(base / "labels.parquet"))
    return str(base)


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "repeats", "mix", "encode"]
    store, docs = Stored(spark, "stages"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(store.keep(stage(spark, seen[-1], sf_dir), name))
        assert seen[-1].columns == columns
    good, one, cut, mixed = ({r["doc_id"]: r["text"] for r in d.collect()} for d in seen[1:])
    assert all(i < 133 for i in good) and len(good) >= 131
    want = plain_components(list(good.items()), 5, 80)
    assert set(one) == {i for i, (_, root) in want.items() if i == root}
    plain = plain_cut(list(one.items()), 50)
    assert cut == {i: p[4] for i, p in plain.items() if p[4].strip(" \t\n\v\f\r")}
    assert set(mixed) <= set(cut) and all(mixed[i] == cut[i] for i in mixed)
    words = sum(len(t.split()) for t in cut.values())
    assert abs(seen[-1].select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0] - words) < 0.2 * words
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in corpus_pipeline.encode(spark, seen[-1], sf_dir).collect():
        assert r["ids"] == library.encode_ordinary(mixed[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) and r["decoded_sha256"] == hashlib.sha256(mixed[r["doc_id"]].encode()).hexdigest()


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() > 100 and got.columns == ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_awkward_tables(spark, sf_dir, awkward, name):  # noqa: F811
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, awkward, sf_dir)
    if name != "encode":
        assert got.columns == awkward.columns
    got.count()
    assert stage(spark, awkward.limit(0), sf_dir).count() == 0
    assert rows(got.limit(1)) is not None
