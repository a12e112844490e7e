"""Rare cases that whole corpora meet: equal hashes, languages of few texts, labels of other documents."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quern.llm import embedding_dedup as E
from quern.llm import language_id, quality
from quern.llm import suffix_dedup as S
from quern.llm.common import Stored, text_bytes


def test_a_language_of_one_text_is_learnt(spark):
    french = [(i, f"le chat {i} est sur la table avec une pomme", "fr") for i in range(800)]
    rows = french + [(1000 + i, "der hund ist in dem haus und schläft", "de") for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(df, F.lit(True)).groupBy("lang_pred").count().collect()
    assert {r["lang_pred"]: r["count"] for r in got} == {"fr": 800, "de": 5000}


def test_labels_of_other_documents_take_nothing_from_the_sample(spark):
    docs = spark.createDataFrame([(i, "fine prose of words, and more of it." if i % 2 else "$$$ @@ ## 11 22") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(i, 1) for i in range(1000, 60_000)], "doc_id long, quality int")
    got = quality.quality(docs, labels, F.lit(True), train_rows=300).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got)
    assert quality.keep_good(docs, labels, train_rows=300).count() == 100


def test_vectors_of_one_hash_stay_apart(spark):
    vectors = [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [-1.0, 0.5]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id long, embedding array<double>")
    rows = rows.withColumns({"key": F.lit(7).cast("long"), "check": F.xxhash64(F.lit(31), "embedding")})
    keyed, nodes = E._keyed(rows, Stored(spark, "clash"))
    assert sorted(r["mult"] for r in nodes.collect()) == [1, 1, 2]
    assert len({r["key"] for r in nodes.collect()}) == 3 == keyed.select("key").distinct().count()


def test_strings_of_one_hash_are_cut_each_by_itself(monkeypatch):
    """Two blocks whose every string has one of few hashes, through all steps."""
    window, true = 8, S._hashes
    random = np.random.default_rng(3)
    word = lambda n: "".join(random.choice(list("abcd"), n))
    shared = [word(14) for _ in range(12)]
    texts = ["".join(word(5) + shared[k] for k in random.integers(0, 12, 4)) for _ in range(40)]
    ids = np.arange(len(texts))

    def whole(texts, ids, blobs):
        raw, offsets = text_bytes(pa.array(texts))
        return S._cover(raw, offsets, ids, blobs, window)

    def run():
        blocks = [ids[::2], ids[1::2]]
        tables = [pa.table({"id": pa.array(b), "text": pa.array([texts[i] for i in b]), "block": pa.array(np.full(len(b), n))}) for n, b in enumerate(blocks)]
        every = []
        for t in tables:
            raw, offsets = text_bytes(t.column("text"))
            every.append(S._strings(raw, offsets, window)[3])
        flags = np.unique(np.concatenate(every) >> np.uint64(64 - S.SHARE_BITS))
        told = pa.table({"data": pa.array([S.pack(S._steps(flags))], pa.binary())})
        shipped = [S._ship(window, 1)(t, told) for t in tables]
        said = S._judge(window)(pa.concat_tables(shipped))
        by_block = [[d.as_py() for n, d in zip(said.column("number").to_pylist(), said.column("data")) if n == k] for k in range(2)]
        return [whole(t.column("text").to_pylist(), t.column("id").to_numpy(), b).tolist() for t, b in zip(tables, by_block)]

    expected = run()
    least = {}
    for i in ids:
        for a in range(len(texts[i]) - window + 1):
            least.setdefault(texts[i][a : a + window], i)
    for block, got in zip([ids[::2], ids[1::2]], expected):
        mark = []
        for i in block:
            own = np.zeros(len(texts[i]), bool)
            for a in range(len(texts[i]) - window + 1):
                if least[texts[i][a : a + window]] < i:
                    own[a : a + window] = True
            mark += own.tolist()
        assert got == mark
    # anchors keep their hashes; strings, which are longer, get one of three
    monkeypatch.setattr(S, "_hashes", lambda sums, down, a, b: np.where(np.asarray(b) - np.asarray(a) >= window, true(sums, down, a, b) % np.uint64(3), true(sums, down, a, b)))
    assert run() == expected


def shipped_strings(texts, window, shards=1):
    """What a block of texts, all of whose anchors are shared, ships to its shards."""
    docs = pa.table({"id": pa.array(range(len(texts))), "text": pa.array(texts), "block": pa.array([0] * len(texts))})
    raw, offsets = text_bytes(docs.column("text"))
    flags = np.unique(S._strings(raw, offsets, window)[3] >> np.uint64(64 - S.SHARE_BITS))
    return S._ship(window, shards)(docs, pa.table({"data": pa.array([S.pack(S._steps(flags))], pa.binary())}))


def test_strings_that_share_an_anchor_but_no_window_need_no_suffix_array(monkeypatch):
    """Frequent phrases shorter than a window made most of the work, more than in proportion to the input."""
    random = np.random.default_rng(7)
    word = lambda n: "".join(random.choice(list("abcdefghijklmnop"), n))
    phrase, passage = word(30), word(60)
    seen, whole = [], S.window_owners
    monkeypatch.setattr(S, "window_owners", lambda text, *more: seen.append(len(text)) or whole(text, *more))
    S._judge(50)(shipped_strings([word(60) + phrase + word(60) for _ in range(200)], 50))
    assert sum(seen) < 1000
    # two texts that share a window with others of their anchors are compared, whatever the others are
    texts = [word(60) + phrase + word(60) for _ in range(50)] + [word(40) + passage + word(40) for _ in range(2)]
    seen.clear()
    S._judge(50)(shipped_strings(texts, 50))
    assert 100 < sum(seen) < 2000


def test_suffix_arrays_of_parts_of_a_shard(monkeypatch):
    random = np.random.default_rng(9)
    word = lambda n: "".join(random.choice(list("ab"), n))
    shared = [word(90) for _ in range(20)]
    texts = [word(30) + shared[random.integers(0, 20)][random.integers(0, 30) :] + word(30) for _ in range(200)]
    said = [[x.tolist() for x in S.unpack(d.as_py())] for d in S._judge(50)(shipped_strings(texts, 50)).column("data")]
    calls, whole = [], S.window_owners
    monkeypatch.setattr(S, "window_owners", lambda text, *more: calls.append(len(text)) or whole(text, *more))
    monkeypatch.setattr(S, "ARRAY_BYTES", 500)
    assert [[x.tolist() for x in S.unpack(d.as_py())] for d in S._judge(50)(shipped_strings(texts, 50)).column("data")] == said
    assert len(calls) > 5


def test_blobs_of_strings_grow_as_the_input(spark, monkeypatch):
    monkeypatch.setattr(S, "PLAIN_BYTES", 20_000)
    monkeypatch.setattr(S, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(S, "SHARD_BYTES", 500)
    shards, numbers, ship, lit = [], [], S._ship, F.lit
    monkeypatch.setattr(S, "_ship", lambda window, n: shards.append(n) or ship(window, n))
    monkeypatch.setattr(S.F, "lit", lambda x: numbers.append(x) or lit(x))
    blobs = []
    for n in (400, 1600):
        numbers.clear()
        S.cut_repeats(spark.range(n).selectExpr("id AS doc_id", "repeat('x', 100) AS text"))
        blobs.append(max(numbers) * shards[-1])  # blocks are told by the literal that rows are dealt by
    assert blobs[0] > 100 and blobs[1] <= 5 * blobs[0]
