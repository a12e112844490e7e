"""Each operator against a plain version, and on awkward tables: nulls, empty and long texts, ties, repeats, clashing names."""

import base64
import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import byte_bpe, embedding_dedup, language_id, mpeg_audio, quality, source_mix, suffix_dedup, token_counts, toxicity
from quern.llm import minhash as M
from quern.llm import words
from quern.llm.suffix_array import permuted_lcp, suffix_array
from tests.conftest import rows

BPE, SPM = P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model")
#: Columns whose names the operators use inside.
CLASH = "n long, key string, kept boolean, component_id string, id string, train string, block string, size string, row string, score string, tie string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
LONG = " ".join(f"w{i % 977}é" for i in range(40_000))
BASE = "the quick brown fox jumps over the lazy dog while seven wizards brew strange potions in the old castle by the sea and nobody hears"


def table(spark, texts, source="s"):
    """doc_id from 0, or (doc_id, text) pairs."""
    data = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", source, None if t is None else len(t), 1, "k", False, "c", "i", "t", "b", "z", "r", "s", "q") for i, t in data], SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    return table(spark, [None, "", " \t\n", "a", "same text here", "same text here", (9, "same text here"), (9, "other"), (None, "no id"), (None, None), LONG, "ÄÖ 的 🙂 x\x00y", "!" * 3000]).persist()


OPERATORS = {
    "language": lambda d: language_id.identify(d, F.lit(True)),
    "near": lambda d: M.near_copies(d, width=3, percent=85),
    "tokens": lambda d: token_counts.token_counts(d, SPM),
    "bpe": lambda d: byte_bpe.bpe_digests(d, BPE, P.PATTERN),
    "mix": source_mix.mix_sources,
    "repeats": suffix_dedup.cut_repeats,
    "media": mpeg_audio.media_digests,
    "quality": lambda d: quality.quality(d, labels(d, "quality"), F.lit(True)),
    "toxicity": lambda d: toxicity.toxicity(d, labels(d, "toxic"), F.lit(True)),
}


def labels(docs, name):
    return docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias(name), F.lit("x").alias("id"), F.lit("y").alias("text"))


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_and_empty_tables(awkward, name):
    got = OPERATORS[name](awkward)
    assert got.count() == awkward.count()
    empty = OPERATORS[name](awkward.limit(0))
    assert empty.count() == 0 and empty.columns == got.columns


# -- near-copies


def sets_of(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(zip(*(w[k:] for k in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset()


def plain_components(data, width, percent):
    s = {i: sets_of(t, width) for i, t in data}
    root = {i: i for i in s}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(s), 2):
        if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: (len(s[i]), top(i)) for i in s}


def edited(seed, n):
    random = np.random.default_rng(seed)
    words = (BASE + " " + BASE.upper()).split()
    out = []
    for i in range(n):
        w = list(words)
        for _ in range(int(random.integers(0, 6))):
            w[int(random.integers(0, len(w)))] = f"x{random.integers(0, 50)}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("width, percent, block", [(3, 85, 256), (5, 80, 256), (3, 85, 7)])
def test_near_copies_match_brute_force(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(M, "BLOCK_SETS", block)
    data = edited(4, 60) + [(100 + i, t) for i, t in enumerate(["one", "ONE", "one two", "a b c d", None, "", "lonely words that stand alone here"])]
    want = plain_components(data, width, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in M.near_copies(table(spark, data), width=width, percent=percent).collect()}
    assert got == want


def test_hot_group_and_null_ids(spark):
    data = [(i, "hot text of one third") for i in range(200)] + [(None, "hot text of one third")]
    got = rows(M.near_copies(table(spark, data)).select("doc_id", "component_id", "kept"))
    assert got.count((None, None, True)) == 1 and all(r[1] == 0 for r in got if r[0] is not None) and sum(r[2] for r in got if r[0] is not None) == 1


def test_keep_one(spark):
    docs = table(spark, [(3, "same text"), (1, "same text"), (1, "zz other"), (None, "same text"), (7, "alone"), (7, "alone")])
    got = M.keep_one(docs)
    assert got.columns == docs.columns
    found = rows(got.select("doc_id", "text"))
    assert [r[0] for r in found] == [1, 7, None] and found[0][1] in ("same text", "zz other")


def test_texts_that_share_an_id_are_linked_by_their_own_sets(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    data = [(1, a), (1, b), (1, c), (2, a + " x"), (3, b + " y"), (4, c + " z"), (5, "alone"), (5, "other"), (5, "other"), (6, ""), (6, None), (None, a)]
    got = rows(M.near_copies(table(spark, data)).select("doc_id", "component_id"))
    assert [r[1] for r in got if r[0] in (2, 3, 4)] == [1, 1, 1]
    found = {(r["doc_id"], r["text"]) for r in M.keep_texts(table(spark, data)).collect()}
    assert found == {(1, a), (1, b), (1, c), (5, "alone"), (5, "other"), (6, ""), (6, None), (None, a)}
    assert M.keep_texts(table(spark, data)).count() == len(found)


def test_structured_words_do_not_collide(spark):
    """A Thue-Morse word and its complement have one polynomial hash modulo 2**64, whatever the odd base."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    got = rows(M.near_copies(table(spark, [f"{a} x y", f"{b} x y", a, b, f"{a}  X y"]), width=3, percent=85).select("doc_id", "component_id"))
    assert got == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 0)]


def test_sets_survive_equal_hashes(monkeypatch):
    """Words of one hash: sets are told apart by their words, in counts and in comparisons."""
    monkeypatch.setattr(words, "hashes", lambda raw, first, last: np.full(len(first), 5, np.uint64))
    texts = ["a b c d", "a b a b a b", "d c b a", "a b", "b a", "A\tB  c d", ""]
    raw = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    sets = M.exact_sets(np.frombuffer(raw, np.uint8), offsets, 3)
    want = [sets_of(t, 3) for t in texts]
    assert [len(s) for s in sets] == [len(w) for w in want] == np.diff(M.shingle_sets(np.frombuffer(raw, np.uint8), offsets, 3)[1]).tolist()
    for i, j in itertools.combinations(range(len(texts)), 2):
        assert len(np.intersect1d(sets[i], sets[j])) == len(want[i] & want[j])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB \té", max_size=40) | st.sampled_from(["x" * 300, "x" * 129 + "y", "z" * 128]), max_size=8), st.integers(1, 5))
def test_exact_sets(texts, width):
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    sets, want = M.exact_sets(raw, offsets, width), [sets_of(t, width) for t in texts]
    assert [len(s) for s in sets] == [len(w) for w in want] == np.diff(M.shingle_sets(raw, offsets, width)[1]).tolist()
    assert all(len(np.intersect1d(sets[i], sets[j])) == len(want[i] & want[j]) for i, j in itertools.combinations(range(len(texts)), 2))


def test_texts_that_only_meet_in_part_are_not_compared_as_one_family(spark, monkeypatch):
    """Half-similar texts fill buckets without being linked; links between them are found all the same."""
    monkeypatch.setattr(M, "BLOCK_SETS", 5)
    random = np.random.default_rng(12)
    common = [f"c{i}" for i in range(60)]
    data = []
    for i in range(90):
        own = [f"o{i // 2}x{k}" for k in range(int(random.integers(10, 40)))] if i % 2 == 0 else own + [f"e{i}"]
        data.append((i, " ".join(common + own)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in M.near_copies(table(spark, data), width=3, percent=85).collect()}
    assert got == plain_components(data, 3, 85)


def test_components_with_hubs(spark):
    from quern.llm.common import Stored
    from quern.llm.components import components

    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5040)] + [(2999, 5000), (9000, 9001), (9001, 9001), (None, 3)]
    got = rows(components(spark.createDataFrame(edges, "a long, b long"), "a", "b", Stored(spark, "hubs"), "x"))
    assert got == sorted([(i, 0) for i in [*range(1, 3000), *range(5000, 5041)]] + [(9001, 9000)], key=repr)


def test_signatures_estimate_similarity():
    a = np.arange(1000, dtype=np.uint64)
    s = M.signatures(np.concatenate([a, a + np.uint64(200)]), np.array([0, 1000]), 600)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.08


# -- repeats


def plain_cut(data, window):
    raw = {i: (t or "").encode() for i, t in data}
    first = {}
    for i in sorted(raw):
        for s in range(len(raw[i]) - window + 1):
            first.setdefault(raw[i][s : s + window], i)
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if first[b[s : s + window]] < i:
                gone[s : s + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"))
    return out


@pytest.mark.parametrize("window, piece", [(50, 1 << 20), (12, 1 << 20), (50, 300)])
def test_repeats_match_brute_force(spark, monkeypatch, window, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", piece)
    monkeypatch.setattr(suffix_dedup, "CALL_BYTES", piece)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 4000)
    random = np.random.default_rng(5)
    passage = ["".join(random.choice(list("abcé 的")) for _ in range(n)) for n in (49, 50, 70, 200)]
    data = []
    for i in range(40):
        parts = ["".join(random.choice(list("abcdefgh é")) for _ in range(random.integers(0, 120))) for _ in range(3)]
        parts.insert(1, passage[int(random.integers(0, 4))])
        data.append((int(random.permutation(1000)[0]) * 40 + i, "".join(parts)))
    data += [(50_000, data[0][1]), (50_001, None), (50_002, ""), (50_003, "ab" * 200), (50_004, "ab" * 150), (50_005, "ab" * 200)]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.cut_repeats(table(spark, data), window=window).collect()}
    want = plain_cut(data, window)
    assert got == {k: v[:4] for k, v in want.items()}
    docs = table(spark, data)
    texts = suffix_dedup.without_repeats(docs, window=window)
    assert texts.columns == docs.columns
    for r in texts.collect():
        assert (r["text"] or "") == want[r["doc_id"]][4] and (r["n_chars"] or 0) == len(r["text"] or "")


def test_equal_ids_do_not_cut_each_other(spark):
    p = "x".join(map(str, range(40)))
    got = rows(suffix_dedup.cut_repeats(table(spark, [(1, p), (1, p), (None, p)])).select("doc_id", "n_removed"))
    assert got == [(1, 0), (1, 0), (None, len(p))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60), st.integers(1, 4))
def test_suffix_array(symbols, times):
    text = np.array(symbols * times + [0], np.uint8)
    b = bytes(text)
    order = suffix_array(text)
    assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    lcp = permuted_lcp(text, order)
    for x, y in itertools.pairwise(order.tolist()):
        n = next((k for k in itertools.count() if max(x, y) + k >= len(b) or b[x + k] != b[y + k]))
        assert lcp[y] == n


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_recurses_over_names(seed):
    random = np.random.default_rng(seed)
    words = [random.integers(1, 1 + seed % 3 + 1, k) for k in (3, 7, 20)]
    fibonacci = [np.array([1]), np.array([1, 2])]
    while len(fibonacci[-1]) < 600:
        fibonacci.append(np.concatenate(fibonacci[:-3:-1]))
    for body in (np.concatenate([words[i] for i in random.integers(0, 3, 120)]), fibonacci[-1][seed:], np.repeat(words[0], 40)):
        b = bytes([*body.tolist(), 0])
        assert suffix_array(np.frombuffer(b, np.uint8)).tolist() == sorted(range(len(b)), key=lambda i: b[i:])


# -- tokens


TEXTS = ["", " ", "a  b", "The cat sat.", "x" * 300, "é的🙂 ▁ a▁b", "tab\tand\nline \n\n end ", "<s> </s> <unk>", "word " * 50, "  lead", "trail  ", "１２３ ﬁ"]


def test_token_counts_match_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=SPM)
    got = rows(token_counts.token_counts(table(spark, TEXTS + [None, LONG]), SPM))
    for i, n_bytes, n, over in got:
        t = (TEXTS + ["", LONG])[i]
        assert (n_bytes, n, over) == (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .▁\né的", max_size=80), st.integers(1, 12))
def test_cuts_are_safe(text, limit):
    sp = sentencepiece.SentencePieceProcessor(model_file=SPM)
    assert token_counts.count_tokens([text], SPM, long_chars=limit) == [len(sp.encode(text))]


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(text=st.text(max_size=60) | st.text(alphabet="abeilnrst 'é的!\n", max_size=200))
def test_bpe_matches_the_library(encoding, text):
    c = byte_bpe.coder(BPE, P.PATTERN)
    ids = c.encode(text)
    assert ids == encoding.encode_ordinary(text) and c.decode(ids) == text.encode()


def test_bpe_columns(spark, encoding):
    docs = table(spark, [*TEXTS, None, LONG, "ab" * 5000])
    for (i, n, a, b), (_, text) in zip(rows(byte_bpe.bpe_digests(docs, BPE, P.PATTERN)), rows(docs.select("doc_id", "text")), strict=True):
        ids = encoding.encode_ordinary(text or "")
        assert (n, a, b) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    ids = byte_bpe.bpe_ids(docs, BPE, P.PATTERN)
    back = byte_bpe.bpe_text(ids, BPE, P.PATTERN)
    assert [(i, bytes(d).decode()) for i, d in rows(back)] == [(i, t or "") for i, t in rows(docs.select("doc_id", "text"))]


# -- mixing


def test_mix(spark):
    random = np.random.default_rng(2)
    data = [(i, " ".join(["w"] * int(random.integers(0, 400)))) for i in range(3000)]
    docs = table(spark, data).withColumn("source", F.when(F.col("doc_id") < 2000, "a").when(F.col("doc_id") < 2900, "b").when(F.col("doc_id") < 2990, "c"))
    got = source_mix.mix_sources(docs)
    by = {r["source"]: r for r in got.groupBy("source").agg(F.sum("size").alias("size"), F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max("copies").alias("copies")).collect()}
    total = sum(r["size"] for r in by.values())
    assert sum(r["target"] for r in by.values()) == pytest.approx(total)
    for r in by.values():
        assert r["target"] <= 3 * r["size"] + 1e-6 and abs(r["taken"] - r["target"]) <= 1600 and r["copies"] <= 3
    assert by[None]["target"] == pytest.approx(3 * by[None]["size"]) or by["c"]["target"] == pytest.approx(3 * by["c"]["size"])
    assert rows(got) == rows(source_mix.mix_sources(docs.repartition(5)))
    taken = source_mix.take_mix(docs)
    assert taken.columns == docs.columns and taken.count() == got.agg(F.sum("copies")).first()[0]
    assert rows(taken.groupBy("doc_id").count()) == rows(got.where("copies > 0").select("doc_id", "copies"))


def test_mix_repeated_rows(spark):
    docs = table(spark, [(1, "a b c")] * 7 + [(None, "x")] * 3)
    assert source_mix.take_mix(docs).count() == source_mix.mix_sources(docs).agg(F.sum("copies")).first()[0] == 10


# -- embeddings


def vectors(n=400, seed=3):
    random = np.random.default_rng(seed)
    x = random.normal(size=(n, 16))
    for i in range(0, n, 4):
        x[i + 1] = x[i] + random.normal(size=16) * 0.1
        x[i + 2] = x[0] + random.normal(size=16) * 0.15 if i < 160 else x[i + 2]
    return x.astype(np.float32)


@pytest.mark.parametrize("shard", [600, 60])
def test_embedding_links_match_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(embedding_dedup, "SHARD_ROWS", shard)
    x = vectors()
    data = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, x[5].tolist(), 1), (901, None, 1), (902, [], 1), (903, [0.0] * 16, 1), (904, [float("nan")] * 16, 1), (905, [None] + [1.0] * 15, 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, key int")
    full = np.vstack([x, x[5]]).astype(np.float64)
    ids = [*range(len(x)), 900]
    link = (full @ full.T) / np.outer(np.linalg.norm(full, axis=1), np.linalg.norm(full, axis=1)) >= 0.9
    np.fill_diagonal(link, False)
    label = np.arange(len(full))
    for _ in range(len(full)):
        label = np.minimum(label, np.where(link, label[None, :], len(full)).min(1))
    want = {i: (int(link[k].sum()), ids[label[k]]) for k, i in enumerate(ids)} | {i: (0, i) for i in range(901, 906)} | {906: (1, 906), 907: (1, 906)}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_links(df).collect()}
    found = sum(g[0] for g in got.values()) / sum(w[0] for w in want.values())
    assert found >= 0.98 and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.98 * len(want)


@pytest.mark.parametrize("shard", [12, 40])
def test_links_count_for_both_ends(spark, monkeypatch, shard):
    monkeypatch.setattr(embedding_dedup, "SHARD_ROWS", shard)
    monkeypatch.setattr(embedding_dedup, "OVERLAP", 2)
    monkeypatch.setattr(embedding_dedup, "LEAST_RECALL", 0.0)
    random = np.random.default_rng(7)
    x = random.normal(size=(300, 8))
    x[1::2] = x[::2] + random.normal(size=(150, 8)) * 0.3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_links(df).collect()}
    assert all(r["n_links"] <= link[i].sum() for i, r in got.items())
    assert not any(r["n_links"] == 0 and not r["kept"] for r in got.values())
    assert sum(r["n_links"] for r in got.values()) % 2 == 0
    alone = [i for i in range(0, 300, 2) if link[i].sum() == link[i + 1].sum() == 1 and link[i, i + 1]]
    assert len(alone) > 20 and all(got[i]["n_links"] == got[i + 1]["n_links"] for i in alone)


def test_audit_is_not_outvoted_by_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD_ROWS", 8)
    monkeypatch.setattr(embedding_dedup, "OVERLAP", 1)
    random = np.random.default_rng(5)
    x = random.normal(size=(240, 16))
    x[1::2] = x[::2] + random.normal(size=(120, 16)) * 0.35
    x[1] = x[0] * 1.5 + 0.001
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    df = df.unionByName(spark.range(1000, 31000).select(F.col("id").alias("vec_id")).crossJoin(df.where("vec_id = 0").select("embedding")))
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    want = {i: int(link[i].sum()) for i in range(2, 240) if link[i].any() and not link[i, 0]}
    got = embedding_dedup.embedding_links(df).where("vec_id < 1000").collect()
    counts = {r["vec_id"]: r["n_links"] for r in got}
    assert len(want) > 60 and sum(counts[i] == w for i, w in want.items()) >= 0.98 * len(want)
    assert got[0]["recall"] >= 0.98
    assert embedding_dedup.audited_recall({}, {}) is None and embedding_dedup.audited_recall({1: 1, 2: 100_000}, {2: 100_000}) == 0.0


def test_embedding_edge_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.embedding_links(df).count() == 0
    df = spark.createDataFrame([(1, None), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = rows(embedding_dedup.embedding_links(df).select("vec_id", "n_links", "component_id", "kept"))
    assert got == [(1, 0, 1, True), (2, 2, 2, True), (3, 0, 3, True), (3, 2, 2, False), (None, 2, 2, False)]


def test_centroids_in_two_levels(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "FLAT_CLUSTERS", 4)
    x = vectors(300, 8).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = embedding_dedup.centroids(x, 30)
    assert 20 <= len(c) <= 40 and np.allclose(np.linalg.norm(c, axis=1), 1)


def test_pruned_graph_reaches_all():
    x = vectors(300, 8).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = embedding_dedup.prune(x)
    seen, front = {embedding_dedup.medoid(x)}, [embedding_dedup.medoid(x)]
    while front:
        front = [int(j) for i in front for j in near[i] if int(j) not in seen and not seen.add(int(j))]
    assert len(seen) == 300 and max(map(len, near)) <= 4 * embedding_dedup.DEGREE
    hits = sum(i in embedding_dedup.search(x, near, x[i], np.array([embedding_dedup.medoid(x)]), 0.9) for i in range(300))
    assert hits >= 280


# -- learnt operators


def prose(kind, n, seed):
    random = np.random.default_rng(seed)
    syllables = {"en": "the and ing tion her wh ou sh", "de": "der und sch ein ich ung ver äu", "fr": "les que eau ment oi è ê ç"}[kind].split()
    word = lambda: "".join(random.choice(syllables) for _ in range(random.integers(1, 4)))
    return [" ".join(word() for _ in range(random.integers(3, 80))) for _ in range(n)]


def test_language(spark):
    data = [(k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang in ("en", "de", "fr") for t in prose(lang, 60, len(lang) + ord(lang[0])))]
    df = spark.createDataFrame([*data, (900, None, "en"), (901, "123 !", "en"), (902, "les que eau", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(df, F.col("doc_id") % 3 != 0).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in data) >= 0.97 * len(data)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[900]["score"] == 0 and got[902]["lang_pred"] == "fr"
    mixed = spark.createDataFrame([(1, "the and her der und sch " * 3, None)], "doc_id long, text string, lang string")
    assert language_id.identify(mixed, F.lit(True)).first()["lang_pred"] == "und"
    one = spark.createDataFrame([(1, "the", "en"), (2, "der", "en")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.identify(one, F.lit(True)).collect()} == {"en"}


def test_codewords():
    for k in (2, 3, 4, 5, 6, 9, 40):
        code = language_id.codewords(k)
        assert len({tuple(r) for r in code.tolist()}) == k and (np.abs(code.sum(0)) < k).all()
        if k > 3:
            assert ((code.shape[1] - code @ code.T)[~np.eye(k, dtype=bool)] / 2).min() >= code.shape[1] / 4


def test_quality(spark):
    good = prose("en", 150, 1)
    bad = [t.upper() for t in prose("en", 30, 2)] + [" | ".join(t.split()) for t in prose("en", 30, 3)] + [" ".join([w] * 20) for w in "alpha beta gamma delta epsilon zeta eta theta".split()]
    data = [(i, t) for i, t in enumerate(good + bad)]
    docs = table(spark, data)
    marks = spark.createDataFrame([(i, int(i < len(good))) for i, _ in data], "doc_id long, quality int")
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    got = quality.quality(docs, marks, ~out).join(marks, "doc_id").where(out).collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got) and all(0 <= r["score"] <= 1 for r in got)
    kept = quality.keep_good(docs, marks)
    assert kept.columns == docs.columns and len({r["doc_id"] for r in kept.collect()} ^ set(range(len(good)))) <= 5
    assert quality.keep_good(docs, marks.where("quality = 1")).count() == docs.count()


def test_rules_in_columns_and_arrays_agree(spark):
    random = np.random.default_rng(4)
    x = random.random((500, len(quality.STATS)))
    y = ((x[:, 3] > 0.5) & (x[:, 7] < 0.4)).astype(float)
    model = quality.fit(x, y)
    assert 0 < len(model.rules) <= quality.MOST_RULES and all(str(r) for r in model.rules)
    df = spark.createDataFrame(x.tolist(), ", ".join(f"stat_{s} double" for s in quality.STATS))
    s = np.stack([r.holds(x) for r in model.rules], axis=1) @ model.weights + model.intercept
    assert np.allclose([r[0] for r in df.select(model.column()).collect()], 1 / (1 + np.exp(-s)))
    assert ((s > 0) == (y > 0)).mean() > 0.95


@pytest.fixture(scope="module")
def toxic(spark):
    random = np.random.default_rng(6)
    data = []
    for i, t in enumerate(prose("en", 200, 9) + prose("de", 200, 10)):
        w, bad = t.split(), i % 5 == 0
        if bad:
            for _ in range(1 + len(w) // 30):
                w.insert(int(random.integers(0, len(w))), random.choice(["zlurp", "grokzt", f"vraxq{random.choice(['en', 'er', 'on', 'al'])}"]))
        data.append((i, " ".join(w), int(bad)))
    return spark.createDataFrame(data, "doc_id long, text string, toxic int").persist()


def test_toxicity(toxic):
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    got = toxicity.toxicity(toxic.drop("toxic"), toxic.select("doc_id", "toxic"), ~out)
    held = got.join(toxic.select("doc_id", "toxic"), "doc_id").where(out).collect()
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.95 * len(held)
    joined = toxicity.toxicity(toxic.drop("toxic"), toxic.select("doc_id", "toxic"), ~out, model_rows=0)
    a, b = ({r["doc_id"]: (r["llr"], r["excess"], r["score"]) for r in d.collect()} for d in (got, joined))
    assert all(np.allclose(a[k], b[k], atol=1e-5) for k in a)


def test_toxicity_without_both_classes(spark, toxic):
    got = toxicity.toxicity(toxic.drop("toxic"), toxic.where("toxic = 0").select("doc_id", "toxic"), F.lit(True))
    assert got.select("score").distinct().count() == 1
    none = toxicity.toxicity(toxic.drop("toxic"), toxic.where("toxic > 5").select("doc_id", "toxic"), F.lit(True))
    assert none.first()["score"] == 0.5


def test_shared_orders_are_distributions(spark, toxic):
    from quern.llm.common import Stored

    schema = "g long, t0 long, t1 long, o0 long, o1 long"
    grams = toxic.select("text", F.lit(2).alias("kind")).mapInArrow(toxicity._count, schema).groupBy("g").agg(F.sum("o0").alias("n"))
    p = toxicity._shared(grams, Stored(spark, "test"))
    sums = p.groupBy(F.shiftright("g", 8)).agg(F.sum("p").alias("p"))
    assert sums.where("p > 1 + 1e-9").count() == 0 and sums.where("p < 0.2").count() == 0


# -- media


def test_payload_round_trip():
    for data in (b"", b"x", b"\xff" * 576, b"\xff\xfb\x90\x00" * 300, bytes(range(256)) * 9):
        payload = mpeg_audio.pad(data)
        media = mpeg_audio.store_payload(payload)
        s = mpeg_audio.parse(media)
        assert len(payload) % 576 == 0 and payload and mpeg_audio.read_payload(media, s) == payload
        n = len(payload) // 576
        assert (len(s.offsets), s.crc_ok, s.crc_bad, s.resyncs, s.vbr["frames"]) == (n, n, 0, 0, n) and s.duration == n * mpeg_audio.Fraction(576, 16000)
        assert s.seek(mpeg_audio.Fraction(0)) == mpeg_audio.FRAME and s.seek(s.duration) is None


@pytest.mark.parametrize("units", [1, 2, 5])
def test_payload_that_looks_like_a_tag(spark, units):
    data = b"a" * (576 * (units - 1) + 505) + b"TAG" + b"b" * 68
    media = mpeg_audio.store_payload(data)
    assert media[-128:-125] == b"TAG"
    s = mpeg_audio.parse(media)
    assert mpeg_audio.read_payload(media, s) == data and s.tags == {}
    assert (len(s.offsets), s.crc_ok, s.resyncs, s.skipped) == (units, units, 0, 0)
    tagged = mpeg_audio.parse(media + b"TAG" + b"name".ljust(125, b"\0"))
    assert tagged.tags == {"TIT2": "name"} and len(tagged.offsets) == units
    got = mpeg_audio.media_digests(table(spark, [(1, data.decode())])).first()
    assert (got["payload_bytes"], got["payload_sha256"], got["tail_crc32"]) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))


def test_resynchronisation_tags_and_checksums():
    media = bytearray(mpeg_audio.store_payload(mpeg_audio.pad(b"hello" * 700)))
    tag = b"ID3\x03\x00\x00" + bytes([0, 0, 0, 16]) + b"TIT2" + (6).to_bytes(4, "big") + b"\x00\x00\x00Title"
    junk = b"\xff\xfb\x00\xff\xe0garbage"
    cut = 3 * mpeg_audio.FRAME
    broken = bytearray(tag + bytes(media[:cut]) + junk + bytes(media[cut:]) + b"TAG" + b"name".ljust(125, b"\0"))
    s = mpeg_audio.parse(bytes(broken))
    assert s.tags["TIT2"] == "Title" and s.resyncs == 1 and s.skipped == len(junk) and len(s.offsets) == len(media) // mpeg_audio.FRAME - 1
    media[mpeg_audio.FRAME * 2 + 8] ^= 1
    s = mpeg_audio.parse(bytes(media))
    assert s.crc_bad == 1 and s.crc_ok == len(s.offsets) - 1
    assert mpeg_audio.parse(b"no frames at all").header is None and mpeg_audio.feature(mpeg_audio.parse(b"")).startswith("none")
    assert len(mpeg_audio.parse(bytes(media[:-10])).offsets) == len(s.offsets) - 1


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=3000))
def test_parser_takes_any_bytes(data):
    mpeg_audio.parse(data)
    mpeg_audio.parse(b"\xff\xfb\x90\x64" + data)


def test_media_columns(spark):
    docs = table(spark, ["hello", None, "é" * 1000])
    media = mpeg_audio.encode_column(docs)
    found = {r["doc_id"]: r for r in mpeg_audio.parse_column(media).collect()}
    assert found[2]["frames"] == 4 and found[2]["seconds_num"] / found[2]["seconds_den"] == 4 * 576 / 16000 and found[2]["offsets"] == [648 * (k + 1) for k in range(4)] and len(found[2]["toc"]) == 100
    digests = {r["doc_id"]: r for r in mpeg_audio.media_digests(docs).collect()}
    payload = mpeg_audio.pad("é".encode() * 1000)
    assert digests[2]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and digests[2]["tail_crc32"] == zlib.crc32(payload[-32:])
    assert digests[1]["n_bytes"] == 0 and digests[1]["payload_bytes"] == 576
    none = spark.createDataFrame([(1, None), (2, b"junk")], "doc_id long, media binary")
    assert rows(mpeg_audio.parse_column(none).select("frames", "seconds_num", "seconds_den")) == [(0, 0, 1), (0, 0, 1)]


# -- plain versions of statistics, language models and decoding


def plain_statistics(text):
    """Some of STATS by plain string work."""
    raw = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    lines = [x for x in raw.split(b"\n") if x]
    n = max(len(words), 1)
    letters = sum(chr(b).isalpha() and b < 128 for b in raw)
    return {
        "bytes": np.log1p(len(raw)), "words": np.log1p(len(words)), "upper_of_letters": sum(65 <= b <= 90 for b in raw) / max(letters, 1),
        "word_length": sum(map(len, words)) / n, "longest_word": max((np.log1p(len(w)) for w in words), default=0), "short_words": sum(len(w) <= 3 for w in words) / n,
        "capital_words": sum(65 <= w[0] <= 90 for w in words) / n, "repeat_words": sum(a == b for a, b in itertools.pairwise(words)) / n,
        "distinct_words": len(set(words)) / n, "distinct_by_root": len(set(words)) / np.sqrt(n), "top_word": max((words.count(w) for w in set(words)), default=0) / n,
        "lines": np.log1p(len(lines)), "repeat_lines": 1 - len(set(lines)) / len(lines) if lines else 0, "repeat_bytes": sum(a == b for a, b in itertools.pairwise(raw)) / max(len(raw), 1),
        "high_share": sum(b >= 128 for b in raw) / max(len(raw), 1), "digit_share": sum(48 <= b <= 57 for b in raw) / max(len(raw), 1),
    }


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abA1.é \n", max_size=60) | st.just("x" * 400 + " " + "x" * 400), max_size=5))
def test_statistics_match_plain_ones(texts):
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    got = quality.statistics(raw, np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64))
    for row, text in zip(got, texts, strict=True):
        for name, value in plain_statistics(text).items():
            assert row[quality.STATS.index(name)] == pytest.approx(value), (name, text)


def test_null_and_repeated_ids_are_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 2000)
    p = "y".join(map(str, range(60)))
    data = [(None, f"{p} tail {i}") for i in range(30)] + [(4, f"{p} end {i}") for i in range(30)] + [(2, p)]
    got = rows(suffix_dedup.cut_repeats(table(spark, data)).select("doc_id", "n_removed"))
    assert got[0] == (2, 0) and all(n >= len(p) for _, n in got[1:])
