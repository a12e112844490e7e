"""Importance resampling and the trie of conversations, held against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import importance as I
from quern.llm import prefix_trie as P

DOCS = "doc_id long, text string, score long, rank string, row string"


def plain_features(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [" ".join(words[i : i + n]) for n in range(1, width + 1) for i in range(len(words) - n + 1)]


def plain_importance(docs, target, width=1, buckets=I.BUCKETS, least=20, percent=10):
    count = lambda texts: np.bincount([zlib.crc32(f.encode()) % buckets for t in texts for f in plain_features(t, width)[1]] or [0], minlength=buckets) * bool(texts)
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in plain_features(x, width)[1]), Counter(bucket(f) for x in target for f in plain_features(x, width)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, x in docs:
        words, f = plain_features(x, width)
        weight = sum(gain(bucket(y)) for y in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((k for k, r in enumerate(rows) if r[1] >= least), key=lambda k: (-rows[k][4], rows[k][0] is None, rows[k][0] or 0, rows[k][2], rows[k][3]))
    rank = {k: n for n, k in enumerate(fit[: len(fit) * percent // 100], 1)}
    return sorted(((r[0], r[2], r[3], r[4], rank.get(k)) for k, r in enumerate(rows)), key=repr)


def some_docs(n, seed=3):
    pick = random.Random(seed)
    words = ["Alpha", "beta", "Γάμμα", "x9", "l'été", "a_b", "0", "z" * 200, "中文"]
    return [(i if i % 17 else None, " ".join(pick.choice(words) for _ in range(pick.choice([0, 1, 3, 12, 40])))) for i in range(n)] + [(5, None), (6, ""), (7, " ,;\x00 ")]


@pytest.mark.parametrize("width", [1, 2, 3])
def test_importance_is_as_written(spark, width):
    docs, target = some_docs(150), ["beta x9 beta", None, "", "中文 Alpha  x9"]
    frame = spark.createDataFrame([(i, t, 1, "r", "w") for i, t in docs], DOCS)
    wanted = spark.createDataFrame([(t, 2) for t in target], "text string, doc_id int")
    got = sorted((tuple(r) for r in I.importance(frame, wanted, width=width, least_words=3, percent=30, buckets=97).collect()), key=repr)
    assert got == plain_importance(docs, target, width, 97, 3, 30)


def test_rows_that_repeat_get_ranks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(I, "COPIES", 3)
    docs = [(None, "beta " * 30)] * 40 + [(1, "beta " * 30)] * 7 + [(2, "alpha " * 25)] * 3
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = I.importance(frame, spark.createDataFrame([("beta",)], "text string"), percent=90).collect()
    assert sorted((tuple(r) for r in got if r["rank"]), key=repr) == [r for r in plain_importance(docs, ["beta"], percent=90) if r[4]]
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 46)) and len(got) == 50


def test_drawn_rows_are_those_with_a_rank(spark):
    docs = some_docs(200)
    frame = spark.createDataFrame([(i, t, 1, "r", "w") for i, t in docs], DOCS)
    target = spark.createDataFrame([("beta x9",)], "text string")
    ids = sorted((r["doc_id"] for r in I.importance(frame, target, least_words=3, percent=25).where("rank is not null").collect()), key=repr)
    found = I.drawn(frame, target, least_words=3, percent=25)
    assert sorted((r["doc_id"] for r in found.collect()), key=repr) == ids and found.columns == frame.columns
    assert I.drawn(frame, target, percent=0).count() == 0


def test_nothing_to_draw(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert I.importance(none, one).collect() == [] and I.drawn(none, one).collect() == []
    assert sorted(tuple(r) for r in I.importance(one, none.select("text")).collect()) == plain_importance([(1, "a b"), (2, None)], [])


def test_checksums_of_runs():
    raw = np.frombuffer(b"a" * 300 + bytes(range(256)) * 2, np.uint8)
    first, last = np.array([0, 3, 0, 7, 300, 500]), np.array([1, 3, 300, 103, 812, 596])
    assert I.crc32_of(raw, first, last).tolist() == [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(first, last)]


def plain_trie(rows, group=5, shared=9):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % shared
        built[c] = tuple(own.get(c - int(math.fmod(c, group)), [])[:h] + x[h:])
    nodes = {}
    for c, x in built.items():
        for d in range(len(x) + 1):
            nodes.setdefault(x[:d], set()).add(c)
    out = []
    for x, members in nodes.items():
        below = [y for y in nodes if y[: len(x)] == x]
        leaf = lambda y: not any(len(z) == len(y) + 1 and z[: len(y)] == y for z in nodes)
        saved = sum((len(nodes[y]) - 1) * len(y[-1][1].encode()) for y in below if y)
        mine = ",".join(str(c) for c in sorted(c for c in members if built[c] == x))
        out.append((min(members), len(x), min(nodes[x[:-1]]) if x else None, len(members), sum(len(y) == len(x) + 1 for y in below), sum(map(leaf, below)), saved, hashlib.sha256(mine.encode()).hexdigest()))
    return sorted(out, key=repr)


def some_turns(n, seed=1):
    pick, rows = random.Random(seed), []
    for c in range(-6, n):
        for t in range(pick.choice([0, 1, 2, 3, 3, 4, 12])):
            rows.append((c, t if pick.random() < 0.9 else None, pick.choice(["user", None, "", "système"]) if t else "user", pick.choice(["yes", "no", None, "ça"]) if t else pick.choice(["hi"] * 8 + ["hello"])))
    return rows + rows[:9] + [(None, 1, "user", "lost"), (4000, 0, "user", "x" * 100_000)]


@pytest.mark.parametrize("most", [12, 100_000])
def test_trie_is_as_written(spark, most):
    rows = some_turns(120)
    frame = spark.createDataFrame([(*r, "top", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, n int").repartition(5)
    got = sorted((tuple(r) for r in P.prefix_trie(frame, subtrie_turns=most).collect()), key=repr)
    assert got == plain_trie(rows)


def test_trie_joins_what_it_does_not_send(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_SENT", 0)
    monkeypatch.setattr(P, "BLOCK_IDS", 2)
    rows = some_turns(60, 4)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((tuple(r) for r in P.prefix_trie(frame, subtrie_turns=5).collect()), key=repr) == plain_trie(rows)


def test_trie_of_equal_and_of_no_turns(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert P.prefix_trie(spark.createDataFrame([], kind)).collect() == []
    assert P.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], kind)).collect() == []
    alone = [(c, 0, "user", "x") for c in range(1, 400) if c % 5]  # most lose their only turn, and the first of their group isn't there
    frame = spark.createDataFrame(alone, kind)
    assert sorted((tuple(r) for r in P.prefix_trie(frame).collect()), key=repr) == plain_trie(alone)
    turnless = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9]
    only = spark.createDataFrame([(c, 0, "user", "x") for c in turnless], kind)
    assert [r["depth"] for r in P.prefix_trie(only).collect()] == [0]
    members = spark.createDataFrame([(b"k", c) for c in range(1000)], "key binary, conv long")
    assert P.ends(members.orderBy(F.desc("conv"))).first()["ends_sha256"] == hashlib.sha256(",".join(map(str, range(1000))).encode()).hexdigest()
