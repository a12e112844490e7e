"""Personal data: strict spans against plain regular expressions; what the trees add on texts with planted loose forms."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quern.llm import personal_data as P

KIND = "doc_id long, text string, kind string, spans int"


def plain(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(map(int, str(2 * d))) for k, d in enumerate(digits)) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_strict_spans_are_as_written():
    pick = random.Random(5)
    parts = ["@", "@", ".", "a", "B9", "-", "+", "1", "25", "300", "00255", " ", "(", ")", "\n", "é", "٣", "Ａ", "4111 1111 1111 1111", "1.2.3.4", "x@y.z", "..", "+1 (407) 555-7710"]
    for _ in range(20_000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 25)))
        assert P.strict_spans(text)[0] == plain(text), text


@pytest.mark.parametrize("text", ["1" * 300_000, "a" * 300_000 + "@", "a@" * 100_000, "1." * 100_000, "+1 " * 100_000, "1 at 2 dot " * 20_000, "1:" * 100_000])
def test_long_runs_take_linear_time(text):
    import time

    began = time.time()
    P.strict_spans(text)
    P.proposals(text)
    assert time.time() - began < 10


def sample(n=900, seed=2):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("etaoinshr") for _ in range(pick.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    digits = lambda n: "".join(pick.choice("0123456789") for _ in range(n))

    def card():
        body = digits(15)
        return next(body + str(k) for k in range(10) if P.luhn(body + str(k)))

    forms = (
        lambda: f"{word()}.{digits(2)}@mail.example.com", lambda: ".".join(str(pick.randint(1, 255)) for _ in range(4)), card, lambda: f"+1 ({digits(3)}) 555-{digits(4)}",
        lambda: digits(15) + "x", lambda: f"version {digits(1)}.{digits(1)}", lambda: digits(16), lambda: f"{digits(3)} {digits(7)}", lambda: f"token={digits(8)}a{digits(9)}f",
    )
    return [(i, f"{prose(12)} {pick.choice(forms)()} {prose(8)}") for i in range(n)]


def test_loose_forms_are_found_and_prose_is_left(spark):
    rows = sample()
    loose = ["write to anna.berg (at) mail3 (dot) example (dot) com soon", "please call (017) 555-7713 soon", "with 4111.1111.1111.1111 on it", "from 10[.]20[.]30[.]40 again"]
    clean = ["Licensed under CC BY-NC 4.0. See version 3.", "they met at noon. Then at ten, 1, 2, 3, 4 of them", "we look at this.That", "", " "]
    more = [(1000 + k, t) for k, t in enumerate(loose + clean)] + [(None, None), (7, rows[7][1]), (1003, "x" * 50_000 + " a@b.cd")]
    frame = spark.createDataFrame([(i, t, "k", 1) for i, t in rows + more], KIND).repartition(3)
    got = P.span_digests(frame).collect()
    again = {(r["doc_id"], r["base_sha256"], r["spans"]) for r in P.span_digests(frame.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["base_sha256"], r["spans"]) for r in got} and len(got) == len(rows) + len(more)
    text = {}
    for i, t in rows + more:
        text.setdefault(i, []).append(t or "")
    for r in got:
        whole = [t for t in text[r["doc_id"]] if hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain(t)).encode()).hexdigest() == r["base_sha256"]]
        assert whole
        strict = plain(whole[0])
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(s[0] == k for s in strict) for k in P.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in strict} <= set(r["spans"].split(",")) and r["n_added"] + len(strict) == len([x for x in r["spans"].split(",") if x])
    added = {r["doc_id"]: r["spans"] for r in got if r["n_added"]}
    assert {1000, 1001, 1002, 1003} <= set(added)
    for k, span in enumerate(("anna.berg (at) mail3 (dot) example (dot) com", "(017) 555-7713", "4111.1111.1111.1111", "10[.]20[.]30[.]40")):
        at = loose[k].index(span)
        assert any(s.endswith(f":{at}:{at + len(span)}") for s in added[1000 + k].split(","))
    assert not {i for i in added if i is not None and i >= 1000 + len(loose)}


def test_redacted_texts_keep_their_rows(spark):
    frame = spark.createDataFrame([(1, "é a@b.cd, 1.2.3.4", "x", 3), (None, None, "y", 4), (2, "none", "z", 5)], KIND)
    found = P.redacted(frame)
    assert found.columns == frame.columns
    assert sorted((r["text"] or "", r["kind"], r["spans"]) for r in found.collect()) == [("", "y", 4), ("none", "z", 5), ("é [EMAIL], [IP]", "x", 3)]
    assert P.personal_data(frame.limit(0)).collect() == [] and P.redacted(frame.limit(0)).collect() == []


def test_spans_hold_code_points(spark):
    frame = spark.createDataFrame([(1, "日本😀 a@b.cd +1 (407) 555-7710")], "doc_id long, text string")
    spans = P.personal_data(frame).select(F.explode("spans").alias("s")).select("s.*").collect()
    assert [(r["kind"], r["start"], r["end"], r["strict"]) for r in spans] == [("email", 4, 10, True), ("phone", 11, 28, True)]
