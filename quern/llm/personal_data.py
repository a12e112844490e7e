"""Personal data: strict forms by pattern, looser ones by generators whose candidates boosted trees accept.

Strict spans are always kept. Generators propose overlapping spans in looser forms (an e-mail address with a written-out
sign, numbers with other separators or without a prefix). For each kind, trees over a candidate's format and context, fitted
on a bounded sample, say how likely it is; a check that the trees don't see (a check digit, the range of parts) then moves the
odds; and a threshold, calibrated on documents held back, selects. Of candidates that overlap the likeliest stays.

There are no labels of personal data, so trees learn from strict spans: those rewritten in loose forms, where they stand, are
examples, and counterexamples are strict forms that fail their check, candidates that no check supports, and strict spans
replaced by what generators propose wrongly.
"""

from __future__ import annotations

import hashlib

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Stored, bound_arrow
from quern.llm.fitting import Boosted, hashed_sample, newton_logistic, sigmoid

KINDS = ("email", "ip", "card", "phone")
#: Documents whose candidates fit the trees, and candidates, at most about so many.
SAMPLE_DOCS = 40_000
TRAIN_ROWS = 40_000
#: Precision that thresholds are set for, the least threshold, and examples held back that a threshold needs.
PRECISION, LEAST_SCORE, LEAST_HELD = 0.95, 0.5, 10
#: Characters of context before and after.
BEFORE, AFTER = 40, 24
#: Texts handled together.
ROWS = 256

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def strict_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """kind, start, end of strict forms, by start and kind; and of forms that fail their check.

    Patterns find the leftmost matches that don't overlap, each kind by itself. Every place is looked at a bounded number
    of times, however long runs of characters are.
    """
    found, failed = [], []
    end, at = 0, text.find("@")
    while at >= 0:
        # the part before the sign is all that may stand there since the last match; it can't hold another sign
        start = at
        while start > end and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        low = end if m is None else m.end()
        if m:
            found.append(("email", start, m.end()))
        else:
            low = at + 1
        end, at = low, text.find("@", max(low, at + 1))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            (found if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")) else failed).append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            digits = _digits(m[0])
            if 12 <= len(digits) <= 19:
                (found if luhn(digits) else failed).append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            (found if 9 <= len(_digits(m[0])) <= 15 else failed).append(("phone", m.start(), m.end()))
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found, failed


AT = re.compile(r"\s?[@＠]\s?|\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?|\s(?:at|AT)\s")
DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s)"
LOOSE_DOMAIN = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{1,63}}){{1,6}}")
LOOSE_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?[\[(]?\s?[.,·]\s?[\])]?\s?[0-9]{1,3}){3}(?![0-9])")
LONG_IP = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}(?::?[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])")
#: What any written sign holds, to look for first.
SIGNS = ("@", "＠", " at ", " AT ", "at]", "at)", "at}", "at>", "AT]", "AT)", "AT}", "AT>")
NUMBERS = re.compile(r"[0-9](?:[   ().\-–/_]{0,3}[0-9])*+")
WIDE = re.compile(r"[   ().\-–/_]{2,}")


def proposals(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end of candidates, which may overlap."""
    out = []
    for sign in SIGNS:
        at = text.find(sign)
        while at >= 0:
            m = AT.search(text, max(0, at - 2), at + 8)
            after = LOOSE_DOMAIN.match(text, m.end()) if m else None
            before = LOCAL.search(text, max(0, m.start() - 64), m.start()) if after else None
            if before:
                out.append(("email", before.start(), after.end()))
            at = text.find(sign, at + len(sign))
    if not DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in LOOSE_IP.finditer(text)]
    if ":" in text:
        out += [("ip", m.start(), m.end()) for m in LONG_IP.finditer(text)]
    for m in NUMBERS.finditer(text):
        if m.end() - m.start() < 7:
            continue
        low = m.start() - (text[m.start() - 1 : m.start()] in ("+", "("))
        pieces = [(low, m.end())]
        if m.end() - m.start() > 16:  # the whole, and what wide gaps leave
            gaps = list(WIDE.finditer(text, m.start(), m.end()))
            for gap in gaps:
                pieces.append((low, gap.start()))
                low = gap.end()
            if gaps:
                pieces.append((low, m.end()))
        for a, b in pieces:
            if b - a > 64:
                continue
            n = len(_digits(text[a:b]))
            if 12 <= n <= 19:
                out.append(("card", a, b))
            if 7 <= n <= 15:
                out.append(("phone", a, b))
    return out


#: Words near a candidate, a feature for each group.
NEAR = tuple(re.compile(p, re.I) for p in (
    r"\b(?:tel|phone|call|fax|mobile|cell|whatsapp|tél|telefon|teléfono|handy|móvil)", r"\b(?:card|visa|master|credit|debit|carte|karte|tarjeta|pay)",
    r"mail|courriel|correo|contact|kontakt|write", r"\b(?:ip|host|server|addr|ping|gateway|login|dns)\b", r"\b(?:version|v|release|isbn|issn|order|ref|page|section|license|licence|vol|fig|no|doi|cc|by)\b",
    r"token|key|hash|secret|sha|md5|uuid",
))


def features(kind: str, span: str, before: str, after: str) -> list[float]:
    """Format and context of a candidate. Check digits and ranges are left out."""
    digits = _digits(span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)] or [0]
    gaps = re.findall(r"[^0-9A-Za-z]+", span)
    last = re.search(r"[A-Za-z]*\Z", span)[0]
    kinds = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4
    near = before[-BEFORE:] + " " + after[:AFTER]
    return [
        len(span), len(digits), len(groups), min(groups), max(groups), len(gaps), len(set(gaps)), max(map(len, gaps), default=0),
        span.count(" "), span.count("."), span.count("-"), "+" in span, "(" in span, "[" in span, "@" in span, "at" in span.lower(), "dot" in span.lower(),
        sum(c.isalpha() for c in span), len(last), last[:1].isupper(), len(set(digits)), digits[:1] == "0", digits[:1] == "1", span.count(":"),
        kinds(before[-1:]), kinds(after[:1]), sum(c.isdigit() for c in before), sum(c.isdigit() for c in after), "\n" in before[-2:], *(bool(p.search(near)) for p in NEAR),
    ]


#: What a check that holds and one that doesn't does to the odds. Of random digits one number in ten has the right last one.
CHECKED = {"card": (10.0, 0.02), "ip": (2.0, 0.02), "email": (1.0, 0.02), "phone": (1.0, 0.02)}


def plausible(kind: str, span: str) -> bool:
    """A candidate's check: its plain form is a strict one."""
    if kind == "card":
        return luhn(_digits(span))
    if kind == "phone":
        return 7 <= len(_digits(span)) <= 15 and len(set(_digits(span))) > 2
    if kind == "ip":
        return ":" in span or all(len(p) == 1 or p[0] != "0" and int(p) <= 255 for p in re.findall(r"[0-9]+", span))
    plain = re.sub(DOT, ".", AT.sub("@", span, count=1))
    return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", plain))


def loosened(kind: str, span: str, nth: int) -> str:
    """A strict span in one of several loose forms."""
    if kind == "email":
        local, domain = span.split("@", 1)
        at, dot = ((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", "."), ("(at)", "."))[nth % 5]
        return local + at + domain.replace(".", dot)
    digits = _digits(span)
    if kind == "ip":
        return span.replace(".", ("[.]", " . ", "(.)", "·")[nth % 4])
    if kind == "card":
        return ("." if nth % 3 == 0 else " " if nth % 3 == 1 else " - ").join(digits[k : k + 4] for k in range(0, len(digits), 4))
    rest = digits[-10:]
    return (f"({rest[:3]}) {rest[3:6]}-{rest[6:]}", f"{rest[:3]}-{rest[3:6]}-{rest[6:]}", f"{rest[:3]}.{rest[3:6]}.{rest[6:]}", f"00{digits[:2]} {digits[2:]}", f"0{rest[:3]}/{rest[3:]}")[nth % 5]


def broken(kind: str, span: str, nth: int) -> str | None:
    """What a generator would propose where a strict span stands, but isn't one: a time, a price or the end of a sentence after "at", a list of numbers."""
    if kind == "email":
        word = span.split("@", 1)[0].strip("0123456789._%+-")
        return word + (" at ", " @ ", " at ")[nth % 3] + (f"{nth % 24}.{nth % 60}", f"{word[:4]}.{word.title()}", f"{nth % 100}.{nth % 90}.{nth % 7}", f"{word[::-1]}.{word.title()}")[nth // 3 % 4]
    if kind == "ip":
        low = nth % 40
        return (", ", ". ", " . ", ".")[nth % 4].join(str(low + k * (nth // 4 % 3 + 1)) for k in range(4))
    return None


def _examples(text: str) -> list[tuple[str, float, bool, list[float]]]:
    """kind, label, weight, features of what a text teaches."""
    found, failed = strict_spans(text)
    out = []
    for kind, a, b in found:
        nth = int.from_bytes(hashlib.blake2b(text[a:b].encode(), digest_size=4).digest(), "little")
        out.append((kind, 1.0, 1.0, features(kind, loosened(kind, text[a:b], nth), text[max(0, a - BEFORE) : a], text[b : b + AFTER])))
        other = broken(kind, text[a:b], nth)
        if other:
            out.append((kind, 0.0, 0.5, features(kind, other, text[max(0, a - BEFORE) : a], text[b : b + AFTER])))
    for kind, a, b in failed:
        out.append((kind, 0.0, 1.0, features(kind, text[a:b], text[max(0, a - BEFORE) : a], text[b : b + AFTER])))
    for kind, a, b in proposals(text):
        inside = [k for k, s, e in found if a < e and s < b]
        if kind in inside:
            continue
        # what is strictly of another kind isn't of this one; what a check supports is unknown and teaches nothing
        if inside or kind == "phone" or not plausible(kind, text[a:b]):
            out.append((kind, 0.0, 1.0 if inside else 0.5, features(kind, text[a:b], text[max(0, a - BEFORE) : a], text[b : b + AFTER])))
    return out


@dataclass
class Selector:
    """Trees of a kind, the line that turns their scores into odds, and the least probability that is selected."""

    trees: Boosted
    slope: float
    start: float
    threshold: float

    def probability(self, kind: str, spans: list[str], x: np.ndarray) -> np.ndarray:
        moved = np.log(np.array([CHECKED[kind][0 if plausible(kind, s) else 1] for s in spans]))
        return sigmoid(self.slope * self.trees.score(x) + self.start + moved)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, held: np.ndarray) -> Selector | None:
    """Trees on rows that aren't held back; line and threshold on those that are. None where they have too few of a class."""
    if min((y[held] > 0).sum(), (y[held] == 0).sum(), (y[~held] > 0).sum(), (y[~held] == 0).sum()) < LEAST_HELD:
        return None
    trees = Boosted(x[~held], y[~held], weight[~held])
    score = trees.score(x[held])
    slope, start = newton_logistic(score[:, None], y[held], l2=0.1)
    slope = max(float(slope[0]), 1e-3)
    p = sigmoid(slope * score + start)
    order = np.argsort(-p, kind="stable")
    right = np.cumsum((y[held] > 0)[order] * weight[held][order]) / np.cumsum(weight[held][order])
    good = np.flatnonzero(right >= PRECISION)
    if not len(good):
        return None
    return Selector(trees, slope, start, max(LEAST_SCORE, float(p[order[good[-1]]])))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, train_rows: int = TRAIN_ROWS) -> dict[str, Selector]:
    """A selector for each kind, from a hashed sample of docs (text) that is bounded in documents and in candidates."""
    width = len(features("card", "1", "", ""))
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("y", T.DoubleType()), T.StructField("weight", T.DoubleType()), T.StructField("part", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                # equal texts fall on one side
                part = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=4).digest(), "little")
                rows += [(k, y, w, part, [float(v) for v in x]) for k, y, w, x in _examples(text)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.float64())), strict=True)], names=schema.names)

    store = Stored(docs.sparkSession, "personal-data")
    texts = hashed_sample(docs.where("text is not null").select("text"), F.col("text"), sample_docs, 11)
    rows = store.keep(texts.mapInArrow(run, schema), "examples")
    got = hashed_sample(rows, F.struct("part", "x", "kind"), train_rows, 12).toArrow()
    kinds, y, weight, part = (np.array(got.column(c).to_pylist()) for c in ("kind", "y", "weight", "part"))
    x = np.array(got.column("x").combine_chunks().flatten()).reshape(-1, width) if len(kinds) else np.zeros((0, width))
    out = {}
    for kind in KINDS:
        own = np.flatnonzero(kinds == kind)
        own = own[np.lexsort((*x[own].T, part[own], y[own]))]  # one order, whatever the order rows came in
        model = fit(x[own], y[own], weight[own], part[own] % 3 == 0) if len(own) else None
        if model:
            out[kind] = model
    return out


def _select(texts: list[str], models: dict[str, Selector]) -> list[list[tuple[str, int, int, float, bool]]]:
    """kind, start, end, probability, strict of each text's spans, by start and kind."""
    out, asked = [], {k: [] for k in models}
    for row, text in enumerate(texts):
        found, _ = strict_spans(text)
        out.append([(k, a, b, 1.0, True) for k, a, b in found])
        if models:
            for kind, a, b in dict.fromkeys(proposals(text)):
                if kind in models and not any(a < e and s < b for _, s, e in found):
                    asked[kind].append((row, a, b))
    picked: dict[int, list] = {}
    for kind, rows in asked.items():
        if rows:
            x = np.array([features(kind, texts[r][a:b], texts[r][max(0, a - BEFORE) : a], texts[r][b : b + AFTER]) for r, a, b in rows], float)
            p = models[kind].probability(kind, [texts[r][a:b] for r, a, b in rows], x)
            for (row, a, b), q in zip(rows, p.tolist(), strict=True):
                if q >= models[kind].threshold:
                    picked.setdefault(row, []).append((q, b - a, kind, a, b))
    for row, spans in picked.items():
        # the likeliest of those that overlap, then the longest; they stand apart once chosen, so neighbours tell
        chosen: list[tuple[int, int]] = []
        for q, _, kind, a, b in sorted(spans, key=lambda s: (-s[0], -s[1], KINDS.index(s[2]), s[3])):
            if all(b <= s or e <= a for s, e in chosen):
                chosen.append((a, b))
                out[row].append((kind, a, b, q, False))
        out[row].sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return out


def _found(rows: DataFrame, models: dict[str, Selector], spans) -> DataFrame:
    """rows (any columns, then text) with spans(text, found) of each text in place of it; schema: name and type of that column."""
    make, name, kind, arrow = spans
    kept = rows.columns[:-1]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField(name, kind)])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                texts = part.column(len(kept)).to_pylist()
                found = _select([t or "" for t in texts], models)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(kept))), pa.array([make(t, f) for t, f in zip(texts, found, strict=True)], arrow)], names=schema.names)

    return rows.mapInArrow(run, schema)


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("strict", T.BooleanType())])
_SPANS = (lambda text, found: [dict(zip(SPAN.names, f, strict=True)) for f in found], "spans", T.ArrayType(SPAN), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("strict", pa.bool_())])))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """id_col, spans of every whole text: kind, start, end (in code points, end exclusive), score, strict, by start and kind.

    A row per input row. Strict spans have score 1; of one kind they don't overlap, of two kinds they may. Others overlap no
    span. A null or empty text has none. Null and repeated ids are rows like others; equal texts have equal spans. A very
    long text is read whole, each place a bounded number of times. Of candidates of one score the longer, then the kind listed
    first, then the earlier stays. Where the sample has too few examples of a kind to calibrate it, that kind has its
    strict spans only. Other columns are not read. An empty table gives no rows.
    """
    bound_arrow(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    found = _found(rows, learn(rows.select("text"), sample_docs, train_rows), _SPANS)
    return found.select(F.col("id").alias(id_col), "spans")


def redacted(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs, all columns, with each span of personal_data replaced by its kind in brackets; spans that overlap become one, named by the first.

    A null text stays null. Rows are as those of personal_data otherwise.
    """
    bound_arrow(docs.sparkSession)
    text = docs[text_col].cast("string")

    def mask(text, found):
        if text is None or not found:
            return text
        out, end = [], 0
        for kind, a, b, _, _ in found:
            if a >= end:
                out += [text[end:a], f"[{kind.upper()}]"]
            end = max(end, b)
        return "".join([*out, text[end:]])

    models = learn(docs.select(text.alias("text")), sample_docs, train_rows)
    done = _found(docs.select(F.struct(*docs.columns).alias("row"), text.alias("text")), models, (mask, "masked", T.StringType(), pa.string()))
    return done.select(*(F.col("masked").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """personal_data as id_col, n_email, n_ip, n_card, n_phone (strict spans), base_sha256 (of those, listed), spans (all, listed), n_added."""
    strict = F.filter("spans", lambda s: s["strict"])
    count = lambda kind: F.size(F.filter(strict, lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    found = personal_data(docs, id_col, text_col, **options)
    return found.select(id_col, *counts, F.sha2(listed(strict).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), (F.size("spans") - F.size(strict)).cast("long").alias("n_added"))
