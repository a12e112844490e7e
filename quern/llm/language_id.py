"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword; a binary classifier of hashed n-grams predicts each bit. The decoder sums, over bits, the
loss of a classifier's margin against the codeword's bit, weighted by how well that classifier knows the language, and
takes the language of least loss. A runner-up that comes close makes the answer ambiguous.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import bound_arrow, spans_by_bytes, text_bytes
from quern.llm.fitting import sigmoid

#: Hash buckets of n-grams of 2 and of 3 bytes, each.
BUCKETS = 1 << 12
#: Documents of a language that fit the classifiers, at most about so many, and of all languages together.
PER_LANGUAGE, SAMPLE_ROWS = 600, 6000
#: Languages that are learnt, those of most distinct texts.
MOST_LANGUAGES = 1000
#: Codewords of up to so many languages use every split of the languages.
EXHAUSTIVE = 6
#: A gap between the two best scores under this is ambiguous.
GAP = 0.2
UNKNOWN = "und"
CALL_BYTES = 1 << 19

# letters are lower-cased; other ASCII becomes a space, so that numbers, marks and lines tell nothing
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of hashed n-gram counts of each row, as unit vectors; rows without grams are zero."""
    n, wide = len(offsets) - 1, 2 * BUCKETS
    text = _FOLD[raw].astype(np.uint32)
    row = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.zeros(n * wide, np.float32)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    for k, size in enumerate((2, 3)):
        m = len(text) - size + 1
        if m <= 0:
            continue
        gram = np.zeros(m, np.uint32)
        blank = np.ones(m, bool)
        for j in range(size):
            gram = gram * np.uint32(0x01000193) + text[j : j + m] + np.uint32(1)
            blank &= text[j : j + m] == 32
        gram ^= gram >> np.uint32(15)
        gram *= np.uint32(0x85EBCA6B)
        at = row[:m] * wide + k * BUCKETS + (gram >> np.uint32(20)).astype(np.int64)
        use = ~blank & (np.arange(m) + size <= ends[:m])
        counts += np.bincount(at[use], minlength=n * wide).astype(np.float32)
    out = np.sqrt(counts).reshape(n, wide)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1, far apart: all splits of a few languages, else the best of seeded random matrices."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= EXHAUSTIVE:
        return np.array([(1, *bits) for bits in itertools.product((1, -1), repeat=k - 1) if -1 in bits], float).T
    bits, best = math.ceil(10 * math.log2(k)), (-1, None)
    random = np.random.default_rng(k)
    for _ in range(300):
        code = random.choice([-1.0, 1.0], (k, bits))
        apart = (bits - code @ code.T) / 2
        np.fill_diagonal(apart, bits)
        split = np.abs(code.sum(0)).max() < k
        if split and apart.min() > best[0]:
            best = (apart.min(), code)
    return best[1]


@dataclass
class Codes:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits, rows sum to 1
    sharpness: float

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted loss of each language: log(1 + exp(-bit * margin))."""
        margin = x @ self.weights + self.bias
        return np.stack([(self.trust[k] * np.logaddexp(0, -self.code[k] * margin)).sum(1) for k in range(len(self.languages))], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = -self.sharpness * self.losses(x)
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], rounds: int = 400, l2: float = 1e-5) -> Codes:
    """Fit all bits' logistic classifiers at once, by accelerated gradient steps; trust and sharpness come from the margins."""
    code = codewords(len(languages))
    share = np.bincount(y, minlength=len(languages)).astype(float)
    weight = (1 / np.maximum(share, 1))[y]
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    target = code[y].astype(np.float32)
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    b, v, c, t, step = np.zeros(code.shape[1], np.float32), w.copy(), np.zeros(code.shape[1], np.float32), 1.0, 4.0
    for _ in range(rounds):
        slope = -target * sigmoid(-target * (x @ v + c)).astype(np.float32) * weight
        w2, b2 = v - step * (x.T @ slope + l2 * v), c - step * slope.sum(0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + np.float32((t - 1) / t2) * (w2 - w), b2 + np.float32((t - 1) / t2) * (b2 - b)
        w, b, t = w2, b2, t2
    right = (np.sign(x @ w + b) == target).astype(float)
    trust = np.stack([right[y == k].mean(0) if (y == k).any() else np.ones(code.shape[1]) for k in range(len(languages))])
    trust = np.maximum(2 * trust - 1, 0.02)
    trust /= trust.sum(1, keepdims=True)
    out = Codes(languages, code, w, b, trust, 1.0)
    loss, best = out.losses(x), (np.inf, 1.0)
    for sharpness in (1, 2, 4, 8, 16, 32):
        z = -sharpness * loss
        fit_loss = (np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(y)), y]).mean()
        if fit_loss < best[0]:
            best = (fit_loss, float(sharpness))
    out.sharpness = best[1]
    return out


def _texts(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes and offsets, and which rows have a letter."""
    lower = pc.utf8_lower(pc.fill_null(column, ""))
    return *text_bytes(lower), pc.match_substring_regex(lower, r"\p{L}").to_numpy(zero_copy_only=False)


def learn(known: DataFrame, per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS) -> Codes | None:
    """Codes from text and lang of rows without nulls; None without languages.

    A sample per language by hashes of texts, bounded in rows and sent to the driver as n-gram vectors, fits the
    classifiers. Its rate follows the number of a language's distinct texts, so copies don't thin it out, and the text of
    least hash is always in it. Languages are the MOST_LANGUAGES of most distinct texts.
    """
    place = F.pmod(F.xxhash64(F.lit(17), "text"), F.lit(1 << 30))
    known = known.withColumn("place", place)
    found = known.groupBy("lang").agg(F.approx_count_distinct("place", 0.02).alias("texts"), F.min("place").alias("least"))
    found = found.orderBy(F.desc("texts"), "lang").limit(MOST_LANGUAGES).collect()
    if not found:
        return None
    each = max(1, min(per_language, sample_rows // len(found)))
    # all texts of a language that has about as many as it may give
    upto = lambda r: int((1 << 30) * min(1.0, 1.1 * each / r["texts"])) if r["texts"] > 0.9 * each else 1 << 30
    limits = F.create_map(*(F.lit(v) for r in found for v in (r["lang"], max(upto(r), r["least"] + 1))))
    sample = known.where(F.col("place") < limits[F.col("lang")]).dropDuplicates(["text", "lang"])

    def run(batches):
        for batch in batches:
            raw, offsets, ok = _texts(batch.column(0))
            for lo, hi in spans_by_bytes(offsets, CALL_BYTES):
                o = offsets[lo : hi + 1]
                x = features(raw[o[0] : o[-1]], o - o[0])
                use = np.flatnonzero(ok[lo:hi])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo).take(pa.array(use)), pa.array([x[i].astype(np.float16).tobytes() for i in use], pa.binary())], names=["lang", "x"])

    got = sample.select("text", "lang").mapInArrow(run, T.StructType([T.StructField("lang", T.StringType()), T.StructField("x", T.BinaryType())])).toArrow()
    rows = sorted(zip(got.column("lang").to_pylist(), got.column("x").to_pylist(), strict=True))
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    place = {lang: k for k, lang in enumerate(languages)}
    x = np.stack([np.frombuffer(b, np.float16) for _, b in rows]).astype(np.float32)
    return fit(x, np.array([place[lang] for lang, _ in rows]), languages)


def identify(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", gap: float = GAP) -> DataFrame:
    """The language of every whole text, learnt from the documents for which the column train is true.

    Result: id_col, lang_pred string, score double (0 to 1), runner_up string, ambiguous boolean (the two best scores
    are closer than gap), a row per input row. Texts that are null, empty or without a letter are UNKNOWN with score
    0, as all are if no language is known. Null languages teach nothing; ids and sources are not read for a
    prediction, so null and repeated ids are rows like others. Other columns are not read. An empty table gives no rows.
    """
    bound_arrow(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"), train.alias("train"))
    model = learn(rows.where("train and lang is not null and text is not null").select("text", "lang"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("runner_up", T.StringType()), T.StructField("ambiguous", T.BooleanType())])

    def run(batches):
        for batch in batches:
            raw, offsets, ok = _texts(batch.column(1))
            for lo, hi in spans_by_bytes(offsets, CALL_BYTES):
                n = hi - lo
                known = ok[lo:hi] & (model is not None)
                lang, score, second, near = np.full(n, UNKNOWN, object), np.zeros(n), np.full(n, None, object), np.zeros(n, bool)
                if known.any():
                    o = offsets[lo : hi + 1]
                    s = model.scores(features(raw[o[0] : o[-1]], o - o[0]))
                    order = np.argsort(-s, axis=1, kind="stable")
                    names = np.array(model.languages, object)
                    lang = np.where(known, names[order[:, 0]], UNKNOWN)
                    score = np.where(known, s[np.arange(n), order[:, 0]], 0.0)
                    if len(names) > 1:
                        second = np.where(known, names[order[:, 1]], None)
                        near = known & (score - s[np.arange(n), order[:, 1]] < gap)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(second.tolist(), pa.string()), pa.array(near)], names=schema.names)

    return rows.select("id", "text").mapInArrow(run, schema)
