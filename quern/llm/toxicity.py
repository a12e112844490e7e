"""Toxicity by two class-conditional Kneser-Ney models of words' byte grams, with shared backoff counts.

The models give a byte of a word its probability after the bytes before it. The highest order has counts of its own
class; it backs off to lower orders whose continuation counts both classes share, so an expression that neither class
has seen often is judged alike by both. What is compared is the difference of the two log-likelihoods per byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import words as W
from quern.llm.common import Stored, bound_arrow, spans_by_bytes, text_bytes
from quern.llm.fitting import hashed_sample, newton_logistic

#: Bytes of a gram of the highest order; they fit a 64-bit number exactly.
ORDER = 6
#: Absolute discount of continuation counts.
DISCOUNT = 0.75
#: Absolute discounts of the highest order for counts of 1, 2 and more, as a class seldom vouches for what it has once or twice.
DISCOUNTS = (0.9, 1.3, 1.5)
#: Marks before a word and after it.
BEGIN, END = 1, 2
CALL_BYTES = 4 << 20
#: A word counts as an expression from this difference of log-likelihoods on, and no word counts more than MOST above it.
STANDS_OUT, MOST = 3.0, 6.0
#: Excess enters the result by its logarithm, above this floor, as one expression in a long text should tell.
FLOOR = 0.005
#: Labelled documents whose scores fit the two weights and the intercept of the result, at most about so many.
CALIBRATION_ROWS = 20_000
#: Grams of a model that is sent to all workers, at most (24 bytes each); a larger one is joined.
MODEL_ROWS = 4_000_000
#: Labels that are sent to all executors, at most (9 bytes each); more are joined.
LABEL_ROWS = 2_000_000
CLASSES = ("t0", "t1", "o0", "o1")
MODELS = ("both", "fold0", "fold1")

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(raw: np.ndarray, offsets: np.ndarray):
    """Words (runs of ASCII letters, lower-cased, and bytes from 128 on) of rows.

    Returns (bytes, first, length, place of each word in the distinct ones, row of each word): the first three
    describe the distinct words of all rows.
    """
    low = _LOWER[raw]
    first, last = W.runs(_LETTER[raw], offsets)
    pick, which = W.names(low, first, last)
    return low, first[pick], (last - first)[pick], which, np.searchsorted(offsets, first, side="right") - 1


def grams_of(low: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams of words, one for each byte and one for the end, and which word each belongs to."""
    size = length + ORDER  # ORDER - 1 marks before and one after
    stop = np.cumsum(size)
    n = int(stop[-1]) if len(stop) else 0
    word = np.repeat(np.arange(len(first)), size)
    place = np.arange(n) - np.repeat(stop - size, size) - (ORDER - 1)
    inner = (place >= 0) & (place < length[word]) if n else np.zeros(0, bool)
    at = np.where(inner, first[word] + place, 0) if n else np.zeros(0, np.int64)
    text = np.where(inner, low[at], np.where(place < 0, BEGIN, END)).astype(np.uint64) if n else np.zeros(0, np.uint64)
    gram = np.zeros(max(0, n - ORDER + 1), np.uint64)
    for k in range(ORDER):
        gram = (gram << np.uint64(8)) | text[k : k + len(gram)]
    whole = place[: len(gram)] <= length[word[: len(gram)]] - (ORDER - 1)
    return gram[whole].view(np.int64), word[: len(gram)][whole]


def _count(batches):
    """Grams of labelled documents with counts by class and fold."""
    for batch in batches:
        raw, offsets = text_bytes(pc.utf8_lower(batch.column(0)))
        kind = batch.column(1).to_numpy(zero_copy_only=False)
        for lo, hi in spans_by_bytes(offsets, CALL_BYTES):
            o = offsets[lo : hi + 1]
            low, first, length, which, row = words_of(raw[o[0] : o[-1]], o - o[0])
            gram, word = grams_of(low, first, length)
            if not len(gram):
                continue
            distinct, name = np.unique(gram, return_inverse=True)
            # a document counts a word once, however often it repeats it
            once = np.unique(row * len(first) + which)
            own, which = kind[lo + once // len(first)], once % len(first)
            counts = []
            for k in range(len(CLASSES)):
                n = np.bincount(which[own == k], minlength=len(first))
                counts.append(np.bincount(name, weights=n[word]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(distinct), *map(pa.array, counts)], names=["g", *CLASSES])


def _shared(grams: DataFrame, store: Stored) -> DataFrame:
    """s, p: the probability of the last byte of each gram of the order below the highest, from continuation counts of both classes.

    A context is followed by 256 bytes at most, which bounds the windows.
    """
    levels, now = [], grams.select("g")
    for k in range(ORDER - 1, 0, -1):
        counted = now.groupBy(F.col("g").bitwiseAND((1 << 8 * k) - 1).alias("g")).agg(F.count(F.lit(1)).alias("c"))
        levels.append((k, counted))
        now = counted.select("g")
    p = None
    for k, counted in reversed(levels):
        context = Window.partitionBy(F.shiftright("g", 8))
        rows = counted.withColumn("all", F.sum("c").over(context)).withColumn("types", F.count(F.lit(1)).over(context))
        below = F.lit(1 / 256)
        if p is not None:
            rows = rows.withColumn("suffix", F.col("g").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(p.select(F.col("g").alias("suffix"), F.col("p").alias("below")), "suffix")
            below = F.col("below")
        p = rows.select("g", ((F.greatest(F.col("c") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("types") * below) / F.col("all")).alias("p"))
    return store.keep(p, "shared")


def fit_models(documents: DataFrame, store: Stored) -> tuple[DataFrame, DataFrame]:
    """Differences of log-probabilities of grams (g, and a column per model) and of backoff weights of contexts (c, likewise).

    documents: text, kind (0 to 3: toxic or ordinary, each in two folds). Counts are taken over all of them. fold0
    and fold1 are models without the documents of that fold.
    """
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("g", *CLASSES)])
    grams = documents.mapInArrow(_count, schema).groupBy("g").agg(*(F.sum(c).alias(c) for c in CLASSES))
    grams = store.keep(grams, "grams")
    shared = _shared(grams, store)
    rows = grams.withColumn("c", F.shiftright("g", 8)).withColumn("s", F.col("g").bitwiseAND((1 << 8 * (ORDER - 1)) - 1))
    rows = rows.join(shared.select(F.col("g").alias("s"), "p"), "s")
    context, columns, weights = Window.partitionBy("c"), [], []
    for model, (toxic, ordinary) in zip(MODELS, ((("t0", "t1"), ("o0", "o1")), (("t1",), ("o1",)), (("t0",), ("o0",))), strict=True):
        logs, backs = [], []
        for parts in (toxic, ordinary):
            n = sum(F.col(c) for c in parts)
            taken = F.when(n == 0, 0.0).when(n == 1, DISCOUNTS[0]).when(n == 2, DISCOUNTS[1]).otherwise(DISCOUNTS[2])
            every = F.sum(n).over(context)
            back = F.when(every > 0, F.sum(taken).over(context) / F.greatest(every, F.lit(1))).otherwise(1.0)
            logs.append(F.log((n - taken) / F.greatest(every, F.lit(1)) + back * F.col("p")))
            backs.append(F.log(back))
        columns.append((logs[0] - logs[1]).cast("float").alias(model))
        weights.append((backs[0] - backs[1]).cast("float").alias(f"b_{model}"))
    table = store.keep(rows.select("g", "c", *columns, *weights), "model")
    back = table.groupBy("c").agg(*(F.first(f"b_{m}").alias(m) for m in MODELS))
    return table.select("g", *MODELS), back


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros((len(wanted), values.shape[1])), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return np.where(hit[:, None], values[at], 0.0), hit


def word_scores(low, first, length, grams, backs) -> np.ndarray:
    """Differences of log-likelihoods of words, a column per model. grams and backs: sorted keys and values."""
    gram, word = grams_of(low, first, length)
    value, hit = _lookup(*grams, gram)
    below, _ = _lookup(*backs, gram >> 8)
    value = np.where(hit[:, None], value, below)
    return np.stack([np.bincount(word, weights=value[:, m], minlength=len(first)) for m in range(value.shape[1])], axis=1)


def _document_features(low_scores: np.ndarray, sizes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Per row, over its words: the difference per byte, and the mean excess of words that stand out."""
    add = lambda v: np.bincount(row, weights=v, minlength=n)
    return np.stack([add(low_scores) / np.maximum(1, add(sizes)), add(np.clip(low_scores - STANDS_OUT, 0, MOST)) / np.maximum(1, np.bincount(row, minlength=n))], axis=1)


def _score_here(rows: DataFrame, grams: DataFrame, backs: DataFrame, models: list[str]) -> DataFrame:
    """Features by models that every worker holds."""
    held = []
    for table, key in ((grams, "g"), (backs, "c")):
        got = table.select(key, *models).toArrow()
        keys = got.column(0).to_numpy()
        order = np.argsort(keys)
        values = np.stack([got.column(m).to_numpy() for m in models], axis=1)[order] if len(keys) else np.zeros((0, len(models)), np.float32)
        held.append((keys[order], values.astype(np.float32)))
    place = rows.columns.index("text")
    names = [c for c in rows.columns if c != "text"]
    schema = T.StructType([*(rows.schema[c] for c in names), *(T.StructField(f"{f}_{m}", T.DoubleType()) for m in models for f in ("mean", "excess"))])

    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(pc.utf8_lower(batch.column(place)))
            for lo, hi in spans_by_bytes(offsets, CALL_BYTES):
                o = offsets[lo : hi + 1]
                low, first, length, which, row = words_of(raw[o[0] : o[-1]], o - o[0])
                scores = word_scores(low, first, length, *held)
                found = [_document_features(scores[which, m], (length + 1)[which], row, hi - lo) for m in range(len(models))]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(f[:, k]) for f in found for k in (0, 1))], names=schema.names)

    return rows.mapInArrow(run, schema)


def _score_joined(rows: DataFrame, grams: DataFrame, backs: DataFrame, models: list[str]) -> DataFrame:
    """The same features where a model is too large to send: distinct words are joined to it, and documents to them."""
    names = [c for c in rows.columns if c != "text"]
    # stored, so that numbers stay with their rows whatever is computed again
    rows = Stored(rows.sparkSession, "toxicity-rows").keep(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    place, at = rows.columns.index("text"), rows.columns.index("_row")
    spelled = T.StructType([T.StructField("_row", T.LongType()), T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])

    def spell(batches):
        for batch in batches:
            raw, offsets = text_bytes(pc.utf8_lower(batch.column(place)))
            low, first, length, which, row = words_of(raw, offsets)
            keys, n = np.unique(row.astype(np.int64) * max(1, len(first)) + which, return_counts=True)
            words = [low[a : a + k].tobytes() for a, k in zip(first.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(at).take(pa.array(keys // max(1, len(first)))), pa.array([words[k] for k in (keys % max(1, len(first))).tolist()], pa.binary()), pa.array(n)], names=spelled.names)

    def cut(batches):
        for batch in batches:
            words = [x.as_py() for x in batch.column(0)]
            length = np.array([len(w) for w in words], np.int64)
            gram, word = grams_of(np.frombuffer(b"".join(words), np.uint8), np.cumsum(length) - length, length)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(word)), pa.array(gram)], names=["word", "g"])

    words = rows.mapInArrow(spell, spelled)
    value = words.select("word").distinct().mapInArrow(cut, T.StructType([T.StructField("word", T.BinaryType()), T.StructField("g", T.LongType())]))
    value = value.withColumn("c", F.shiftright("g", 8)).join(grams, "g", "left").join(backs.select("c", *(F.col(m).alias(f"b_{m}") for m in models)), "c", "left")
    value = value.groupBy("word").agg(*(F.sum(F.coalesce(m, f"b_{m}", F.lit(0.0)).cast("double")).alias(m) for m in models))
    words = words.join(value, "word")
    total = lambda x: F.sum(F.col("n") * x)
    found = words.groupBy("_row").agg(*(x for m in models for x in ((total(F.col(m)) / total(F.length("word") + 1)).alias(f"mean_{m}"), (total(F.least(F.greatest(F.col(m) - STANDS_OUT, F.lit(0.0)), F.lit(MOST))) / F.sum("n")).alias(f"excess_{m}"))))
    out = rows.drop("text").join(found, "_row", "left")
    return out.select(*names, *(F.coalesce(f"{f}_{m}", F.lit(0.0)).alias(f"{f}_{m}") for m in models for f in ("mean", "excess")))


def toxicity(docs: DataFrame, labels: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7, model_rows: int = MODEL_ROWS) -> DataFrame:
    """Toxicity of every whole text, learnt from labels of the documents for which the column train is true.

    Result: id_col, score double (0 to 1), predicted int (1 from threshold on), llr double (difference of the
    log-likelihoods per byte), excess double (mean excess of words that stand out), a row per input row of docs.
    Counts cover all labelled training documents. The weights of llr and excess come from a bounded sample of them
    (CALIBRATION_ROWS), each scored by a model that hasn't seen its fold.

    Null and empty texts have no words: both differences are 0 and the score is what the intercept gives. Null
    labels and ids train nothing; of repeated labels of an id the largest counts. Without labels of both classes
    the score is the smoothed rate of label 1. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_arrow(spark)
    store = Stored(spark, "toxicity")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), train.alias("train"))
    marked = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    marked = store.keep(marked, "labels")
    marked = F.broadcast(marked) if marked.count() <= LABEL_ROWS else marked
    known = rows.where("train").join(marked, "id").withColumn("fold", F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(2)).cast("int"))
    known = known.withColumn("kind", F.when(F.col("y") > 0, F.col("fold")).otherwise(F.col("fold") + 2))
    grams, backs = fit_models(known.select("text", "kind"), store)
    seen = known.groupBy("y").count().collect()
    n1, n0 = (sum(r["count"] for r in seen if (r["y"] > 0) == one) for one in (True, False))
    score = _score_here if grams.count() <= model_rows else _score_joined
    keep = rows.select("id", "text")
    if not n0 or not n1:
        out = score(keep, grams, backs, ["both"]).withColumn("score", F.lit((n1 + 1) / (n0 + n1 + 2) if n0 + n1 else 0.5))
    else:
        fit = score(hashed_sample(known, F.col("id"), CALIBRATION_ROWS, 11).select("y", "fold", "text"), grams, backs, list(MODELS[1:])).toPandas()
        own = np.stack([np.where(fit.fold == 0, fit[f"{f}_fold0"], fit[f"{f}_fold1"]) for f in ("mean", "excess")], axis=1)
        own[:, 1] = np.log(FLOOR + own[:, 1])
        weights, intercept = newton_logistic(own, (fit.y > 0).to_numpy(float), l2=1.0)
        out = score(keep, grams, backs, ["both"])
        out = out.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.lit(float(weights[0])) * F.col("mean_both") + F.lit(float(weights[1])) * F.log(FLOOR + F.col("excess_both")) + F.lit(intercept))))))
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.col("mean_both").alias("llr"), F.col("excess_both").alias("excess"))
