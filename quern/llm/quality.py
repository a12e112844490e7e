"""Quality by a sparse rule ensemble: tree paths as conjunctive rules over text statistics, lasso weights, Spark columns.

Statistics of whole texts are computed once, in Arrow batches over bytes. Small boosted trees on a bounded labelled
sample give candidate rules, a lasso logistic fit keeps few of them, and those become one Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import words as W
from quern.llm.common import Stored, bound_arrow, spans_by_bytes, text_bytes
from quern.llm.fitting import hashed_sample, sigmoid

CALL_BYTES = 1 << 19
#: Labelled documents whose statistics fit the rules, at most about so many.
TRAIN_ROWS = 20_000
#: Trees, their depth, their share of rows, and the shrinkage of each.
TREES, DEPTH, SHARE, RATE = 60, 3, 0.5, 0.15
#: Cuts per statistic that trees may use.
CUTS = 32
#: Rules that the lasso is given, and rules that it may keep.
SCREENED = 250
MOST_RULES = 60

_CLASS = np.full(256, 8, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\v\f\r", b".,;:", b"!?", b"#$%&*@~^|<>=+_\\/{}[]-()\"'`")):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 7
CLASSES = ("lower", "upper", "digit", "white", "stop", "exclaim", "symbol", "high", "control")
STATS = (
    "bytes", "words", *(f"{c}_share" for c in CLASSES), "upper_of_letters", "word_length", "longest_word", "short_words", "capital_words", "odd_words",
    "repeat_words", "distinct_words", "distinct_by_root", "top_word", "lines", "line_words", "repeat_lines", "stops_per_word", "repeat_bytes",
)


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATS for each text; those of an empty text are 0."""
    n = len(offsets) - 1
    out = {s: np.zeros(n) for s in STATS}
    size = np.diff(offsets).astype(float)
    row = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(row * len(CLASSES) + _CLASS[raw], minlength=n * len(CLASSES)).reshape(n, len(CLASSES))
    per = lambda a, b: a / np.maximum(b, 1)
    out["bytes"] = np.log1p(size)
    for k, name in enumerate(CLASSES):
        out[f"{name}_share"] = per(kinds[:, k], size)
    out["upper_of_letters"] = per(kinds[:, 1], kinds[:, 0] + kinds[:, 1])
    if not len(raw):
        return np.stack([out[s] for s in STATS], axis=1)
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True

    def runs(inside):
        first, last = W.runs(inside, offsets)
        return first, last, row[first], W.names(raw, first, last)[1]

    add = lambda of, v=None: np.bincount(of, weights=v, minlength=n)
    first, last, of, name = runs(_CLASS[raw] != 3)
    length, words = last - first, add(of).astype(float)
    out["words"], out["word_length"] = np.log1p(words), per(add(of, length), words)
    np.maximum.at(out["longest_word"], of, np.log1p(length))
    out["short_words"] = per(add(of, length <= 3), words)
    out["capital_words"] = per(add(of, _CLASS[raw[first]] == 1), words)
    letters = np.concatenate([[0], np.cumsum((_CLASS[raw] < 2) | (_CLASS[raw] == 7))])
    out["odd_words"] = per(add(of, letters[last] == letters[first]), words)
    same = np.zeros(len(name))
    same[1:] = (name[1:] == name[:-1]) & (of[1:] == of[:-1])
    out["repeat_words"] = per(add(of, same), words)
    _, key, count = np.unique(of * (len(raw) + 1) + name, return_index=True, return_counts=True)
    distinct = add(of[key]).astype(float)
    out["distinct_words"], out["distinct_by_root"] = per(distinct, words), distinct / np.sqrt(np.maximum(words, 1))
    np.maximum.at(out["top_word"], of[key], count)
    out["top_word"] = per(out["top_word"], words)
    _, _, line_of, line = runs(raw != 10)
    lines = add(line_of).astype(float)
    out["lines"], out["line_words"] = np.log1p(lines), np.log1p(per(words, lines))
    _, key = np.unique(line_of * (len(raw) + 1) + line, return_index=True)
    out["repeat_lines"] = 1 - per(add(line_of[key]), lines) * (lines > 0) - (lines == 0)
    out["stops_per_word"] = per(kinds[:, 4] + kinds[:, 5], words)
    twice = np.zeros(len(raw))
    twice[1:] = (raw[1:] == raw[:-1]) & ~edge[1:-1]
    out["repeat_bytes"] = per(add(row, twice), size)
    return np.stack([out[s] for s in STATS], axis=1)


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with text_col replaced by STATS, as doubles; null counts as the empty text."""
    bound_arrow(docs.sparkSession)
    names = [c for c in docs.columns if c != text_col]
    schema = T.StructType([*(docs.schema[c] for c in names), *(T.StructField(f"stat_{s}", T.DoubleType()) for s in STATS)])
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column(at))
            for lo, hi in spans_by_bytes(offsets, CALL_BYTES):
                o = offsets[lo : hi + 1]
                found = statistics(raw[o[0] : o[-1]], o - o[0])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(np.ascontiguousarray(found[:, k])) for k in range(len(STATS)))], names=schema.names)

    return docs.mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """Statistics that must be above (True) or at most (False) a cut, all of them."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, cut in self.terms:
            out &= (x[:, k] > cut) == above
        return out

    def column(self) -> Column:
        out = None
        for k, above, cut in self.terms:
            c = F.col(f"stat_{STATS[k]}")
            c = c > F.lit(cut) if above else c <= F.lit(cut)
            out = c if out is None else out & c
        return out

    def __str__(self):
        return " and ".join(f"{STATS[k]} {'>' if above else '<='} {cut:.4g}" for k, above, cut in self.terms)


def _tree(bins, cuts, slope, weight, rows, depth, features):
    """Split rows by the best gain; yields (path, rows) of all nodes but the root. A path has (statistic, above, cut)."""
    if depth == 0 or len(rows) < 10:
        return
    g, h = slope[rows], weight[rows]
    best, total_g, total_h = (1e-6, None, None), g.sum(), h.sum()
    for k in features:
        sums = np.bincount(bins[rows, k], weights=g, minlength=len(cuts[k]) + 1).cumsum()[:-1]
        mass = np.bincount(bins[rows, k], weights=h, minlength=len(cuts[k]) + 1).cumsum()[:-1]
        if not len(sums):
            continue
        gain = sums**2 / (mass + 1) + (total_g - sums) ** 2 / (total_h - mass + 1) - total_g**2 / (total_h + 1)
        gain[(mass < 0.5) | (total_h - mass < 0.5)] = 0
        j = int(gain.argmax())
        if gain[j] > best[0]:
            best = (gain[j], k, j)
    _, k, j = best
    if k is None:
        return
    above = bins[rows, k] > j
    for side in (False, True):
        own = rows[above == side]
        step = ((k, side, float(cuts[k][j])),)
        yield step, own
        for path, deeper in _tree(bins, cuts, slope, weight, own, depth - 1, features):
            yield step + path, deeper


def grow_rules(x: np.ndarray, y: np.ndarray, seed: int = 5) -> list[Rule]:
    """Paths of boosted trees, each on half of the rows and statistics."""
    random = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, CUTS + 2)[1:-1])) for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    score, rules = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), {}
    for _ in range(TREES):
        p = sigmoid(score)
        slope, weight = y - p, p * (1 - p)
        rows = np.flatnonzero(random.random(len(y)) < SHARE)
        features = np.flatnonzero(random.random(x.shape[1]) < 0.5)
        found = list(_tree(bins, cuts, slope, weight, rows, DEPTH, features))
        for path, own in found:
            terms: dict = {}
            for k, above, cut in path:  # one statistic twice on a path: the tighter cut holds
                terms[k, above] = (max if above else min)(cut, terms.get((k, above), cut))
            rule = Rule(tuple(sorted((k, above, cut) for (k, above), cut in terms.items())))
            rules[rule] = None
        deepest = {path: own for path, own in found}
        for path, own in found:
            if not any(len(p) > len(path) and p[: len(path)] == path for p in deepest):
                leaf = Rule(path).holds(x)
                score[leaf] += RATE * slope[own].sum() / (weight[own].sum() + 1)
    return list(rules)


def lasso_logistic(z: np.ndarray, y: np.ndarray, strength: float, rounds: int = 400, start=None) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise mean logistic loss plus strength times the sum of absolute weights (FISTA)."""
    n, m = z.shape
    # the largest eigenvalue of z'z / n, by power steps, bounds the curvature
    v = np.ones(m)
    for _ in range(20):
        v = z.T @ (z @ v.astype(z.dtype)) / n
        v /= max(np.linalg.norm(v), 1e-12)
    step = 4.0 / (1.1 * float(np.linalg.norm(z.T @ (z @ v.astype(z.dtype)) / n)) + 1)
    w, b = (np.zeros(m), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))) if start is None else start
    v, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        p = sigmoid(z @ v.astype(z.dtype) + c)
        w2 = v - step * (z.T @ (p - y).astype(z.dtype) / n)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * strength, 0)
        b2 = c - step * float((p - y).mean())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        still = np.abs(w2 - w).max(initial=abs(b2 - b)) < 1e-5
        w, b, t = w2, b2, t2
        if still:
            break
    return w, b


def screened(rules: list[Rule], x: np.ndarray, y: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """Rules that hold for different rows, the shortest of each, at most SCREENED by their correlation with the label, and their columns."""
    columns = [r.holds(x) for r in rules]
    kept: dict[bytes, int] = {}
    for k in sorted(range(len(rules)), key=lambda k: len(rules[k].terms)):
        kept.setdefault(np.packbits(columns[k]).tobytes(), k)
    picks = [k for k in sorted(kept.values()) if 0 < columns[k].sum() < len(x)]
    away = y - y.mean()
    strength = np.array([abs(away[columns[k]].sum()) / np.sqrt(columns[k].mean() * (1 - columns[k].mean())) for k in picks])
    picks = [picks[k] for k in np.sort(np.argsort(-strength, kind="stable")[:SCREENED])]
    return [rules[k] for k in picks], np.stack([columns[k] for k in picks], axis=1).astype(np.float32) if picks else np.zeros((len(x), 0), np.float32)


@dataclass
class Ensemble:
    rules: list[Rule]
    weights: np.ndarray
    intercept: float

    def column(self) -> Column:
        """The probability of label 1 as an expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights.tolist(), strict=True):
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Ensemble:
    """Rules and their lasso weights; the penalty is the best of a path on a fifth of the rows held back."""
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return Ensemble([], np.zeros(0), float(np.log(rate / (1 - rate))))
    back = np.random.default_rng(seed).random(len(y)) < 0.2
    if len(np.unique(y[back])) < 2 or len(np.unique(y[~back])) < 2:
        back[:] = False

    path = (0.02, 0.01, 0.006, 0.004, 0.0025, 0.0015, 0.001)
    rules, z = screened(grow_rules(x[~back], y[~back], seed), x[~back], y[~back])
    test = np.stack([r.holds(x[back]) for r in rules], axis=1).astype(np.float32) if rules else np.zeros((int(back.sum()), 0), np.float32)
    best, start = (np.inf, path[-2]), None
    for strength in path if back.any() else ():
        start = lasso_logistic(z, y[~back], strength, start=start)
        s = test @ start[0].astype(np.float32) + start[1]
        loss = np.logaddexp(0, -np.where(y[back] > 0, 1, -1) * s).mean()
        if loss < best[0] - 1e-4 and (start[0] != 0).sum() <= MOST_RULES:
            best = (loss, strength)
    rules, z = screened(grow_rules(x, y, seed), x, y)
    start = None
    for strength in path[: path.index(best[1]) + 1]:
        new = lasso_logistic(z, y, strength, start=start)
        if start is not None and (new[0] != 0).sum() > MOST_RULES:
            break
        start = new
    weights, intercept = start
    keep = np.argsort(-np.abs(weights))[:MOST_RULES]
    keep = np.sort(keep[weights[keep] != 0])
    return Ensemble([rules[k] for k in keep], weights[keep], intercept)


def _seen(docs: DataFrame, train, id_col: str, text_col: str, store: Stored) -> DataFrame:
    """id, train and statistics of each row, stored."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), train.alias("train"))
    return store.keep(text_statistics(rows), "statistics")


def _labelled(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, train_rows: int) -> DataFrame:
    """rows (id and more) with their label y, for a hashed sample of a bounded number of labelled ids that rows have.

    Ids meet labels before the sample is drawn, and by themselves, so labels of other rows take nothing from it.
    """
    marked = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    own = Stored(rows.sparkSession, "labelled").keep(marked.join(rows.select("id"), "id", "left_semi"), "ids")
    return rows.join(F.broadcast(hashed_sample(own, F.col("id"), train_rows, 4)), "id")  # about train_rows ids


def _learn(known: DataFrame, train_rows: int) -> Ensemble:
    """An ensemble from labelled statistics, about train_rows at most; equal rows of an id teach once."""
    columns = [f"stat_{s}" for s in STATS]
    rows = Stored(known.sparkSession, "taught").keep(known.select("id", "y", *columns).distinct(), "rows")
    got = hashed_sample(rows, F.struct("id", *columns), train_rows, 6).toPandas().sort_values(["id", *columns])
    return fit(got[columns].to_numpy(float), (got["y"] > 0).to_numpy(float))


def quality(docs: DataFrame, labels: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Quality of every whole text, learnt from labels of the documents for which the column train is true.

    Result: id_col, score double (0 to 1, higher: label 1 likelier), predicted int (1 from threshold on), a row per
    input row of docs. The rules are fitted on a hashed sample of at most about train_rows labelled rows.

    A null text counts as empty; empty texts have all statistics 0 and are scored by the same rules. Null labels and
    ids train nothing; of repeated labels of an id the largest counts. Without labels of both classes the score is
    the smoothed rate of label 1. Very long texts are read whole, and equal texts score alike. Other columns are not
    read. An empty table gives no rows.
    """
    seen = _seen(docs, train, id_col, text_col, Stored(docs.sparkSession, "quality"))
    model = _learn(_labelled(seen.where("train"), labels, id_col, label_col, train_rows), train_rows)
    return seen.select(F.col("id").alias(id_col), model.column().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))



def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs, all columns, without the rows that the rules predict label 0 for. Without labels of both classes all rows stay.

    The rules learn from the labels of the documents of docs. A row is judged by its own text, so null and repeated
    ids are rows like others. The statistics and the rules run in the scan, without a join; before that, statistics are
    computed of the sampled labelled rows only. Very long texts are read whole; rows that score alike fare alike.
    """
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    model = _learn(text_statistics(_labelled(texts, labels, id_col, label_col, train_rows)), train_rows)
    if not model.rules:
        return docs
    named = docs.select(F.struct(*docs.columns).alias("row"), docs[text_col].cast("string").alias("text"))
    judged = text_statistics(named).where(model.column() >= threshold)
    return judged.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
