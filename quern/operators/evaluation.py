"""Scores of answers, means over groupings, paired tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import text as X
from quern.sources.scratch import Scratch

# English words that tell nothing about a sense.
STOP_WORDS = ("the", "and", "for", "that", "this", "with", "from", "also", "see", "used", "abbr", "variant")


# -- groupings


def grouped_means(rows: DataFrame, sets: list[list[str]], values: list[str]) -> DataFrame:
    """Means of values and counts n for each set of columns, in one pass; columns outside a set are null."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(*(F.avg(v).alias(v) for v in values), F.count(F.lit(1)).alias("n"))


def pivot_means(rows: DataFrame, by: str, over: str, value: str, names: list[str]) -> DataFrame:
    """by, and the mean of value for each of names in over."""
    return rows.groupBy(by).pivot(over, names).avg(value)


def condition_means(scores: DataFrame, conditions: list[str], dims: list[str], by: list[str] = ()) -> DataFrame:
    """by, condition, dim, mean, n of scores.<condition>.<dim>; nulls are left out."""
    cells = F.array(*(F.struct(F.lit(c).alias("condition"), F.lit(d).alias("dim"), F.col(f"scores.{c}.{d}").cast("double").alias("score")) for c in conditions for d in dims))
    rows = scores.select(*by, F.inline(cells)).where("score is not null")
    return rows.groupBy(*by, "condition", "dim").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"))


def with_deltas(rows: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """Three conditions side by side with their differences."""
    return rows.withColumns({f"{b}_minus_{a}": F.col(b) - F.col(a), f"{c}_minus_{a}": F.col(c) - F.col(a), f"{c}_minus_{b}": F.col(c) - F.col(b)})


def size_table(rows: DataFrame, by: str = "band", a: str = "rag_context_chars", b: str = "mcp_context_chars") -> DataFrame:
    """Mean sizes, their ratio and n by band, with a total row where band is null."""
    out = rows.rollup(by).agg(F.avg(a).alias(a), F.avg(b).alias(b), F.count(F.lit(1)).alias("n"))
    return out.withColumn("ratio", F.try_divide(b, a))


def extremes(rows: DataFrame, value: str, tie: str, n: int = 10) -> DataFrame:
    """The n largest (side top) and the n smallest (side bottom); they overlap where there are few rows."""
    top = rows.orderBy(F.desc(value), tie).limit(n).withColumn("side", F.lit("top"))
    return top.unionByName(rows.orderBy(value, F.desc(tie)).limit(n).withColumn("side", F.lit("bottom")))


def judge_disagreement(ratings: DataFrame) -> DataFrame:
    """entry, disagreement: the mean absolute difference of pairs of judges over dimensions. ratings: entry, judge, scores (array)."""
    grouped = ratings.groupBy("entry").agg(F.sort_array(F.collect_list(F.struct("judge", "scores"))).alias("js"))
    pairs = F.flatten(F.transform("js", lambda a: F.transform(F.filter("js", lambda b: b["judge"] > a["judge"]), lambda b: F.zip_with(a["scores"], b["scores"], lambda x, y: F.abs(x - y)))))
    flat = F.flatten(pairs)
    return grouped.select("entry", F.aggregate(flat, F.lit(0.0), lambda s, x: s + x, lambda s: F.try_divide(s, F.size(flat))).alias("disagreement"))


def judge_means(ratings: DataFrame) -> DataFrame:
    """One row: means over entries of the means over judges, for accuracy, naturalness and completeness."""
    names = ("accuracy", "naturalness", "completeness")
    per = ratings.groupBy("entry").agg(*(F.avg(F.col("scores")[i]).alias(n) for i, n in enumerate(names)))
    return per.agg(*(F.avg(n).alias(n) for n in names), F.count(F.lit(1)).alias("n"))


def backend_summary(results: DataFrame) -> DataFrame:
    """backend, n, mean time, languages and valid ones of successful rows, and the share of matches where there is a reference."""
    ok = results.where("error is null")
    return ok.groupBy("backend").agg(F.count(F.lit(1)).alias("n"), F.avg("seconds").alias("seconds"), F.avg("langs").alias("langs"), F.avg("valid").alias("valid"), F.try_divide(F.count_if("matches"), F.count("matches")).alias("match_share"))


def usage_totals(responses: DataFrame) -> DataFrame:
    """condition, tokens, errors from an array of answers per row."""
    rows = responses.select(F.explode("answers").alias("a"))
    return rows.groupBy(F.col("a.condition").alias("condition")).agg(F.sum(F.coalesce("a.usage.total_tokens", F.lit(0))).alias("tokens"), F.count_if(F.col("a.error").isNotNull()).alias("errors"))


def pending(work: DataFrame, done: DataFrame, key: str = "term", complete: Column | None = None) -> DataFrame:
    """Work that isn't done; rows of done that aren't complete don't count."""
    return work.join((done if complete is None else done.where(complete)).select(key), key, "left_anti")


# -- scores of answers


def pinyin_score(answer: Column, reference: Column) -> Column:
    """1 if the answer's pinyin has the reference's letters and tones, or there is no reference."""
    found = X.extract_pinyin(answer)
    same = X.compare_pinyin(found) == X.compare_pinyin(reference)
    return F.when(F.coalesce(reference, F.lit("")) == "", 1.0).when(F.coalesce(same, F.lit(False)), 1.0).otherwise(0.0)


def completeness_score(answer: Column, definitions: Column) -> Column:
    """The share of reference definitions of which at least half of the key words stand in the answer; 1 without any."""
    low = F.lower(answer)
    keys = lambda d: F.filter(F.regexp_extract_all(F.lower(d), F.lit("([a-zA-Z]{3,})"), F.lit(1)), lambda w: ~w.isin(*STOP_WORDS))
    covered = F.filter(definitions, lambda d: F.size(F.filter(keys(d), lambda w: F.contains(low, w))) >= F.size(keys(d)) * 0.5)
    return F.when(F.coalesce(F.size(definitions), F.lit(0)) <= 0, 1.0).otherwise(F.size(covered) / F.size(definitions))


def example_score(answer: Column, term: Column) -> Column:
    """1 if a line has four Han characters in a row and the term."""
    return F.when(F.exists(F.split(answer, "\n"), lambda x: x.rlike(r"[\x{4E00}-\x{9FFF}]{4,}") & F.contains(x, term)), 1.0).otherwise(0.0)


def score_entries(responses: DataFrame, references: DataFrame, conditions: list[str], order: str | None = None) -> DataFrame:
    """term, band, condition, answered, pinyin, completeness, term_present, example, composite (the mean of the four).

    responses: term, band, response_<condition>. references: term, pinyin, definitions (array of strings) and, if it
    has one, band ('unknown' where null), which replaces that of responses. Of references to one term the last by order
    counts, or the greatest row without an order. Responses to terms without a reference are left out. Missing and empty
    answers score 0 and aren't answered; answered_scores leaves them out.
    """
    own = [c for c in ("pinyin", "definitions", "band") if c in references.columns]
    last = references.groupBy("term").agg(F.max_by(F.struct(*own), order if order else F.struct(*own)).alias("_r"))
    band = F.coalesce("_r.band", F.lit("unknown")) if "band" in own else F.col("band")
    cells = F.array(*(F.struct(F.lit(c).alias("condition"), F.col(f"response_{c}").alias("answer")) for c in conditions))
    rows = responses.join(last, "term").select("term", band.alias("band"), F.col("_r.pinyin").alias("_p"), F.col("_r.definitions").alias("_d"), F.inline(cells))
    has = F.coalesce(F.col("answer"), F.lit("")) != ""
    text = F.col("text")
    found = {"pinyin": pinyin_score(text, F.col("_p")), "completeness": completeness_score(text, F.col("_d")), "term_present": F.contains(text, F.col("term")).cast("double"), "example": example_score(text, F.col("term"))}
    rows = rows.withColumns({"answered": has, "text": X.strip_thinking(F.coalesce("answer", F.lit("")))})
    rows = rows.select("term", "band", "condition", "answered", *(F.when(F.col("answered"), c).otherwise(0.0).alias(k) for k, c in found.items()))
    return rows.withColumn("composite", (F.col("pinyin") + F.col("completeness") + F.col("term_present") + F.col("example")) / 4)


def answered_scores(scores: DataFrame) -> DataFrame:
    """The rows that means by condition are taken of: means by band take all, missing answers as 0."""
    return scores.where("answered")


def translation_eval(definitions: DataFrame, bands: DataFrame, ref_source: str, own_source: str) -> DataFrame:
    """headword_id, lang, band and the overlap of two sources' glosses: the rows that means over lang, band and all are taken of."""
    one = lambda s, name: definitions.where(F.col("source") == s).select("headword_id", "lang", F.col("definition").alias(name))
    rows = one(ref_source, "ref").join(one(own_source, "own"), ["headword_id", "lang"]).join(bands.select("headword_id", "band"), "headword_id", "left")
    found = X.gloss_overlap(X.split_glosses(F.col("ref")), X.split_glosses(F.col("own")), F.col("lang"))
    return rows.select("headword_id", "lang", "band", found.alias("o"), X.is_gloss_format(F.col("own")).alias("gloss_format")).select("headword_id", "lang", "band", "o.*", "gloss_format")


# -- paired tests


#: Parts that distinct sizes are ranked in, and the accuracy of their bounds.
RANK_PARTS, RANK_ACCURACY = 200, 2000


def _ranked(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """d, k, rank: distinct differences, the number of each, and their mean rank by size.

    They are computed once and stored: pairs may be sums of doubles, which come out different in their last bits when they
    are added again in another order, and counts of the one run don't meet differences of the other. Ranks come from counts
    per size. Sizes are ordered within parts between approximate percentiles, so no task gets all of them; only the parts'
    totals are summed in one place.
    """
    rows = pairs.select((F.col(b) - F.col(a)).alias("d")).where("d is not null and d <> 0")
    rows = Scratch(pairs.sparkSession).table(rows.groupBy("d").agg(F.count(F.lit(1)).alias("k")), "differences")
    sizes = rows.groupBy(F.abs("d").alias("size")).agg(F.sum("k").alias("k"))
    bounds = sizes.agg(F.percentile_approx("size", [i / RANK_PARTS for i in range(1, RANK_PARTS)], RANK_ACCURACY).alias("bounds"))
    part = F.size(F.filter("bounds", lambda x: x < F.col("size")))
    sizes = sizes.join(F.broadcast(bounds)).select("size", "k", part.alias("part"))  # one row
    inside = Window.partitionBy("part").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    below = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("k").alias("all")).select("part", F.coalesce(F.sum("all").over(below), F.lit(0)).alias("below"))  # RANK_PARTS rows at most
    sizes = sizes.join(F.broadcast(parts), "part").select("size", (F.col("below") + F.coalesce(F.sum("k").over(inside), F.lit(0)) + (F.col("k") + 1) / 2).alias("rank"))
    return rows.withColumn("size", F.abs("d")).join(sizes, "size").select("d", "k", "rank")


def ranked_differences(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """d, rank: differences b - a that aren't 0, ranked by size; ties have the mean of their ranks."""
    return _ranked(pairs, a, b).select("d", "rank", F.explode(F.sequence(F.lit(1).cast("long"), "k"))).select("d", "rank")


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2))))


def wilcoxon(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: n, w_plus, w_minus, w, z, p of the signed-rank test of b - a.

    z and p are null under ten differences; without any difference w is 0 and p is 1.
    """
    ranks = F.col("k") * F.col("rank")
    rows = _ranked(pairs, a, b).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("d") > 0, ranks)), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("d") < 0, ranks)), F.lit(0.0)).alias("w_minus"))
    n = F.col("n").cast("double")
    rows = rows.withColumn("w", F.least("w_plus", "w_minus"))
    z = F.try_divide(F.col("w") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24))
    rows = rows.withColumn("z", F.when(n >= 10, z))
    two_sided = F.least(F.lit(1.0), 2 * normal_cdf(-F.abs(F.coalesce("z", F.lit(0.0)))))
    return rows.withColumn("p", F.when(n == 0, 1.0).when(F.col("z").isNotNull(), two_sided))


#: A part of a group's distinct values that one task resamples holds about so many of them.
PART_VALUES = 2048


def _nodes(parts: DataFrame) -> DataFrame:
    """g, part, path: the nodes (level, node, n) over each part, from the group down, with the rows below each."""
    steps = parts.select("g", "part", "n", F.explode(F.sequence(F.lit(0), "levels")).alias("level"), "levels")
    steps = steps.select("g", "part", "n", "level", F.expr("shiftright(part, levels - level)").alias("node"))
    held = steps.groupBy("g", "level", "node").agg(F.sum("n").alias("below"))
    path = F.sort_array(F.collect_list(F.struct("level", "node", "below")))  # as long as the tree is deep
    return steps.join(held, ["g", "level", "node"]).groupBy("g", "part").agg(path.alias("path"))


def resampled(rows: DataFrame, by: list[str], value: str, rounds: int, seed: int) -> DataFrame:
    """by, n, mean, means: sorted means of as many resamples of a group as rounds says; null where it has no value.

    A resample draws n of the group's n values with replacement. Equal values are counted first and drawn together. A
    group's distinct values are dealt by hash to the leaves of a tree: how many of the n draws fall below either side of
    a node is binomial, drawn with a seed of the node's own, so each leaf knows its share of every resample from its
    path alone, and draws it among its values. Sums of leaves add up to those of the group. So no task has a group whole;
    only its rounds means meet, to be sorted. Reruns agree but for the order in which doubles are added.
    """
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    read = rows.select(key.alias("g"), F.col(value).cast("double").alias("d"))
    groups = read.select("g").distinct()
    values = read.where("d is not null").groupBy("g", "d").agg(F.count(F.lit(1)).alias("k"))
    sizes = values.groupBy("g").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("distinct"), F.sum(F.col("d") * F.col("k")).alias("total"))
    levels = F.greatest(F.lit(0), F.ceil(F.log2(F.col("distinct") / PART_VALUES))).cast("int")
    sizes = sizes.select("g", "n", (F.col("total") / F.col("n")).alias("mean"), levels.alias("levels"))
    dealt = values.join(sizes.select("g", "levels"), "g")
    dealt = dealt.select("g", "d", "k", "levels", F.pmod(F.xxhash64("d"), F.expr("shiftleft(1L, levels)")).alias("part"))
    parts = dealt.groupBy("g", "levels", "part").agg(F.sum("k").alias("n"))

    kind = T.StructType([parts.schema["g"], T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def draw(own: pa.Table, path: pa.Table) -> pa.Table:
        own = own.combine_chunks().sort_by("d")
        steps = [(s["level"], s["node"], s["below"]) for s in path.column("path")[0].as_py()]
        number = path.column("number")[0].as_py() & ((1 << 64) - 1)
        source = lambda level, node: np.random.default_rng([seed, number, level, node])
        share = np.full(rounds, steps[0][2], np.int64)
        for (level, node, n), (_, child, below) in zip(steps[:-1], steps[1:], strict=True):
            left = below if child % 2 == 0 else n - below
            first = source(level, node).binomial(share, left / n)
            share = first if child % 2 == 0 else share - first
        d, k = own.column("d").to_numpy(), own.column("k").to_numpy().astype(float)
        random, sums = source(steps[-1][0] + 1, steps[-1][1]), np.empty(rounds)
        step = max(1, (1 << 20) // len(d))
        for lo in range(0, rounds, step):
            sums[lo : lo + step] = random.multinomial(share[lo : lo + step], k / k.sum()) @ d
        return pa.table([path.column("of").slice(0, 1), pa.array([sums.tolist()], pa.list_(pa.float64()))], names=kind.names)

    # the number is of a seed only
    paths = _nodes(parts).select(F.col("g").alias("of"), F.col("part").alias("leaf"), "path", F.xxhash64("g").alias("number"))
    drawn = dealt.groupBy("g", "part").cogroup(paths.groupBy("of", "leaf")).applyInArrow(draw, kind)
    sums = drawn.select("g", F.posexplode("sums").alias("round", "part_sum")).groupBy("g", "round").agg(F.sum("part_sum").alias("total"))
    means = sums.join(sizes, "g").groupBy("g").agg(F.sort_array(F.collect_list(F.col("total") / F.col("n"))).alias("means"))
    found = groups.join(sizes.join(means, "g").select("g", "n", "mean", "means"), "g", "left")
    return found.select(*(F.col("g").getField(c).alias(c) for c in by), F.coalesce("n", F.lit(0).cast("long")).alias("n"), "mean", "means")


def order_statistic(means: Column, q: float) -> Column:
    """The value at place int(q * count) of a sorted array, or its last."""
    return F.get(means, F.least(F.size(means) - 1, F.floor(F.lit(q) * F.size(means)).cast("int")))


def paired_bootstrap(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b", rounds: int = 10_000, seed: int = 42) -> DataFrame:
    """by, n, mean_diff, p (two-sided), low, high (95 %) of paired differences b - a; pairs with a null side don't count.

    A group without pairs has n = 0 and nulls. See resampled for how groups are drawn.
    """
    found = resampled(pairs.withColumn("difference of the pair", F.col(b) - F.col(a)), by, "difference of the pair", rounds, seed)
    beyond = F.when(F.col("mean") >= 0, F.size(F.filter("means", lambda x: x <= 0))).otherwise(F.size(F.filter("means", lambda x: x >= 0)))
    p = F.when(F.col("mean").isNotNull(), F.least(F.lit(1.0), 2 * beyond / F.size("means")))
    return found.select(*by, "n", F.col("mean").alias("mean_diff"), p.alias("p"), order_statistic(F.col("means"), 0.025).alias("low"), order_statistic(F.col("means"), 0.975).alias("high"))


def means_with_interval(rows: DataFrame, by: list[str], value: str, confidence: float = 0.95, rounds: int = 5000, seed: int = 42) -> DataFrame:
    """by, n, mean, low, high; under three values the interval is the mean, and without any all three are 0."""
    tail = (1 - confidence) / 2
    found = resampled(rows, by, value, rounds, seed).withColumn("mean", F.coalesce("mean", F.lit(0.0)))
    bound = lambda q: F.when(F.col("n") >= 3, order_statistic(F.col("means"), q)).otherwise(F.col("mean"))
    return found.select(*by, "n", "mean", bound(tail).alias("low"), bound(1 - tail).alias("high"))


def stars(p: float | None) -> str:
    """Marks of significance at .001, .01 and .05."""
    return "" if p is None else "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else ""


def markdown_table(df: DataFrame, digits: int = 3) -> str:
    """A small frame as a Markdown table."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    rows = [df.columns, ["---"] * len(df.columns), *([show(v) for v in r] for r in df.collect())]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def latex_table(df: DataFrame, digits: int = 3) -> str:
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    body = [" & ".join(r) + r" \\" for r in (df.columns, *([show(v) for v in r] for r in df.collect()))]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", *body, r"\end{tabular}"])


def blind_order(rows: DataFrame, labels: list[str], seed: int = 42, key: str = "term") -> DataFrame:
    """rows with a map from blind letter to label, shuffled by a hash of key and seed: the same on every run."""
    ordered = F.sort_array(F.array(*(F.struct(F.xxhash64(F.lit(seed), F.col(key), F.lit(x)).alias("h"), F.lit(x).alias("label")) for x in labels)))
    letters = F.array(*(F.lit(chr(65 + i)) for i in range(len(labels))))
    return rows.withColumn("mapping", F.map_from_arrays(letters, F.transform(ordered, lambda x: x["label"])))


def unblind(rows: DataFrame, raw: str = "raw_scores") -> DataFrame:
    """Scores by label, from scores by blind letter."""
    return rows.withColumn("scores", F.map_from_entries(F.transform(F.map_entries("mapping"), lambda e: F.struct(e["value"].alias("key"), F.try_element_at(F.col(raw), e["key"]).alias("value")))))
