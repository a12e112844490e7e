import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import evaluation as E
from tests.conftest import rows


def test_scores(spark):
    responses = spark.createDataFrame([("爱", "high", "爱 (ai4): to love\n我爱你们大家。", None), ("书", "low", "x", "Pinyin: shū.\nbook\n这是一本书。")], "term string, band string, response_a string, response_b string")
    references = spark.createDataFrame([("爱", "ai4", ["to love", "affection"]), ("书", "shu1", ["book"])], "term string, pinyin string, definitions array<string>")
    scores = E.score_entries(responses, references, ["a", "b"])
    got = {(r["term"], r["condition"]): r for r in scores.collect()}
    assert [got["爱", "a"][c] for c in ("term_present", "composite", "answered")] == [1.0, 3.5 / 4, True]
    assert rows(E.answered_scores(scores).select("term", "condition")) == [("书", "a"), ("书", "b"), ("爱", "a")]
    assert (got["爱", "a"]["pinyin"], got["爱", "a"]["completeness"], got["爱", "a"]["example"]) == (1.0, 0.5, 1.0)
    assert got["爱", "b"]["composite"] == 0.0
    assert (got["书", "b"]["pinyin"], got["书", "b"]["completeness"], got["书", "b"]["example"]) == (1.0, 1.0, 1.0)


def test_scores_need_a_reference_and_take_the_last(spark):
    responses = spark.createDataFrame([("a", "high", "a [ma1]\nhorse"), ("b", "low", "b")], "term string, band string, response_x string")
    references = spark.createDataFrame([("a", "ma3", ["sheep"], None, 1), ("a", "ma1", ["horse"], None, 2)], "term string, pinyin string, definitions array<string>, band string, line_no int")
    got = E.score_entries(responses, references, ["x"], "line_no")
    assert rows(got.select("term", "band", "pinyin", "completeness", "term_present", "example")) == [("a", "unknown", 1.0, 1.0, 1.0, 0.0)]


def test_ranks_over_parts_match_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(E, "RANK_PARTS", 7)
    random = np.random.default_rng(5)
    d = random.integers(-60, 60, 400).astype(float)
    got = rows(E.ranked_differences(spark.createDataFrame([(0.0, x) for x in d.tolist()], "a double, b double")))
    size = np.abs(d[d != 0])
    assert got == sorted(((x, (size < abs(x)).sum() + ((size == abs(x)).sum() + 1) / 2) for x in d[d != 0].tolist()), key=repr)


def test_wilcoxon(spark):
    random = np.random.default_rng(1)
    a, b = random.integers(0, 9, 40).astype(float), random.integers(0, 9, 40).astype(float)
    d = (b - a)[a != b]
    order = np.abs(d)
    ranks = np.array([(order < x).sum() + ((order == x).sum() + 1) / 2 for x in order])
    r = E.wilcoxon(spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a double, b double")).first()
    assert (r["n"], r["w_plus"], r["w_minus"]) == (len(d), ranks[d > 0].sum(), ranks[d < 0].sum())
    n, w = len(d), min(ranks[d > 0].sum(), ranks[d < 0].sum())
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    assert r["z"] == pytest.approx(z) and r["p"] == pytest.approx(min(1, 2 * 0.5 * (1 + math.erf(-abs(z) / math.sqrt(2)))))
    few = E.wilcoxon(spark.createDataFrame([(1.0, 2.0)], "a double, b double")).first()
    assert few["n"] == 1 and few["z"] is None and few["p"] is None
    for none in ([], [(1.0, 1.0)] * 3):
        r = E.wilcoxon(spark.createDataFrame(none, "a double, b double")).first()
        assert (r["n"], r["w"], r["p"]) == (0, 0.0, 1.0)


def test_bootstrap(spark):
    df = spark.createDataFrame([("g", float(i), float(i) + 1) for i in range(12)] + [("h", 1.0, 1.0)] * 4, "k string, a double, b double")
    got = {r["k"]: r for r in E.paired_bootstrap(df, ["k"], rounds=200).collect()}
    assert got["g"]["mean_diff"] == 1 and got["g"]["p"] == 0 and got["g"]["low"] == got["g"]["high"] == 1
    assert got["h"]["mean_diff"] == 0 and got["h"]["p"] == 1
    m = {r["k"]: r for r in E.means_with_interval(df, ["k"], "a", rounds=200).collect()}
    assert m["g"]["low"] <= m["g"]["mean"] <= m["g"]["high"]
    empty = E.means_with_interval(spark.createDataFrame([("k", None)], "k string, v double"), ["k"], "v").first()
    assert tuple(empty) == ("k", 0, 0.0, 0.0, 0.0)


def test_resamples_of_dealt_groups_are_those_of_whole_ones(spark, monkeypatch):
    """Dealt over a tree of parts, means of resamples are spread as those of draws with replacement from the group."""
    monkeypatch.setattr(E, "PART_VALUES", 8)
    random = np.random.default_rng(1)
    big = random.normal(3, 2, 400).round(3).tolist() + [5.0] * 100
    data = [("big", v) for v in big] + [(None, 1.0), (None, 4.0), (None, None), ("one", 2.5), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r["k"]: r for r in E.resampled(df, ["k"], "v", 2000, 7).collect()}
    assert set(got) == {"big", None, "one", "none"} and (got["none"]["n"], got["none"]["means"]) == (0, None)
    means = np.array(got["big"]["means"])
    whole = np.array([random.choice(big, len(big)).mean() for _ in range(2000)])
    assert len(means) == 2000 and (np.diff(means) >= 0).all() and got["big"]["n"] == 500
    assert abs(means.mean() - np.mean(big)) < 0.01 and abs(means.std() / whole.std() - 1) < 0.08
    assert np.abs(np.quantile(means, [0.05, 0.5, 0.95]) - np.quantile(whole, [0.05, 0.5, 0.95])).max() < 0.03
    values, counts = np.unique(got[None]["means"], return_counts=True)  # of two values, halves of the draws are mixed
    assert values.tolist() == [1.0, 2.5, 4.0] and abs(counts[1] / 2000 - 0.5) < 0.06
    assert set(got["one"]["means"]) == {2.5}
    again = E.resampled(df.repartition(3, "v"), ["k"], "v", 2000, 7).where("k = 'big'").first()["means"]
    assert np.allclose(again, means)
    assert E.resampled(df, [], "v", 10, 1).first()["n"] == 503
    few = E.means_with_interval(df, ["k"], "v", rounds=50).where("k is null").first()
    assert tuple(few) == (None, 2, 2.5, 2.5, 2.5)
    pairs = E.paired_bootstrap(df.select("k", F.lit(0.0).alias("a"), F.col("v").alias("b")), ["k"], rounds=400)
    r = {r["k"]: r for r in pairs.collect()}
    assert r["big"]["p"] == 0 and r["big"]["low"] < r["big"]["mean_diff"] < r["big"]["high"] and r["none"]["p"] is None


def test_groupings(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 5.0)], "lang string, band string, v double")
    assert rows(E.grouped_means(df, [["lang"], ["band"], []], ["v"])) == [("a", None, 2.0, 2), ("b", None, 5.0, 1), (None, "x", 3.0, 2), (None, "y", 3.0, 1), (None, None, 3.0, 3)]
    assert rows(E.with_deltas(spark.createDataFrame([(1.0, 2.0, 4.0)], "p double, q double, r double"), "p", "q", "r")) == [(1.0, 2.0, 4.0, 1.0, 3.0, 2.0)]
    sizes = spark.createDataFrame([("high", 10, 30), ("low", 20, 20)], "band string, rag_context_chars int, mcp_context_chars int")
    assert rows(E.size_table(sizes))[-1][1:] == (15.0, 25.0, 2, pytest.approx(25 / 15))
    assert rows(E.extremes(df, "v", "band", 1).select("v", "side")) == [(1.0, "bottom"), (5.0, "top")]
    r = spark.createDataFrame([("e", "j1", [1, 2, 3]), ("e", "j2", [2, 2, 5]), ("f", "j1", [1, 1, 1])], "entry string, judge string, scores array<int>")
    assert rows(E.judge_disagreement(r)) == [("e", 1.0), ("f", None)]
    assert E.judge_means(r).first()["accuracy"] == 1.25
    s = spark.createDataFrame([({"a": 1, "b": 2}, "t")], "m map<string,int>, term string").select("term", F.struct(F.struct(F.col("m")["a"].alias("x"), F.lit(None).cast("int").alias("y")).alias("rag")).alias("scores"))
    assert rows(E.condition_means(s, ["rag"], ["x", "y"])) == [("rag", "x", 1.0, 1)]
    b = spark.createDataFrame([("m", 1.0, 3, 2, True, None), ("m", 3.0, 1, 1, None, None), ("m", 9.0, 9, 9, True, "x")], "backend string, seconds double, langs int, valid int, matches boolean, error string")
    assert rows(E.backend_summary(b)) == [("m", 2, 2.0, 2.0, 1.5, 1.0)]
    u = spark.sql("select array(named_struct('condition','a','usage',named_struct('total_tokens',5),'error',null), named_struct('condition','a','usage',named_struct('total_tokens',null),'error','x')) answers")
    assert rows(E.usage_totals(u)) == [("a", 5, 1)]
    done = spark.createDataFrame([("t1", "x"), ("t2", None)], "term string, answer string")
    work = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "term string")
    assert rows(E.pending(work, done, complete=F.col("answer").isNotNull())) == [("t2",), ("t3",)]


def test_blind(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "term string")
    got = E.blind_order(df, ["x", "y"])
    assert rows(got.select("term", F.map_entries("mapping"))) == rows(E.blind_order(df, ["x", "y"]).select("term", F.map_entries("mapping")))
    back = E.unblind(got.withColumn("raw_scores", F.create_map(F.lit("A"), F.lit(1), F.lit("B"), F.lit(2)))).collect()
    assert all(sorted(r["scores"].values()) == [1, 2] and set(r["scores"]) == {"x", "y"} for r in back)


def test_translation_eval(spark):
    d = spark.createDataFrame([(1, "en", "bank/shore", "cedict"), (1, "en", "bank", "minimax"), (2, "en", "x", "cedict")], "headword_id int, lang string, definition string, source string")
    r = E.translation_eval(d, spark.createDataFrame([(1, "high")], "headword_id int, band string"), "cedict", "minimax").first()
    assert r["sense_coverage"] == 0.5 and r["false_sense_rate"] == 0.0 and r["gloss_format"]
    table = spark.createDataFrame([("a", 0.5)], "k string, v double")
    assert E.markdown_table(table).splitlines()[-1] == "| a | 0.500 |" and "a & 0.500" in E.latex_table(table)
    assert [E.stars(p) for p in (0.0001, 0.005, 0.03, 0.5, None)] == ["***", "**", "*", "", ""]


def test_differences_are_computed_once(spark):
    """Pairs that come out different each time they are computed, as sums of doubles may."""

    @F.udf("double")
    def noisy(i):
        import random

        return 1 + i + random.random() / 2

    r = E.wilcoxon(spark.range(300).select(F.lit(0.0).alias("a"), noisy.asNondeterministic()("id").alias("b"))).first()
    assert (r["n"], r["w_plus"], r["w_minus"]) == (300, 300 * 301 / 2, 0)
