import pytest
from pyspark.sql import functions as F

from quern.functions import scripts as G
from quern.operators import dialects as D
from quern.operators import lexicon as L
from quern.operators import translate as T
from tests.conftest import rows

HEAD = "id long, traditional string, simplified string, pinyin string, pos string"
DEFS = "id long, headword_id long, lang string, definition string, source string"
FORMS = "headword_id long, dialect string, native_chars string, pronunciation string, gloss string, source string"


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(1, "女", "女", "nv3", None), (2, "女", "女", "nu:3", None), (3, "何", "何", "He2", None), (4, "何", "何", "he2", "noun")], HEAD)


@pytest.fixture(scope="module")
def defs(spark):
    return spark.createDataFrame([(1, 1, "en", "woman", "cedict"), (2, 2, "en", "female", "cedict"), (3, 2, "fr", "femme", "cfdict"), (4, 3, "en", "surname He", "cedict"), (5, 4, "en", "to carry", "zz"), (6, 4, "en", "what", "minimax")], DEFS)


@pytest.fixture(scope="module")
def forms(spark):
    return spark.createDataFrame([(2, "yue", None, "neoi5", None, "x"), (1, "nan", None, "lú", None, "x")], FORMS)


def test_reconcile(words, defs, forms):
    assert rows(L.variant_pairs(words)) == [(1, 2)]
    assert rows(L.variant_pair_count(words)) == [(1, 1)]
    w, d, f = L.reconcile(words, defs, forms)
    assert [r[0] for r in rows(w.select("id"))] == [1, 3, 4]
    assert rows(d.select("headword_id", "lang", "definition").where("headword_id = 1")) == [(1, "en", "woman"), (1, "fr", "femme")]
    assert rows(f.select("headword_id", "dialect")) == [(1, "nan"), (1, "yue")]
    assert dict(rows(L.fill_pos(w, d).select("id", "pos"))) == {1: None, 3: None, 4: "noun"}


def test_conflicts(spark):
    e = spark.createDataFrame([("a", "a", "x1 (x¹)5", "", 1), ("a", "a", "x1", "verb", 2), ("a", "a", "x1", "noun", 3)], "traditional string, simplified string, pinyin string, pos string, arrival int")
    assert rows(L.upsert_headwords(e).select("pinyin", "pos")) == [("x1", "verb")]
    d = spark.createDataFrame([(1, "en", "s", "old", True, 1), (1, "en", "s", None, True, 2), (1, "de", "s", "x", True, 3)], "headword_id int, lang string, source string, definition string, verified boolean, arrival int")
    assert rows(L.upsert_definitions(d).select("lang", "definition", "verified")) == [("de", "x", True), ("en", None, False)]
    t = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b", 1), (2, "c", 2), (2, "d", 3)], "k int, v string, arrival int")
    assert rows(L.append_new(t, new, ["k"], "arrival").select("k", "v")) == [(2, "c")]
    s = spark.createDataFrame([("cedict", "d", "l", "u")], "name string, description string, license string, url string")
    known = spark.createDataFrame([("jmdict", "J", "CC", "http")], "name string, description string, license string, url string")
    got = L.ensure_sources(s, spark.createDataFrame([("jmdict",), ("new",), ("cedict",)], "name string"), known)
    assert rows(got) == [("cedict", "d", "l", "u"), ("jmdict", "J", "CC", "http"), ("new", "", "", None)]


def test_coverage(words, defs):
    got = {r["lang"]: r for r in L.coverage(defs, 4).collect()}
    assert got["en"]["covered"] == 4 and got["en"]["percent"] == 100.0 and got["fr"]["sources"] == "cfdict" and got["fr"]["percent"] == 25.0
    assert dict(rows(L.coverage_gaps(words, defs, ("en", "fr", "de")))) == {"en": 0, "fr": 3, "de": 4}
    plan = L.without_definition(words, defs, lang="fr")
    assert "LeftAnti" in plan._jdf.queryExecution().toString() and plan.count() == 3


def test_matching_uses_no_nested_loop(spark, words):
    r = spark.createDataFrame([("何", 1), ("无", 2)], "word string, line_no int")
    got = L.match_words(r, words)
    assert rows(got.select("headword_id")) == [(3,), (4,)]
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    assert rows(L.source_bands(spark.createDataFrame([(1, s) for s in "abcd"] + [(2, "a")], "headword_id int, source string"))) == [(1, 4, "high"), (2, 1, "rare")]


def test_best_and_export(spark, words, defs, tmp_path):
    best = L.best_definitions(words, defs, "en")
    assert dict(rows(best.select("id", "definition"))) == {1: "woman", 2: "female", 3: "surname He", 4: "what"}
    assert [r["line"] for r in L.export_lines(words, defs, "en").collect()] == ["何 何 [He2] /surname He/", "何 何 [he2] /what/", "女 女 [nu:3] /female/", "女 女 [nv3] /woman/"]
    assert L.export_all(words, defs, str(tmp_path / "out")) == ["en", "fr"]
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out/en")).collect()]
    assert "# Entries: 4" in lines and "女 女 [nv3] /woman/" in lines


def test_backfill(spark, words, defs):
    langs = ["en", "de", "fr"]
    part = L.partial_coverage(words, defs, langs, include_zero=True)
    assert part.count() == 4 and dict(rows(L.missing_counts(part))) == {"de": 4, "fr": 4, "en": 3}
    work = {r["headword_id"]: r for r in L.backfill_work(words, defs, langs, 10, include_zero=True, max_langs=1).collect()}
    assert work[4]["existing_defs"] == {"en": "what"} and work[2]["existing_defs"] == {"en": "female", "fr": "femme"} and work[1]["missing_langs"] == ["de"]
    good, bad = T.backfill(words, defs, T.offline, langs, size=10, include_zero=True)
    assert good.where("headword_id = 4").count() == 2 and bad.count() == 0
    assert L.batch_size(10, 20) == 12 and L.batch_size(5, 20) == 20
    ids = spark.createDataFrame([(3,)], "id long")
    assert rows(T.retranslate_work(words, defs.withColumn("confidence", F.lit(None).cast("string")), ids).select("id", "scope")) == [(3, "narrow_name")]


def test_limited_translator_is_retried():
    calls = []

    def limited(prompts):
        calls.append(len(prompts))
        if len(calls) < 3:
            raise T.RateLimited
        return ["ok"]

    assert T.call(limited, ["a", "b"], wait=0) == ["ok", ""] and len(calls) == 3
    assert T.fit_length(["a", "b", "c"], 2) == ["a", "b"]


def test_contamination_and_repair(spark, words, defs, forms):
    d = defs.unionByName(spark.createDataFrame([(9, 4, "de", "银行 x", "minimax"), (10, 4, "ja", "銀行", "minimax")], DEFS))
    assert rows(L.leaked(d).select("id")) == [(9,)]
    assert rows(L.contamination_report(d, G.validate(F.col("lang"), F.col("definition"))).where("bad > 0").select("lang", "script", "bad")) == [("de", "cjk", 1), ("de", None, 1)]
    assert L.without_ids(d, L.leaked(d)).count() == 7
    assert L.samples(d, ["lang"], "id", 2).where("lang = 'en'").count() == 2
    e = spark.createDataFrame([("何", "何", "He2", "x"), ("何", "何", "he2", "y"), ("新", "新", "xin1", "z")], "traditional string, simplified string, pinyin string, definition string")
    assert rows(L.classify_entries(e, words, defs).select("pinyin", "status", "proper")) == [("He2", "complete", True), ("he2", "missing_definition", False), ("xin1", "missing_headword", False)]
    odd = words.unionByName(spark.createDataFrame([(7, "\U00030001", "x", "p", None)], HEAD))
    w, _, _ = L.drop_odd_headwords(odd, defs, forms)
    assert w.count() == 4
    assert rows(L.entry_counts(spark.createDataFrame([("cedict",), ("x",)], "name string"), defs, forms)) == [("cedict", 3, 0), ("x", 0, 2)]


def test_samples_repeat(spark):
    b = spark.createDataFrame([(i, "high" if i % 2 else "low") for i in range(50)], "headword_id int, band string")
    a = rows(L.sample_bands(b, 5))
    assert len(a) == 10 and a == rows(L.sample_bands(b.repartition(7), 5))


def test_derive_from_compounds(spark):
    words = spark.createDataFrame([(1, "注射", "注射", "p", None), (2, "注意", "注意", "p", None), (3, "注", "注", "p", None), (4, "射", "射", "p", None), (5, "意", "意", "p", None), (6, "X射", "X射", "p", None)], HEAD)
    forms = spark.createDataFrame([(1, "nan", None, "chù-siā", None, "s"), (2, "nan", None, "chù-ì", None, "s"), (5, "nan", None, "ì", None, "s"), (6, "nan", None, "a/b-c", None, "s")], FORMS)
    assert rows(D.derive_from_compounds(words, forms).select("headword_id", "pronunciation")) == [(3, "chù"), (4, "siā")]
    assert rows(D.derive_from_compounds(words, forms, least=2).select("headword_id")) == [(3,)]
    assert rows(D.derive_from_compounds(words, forms, limit=1).select("headword_id")) == [(3,)]
