import pytest
from pyspark.sql import functions as F

from quern.operators import corpus as C
from quern.operators import report as R
from quern.operators import search as S
from tests.conftest import rows

ARTICLES = [
    ("wiki", "银行", "银行", "银行是金融机构。银行提供贷款。银行在城市里很常见。"),
    ("news", "n1", "新闻", "今天银行宣布降息。市场反应热烈！"),
    ("wiki", "选任", "选任", "选举与任命不同。选任官员是重要的事情。"),
    ("news", "n2", "空", None),
    ("chid_test", "c1", None, "他画蛇#idiom000#添足了。这样不好吗？"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    articles = spark.createDataFrame(ARTICLES, "source string, source_article_id string, title string, text string")
    return C.number_chunks(C.chunk_articles(C.rename_sources(C.clean_articles(articles)))).persist()


def test_ingest(chunks):
    assert rows(C.source_counts(chunks)) == [("chid", 1, 2), ("news", 1, 2), ("wiki", 2, 5)]
    assert chunks.where("text like '%画蛇添足%'").count() == 1
    assert C.corpus_stats(chunks).where("source is null").first()["chunk_count"] == 9


def test_phrase_is_adjacency(chunks):
    assert S.phrase_hits(chunks, "选任").count() == 1
    assert S.all_character_hits(chunks, "选任").count() == 2
    assert S.count_hits(chunks, "银行", 3).first()["hits"] == 3
    assert rows(S.count_by_source(S.phrase_hits(chunks, "银行"), 2)) == [("news", 1), ("wiki", 2)]


def test_search_spreads_over_sources(chunks):
    found = S.search(chunks, "银行", 2).collect()
    assert {r["source"] for r in found} == {"wiki", "news"} and all("银行" in r["text"] and r["rank"] == 0.0 for r in found)
    assert S.search(chunks, "没有", 5).count() == 0 and S.search(chunks, "", 5).count() == 0
    assert "WindowGroupLimit" in S.sample_per_source(chunks, 2)._jdf.queryExecution().toString()


def test_context(chunks):
    hits = S.phrase_hits(chunks, "提供")
    r = S.context(chunks, hits, 1, 1).first()
    assert r["context"].split("\n") == ["银行是金融机构。", "银行提供贷款。", "银行在城市里很常见。"] and r["hit_index"] == 1 and r["chunk_count"] == 3
    r = S.context(chunks, hits, 0, 0).first()
    assert r["context"] == r["hit_text"] and r["chunk_count"] == 1


def test_examples_and_samples(chunks):
    assert [r["text"] for r in S.example_sentences(chunks, "银行", 2).collect()] == ["银行在城市里很常见。"]
    assert [r["source"] for r in S.sample_sentences(chunks, "银行", 3).collect()] == ["news", "wiki"]
    assert S.passages(S.search(chunks, "没有"), 3).first()["passages"].startswith("(No")
    assert S.passages(S.search(chunks, "银行"), 2).first()["passages"].startswith("1. [")


def test_index(chunks):
    index = C.postings(chunks)
    vocab = C.vocabulary(index)
    assert C.doc_count(vocab, "银") == 4 and C.doc_count(vocab, "龘") == 0
    ranked = C.bm25(index, ["银", "行"], limit=2).collect()
    assert ranked[0]["score"] >= ranked[1]["score"]


def test_report(spark, chunks):
    cedict = spark.createDataFrame([("銀行", "银行", "yin2 hang2", "bank")], "traditional string, simplified string, pinyin string, definition string")
    d = R.report_dict(R.word_report(chunks, cedict, "银行", 10, 2, 2))
    assert d["total_hits"] == 4 and [s["name"] for s in d["sources"]] == ["wiki", "news"] and len(d["sources"][0]["best_snippets"]) == 2
    assert d["cedict_entries"][0]["definition"] == "bank" and d["best_snippets"][0]["context"].count("\n") >= 1
    empty = R.report_dict(R.word_report(chunks, cedict, "龘", 10, 2, 0))
    assert empty["total_hits"] == 0 and empty["sources"] == [] and empty["best_snippets"] == []
    words = spark.createDataFrame([(1, "銀行", "银行", "yin2 hang2", "noun")], "id long, traditional string, simplified string, pinyin string, pos string")
    defs = spark.createDataFrame([(1, 1, "en", "bank/CL:家", "cedict"), (2, 1, "de", "Bank", "handedict"), (3, 1, "en", "shore", "zz")], "id long, headword_id long, lang string, definition string, source string")
    forms = spark.createDataFrame([(1, "yue", None, "ngan4 hong4", None, "x")], "headword_id long, dialect string, native_chars string, pronunciation string, gloss string, source string")
    text = R.report_text(chunks, cedict, words, defs, forms, "银行", "full")
    assert "ngan4 hong4" in text and "## Context" in text and "- wiki: 3" in text
    assert "## Context" not in R.report_text(chunks, cedict, words, defs, forms, "银行", "brief")
    assert rows(R.definitions_of(words, defs, "银行").select("lang", "source")) == [("de", "handedict"), ("en", "cedict"), ("en", "zz")]
    from quern.operators.lexicon import priority

    told = R.format_etymology(R.etymology(words, defs, forms, priority(), "银行"), "银行", others=True)
    assert told.splitlines() == ["銀行 / 银行 [yin2 hang2]", "  en: bank", "  yue: ngan4 hong4", "  de: Bank"]
    assert R.format_etymology(R.etymology(words, defs, forms, priority(), "x"), "x") == "x: not found"
    assert R.lookup_word(words, defs, "银行").first()["definitions"][0]["lang"] == "de"
    assert R.reference_data(chunks, words, defs, forms, "银行").first()["corpus_hits"] == 4
    assert R.prompts(chunks, "r", "银行").first()["mcp_context_chars"] == 1
    assert rows(R.dictionary_stats(words, defs, forms))[0] == ("lang", "de", 1)


def test_lookup_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "w")
    spark.createDataFrame([("a", "b")], "traditional string, simplified string").write.parquet(path)
    plan = R.lookup_entries(spark.read.parquet(path), "a")._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(EqualTo(simplified,a),EqualTo(traditional,a))]" in plan


def test_conflicting_articles(spark):
    rows_in = spark.createDataFrame([("s", "1", 0, "a", 1), ("s", "1", 0, "b", 2), ("s", "1", 1, "tail", 2)], "source string, source_article_id string, chunk_index int, text string, arrival int")
    assert rows(C.merge_chunks(rows_in)) == [("s", "1", 0, "a"), ("s", "1", 1, "tail")]
    arts = spark.createDataFrame([("s", "1", "t1", "x", 2), ("s", "1", "t0", "y", 1)], "source string, source_article_id string, title string, text string, arrival int")
    assert rows(C.first_articles(arts)) == [("s", "1", "t0", "y", 1)]


def test_group_lines(spark):
    df = spark.createDataFrame([(i, f"l{i}") for i in range(7)], "line_no int, text string")
    assert rows(C.group_lines(df, 5)) == [(0, "l0\nl1\nl2\nl3\nl4", "l0"), (1, "l5\nl6", "l5")]
    assert rows(C.full_article(df.select(F.lit("s").alias("source"), F.lit("a").alias("source_article_id"), F.col("line_no").alias("chunk_index"), "text").where("line_no < 2"))) == [("s", "a", "l0\nl1")]


def test_many_terms_like_few(chunks, monkeypatch):
    terms = ["银行", "选任", "是", "", "没有", "大家", "BANK x"]
    few = rows(S.count_terms_by_source(chunks, terms))
    monkeypatch.setattr(S, "MANY_TERMS", 1)
    assert few == rows(S.count_terms_by_source(chunks, terms)) and ("银行", "wiki", 3) in few
    assert S.term_hits(chunks, [""]).count() == 0
