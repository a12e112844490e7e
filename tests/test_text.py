import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import answers as A
from quern.functions import scripts as G
from quern.functions import text as X
from quern.functions.pinyin import to_numbered, tone_marked_to_numbered


def one(spark, column, *values, names="a b c d"):
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names.split()[: len(values)])) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def plain_chunks(text, least, ends):
    """The chunk rules restated: pieces end at an end mark, short ones go before the next, a short rest to the last."""
    parts = [p.strip() for p in re.findall(f"[^{ends}]*[{ends}]|[^{ends}]+", text.strip())]
    out, rest = [], ""
    for p in filter(None, parts):
        rest += p
        if len(rest) >= least:
            out.append(rest)
            rest = ""
    if rest:
        out = [*out[:-1], out[-1] + rest] if out else [rest]
    return out


@pytest.mark.parametrize(
    "text, least, want",
    [
        ("第一句话。第二句话。第三句话。", 4, ["第一句话。", "第二句话。", "第三句话。"]),
        ("嗯。这是一个完整的句子。", 5, ["嗯。这是一个完整的句子。"]),
        ("这是一个完整的句子。嗯", 4, ["这是一个完整的句子。嗯"]),
        ("　 好。。", 4, ["好。。"]),
        ("   ", 4, []),
        ("没有标点", 4, ["没有标点"]),
    ],
)
def test_chunks_golden(spark, text, least, want):
    assert one(spark, X.chunks(F.col("a"), least), text) == want


def test_chunks_match_plain_rules(spark):
    import random

    random.seed(3)
    texts = ["".join(random.choice("甲乙𰵝丙 。！？；\n　") for _ in range(random.randint(0, 40))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "a string").select("a", X.chunks(F.col("a")).alias("x"))
    for a, x in df.collect():
        assert x == plain_chunks(a, 4, "。！？；"), a
        assert "".join(x).replace(" ", "").replace("\n", "").replace("　", "") == a.replace(" ", "").replace("\n", "").replace("　", "")


def test_tokens_and_phrases(spark):
    assert one(spark, X.tokens(F.col("a")), "我爱NLP 2024, ok!") == ["我", "爱", "nlp", "2024", "ok"]
    assert one(spark, X.phrase(F.col("a"), "学而"), "学而时习之") is True
    assert one(spark, X.phrase(F.col("a"), "学时"), "学而时习之") is False
    assert one(spark, X.phrase(F.col("a"), "of the"), "Out OF The way") is True
    assert one(spark, X.phrase(F.col("a"), "of the"), "of then") is False
    assert one(spark, X.every_character(F.col("a"), "学时"), "学而时习之") is True
    assert X.phrase_query('选"任') == '"选 "" 任"'
    assert one(spark, X.highlight(F.col("a"), "任"), "选任x") == "选[任]x"


@pytest.mark.parametrize("text, want", [("lu:4", "lv4"), ("nü3", "nv3"), ("Zhong1 Guo2", "Zhong1 Guo2"), (" zhong1  guo2 ", "zhong1 guo2")])
def test_normalize_pinyin(spark, text, want):
    assert one(spark, X.normalize_pinyin(F.col("a")), text) == want


@pytest.mark.parametrize("text, want", [("nǐ hǎo", "ni3 hao3"), ("diànnǎo", "dian4 nao3"), ("zhōngguó", "zhong1 guo2"), ("ma", "ma5"), ("Běi jīng", "Bei3 jing1"), ("", ""), ("123", "123"), ("xī'ān", "xi1 an1")])
def test_tones(spark, text, want):
    assert to_numbered(text) == want
    assert one(spark, tone_marked_to_numbered("a"), text) == want


@pytest.mark.parametrize("text, want", [("to walk/to go", "verb"), ("bank/CL:家[jia1]", "noun"), ("(particle) x", "particle"), ("(classifier for x)", "classifier"), ("(a phrase)", "phrase"), ("hello", None), ("", None), ("to lend/CL:x", "noun")])
def test_pos(spark, text, want):
    assert one(spark, X.pos_from_definition(F.col("a")), text) == want


def test_other_fields(spark):
    assert one(spark, X.pos_from_entry(F.col("a")), "to lend/CL:x") == "verb"
    assert one(spark, X.strip_toneless_suffix(F.col("a")), "de (de¹)5") == "de"
    assert one(spark, X.compare_pinyin(F.col("a")), "a2i") == "ai2"
    assert one(spark, X.map_pos(F.col("a")), "adverb (fukushi)") == "verb"
    assert one(spark, X.map_pos(F.col("a")), "pronoun") == "noun"
    assert one(spark, X.map_pos(F.col("a")), "i adj x") == "adj"
    assert one(spark, X.merge_pos(F.col("a"), F.col("b")), "", "verb") == "verb"
    assert one(spark, X.scope(F.col("a"), F.col("b")), "He2", "surname He") == "narrow_name"
    assert one(spark, X.has_odd_character(F.col("a")), "\U00030001") is True
    assert one(spark, X.clean_idiom_markers(F.col("a")), "一#idiom12#二") == "一二"
    assert one(spark, X.blank(F.col("a")), "　\xa0") is True
    assert one(spark, X.clean_definition(F.col("a")), "/bank/CL:家[jia1]//x/") == "bank/x"
    assert one(spark, X.is_gloss_format(F.col("a")), "a b/c; d") is True
    assert one(spark, X.is_gloss_format(F.col("a")), "This is a sentence.") is False


def test_glosses(spark):
    assert one(spark, X.split_glosses(F.col("a")), "/bank; shore/CL:家/(Eig, Geo)/x/") == ["bank", "shore", "x"]
    assert one(spark, X.normalize_gloss(F.col("a"), F.lit("en")), "To  lend (money) out") == "lend out"
    assert one(spark, X.normalize_gloss(F.col("a"), F.lit("ru")), "To lend") == "to lend"
    got = one(spark, X.gloss_overlap(F.array(F.lit("to bank"), F.lit("river shore")), F.array(F.lit("bank"), F.lit("moon")), F.lit("en")))
    assert (got["matched_ref"], got["total_ref"], got["matched_llm"], got["total_llm"]) == (1, 2, 1, 2)
    assert one(spark, X.gloss_overlap(F.array().cast("array<string>"), F.array(F.lit("a")), F.lit("en")))["sense_coverage"] == 1.0


def test_answers_text(spark):
    assert one(spark, X.strip_thinking(F.col("a")), "<think>deep</think>short") == "deep"
    assert one(spark, X.strip_thinking(F.col("a")), "<think>deep</think>" + "long " * 20) == ("long " * 20).strip()
    assert one(spark, X.clean_answer(F.col("a")), ' 3. "/bank/"') == "bank"
    assert [one(spark, X.clean_answer(F.col("a")), x) for x in ("'tis", 'say "hi"', "/a/b/", '"a" or "b"')] == ["'tis", 'say "hi"', "a/b", 'a" or "b']
    assert one(spark, X.extract_pinyin(F.col("a")), "爱 (ai2) x") == "ai2"
    assert one(spark, X.extract_pinyin(F.col("a")), "Pinyin: cè shì here") == "ce4 shi4 here"
    assert one(spark, X.extract_definitions(F.col("a")), "1. To love\n- x\nMeaning: Affection") == ["to love", "affection"]
    assert one(spark, X.judge_scores(F.col("a")), "4, 5 and 3") == [4, 5, 3]
    assert one(spark, X.answer_issues(F.lit("de"), F.col("a")), "银行") == ["CJK_LEAK"]
    assert one(spark, X.answer_issues(F.lit("ko"), F.col("a")), "은행ж") == ["NON_HANGUL:ж"]
    assert one(spark, X.answer_issues(F.lit("ja"), F.col("a")), "銀行") == ["POSSIBLE_ECHO"]


@pytest.mark.parametrize(
    "lang, text, want",
    [
        ("en", "bank", []), ("en", "жизнь", ["cyrillic"]), ("en", "variant of 迥", []), ("en", "money 银行 house", ["cjk"]), ("ar", "وزن kg", []), ("ar", "كلمة money house", ["latin"]),
        ("ar", "NATO x", []), ("fa", "Panthera leo", []), ("xx", "银行", []), ("ko", "은행", []), ("de", "", []), ("hu", "埋 régi formája", []), ("ja", "銀行/きん", []),
    ],
)
def test_validate(spark, lang, text, want):
    assert one(spark, G.validate(F.col("a"), F.col("b")), lang, text) == want


def test_old_ranges_flag_blanks(spark):
    assert one(spark, G.invalid_scripts(F.lit("ar"), F.col("a"), G.OLD_SCRIPTS), "كلمة كلمة") == ["latin"]
    got = one(spark, G.validate_map(F.create_map(F.lit("en"), F.lit("ok"), F.lit("de"), F.lit("жж"))))
    assert got["clean"] == {"en": "ok"} and got["rejected"] == {"de": "жж"}


def test_answer_parsers(spark):
    assert A.parse_answer('en: "bank/x"\nde: /Bank/\nzz: no') == {"en": "bank/x", "de": "Bank"}
    assert A.parse_answer("en: bank/financial institution/de: Bank/Geldinstitut/fr: banque") == {"en": "bank/financial institution", "de": "Bank/Geldinstitut", "fr": "banque"}
    assert A.parse_batch("1.\nen: bank", 3) == [{"en": "bank"}, {}, {}]
    assert A.parse_batch("1.\n\n2.\nen: shore", 2) == [{"en": "shore"}, {}]
    assert A.parse_batch("1. en: a\nde: b\n2. en: c\n3. en: d", 2) == [{"en": "a", "de": "b"}, {"en": "c"}]
    assert A.parse_backfill("1.\n de: x\n en: y\n2.\n fr: z", [["de"], ["fr"]]) == [{"de": "x"}, {"fr": "z"}]
    assert A.parse_backfill("de: x\n\nfr: z\n\nes: q", [["de"], ["fr"]]) == [{"de": "x"}, {"fr": "z"}]
    df = spark.createDataFrame([("1.\nen: bank", 2)], "a string, n int").select(A.parsed_batch("a", "n").alias("x"))
    assert df.first()["x"] == [{"en": "bank"}, {}]


def test_prompts(spark):
    defs = F.create_map(F.lit("en"), F.lit("bank"))
    got = one(spark, A.backfill_block(F.lit(2), F.lit("銀行"), F.lit("银行"), F.lit("yin2 hang2"), defs, F.array(F.lit("de"))))
    assert got.startswith("2. 銀行 / 银行") and "   en: bank" in got and got.endswith("   de:")
    assert "English: bank" in one(spark, A.entry_prompt(F.lit("a"), F.lit("b"), F.lit("c"), F.lit(""), defs, F.array(F.lit("de")), F.array(F.lit("ex"))))
    assert "English: bank" not in one(spark, A.verify_prompt(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("n"), F.lit("en"), F.lit("bank"), defs))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_to_numbered_never_fails(text):
    assert isinstance(to_numbered(text), str)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60), st.integers(0, 4))
def test_batch_parser_gives_count(text, n):
    assert len(A.parse_batch(text, n)) == n and len(A.parse_backfill(text, [["en"]] * n)) == n
