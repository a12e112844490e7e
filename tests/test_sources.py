import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.operators import lexicon as L
from quern.plans import jobs as J
from quern.sources import dictionaries as R
from quern.sources import texts as S
from tests.conftest import rows


def put(base, path, text, encoding="utf-8"):
    p = base / path
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(text.encode(encoding) if isinstance(text, str) else text)
    return str(p)


def test_classics(spark, tmp_path):
    put(tmp_path, "双语数据/论语/学而/source.txt", " 学而时习之。\n")
    put(tmp_path, "双语数据/论语/学而/target.txt", "x")
    put(tmp_path, "古文原文/论语/学而/text.txt", "重复")
    put(tmp_path, "古文原文/孟子/上 1/text.txt", "孟子见梁惠王。")
    assert rows(S.bilingual_classics(spark, str(tmp_path))) == [("论语/学而", "论语·学而", "学而时习之。")]
    assert rows(S.raw_classics(spark, str(tmp_path))) == [("孟子/上 1", "孟子·上 1", "孟子见梁惠王。")]


def test_poems_and_chapters(spark, tmp_path):
    put(tmp_path, "p/a.json", json.dumps([{"title": "静夜思", "author": "李白", "paragraphs": ["床前", "明月"]}, {"rhythmic": "如梦令", "author": "", "paragraphs": ["x"]}, {"title": "空", "paragraphs": []}]))
    put(tmp_path, "p/authors.json", json.dumps([{"name": "李白"}]))
    put(tmp_path, "p/bad.json", "{nope")
    assert rows(S.poems(spark, str(tmp_path / "p"), "tang")) == [("tang/如梦令/", "如梦令", "x"), ("tang/静夜思/李白", "静夜思（李白）", "床前\n明月")]
    put(tmp_path, "c/list.json", json.dumps([{"chapter": "大学", "paragraphs": ["a", "b"]}, {"content": ["c"]}]))
    put(tmp_path, "c/dict.json", json.dumps({"上": ["x", "y"], "下": "z", "坏": {"q": 1}}))
    assert rows(S.classic_json(spark, str(tmp_path / "c"), "sishu")) == [("sishu/list_1", "list_1", "c"), ("sishu/上", "上", "x\ny"), ("sishu/下", "下", "z"), ("sishu/大学", "大学", "a\nb")]


def test_json_lines(spark, tmp_path):
    put(tmp_path, "n/x.json", '{"news_id":"1","title":"t","content":"c"}\nbroken\n{"news_id":"2","title":"t","content":"  "}\n')
    assert rows(S.news_jsonl(spark, str(tmp_path / "n"))) == [("1", "t", "c")]
    put(tmp_path, "w/web_text_zh_train.json", '{"qid":7,"title":"q","content":"a"}\n{"qid":7,"title":"q","content":"b"}\n')
    put(tmp_path, "w/other.json", '{"qid":8,"title":"q","content":"z"}\n')
    assert rows(S.community_answers(spark, str(tmp_path / "w"))) == [("7", "q", "a"), ("7", "q", "b")]
    put(tmp_path, "b/baike_qa_train.json", '{"qid":"q1","title":"t","answer":"a"}\n')
    assert rows(S.encyclopedia_answers(spark, str(tmp_path / "b"))) == [("q1", "t", "a")]
    put(tmp_path, "l/d.json", json.dumps([["你 好", "好 的"], ["只有一句"], ["a", "b"]]))
    assert rows(S.dialogues(spark, str(tmp_path / "l"))) == [("0", "你好", "你好\n好的"), ("2", "a", "a\nb")]
    put(tmp_path, "k/train.json", '{"fact":"事实","meta":{"accusation":["盗窃","抢劫","a","b"]}}\n\n{"fact":"无罪名","meta":{}}\nbad\n')
    assert rows(S.court_cases(spark, str(tmp_path / "k"))) == [("train/0", "盗窃、抢劫、a", "事实"), ("train/2", "无罪名", "无罪名")]
    put(tmp_path, "t/v.json", '{"english":"hello","chinese":"你好"}\n{"english":"","chinese":"只有中文"}\n')
    assert rows(S.parallel_sentences(spark, str(tmp_path / "t"))) == [("v/0", "hello", "你好"), ("v/1", "只有中文", "只有中文")]
    assert rows(S.id_list(spark, put(tmp_path, "ids.json", "[3, 5]"))) == [(3,), (5,)]
    assert S.json_rows(spark, str(tmp_path / "none.json"), "a int").count() == 0


def test_tables_of_text(spark, tmp_path):
    put(tmp_path, "c.tsv", 't1\tabs "x"\tk_1\tphys\nonlyone\nt2\tabs2\n')
    assert rows(S.abstracts(spark, str(tmp_path))) == [("0", "t1", 'abs "x"\n关键词：k、1'), ("2", "t2", "abs2")]
    put(tmp_path, "laws/宪法.md", "  " + "第一条" * 10)
    put(tmp_path, "laws/README.md", "x" * 50)
    put(tmp_path, "laws/short.md", "短")
    assert rows(S.laws(spark, str(tmp_path / "laws"))) == [("宪法.md", "宪法", "第一条" * 10)]
    for name, head, line in (("question", "question_id,content", '1,"头痛, 怎么办"'), ("answer", "ans_id,question_id,content", "9,1,多喝水")):
        (tmp_path / "q").mkdir(exist_ok=True)
        with zipfile.ZipFile(tmp_path / "q" / f"{name}.zip", "w") as z:
            z.writestr(f"{name}.csv", f"{head}\n{line}\n")
    assert rows(S.medical_questions(spark, str(tmp_path / "q"))) == [("a/9", "答：多喝水", "多喝水"), ("q/1", "问：头痛, 怎么办", "头痛, 怎么办")]
    put(tmp_path, "m/IM_内科/n.csv", "department,title,ask,answer\n心血管科,高血压,头晕,吃药\n心血管科,,,多休息\n", "gbk")
    got = rows(S.medical_dialogues(spark, str(tmp_path / "m")).select("title", "text"))
    assert got == [("内科问答", "答：多休息"), ("高血压", "问：头晕\n答：吃药")]
    put(tmp_path, "s/f.txt", "\n".join(["一", "", "二", "三", " ", "四", "五", "六"]))
    assert rows(S.subtitles(spark, str(tmp_path / "s"))) == [("f/0", "一", "一\n二\n三\n四\n五"), ("f/1", "六", "六")]


def test_table_articles(spark):
    t = spark.createDataFrame([("chid_train", 1, None, "一#idiom1#二"), ("wiki", 2, "t", None), ("wiki", 3, "t", "x")], "source string, source_id long, title string, text string")
    assert rows(S.table_articles(t, "chid_train")) == [("1", "", "一二")]
    assert rows(S.table_articles(t, "wiki")) == [("3", "t", "x")]
    n = spark.createDataFrame([(0, "a", "b"), (1, "c", " ")], "idx int, title string, content string")
    assert rows(S.labelled_news(n)) == [("0", "a", "b")]


CEDICT = "# c\n% d\n\n銀行 银行 [yin2 hang2] /bank/CL:家[jia1]/\n一 [yi1] /one/\n空 空 [kong1] //\nbroken line\n"


def test_cedict(spark, tmp_path):
    path = put(tmp_path, "c.u8", CEDICT)
    assert rows(R.read_cedict(spark, path).drop("line_no")) == [("一", "一", "yi1", "one"), ("空", "空", "kong1", ""), ("銀行", "银行", "yin2 hang2", "bank/CL:家[jia1]")]
    gz = put(tmp_path, "d.gz", gzip.compress(CEDICT.encode()))
    assert rows(R.read_dictionary(spark, gz).drop("line_no")) == [("一", "一", "yi1", "one", None), ("銀行", "银行", "yin2 hang2", "bank/CL:家[jia1]", "noun")]


def test_wiktextract(spark, tmp_path):
    ok = {
        "word": "電腦", "lang_code": "zh", "pos": "noun", "forms": [{"form": "旧", "tags": ["Simplified-Chinese", "Second-Round-Simplified-Chinese"]}, {"form": "电脑", "tags": ["Simplified-Chinese"]}],
        "sounds": [{"zh_pron": "x", "tags": ["Min-Nan", "POJ"]}, {"zh_pron": "diànnǎo", "tags": ["Mandarin", "Pinyin"]}],
        "senses": [{"glosses": ["machine", "computer"]}, {"glosses": ["computer"]}, {"glosses": ["gone"], "form_of": [{"word": "y"}]}],
        "translations": [{"lang_code": "fr", "word": "ordinateur"}, {"lang_code": "fr", "word": "ordinateur"}, {"lang_code": "zz", "word": "q"}],
    }
    lines = [ok, {**ok, "sounds": []}, {**ok, "senses": []}, {**ok, "lang_code": "ja"}]
    path = put(tmp_path, "w.jsonl", "\n".join(map(json.dumps, lines)) + "\nbroken\n")
    entries = R.read_wiktextract(spark, path)
    assert rows(entries) == [("電腦", "电脑", "dian4 nao3", "noun", ["computer"], {"fr": ["ordinateur"]})]
    assert rows(J.wiktextract_imports(entries).select("lang", "definition")) == [("en", "computer"), ("fr", "ordinateur")]
    sounds = R.hokkien_sounds(spark.read.schema(R.WIKT_SCHEMA).option("mode", "DROPMALFORMED").json(path))
    assert sounds.where("word = '電腦' and pronunciation = 'x'").count() == 3


JM = """<?xml version="1.0"?>
<!DOCTYPE JMdict [
<!ENTITY n "noun (common) (futsuumeishi)">
]>
<JMdict>
<entry><ent_seq>1</ent_seq><k_ele><keb>銀行</keb></k_ele><k_ele><keb>お銀</keb></k_ele><r_ele><reb>ぎんこう</reb></r_ele><sense><pos>&n;</pos><gloss>bank</gloss><gloss xml:lang="ger">Bank</gloss></sense></entry>
<entry><ent_seq>2</ent_seq><k_ele><keb>東</keb></k_ele><r_ele><reb>ひがし</reb></r_ele><sense><gloss xml:lang="ger">Osten</gloss></sense></entry>
<entry><ent_seq>3</ent_seq><r_ele><reb>かな</reb></r_ele><sense><gloss>kana</gloss></sense></entry>
</JMdict>"""


@pytest.mark.parametrize("packed", [False, True])
def test_jmdict(spark, tmp_path, packed):
    path = put(tmp_path, "j.xml.gz" if packed else "j.xml", gzip.compress(JM.encode()) if packed else JM)
    entries = R.read_jmdict(spark, path)
    assert rows(entries) == [("銀行", "ぎんこう", "noun", ["bank"], "ぎんこう")]
    words = spark.createDataFrame([(5, "銀行", "银行", "yin2 hang2", None)], "id long, traditional string, simplified string, pinyin string, pos string")
    assert rows(J.jmdict_imports(entries, words)) == [("銀行", "银行", "yin2 hang2", "noun", "ja", "ぎんこう", "jmdict")]
    assert rows(J.jmdict_imports(entries, words.where("id < 0")))[0][:3] == ("銀行", "銀行", "ぎんこう")


@pytest.fixture
def words(spark):
    return spark.createDataFrame([(1, "銀行", "银行", "yin2 hang2", None), (2, "女", "女", "nv3", None)], "id long, traditional string, simplified string, pinyin string, pos string")


def test_readings(spark, tmp_path, words):
    path = put(tmp_path, "canto.txt", "# x\n銀行 银行 [yin2 hang2] {ngan4 hong4} /bank/ bench /\n女 女 [nv3] /no reading/\n新 新 [xin1] {san1}\n")
    got = R.readings(R.numbered_lines(spark, path))
    assert rows(got.drop("line_no")) == [("新", "新", "xin1", "san1", []), ("銀行", "银行", "yin2 hang2", "ngan4 hong4", ["bank", "bench"])]
    w, forms = J.cantonese_imports(got, words)
    assert w.count() == 3 and rows(forms.select("pronunciation", "gloss")) == [("ngan4 hong4", "bank/bench"), ("san1", None)]
    assert rows(J.reading_overlay(R.readings(R.numbered_lines(spark, path), False), words).select("headword_id", "pronunciation")) == [(1, "ngan4 hong4")]


def test_dialect_tables(spark, tmp_path, words):
    path = put(tmp_path, "h.csv", "﻿DictWordID,PojUnicode,KipUnicode,HanLoTaibunPoj,HoaBun\n1,gîn-hâng,x,銀行,銀行\n2,,lú,查某,女\n3,a,b,c,\n4,,,d,女\n")
    got = R.hokkien_csv(spark, path)
    assert rows(got.drop("line_no")) == [("女", "查某", "lú", None), ("銀行", None, "gîn-hâng", None)]
    assert rows(R.hokkien_csv(spark, path, fallback=False).select("word")) == [("銀行",)]
    from quern.operators import dialects as D

    assert rows(D.forms_by_word(got, words, "nan", "itaigi").select("headword_id", "native_chars")) == [(1, None), (2, "查某")]
    rime = R.rime_lines(spark, str(tmp_path)) if put(tmp_path, "r.dict.yaml", "name: x\n...\n女\tneoi5\t10\n女\tjyu5\t1\n銀行\tngan4 hong4\n銀行\tngan4 hong2\n") else None
    assert rows(J.single_character_forms(rime, words, "yue", "rime").select("headword_id", "pronunciation")) == [(2, "neoi5")]
    assert rows(J.word_forms(rime, words, "yue", "rime").select("headword_id", "pronunciation")) == [(1, "ngan4 hong2")]
    with zipfile.ZipFile(tmp_path / "u.zip", "w") as z:
        z.writestr("Unihan_Readings.txt", "# x\nU+5973\tkCantonese\tneoi5 jyu5\nU+5973\tkMandarin\tnǚ\nU+20000\tkCantonese\tjaa1\n")
    assert rows(R.unihan(spark, str(tmp_path / "u.zip")).select("word", "pronunciation")) == [("女", "neoi5"), ("\U00020000", "jaa1")]
    wh = R.wikihan(spark, put(tmp_path, "w.tsv", "Character\tHokkien\tCantonese\n女\tlú/lír\t-\n銀行\ta\tb\n"))
    assert rows(wh.select("word", "dialect", "pronunciation")) == [("女", "nan", "lú")]
    assert rows(J.forms_by_dialect(wh, words, "wikihan").select("headword_id", "dialect", "source")) == [(2, "nan", "wikihan")]
    hou = R.sinitic_words(spark, put(tmp_path, "o.tsv", "DOCULECT\tCHARACTERS\tVALUE\nXiamen\t女\tlu\nFuzhou\t女\tny\nGuangzhou\t女\tnoey\nXiamen\ta\tb\n"))
    assert rows(J.forms_by_dialect(hou, words, "hou2004", "place").select("dialect", "pronunciation", "source")) == [("nan", "lu", "hou2004-xiamen"), ("yue", "noey", "hou2004-guangzhou")]


def test_jobs(spark, tmp_path):
    put(tmp_path, "news2016zh/x.json", '{"news_id":"1","title":"t","content":"第一句话。第二句话。"}\n')
    put(tmp_path, "webtext2019zh/web_text_zh_a.json", '{"qid":1,"title":"q","content":"回答一二三。"}\n{"qid":1,"title":"q","content":"别的回答。还有一句。"}\n')
    articles = J.collect_articles(spark, str(tmp_path), ["news2016zh", "webtext2019zh"])
    counts = J.build_corpus(articles, str(tmp_path / "out"))
    assert rows(counts) == [("news2016zh", 1, 2), ("webtext2019zh", 1, 2)]
    c = spark.read.parquet(str(tmp_path / "out")).where("source = 'webtext2019zh'")
    assert rows(c.select("chunk_index", "text")) == [(0, "回答一二三。"), (1, "还有一句。")]
    put(tmp_path, "a.u8", CEDICT)
    put(tmp_path, "b.u8", "銀行 银行 [yin2 hang2] /Bank/\n")
    imports = J.cedict_imports(spark, {"cedict": ("en", str(tmp_path / "a.u8")), "handedict": ("de", str(tmp_path / "b.u8"))})
    w, d = J.assemble(imports)
    assert w.count() == 2 and rows(L.coverage(d, 2).select("lang", "percent")) == [("de", 50.0), ("en", 100.0)]
    none = spark.createDataFrame([], "headword_id long, dialect string, native_chars string, pronunciation string, gloss string, source string")
    w2, d2, _ = J.merge(w, d, none)
    assert w2.where(F.col("pos") == "noun").count() == 1 and d2.count() == 3


def test_timed(spark):
    found, _ = J.timed(spark.range(3), 30)
    assert len(found) == 3
    slow = spark.range(0, 4, 1, 4).mapInPandas(_sleep, "id long")
    found, took = J.timed(slow, 1.0)
    assert found is None and took < 15


def _sleep(parts):
    import time

    time.sleep(20)
    yield from parts


def test_lines_are_numbered_over_splits(spark, tmp_path, monkeypatch):
    from quern.sources import texts as T

    folder = tmp_path / "lines"
    (folder / "a b").mkdir(parents=True)
    lines = {"one.txt": [f"line {i} " + "x" * (i % 90) for i in range(4000)], "a b/two+é.txt": ["", "only", "", "last"], "empty.txt": []}
    for name, found in lines.items():
        (folder / name).write_text("".join(x + ("\r\n" if i % 7 == 0 else "\n") for i, x in enumerate(found)), newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
        for most in (200_000, 3):
            monkeypatch.setattr(T, "MOST_SPLITS", most)
            found = T._lines(spark, str(folder), "*.txt")
            assert found.rdd.getNumPartitions() > 1
            got = {(r["path"], r["line_no"]): r["value"] for r in found.collect()}
            assert got == {(n, i): x for n, found in lines.items() for i, x in enumerate(found)}
        kept = T._lines(spark, str(folder), "*.txt", F.col("value") != "").where("path like 'a b%'").collect()
        assert sorted((r["line_no"], r["value"]) for r in kept) == [(0, "only"), (1, "last")]
        groups = {r["source_article_id"]: r["text"] for r in T.subtitles(spark, str(folder), 1000).collect()}
        assert sorted(groups) == ["one/0", "one/1", "one/2", "one/3", "two+é/0"] and groups["one/3"].split("\n")[-1] == lines["one.txt"][-1]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_one_ordered_file_is_sorted_over_many_tasks(spark):
    from quern.sources.scratch import Scratch

    scratch = Scratch(spark)
    rows = scratch.in_order(spark.range(5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("k")), "k")
    assert "Sort" not in rows._jdf.queryExecution().executedPlan().toString() and rows.rdd.getNumPartitions() == 1
    found = spark.read.text(scratch.lines(rows, F.col("k").cast("string"), "ordered")).coalesce(1)
    assert [int(r["value"]) for r in found.collect()] == list(range(5000))
