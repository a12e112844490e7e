"""Queries that write files of the readers' formats from the test tables and read them back, and queries of dictionary
writes, reports, groupings and scores, with SQL that gives the same rows from the tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import scripts as G
from quern.functions import text as X
from quern.functions.pinyin import tone_marked_to_numbered
from quern.operators import corpus as C
from quern.operators import dialects as D
from quern.operators import evaluation as E
from quern.operators import lexicon as L
from quern.operators import report as R
from quern.operators import search as S
from quern.operators import translate as U
from quern.plans import jobs as J
from quern.plans import parts as P
from quern.queries import _chunks, _dictionary, _table, query
from quern.sources import dictionaries as Y
from quern.sources import texts as T
from quern.sources.scratch import Scratch

ARTICLE = "source_article_id, title, text"
TEXT = r"regexp_matches(coalesce(text, ''), '\S')"


def _json(*columns):
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


# -- text collections


@query(f"SELECT doc_id::VARCHAR AS source_article_id, source AS title, text FROM documents WHERE source = 'src1' AND {TEXT}")
def read_table_articles(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("source_id"), F.col("source").alias("title"), "text")
    return T.table_articles(docs, "src1")


@query(f"SELECT doc_id::VARCHAR AS source_article_id, source AS title, text FROM documents WHERE {TEXT}")
def read_news(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    line = _json(F.col("doc_id").cast("string").alias("news_id"), F.col("source").alias("title"), F.col("text").alias("content"))
    return T.news_jsonl(spark, Scratch(spark).lines(docs, line, "news", suffix=".json"))


@query(f"SELECT doc_id::VARCHAR AS source_article_id, source AS title, text FROM documents WHERE {TEXT}")
def read_community_answers(spark, sf_dir):
    docs, files = _table(spark, sf_dir, "documents"), Scratch(spark)
    line = _json(F.col("doc_id").alias("qid"), F.col("source").alias("title"), F.col("text").alias("content"))
    files.lines(docs.limit(5), line, "web", "other", ".json")  # files of other names are not read
    return T.community_answers(spark, files.lines(docs, line, "web", "web_text_zh_", ".json"))


@query(f"SELECT doc_id::VARCHAR AS source_article_id, source AS title, text FROM documents WHERE {TEXT}")
def read_encyclopedia(spark, sf_dir):
    line = _json(F.col("doc_id").alias("qid"), F.col("source").alias("title"), F.col("text").alias("answer"))
    return T.encyclopedia_answers(spark, Scratch(spark).lines(_table(spark, sf_dir, "documents"), line, "qa", "baike_qa_", ".json"))


@query(f"SELECT doc_id::VARCHAR AS source_article_id, source AS title, text FROM documents WHERE {TEXT}")
def read_labelled_news(spark, sf_dir):
    return T.labelled_news(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.col("source").alias("title"), F.col("text").alias("content")))


@query(f"SELECT CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 50) ELSE source || '、' || lang END AS title, text FROM documents WHERE {TEXT}")
def read_court_cases(spark, sf_dir):
    named = F.when(F.col("doc_id") % 3 != 0, F.array("source", "lang"))
    line = _json(F.col("text").alias("fact"), F.struct(named.alias("accusation")).alias("meta"))
    return T.court_cases(spark, Scratch(spark).lines(_table(spark, sf_dir, "documents"), line, "cases", suffix=".json")).select("title", "text")


@query(f"SELECT CASE WHEN doc_id % 2 = 0 THEN source ELSE substr(text, 1, 50) END AS title, text FROM documents WHERE {TEXT}")
def read_parallel_sentences(spark, sf_dir):
    line = _json(F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("english"), F.col("text").alias("chinese"))
    return T.parallel_sentences(spark, Scratch(spark).lines(_table(spark, sf_dir, "documents"), line, "pairs", suffix=".json")).select("title", "text")


@query("SELECT p_name AS title, p_type || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || '关键词：' || p_brand || '、x' ELSE '' END AS text FROM part")
def read_abstracts(spark, sf_dir):
    line = F.concat_ws("\t", "p_name", "p_type", F.when(F.col("p_partkey") % 2 == 0, F.concat("p_brand", F.lit("_x"))))
    return T.abstracts(spark, Scratch(spark).lines(_table(spark, sf_dir, "part"), line, "csl", suffix=".tsv")).select("title", "text")


@query("SELECT 'f0/' || (n_nationkey // 5) AS source_article_id, arg_min(n_name, n_nationkey) AS title, string_agg(n_name, chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY n_nationkey // 5")
def read_subtitles(spark, sf_dir):
    rows = _table(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey")
    return T.subtitles(spark, Scratch(spark).lines(rows, F.concat("n_name", F.lit("\n ")), "subs", "f"))


@query("SELECT n // 5 AS group_no, string_agg(text, chr(10) ORDER BY n) AS text, substr(arg_min(text, n), 1, 50) AS title FROM (SELECT o_orderkey || ' ' || o_orderpriority AS text, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) GROUP BY n // 5")
def read_split_lines(spark, sf_dir):
    """Orders as the lines of one file, blank ones between, read in many splits and put into groups of five."""
    scratch = Scratch(spark)
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" ", "o_orderkey", "o_orderpriority").alias("line"))
    folder = scratch.lines(scratch.in_order(rows, "o_orderkey"), F.concat("line", F.lit("\n \r")), "orders", "f")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 10))
    try:
        found = Scratch(spark).table(T.subtitles(spark, folder), "groups")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return found.select(F.element_at(F.split("source_article_id", "/"), -1).cast("long").alias("group_no"), "text", "title")


def _whole(spark, rows: DataFrame, value, folder: str, suffix: str = ".json") -> str:
    """One file that holds one value of all rows of a table whose size is fixed."""
    return Scratch(spark).lines(rows.agg(value.alias("v")), F.col("v"), folder, "f", suffix)


@query("SELECT 'tang/' || n_name || '/' || CASE WHEN n_nationkey % 2 = 0 THEN 'A' ELSE '' END AS source_article_id, n_name || CASE WHEN n_nationkey % 2 = 0 THEN '（A）' ELSE '' END AS title, n_name || chr(10) || n_regionkey AS text FROM nation")
def read_poems(spark, sf_dir):
    poem = F.struct(F.col("n_name").alias("title"), F.when(F.col("n_nationkey") % 2 == 0, "A").otherwise("").alias("author"), F.array("n_name", F.col("n_regionkey").cast("string")).alias("paragraphs"))
    return T.poems(spark, _whole(spark, _table(spark, sf_dir, "nation"), F.to_json(F.collect_list(poem)), "poems"), "tang")


@query("SELECT 'c/' || n_name AS source_article_id, n_name AS title, n_name || chr(10) || 'x' AS text FROM nation")
def read_classic(spark, sf_dir):
    entry = F.struct(F.col("n_name").alias("key"), F.array("n_name", F.lit("x")).alias("value"))
    return T.classic_json(spark, _whole(spark, _table(spark, sf_dir, "nation"), F.to_json(F.map_from_entries(F.collect_list(entry))), "classic"), "c")


@query("SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::VARCHAR AS source_article_id, n_name AS title, n_name || chr(10) || 'ok' AS text FROM nation QUALIFY n_nationkey % 4 <> 0")
def read_dialogues(spark, sf_dir):
    turns = F.when(F.col("n_nationkey") % 4 == 0, F.array("n_name")).otherwise(F.array("n_name", F.lit("o k")))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", turns.alias("t")))), lambda x: x["t"])
    return T.dialogues(spark, _whole(spark, _table(spark, sf_dir, "nation"), F.to_json(listed), "talks"))


@query("SELECT 'f0.md' AS source_article_id, 'f0' AS title, string_agg(n_name, chr(10) ORDER BY n_nationkey) AS text FROM nation")
def read_laws(spark, sf_dir):
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), "\n")
    return T.laws(spark, _whole(spark, _table(spark, sf_dir, "nation"), names, "laws", ".md"))


@query("SELECT n_nationkey::BIGINT AS id FROM nation")
def read_id_list(spark, sf_dir):
    return T.id_list(spark, _whole(spark, _table(spark, sf_dir, "nation"), F.to_json(F.collect_list("n_nationkey")), "ids"))


@query("SELECT n_nationkey, n_name FROM nation")
def read_json_rows(spark, sf_dir):
    rows = F.to_json(F.collect_list(F.struct("n_nationkey", "n_name")))
    return T.json_rows(spark, _whole(spark, _table(spark, sf_dir, "nation"), rows, "rows"), "n_nationkey int, n_name string")


# -- dictionaries

ENTRY = "CASE p_partkey % 4 WHEN 0 THEN 'to ' || p_name WHEN 1 THEN p_name || '/CL:' || p_type WHEN 2 THEN '(' || p_type || ')' ELSE p_type END"


def _definition():
    k = F.col("p_partkey") % 4
    return F.when(k == 0, F.concat(F.lit("to "), "p_name")).when(k == 1, F.concat("p_name", F.lit("/CL:"), "p_type")).when(k == 2, F.concat(F.lit("("), "p_type", F.lit(")"))).otherwise(F.col("p_type"))


def _entries(spark, sf_dir, folder: str) -> str:
    """Parts as lines in CEDICT form, with comments between."""
    parts = _table(spark, sf_dir, "part")
    line = F.concat(F.lit("T"), "p_partkey", F.lit(" S"), "p_partkey", F.lit(" ["), "p_brand", F.lit("] /"), _definition(), F.lit("/"))
    return Scratch(spark).lines(parts, F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("# comment\n"), line)).otherwise(line), folder, suffix=".u8")


@query(f"SELECT 'T' || p_partkey AS traditional, 'S' || p_partkey AS simplified, p_brand AS pinyin, {ENTRY} AS definition FROM part")
def read_cedict_entries(spark, sf_dir):
    return Y.read_cedict(spark, _entries(spark, sf_dir, "cedict")).drop("line_no")


@query(f"SELECT 'T' || p_partkey AS traditional, 'S' || p_partkey AS simplified, p_brand AS pinyin, {ENTRY} AS definition, CASE p_partkey % 4 WHEN 0 THEN 'verb' WHEN 1 THEN 'noun' WHEN 2 THEN 'phrase' END AS pos FROM part")
def read_dictionary_entries(spark, sf_dir):
    return Y.read_dictionary(spark, _entries(spark, sf_dir, "dictionary")).drop("line_no")


@query(f"SELECT 'T' || p_partkey AS traditional, 'S' || p_partkey AS simplified, p_brand AS pinyin, CASE p_partkey % 4 WHEN 0 THEN 'verb' WHEN 1 THEN 'noun' WHEN 2 THEN 'phrase' END AS pos, 'de' AS lang, 'handedict' AS source, {ENTRY} AS definition FROM part")
def import_dictionary(spark, sf_dir):
    words, defs = J.assemble(J.cedict_imports(spark, {"handedict": ("de", _entries(spark, sf_dir, "imports"))}))
    return words.join(defs.withColumnRenamed("id", "def_id"), words["id"] == defs["headword_id"]).select(*L.KEY, "pos", "lang", "source", "definition")


@query("""SELECT p_name || p_partkey AS traditional, CASE WHEN p_partkey % 2 = 0 THEN 'S' || p_partkey ELSE p_name || p_partkey END AS simplified, CASE p_partkey % 3 WHEN 0 THEN 'yin2 hang2' WHEN 1 THEN 'lü3' ELSE 'ma5' END AS pinyin,
  CASE WHEN p_size % 2 = 0 THEN 'noun' END AS pos, p_type || '/' || p_brand AS en, p_brand AS fr FROM part WHERE p_partkey % 5 <> 0""")
def read_wiktextract_entries(spark, sf_dir):
    k = F.col("p_partkey")
    tags = lambda *x: F.array(*map(F.lit, x))
    sound = F.struct(F.element_at(F.array(F.lit("yín háng"), F.lit("lǚ"), F.lit("ma")), (k % 3 + 1).cast("int")).alias("zh_pron"), tags("Mandarin", "Pinyin").alias("tags"))
    sounds = F.when(k % 5 == 0, F.array().cast("array<struct<zh_pron:string,tags:array<string>>>")).otherwise(F.array(sound))
    forms = F.when(k % 2 == 0, F.array(F.struct(F.concat(F.lit("S"), k).alias("form"), tags("Simplified-Chinese").alias("tags"))))
    senses = F.array(F.struct(F.array(F.lit("up"), F.col("p_type")).alias("glosses")), F.struct(F.array("p_brand").alias("glosses")))
    words = F.array(F.struct(F.lit("fr").alias("lang_code"), F.col("p_brand").alias("word")), F.struct(F.lit("xx").alias("lang_code"), F.lit("no").alias("word")))
    line = F.to_json(F.struct(F.concat("p_name", k).alias("word"), F.lit("zh").alias("lang_code"), F.when(F.col("p_size") % 2 == 0, "noun").otherwise("other").alias("pos"), forms.alias("forms"), sounds.alias("sounds"), senses.alias("senses"), words.alias("translations")))
    found = Y.read_wiktextract(spark, Scratch(spark).lines(_table(spark, sf_dir, "part"), line, "wikt", suffix=".jsonl"))
    return found.select("traditional", "simplified", "pinyin", "pos", F.array_join("glosses_en", "/").alias("en"), F.array_join(F.col("translations")["fr"], "/").alias("fr"))


def _readings(spark, sf_dir) -> DataFrame:
    """Suppliers as lines with Cantonese readings; every third has none."""
    jyutping = F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit(" {jyut"), "s_nationkey", F.lit("}")))
    line = F.concat("s_name", F.lit(" "), F.lower("s_name"), F.lit(" [p"), "s_suppkey", F.lit("]"), jyutping, F.lit(" /a/b"), "s_suppkey", F.lit("/"))
    return Y.readings(Y.numbered_lines(spark, Scratch(spark).lines(_table(spark, sf_dir, "supplier"), line, "readings")))


def _suppliers(spark, sf_dir) -> DataFrame:
    """Headwords of the first half of the suppliers' readings, by number."""
    rows = _table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0")
    return rows.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("traditional"), F.lower("s_name").alias("simplified"), F.concat(F.lit("p"), "s_suppkey").alias("pinyin"), F.lit(None).cast("string").alias("pos"))


@query("SELECT s_name AS traditional, lower(s_name) AS simplified, 'p' || s_suppkey AS pinyin, 'jyut' || s_nationkey AS jyutping, 'a,b' || s_suppkey AS definitions FROM supplier WHERE s_suppkey % 3 <> 0")
def read_readings(spark, sf_dir):
    return _readings(spark, sf_dir).select("traditional", "simplified", "pinyin", "jyutping", F.array_join("definitions", ",").alias("definitions"))


@query("SELECT s_name AS traditional, 'yue' AS dialect, 'jyut' || s_nationkey AS pronunciation, 'a/b' || s_suppkey AS gloss, s_suppkey % 2 = 1 AS new FROM supplier WHERE s_suppkey % 3 <> 0")
def import_cantonese(spark, sf_dir):
    old = _suppliers(spark, sf_dir)
    words, forms = J.cantonese_imports(_readings(spark, sf_dir), old)
    known = old.select(F.col("id").alias("old_id"))
    rows = forms.join(words.select(F.col("id").alias("headword_id"), "traditional"), "headword_id").join(known, F.col("headword_id") == F.col("old_id"), "left")
    return rows.select("traditional", "dialect", "pronunciation", "gloss", F.col("old_id").isNull().alias("new"))


@query("SELECT s_suppkey AS headword_id, 'yue' AS dialect, 'jyut' || s_nationkey AS pronunciation, 'cccedict-readings' AS source FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 2 = 0")
def import_reading_overlay(spark, sf_dir):
    return J.reading_overlay(_readings(spark, sf_dir), _suppliers(spark, sf_dir)).select("headword_id", "dialect", "pronunciation", "source")


def _hokkien(spark, sf_dir) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier")
    quoted = lambda *x: F.concat_ws(",", *(F.concat(F.lit('"'), c, F.lit('"')) for c in x))
    sound = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("poj-"), "s_nationkey")).otherwise("")
    native = F.when(F.col("s_suppkey") % 5 == 0, F.col("s_name")).otherwise(F.concat(F.lit("n"), "s_nationkey"))
    line = quoted(F.col("s_name"), sound, F.concat(F.lit("kip-"), "s_nationkey"), native)
    return Y.hokkien_csv(spark, Scratch(spark).lines(rows, line, "hokkien", suffix=".csv", head="HoaBun,PojUnicode,KipUnicode,HanLoTaibunPoj"))


HOKKIEN = "CASE WHEN s_suppkey % 2 = 0 THEN 'poj-' ELSE 'kip-' END || s_nationkey AS pronunciation, CASE WHEN s_suppkey % 5 <> 0 THEN 'n' || s_nationkey END AS native_chars"


@query(f"SELECT s_name AS word, {HOKKIEN} FROM supplier")
def read_hokkien(spark, sf_dir):
    return _hokkien(spark, sf_dir).select("word", "pronunciation", "native_chars")


@query(f"SELECT s_suppkey AS headword_id, 'nan' AS dialect, 'itaigi' AS source, {HOKKIEN} FROM supplier WHERE s_suppkey % 2 = 0")
def import_hokkien(spark, sf_dir):
    return D.forms_by_word(_hokkien(spark, sf_dir), _suppliers(spark, sf_dir), "nan", "itaigi").select("headword_id", "dialect", "source", "pronunciation", "native_chars")


def _rime(spark, sf_dir) -> DataFrame:
    """Characters and words of two, by nation, behind a header."""
    rows = _table(spark, sf_dir, "nation")
    han = F.expr("decode(unhex(lpad(hex(19968 + n_nationkey % 20), 4, '0')), 'UTF-16BE')")
    word = F.when(F.col("n_nationkey") % 2 == 0, han).otherwise(F.concat(han, F.lit("人")))
    return Y.rime_lines(spark, Scratch(spark).lines(rows, F.concat_ws("\t", word, F.lower("n_name"), F.lit("1%")), "rime", suffix=".yaml", head="# x\nname: y\tz\n..."))


def _characters(spark, sf_dir) -> DataFrame:
    rows = _table(spark, sf_dir, "nation").where("n_nationkey < 20")
    han = F.expr("decode(unhex(lpad(hex(19968 + n_nationkey), 4, '0')), 'UTF-16BE')")
    word = F.when(F.col("n_nationkey") % 2 == 0, han).otherwise(F.concat(han, F.lit("人")))
    return rows.select(F.col("n_nationkey").cast("long").alias("id"), word.alias("traditional"), word.alias("simplified"), F.lower("n_name").alias("pinyin"))


RIME = "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN chr(19968 + n_nationkey % 20) ELSE chr(19968 + n_nationkey % 20) || '人' END AS word, lower(n_name) AS pronunciation FROM nation"


@query(f"SELECT word, pronunciation FROM ({RIME})")
def read_rime(spark, sf_dir):
    return _rime(spark, sf_dir).select("word", "pronunciation")


@query(f"WITH r AS ({RIME}), f AS (SELECT word, count(*) AS n, min(n_nationkey) AS id FROM r WHERE length(word) = 1 GROUP BY word) SELECT id::BIGINT AS headword_id, 'yue' AS dialect, 'rime' AS source FROM f WHERE id < 20")
def import_rime_characters(spark, sf_dir):
    return J.single_character_forms(_rime(spark, sf_dir), _characters(spark, sf_dir), "yue", "rime").select("headword_id", "dialect", "source")


@query(f"WITH r AS ({RIME}), f AS (SELECT word, max(n_nationkey) AS last, min(n_nationkey) AS id FROM r WHERE length(word) = 2 GROUP BY word) SELECT id::BIGINT AS headword_id, 'yue' AS dialect, 'rime-words' AS source FROM f WHERE id < 20")
def import_rime_words(spark, sf_dir):
    return J.word_forms(_rime(spark, sf_dir), _characters(spark, sf_dir), "yue", "rime-words").select("headword_id", "dialect", "source")


@query("""WITH n AS (SELECT n_nationkey, chr(19968 + n_nationkey) AS word FROM nation)
SELECT word, 'nan' AS dialect, 'h' || n_nationkey AS pronunciation FROM n WHERE n_nationkey % 3 <> 0 UNION ALL SELECT word, 'yue', 'c' || n_nationkey FROM n""")
def read_wikihan(spark, sf_dir):
    han = F.expr("decode(unhex(lpad(hex(19968 + n_nationkey), 4, '0')), 'UTF-16BE')")
    hokkien = F.when(F.col("n_nationkey") % 3 == 0, "-").otherwise(F.concat(F.lit("h"), "n_nationkey", F.lit("/x")))
    line = F.concat_ws("\t", han, hokkien, F.concat(F.lit("c"), "n_nationkey"))
    return Y.wikihan(spark, Scratch(spark).lines(_table(spark, sf_dir, "nation"), line, "wikihan", suffix=".tsv", head="Character\tHokkien\tCantonese")).select("word", "dialect", "pronunciation")


@query("SELECT chr(19968 + n_nationkey) AS word, CASE WHEN n_nationkey % 2 = 0 THEN 'Xiamen' ELSE 'Guangzhou' END AS place, CASE WHEN n_nationkey % 2 = 0 THEN 'nan' ELSE 'yue' END AS dialect, lower(n_name) AS pronunciation FROM nation WHERE n_nationkey % 5 <> 0")
def read_sinitic_words(spark, sf_dir):
    han = F.expr("decode(unhex(lpad(hex(19968 + n_nationkey), 4, '0')), 'UTF-16BE')")
    place = F.when(F.col("n_nationkey") % 5 == 0, "Elsewhere").when(F.col("n_nationkey") % 2 == 0, "Xiamen").otherwise("Guangzhou")
    line = F.concat_ws("\t", place, han, F.lower("n_name"))
    return Y.sinitic_words(spark, Scratch(spark).lines(_table(spark, sf_dir, "nation"), line, "words", suffix=".tsv", head="DOCULECT\tCHARACTERS\tVALUE")).select("word", "place", "dialect", "pronunciation")


# -- reports and look-ups

TERM = "Customer#000000007"


def _forms(spark, sf_dir) -> DataFrame:
    """Orders as dialect forms: priority as dialect, status as source."""
    return _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("headword_id"), F.col("o_orderpriority").alias("dialect"), F.concat(F.lit("n"), "o_orderkey").alias("native_chars"), F.concat(F.lit("p"), "o_orderkey").alias("pronunciation"), F.lit(None).cast("string").alias("gloss"), F.col("o_orderstatus").alias("source"))


OF_TERM = f"FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_name = '{TERM}'"


@query(f"SELECT c_custkey AS headword_id, c_name AS traditional, c_mktsegment AS pinyin, o_orderpriority AS lang, 'order ' || o_orderkey AS definition, o_orderstatus AS source {OF_TERM}")
def definitions_of_term(spark, sf_dir):
    return R.definitions_of(*_dictionary(spark, sf_dir), TERM).select("headword_id", "traditional", "pinyin", "lang", "definition", "source")


@query(f"SELECT c_custkey AS headword_id, o_orderpriority AS dialect, 'n' || o_orderkey AS native_chars, 'p' || o_orderkey AS pronunciation, o_orderstatus AS source {OF_TERM} AND o_orderpriority IN ('1-URGENT', '5-LOW')")
def dialect_forms_of_term(spark, sf_dir):
    words = _dictionary(spark, sf_dir)[0]
    return R.dialect_forms_of(words, _forms(spark, sf_dir), TERM, ("1-URGENT", "5-LOW")).select("headword_id", "dialect", "native_chars", "pronunciation", "source")


@query(f"SELECT c_custkey AS id, c_mktsegment AS pinyin, (SELECT coalesce(string_agg(o_orderpriority || ':' || o_orderstatus || ':order ' || o_orderkey, '|' ORDER BY o_orderpriority, o_orderstatus, 'order ' || o_orderkey), '') FROM orders WHERE o_custkey = c_custkey) AS definitions FROM customer WHERE lower(c_name) = lower('{TERM}')")
def lookup_term(spark, sf_dir):
    found = R.lookup_word(*_dictionary(spark, sf_dir), TERM.lower())
    return found.select("id", "pinyin", F.coalesce(F.array_join(F.transform("definitions", lambda d: F.concat_ws(":", d["lang"], d["source"], d["definition"])), "|"), F.lit("")).alias("definitions"))


@query("""SELECT 'total' AS kind, 'headwords' AS name, count(*) AS n FROM customer UNION ALL SELECT 'total', 'definitions', count(*) FROM orders UNION ALL SELECT 'total', 'dialect_forms', count(*) FROM orders
UNION ALL SELECT 'lang', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority""")
def dictionary_totals(spark, sf_dir):
    return R.dictionary_stats(*_dictionary(spark, sf_dir), _forms(spark, sf_dir))


@query(f"""WITH d AS (SELECT o_orderpriority AS k, arg_min('order ' || o_orderkey, (CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 99 END, o_orderstatus, o_orderkey)) AS v {OF_TERM} GROUP BY 1)
SELECT c_custkey AS id, (SELECT string_agg(k, ',' ORDER BY k) FROM d) AS langs, (SELECT string_agg(k, ',' ORDER BY k) FROM d) AS dialects FROM customer WHERE c_name = '{TERM}'""")
def etymology_of_term(spark, sf_dir):
    words, defs = _dictionary(spark, sf_dir)
    found = R.etymology(words, defs, _forms(spark, sf_dir), L.priority(table={"F": 1, "O": 2}), TERM)
    keys = lambda c: F.array_join(F.sort_array(F.map_keys(c)), ",")
    return found.select("id", keys("definitions").alias("langs"), keys("dialects").alias("dialects"))


@query(f"""SELECT '{TERM}' AS term, (SELECT c_mktsegment FROM customer WHERE c_name = '{TERM}') AS pinyin, count(*)::INT AS dialects, (SELECT count(*) FROM documents WHERE contains(lower(text), '{TERM.lower()}')) AS corpus_hits {OF_TERM}""")
def reference_of_term(spark, sf_dir):
    words, defs = _dictionary(spark, sf_dir)
    found = R.reference_data(_chunks(spark, sf_dir), words, defs, _forms(spark, sf_dir), TERM)
    return found.select("term", "pinyin", F.size("dialects").alias("dialects"), "corpus_hits")


@query("SELECT conv_id::VARCHAR AS source_article_id, turn AS chunk_index, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role) AS k FROM conversations) WHERE k = 1")
def merge_arrivals(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select(F.lit("talk").alias("source"), F.col("conv_id").cast("string").alias("source_article_id"), F.col("turn").alias("chunk_index"), "text", F.col("role").alias("arrival"))
    again = rows.withColumns({"text": F.lit("late"), "arrival": F.lit("~")})
    return C.merge_chunks(rows.unionByName(again)).select("source_article_id", "chunk_index", "text")


# -- groupings and scores


@query("SELECT o_orderpriority AS lang, count(DISTINCT o_custkey) AS covered, round(100.0 * count(DISTINCT o_custkey) / (SELECT count(*) FROM customer), 1)::DOUBLE AS percent FROM orders GROUP BY 1")
def coverage_percent(spark, sf_dir):
    words, defs = _dictionary(spark, sf_dir)
    return L.coverage(defs, words.count()).select("lang", "covered", "percent")


@query(r"""WITH r AS (SELECT lang, regexp_matches(text, '[\x{0400}-\x{04FF}]') AS bad FROM (SELECT lang, text FROM documents UNION ALL SELECT 'en', CASE WHEN p_partkey % 3 = 0 THEN 'жизнь' ELSE p_name END FROM part))
SELECT lang, NULL::VARCHAR AS script, count(*) FILTER (bad) AS bad, count(*) AS total FROM r GROUP BY lang UNION ALL SELECT lang, 'cyrillic', count(*) FILTER (bad), count(*) FROM r GROUP BY lang HAVING count(*) FILTER (bad) > 0""")
def contamination_by_script(spark, sf_dir):
    own = _table(spark, sf_dir, "part").select(F.lit("en").alias("lang"), F.when(F.col("p_partkey") % 3 == 0, "жизнь").otherwise(F.col("p_name")).alias("definition"))
    rows = _table(spark, sf_dir, "documents").select("lang", F.col("text").alias("definition")).unionByName(own)
    return L.contamination_report(rows, G.invalid_scripts(F.col("lang"), F.col("definition")))


@query("""SELECT s AS band, c AS condition, d AS dim, avg(v) AS mean, count(v) AS n FROM (SELECT o_orderstatus AS s, 'rag' AS c, 'price' AS d, o_totalprice AS v FROM orders UNION ALL SELECT o_orderstatus, 'rag', 'key', CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END FROM orders
UNION ALL SELECT o_orderstatus, 'mcp', 'price', 2 * o_totalprice FROM orders UNION ALL SELECT o_orderstatus, 'mcp', 'key', NULL FROM orders) WHERE v IS NOT NULL GROUP BY ALL""")
def means_by_condition(spark, sf_dir):
    price, key = F.col("o_totalprice"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey"))
    scores = F.struct(F.struct(price.alias("price"), key.alias("key")).alias("rag"), F.struct((2 * price).alias("price"), F.lit(None).cast("long").alias("key")).alias("mcp"))
    return E.condition_means(_table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("band"), scores.alias("scores")), ["rag", "mcp"], ["price", "key"], ["band"])


@query("SELECT p_type AS band, avg(p_size) AS rag_context_chars, avg(length(p_name)) AS mcp_context_chars, count(*) AS n, avg(length(p_name)) / avg(p_size) AS ratio FROM part GROUP BY ROLLUP (p_type)")
def context_sizes(spark, sf_dir):
    return E.size_table(_table(spark, sf_dir, "part").select(F.col("p_type").alias("band"), F.col("p_size").alias("rag_context_chars"), F.length("p_name").alias("mcp_context_chars")))


@query("""WITH r AS (SELECT p_partkey AS entry, [p_size, p_size % 5, 3] AS a, [p_partkey % 7, 2, p_size % 3] AS b FROM part)
SELECT entry, (abs(a[1] - b[1]) + abs(a[2] - b[2]) + abs(a[3] - b[3])) / 3.0::DOUBLE AS disagreement FROM r""")
def judge_differences(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey").cast("int"))
    a = rows.select(F.col("p_partkey").alias("entry"), F.lit("j1").alias("judge"), F.array("p_size", F.col("p_size") % 5, F.lit(3)).alias("scores"))
    b = rows.select(F.col("p_partkey").alias("entry"), F.lit("j2").alias("judge"), F.array(F.col("k") % 7, F.lit(2), F.col("p_size") % 3).alias("scores"))
    return E.judge_disagreement(a.unionByName(b))


@query("SELECT p_brand AS backend, count(*) AS n, avg(p_retailprice) AS seconds, avg(p_size) AS langs, avg(p_size % 7) AS valid, count(*) FILTER (p_size % 4 = 1) * 1.0::DOUBLE / nullif(count(*) FILTER (p_size % 4 > 0), 0) AS match_share FROM part WHERE p_partkey % 9 <> 0 GROUP BY p_brand")
def backend_means(spark, sf_dir):
    size = F.col("p_size")
    rows = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("backend"), F.col("p_retailprice").alias("seconds"), size.alias("langs"), (size % 7).alias("valid"), F.when(size % 4 == 1, True).when(size % 4 > 0, False).alias("matches"), F.when(F.col("p_partkey") % 9 == 0, "failed").alias("error"))
    return E.backend_summary(rows)


@query("SELECT p_type AS condition, sum(CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END)::BIGINT AS tokens, count(*) FILTER (p_size % 3 = 0) AS errors FROM part GROUP BY p_type")
def token_usage(spark, sf_dir):
    size = F.col("p_size")
    answer = F.struct(F.col("p_type").alias("condition"), F.struct(F.when(size % 2 == 0, size).alias("total_tokens")).alias("usage"), F.when(size % 3 == 0, "x").alias("error"))
    return E.usage_totals(_table(spark, sf_dir, "part").select(F.array(answer).alias("answers")))


@query("""WITH r AS (SELECT p_name AS term, arg_max({'p': p_brand, 'd': p_type, 'b': p_type}, p_partkey) AS x FROM part WHERE p_size % 2 = 0 GROUP BY p_name),
a AS (SELECT p_partkey, p_name AS term, CASE WHEN p_size % 5 > 0 THEN p_name || ' [ma' || p_size % 4 || '] ' || p_type END AS answer FROM part),
s AS (SELECT p_partkey, x.b AS band, coalesce(answer, '') <> '' AS answered, answer, x FROM a JOIN r USING (term))
SELECT p_partkey, band, answered, CASE WHEN answered AND contains(lower(answer), lower(x.d)) THEN 1.0 ELSE 0.0 END::DOUBLE AS completeness, CASE WHEN answered THEN 1.0 ELSE 0.0 END::DOUBLE AS term_present FROM s""")
def score_answers(spark, sf_dir):
    parts = _table(spark, sf_dir, "part")
    refs = parts.where("p_size % 2 = 0").select(F.col("p_name").alias("term"), F.col("p_brand").alias("pinyin"), F.array("p_type").alias("definitions"), F.col("p_type").alias("band"), F.col("p_partkey").alias("line_no"))
    answer = F.when(F.col("p_size") % 5 > 0, F.concat("p_name", F.lit(" [ma"), F.col("p_size") % 4, F.lit("] "), "p_type"))
    # the part's number rides along in the band of responses, which references replace
    asked = parts.select("p_partkey", F.col("p_name").alias("term"), F.col("p_type").alias("band"), answer.alias("response_x"))
    scored = E.score_entries(asked.drop("p_partkey").distinct(), refs, ["x"], "line_no")
    wide = asked.select("p_partkey", "term", F.coalesce(F.col("response_x"), F.lit("")).alias("r")).withColumn("answered", F.col("r") != "")
    text = E.completeness_score(F.col("r"), F.array("d"))
    one = refs.groupBy("term").agg(F.max_by(F.struct(F.col("definitions")[0].alias("d"), "band"), "line_no").alias("x")).select("term", "x.*")
    seen = scored.select("term", "band", "answered", "term_present").distinct()
    return wide.join(one, "term").join(seen, ["term", "band", "answered"]).select("p_partkey", "band", "answered", F.when(F.col("answered"), text).otherwise(0.0).alias("completeness"), "term_present")


def _with_fits(found, spread, mean):
    """Whether 95 % bounds of resamples are where the spread of the values puts them, by 1.96 standard errors and a margin of 0.5."""
    error = F.col("sd") / F.sqrt("n")
    fits = lambda distance: F.abs(distance / error - 1.96) < 0.5
    return found.join(spread, "k").withColumns({"low_fits": fits(F.col(mean) - F.col("low")), "high_fits": fits(F.col("high") - F.col(mean))})


@query("""WITH p AS (SELECT c_mktsegment AS k, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS a, avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS b FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment, o_custkey)
SELECT k, count(b - a)::BIGINT AS n, round(avg(b - a), 3) AS mean_diff, avg(b - a) > 0 AS positive, count(b - a) > 1 AS low_fits, count(b - a) > 1 AS high_fits FROM p GROUP BY k""")
def bootstrap_sign(spark, sf_dir):
    of = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    rows = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    pairs = rows.groupBy(F.col("c_mktsegment").alias("k"), "o_custkey").agg(of("F").alias("a"), of("O").alias("b")).drop("o_custkey")
    found = E.paired_bootstrap(pairs, ["k"], rounds=1000)
    return _with_fits(found, pairs.groupBy("k").agg(F.stddev_pop(F.col("b") - F.col("a")).alias("sd")), "mean_diff").select("k", "n", F.round("mean_diff", 3).alias("mean_diff"), (F.col("mean_diff") > 0).alias("positive"), "low_fits", "high_fits")


@query("SELECT o_orderpriority AS k, count(*) AS n, round(avg(o_totalprice), 3) AS mean, true AS inside, count(*) > 2 AS low_fits, count(*) > 2 AS high_fits FROM orders GROUP BY 1")
def mean_intervals(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("k"), "o_totalprice")
    found = E.means_with_interval(rows, ["k"], "o_totalprice", rounds=1000)
    found = _with_fits(found, rows.groupBy("k").agg(F.stddev_pop("o_totalprice").alias("sd")), "mean")
    return found.select("k", "n", F.round("mean", 3).alias("mean"), F.col("mean").between(F.col("low"), F.col("high")).alias("inside"), "low_fits", "high_fits")


# -- jobs in parts


@query("SELECT o_orderkey, upper(o_orderpriority) AS answer, 1::BIGINT AS times FROM orders")
def resumed_answers(spark, sf_dir):
    """Answers to a prompt per order, asked in parts; the run breaks off at its third part and another goes on."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("prompt"))
    path, asked = f"{Scratch(spark).root}/answers", []

    def work(todo, most):
        asked.append(1)
        if len(asked) > most:
            raise InterruptedError("the run breaks off")
        return U.ask(todo, lambda prompts: [p.upper() for p in prompts]).select("o_orderkey", "answer")

    try:
        P.run_in_parts(rows, ["o_orderkey"], lambda todo: work(todo, 2), path, parts=4)
    except InterruptedError:
        pass
    found = P.run_in_parts(rows, ["o_orderkey"], lambda todo: work(todo, 100), path, parts=4)
    return found.groupBy("o_orderkey", "answer").agg(F.count(F.lit(1)).alias("times"))


# -- writes


@query("""WITH r AS (SELECT p_brand AS t, p_type AS s, p_name || CASE WHEN p_size % 2 = 0 THEN ' (ni³)5' ELSE '' END AS p, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN 'noun' || p_size END AS pos, p_partkey FROM part)
SELECT t AS traditional, s AS simplified, regexp_replace(p, ' \\(ni³\\)5$', '') AS pinyin, arg_min(pos, p_partkey) FILTER (pos <> '') AS pos FROM r GROUP BY 1, 2, 3""")
def upsert_words(spark, sf_dir):
    size = F.col("p_size")
    rows = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("traditional"), F.col("p_type").alias("simplified"), F.concat("p_name", F.when(size % 2 == 0, " (ni³)5").otherwise("")).alias("pinyin"), F.when(size % 3 == 0, "").when(size % 3 == 1, F.concat(F.lit("noun"), size)).alias("pos"), F.col("p_partkey").alias("arrival"))
    return L.upsert_headwords(rows).drop("arrival")


@query("""WITH w AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_name) AS keep FROM part),
d AS (SELECT l_partkey, l_returnflag AS lang, min(l_orderkey * 10 + l_linenumber) AS d FROM lineitem GROUP BY 1, 2)
SELECT keep AS headword_id, lang, arg_min(d, p_partkey) AS definition FROM w JOIN d ON l_partkey = p_partkey GROUP BY 1, 2""")
def reconcile_definitions(spark, sf_dir):
    words = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("traditional"), F.col("p_brand").alias("simplified"), F.col("p_name").alias("pinyin"))
    defs = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("headword_id"), F.col("l_returnflag").alias("lang")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("definition")).withColumn("source", F.lit("s"))
    none = defs.select("headword_id", F.col("lang").alias("dialect"), "source").limit(0)
    return L.reconcile(words, defs, none)[1].select("headword_id", "lang", "definition")


@query(f"SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'given' WHEN p_partkey % 4 = 0 THEN 'verb' WHEN p_partkey % 4 = 1 THEN 'noun' WHEN p_partkey % 4 = 2 THEN 'phrase' END AS pos FROM part")
def fill_parts_of_speech(spark, sf_dir):
    parts = _table(spark, sf_dir, "part")
    words = parts.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, "given").alias("pos"))
    defs = parts.select((F.col("p_partkey") * 2).alias("id"), F.col("p_partkey").alias("headword_id"), F.lit("en").alias("lang"), _definition().alias("definition"))
    later = defs.withColumns({"id": F.col("id") + 1, "definition": F.lit("to come later")})
    return L.fill_pos(words, defs.unionByName(later)).select("id", "pos")


@query("SELECT p_partkey AS id FROM part WHERE p_size % 2 = 0 AND p_partkey % 3 <> 0 AND p_partkey % 5 = 0")
def leaked_definitions(spark, sf_dir):
    k = F.col("p_partkey")
    rows = _table(spark, sf_dir, "part").select(k.alias("id"), F.when(F.col("p_size") % 2 == 0, "minimax").otherwise("cedict").alias("source"), F.when(k % 3 == 0, "ja").otherwise("de").alias("lang"), F.when(k % 5 == 0, F.concat("p_name", F.lit("银"))).otherwise(F.col("p_name")).alias("definition"))
    return L.leaked(rows).select("id")


@query("SELECT c_custkey AS id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 4 <> 0")
def drop_odd_words(spark, sf_dir):
    words, defs = _dictionary(spark, sf_dir)
    k = F.col("id")
    words = words.withColumns({"traditional": F.when(k % 3 == 0, F.lit("⿰木木")).otherwise(F.col("traditional")), "simplified": F.when(k % 4 == 0, F.lit("\U00030001")).otherwise(F.col("simplified"))})
    kept, kept_defs, _ = L.drop_odd_headwords(words, defs, _forms(spark, sf_dir))
    n = kept_defs.groupBy(F.col("headword_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return kept.select("id").join(n, "id", "left").na.fill(0)


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 2 = 1")
def append_missing(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("arrival"))
    again = rows.withColumns({"name": F.lit("late"), "arrival": F.col("arrival") + 10_000_000})
    return L.append_new(rows.where("id % 2 = 0"), rows.unionByName(again), ["id"], "arrival").select("id", "name")


@query("SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'old' WHEN s_suppkey % 3 = 0 THEN 'd' || s_suppkey ELSE '' END AS description FROM supplier")
def ensure_named_sources(spark, sf_dir):
    rows = _table(spark, sf_dir, "supplier")
    none = F.lit(None).cast("string")
    have = rows.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("name"), F.lit("old").alias("description"), F.lit("").alias("license"), none.alias("url"))
    known = rows.where("s_suppkey % 3 = 0").select(F.col("s_name").alias("name"), F.concat(F.lit("d"), "s_suppkey").alias("description"), F.lit("l").alias("license"), none.alias("url"))
    return L.ensure_sources(have, rows.select(F.col("s_name").alias("name")), known).select("name", "description")


# -- fields


@query(r"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'yin2 hang2' WHEN 1 THEN 'nü3 er2' ELSE 'ma5' END AS numbered, CASE p_partkey % 3 WHEN 0 THEN 'yinhang22' WHEN 1 THEN 'nver32' ELSE 'ma5' END AS compared,
  CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_name || ' (x)' END AS bare, p_type || '/' || p_brand AS shown, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '"' || p_name END AS answer FROM part""")
def entry_fields(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    marked = F.when(k % 3 == 0, "yín háng").when(k % 3 == 1, "nǚ ér").otherwise("ma")
    rows = _table(spark, sf_dir, "part").withColumn("marked", marked)
    numbered = rows.withColumn("numbered", tone_marked_to_numbered("marked"))
    shown = X.clean_definition(F.concat(F.lit("/"), "p_type", F.lit("/CL:x//"), "p_brand", F.lit("/KP:y/")))
    bare = X.strip_toneless_suffix(F.when(size % 2 == 0, F.concat("p_name", F.lit(" (¹²)5"))).otherwise(F.concat("p_name", F.lit(" (x)"))))
    answer = X.clean_answer(F.when(size % 2 == 0, F.concat(F.lit('3. "/'), "p_name", F.lit('/"'))).otherwise(F.concat(F.lit('"'), "p_name")))
    return numbered.select("p_partkey", "numbered", X.compare_pinyin(X.normalize_pinyin(F.col("numbered"))).alias("compared"), bare.alias("bare"), shown.alias("shown"), answer.alias("answer"))


@query(r"""SELECT doc_id, len(regexp_split_to_array(text, '[;/]')) <= 5 AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(regexp_split_to_array(text, '[;/]')) AS p) WHERE regexp_matches(trim(p), '[.!?]$') OR len(regexp_split_to_array(regexp_replace(p, '^\s+|\s+$', '', 'g'), '\s+')) > 5) AS gloss,
  NOT contains(text, '<think>') AS plain, length(text) > 0 AS has FROM (SELECT doc_id, source || '/' || lang AS text FROM documents)""")
def answer_fields(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang").alias("text"))
    return rows.select("doc_id", X.is_gloss_format(F.col("text")).alias("gloss"), (X.strip_thinking(F.col("text")) == F.col("text")).alias("plain"), (F.length(X.without_cjk(F.col("text"))) > 0).alias("has"))
