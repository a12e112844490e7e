"""Readers of dictionaries and of dialect readings. Lines are read by Spark; every reader gives columns, no Python rows."""

from __future__ import annotations

import io
import re
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions.pinyin import tone_marked_to_numbered
from quern.sources.texts import _lines

# Parts of speech and target languages of Wiktextract.
WIKT_POS = {
    "noun": "noun", "verb": "verb", "adj": "adj", "adv": "adv", "name": "proper_noun", "prep": "prep", "conj": "conj", "intj": "intj", "pron": "pron", "det": "det", "num": "num",
    "particle": "particle", "classifier": "classifier", "phrase": "phrase", "proverb": "phrase", "idiom": "phrase", "suffix": "affix", "prefix": "affix", "affix": "affix",
}
WIKT_LANGUAGES = ("en", "de", "fr", "es", "sv", "ja", "ko", "ru", "id", "vi", "tl")
WIKT_SCHEMA = (
    "word string, lang_code string, pos string, forms array<struct<form:string,tags:array<string>>>, sounds array<struct<zh_pron:string,ipa:string,tags:array<string>>>, "
    "senses array<struct<glosses:array<string>,form_of:array<struct<word:string>>,alt_of:array<struct<word:string>>>>, translations array<struct<lang_code:string,word:string>>"
)
# Places of the Sinitic word lists and their dialects.
DOCULECTS = {"Xiamen": "nan", "Shantou": "nan", "Fuzhou": "nan", "Guangzhou": "yue", "Xianggang": "yue"}
DEFAULT_DOCULECTS = ("Xiamen", "Shantou", "Guangzhou")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, value of the lines of text files, gzip included; numbers ascend in file order, with gaps between partitions."""
    return spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())


def entry_fields(line: Column) -> dict[str, Column]:
    """Fields of "T S [pinyin] rest": split at the first brackets; the simplified form defaults to the traditional one."""
    line = X.strip(line)
    parts = r"^([^\[]*)\[([^\]]*)\](.*)$"
    words = X.strip(F.regexp_extract(line, parts, 1))
    simplified = X.strip(F.regexp_extract(words, r"^[^ ]* (.*)$", 1))
    traditional = F.regexp_extract(words, "^([^ ]*)", 1)
    return {"ok": line.rlike(parts), "traditional": traditional, "simplified": F.when(words.contains(" "), simplified).otherwise(traditional), "pinyin": X.strip(F.regexp_extract(line, parts, 2)), "rest": X.strip(F.regexp_extract(line, parts, 3))}


def _unslashed(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "^/", ""), "/$", "")


def cedict_lines(lines: DataFrame, keep_empty: bool = True, comments: str = "#") -> DataFrame:
    """line_no, traditional, simplified, pinyin, definition of lines in CEDICT form.

    The corpus reader keeps empty definitions and knows # comments; the dictionary reader drops the former and knows % too.
    """
    f = entry_fields(F.col("value"))
    rows = lines.where(f["ok"] & ~X.strip(F.col("value")).rlike(f"^[{comments}]"))
    rows = rows.select("line_no", f["traditional"].alias("traditional"), f["simplified"].alias("simplified"), f["pinyin"].alias("pinyin"), _unslashed(f["rest"]).alias("definition"))
    return rows if keep_empty else rows.where("definition <> ''")


def read_cedict(spark: SparkSession, path: str) -> DataFrame:
    """Entries for the corpus, each once."""
    return cedict_lines(numbered_lines(spark, path)).dropDuplicates(["traditional", "simplified", "pinyin", "definition"])


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Entries for the dictionary with their part of speech."""
    return cedict_lines(numbered_lines(spark, path), keep_empty=False, comments="#%").withColumn("pos", X.pos_from_entry(F.col("definition")))


def readings(lines: DataFrame, definitions: bool = True) -> DataFrame:
    """line_no, traditional, simplified, pinyin, jyutping (in braces, required) and, if asked for, definitions (an array)."""
    line = F.col("value")
    f = entry_fields(line)
    jyutping = X.strip(F.regexp_extract(line, r"\{([^}]+)\}", 1))
    rows = lines.where(f["ok"] & ~X.strip(line).startswith("#") & line.rlike(r"\{[^}]+\}"))
    bare = _unslashed(X.strip(F.regexp_replace(f["rest"], r"\{[^}]+\}", "")))
    listed = F.filter(F.transform(F.split(bare, "/"), X.strip), lambda d: d != "")
    columns = [f[k].alias(k) for k in ("traditional", "simplified", "pinyin")]
    return rows.select("line_no", *columns, jyutping.alias("jyutping"), *([listed.alias("definitions")] if definitions else []))


# -- Wiktextract


def first_simplified(forms: Column) -> Column:
    fit = F.filter(forms, lambda f: F.array_contains(f["tags"], "Simplified-Chinese") & ~F.array_contains(f["tags"], "Second-Round-Simplified-Chinese"))
    return F.try_element_at(fit, F.lit(1))["form"]


def first_pinyin(sounds: Column) -> Column:
    fit = F.filter(sounds, lambda s: F.array_contains(s["tags"], "Mandarin") & F.array_contains(s["tags"], "Pinyin") & (F.coalesce(s["zh_pron"], F.lit("")) != ""))
    return F.try_element_at(fit, F.lit(1))["zh_pron"]


def last_glosses(senses: Column) -> Column:
    """The last gloss of each sense that isn't a form of another word, each once."""
    own = F.filter(senses, lambda s: (F.coalesce(F.size(s["form_of"]), F.lit(0)) <= 0) & (F.coalesce(F.size(s["alt_of"]), F.lit(0)) <= 0) & (F.coalesce(F.size(s["glosses"]), F.lit(0)) > 0))
    return F.array_distinct(F.filter(F.transform(own, lambda s: F.element_at(s["glosses"], -1)), lambda g: g.isNotNull() & (g != "")))


def translation_map(translations: Column) -> Column:
    """A map from target language to its distinct words in order."""
    fit = F.filter(translations, lambda t: t["lang_code"].isin(*WIKT_LANGUAGES) & (F.coalesce(t["word"], F.lit("")) != ""))
    langs = F.array_distinct(F.transform(fit, lambda t: t["lang_code"]))
    words = F.transform(langs, lambda lang: F.array_distinct(F.transform(F.filter(fit, lambda t: t["lang_code"] == lang), lambda t: t["word"])))
    return F.map_from_arrays(langs, words)


def wiktextract_entries(rows: DataFrame) -> DataFrame:
    """traditional, simplified, pinyin (numbered), pos, glosses_en, translations of Chinese entries that have pinyin and glosses."""
    pos = F.create_map(*(F.lit(x) for pair in WIKT_POS.items() for x in pair))
    rows = rows.withColumns({"_pinyin": first_pinyin(F.col("sounds")), "glosses_en": last_glosses(F.col("senses"))})
    rows = rows.where((F.coalesce("word", F.lit("")) != "") & F.coalesce("lang_code", F.lit("zh")).isin("zh", "") & F.col("_pinyin").isNotNull() & (F.size("glosses_en") > 0))
    empty = F.array().cast("array<struct<lang_code:string,word:string>>")
    return rows.select(F.col("word").alias("traditional"), F.coalesce(F.nullif(first_simplified(F.col("forms")), F.lit("")), F.col("word")).alias("simplified"), tone_marked_to_numbered("_pinyin").alias("pinyin"), F.try_element_at(pos, F.col("pos")).alias("pos"), "glosses_en", translation_map(F.coalesce("translations", empty)).alias("translations"))


def read_wiktextract(spark: SparkSession, path: str) -> DataFrame:
    return wiktextract_entries(spark.read.schema(WIKT_SCHEMA).option("mode", "DROPMALFORMED").json(path))


def hokkien_sounds(rows: DataFrame) -> DataFrame:
    """line_no, word, pronunciation: the first Hokkien sound's romanisation, or else its IPA."""
    fit = F.filter("sounds", lambda s: F.lower(F.array_join(s["tags"], " ")).rlike("min-nan|hokkien") & (F.coalesce(F.nullif(s["zh_pron"], F.lit("")), s["ipa"], F.lit("")) != ""))
    first = F.try_element_at(fit, F.lit(1))
    rows = rows.withColumn("line_no", F.monotonically_increasing_id())
    return _forms(rows, F.col("word"), F.coalesce(F.nullif(first["zh_pron"], F.lit("")), first["ipa"]))


# -- JMdict


def resolve_entities(xml: str) -> str:
    """XML with the entities that its document type declares put in, and without that declaration."""
    head = re.search(r"<!DOCTYPE.*?\]>", xml, re.S)
    if not head:
        return xml
    body = xml[: head.start()] + xml[head.end() :]
    for name, value in re.findall(r'<!ENTITY\s+(\S+)\s+"([^"]*)"', head.group()):
        body = body.replace(f"&{name};", value)
    return body


JMDICT = "struct<k_ele:array<struct<keb:string>>,r_ele:array<struct<reb:string>>,sense:array<struct<pos:array<string>,gloss:array<struct<_VALUE:string,`_xml:lang`:string>>>>>"


def jmdict_entries(entries: DataFrame) -> DataFrame:
    """kanji, reading, pos, glosses_en, glosses_ja: a row per form of Han characters only, of entries with English glosses."""
    kanji = F.filter(F.transform("k_ele", lambda k: k["keb"]), lambda k: X.is_pure_cjk(k))
    poses = F.filter(F.transform(F.flatten(F.transform("sense", lambda s: F.coalesce(s["pos"], F.array().cast("array<string>")))), X.map_pos), lambda p: p.isNotNull())
    none = F.array().cast("array<struct<_VALUE:string,`_xml:lang`:string>>")
    glosses = F.transform(F.filter(F.flatten(F.transform("sense", lambda s: F.coalesce(s["gloss"], none))), lambda g: g["_xml:lang"].isNull()), lambda g: F.coalesce(g["_VALUE"], F.lit("")))
    reading = F.try_element_at("r_ele", F.lit(1))["reb"]
    rows = entries.where((F.size(glosses) > 0) & (F.coalesce(reading, F.lit("")) != ""))
    return rows.select(F.explode(kanji).alias("kanji"), reading.alias("reading"), F.coalesce(F.try_element_at(poses, F.lit(1)), F.lit("")).alias("pos"), glosses.alias("glosses_en"), reading.alias("glosses_ja"))


def read_jmdict(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an XML file, plain or gzip. The file is cut into entries after its entities are put in, by one worker per file."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_py()
                if raw[:2] == b"\x1f\x8b":
                    import gzip

                    raw = gzip.decompress(raw)
                yield pa.RecordBatch.from_arrays([pa.array(re.findall(r"<entry>.*?</entry>", resolve_entities(raw.decode()), re.S), pa.string())], names=["xml"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "xml string")
    return jmdict_entries(rows.select(F.from_xml("xml", JMDICT[len("struct<") : -1].replace("k_ele:", "k_ele ", 1).replace(",r_ele:", ", r_ele ", 1).replace(",sense:", ", sense ", 1)).alias("e")).select("e.*"))


# -- dialect readings: line_no, word, native_chars, pronunciation, gloss


def _forms(rows: DataFrame, word: Column, pronunciation: Column, native: Column | None = None, gloss: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    word, pronunciation = X.strip(word), X.strip(pronunciation)
    own = none if native is None else F.nullif(F.nullif(X.strip(native), F.lit("")), word)
    out = rows.select("line_no", word.alias("word"), own.alias("native_chars"), pronunciation.alias("pronunciation"), (none if gloss is None else gloss).alias("gloss"))
    return out.where((F.coalesce("word", F.lit("")) != "") & (F.coalesce("pronunciation", F.lit("")) != ""))


def _csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV file with a header; Spark drops a byte order mark."""
    return spark.read.option("header", "true").option("sep", sep).option("multiLine", "true").csv(path).withColumn("line_no", F.monotonically_increasing_id())


def _column(rows: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in rows.columns else F.lit(None).cast("string")


def hokkien_csv(spark: SparkSession, path: str, fallback: bool = True) -> DataFrame:
    """Readings of Mandarin words; native characters that are the Mandarin ones count as none. fallback: a second romanisation."""
    rows = _csv(spark, path)
    sound = F.nullif(X.strip(_column(rows, "PojUnicode")), F.lit(""))
    if fallback:
        sound = F.coalesce(sound, X.strip(_column(rows, "KipUnicode")))
    return _forms(rows, _column(rows, "HoaBun"), sound, _column(rows, "HanLoTaibunPoj"))


def rime_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of word, reading, weight behind the header's end mark."""
    rows = _lines(spark, path, "*.yaml")
    start = rows.where(X.strip(F.col("value")) == "...").groupBy("path").agg(F.min("line_no").alias("start"))
    rows = rows.join(start, "path").where("line_no > start").withColumn("f", F.split(X.strip(F.col("value")), "\t")).where(F.size("f") >= 2)
    return _forms(rows, F.col("f")[0], F.col("f")[1])


def unihan(spark: SparkSession, path: str) -> DataFrame:
    """First Cantonese readings of characters, from a zip that Spark has no codec for."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    lines = z.read("Unihan_Readings.txt").decode().split("\n")
                rows = [(i, chr(int(f[0][2:], 16)), f[2].split()[0]) for i, line in enumerate(lines) if len(f := line.split("\t")) >= 3 and f[1] == "kCantonese" and f[2].split()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["line_no", "word", "sound"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "line_no long, word string, sound string")
    return _forms(rows, F.col("word"), F.col("sound"))


def wikihan(spark: SparkSession, path: str) -> DataFrame:
    """dialect and readings of single characters, a row per dialect; - is none."""
    rows = _csv(spark, path, "\t")
    rows = rows.select("line_no", F.col("Character").alias("c"), F.inline(F.array(*(F.struct(F.lit(d).alias("dialect"), _column(rows, name).alias("sound")) for name, d in (("Hokkien", "nan"), ("Cantonese", "yue"))))))
    sound = F.nullif(X.strip(F.split("sound", "/")[0]), F.lit("-"))
    out = _forms(rows.withColumn("line_no", F.struct("line_no", "dialect")), F.col("c"), sound)
    return out.where(F.length("word") == 1).withColumns({"dialect": F.col("line_no.dialect"), "line_no": F.col("line_no.line_no")})


def sinitic_words(spark: SparkSession, path: str, doculects=DEFAULT_DOCULECTS) -> DataFrame:
    """place, dialect and readings of single Han characters in some places, in one scan."""
    rows = _csv(spark, path, "\t").where(F.col("DOCULECT").isin(*doculects))
    dialect = F.create_map(*(F.lit(x) for pair in DOCULECTS.items() for x in pair))
    rows = rows.withColumn("line_no", F.struct("line_no", "DOCULECT"))
    out = _forms(rows, F.col("CHARACTERS"), F.col("VALUE")).where((F.length("word") == 1) & X.is_pure_cjk(F.col("word")))
    return out.withColumns({"place": F.col("line_no.DOCULECT"), "line_no": F.col("line_no.line_no")}).withColumn("dialect", F.try_element_at(dialect, F.col("place")))


def taibun(spark: SparkSession, path: str) -> DataFrame:
    """First readings of a msgpack map from word to readings. Needs the msgpack library on the workers."""

    def run(batches):
        import msgpack

        for batch in batches:
            for content in batch.column(0):
                pairs = list(msgpack.unpackb(content.as_py(), raw=False).items())
                yield pa.RecordBatch.from_arrays([pa.array(range(len(pairs)), pa.int64()), pa.array([k for k, _ in pairs], pa.string()), pa.array([(v or "").split("/")[0] for _, v in pairs], pa.string())], names=["line_no", "word", "sound"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "line_no long, word string, sound string")
    return _forms(rows, F.col("word"), F.col("sound"))
