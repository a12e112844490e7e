"""Readers of text collections. Each gives articles: source_article_id, title, text; blank texts are dropped.

Readers of lines number them over the splits of a file. Readers of files that are one value each take them whole.
"""

from __future__ import annotations

import io
import re
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as X

ARTICLE = ["source_article_id", "title", "text"]


def _articles(rows: DataFrame, id_: Column, title: Column, text: Column) -> DataFrame:
    out = rows.select(F.coalesce(id_.cast("string"), F.lit("")).alias("source_article_id"), F.coalesce(title, F.lit("")).alias("title"), F.coalesce(text, F.lit("")).alias("text"))
    return out.where(~X.blank(F.col("text")))


def _whole(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, value of whole files below a folder. path is below the folder, without escapes."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    base = re.escape("/" + path.split("://")[-1].strip("/")) + "/"
    return rows.select(F.regexp_extract(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), base + "(.*)", 1).alias("path"), "value")


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def _path(base: str) -> Column:
    """A file's path below a base, without escapes."""
    return F.regexp_extract(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), re.escape("/" + base.split("://")[-1].strip("/")) + "/(.*)", 1)


#: Splits of files whose first line numbers are worked out by the driver and sent to tasks; those of more are joined.
MOST_SPLITS = 200_000


def _lines(spark: SparkSession, path: str, pattern: str, keep: Column | None = None) -> DataFrame:
    """path, line_no (from 0), value of the lines of files, blank ones counted; with keep, of those for which it is true of value, counted alone.

    Files are read in splits, so none need fit a task: a first pass counts the lines of each split, sums of those before it
    in its file say where its numbers begin, and the second numbers lines inside their split as they are read. Compressed
    files are one split each. Files mustn't change in between. A file without lines gives none.
    """
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "\n").text(path)
    rows = rows.select(_path(path).alias("path"), F.col("_metadata.file_block_start").alias("split"), F.regexp_replace("value", r"\r\z", "").alias("value"))
    rows = rows if keep is None else rows.where(keep)
    counts = rows.groupBy("path", "split").agg(F.count(F.lit(1)).alias("n"))
    few = counts.limit(MOST_SPLITS + 1).collect()  # a row per split, up to a bound
    if len(few) > MOST_SPLITS:
        before = F.sum("n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
        begins = counts.select("path", "split", F.coalesce(before, F.lit(0)).alias("begin"))
    else:
        table, at = [], {}
        for r in sorted(few):
            table.append((r["path"], r["split"], at.get(r["path"], 0)))
            at[r["path"]] = at.get(r["path"], 0) + r["n"]
        begins = F.broadcast(spark.createDataFrame(table, "path string, split long, begin long"))

    def number(batches):
        last, n = None, 0
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            # a split's rows follow one another in one task
            paths, splits = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
            new = np.concatenate([[True], (paths[1:] != paths[:-1]) | (splits[1:] != splits[:-1])])
            start = np.flatnonzero(new)
            nth = np.arange(size) - np.repeat(start, np.diff(np.append(start, size)))
            if last == (batch.column(0)[0].as_py(), splits[0]):
                first = start[1] if len(start) > 1 else size
                nth[:first] += n
            last, n = (batch.column(0)[size - 1].as_py(), splits[-1]), int(nth[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nth.astype(np.int64)), batch.column(2)], names=["path", "split", "nth", "value"])

    found = rows.mapInArrow(number, "path string, split long, nth long, value string")
    return found.join(begins, ["path", "split"]).select("path", (F.col("begin") + F.col("nth")).alias("line_no"), "value")


def table_articles(table: DataFrame, source: str, limit: int = 0) -> DataFrame:
    """Rows of one source of a table (source, source_id, title, text); the filter and the columns reach the scan."""
    text = X.clean_idiom_markers(F.col("text")) if source.startswith("chid") else F.col("text")
    rows = table.where(F.col("source") == source)
    return _articles(rows.limit(limit) if limit else rows, F.col("source_id"), F.col("title"), text)


def bilingual_classics(spark: SparkSession, base: str) -> DataFrame:
    """双语数据/<book>/…/source.txt: whole files; id is the path of folders, title the same with dots."""
    rows = _whole(spark, f"{base}/双语数据", "source.txt")
    folder = F.regexp_replace("path", "/source.txt$", "")
    return _articles(rows, folder, F.replace(folder, F.lit("/"), F.lit("·")), X.strip(F.col("value")))


def raw_classics(spark: SparkSession, base: str) -> DataFrame:
    """古文原文/<book>/…/text.txt of books that the bilingual set doesn't have."""
    book = lambda p: F.split(p, "/")[0]
    have = _whole(spark, f"{base}/双语数据", "*").select(book(F.col("path")).alias("book")).distinct()
    rows = _whole(spark, f"{base}/古文原文", "text.txt").withColumn("book", book(F.col("path"))).join(have, "book", "left_anti")
    folder = F.regexp_replace("path", "/text.txt$", "")
    return _articles(rows, folder, F.replace(folder, F.lit("/"), F.lit("·")), X.strip(F.col("value")))


POEMS = "array<struct<title:string,rhythmic:string,author:string,paragraphs:array<string>>>"


def poems(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """JSON arrays of poems; author files and what isn't such an array are skipped."""
    rows = _whole(spark, folder, "*.json").where(~_stem(F.col("path")).startswith("author"))
    rows = rows.select(F.explode(F.from_json("value", POEMS)).alias("p"))
    title, author = F.coalesce(F.nullif(F.col("p.title"), F.lit("")), F.col("p.rhythmic"), F.lit("")), F.coalesce("p.author", F.lit(""))
    shown = F.when(author != "", F.concat(title, F.lit("（"), author, F.lit("）"))).otherwise(title)
    return _articles(rows, F.concat_ws("/", F.lit(prefix), title, author), shown, F.array_join("p.paragraphs", "\n"))


def classic_json(spark: SparkSession, folder: str, collection: str) -> DataFrame:
    """JSON of a classic: a list of chapters (title or chapter; paragraphs or content), or an object of chapters.

    Values that are neither a text nor a list of texts are skipped.
    """
    rows = _whole(spark, folder, "*.json").withColumn("stem", _stem(F.col("path")))
    chapter = "array<struct<title:string,chapter:string,paragraphs:array<string>,content:array<string>>>"
    listed = rows.select("stem", F.posexplode(F.from_json("value", chapter)).alias("i", "c"))
    name = F.coalesce(F.nullif(F.col("c.title"), F.lit("")), F.nullif(F.col("c.chapter"), F.lit("")), F.concat("stem", F.lit("_"), "i"))
    a = _articles(listed, F.concat_ws("/", F.lit(collection), name), name, F.array_join(F.coalesce("c.paragraphs", "c.content"), "\n"))
    keyed = rows.where(F.ltrim("value").startswith("{")).select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "v"))
    texts = F.when(F.col("v").startswith("["), F.array_join(F.from_json("v", "array<string>"), "\n")).when(~F.col("v").startswith("{"), F.col("v"))
    return a.unionByName(_articles(keyed, F.concat_ws("/", F.lit(collection), "k"), F.col("k"), texts))


def labelled_news(table: DataFrame) -> DataFrame:
    """title, content of a table with a row number in idx; the numbers of skipped rows are used up."""
    return _articles(table, F.col("idx"), F.col("title"), F.col("content"))


def _json_lines(spark: SparkSession, path: str, schema: str, pattern: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).json(path)


def news_jsonl(spark: SparkSession, path: str) -> DataFrame:
    rows = _json_lines(spark, path, "news_id string, title string, content string", "*.json*")
    return _articles(rows, F.col("news_id"), F.col("title"), F.col("content"))


def community_answers(spark: SparkSession, base: str) -> DataFrame:
    """Answers by question id; ids repeat over answers."""
    rows = _json_lines(spark, base, "qid string, title string, content string", "web_text_zh_*.json")
    return _articles(rows, F.col("qid"), F.col("title"), F.col("content"))


def dialogue_fields(turns: Column) -> tuple[Column, Column]:
    """text and title of a dialogue: turns without spaces, on lines; the first one's first 50 characters."""
    bare = F.transform(turns, lambda t: F.replace(t, F.lit(" "), F.lit("")))
    return F.array_join(bare, "\n").alias("text"), F.substring(bare[0], 1, 50).alias("title")


def dialogues(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """One JSON array of dialogues, each an array of turns; those under two turns are skipped, their numbers used up."""
    rows = _whole(spark, path, pattern).select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("i", "turns")).where(F.size("turns") >= 2)
    text, title = dialogue_fields(F.col("turns"))
    return _articles(rows, F.col("i"), title, text)


def _numbered_json(spark: SparkSession, base: str, schema: str) -> DataFrame:
    rows = _lines(spark, base, "*.json").withColumn("j", F.from_json("value", schema))
    return rows.withColumn("line_id", F.concat(_stem(F.col("path")), F.lit("/"), "line_no"))


def court_cases(spark: SparkSession, base: str) -> DataFrame:
    """JSON lines of cases; the title is up to three accusations, or the start of the facts."""
    rows = _numbered_json(spark, base, "fact string, meta struct<accusation:array<string>>")
    named = F.array_join(F.slice("j.meta.accusation", 1, 3), "、")
    return _articles(rows, F.col("line_id"), F.coalesce(F.nullif(named, F.lit("")), F.substring("j.fact", 1, 50)), F.col("j.fact"))


def parallel_sentences(spark: SparkSession, base: str) -> DataFrame:
    rows = _numbered_json(spark, base, "english string, chinese string")
    title = F.coalesce(F.nullif(F.substring("j.english", 1, 80), F.lit("")), F.substring("j.chinese", 1, 50))
    return _articles(rows, F.col("line_id"), title, F.col("j.chinese"))


def encyclopedia_answers(spark: SparkSession, base: str) -> DataFrame:
    rows = _json_lines(spark, base, "qid string, title string, answer string", "baike_qa_*.json")
    return _articles(rows, F.col("qid"), F.col("title"), F.col("answer"))


def abstracts(spark: SparkSession, path: str, pattern: str = "*.tsv") -> DataFrame:
    """Lines of title, abstract, keywords between tabs; quotes mean nothing. The id is the line's number."""
    rows = _lines(spark, path, pattern).withColumn("f", F.split("value", "\t")).where(F.size("f") >= 2)
    words = F.replace(F.try_element_at("f", F.lit(3)), F.lit("_"), F.lit("、"))
    text = F.concat(F.col("f")[1], F.when(F.coalesce(words, F.lit("")) != "", F.concat(F.lit("\n关键词："), words)).otherwise(""))
    return _articles(rows, F.col("line_no"), F.col("f")[0], F.when(~X.blank(F.col("f")[1]), text))


# Files of laws that aren't laws, and the least length of one.
NOT_LAWS = ("README.md", "法律法规模版.md")
LEAST_LAW = 20


def laws(spark: SparkSession, base: str) -> DataFrame:
    rows = _whole(spark, base, "*.md").where(~F.element_at(F.split("path", "/"), -1).isin(*NOT_LAWS)).withColumn("t", X.strip(F.col("value")))
    return _articles(rows.where(F.length("t") >= LEAST_LAW), F.col("path"), _stem(F.col("path")), F.col("t"))


def _records(raw, encoding: str) -> list[list[tuple[str, str]]]:
    import csv

    rows = csv.DictReader(io.TextIOWrapper(raw, encoding, "replace", newline=""))
    return [[(k, v) for k, v in r.items() if isinstance(k, str) and isinstance(v, str)] for r in rows]


def worker_csv(spark: SparkSession, path: str, pattern: str, encoding: str = "utf-8-sig") -> DataFrame:
    """path, line_no, fields (map) of CSV files, or of the CSV members of zip files, that Spark's reader can't decode."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = io.BytesIO(content.as_py())
                if zipfile.is_zipfile(raw):
                    with zipfile.ZipFile(raw) as z:
                        rows = [r for member in sorted(n for n in z.namelist() if n.endswith(".csv")) for r in _records(z.open(member), encoding)]
                else:
                    raw.seek(0)
                    rows = _records(raw, encoding)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.map_(pa.string(), pa.string()))], names=["path", "line_no", "fields"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path"), "content").mapInArrow(run, "path string, line_no long, fields map<string,string>")


def medical_questions(spark: SparkSession, base: str) -> DataFrame:
    """Questions and answers of question.zip and answer.zip."""
    parts = []
    for name, key, mark, sign in (("question", "question_id", "q", "问："), ("answer", "ans_id", "a", "答：")):
        rows = worker_csv(spark, base, f"{name}.zip")
        text = F.try_element_at("fields", F.lit("content"))
        parts.append(_articles(rows, F.concat(F.lit(f"{mark}/"), F.coalesce(F.try_element_at("fields", F.lit(key)), F.col("line_no").cast("string"))), F.concat(F.lit(sign), F.substring(text, 1, 50)), text))
    return parts[0].unionByName(parts[1])


def medical_dialogues(spark: SparkSession, base: str, encoding: str = "gbk") -> DataFrame:
    """CSV with columns title, ask, answer in GBK, below folders named <code>_<department>; bad bytes are replaced."""
    rows = worker_csv(spark, base, "*.csv", encoding)
    rows = rows.select("path", "line_no", *(F.try_element_at("fields", F.lit(c)).alias(c) for c in ("title", "ask", "answer")))
    dept = F.regexp_replace(F.element_at(F.split("path", "/"), -2), "^[^_]*_", "")
    part = lambda sign, c: F.when(~X.blank(F.col(c)), F.concat(F.lit(sign), X.strip(F.col(c))))
    title = F.coalesce(F.nullif(X.strip(F.col("title")), F.lit("")), F.concat(dept, F.lit("问答")))
    return _articles(rows, F.concat_ws("/", dept, _stem(F.col("path")), F.col("line_no")), title, F.concat_ws("\n", part("问：", "ask"), part("答：", "answer")))


def subtitles(spark: SparkSession, path: str, group_size: int = 5, pattern: str = "*.txt") -> DataFrame:
    """Groups of consecutive lines that aren't blank, within each file; the last one is shorter."""
    from quern.operators.corpus import group_lines

    rows = _lines(spark, path, pattern, X.strip(F.col("value")) != "").withColumn("text", X.strip(F.col("value")))
    grouped = group_lines(rows, group_size, "line_no", ("path",), numbered=True)
    return _articles(grouped, F.concat(_stem(F.col("path")), F.lit("/"), "group_no"), F.col("title"), F.col("text"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """id of a JSON list of numbers."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<long>")).alias("id"))


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON array; none if there is no file."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("multiLine", "true").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


#: Readers by source: (reader, what it reads below a base folder).
REGISTRY = {
    "webtext2019zh": (community_answers, "webtext2019zh"), "lccc": (dialogues, "lccc"), "cail2018": (court_cases, "cail2018"), "translation2019zh": (parallel_sentences, "translation2019zh"),
    "baike2018qa": (encyclopedia_answers, "baike2018qa"), "csl": (abstracts, "csl"), "laws": (laws, "laws"), "cmedqa2": (medical_questions, "cmedqa2"), "medical_dialogues": (medical_dialogues, "medical_dialogues"),
    "subtitles": (subtitles, "subtitles"), "news2016zh": (news_jsonl, "news2016zh"), "classics_bilingual": (bilingual_classics, "classics"), "classics_raw": (raw_classics, "classics"),
}
