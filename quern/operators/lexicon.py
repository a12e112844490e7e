"""The dictionary: conflicts, merging of variants, coverage and gaps, best definitions, export.

headwords: id, traditional, simplified, pinyin, pos. definitions: id, headword_id, lang, definition, source, confidence,
verified. forms: headword_id, dialect, native_chars, pronunciation, gloss, source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X

# Priorities of sources, the lowest first; others come last.
PRIORITY = {"cedict": 1, "cfdict": 1, "handedict": 1, "cidict": 1, "jmdict": 2, "wiktextract": 3, "minimax": 4}
OTHERS = 99
# Languages whose gaps the coverage report names.
REPORT_LANGUAGES = ("en", "de", "fr", "es", "sv", "ja", "ko", "ru", "id", "vi", "tl", "fa", "nl", "pt", "ar", "th", "hi", "it")
KEY = ["traditional", "simplified", "pinyin"]


def priority(source: Column = None, table: dict[str, int] = PRIORITY) -> Column:
    source = F.col("source") if source is None else source
    out = F.lit(OTHERS)
    for name, p in table.items():
        out = F.when(source == name, p).otherwise(out)
    return out


# -- rows that conflict


def first_wins(rows: DataFrame, key: list[str], arrival: str) -> DataFrame:
    """The row of each key that arrived first."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), arrival).alias("x")).select(*key, "x.*")


def last_wins(rows: DataFrame, key: list[str], arrival: str) -> DataFrame:
    """The row of each key that arrived last, all its columns, nulls included."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), arrival).alias("x")).select(*key, "x.*")


def upsert_headwords(entries: DataFrame, arrival: str = "arrival") -> DataFrame:
    """One headword per (traditional, simplified, pinyin), with the first part of speech that isn't empty."""
    rows = entries.withColumn("pinyin", X.strip_toneless_suffix(F.coalesce("pinyin", F.lit(""))))
    has = F.coalesce(F.col("pos"), F.lit("")) != ""
    return rows.groupBy(*KEY).agg(F.min_by("pos", F.when(has, F.col(arrival))).alias("pos"), F.min(arrival).alias(arrival))


def upsert_definitions(rows: DataFrame, arrival: str = "arrival") -> DataFrame:
    """One definition per (headword_id, lang, source): the last one; replacing resets verified."""
    n = rows.groupBy("headword_id", "lang", "source").agg(F.count(F.lit(1)).alias("n"))
    out = last_wins(rows, ["headword_id", "lang", "source"], arrival)
    if "verified" in rows.columns:
        out = out.join(n, ["headword_id", "lang", "source"]).withColumn("verified", F.when(F.col("n") > 1, F.lit(False)).otherwise(F.col("verified"))).drop("n")
    return out


def upsert_forms(rows: DataFrame, arrival: str = "arrival") -> DataFrame:
    return last_wins(rows, ["headword_id", "dialect", "source"], arrival)


def append_new(table: DataFrame, rows: DataFrame, key: list[str], arrival: str) -> DataFrame:
    """rows whose key the table doesn't have, first of each: what a writer appends so that first ones stay."""
    return first_wins(rows, key, arrival).join(table.select(*key), key, "left_anti")


def ensure_sources(table: DataFrame, names: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """table with a row for each new name; description, license and url come from known, else '' and null."""
    new = names.select("name").distinct().join(table.select("name"), "name", "left_anti")
    if known is not None:
        new = new.join(known.select("name", "description", "license", "url"), "name", "left")
    for c in ("description", "license"):
        new = new.withColumn(c, F.coalesce(F.col(c) if c in new.columns else F.lit(None).cast("string"), F.lit("")))
    return table.unionByName(new, allowMissingColumns=True)


def entry_counts(sources: DataFrame, definitions: DataFrame, forms: DataFrame) -> DataFrame:
    """sources with entry_count (definitions) and form_count (dialect forms), 0 where there are none."""
    per = lambda df, name: df.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias(name))
    out = sources.drop("entry_count", "form_count").join(per(definitions, "entry_count"), "name", "left").join(per(forms, "form_count"), "name", "left")
    return out.na.fill(0, ["entry_count", "form_count"])


# -- variants


def variant_pairs(headwords: DataFrame) -> DataFrame:
    """keep_id, drop_id of headwords that differ in the writing of their pinyin only; capitals count."""
    rows = headwords.withColumn("norm", X.normalize_pinyin(F.col("pinyin")))
    key = ["traditional", "simplified", "norm"]
    keep = rows.groupBy(*key).agg(F.min("id").alias("keep_id"))
    return rows.join(keep, key).where("id <> keep_id").select("keep_id", F.col("id").alias("drop_id"))


def variant_pair_count(headwords: DataFrame) -> DataFrame:
    """One row: pairs of variants, k of them counted as k(k-1)/2, and headwords that merging drops."""
    rows = headwords.withColumn("norm", X.normalize_pinyin(F.col("pinyin"))).groupBy("traditional", "simplified", "norm").agg(F.count(F.lit(1)).alias("k"))
    return rows.agg(F.coalesce(F.sum(F.col("k") * (F.col("k") - 1) / 2), F.lit(0)).cast("long").alias("pairs"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("dropped"))


def reconcile(headwords: DataFrame, definitions: DataFrame, forms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Variants merged into the one of smallest id. Its own definitions and forms win, then those of smaller ids."""
    pairs = variant_pairs(headwords)
    words = headwords.join(pairs.select(F.col("drop_id").alias("id")), "id", "left_anti")

    def moved(rows: DataFrame, key: list[str]) -> DataFrame:
        out = rows.join(pairs, rows["headword_id"] == pairs["drop_id"], "left").withColumn("_from", F.col("headword_id"))
        out = out.withColumn("headword_id", F.coalesce("keep_id", "headword_id")).drop("keep_id", "drop_id")
        return first_wins(out, ["headword_id", *key], "_from").drop("_from")

    return words, moved(definitions, ["lang", "source"]), moved(forms, ["dialect", "source"])


def fill_pos(headwords: DataFrame, definitions: DataFrame) -> DataFrame:
    """headwords with the part of speech that their first English definition tells, where they have none."""
    first = definitions.where("lang = 'en'").groupBy("headword_id").agg(F.min_by("definition", "id").alias("first"))
    out = headwords.join(first, headwords["id"] == first["headword_id"], "left").drop("headword_id")
    return out.withColumn("pos", F.coalesce("pos", X.pos_from_definition(F.col("first")))).drop("first")


# -- matching texts to headwords


def headword_keys(headwords: DataFrame) -> DataFrame:
    """word, headword_id for both forms of each headword, once where they are the same."""
    return headwords.select(F.explode(F.array_distinct(F.array("traditional", "simplified"))).alias("word"), F.col("id").alias("headword_id"))


def match_words(rows: DataFrame, headwords: DataFrame, word: str = "word") -> DataFrame:
    """rows by the headwords whose traditional or simplified form is their word: an equi-join, no test of either."""
    keys = headword_keys(headwords).withColumnRenamed("word", "_word")
    return rows.join(keys, rows[word] == keys["_word"]).drop("_word")


def match_exact(rows: DataFrame, headwords: DataFrame, how: str = "inner") -> DataFrame:
    """rows by the headword of the same three fields, or (left_anti) those without one."""
    return rows.join(headwords.select(*KEY, F.col("id").alias("headword_id")), KEY, how)


# -- coverage


def coverage(definitions: DataFrame, total: int) -> DataFrame:
    """lang, covered, sources (joined by commas, in order), percent of total (one decimal; 0 for no headwords)."""
    rows = definitions.groupBy("lang").agg(F.count_distinct("headword_id").alias("covered"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))
    return rows.withColumn("percent", F.round(100.0 * F.col("covered") / total, 1) if total else F.lit(0.0))


def coverage_gaps(headwords: DataFrame, definitions: DataFrame, langs: tuple[str, ...] = REPORT_LANGUAGES) -> DataFrame:
    """lang, missing: headwords without a definition in each of langs, as total less covered."""
    spark = headwords.sparkSession
    wanted = spark.createDataFrame([(x,) for x in langs], "lang string")
    total = headwords.agg(F.count(F.lit(1)).alias("total"))
    covered = definitions.join(headwords.select(F.col("id").alias("headword_id")), "headword_id", "left_semi").groupBy("lang").agg(F.count_distinct("headword_id").alias("covered"))
    return wanted.join(total).join(covered, "lang", "left").select("lang", (F.col("total") - F.coalesce("covered", F.lit(0))).alias("missing"))


def without_definition(headwords: DataFrame, definitions: DataFrame, lang: str | None = None, source: str | None = None) -> DataFrame:
    """Headwords that have no definition in a language or from a source."""
    rows = definitions
    rows = rows.where(F.col("lang") == lang) if lang else rows
    rows = rows.where(F.col("source") == source) if source else rows
    return headwords.join(rows.select(F.col("headword_id").alias("id")), "id", "left_anti")


def best_definitions(headwords: DataFrame, definitions: DataFrame, lang: str | None = None, table: dict[str, int] = PRIORITY) -> DataFrame:
    """One definition per headword and language: the lowest priority, then the smallest id."""
    rows = definitions if lang is None else definitions.where(F.col("lang") == lang)
    best = rows.groupBy("headword_id", "lang").agg(F.min_by(F.struct("definition", "source"), F.struct(priority(table=table), "id")).alias("d"))
    return headwords.join(best, headwords["id"] == best["headword_id"]).select("id", *KEY, "lang", "d.definition", "d.source")


# Titles of exported dictionaries.
TITLES = {"en": "Chinese-English", "de": "Chinese-German", "fr": "Chinese-French", "es": "Chinese-Spanish"}


def export_lines(headwords: DataFrame, definitions: DataFrame, lang: str) -> DataFrame:
    """pinyin, simplified, line of an export, in order of pinyin; empty definitions give none."""
    best = best_definitions(headwords, definitions, lang)
    body = F.regexp_replace(X.strip(F.col("definition")), r"\A/+|/+\z", "")
    line = F.concat(F.col("traditional"), F.lit(" "), F.col("simplified"), F.lit(" ["), F.col("pinyin"), F.lit("] /"), body, F.lit("/"))
    return best.where(body != "").select("pinyin", "simplified", line.alias("line")).orderBy("pinyin", "simplified", "line")


def export_header(headwords: DataFrame, definitions: DataFrame, lang: str) -> list[str]:
    """Lines before an export: title, sources, date, and the number of entries, empty ones included."""
    rows = definitions.where(F.col("lang") == lang).join(headwords.select(F.col("id").alias("headword_id")), "headword_id", "left_semi")
    n, sources, day = rows.agg(F.count_distinct("headword_id"), F.array_join(F.sort_array(F.collect_set("source")), ", "), F.date_format(F.current_timestamp(), "yyyy-MM-dd")).first()
    return [f"# {TITLES.get(lang, f'Chinese-{lang}')} dictionary", f"# Sources: {sources}", f"# Date: {day}", f"# Entries: {n}"]


def export_language(headwords: DataFrame, definitions: DataFrame, lang: str, path: str) -> None:
    """Write header and lines as text, in order over the part files; nothing passes through the driver but the header."""
    spark = headwords.sparkSession
    head = spark.createDataFrame([(0, "", "", i, x) for i, x in enumerate(export_header(headwords, definitions, lang))], "part int, pinyin string, simplified string, n int, line string")
    body = export_lines(headwords, definitions, lang).select(F.lit(1).alias("part"), "pinyin", "simplified", F.lit(0).alias("n"), "line")
    head.unionByName(body).orderBy("part", "pinyin", "simplified", "n", "line").select("line").write.mode("overwrite").text(path)


def export_all(headwords: DataFrame, definitions: DataFrame, path: str) -> list[str]:
    langs = [r["lang"] for r in definitions.select("lang").distinct().orderBy("lang").collect()]  # a few dozen
    for lang in langs:
        export_language(headwords, definitions, lang, f"{path}/{lang}")
    return langs


# -- what misses which languages


def partial_coverage(headwords: DataFrame, definitions: DataFrame, langs: list[str], source: str = "minimax", include_zero: bool = False) -> DataFrame:
    """headword_id, present, missing of headwords with fewer than all languages from a source; those with none, if asked for."""
    rows = definitions.where(F.col("source") == source).groupBy("headword_id").agg(F.collect_set("lang").alias("present"))
    out = headwords.select(F.col("id").alias("headword_id")).join(rows, "headword_id", "left" if include_zero else "inner")
    every = F.array(*map(F.lit, sorted(langs)))
    out = out.withColumn("present", F.coalesce("present", F.array().cast("array<string>")))
    return out.withColumn("missing", F.array_except(every, "present")).where(F.size("present") < len(langs))


def missing_counts(partial: DataFrame) -> DataFrame:
    return partial.select(F.explode("missing").alias("lang")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def backfill_work(headwords: DataFrame, definitions: DataFrame, langs: list[str], batch: int, source: str = "minimax", include_zero: bool = False, max_langs: int | None = None) -> DataFrame:
    """The next entries to fill, by id, with what is known of them: the source's definitions, else the first of others per language."""
    work = partial_coverage(headwords, definitions, langs, source, include_zero).orderBy("headword_id").limit(batch)
    if max_langs:
        work = work.withColumn("missing", F.slice("missing", 1, max_langs))
    near = definitions.join(work.select("headword_id"), "headword_id", "left_semi")
    own = near.where(F.col("source") == source).groupBy("headword_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "definition")))).alias("own"))
    first = near.where(F.col("source") != source).groupBy("headword_id", "lang").agg(F.min_by("definition", "id").alias("definition"))
    other = first.groupBy("headword_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "definition")))).alias("other"))
    out = work.join(own, "headword_id", "left").join(other, "headword_id", "left").join(headwords.select(F.col("id").alias("headword_id"), *KEY), "headword_id")
    return out.select("headword_id", *KEY, F.col("missing").alias("missing_langs"), F.col("present").alias("existing_lang_set"), F.coalesce("own", "other").alias("existing_defs"))


def batch_size(mean_missing: float, size: int) -> int:
    """Entries per request: fewer where many languages are asked for."""
    return max(3, int(10000 / (mean_missing * 80))) if mean_missing > 8 else size


# -- contamination and repair


def contamination(definitions: DataFrame, invalid: Column) -> DataFrame:
    """Definitions with the scripts that don't fit, none with an empty list."""
    return definitions.withColumn("invalid", invalid).where(F.size("invalid") > 0)


def contamination_report(definitions: DataFrame, invalid: Column) -> DataFrame:
    """lang, script, bad, total: by language (script null), and by language and script."""
    rows = definitions.withColumn("invalid", invalid)
    by = rows.groupBy("lang").agg(F.count_if(F.size("invalid") > 0).alias("bad"), F.count(F.lit(1)).alias("total"))
    deep = rows.select("lang", F.explode("invalid").alias("script")).groupBy("lang", "script").agg(F.count(F.lit(1)).alias("bad"))
    return by.select("lang", F.lit(None).cast("string").alias("script"), "bad", "total").unionByName(deep.join(by.select("lang", "total"), "lang").select("lang", "script", "bad", "total"))


def samples(rows: DataFrame, by: list[str], order: str, most: int = 5) -> DataFrame:
    """The first rows of each group."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("nth") <= most)


def without_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def leaked(definitions: DataFrame, source: str = "minimax") -> DataFrame:
    """Definitions of a source, in any language but Japanese, with Han characters."""
    return definitions.where((F.col("source") == source) & (F.col("lang") != "ja") & F.col("definition").rlike(f"[{X.HAN}]"))


def classify_entries(entries: DataFrame, headwords: DataFrame, definitions: DataFrame, source: str = "cedict") -> DataFrame:
    """entries with headword_id, status (missing_headword, missing_definition, complete) and whether they are proper nouns."""
    rows = entries.join(headwords.select(*KEY, F.col("id").alias("headword_id")), KEY, "left")
    have = definitions.where(F.col("source") == source).select("headword_id").distinct().withColumn("has", F.lit(True))
    rows = rows.join(have, "headword_id", "left")
    status = F.when(F.col("headword_id").isNull(), "missing_headword").when(F.col("has").isNull(), "missing_definition").otherwise("complete")
    return rows.withColumns({"status": status, "proper": X.is_capitalised(F.col("pinyin"))}).drop("has")


def drop_odd_headwords(headwords: DataFrame, definitions: DataFrame, forms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without headwords that have odd characters, and without what belongs to them."""
    odd = headwords.where(X.has_odd_character(F.col("simplified")) | X.has_odd_character(F.col("traditional"))).select("id")
    of = odd.withColumnRenamed("id", "headword_id")
    return without_ids(headwords, odd), definitions.join(of, "headword_id", "left_anti"), forms.join(of, "headword_id", "left_anti")


def source_bands(definitions: DataFrame) -> DataFrame:
    """headword_id, sources, band by distinct sources: 4 high, 3 mid, 2 low, else rare."""
    n = definitions.groupBy("headword_id").agg(F.count_distinct("source").alias("sources"))
    return n.withColumn("band", F.when(F.col("sources") >= 4, "high").when(F.col("sources") == 3, "mid").when(F.col("sources") == 2, "low").otherwise("rare"))


def sample_bands(bands: DataFrame, per_band: int, seed: int = 42) -> DataFrame:
    """per_band headwords of each band, by a hash of id and seed: the same on every run."""
    order = Window.partitionBy("band").orderBy(F.xxhash64(F.lit(seed), "headword_id"), "headword_id")
    return bands.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_band).drop("nth")
