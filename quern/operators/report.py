"""Word reports: corpus evidence with dictionary and dialect entries of a term."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import search as S

# Hits, snippets per source and context for each level of detail.
DETAIL = {"brief": (10, 2, 0), "standard": (30, 3, 2), "full": (30, 3, 2)}
#: Hits that are shown with their context.
CONTEXT_HITS = 6


def lookup_entries(entries: DataFrame, term: str) -> DataFrame:
    """Rows of a dictionary whose simplified or traditional form is the term. Both tests reach the scan."""
    return entries.where((F.col("simplified") == term) | (F.col("traditional") == term))


def best_snippets(results: DataFrame, most: int) -> DataFrame:
    """source, best_snippets: the first texts of each source, in order of results."""
    rows = results.withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy("chunk_id"))).where(F.col("nth") <= most)
    return rows.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]).alias("best_snippets"))


def evidence(chunks: DataFrame, term: str, limit: int = 30, per_source: int = 3, cap: int = 1000) -> DataFrame:
    """source, hit_count, best_snippets, most hits first; a source without a sampled hit has no snippets."""
    hits = S.phrase_hits(chunks, term)
    shown = best_snippets(S.search(chunks, term, limit), per_source)
    counts = S.count_by_source(hits, cap).withColumnRenamed("hits", "hit_count")
    return counts.join(shown, "source", "left").select("source", "hit_count", F.coalesce("best_snippets", F.array().cast("array<string>")).alias("best_snippets")).orderBy(F.desc("hit_count"), "source")


def word_report(chunks: DataFrame, cedict: DataFrame, term: str, limit: int = 30, per_source: int = 3, context_chunks: int = 2) -> DataFrame:
    """One row: term, total_hits, sources, cedict_entries, best_snippets, pinyin_suggestion (null)."""
    spark = chunks.sparkSession
    found = evidence(chunks, term, limit, per_source).agg(
        F.coalesce(F.sum("hit_count"), F.lit(0)).alias("total_hits"),
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("hit_count")).alias("o"), "source", "hit_count", "best_snippets"))), lambda x: F.struct(x["source"].alias("name"), x["hit_count"].alias("hit_count"), x["best_snippets"].alias("best_snippets"))).alias("sources"),
    )
    words = lookup_entries(cedict, term).agg(F.sort_array(F.collect_list(F.struct("traditional", "simplified", "pinyin", "definition"))).alias("cedict_entries"))
    none = spark.range(1).select(F.array().cast("array<struct<source:string,title:string,hit_text:string,context:string>>").alias("best_snippets"))
    if context_chunks:
        top = S.search(chunks, term, limit, compat=True).limit(CONTEXT_HITS)
        shown = S.context(chunks, top, context_chunks, context_chunks).agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", "source", "title", "hit_text", "context"))), lambda x: F.struct(x["source"].alias("source"), x["title"].alias("title"), x["hit_text"].alias("hit_text"), x["context"].alias("context"))).alias("best_snippets"))
    else:
        shown = none
    # three one-row frames side by side
    return found.join(words).join(shown).select(F.lit(term).alias("term"), "total_hits", "sources", "cedict_entries", "best_snippets", F.lit(None).cast("string").alias("pinyin_suggestion"))


def report_json(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct(*report.columns)).alias("report"))


def definitions_of(headwords: DataFrame, definitions: DataFrame, term: str) -> DataFrame:
    """Definitions of headwords with the term, by language and source."""
    words = lookup_entries(headwords, term).withColumnRenamed("id", "headword_id")
    return definitions.join(words.select("headword_id", "traditional", "simplified", "pinyin"), "headword_id").select("headword_id", "traditional", "simplified", "pinyin", "lang", "definition", "source").orderBy("lang", "source")


def dialect_forms_of(headwords: DataFrame, forms: DataFrame, term: str, dialects: tuple[str, ...] | None = None) -> DataFrame:
    """Dialect forms of headwords with the term, by dialect and source; of some dialects only, if they are named."""
    words = lookup_entries(headwords, term).withColumnRenamed("id", "headword_id").select("headword_id", "traditional", "simplified", "pinyin")
    rows = forms if dialects is None else forms.where(F.col("dialect").isin(*dialects))
    return rows.join(words, "headword_id").select("headword_id", "traditional", "simplified", "pinyin", "dialect", "native_chars", "pronunciation", "gloss", "source").orderBy("dialect", "source")


def lookup_word(headwords: DataFrame, definitions: DataFrame, term: str) -> DataFrame:
    """A row per headword with its definitions as an array, by language and source. One join, no query per word."""
    words = lookup_entries(headwords, term)
    listed = definitions.groupBy("headword_id").agg(F.sort_array(F.collect_list(F.struct("lang", "source", "definition"))).alias("definitions"))
    return words.join(listed, words["id"] == listed["headword_id"], "left").select("id", "traditional", "simplified", "pinyin", "pos", "definitions")


def dictionary_stats(headwords: DataFrame, definitions: DataFrame, forms: DataFrame) -> DataFrame:
    """kind, name, n: totals, definitions by language, most first."""
    total = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("kind"), F.lit(name).alias("name"), "n")
    by = definitions.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(F.lit("lang").alias("kind"), F.col("lang").alias("name"), "n")
    return total(headwords, "headwords").unionByName(total(definitions, "definitions")).unionByName(total(forms, "dialect_forms")).unionByName(by).orderBy("kind", F.desc("n"), "name")


# Languages shown first in an etymology, and further ones.
FIRST_LANGUAGES = ("vi", "id", "tl")
MORE_LANGUAGES = ("en", "de", "fr", "es", "sv", "ja", "ko", "ru")


def etymology(headwords: DataFrame, definitions: DataFrame, forms: DataFrame, priority, term: str) -> DataFrame:
    """A row per headword with maps: the best definition of each language, the first form of each dialect."""
    words = lookup_entries(headwords, term).select("id", "traditional", "simplified", "pinyin")
    best = definitions.groupBy("headword_id", "lang").agg(F.min_by("definition", F.struct(priority, "source")).alias("definition"))
    best = best.groupBy("headword_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "definition")))).alias("definitions"))
    first = forms.groupBy("headword_id", "dialect").agg(F.min_by(F.struct("native_chars", "pronunciation", "gloss"), "source").alias("form"))
    first = first.groupBy("headword_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("dialect", "form")))).alias("dialects"))
    return words.join(best, words["id"] == best["headword_id"], "left").drop("headword_id").join(first, words["id"] == first["headword_id"], "left").drop("headword_id")


def format_etymology(rows: DataFrame, term: str, others: bool = False) -> str:
    """Text of an etymology: head, English, dialects, other languages."""
    out = []
    for r in rows.orderBy("id").collect():  # the few headwords of one term
        words = r["traditional"] if r["traditional"] == r["simplified"] else f"{r['traditional']} / {r['simplified']}"
        out.append(f"{words} [{r['pinyin']}]")
        defs = r["definitions"] or {}
        if "en" in defs:
            out.append(f"  en: {tidy_definition(defs['en'])}")
        for dialect, form in sorted((r["dialects"] or {}).items(), reverse=True):
            out.append(f"  {dialect}: {' '.join(x for x in (form['native_chars'], form['pronunciation']) if x)}" + (f" ({form['gloss']})" if form["gloss"] else ""))
        out += [f"  {lang}: {tidy_definition(defs[lang])}" for lang in FIRST_LANGUAGES + (MORE_LANGUAGES[1:] if others else ()) if lang in defs]
    return "\n".join(out) if out else f"{term}: not found"


def tidy_definition(definition: str) -> str:
    """clean_definition of one string."""
    kept = [p for i, p in enumerate(definition.split("/")) if p and (i == 0 or not p.startswith(("CL:", "KP:")))]
    return "/".join(kept)


def report_text(chunks: DataFrame, cedict: DataFrame, headwords: DataFrame, definitions: DataFrame, forms: DataFrame, term: str, detail: str = "standard") -> str:
    """The report as Markdown, at one of the levels of DETAIL. Only full shows context, and brief shows no examples."""
    limit, per_source, around = DETAIL[detail]
    r = word_report(chunks, cedict, term, limit, per_source, around).first()
    out = [f"# {term}", "", f"Hits: {r['total_hits']}"]
    for e in r["cedict_entries"]:
        out.append(f"- {e['traditional']} / {e['simplified']} [{e['pinyin']}] {e['definition']}")
    known = definitions_of(headwords, definitions, term).collect()
    out += ["", "## Definitions"] * bool(known) + [f"- {d['lang']} ({d['source']}): {d['definition']}" for d in known]
    said = dialect_forms_of(headwords, forms, term).collect()
    out += ["", "## Dialects"] * bool(said) + [f"- {d['dialect']} ({d['source']}): {' '.join(x for x in (d['native_chars'], d['pronunciation']) if x)}" for d in said]
    out += ["", "## Sources"] * bool(r["sources"])
    for s in r["sources"]:
        out.append(f"- {s['name']}: {s['hit_count']}")
        out += [f"  - {x}" for x in s["best_snippets"]] if detail != "brief" else []
    if detail == "full":
        out += ["", "## Context"] + [f"- {x['source']}, {x['title']}: {x['context']}" for x in r["best_snippets"]]
    return "\n".join(out)


def search_text(chunks: DataFrame, query: str, limit: int = 20) -> str:
    rows = S.search(chunks, query, S.clamp_limit(limit)).collect()
    return "\n".join(f"- [{r['source']}] {r['title']}: {r['snippet']}" for r in rows) or f"No results for {query}"


def report_dict(report: DataFrame) -> dict:
    return json.loads(report_json(report).first()["report"])


def reference_data(chunks: DataFrame, headwords: DataFrame, definitions: DataFrame, forms: DataFrame, term: str) -> DataFrame:
    """One row: term, pinyin, English definitions, dialects, corpus_hits."""
    words = lookup_entries(headwords, term)
    pinyin = words.agg(F.min_by("pinyin", "id").alias("pinyin"))
    defs = definitions_of(headwords, definitions, term).where("lang = 'en'").agg(F.sort_array(F.collect_list(F.struct("source", "definition"))).alias("definitions"))
    said = dialect_forms_of(headwords, forms, term).agg(F.sort_array(F.collect_list(F.struct("dialect", "source", "native_chars", "pronunciation"))).alias("dialects"))
    return pinyin.join(defs).join(said).join(S.count_hits(chunks, term)).select(F.lit(term).alias("term"), "pinyin", "definitions", "dialects", F.col("hits").alias("corpus_hits"))


def prompts(chunks: DataFrame, report: str, term: str, top: int = 5) -> DataFrame:
    """One row: prompts without evidence, with passages, and with the report, and the sizes of the last two's evidence."""
    shown = S.passages(S.search(chunks, term, top), top)
    ask = f"Explain the Chinese word {term}: pinyin, definitions, an example."
    return shown.select(F.lit(term).alias("term"), F.lit(ask).alias("baseline"), F.concat(F.lit(ask + "\n\nPassages:\n"), F.col("passages")).alias("rag"), F.lit(f"{ask}\n\nReport:\n{report}").alias("mcp"), F.length("passages").alias("rag_context_chars"), F.lit(len(report)).alias("mcp_context_chars"))
