"""Filling of missing definitions by a translator: a function from prompts to answers that the caller gives.

No translator is part of the library; offline() is a stand-in for tests. Calls run in batches on the workers, with
retries, and never while a plan is built.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import answers as A
from quern.functions import scripts as G
from quern.functions import text as X
from quern.operators import lexicon as L

Translator = Callable[[list[str]], list[str]]


class RateLimited(Exception):
    """What a translator raises when it is asked too often."""


def offline(prompts: list[str]) -> list[str]:
    """Answers each requested language with a text made of its code, without any network."""
    out = []
    for p in prompts:
        asked = [line.strip()[:-1] for line in p.split("\n") if line.strip().endswith(":") and line.strip()[:-1] in A.TARGETS]
        out.append("\n".join(f"{lang}: {lang} gloss" for lang in asked))
    return out


def fit_length(answers: list[str], count: int) -> list[str]:
    """count answers: missing ones empty, further ones dropped."""
    return (list(answers) + [""] * count)[:count]


def call(translator: Translator, prompts: list[str], retries: int = 3, wait: float = 10.0) -> list[str]:
    """Answers to prompts; waits 1, 2, … times wait before each retry of a limited call, then gives up with ''."""
    for attempt in range(retries + 1):
        try:
            return fit_length(translator(prompts), len(prompts))
        except RateLimited:
            if attempt < retries:
                time.sleep(wait * (attempt + 1))
    return [""] * len(prompts)


def ask(rows: DataFrame, translator: Translator, prompt_col: str = "prompt", answer_col: str = "answer", batch: int = 20, spacing: float = 0.0) -> DataFrame:
    """rows with the translator's answers. spacing is the least time between calls of one worker."""
    schema = rows.withColumn(answer_col, F.lit("")).schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0
        for pdf in parts:
            found: list[str] = []
            for lo in range(0, len(pdf), batch):
                time.sleep(max(0.0, last + spacing - time.monotonic()) if last else 0.0)
                last = time.monotonic()
                found += call(translator, pdf[prompt_col].iloc[lo : lo + batch].tolist())
            yield pdf.assign(**{answer_col: found})

    return rows.mapInPandas(run, schema)


def backfill(headwords: DataFrame, definitions: DataFrame, translator: Translator, langs: list[str], size: int = 20, batches: int = 1, source: str = "minimax", include_zero: bool = False) -> tuple[DataFrame, DataFrame]:
    """New definitions and rejected ones of the next size * batches entries: ask, parse, keep asked languages, validate scripts."""
    work = L.backfill_work(headwords, definitions, langs, size * batches, source, include_zero)
    prompt = A.backfill_block(F.lit(1), F.col("traditional"), F.col("simplified"), F.col("pinyin"), F.col("existing_defs"), F.col("missing_langs"))
    answered = ask(work.select("headword_id", "missing_langs", prompt.alias("prompt")), translator)
    parsed = answered.select("headword_id", F.explode(A.parsed_backfill("answer", F.array("missing_langs"))).alias("m")).select("headword_id", F.explode("m").alias("lang", "definition"))
    checked = parsed.withColumns({"source": F.lit(source), "invalid": G.validate(F.col("lang"), F.col("definition"))})
    return checked.where(F.size("invalid") == 0).drop("invalid"), checked.where(F.size("invalid") > 0)


def retranslate_work(headwords: DataFrame, definitions: DataFrame, ids: DataFrame | None = None, single_only: bool = True, done: str = "v2", force: bool = False) -> DataFrame:
    """Headwords to translate again, with their scope: by ids if given, most frequent first; those done are left out."""
    rows = headwords if ids is None else headwords.join(ids.select("id"), "id", "left_semi")
    rows = rows.where(F.length("simplified") == 1) if single_only else rows
    if not force:
        rows = rows.join(definitions.where(F.col("confidence") == done).select(F.col("headword_id").alias("id")), "id", "left_anti")
    first = definitions.where("lang = 'en'").groupBy("headword_id").agg(F.min_by("definition", "id").alias("en"))
    rows = rows.join(first, rows["id"] == first["headword_id"], "left").drop("headword_id")
    if "sfreq" not in rows.columns:
        rows = rows.withColumn("sfreq", F.lit(None).cast("long"))
    return rows.withColumn("scope", X.scope(F.col("pinyin"), F.coalesce("en", F.lit("")))).orderBy(F.desc_nulls_last("sfreq"), "id")
