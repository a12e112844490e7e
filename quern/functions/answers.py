"""Prompts for translators and parsers of what they answer."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Target languages in order, with their names.
LANGUAGE_NAMES = {
    "en": "English", "de": "German", "fr": "French", "es": "Spanish", "sv": "Swedish", "ja": "Japanese", "ko": "Korean", "ru": "Russian", "id": "Indonesian",
    "vi": "Vietnamese", "tl": "Tagalog", "fa": "Persian", "nl": "Dutch", "pt": "Portuguese", "ar": "Arabic", "th": "Thai", "hi": "Hindi", "it": "Italian",
    "tr": "Turkish", "ms": "Malay", "pl": "Polish", "hu": "Hungarian", "cs": "Czech", "el": "Greek", "ro": "Romanian", "et": "Estonian",
}
TARGETS = tuple(LANGUAGE_NAMES)


def language_name(lang: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, lang), lang)


def context_lines(definitions: Column, indent: str = "  ", empty: str = "(none)") -> Column:
    """A map from language to definition as indented lines."""
    lines = F.transform(F.map_entries(definitions), lambda e: F.concat(F.lit(indent), language_name(e["key"]), F.lit(": "), e["value"]))
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise(indent + empty)


def entry_prompt(traditional: Column, simplified: Column, pinyin: Column, pos: Column, definitions: Column, langs: Column, examples: Column | None = None) -> Column:
    """A prompt for one entry in all of langs."""
    shown = F.lit("")
    if examples is not None:
        shown = F.when(F.coalesce(F.size(examples), F.lit(0)) > 0, F.concat(F.lit("\nExample sentences:\n"), F.array_join(F.transform(examples, lambda x: F.concat(F.lit("  "), x)), "\n"), F.lit("\n"))).otherwise("")
    asked = F.array_join(F.transform(langs, lambda x: F.concat(x, F.lit(":"))), "\n")
    head = F.concat(F.lit("Chinese: "), traditional, F.lit(" / "), simplified, F.lit("\nPinyin: "), pinyin, F.lit("\nPOS: "), F.coalesce(F.nullif(pos, F.lit("")), F.lit("unknown")))
    return F.concat(head, F.lit("\n\nExisting definitions:\n"), context_lines(definitions), shown, F.lit("\nWrite one line for each language, as xx: first/second.\n\n"), asked)


def verify_prompt(traditional: Column, simplified: Column, pinyin: Column, pos: Column, lang: Column, current: Column, definitions: Column) -> Column:
    """A prompt to check one definition against those in other languages."""
    others = F.map_filter(definitions, lambda k, _: k != lang)
    return F.concat(F.lit("Chinese: "), traditional, F.lit(" / "), simplified, F.lit("\nPinyin: "), pinyin, F.lit("\nPOS: "), F.coalesce(F.nullif(pos, F.lit("")), F.lit("unknown")), F.lit("\nLanguage: "), language_name(lang), F.lit("\nCurrent definition: "), current, F.lit("\nOther definitions:\n"), context_lines(others))


def backfill_block(number: Column, traditional: Column, simplified: Column, pinyin: Column, definitions: Column, missing: Column) -> Column:
    """One numbered entry of a prompt that asks for missing languages only; known ones come in the order of TARGETS."""
    known = F.filter(F.transform(F.array(*map(F.lit, TARGETS)), lambda k: F.concat(F.lit("   "), k, F.lit(": "), F.try_element_at(definitions, k))), lambda x: x.isNotNull())
    shown = F.when(F.size(known) > 0, F.array_join(known, "\n")).otherwise("   (none)")
    asked = F.array_join(F.transform(missing, lambda k: F.concat(F.lit("   "), k, F.lit(":"))), "\n")
    return F.concat(number.cast("string"), F.lit(". "), traditional, F.lit(" / "), simplified, F.lit("\n   Pinyin: "), pinyin, F.lit("\n   Existing translations:\n"), shown, F.lit("\n   Missing:\n"), asked)


# -- answers


def lines_of(answer: str, langs) -> list[str]:
    """Stripped lines, where a /xx: of a known language starts a line of its own. Blank lines stay."""
    border = re.compile("/(?=(?:" + "|".join(map(re.escape, sorted(langs))) + "):)")
    return [part for line in answer.strip().split("\n") for part in border.split(line.strip())]


def tidy(definition: str) -> str:
    """Without quotes around it and one slash at each end."""
    out = definition.strip()
    if out[:1] == '"' and out[-1:] == '"':
        out = out[1:-1]
    return out.removeprefix("/").removesuffix("/").strip()


def field(line: str) -> tuple[str, str]:
    lang, colon, rest = line.partition(":")
    return (lang.strip().lower(), rest) if colon else ("", "")


def parse_answer(answer: str | None, langs=TARGETS) -> dict[str, str]:
    """Definitions by language; the last line of a language counts, unknown languages don't."""
    found = (field(line) for line in lines_of(answer or "", langs))
    return {lang: text for lang, rest in found if lang in langs and (text := tidy(rest))}


def _number(line: str) -> str | None:
    """What follows an entry's number, or None if the line has none."""
    head, dot, rest = line.partition(".")
    return rest.strip() if line[:1].isdigit() and dot and head.strip().isdigit() else None


def parse_batch(answer: str | None, count: int, langs=TARGETS) -> list[dict[str, str]]:
    """Definitions of count numbered entries. A number ends the entry before it only if that has any; missing ones are empty.

    What stands behind a number isn't tidied.
    """
    out: list[dict[str, str]] = [{}]
    for line in lines_of(answer or "", langs):
        rest = _number(line.strip())
        if rest is not None and out[-1]:
            out.append({})
        lang, text = field(line.strip() if rest is None else rest)
        text = tidy(text) if rest is None else text.strip()
        if lang in langs and text:
            out[-1][lang] = text
    return (out + [{}] * count)[:count]


def parse_backfill(answer: str | None, missing: list[list[str]]) -> list[dict[str, str]]:
    """Definitions of entries in the languages that each misses. Entries are numbered, or else end at blank lines."""
    lines = [line.strip() for line in lines_of(answer or "", TARGETS)]
    numbered = any(line[:1].isdigit() and "." in line.split(" ")[0] for line in lines)
    out: list[dict[str, str]] = [{}]
    for line in lines:
        rest = _number(line) if numbered else None
        ends = rest is not None if numbered else not line
        if ends and out[-1]:
            out.append({})
        lang, text = field(line if rest is None else rest)
        if len(out) <= len(missing) and lang in missing[len(out) - 1] and (text := tidy(text)):
            out[-1][lang] = text
    return (out + [{}] * len(missing))[: len(missing)]


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def parsed_answer(answer: pd.Series) -> pd.Series:
    return answer.map(parse_answer)


@F.pandas_udf(T.ArrayType(T.MapType(T.StringType(), T.StringType())))
def parsed_batch(answer: pd.Series, count: pd.Series) -> pd.Series:
    """Entries are read with state from line to line, which column functions can't do."""
    return pd.Series([parse_batch(a, int(n)) for a, n in zip(answer, count, strict=True)])


@F.pandas_udf(T.ArrayType(T.MapType(T.StringType(), T.StringType())))
def parsed_backfill(answer: pd.Series, missing: pd.Series) -> pd.Series:
    return pd.Series([parse_backfill(a, [list(x) for x in m]) for a, m in zip(answer, missing, strict=True)])
