"""Tone-marked pinyin to numbered pinyin."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Combining marks of the four tones, the vowels that bear them, initials and finals of syllables.
TONES = {"̄": "1", "́": "2", "̌": "3", "̀": "4"}
VOWELS = "aeiouüAEIOUÜ"
INITIALS = ("zh", "ch", "sh", "b", "p", "m", "f", "d", "t", "n", "l", "g", "k", "h", "j", "q", "x", "z", "c", "s", "r", "y", "w")
FINALS = ("iang", "iong", "uang", "ang", "eng", "ing", "ong", "uai", "uan", "ian", "iao", "ai", "ei", "ao", "ou", "an", "en", "in", "un", "er", "ia", "ie", "iu", "ua", "ue", "ui", "uo", "a", "e", "i", "o", "u", "ü", "v")


@lru_cache(maxsize=1)
def _tables():
    marks = {c: (v, tone) for v in VOWELS for mark, tone in TONES.items() if len(c := unicodedata.normalize("NFC", v + mark)) == 1}
    # an initial, if any, takes part even where no final follows it; other characters separate syllables
    syllable = re.compile(rf"(?P<initial>{'|'.join(INITIALS)})?(?P<final>(?:{'|'.join(FINALS)})(?:n(?![aeiouüv])|ng|r)?)?")
    return marks, syllable


def to_numbered(pinyin: str) -> str:
    """Numbered syllables. Spaced pinyin keeps its case and gives each syllable its last tone; run-together pinyin is
    read greedily in lower case, by initials and finals, and each syllable gets its first tone. 5 is no tone."""
    marks, syllable = _tables()
    if not pinyin:
        return ""
    text = unicodedata.normalize("NFC", pinyin)
    plain = [marks.get(ch, (ch, "")) for ch in text]
    if " " in text:
        out, at = [], 0
        for word in re.finditer(r"\S+", text):
            part = plain[word.start() : word.end()]
            out.append("".join(ch for ch, _ in part) + next((t for _, t in reversed(part) if t), "5"))
        return " ".join(out)
    base = "".join(ch for ch, _ in plain).lower()
    out, at = [], 0
    while at < len(base):
        m = syllable.match(base, at) if base[at] not in "' -" else None
        if not m or not m.group():
            at += 1
            continue
        tone = next((t for _, t in plain[m.start() : m.end()] if t), "5") if m.group("final") else ""
        out.append(m.group() + tone)
        at = m.end()
    return " ".join(out) or text


@F.pandas_udf(T.StringType())
def tone_marked_to_numbered(pinyin: pd.Series) -> pd.Series:
    """to_numbered over a column; null stays null. Syllables are read with state, which column functions can't do."""
    return pinyin.map(lambda p: None if p is None else to_numbered(p))
