"""Which writing systems a definition uses, and whether they fit its language."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import HAN

# Families of scripts as character ranges.
SCRIPTS = {
    "latin": r"\x{0041}-\x{024F}",
    "cyrillic": r"\x{0400}-\x{04FF}",
    "arabic": r"\x{0600}-\x{06FF}",
    "arabic_ext": r"\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}",
    "devanagari": r"\x{0900}-\x{097F}",
    "thai": r"\x{0E00}-\x{0E7F}",
    "cjk": HAN,
    "hangul": r"\x{AC00}-\x{D7AF}",
    "kana": r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}",
    "hebrew": r"\x{0590}-\x{05FF}",
    "greek": r"\x{0370}-\x{03FF}",
}
#: The older audit's ranges: everything up to U+024F is latin, blanks and digits too.
OLD_SCRIPTS = SCRIPTS | {"latin": r"\x{0000}-\x{024F}"}
# Scripts that fit each language; those not named here fit latin alone.
LATIN_LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "sv", "nl", "id", "tl", "vi", "tr", "ms", "pl", "hu", "cs", "ro", "et")
VALID_SCRIPTS = {
    **{lang: ("latin",) for lang in LATIN_LANGUAGES},
    "ru": ("cyrillic", "latin"), "ar": ("arabic", "arabic_ext"), "fa": ("arabic", "arabic_ext"), "hi": ("devanagari", "latin"), "th": ("thai", "latin"),
    "ja": ("cjk", "kana", "latin"), "ko": ("cjk", "hangul", "latin"), "el": ("greek", "latin"),
}
# Latin words that any language may use.
UNIVERSAL = (
    "DNA RNA USB LED GPS SMS TV CD DVD MP3 WiFi HTTP HTTPS URL PDF API CPU GPU RAM SIM PIN ATM VPN HDMI JPEG PNG GIF IP "
    "mg kg km cm mm nm pm mL dL kL mA kW MW GW Hz kHz MHz GHz dB GB MB TB KB pH rpm"
).split()

# The frames in which Han characters count as a reference to a word. C stands for a run of them.
# Words (any case) that are followed, somewhere after white space, by a run.
NAMING_WORDS = (
    "variant|old variant|archaic variant|ancient variant|ancient form|old form|same as|see also|see |abbr\\b|abbrev|abbreviation|short for|component|radical|character|notation|form|surname|family name|given name|name",
    "Variante|Kurzform|Abkürzung|Bestandteil|Zeichen|Schreibweise|Notation",
    "variante|abréviation|composant|caractère|notation|forme",
    "variante|abreviatura|componente|carácter|notación|forma",
    "variante|abreviatura|componente|caractere|notação|forma",
    "variante|abbreviazione|componente|carattere|notazione|forma",
    "variant|förkortning|komponent|tecken|notation|form",
    "variant|afkorting|component|karakter|notatie|vorm",
    "varian|singkatan|komponen|karakter|notasi|bentuk",
    "baryante|pagdadaglat|bahagi|karakter|notasyon|anyo",
    "вариант|сокращение|компонент|иероглиф|запись|форм\\w*",
    "biến thể|dạng cũ|dạng cổ|viết tắt|thành phần",
    "varyant\\w*|kısaltma\\w*|bileşen\\w*|karakter\\w*|biçim\\w*|şekil\\w*",
    "wariant|skrót|komponent|znak|forma|zapis",
    "varianta|zkratka|složka|znak|forma|zápis",
    "változat\\w*|rövidítés\\w*|összetevő\\w*|karakter\\w*|alak\\w*|jelölés\\w*",
    "variantă|abreviere|componentă|caracter|formă|notație",
    "varian|singkatan|komponen|aksara|bentuk|notasi",
)
# The same for words whose case counts.
NAMING_WORDS_EXACT = (
    "شكل|بديل|مكون|عنصر|اختصار|واریانت|نوع|صورة",
    "واریانت|شکل|مخفف|جزء|عنصر|کاراکتر",
    "रूप|प्रकार|संक्षेप|घटक|संस्करण",
    "รูปแบบ|ตัวย่อ|ส่วนประกอบ|อักษร|แบบ",
    "παραλλαγή|συντομογραφία|στοιχείο|χαρακτήρας|μορφή|σύντμηση",
)
# Other frames: (pattern, whether case is ignored).
FRAMES = (
    (r"(C)\s*(?:radical|component|stroke)", True),
    (r"(C)の(?:異体字|旧字体|略字|別字|俗字|本字|正字)", False),
    (r"(?:異体字|旧字体|略字|別字|古字).*?(C)", False),
    (r"(C)의\s*(?:이체자|약자|속자|본자|정자|변형)", False),
    (r"(?:이체자|약자|속자).*?(C)", False),
    (r"(?:variant\w*|lühend\w*|komponent\w*|märk\w*|vorm\w*|tähistus\w*|koostisosa\w*|variandi\w*)[/\s].*?(C)", True),
    (r"(C)\s+(?:variandi\w*|koostisosa\w*)", True),
    (r"(?:of|de|di|von|van|av|dari|ng|của|의|の|ของ|для|für|pour|para|per|för)\s+(C)", False),
    (r"(?:used|verwendet|utilisé|usado|usato|gebruikt|används|digunakan|ginagamit|dùng|используется|ใช้ใน|يُستخدم في|استفاده در|में प्रयुक्त|kullanıl\w*|używany|używane|używana|używano|používá\w*|používaný|használ\w*|utilizat|kasutatav|χρησιμοποιείται|yalnızca)\s+(?:\w+\s+){0,3}(C)", True),
    (r"(?:dalam|في|در|trong|ใน)\s+(C)", False),
    (r"(C)\s*(?:में|ใน|에서|का|की|के|の|의|를|을|が|は|を)", False),
    (r"(C)\s*[/／、，,]\s*(C)", False),
    (r"(C)\s*(?:and|or|و|и|dan|at|và|und|et|y|e|i|och|en|og|ve|és|a|și|ja|kai|και|lub|nebo|vagy|sau|või|veya)\s+(C)", False),
    (r"(?:after|nach|après|después|dopo|na|efter|setelah|pagkatapos|sau|後|بعد|के बाद|หลัง)\s+(C)", True),
    (r"(?:الاسم|الشخصي|نام|नाम|ชื่อ|이름|名前|nome|nom|name|Name|naam|namn).*?(C)", True),
    (r"(?:lihat|siehe|voir|ver|vedere|se|zie|tingnan|xem|انظر|देखें|ดู|görünce|patrz|viz|lásd|a se vedea|vaata|βλέπε|bak\w*|bkz)\W*\s*(C)", True),
    (r"(C)(?:\[[\w]+\])?[''ʼ]\w+\s+(?:varyant\w*|bileşik\w*|bakınız|bak\w*)", True),
    (r"(C)(?:\s*\([^)]*\))?\s+bileşik\w*\s+\w+\s+kullanıl\w*", True),
    (r"(C)\s+(?:bedeutet|means|significa|signifie|означает|berarti|bermaksud|หมายถึง|anlamına|znamená|oznacza|jelent|înseamnă|tähendab|σημαίνει)", True),
    (r"(?:synonym\w*|synonim\w*|sinónim\w*|sinonim\w*|συνώνυμο\w*|синоним\w*|sünonüüm\w*)\s+(?:\w+\s+){0,3}(C)", True),
    (r"(?:kształt|tvar|shape|forme?|Gestalt|alak|biçim|tüüp)\s+(C)", True),
    (r"(C)\s+(?:régi|alte?|vieille?|antigua?|antiga?|vecchi[ao]|gamla|oude|lama|lumang|cũ|ancien|eski|stara|starý|vechi|vana)\s", True),
    (r"(C)\s+régi\s+\w+", True),
    (r"(C)\s+\w+\s+(?:használt|używany|używane|používaný|kullanılan|utilizat|kasutatav|χρησιμοποιείται|gebruikt|utilisé|используется)", True),
    (r"(C)\s+\w+\s+(?:bileşeni|parçası|součástí|składnikiem|összetevője|componentă|komponendiks|στοιχείο)", True),
    (r"(C)\s+\w+(?:nin|nın|nun|nün|nin|inin|unun|ünün)\s+\w+", True),
    (r"используется\s+(?:в|при|для)\s+(C)", False),
)


@lru_cache(maxsize=1)
def _frames() -> tuple[re.Pattern, list[re.Pattern]]:
    run = "[一-鿿㐀-䶿\U00020000-\U0002a6df]+"
    naming = [(rf"(?:{words})\s.*?(C)", True) for words in NAMING_WORDS] + [(rf"(?:{words})\s.*?(C)", False) for words in NAMING_WORDS_EXACT]
    return re.compile(run), [re.compile(p.replace("(C)", f"({run})"), re.IGNORECASE if any_case else 0) for p, any_case in (*naming, *FRAMES)]


def only_refers(text: str) -> bool:
    """Whether each run of Han characters of a text stands in a frame that refers to a word."""
    run, frames = _frames()
    left = set(run.findall(text))
    for frame in frames:
        if not left:
            break
        for m in frame.finditer(text):
            left.difference_update(run.findall(m.group(0)))
    return not left


@F.pandas_udf(T.BooleanType())
def cjk_is_reference(text: pd.Series) -> pd.Series:
    """only_refers over a column. Python's regular expressions decide here, so that words and cases count as they do there."""
    return text.map(lambda t: t is None or only_refers(t)).astype(bool)


def scripts(c: Column, ranges: dict[str, str] = SCRIPTS) -> Column:
    """The families of scripts that a text uses, as an array in the order of ranges."""
    return F.array_compact(F.array(*(F.when(c.rlike(f"[{chars}]"), name) for name, chars in ranges.items())))


def valid_scripts(lang: Column) -> Column:
    """The families that fit a language, or null for a language that isn't known."""
    out = None
    for scripts_of in dict.fromkeys(VALID_SCRIPTS.values()):
        test = lang.isin(*(k for k, v in VALID_SCRIPTS.items() if v == scripts_of))
        value = F.array(*map(F.lit, scripts_of))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def invalid_scripts(lang: Column, text: Column, ranges: dict[str, str] = SCRIPTS) -> Column:
    """Families that a text uses and its language doesn't fit; none for empty texts and unknown languages."""
    found = F.array_except(scripts(text, ranges), valid_scripts(lang))
    return F.coalesce(F.when(text != "", found), F.array().cast("array<string>"))


def latin_is_acceptable(c: Column) -> Column:
    """Whether all Latin words are single letters, universal, short acronyms, capitalised, or of a text with a binomial."""
    words = F.regexp_extract_all(c, F.lit("([a-zA-Z]+)"), F.lit(1))
    known = F.array(*map(F.lit, UNIVERSAL))
    binomial = c.rlike(r"[A-Z][a-z]{2,}\s+[a-z]{2,}")
    fine = lambda w: (F.length(w) == 1) | F.array_contains(known, w) | F.array_contains(known, F.upper(w)) | w.rlike("^[A-Z]{2,6}$") | w.rlike("^[A-Z][a-z]+$") | (binomial & w.rlike("^[a-z]{2,}$"))
    return F.forall(words, fine)


def validate(lang: Column, text: Column) -> Column:
    """The scripts that make a definition invalid, none if it is valid.

    Han characters that only refer to words are no contamination, nor are acceptable Latin words in Arabic and Persian.
    Python looks only at rows whose one invalid script is Han.
    """
    bad = invalid_scripts(lang, text)
    none = F.array().cast("array<string>")
    only_cjk, only_latin = bad == F.array(F.lit("cjk")), bad == F.array(F.lit("latin"))
    refers = cjk_is_reference(F.when(only_cjk, text))
    return F.when(only_cjk & refers, none).when(only_latin & lang.isin("ar", "fa") & latin_is_acceptable(text), none).otherwise(bad)


def validate_map(definitions: Column) -> Column:
    """Struct of clean and rejected: a map from language to definition, split by invalid_scripts with the native exemption."""
    bad = lambda k, v: (F.size(invalid_scripts(k, v)) > 0) & ~(k.isin("ar", "fa") & (invalid_scripts(k, v) == F.array(F.lit("latin"))) & latin_is_acceptable(v))
    return F.struct(F.map_filter(definitions, lambda k, v: ~bad(k, v)).alias("clean"), F.map_filter(definitions, bad).alias("rejected"))
