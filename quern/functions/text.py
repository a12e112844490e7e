"""Text expressions: cleaning, chunking, tokens, phrases, dictionary fields. All are Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentence ends, the least chunk length, the marker of idiom blanks.
SENTENCE_ENDS = "。！？；"
MIN_CHUNK_CHARS = 4
IDIOM_MARKER = r"#idiom\d*#"
#: What Python's str.strip() takes for white space.
SPACE = r"[\s\x1c-\x1f\x85]"
HAN = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}"


def strip(c: Column) -> Column:
    """c without white space at its ends, Unicode white space included."""
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def blank(c: Column) -> Column:
    """True for null, empty and all-white text."""
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def clean_idiom_markers(c: Column) -> Column:
    return F.regexp_replace(c, IDIOM_MARKER, "")


def content_hash(c: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in hex."""
    return F.sha2(c.cast("binary"), 256)


def pieces(c: Column, ends: str = SENTENCE_ENDS) -> Column:
    """Stripped pieces of a text, each up to one sentence end; blank ones are dropped."""
    cut = F.split(strip(c), f"(?<=[{ends}])")
    return F.filter(F.transform(cut, strip), lambda x: x != "")


def chunks(c: Column, min_chars: int = MIN_CHUNK_CHARS, ends: str = SENTENCE_ENDS) -> Column:
    """Sentence chunks: pieces shorter than min_chars are put before the next piece, a short rest is put to the last chunk.

    Long chunks stay whole. Null gives null, a blank text an empty array.
    """
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("rest"))

    def add(state: Column, piece: Column) -> Column:
        text = F.concat(state["rest"], piece)
        full = F.length(text) >= min_chars
        return F.struct(F.when(full, F.concat(state["out"], F.array(text))).otherwise(state["out"]).alias("out"), F.when(full, F.lit("")).otherwise(text).alias("rest"))

    def end(state: Column) -> Column:
        out, rest = state["out"], state["rest"]
        n = F.size(out)
        longer = F.concat(F.slice(out, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.try_element_at(out, F.lit(-1)), rest)))
        return F.when(rest == "", out).when(n == 0, F.array(rest)).otherwise(longer)

    return F.aggregate(pieces(c, ends), start, add, end)


def tokens(c: Column) -> Column:
    """Lower-case tokens in order: each Han, kana or Hangul character, and each run of other letters or digits."""
    single = rf"{HAN}\x{{3040}}-\x{{30FF}}\x{{AC00}}-\x{{D7AF}}"
    # one class cut out of another instead of a lookahead before each character
    return F.regexp_extract_all(F.lower(c), F.lit(rf"[{single}]|[\p{{L}}\p{{N}}&&[^{single}]]++"), F.lit(0))


def has_token(c: Column) -> Column:
    """Whether a text has any token; found at its first letter or digit."""
    return F.rlike(c, F.lit(rf"[\p{{L}}\p{{N}}{HAN}\x{{3040}}-\x{{30FF}}\x{{AC00}}-\x{{D7AF}}]"))


def token_line(c: Column) -> Column:
    """Tokens between single spaces, with a space at both ends, so that a phrase of tokens is a substring."""
    return F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" "))


def has_phrase(line: Column, term: str) -> Column:
    """Whether a token line has a term's tokens in a row; a term without tokens is in none."""
    return (F.size(tokens(F.lit(term))) > 0) & F.contains(line, token_line(F.lit(term)))


def phrase_query(term: str) -> str:
    """The adjacency query of a term: its characters as tokens, in quotes. Quotes in the term are doubled."""
    return '"' + " ".join(ch.replace('"', '""') for ch in term) + '"'


def is_cjk(term: str) -> bool:
    return bool(term) and all(0x3400 <= ord(ch) <= 0x9FFF or 0x20000 <= ord(ch) <= 0x2A6DF for ch in term)


def phrase(c: Column, term: str) -> Column:
    """Whether a text has the term's tokens next to each other, whatever stands between tokens.

    For Han terms a substring test comes first; only texts that fail it but have all characters are tokenised.
    """
    if not term.strip():
        return F.lit(False)
    whole = has_phrase(token_line(c), term)
    if is_cjk(term):
        return c.contains(term) | (every_character(c, term) & whole)
    plain = max(re.findall("[a-z0-9]+", term.lower()), key=len, default="")
    # a cheap test that every text with the phrase passes goes first
    return F.contains(F.lower(c), F.lit(plain)) & whole if plain else whole


def every_character(c: Column, term: str) -> Column:
    """Whether a text has all characters of a term, adjacent or not."""
    out = F.lit(bool(term.strip()))
    for ch in dict.fromkeys(term):
        out = out & c.contains(ch)
    return out


def highlight(c: Column, term: str, left: str = "[", right: str = "]") -> Column:
    return F.replace(c, F.lit(term), F.lit(f"{left}{term}{right}")) if term else c


def snippet(c: Column, snippet_tokens: int = 64) -> Column:
    """The first 4 * snippet_tokens characters."""
    return F.substring(c, 1, 4 * snippet_tokens)


# -- dictionary fields


def normalize_pinyin(c: Column) -> Column:
    """u: and ü become v, white space collapses, case stays (capitals mark names)."""
    return F.regexp_replace(F.replace(F.replace(strip(c), F.lit("u:"), F.lit("v")), F.lit("ü"), F.lit("v")), rf"(?U){SPACE}+", " ")


def compare_pinyin(c: Column) -> Column:
    """Lower-case letters, then digits, so that tone places don't matter."""
    low = F.lower(c)
    return F.concat(F.regexp_replace(low, "[^a-z]", ""), F.regexp_replace(low, "[^0-9]", ""))


def strip_toneless_suffix(c: Column) -> Column:
    """Drop a trailing " (superscript pinyin)5"."""
    return strip(F.regexp_replace(c, r" \([^)]*[¹²³⁴⁵][^)]*\)5\s*$", ""))


def pos_from_definition(c: Column) -> Column:
    """Part of speech by the first of: classifier list, verb, particle, classifier, a phrase in parentheses."""
    first = strip(F.split(c, "/")[0])
    low = F.lower(first)
    return (
        F.when(F.coalesce(c, F.lit("")) == "", F.lit(None).cast("string"))
        .when(c.contains("CL:"), "noun")
        .when(first.startswith("to "), "verb")
        .when(low.contains("particle"), "particle")
        .when(low.contains("(classifier"), "classifier")
        .when(first.startswith("(") & first.endswith(")"), "phrase")
    )


def pos_from_entry(c: Column) -> Column:
    """Part of speech at import: verb comes before the classifier list, and the whole string must be in parentheses."""
    return F.when(c.startswith("to "), "verb").when(c.contains("CL:"), "noun").when(c.startswith("(") & c.endswith(")"), "phrase")


def merge_pos(old: Column, new: Column) -> Column:
    return F.coalesce(F.nullif(old, F.lit("")), new)


def is_pure_cjk(c: Column) -> Column:
    """Only characters of U+4E00 to U+9FFF, and at least one."""
    return F.coalesce(c.rlike(r"\A[\x{4E00}-\x{9FFF}]+\z"), F.lit(False))


# Parts of speech by what their names contain, in this order ("adverb" is therefore a verb).
POS_NAMES = (
    ("verb", "verb"), ("noun", "noun"), ("adjective", "adj"), ("adverb", "adv"), ("conjunction", "conj"), ("interjection", "intj"),
    ("particle", "particle"), ("pronoun", "pronoun"), ("counter", "classifier"), ("suffix", "suffix"), ("prefix", "prefix"), ("expression", "phrase"),
)


def map_pos(c: Column) -> Column:
    low, out = F.lower(c), None
    for name, pos in POS_NAMES:
        test = low.contains(name)
        if name == "adjective":
            test = test | F.array_contains(F.split(low, r"\s+"), "adj")
        out = F.when(test, pos) if out is None else out.when(test, pos)
    return out


def is_capitalised(c: Column) -> Column:
    """A pinyin that starts with a capital is a proper noun's."""
    return F.coalesce(F.substring(c, 1, 1).rlike(r"^\p{Lu}"), F.lit(False))


# Phrases of definitions that tell a word of narrow use.
NARROW = ("surname", "only used in", "variant of", "abbr. for", "old variant", "used in place name")


def is_narrow(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike("|".join(x.replace(".", r"\.") for x in NARROW)), F.lit(False))


def scope(pinyin: Column, definition: Column) -> Column:
    """narrow_name, narrow, name or general."""
    name, narrow = is_capitalised(pinyin), is_narrow(definition)
    return F.when(name & narrow, "narrow_name").when(narrow, "narrow").when(name, "name").otherwise("general")


def has_odd_character(c: Column) -> Column:
    """A character from U+30000 on, or one that describes a composition."""
    return F.coalesce(c.rlike(r"[\x{30000}-\x{10FFFF}\x{2FF0}-\x{2FFF}]"), F.lit(False))


# -- glosses

# Leading articles dropped from glosses, and the languages they are dropped in.
ARTICLES = ("to ", "a ", "an ", "the ", "le ", "la ", "les ", "l'", "un ", "une ", "der ", "die ", "das ", "ein ", "eine ")
ARTICLE_LANGUAGES = ("en", "de", "fr", "es", "id")


def split_glosses(c: Column) -> Column:
    """Senses of a definition: parts between ; and /, without classifier lists and bare qualifiers."""
    parts = F.transform(F.split(F.regexp_replace(strip(c), r"\A/+|/+\z", ""), "[;/]"), strip)
    return F.filter(parts, lambda p: (p != "") & ~p.rlike(r"^CL[:：]") & ~p.rlike(r"^\([A-Z][a-z]+(?:,\s*[A-Z][a-z]+)*\)$"))


def normalize_gloss(c: Column, lang: Column) -> Column:
    """Lower case, without one leading article, parentheses and doubled spaces."""
    low = strip(F.lower(c))
    bare = F.when(lang.isin(*ARTICLE_LANGUAGES), F.regexp_replace(low, "^(?:" + "|".join(ARTICLES) + ")", "")).otherwise(low)
    return strip(F.regexp_replace(F.regexp_replace(bare, r"(?U)\s*\([^)]*\)\s*", " "), r"(?U)\s+", " "))


def glosses_match(a: Column, b: Column) -> Column:
    """Equal, one inside the other, or half of the shorter one's words shared."""
    words = lambda x: F.filter(F.array_distinct(F.split(x, r"(?U)\s+")), lambda w: w != "")
    shared = F.size(F.array_intersect(words(a), words(b))) / F.greatest(F.least(F.size(words(a)), F.size(words(b))), F.lit(1))
    return F.contains(a, b) | F.contains(b, a) | (shared >= 0.5)


def gloss_overlap(reference: Column, candidate: Column, lang: Column) -> Column:
    """Struct of matched_ref, total_ref, matched_llm, total_llm, sense_coverage, false_sense_rate of two arrays of glosses."""
    clean = lambda xs: F.filter(F.transform(xs, lambda g: normalize_gloss(g, lang)), lambda g: g != "")
    ref, own = clean(reference), clean(candidate)
    hit_ref = F.size(F.filter(ref, lambda r: F.exists(own, lambda x: glosses_match(r, x))))
    hit_own = F.size(F.filter(own, lambda x: F.exists(ref, lambda r: glosses_match(x, r))))
    empty = F.size(ref) == 0
    return F.struct(
        F.when(empty, 0).otherwise(hit_ref).alias("matched_ref"), F.size(ref).alias("total_ref"),
        F.when(empty, 0).otherwise(hit_own).alias("matched_llm"), F.size(own).alias("total_llm"),
        F.when(empty, 1.0).otherwise(F.try_divide(hit_ref, F.size(ref))).alias("sense_coverage"),
        F.when(empty | (F.size(own) == 0), 0.0).otherwise(1 - F.try_divide(hit_own, F.size(own))).alias("false_sense_rate"),
    )


def is_gloss_format(c: Column) -> Column:
    """One to five segments between ; and /, each of at most five words and without a final stop."""
    parts = F.filter(F.transform(F.split(strip(c), "[;/]"), strip), lambda p: p != "")
    fine = F.forall(parts, lambda p: ~p.rlike("[.!?。！？]$") & (F.size(F.split(p, r"(?U)\s+")) <= 5))
    return F.coalesce(F.size(parts).between(1, 5) & fine, F.lit(False))


def clean_definition(c: Column) -> Column:
    """A definition for display: without classifier and pronunciation notes and doubled slashes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "/(?:CL|KP):[^/]*", ""), "/{2,}", "/"), r"\A/+|/+\z", "")


# -- model answers


def strip_thinking(c: Column, least: int = 50) -> Column:
    """Without <think> blocks; if at most least characters are left, what is inside the first block. Other texts stay."""
    rest = strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))
    closed = c.rlike(r"(?s)<think>.*?</think>")
    inside = strip(F.regexp_extract(c, r"(?s)<think>(.*?)</think>", 1))
    return F.when(~c.contains("<think>"), c).when(F.length(rest) > least, rest).when(closed, inside).otherwise(strip(c))


def clean_answer(c: Column) -> Column:
    """Without a leading number, one pair of double quotes if both ends have one, and one slash at each end."""
    bare = strip(F.regexp_replace(strip(c), r"^\d+\s*\.\s*", ""))
    return strip(F.regexp_replace(F.regexp_replace(bare, r'(?s)\A"(.*)"\z', "$1"), r"\A/|/\z", ""))


def without_cjk(c: Column) -> Column:
    """Context without Han characters and the doubled spaces that they leave."""
    return strip(F.regexp_replace(F.regexp_replace(c, f"[{HAN}]", ""), " {2,}", " "))


# How answers write pinyin with numbers, and the letters of pinyin with marks.
NUMBERED = (r"\(([a-z]+\d[a-z\s\d]*)\)", r"\[([a-z]+\d[a-z\s\d]*)\]", r"[Pp]inyin:?\s*([a-z]+\d[a-z\s\d]*)")
MARKED = "aāáǎàeēéěèiīíǐìoōóǒòuūúǔùüǖǘǚǜ"
PLAIN = "aaaaaeeeeeiiiiiooooouuuuuvvvvv"


def number_tones(c: Column) -> Column:
    """Pinyin with marks as letters with the tone's number at the end of each run of letters; ü becomes v."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))

    def one(run: Column) -> Column:
        marks = F.regexp_replace(run, "[^āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜ]", "")
        last = F.right(marks, F.lit(1))
        tone = F.when(marks == "", "").otherwise(((F.instr(F.lit("āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜ"), last) - 1) % 4 + 1).cast("string"))
        return F.concat(F.translate(run, MARKED, PLAIN), tone)

    return F.array_join(F.transform(runs, one), "")


def extract_pinyin(c: Column) -> Column:
    """The first pinyin that an answer names: numbered in parentheses, in brackets or after its label, else with marks after the label."""
    letter = r"[a-zA-Zāáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜü]"
    tries = [F.nullif(strip(F.regexp_extract(c, t, 1)), F.lit("")) for t in NUMBERED]
    marked = F.regexp_extract(c, rf"[Pp]inyin[:\s]*\*?\*?\s*({letter}+(?:\s+{letter}+)*)", 1)
    return F.coalesce(*tries, F.nullif(number_tones(strip(marked)), F.lit("")))


def extract_definitions(c: Column) -> Column:
    """Lower-case text of numbered and bulleted lines, and of lines that name a definition or a meaning, after the colon."""
    lines = F.transform(F.split(c, "\n"), strip)
    listed = lambda x: x.rlike(r"^(?:\d+\.|[-*])")
    of_list = lambda x: strip(F.regexp_replace(x, r"(?U)^[\d.)\-*\s]+", ""))
    of_label = lambda x: strip(F.regexp_replace(x, r"(?U).*?:\s*", ""))
    named = lambda x: F.lower(x).rlike("definition|meaning")
    found = F.transform(lines, lambda x: F.when(listed(x), F.when(F.length(of_list(x)) > 2, of_list(x))).when(named(x), F.nullif(of_label(x), F.lit(""))))
    return F.transform(F.array_compact(found), F.lower)


def judge_scores(c: Column) -> Column:
    """The first three digits from 1 to 5, or null if there are fewer."""
    found = F.slice(F.regexp_extract_all(c, F.lit("([1-5])"), F.lit(1)), 1, 3)
    return F.when(F.size(found) == 3, F.transform(found, lambda x: x.cast("int")))


# Characters that a text must have one of, or five letters, not to count as an echo in Japanese.
KANA_SIGNS = "ァ-ヶぁ-ゖー"
CJK_LEAK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]"
HANGUL = r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}"


def answer_issues(lang: Column, answer: Column) -> Column:
    """Flags of a translated answer: CJK_LEAK, NON_HANGUL:<first ten odd characters>, POSSIBLE_ECHO."""
    odd = F.regexp_replace(answer, rf"(?U)[\s/(),.\-0-9a-zA-Z{HANGUL}]", "")
    kana = answer.rlike("[" + "".join(dict.fromkeys(KANA_SIGNS.replace("-", ""))) + r"\-]")
    return F.array_compact(
        F.array(
            F.when(answer.rlike(CJK_LEAK) & ~lang.isin("ja", "zh"), "CJK_LEAK"),
            F.when((lang == "ko") & (odd != ""), F.concat(F.lit("NON_HANGUL:"), F.substring(odd, 1, 10))),
            F.when((lang == "ja") & ~kana & (F.length(answer) < 5), "POSSIBLE_ECHO"),
        )
    )
