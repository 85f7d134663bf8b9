"""Column expressions over text: cleaning, tokenizing, stemming and small scalars.

Everything here is native Catalyst, so it fuses with the scan that feeds it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the alphabet of tokens (digits, Latin, Cyrillic) and combining marks
ALPHABET = r"0-9A-Za-zЀ-ԯ"
MARKS = r"̀-ͯ"
TOKEN = rf"[{ALPHABET}][{ALPHABET}{MARKS}]*(?:-[{ALPHABET}][{ALPHABET}{MARKS}]*)*"
MIN_TOKEN = 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize_url(url: Column) -> Column:
    """The url before its fragment and its query."""
    return F.substring_index(F.substring_index(url, "#", 1), "?", 1)


def content_hash(text: Column) -> Column:
    """Hexadecimal MD5 of the UTF-8 text."""
    return F.md5(text)


def strip(text: Column) -> Column:
    """text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_text(text: Column) -> Column:
    """Drop reference marks in brackets, squeeze white space, close up punctuation, parentheses and spaced hyphens."""
    steps = [
        (r"\[\d+\]", ""),
        (r"(?U)\s*\[[^\]]+\]\s*", " "),
        (r"(?U)\s{2,}", " "),
        (r"(?U)^\s+|\s+$", ""),
        (r"(?U)\s+([.,;:!?)])", "$1"),
        (r"(?U)([(])\s+", "$1"),
        (r"(?U)(\w)\s+-\s+(\w)", "$1-$2"),
    ]
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The runs of characters between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def count_words(text: Column) -> Column:
    """How many words hold a letter or digit."""
    return F.size(F.filter(words(text), lambda w: w.rlike(r"[\p{L}\p{N}]"))).cast("int")


def normalize_heading(text: Column) -> Column:
    """A heading without its numbering and colons, trimmed, lower case."""
    return F.lower(strip(F.replace(F.regexp_replace(strip(text), r"^\s*\d+(\.\d+)*\s*", ""), F.lit(":"), F.lit(""))))


def detect_source(url: Column, hint: Column | None = None, html: Column | None = None) -> Column:
    """wikipedia or bre: by hint, host, then the page's own marks; bre if none tells."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    told = F.when(host.contains("wikipedia.org"), "wikipedia").when(host.contains("bigenc.ru"), "bre")
    if html is not None:
        marked = html.rlike(r"""(?i)<div\b[^>]*\b(class\s*=\s*["'][^"']*\bmw-parser-output\b|id\s*=\s*["']?mw-content-text\b)""")
        told = F.coalesce(told, F.when(marked, "wikipedia"))
    if hint is not None:
        told = F.coalesce(F.lower(F.nullif(hint, F.lit(""))), told)
    return F.coalesce(told, F.lit("bre"))


#: Characters whose lower case is in the alphabet or a mark, though they are in neither themselves.
_ODD_CASE = "\u0130\u212a"


def raw_tokens(text: Column) -> Column:
    """Tokens in order, lower case, without combining marks, of any length.

    Text without marks and odd capitals is lowered as a whole, which spares a
    function call for each token.
    """
    found = lambda x: F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))
    marked = F.transform(found(text), lambda x: F.lower(F.regexp_replace(x, f"[{MARKS}]", "")))
    return F.when(text.rlike(f"[{MARKS}{_ODD_CASE}]"), marked).otherwise(found(F.lower(text)))


def tokens(text: Column) -> Column:
    """Lower-case tokens in order: Cyrillic, Latin and digits with inner hyphens; combining marks are dropped.

    Tokens of digits are kept at any length, others from three characters on.
    """
    return F.filter(raw_tokens(text), keeps)


def keeps(token: Column) -> Column:
    """Whether a token is kept."""
    return (F.length(token) >= MIN_TOKEN) | all_digits(token)


def ascii_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower case, of any length."""
    odd = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)
    return F.when(text.rlike(f"[{_ODD_CASE}]"), odd).otherwise(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def all_digits(token: Column) -> Column:
    return token.rlike("^[0-9]+$")


def contains_cyrillic(token: Column) -> Column:
    return token.rlike(r"[Ѐ-ԯ]")


# fixed values: vowels and the endings of each class
VOWELS = "аеиоуыэюяё"
ENDINGS = {
    "perfective_1": "ивши ившись ив",
    "perfective_2": "вшись вши в",
    "reflexive": "ся сь",
    "adjective": "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею",
    "participle_1": "ем нн вш ющ щ",
    "participle_2": "ивш ывш ующ",
    "verb_1": "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю",
    "verb_2": "ла на ете йте ли й л ем н ло но ет ют ны ть ешь",
    "noun": "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я",
    "superlative": "ейш ейше",
}


def ending(name: str) -> str:
    """A pattern of a class of endings at a word's end; of two that fit, the longer one matches."""
    return f"(?:{'|'.join(ENDINGS[name].split())})$"


def _cut(x: Column, name: str) -> Column:
    return F.regexp_replace(x, ending(name), "")


def stem_ru(word: Column) -> Column:
    """The stem of a Russian word: endings are cut from what follows its first vowel."""

    def first(name: str, x: Column, other: Callable[[Column], Column]) -> Column:
        return let(_cut(x, name), lambda y: F.when(y != x, y).otherwise(other(x)))

    def inflected(r: Column) -> Column:
        verb = lambda x: first("verb_1", x, lambda y: first("verb_2", y, lambda z: _cut(z, "noun")))
        participle = lambda x: first("participle_2", x, lambda y: _cut(y, "participle_1"))
        return let(_cut(r, "reflexive"), lambda x: let(_cut(x, "adjective"), lambda a: F.when(a != x, participle(a)).otherwise(verb(x))))

    def tail(r: Column) -> Column:
        r = F.regexp_replace(r, "и$", "")
        r = F.regexp_replace(r, f"^(.*[{VOWELS}].*?)ость?$", "$1")
        soft = lambda x: F.when(x.endswith("ь"), F.regexp_replace(x, "ь$", "")).otherwise(F.regexp_replace(_cut(x, "superlative"), "нн$", "н"))
        return let(r, soft)

    def stemmed(w: Column) -> Column:
        split = F.regexp_extract(w, f"^([^{VOWELS}]*[{VOWELS}])(.+)$", 1)
        rest = F.regexp_extract(w, f"^([^{VOWELS}]*[{VOWELS}])(.+)$", 2)
        after = first("perfective_1", rest, lambda r: first("perfective_2", r, inflected))
        return F.when(split == "", w).otherwise(F.concat(split, tail(after)))

    return let(F.replace(F.lower(word), F.lit("ё"), F.lit("е")), stemmed)


def stem(token: Column) -> Column:
    """Null for digits; words with Cyrillic of more than three characters by stem_ru; others in lower case."""
    other = F.when((F.length(token) > 3) & contains_cyrillic(token), stem_ru(token)).otherwise(F.lower(token))
    return F.when(~all_digits(token), other)


def human_bytes(n: Column) -> Column:
    """A size with two decimals (of a tie the even one) in the largest unit that leaves it under 1024."""
    shown = lambda x, unit: F.concat(F.replace(F.format_number(x, 2), F.lit(","), F.lit("")), F.lit(f" {unit}"))
    out = shown(n / 1024.0**5, "PB")
    for i, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        x = n / F.lit(1024.0**i)
        out = F.when(x < 1024, shown(x, unit)).otherwise(out)
    return out


def six_digits(x: Column) -> Column:
    """A double as text with six significant digits (of a tie the even one) and no trailing zeros."""
    places = F.lit(5) - F.floor(F.log10(F.abs(x))).cast("int")
    fixed = F.replace(F.call_function("format_number", x, places), F.lit(","), F.lit(""))
    shown = F.when((places >= 0) & (places < 10) & (F.length(F.regexp_replace(fixed, r"^-|\..*$", "")) < 7), fixed).otherwise(F.format_string("%.6g", x))
    shown = F.when(shown.contains(".") & ~shown.contains("e"), F.regexp_replace(shown, r"\.?0+$", "")).otherwise(shown)
    return F.when(x == 0, F.lit("0")).otherwise(F.regexp_replace(shown, r"\.?0+e", "e"))
