"""Tokenizer, stemmer and scalars: worked cases and random strings against plain restatements."""

import random

import pytest
from pyspark.sql import functions as F

from skald.functions import text as X


def column(spark, values, build):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string")
    return [r["out"] for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


TOKENS = {
    "12-": ["12"], "a-b": ["a-b"], "a--b": [], "1-2": ["1-2"], "1": ["1"], "ab": [], "Ёлка-1": ["ёлка-1"], "don't": ["don"], "3.14": ["3", "14"], "-abc": ["abc"],
    "абв́г": ["абвг"], "а-́б": [], "": [], "Биология — это наука, изучающая жизнь.": ["биология", "это", "наука", "изучающая", "жизнь"],
}

STEMS = {
    "тюлень": "тюлен", "морское": "морск", "млекопитающее": "млекопита", "семейства": "семейств", "буровато-серая": "буровато-сер", "клетка": "клетк", "клетки": "клетк",
    "клетками": "клетк", "важнейший": "важн", "молодость": "молодос", "постоянно": "постоян", "учившись": "уч", "организмов": "организмо", "организм": "организм", "вид": "вид",
    "2024": None,
}


def plain_tokens(text):
    """One pass over the characters."""
    alnum = lambda c: c.isascii() and c.isalnum() or "Ѐ" <= c <= "ԯ"
    out, word = [], ""
    for i, c in enumerate(text + "\n"):
        if "̀" <= c <= "ͯ":
            continue
        if alnum(c):
            word += c.lower()
        elif c == "-" and word and i + 1 < len(text) and alnum(text[i + 1]):
            word += c
        else:
            if word and (all("0" <= x <= "9" for x in word) or len(word) >= 3):
                out.append(word)
            word = ""
    return out


def plain_stem(word):
    """Step by step, by string ends."""

    def cut(r, name):
        fit = [e for e in X.ENDINGS[name].split() if r.endswith(e)]
        return r[: -len(max(fit, key=len))] if fit else None

    w = word.lower().replace("ё", "е")
    at = next((i + 1 for i, c in enumerate(w) if c in X.VOWELS), len(w))
    if at >= len(w):
        return w
    r = w[at:]
    if (x := cut(r, "perfective_1")) is not None or (x := cut(r, "perfective_2")) is not None:
        r = x
    else:
        r = x if (x := cut(r, "reflexive")) is not None else r
        if (a := cut(r, "adjective")) is not None:
            p = cut(a, "participle_2")
            p = cut(a, "participle_1") if p is None else p
            r = a if p is None else p
        else:
            for name in ("verb_1", "verb_2", "noun"):
                if (x := cut(r, name)) is not None:
                    r = x
                    break
    r = r.removesuffix("и")
    for e in ("ость", "ост"):
        if r.endswith(e):
            if any(c in X.VOWELS for c in r[: -len(e)]):
                r = r[: -len(e)]
            break
    if r.endswith("ь"):
        r = r[:-1]
    else:
        r = x if (x := cut(r, "superlative")) is not None else r
        r = r[:-1] if r.endswith("нн") else r
    return w[:at] + r


def test_tokens(spark):
    assert column(spark, TOKENS, X.tokens) == list(TOKENS.values())


def test_tokens_of_random_text(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aZ09-- .́бЁя'é\n") for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    assert column(spark, texts, X.tokens) == [plain_tokens(t) for t in texts]


def test_stems(spark):
    assert column(spark, STEMS, X.stem) == list(STEMS.values())


def test_stems_of_random_words(spark):
    rng = random.Random(2)
    ends = [e for x in X.ENDINGS.values() for e in x.split()]
    words = ["".join(rng.choice("абвгнтсеиоуьйё") for _ in range(rng.randint(1, 6))) + rng.choice(ends) + rng.choice(["", rng.choice(ends)]) for _ in range(3000)]
    assert column(spark, words, X.stem_ru) == [plain_stem(w) for w in words]


@pytest.mark.parametrize(
    ("given", "expected"),
    [("Белок [12] (  альфа ) , и а - б [прим. 1] да", "Белок (альфа), и а-б да"), ("a - b - c", "a-b - c"), ("x\ny [1]", "x\ny"), ("", "")],
)
def test_clean_text(spark, given, expected):
    assert column(spark, [given], X.clean_text) == [expected]


def test_scalars(spark):
    assert column(spark, ["http://a/b?x#y", "http://a/b#y?x", None], X.normalize_url) == ["http://a/b", "http://a/b", None]
    assert column(spark, ["", "a - b", "1 !! я", None], X.count_words) == [0, 2, 2, 0]
    assert column(spark, ["1.2 Ссылки:", " Литература "], X.normalize_heading) == ["ссылки", "литература"]
    sizes = column(spark, ["0", "1023", "1024", "1048576", str(5 * 1024**5)], lambda c: X.human_bytes(c.cast("double")))
    assert sizes == ["0.00 B", "1023.00 B", "1.00 KB", "1.00 MB", "5.00 PB"]
    assert column(spark, ["0.30103", "100", "2.5", "1234567"], lambda c: X.six_digits(c.cast("double"))) == ["0.30103", "100", "2.5", "1.23457e+06"]
    assert column(spark, ["http://ru.wikipedia.org/x", "https://old.bigenc.ru/y", "http://other.org", None], X.detect_source) == ["wikipedia", "bre", "bre", "bre"]


def test_sizes_round_as_the_exact_value_does(spark):
    values = [*range(0, 5000), *(n * 997 for n in range(1000, 3000)), 1152 << 10, 3 << 49, (1 << 60) + 12345]
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", X.human_bytes(F.col("v")).alias("out")).collect()

    def plain(x):
        for unit in ("B", "KB", "MB", "GB", "TB"):
            if x < 1024:
                return f"{x:.2f} {unit}"
            x /= 1024
        return f"{x:.2f} PB"

    assert {r["v"]: r["out"] for r in rows} == {float(v): plain(float(v)) for v in values}


def test_six_digits_are_those_of_c(spark):
    rng = random.Random(2)
    values = [0.0, 1.0, 59.78125, 0.5978125, 999999.5, 1e6, 123456.5, 1234567.0, 0.30103, 1e-5, 25600.0, -2.5, 0.00012345678, 5e15, 100000.5, 1e-4, *(rng.uniform(0, 10) ** rng.randint(-3, 7) for _ in range(300))]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.six_digits(F.col("v")).alias("out")).collect()
    assert {r["v"]: r["out"] for r in rows} == {v: f"{v:.6g}" for v in values}
