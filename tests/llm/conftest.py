import re
import string

import pytest

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORDS = {"spaced": re.compile(r"[^\x20\x09-\x0D]+"), "alnum": re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}


@pytest.fixture(scope="session")
def split():
    """Words of a text by a plain pattern."""
    return lambda text, kind: WORDS[kind].findall((text or "").translate(LOWER))


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text) pairs, with a column that clashes with results."""

    def build(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double")

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and very long texts, ties, repeated rows."""
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(60_000))
    return make([(1, None), (2, ""), (3, " \n\t "), (4, long), (5, long), (6, "one"), (6, "one"), (None, "a null id here"), (7, "!!! ??? ..."), (8, "é日本 İ  x"), (9, "ein zwei drei vier fünf sechs"), (10, "ein zwei drei vier fünf sechs")])


@pytest.fixture(scope="session")
def clash():
    """A table with columns of every name that the operators use for their own, and one with a dot."""
    names = "_id _th _spans _key _own _n_words _items _sizes _component tokens tokenizer predicted rejected kept component_id a.b c0 n0 id"

    def build(docs):
        from pyspark.sql import functions as F

        return docs.withColumns({n: F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in names.split()})

    return build
