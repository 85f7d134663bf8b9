"""Language models: probabilities that sum to one, plain lookups, held-out accuracy, rejection."""

import numpy as np
import pyarrow as pa
import pytest
from paths import LARGE, SF
from pyspark.sql import functions as F

from skald.llm import language_id as L


def counted(texts):
    raw, at = L.buffers(pa.array(texts))
    code, _ = L.symbols(raw, at)
    return np.unique(L.ngrams(code), return_counts=True)


def test_symbols_and_ngrams():
    raw, at = L.buffers(pa.array(["Ab, c!", None, "..", "é1日"]))
    code, begin = L.symbols(raw, at)
    a, b, c, e = (ord(x) for x in "abcé")
    assert code.tolist()[:6] == [a, b, 0, c, 0, e] and code[-1] == 0 and len(code) == 9
    assert begin.tolist() == [0, 5, 5, 5, 9]
    grams = L.ngrams(code)
    assert grams[:5].tolist() == [a, b | a << 12, b << 12 | a << 24, c, c << 12]


def test_letters_are_code_points_of_their_category():
    """Tags, private use, marks alone and digits are no letters; letters of the upper planes and marks behind letters are."""
    texts = ["\U000e0067\U000e0062", "\U000f0000", "\u0301 \u0301\u0302", "123 !", "\U00020000", "e\u0301", "\u0301e", "\U000e0101"]
    raw, at = L.buffers(pa.array(texts))
    assert np.diff(L.symbols(raw, at)[1]).tolist() == [0, 0, 0, 0, 2, 3, 2, 0]


def plain_kneser_ney(text, order):
    """P(symbol | those before it in its word) by dictionaries; grams are tuples, padded with 0 where the word begins."""
    grams = {}
    for word in text.split():
        code = [0] * (order - 1) + [ord(c) for c in word] + [0]
        for i in range(order - 1, len(code)):
            g = tuple(code[i - order + 1 : i + 1])
            grams[g] = grams.get(g, 0) + 1
    levels = {order: grams}
    for n in range(order - 1, 0, -1):
        levels[n] = {}
        for g in levels[n + 1]:
            levels[n][g[1:]] = levels[n].get(g[1:], 0) + 1

    def p(g):
        if not g:
            return 1 / 4096
        counts = levels[len(g)]
        once, twice = (sum(c == x for c in counts.values()) for x in (1, 2))
        cut = min(0.95, max(0.05, once / max(1, once + 2 * twice)))
        seen = [c for h, c in counts.items() if h[:-1] == g[:-1]]
        if not seen:
            return p(g[1:])
        return max(counts.get(g, 0) - cut, 0) / sum(seen) + cut * len(seen) / sum(seen) * p(g[1:])

    return p, grams


def test_probabilities_equal_a_dictionary_model():
    text = "the cat sat on the mat that the hat of the cat ate at a mat the theme then"
    model = L._Language(*counted([text]), L.ORDER)
    p, grams = plain_kneser_ney(text, L.ORDER)
    rng = np.random.default_rng(4)
    seen = list(grams)
    asked = seen + [(*seen[rng.integers(len(seen))][:-1], int(rng.choice([0, 97, 104, 122]))) for _ in range(200)] + [(97, 98, 99, 100, 101), (0, 0, 0, 122, 0)]
    packed = np.array([sum(c << (L.BITS * i) for i, c in enumerate(reversed(g))) for g in asked])
    assert np.allclose(np.exp(model.log_p(packed, L.ORDER)), [p(g) for g in asked], rtol=1e-9)


def test_probabilities_sum_to_one():
    grams, counts = counted(["the cat sat on the mat", "that hat", "a the at tat"])
    model = L._Language(grams, counts, L.ORDER)
    for context in (0, grams[3] >> 12, 12345):
        p = np.exp(model.log_p((int(context) << 12) + np.arange(1 << L.BITS), L.ORDER))
        assert abs(p.sum() - 1) < 1e-6 and (p > 0).all()


def test_sorted_hash_array_equals_a_dictionary():
    rng = np.random.default_rng(1)
    key = np.unique(rng.integers(0, 1 << 60, 5000))
    table = L._Sorted(key, np.arange(len(key), dtype=float)[:, None])
    asked = np.concatenate([key, rng.integers(0, 1 << 60, 5000)])
    place = {k: float(i) for i, k in enumerate(key.tolist())}
    got = table.find(asked)
    assert [table.rows[i, 0] if i >= 0 else None for i in got] == [place.get(k) for k in asked.tolist()]


def test_joint_model_equals_each_language():
    texts = {"a": ["the cat sat on that mat"] * 3, "b": ["der hund saß auf der matte"] * 3}
    counts = {k: counted(v) for k, v in texts.items()}
    model = L.Model(["a", "b"], counts)
    raw, at = L.buffers(pa.array(["the matte hund", "zzz"]))
    grams = L.ngrams(L.symbols(raw, at)[0])
    for i, k in enumerate("ab"):
        assert np.allclose(model.log_p(grams)[:, i], L._Language(*counts[k], L.ORDER).log_p(grams, L.ORDER), atol=1e-4)


def test_held_out_accuracy_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("clash"))
    got = L.identify(docs).withColumn("held", L.held_out()).toPandas()
    held = got[got.held]
    assert (held.lang == held.lang_pred).mean() > 0.97 and len(held) > 20
    assert got.score.between(0, 1).all() and got.rejected.mean() < 0.05
    assert len(got) == docs.count()


def test_rejection_of_an_unseen_language_and_of_known_ones(spark):
    """Trained without one Latin-script language, most of its texts are rejected, and hardly any of the others."""
    docs = spark.read.parquet(f"{LARGE}/documents.parquet").repartition(8)
    got = L.predict(docs.filter(L.held_out()), L.train(docs.filter((F.col("lang") != "fr") & ~L.held_out()))).toPandas()
    assert got[got.lang == "fr"].rejected.mean() > 0.8 and got[got.lang != "fr"].rejected.mean() < 0.005
    off = np.random.default_rng(1).exponential(size=20_000)
    assert (off > L.upper_limit(off[:1000])).mean() < 0.002


def test_own_columns_survive(spark, make):
    """accepted() returns the rows as they are; identify() replaces columns of its results' names, in any case."""
    docs = make([(i, "the cat sat on the mat and ate " * 3) for i in range(40)] + [(99, "12 34")]).withColumns({"rejected": F.lit("mine"), "a.b": F.lit(1), "ROW": F.lit(2)})
    left = L.accepted(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == set(range(40))
    assert {(r["score"], r["rejected"], r["a.b"]) for r in left.collect()} == {(1.5, "mine", 1)}
    assert L.identify(docs.withColumnRenamed("score", "Score")).columns == ["doc_id", "text", "lang", "source", "n_chars", "a.b", "ROW", "lang_pred", "score", "margin", "entropy", "rejected"]


def test_too_many_languages_are_refused(spark):
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError, match="more than 5 languages"):
        L.train(docs, max_languages=5)


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    changed = docs.withColumn("lang", F.when(L.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a, b = (L.identify(d).orderBy("doc_id").select("lang_pred", "score").collect() for d in (docs, changed))
    assert a == b


def test_odd_rows(spark, odd, make):
    train = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = L.train(train)
    got = L.predict(odd, model).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    for i in (1, 2, 3, 7):
        assert (by[i]["lang_pred"], by[i]["score"], by[i]["rejected"]) == ("und", 0.0, True)
    assert by[4]["score"] == by[5]["score"] and by[4]["lang_pred"] in model.languages
    junk = make([(1, "日本語の文章です " * 50)])
    assert L.predict(junk, model).first()["rejected"]
    assert L.predict(odd, None).filter("lang_pred <> 'und'").count() == 0
    assert L.identify(make([(1, "x")]).limit(0)).count() == 0
