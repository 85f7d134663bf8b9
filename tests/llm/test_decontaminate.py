"""Winnowing against all windows."""

import hashlib
import random

from skald.llm import decontaminate as D


def plain(docs, items, split):
    """Every window of every item, looked for in every document."""
    windows = {}
    for item, text in items:
        w = split(text, "alnum")
        for i in range(max(1, len(w) - 7) if w else 0):
            windows.setdefault(tuple(w[i : i + 8]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = split(text, "alnum"), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, len(found) >= 2))
    return sorted(out, key=repr)


def test_every_window_is_found(spark, make, split):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    items = [(i, text(rng.randint(0, 14))) for i in range(30)] + [(31, None), (3, "x y"), (32, "Ünïcode wörds 42"), (33, "Ünïcode wörds 42"), (34, "!!")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(80)] + [(90, "say ünïcode WÖRDS 42".replace("Ö", "ö")), (91, None), (92, items[0][1]), (92, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for words in (2_000_000, 60):  # broadcast, and joined
        got = D.report(make(docs).drop("score"), bench, block_words=words)
        assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, items, split)


def test_winnowing_guarantee():
    """Any run of SPAN equal words chooses a common fingerprint at the same place."""
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b, run = (rng.integers(0, 1 << 60, n).astype(np.uint64) for n in (20, 20, D.SPAN))
        a[5 : 5 + D.SPAN] = b[9 : 9 + D.SPAN] = run
        ga, gb = D.grams(a, D.K), D.grams(b, D.K)
        ka, kb = D.winnow(ga, np.ones(len(ga), bool), D.PICK), D.winnow(gb, np.ones(len(gb), bool), D.PICK)
        assert any(ka[5 + j] and kb[9 + j] for j in range(D.PICK))


def test_odd_rows_and_empty_tables(spark, odd, make):
    bench = spark.createDataFrame([(1, "one"), (2, None), (None, "a null id")], "item_id long, text string")
    got = D.report(odd, bench).collect()
    assert len(got) == odd.count()
    assert sorted(r["n_items"] for r in got if r["doc_id"] == 6) == [1, 1]
    assert next(r for r in got if r["doc_id"] is None)["n_hit"] == 3
    assert D.report(odd, bench.limit(0)).filter("n_items > 0").count() == 0
    assert D.report(make([(1, "x")]).limit(0), bench).count() == 0
    assert D.clean(odd, bench).columns == odd.columns


def test_clean_drops_passages_only(spark, make):
    passage = " ".join(f"p{i}" for i in range(30))
    bench = spark.createDataFrame([(1, passage), (2, "q r s t u v w x y")], "item_id long, text string")
    docs = make([(1, f"before {passage} after"), (2, " ".join(passage.split()[:9]) + " and no more"), (3, "clean text"), (4, None)])
    assert sorted(r["doc_id"] for r in D.clean(docs, bench).collect()) == [2, 3, 4]


def test_clean_with_columns_of_any_name(odd, clash, make, spark):
    docs = clash(odd)
    bench = spark.createDataFrame([("q", "ein zwei drei vier fünf sechs")], "item_id string, text string")
    left = D.clean(docs, bench)
    assert left.columns == docs.columns
    assert sorted(map(repr, left.collect())) == sorted(map(repr, D.clean(docs, bench, block_words=1).collect()))
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(["1", "2", "3", "4", "5", "6", "6", "None", "7", "8"])


def test_clean_drops_edited_items(make, spark):
    """A short item with a replaced word has no long run, but most of its words are hit; a chance window of a long one stays."""
    short, long = [f"w{i}" for i in range(17)], [f"v{i}" for i in range(60)]
    bench = spark.createDataFrame([("s", " ".join(short)), ("l", " ".join(long))], "item_id string, text string")
    docs = make([(1, "x y " + " ".join(short[:12] + ["other"] + short[13:]) + " z"), (2, "x y " + " ".join(long[20:29]) + " z"), (3, "clean words only")])
    assert sorted(r["doc_id"] for r in D.clean(docs, bench).collect()) == [2, 3]
