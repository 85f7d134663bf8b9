"""Groups against all pairs."""

import random
from itertools import combinations

from skald.llm import neardup as N


def plain(rows, split, percent):
    """(n_shingles, component) by row, from all pairs."""

    def shingles(text):
        w = split(text, "spaced")
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in rows]
    above = {i: i for i, _ in rows}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for (i, a), (j, b) in combinations(zip((i for i, _ in rows), sets), 2):
        if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((top(i), top(j)))
            above[y] = x
    return sorted((repr(i), len(s), repr(top(i)) if s or i is None else repr(i)) for (i, _), s in zip(rows, sets))


def corpus(rng):
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) + rng.choice(["", "1", "É"])
    rows, base = [], [[word() for _ in range(rng.randint(60, 260))] for _ in range(12)]
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 9])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            w = w[: int(len(w) * rng.uniform(0.8, 1))]
        rows.append((rng.randrange(10_000) * 200 + i, " ".join(w)))
    return rows + [(7, "short text"), (8, "Short  text"), (9, "x"), (11, None), (12, ""), (13, "   ")]


def test_components_equal_all_pairs(make, split):
    for seed, percent, options in ((1, 85, {}), (3, 80, {"bands": 14, "slack": 24})):
        rows = corpus(random.Random(seed))
        got = N.groups(make(rows), percent=percent, **options).collect()
        assert sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in got) == plain(rows, split, percent)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_odd_rows(odd, make):
    got = {(r["doc_id"]): r for r in N.groups(odd).collect()}
    assert N.groups(odd).count() == odd.count()
    assert (got[4]["component_id"], got[5]["component_id"], got[10]["component_id"]) == (4, 4, 9)
    assert (got[None]["component_id"], got[None]["kept"]) == (None, False)
    assert all(got[i]["kept"] and got[i]["n_shingles"] == 0 for i in (1, 2, 3))
    assert N.groups(make([(1, "x")]).limit(0)).count() == 0
    kept = N.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 8, 9]


def test_rows_that_repeat_an_id_join_what_they_are_linked_to(make):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    got = N.groups(make([(5, a), (5, b), (3, a), (9, b)])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {5: 3, 3: 3, 9: 3}


def test_components_of_chains(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 103), (103, 101), (7, 7)]
    links = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in links]
    got = {r["node"]: r["component"] for r in N.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 103: 100}


def test_deduplicate_keeps_null_ids_and_other_texts_of_an_id(make):
    texts = [" ".join(f"{c}{i * 7 % 31}x{i}" for i in range(40)) for c in "abcde"]
    rows = [(1, texts[0]), (2, texts[1]), (5, texts[0]), (5, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[4]), (None, texts[0]), (None, "a clean one")]
    left = [(r["doc_id"], r["text"]) for r in N.deduplicate(make(rows), nameless=True).collect()]
    assert sorted(left, key=str) == sorted([rows[i] for i in (0, 1, 3, 4, 5, 7, 8)], key=str)


def test_columns_of_any_name(odd, clash, make):
    for docs in (clash(odd), clash(make([(1, "a b c d e f"), (2, "a b c d e f")]))):
        left = N.deduplicate(docs, nameless=True)
        assert left.columns == docs.columns
        assert all(r["_key"] == f"_key of {r['doc_id'] or 'none'}" and r["kept"].startswith("kept of") for r in left.collect())
