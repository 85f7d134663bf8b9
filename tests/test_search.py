"""The query language and its algebra against counters."""

import random
from collections import Counter

import pytest

from skald.operators import search
from skald.plans import query_language as Q

POSTINGS = {"a": Counter(d1=3, d2=1), "b": Counter(d1=1, d2=2, d3=1), "c": Counter(d3=1, d4=1)}


@pytest.fixture(scope="module")
def postings(spark):
    return spark.createDataFrame([(t, d, n) for t, c in POSTINGS.items() for d, n in c.items()], "term string, doc_id string, tf long").cache()


@pytest.fixture(scope="module")
def direct(spark):
    return spark.createDataFrame([(f"d{i}", f"t{i}", f"u{i}") for i in range(1, 5)], "doc_id string, title string, url string").cache()


def hits(df):
    return Counter({r["doc_id"]: r["n"] for r in df.collect()})


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("a b &&", "d1 d2"), ("a b ||", "d1 d1 d1 d2 d2 d3"), ("a b !", "d1 d1"), ("b a !", "d2 d3"), ("a c &&", ""), ("a c && b ||", ""), ("a b || c &&", "d3"), ("a b && !", "d1 d2"),
        ("a && b", "d1 d2 d2 d3"), ("a b", "d1 d2 d2 d3"), ("a &b", "d1 d2 d2 d3"), ("a|b", "d1 d2 d2 d3"), ("a &&& b", "d1 d2 d2 d3"), ("a b !!", "d1 d2 d2 d3"), ('"a&&b"', "d1 d2 d2 d3"),
        ("!a", "d1 d1 d1 d2"), ("a zzz &&", "d1 d1 d1 d2"), ("(a || b) && c", "d3 d4"), ("A", ""), ("zzz", ""), ('"a b"', ""),
    ],
)
def test_postfix_multisets(postings, query, expected):
    found = search.search(postings, [query], syntax="postfix", semantics="multiset", literal_or=True)
    assert hits(found) == Counter(expected.split())


@pytest.mark.parametrize(
    ("query", "expected"),
    [("a && b", "d1 d2"), ("a b", "d1 d2"), ("!a", "d3 d4"), ("(a || b) && c", "d3"), ("a zzz", ""), ("A", "d1 d2"), ("zzz", ""), ("a || zzz", "d1 d2"), ("b !a", "d3"), ("a || b c", "d1 d2 d3"), ("((a", "d1 d2"), ("!(a || c)", "")],
)
def test_infix_sets(postings, direct, query, expected):
    assert hits(search.search(postings, [query], direct=direct)) == Counter(expected.split())


def test_random_trees(postings, direct):
    rng = random.Random(3)

    def tree(depth):
        if not depth or rng.random() < 0.2:
            return Q.Term(rng.choice("abc"))
        return rng.choice([Q.And, Q.Or, Q.Minus])(tree(depth - 1), tree(depth - 1))

    def plain(node):
        if isinstance(node, Q.Term):
            return POSTINGS[node.text]
        left, right = plain(node.left), plain(node.right)
        return left & right if isinstance(node, Q.And) else left | right if isinstance(node, Q.Or) else left - right

    def shown(node):
        return node.text if isinstance(node, Q.Term) else f"{shown(node.left)} {shown(node.right)} {'&&' if isinstance(node, Q.And) else '||' if isinstance(node, Q.Or) else '!'}"

    trees = [tree(4) for _ in range(25)]
    found = search.search(postings, [shown(t) for t in trees], syntax="postfix", semantics="multiset").collect()
    for i, t in enumerate(trees):
        assert Counter({r["doc_id"]: r["n"] for r in found if r["query_id"] == i}) == plain(t)


def test_enriched_and_repeated(postings, direct):
    found = search.search(postings, ["a", "  ", "zzz"], semantics="multiset")
    assert sorted((r["doc_id"], r["url"]) for r in search.with_documents(found, direct).collect()) == [("d1", "u1"), ("d2", "u2")]
    assert sorted(r["doc_id"] for r in search.repeated(found).collect()) == ["d1", "d1", "d1", "d2"]
