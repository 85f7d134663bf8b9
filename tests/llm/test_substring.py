"""Passages: planted ones are found and cut, clean text stays; the chain against a plain search."""

import random
import zlib

import numpy as np

from skald.llm import substring as S


def words(rng, n):
    return [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(400)}" for _ in range(n)]


def test_fenwick_equals_prefix_maxima():
    rng = random.Random(1)
    tree, plain = S.Fenwick(50), {}
    for step in range(300):
        i, v = rng.randrange(50), rng.uniform(-5, 5)
        tree.put(i, v, step)
        plain[i] = max(plain.get(i, (-9, -1)), (v, step))
        q = rng.randrange(50)
        below = [x for j, x in plain.items() if j <= q]
        assert tree.best(q) == (max(below) if below else (0.0, -1))


def test_chains_equal_a_plain_search():
    """The best chain's score equals that of trying every predecessor."""
    rng = random.Random(2)
    for _ in range(200):
        found = sorted({(rng.randrange(60), rng.randrange(60), rng.randint(1, 8)) for _ in range(rng.randint(1, 12))})
        score = []
        for i, (a, b, m) in enumerate(found):
            before = [score[j] - S.GAP_COST * (a - x - n + b - y - n) for j, (x, y, n) in enumerate(found[:i]) if x + n <= a and y + n <= b]
            score.append(m + S.K - 1 + max([0, *before]))
        chain = S.chains(found)[0]
        got = sum(m + S.K - 1 for _, _, m in chain) - S.GAP_COST * sum(q[0] - p[0] - p[2] + q[1] - p[1] - p[2] for p, q in zip(chain[:-1], chain[1:]))
        assert abs(got - max(score)) < 1e-9
        assert all(p[0] + p[2] <= q[0] and p[1] + p[2] <= q[1] for p, q in zip(chain[:-1], chain[1:]))


def test_fuzzy_passages_of_two_documents():
    rng, share = random.Random(3), []
    for _ in range(60):
        passage = words(rng, rng.randint(60, 140))
        edited = [w for w in passage if rng.random() > 0.03]
        edited = [words(rng, 1)[0] if rng.random() < 0.04 else w for w in edited]
        head, other, tail = words(rng, 30), words(rng, 80), words(rng, 25)
        code = {w: i for i, w in enumerate(sorted({*passage, *edited, *head, *other, *tail}))}
        a, b = (np.array([code[w] for w in x], np.uint16) for x in (head + edited + tail, other + passage))
        found = S.passages(a, b)
        covered = set().union(*(range(s, e) for s, e, *_ in found)) if found else set()
        own = set(range(30, 30 + len(edited)))
        share.append(len(covered & own) / len(own))
        assert share[-1] >= 0.5 and len(covered - own) <= 6
        assert all(p[4] >= S.SIMILAR for p in found)
        assert S.passages(a, np.array([code[w] for w in other], np.uint16)) == []
    assert sum(share) / len(share) >= 0.93


def test_every_copy_of_a_passage():
    """A source's passage held three times, its first words alone before it, a long run of one word."""
    rng = np.random.default_rng(5)
    fresh = lambda n: rng.integers(100, 60000, n).astype(np.uint16)
    passage, gaps = fresh(60), [fresh(30) for _ in range(4)]
    source = np.concatenate([fresh(50), passage, fresh(50)])
    found = S.passages(np.concatenate([x for g in gaps[:3] for x in (g, passage)] + [gaps[3]]), source)
    assert sorted(p[:4] for p in found) == [(s, s + 60, 50, 110) for s in (30, 120, 210)]
    found = S.passages(np.concatenate([gaps[0], passage[:42], gaps[1], passage, gaps[2]]), source)
    assert [p[:4] for p in found] == [(102, 162, 50, 110)]
    assert [p[:2] for p in S.passages(np.concatenate([passage, gaps[0]]), np.concatenate([source, source]))] == [(0, 60)]
    same = np.full(3000, 7, np.uint16)
    found = S.passages(np.concatenate([gaps[0], same, gaps[1], same, gaps[2]]), np.concatenate([source, same]))
    assert set().union(*(range(p[0], p[1]) for p in found)) >= {*range(30, 3030), *range(3060, 6060)}


def test_report_and_removal(make):
    rng = random.Random(4)
    passage, boiler = words(rng, 70), words(rng, 12)
    own = {i: words(rng, 90) for i in range(30)}
    texts = {i: " ".join(w) for i, w in own.items()}
    for i in (3, 9, 14, 21):
        texts[i] = " ".join(own[i][:40] + passage + own[i][40:])
    for i in (5, 6, 7):
        texts[i] += " " + " ".join(boiler)
    texts[25] = texts[2]
    docs = make(list(texts.items()))
    got = {r["doc_id"]: r for r in S.report(docs).collect()}
    assert {i for i, r in got.items() if r["n_passages"]} == {9, 14, 21, 25}
    assert all(got[i]["source_ids"] == [3] and abs(got[i]["n_repeated"] - 70) <= 3 for i in (9, 14, 21))
    assert (got[25]["source_ids"], got[25]["n_repeated"]) == ([2], 90)
    assert sorted((r["doc_id"], r["source_id"]) for r in S.repeats(docs).collect()) == [(9, 3), (14, 3), (21, 3), (25, 2)]
    left = {r["doc_id"]: r for r in S.remove(docs).collect()}
    assert set(left) == set(texts) - {25}
    assert all(left[i]["text"] == texts[i] for i in texts if i not in (9, 14, 21, 25))
    joined = " ".join(passage[5:-5])
    assert all(joined not in left[i]["text"] and left[i]["n_chars"] == len(left[i]["text"]) for i in (9, 14, 21))
    assert " ".join(own[9][:38]) in left[9]["text"] and " ".join(own[9][43:]) in left[9]["text"]


def test_true_source_behind_earlier_holders(make):
    """Two earlier documents hold a passage's lines singly; its true source is later than both."""
    rng, rows, true = random.Random(6), [], set()
    for n in range(0, 200, 5):
        lines = [words(rng, 26), words(rng, 26)]
        held = [lines[0], lines[1], lines[0] + lines[1], lines[0], lines[0] + lines[1]]
        rows += [(n + i, " ".join(words(rng, 40) + x + words(rng, 40))) for i, x in enumerate(held)]
        true.add((n + 4, n + 2))
    got = {(r["doc_id"], r["source_id"]) for r in S.repeats(make(rows)).collect()}
    assert got == true


def test_verbatim_spans_against_all_pairs(make):
    """Of every span of MIN_WORDS + PICK - 1 words that any earlier document has, found by trying all pairs, MIN_WORDS are covered."""
    rng, least = random.Random(9), S.MIN_WORDS + S.PICK - 1
    pool = [words(rng, rng.randint(20, 120)) for _ in range(12)]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 4)):
            passage = rng.choice(pool)
            a = rng.randrange(len(passage))
            parts += words(rng, rng.randint(0, 30)) + passage[a : a + rng.randint(10, 120)]
        texts.append(parts)
    held: dict[tuple, int] = {}
    for i, text in enumerate(texts):
        for p in range(len(text) - least + 1):
            held.setdefault(tuple(text[p : p + least]), i)
    spans = [(i, p) for i, text in enumerate(texts) for p in range(len(text) - least + 1) if held[tuple(text[p : p + least])] < i]
    assert len({i for i, _ in spans}) > 20
    covered: dict[int, set] = {}
    for r in S.repeats(make([(i, " ".join(t)) for i, t in enumerate(texts)])).collect():
        assert r["source_id"] < r["doc_id"] and r["similarity"] >= S.SIMILAR
        covered.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    few = [(i, p) for i, p in spans if len(covered.get(i, set()).intersection(range(p, p + least))) < S.MIN_WORDS]
    assert not few


def test_halves_of_a_passage_in_other_documents(make):
    """The first half and the rest stand in two early documents; the whole passage, once more and edited, in later ones."""
    rng = random.Random(10)
    whole = words(rng, 70)
    edited = [words(rng, 1)[0] if i % 13 == 6 else w for i, w in enumerate(whole)]
    pad = lambda x: " ".join(words(rng, 20) + x + words(rng, 20))
    got = {(r["doc_id"], r["source_id"]): r["end"] - r["start"] for r in S.repeats(make([(1, pad(whole[:35])), (2, pad(whole[35:])), (10, pad(whole)), (11, pad(whole)), (12, pad(edited))])).collect()}
    assert set(got) == {(11, 10), (12, 10)}
    assert got[11, 10] == 70 and got[12, 10] >= 60


def test_find_meets_edited_passages(make):
    """Every passage with replaced words that the alignment accepts is also met by its seeds."""
    rng, rows, sure = random.Random(8), [], set()
    code = lambda text: np.array([zlib.crc32(w.encode()) & 0xFFFF for w in text], np.uint16)
    for n in range(0, 600, 2):
        passage = words(rng, (52, 60, 80)[n // 2 % 3])
        edited = [words(rng, 1)[0] if rng.random() < (0.08, 0.1, 0.15)[n // 6 % 3] else w for w in passage]
        a, b = (words(rng, 30) + x + words(rng, 30) for x in (edited, passage))
        rows += [(n, " ".join(b)), (n + 1, " ".join(a))]
        if S.passages(code(a), code(b)):
            sure.add((n + 1, n))
    got = {(r["doc_id"], r["source_id"]) for r in S.repeats(make(rows)).collect()}
    print("edited passages:", len(rows) // 2, "aligned:", len(sure), "found:", len(got & sure))
    assert len(got & sure) >= 0.98 * len(sure) > 200


def test_odd_rows(odd, make):
    got = S.report(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert (by[5]["source_ids"], by[5]["n_repeated"], by[4]["n_passages"]) == ([4], by[5]["n_words"], 0)
    left = S.remove(odd)
    assert left.columns == odd.columns and left.count() == odd.count() - 1
    assert S.report(make([(1, "x")]).limit(0)).count() == 0
    assert S.remove(make([(1, "x")]).limit(0)).count() == 0


def test_columns_of_any_name(odd, clash):
    docs = clash(odd)
    left = S.remove(docs)
    assert left.columns == docs.columns
    assert {(r["doc_id"], r["_spans"], r["a.b"]) for r in left.collect()} == {(i, f"_spans of {i or 'none'}", f"a.b of {i or 'none'}") for i in (None, 1, 2, 3, 4, 6, 7, 8, 9, 10)}
