"""Packing: an exact round trip of ids, gapless sequences, few of them."""

import random
import zlib

import numpy as np
import pandas as pd
from tokenizers import Tokenizer

from skald.llm import packing as P
from skald.llm.tokens import default_path


def test_plans_use_every_piece_once():
    rng = np.random.default_rng(6)
    for _ in range(200):
        cap = int(rng.integers(1, 50))
        counts = np.bincount(rng.integers(1, cap + 1, rng.integers(0, 90)), minlength=cap + 1)
        plan, used = P.Plan(counts), np.zeros(cap + 1, int)
        for lengths, times in plan.patterns:
            assert times > 0 and sum(lengths) <= cap
            for x in lengths:
                used[x] += times
        assert (used == counts).all()
        for x in np.flatnonzero(counts):  # each piece has a place of its own
            seq, offset = plan.place(np.full(counts[x], x), np.arange(counts[x]))
            assert len(set(zip(seq.tolist(), offset.tolist()))) == counts[x]


def test_exact_complements():
    assert P.Plan(np.bincount([7, 3], minlength=11)).n == 1
    assert P.Plan(np.bincount([5, 3, 2] * 4, minlength=11)).n == 4
    assert P.Plan(np.bincount([4, 3, 2, 1] * 3, minlength=11)).n == 3
    assert P.Plan(np.bincount([6] * 5 + [2] * 10, minlength=11)).n == 5


def check(df: pd.DataFrame, cap: int):
    df = df.sort_values(["sequence_id", "offset"])
    size = df.groupby("sequence_id").length
    assert (size.cumsum() - df.length == df.offset).all()
    assert size.sum().max() <= cap


def test_round_trip(make):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "Größe", "x"]) for _ in range(rng.randint(0, 90)))) for i in range(120)] + [(500, None), (501, "")]
    got = P.pack(make(rows), cap=64).toPandas()
    check(got, 64)
    plain = Tokenizer.from_file(default_path())
    for doc, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        own = got[got.doc_id == doc].sort_values("piece")
        assert own.piece.tolist() == list(range(len(own)))
        assert own.length.tolist()[1:] == [64] * (len(own) - 1)
        assert own.length.sum() == len(ids)
        for r in own.itertuples():
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert got.sequence_id.nunique() <= 1.03 * got.length.sum() / 64 + 1


def test_groups_of_one_length_are_numbered_in_parts(make, monkeypatch):
    monkeypatch.setattr(P, "FEWEST", 3)
    monkeypatch.setattr(P, "GROUP", 3)
    got = P.pack(make([(i, "same text") for i in range(50)] + [(1, "same text")]), cap=8).toPandas()
    assert len(got) == 51
    check(got, 8)
    assert not got.duplicated(["sequence_id", "offset"]).any()


def test_odd_rows(odd, make):
    got = P.pack(odd).toPandas()
    check(got, 2048)
    assert set(got.doc_id.dropna()) == set(range(1, 11)) and got.doc_id.isna().sum() == 1
    assert (got[got.doc_id.isin([1, 2])].length == 1).all()
    assert P.pack(make([(1, "x")]).limit(0)).count() == 0
