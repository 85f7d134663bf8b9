"""The adaptive scan against all distances."""

import numpy as np
import pytest
from paths import SF
from pyspark.sql import functions as F

from skald.llm import ann as A


def exact(ids, x, asked, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in asked:
        s = unit @ unit[q]
        others = np.flatnonzero(ids != ids[q])
        order = others[np.lexsort((ids[others], -s[others]))][:k]
        out[int(ids[q])] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def test_scan_finds_the_nearest():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(1500, 40)), np.repeat(rng.normal(size=(1, 40)), 30, axis=0)])
    ids = rng.permutation(len(x))
    asked = np.array([0, 5, 1510, 1529])
    rotation = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    j, i, score = A.scan(x[asked], ids[asked], x, ids, rotation, 5)
    want = exact(ids, x, asked, 5)
    for r, q in enumerate(asked):
        assert np.allclose(score[j == r], [s for _, s in want[int(ids[q])]], atol=1e-12)
        if q >= 1500:  # copies: the smallest ids
            assert ids[i[j == r]].tolist() == [v for v, _ in want[int(ids[q])]]


@pytest.mark.parametrize("sample", [20_000, 400])
def test_recall_against_brute_force(spark, sample):
    """With centroids of the one sample, and with those of cells."""
    v = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id")
    table = v.toPandas()
    ids, x = table.vec_id.to_numpy(), np.stack(table.embedding.to_numpy()).astype(float)
    got = A.search(v, F.col("id") % 5 == 0, sample=sample).toPandas()
    want = exact(ids, x, np.flatnonzero(ids % 5 == 0), 5)
    assert set(got.query_id) == set(want)
    found = sum(len(set(g.vec_id) & {i for i, _ in want[q]}) for q, g in got.groupby("query_id"))
    assert found / (5 * len(want)) >= 0.9
    scores = {q: dict(zip(ids.tolist(), (x @ x[np.flatnonzero(ids == q)[0]]) / np.linalg.norm(x, axis=1) / np.linalg.norm(x[np.flatnonzero(ids == q)[0]]))) for q in want}
    assert all(abs(scores[r.query_id][r.vec_id] - r.score) < 1e-12 for r in got.itertuples())
    for _, g in got.sort_values("rank").groupby("query_id"):
        assert g["rank"].tolist() == [1, 2, 3, 4, 5] and g.score.is_monotonic_decreasing


@pytest.mark.parametrize("chunk", [4096, 7])
def test_ties_copies_and_odd_vectors(spark, monkeypatch, chunk):
    monkeypatch.setattr(A, "CHUNK", chunk)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(60)] + [(100, [3.0, -1.0, 0.5]), (101, None), (102, [0.0, 0.0, 0.0]), (103, [1.0, None, 2.0]), (104, [float("nan"), 1.0, 1.0]), (105, [float("inf"), 1.0, 1.0]), (106, []), (107, [1.0]), (5, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = A.search(v, F.col("id") % 50 == 0).orderBy("query_id", "rank").toPandas()
    assert got[got.query_id == 0].vec_id.tolist() == [1, 2, 3, 4, 5]
    assert got[got.query_id == 50].vec_id.tolist() == [0, 1, 2, 3, 4]
    assert got[got.query_id == 100].vec_id.tolist() == [0, 1, 2, 3, 4]
    few = A.search(v.filter("vec_id in (0, 1, 100, 102)"), F.col("id") % 50 == 0).orderBy("query_id", "rank").toPandas()
    assert few[few.query_id == 0].vec_id.tolist() == [1, 100]
    assert A.search(v.limit(0), F.col("id") % 50 == 0).count() == 0
    assert A.search(v.filter("vec_id = 0"), F.col("id") % 50 == 0).count() == 0


def test_very_small_and_large_components(spark):
    """Their squares are 0 or infinite; their cosines are not."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 6))
    size = 10.0 ** np.where(np.arange(40) % 3 == 0, -200, np.where(np.arange(40) % 3 == 1, 200, 0))
    v = spark.createDataFrame([(i, (r * s).tolist()) for i, (r, s) in enumerate(zip(x, size))], "vec_id long, embedding array<double>")
    got = A.search(v, F.col("id") % 10 == 0, recall=1.0).toPandas()
    want = exact(np.arange(40), x, [0, 10, 20, 30], 5)
    for q, g in got.sort_values("rank").groupby("query_id"):
        assert g.vec_id.tolist() == [i for i, _ in want[q]] and np.allclose(g.score, [s for _, s in want[q]], atol=1e-12)
