"""Positive-unlabelled learning: held-out accuracy, its prior, nothing learnt from held-out labels."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skald.llm import quality as C
from skald.llm.language_id import held_out

SF = "/root/testdata/sf0.01"


def test_features():
    x = C.features(pa.array(["AAA bbb", None, "", "a a a a", "Ünï\ncode 42"]))
    assert x.shape == (5, C.WIDTH) and np.isfinite(x).all()
    assert np.array_equal(x[1], x[2])
    assert x[3, C._CELLS + 6] > x[0, C._CELLS + 6]  # words that repeat their neighbour


def test_negative_risk_is_not_chased():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(1.5, 1, (1500, 6)), rng.normal(-1.5, 1, (1500, 6))
    positive, unlabelled = good[:500], np.concatenate([good[500:], bad[:500]])
    net = C.fit(positive, unlabelled, 2 / 3)
    z = net.z(net.norm(np.concatenate([good[500:], bad[500:]])))
    assert ((z > 0) == (np.arange(len(z)) < 1000)).mean() > 0.95
    x, n = np.concatenate([positive, unlabelled]), np.arange(2000)
    prior = C.class_prior(x, (n < 500) & (n % 4 > 0), (n >= 500) & (n % 4 > 0), (n < 500) & (n % 4 == 0), (n >= 500) & (n % 4 == 0))
    assert abs(prior - 2 / 3) < 0.12


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = C.classify(docs.withColumn("score", F.lit("clash")), labels).withColumn("held", held_out()).join(labels, "doc_id").filter("held").toPandas()
    assert ((got.score >= 0.7).astype(int) == got.predicted).all()
    assert (got.predicted == got.quality).mean() > 0.93
    assert got[got.quality == 0].score.median() < 0.3 < 0.8 < got[got.quality == 1].score.median()


def test_held_out_labels_do_not_matter(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (C.classify(docs, x).orderBy("doc_id").select("score").limit(50).collect() for x in (labels, turned))
    assert a == b


def test_odd_rows(spark, odd, make):
    labels = spark.createDataFrame([(4, 1), (5, 1), (6, 0), (6, 0), (9, 1), (None, 1), (8, None), (77, 1)], "doc_id long, quality int")
    got = C.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[1] == by[2] and by[4] == by[5]
    assert {r["score"] for r in C.classify(odd, labels.filter("quality = 0")).collect()} == {0.5}
    assert C.classify(make([(1, "x")]).limit(0), labels).count() == 0
    assert C.classify(odd, labels.limit(0)).count() == odd.count()


def test_columns_of_any_name(odd, clash):
    got = C.score(clash(odd), None)
    assert got.columns == [c for c in clash(odd).columns if c not in ("score", "predicted")] + ["score", "predicted"]
    assert got.filter("predicted <> 0 or score <> 0.5").count() == 0


def test_gradient_of_the_risk():
    """One step's gradient against differences of the non-negative risk itself, on either side of its border."""
    rng = np.random.default_rng(7)
    xp, xu = rng.normal(1, 1, (40, 6)), rng.normal(0, 1, (60, 6))
    loss = lambda z: 1 / (1 + np.exp(z))

    def terms(net):
        lp, lu = loss(net.z(xp)), loss(net.z(xu))
        return lp.mean(), (1 - lu).mean() - prior * (1 - lp).mean()

    for prior, sign in ((0.2, 1), (0.95, -1)):
        net = C.Network(np.zeros(6), np.ones(6), seed=3)
        if sign < 0:
            net.p[3][0] = -3.0
            if terms(net)[1] > 0:  # where unlabelled rows score less, the second term is under zero
                xp, xu = xu, xp
        assert np.sign(terms(net)[1]) == sign
        value = lambda: prior * terms(net)[0] + terms(net)[1] if sign > 0 else -terms(net)[1]
        got = C.risk_gradient(net, xp, xu, prior)
        for p, g in zip(net.p, got):
            flat = p.reshape(-1)
            for i in rng.choice(flat.size, min(flat.size, 8), replace=False):
                old, h = flat[i], 1e-5
                flat[i] = old + h
                up = value()
                flat[i] = old - h
                down = value()
                flat[i] = old
                assert abs((up - down) / (2 * h) - g.reshape(-1)[i]) < 1e-6
