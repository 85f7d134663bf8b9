"""The pipeline over planted documents, stage by stage and as a whole."""

import random

import pytest
from paths import SF

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages():
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "packing"]


def test_planted_documents(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/documents.parquet").toPandas().head(150)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    rng = random.Random(5)
    base = [t for t in source.text if 120 < len(t.split()) < 400]
    passage = " ".join(base[1].split()[10:80])
    words = base[2].split()
    words[7] = "changed"
    planted = {
        9000: base[0],  # an exact copy
        9001: " ".join(words),  # a near copy
        9002: " ".join(base[3].split()[:30] + passage.split() + base[4].split()[:30]),  # a repeated passage
        9003: " ".join(rng.sample(base[5].split(), 90)) + " " + bench.text[0],  # a benchmark item
        9004: "12345 67890 !!! ???",  # no language
    }
    rows = [tuple(r) for r in source[["doc_id", "text", "lang", "source", "n_chars"]].itertuples(index=False)] + [(i, t, None, "s", len(t)) for i, t in planted.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    left, kept = docs, {}
    for name, stage in pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path)).cache()
        assert left.columns == docs.columns
        kept[name] = {r["doc_id"]: r for r in left.collect()}
    assert 9004 not in kept["language_id"] and {9000, 9001, 9002, 9003} <= set(kept["language_id"])
    assert not {9000, 9001} & set(kept["near_dedup"]) and {9002, 9003} <= set(kept["near_dedup"])
    cut = kept["substring_dedup"][9002]
    assert " ".join(passage.split()[5:-5]) not in cut["text"] and cut["n_chars"] == len(cut["text"])
    assert 9003 not in kept["decontamination"] and 9002 in kept["decontamination"]
    packed = pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(packed.doc_id) == set(kept["decontamination"])
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
