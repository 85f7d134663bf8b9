"""The refresh state machine, its store, and the stream in front of it."""

import pytest
from pyspark.sql import functions as F

from skald.operators import refresh
from skald.streaming import refresh_stream

NOW, POLICY = 1_000_000_000, refresh.Policy(min_words=3, revisit_seconds=604_800)


def page(url, text):
    return (url, "Wikipedia", f"<p>{text}</p>" if text else None, text)


@pytest.fixture
def pages(spark):
    return lambda *rows: refresh.prepared(spark.createDataFrame([page(*r) for r in rows], "url string, source_name string, raw_html string, clean_text string"))


def stored(spark, pages, url, text, age):
    new = refresh.refresh(spark.createDataFrame([], refresh.STORE), pages((url, text)), NOW - age, POLICY)
    return new


@pytest.mark.parametrize(
    ("before", "fetched", "action", "counter"),
    [
        (("one two three", 10), "four five six", "fresh", "skipped"),
        (("one two three", 604_800), "one two three", "touch", "skipped"),
        (("one two three", 604_800), "four five six", "update", "updated"),
        (("one two three", 604_800), "one two", "delete", "too_short"),
        (None, "one two", "short", "too_short"),
        (None, "one two three", "insert", "downloaded"),
        (None, None, "failed", "skipped"),
        (("one two three", 700_000), None, "failed", "skipped"),
    ],
)
def test_actions(spark, pages, before, fetched, action, counter):
    store = stored(spark, pages, "http://a/x", *before) if before else spark.createDataFrame([], refresh.STORE)
    got = pages(("http://a/x?y#z", fetched))
    row = refresh.decide(store, got, NOW, POLICY).select("action", "counter").first()
    assert (row["action"], row["counter"]) == (action, counter)
    after = {r["normalized_url"]: r for r in refresh.refresh(store, got, NOW, POLICY).collect()}
    if action in ("delete", "short") or (action == "failed" and not before):
        assert not after
    else:
        r = after["http://a/x"]
        assert r["clean_text"] == (fetched if action in ("insert", "update") else before[0])
        assert r["updated_at"] == (NOW if action in ("touch", "insert", "update") else NOW - before[1])
        assert r["status"] == "processed"


def test_word_count_after_update(spark, pages):
    store = stored(spark, pages, "http://a/x", "one two three", 700_000)
    new = pages(("http://a/x", "one two three four"))
    count = lambda p: refresh.refresh(store, new, NOW, p).first()["word_count"]
    assert (count(POLICY), count(refresh.Policy(3, 604_800, refresh_word_count=False))) == (4, 3)


def test_unique_urls_and_untouched_rows(spark, pages):
    store = stored(spark, pages, "http://a/x", "one two three", 700_000).union(stored(spark, pages, "http://a/y", "one two three", 5))
    new = refresh.refresh(store, pages(("http://a/z", "a b c d"), ("http://a/z?q", "a b c d"), ("http://a/w", "a b c d")), NOW, POLICY)
    assert sorted(r["normalized_url"] for r in new.collect()) == ["http://a/w", "http://a/x", "http://a/y", "http://a/z"]
    assert refresh.due_for_revisit(store, NOW, 7).count() == 1
    assert refresh.get_document(store, "http://a/x?1").count() == 1
    assert refresh.existing(spark.createDataFrame([("http://a/x",), ("q",)], "normalized_url string"), store).count() == 1
    assert refresh.visited_urls(store, 1).count() == 1


def test_budget(spark):
    visits = spark.createDataFrame([(i, i % 2 == 0) for i in range(20)], "visit_seq long, is_write boolean")
    assert sorted(r[0] for r in refresh.within_budget(visits, 3).collect()) == [0, 1, 2, 3, 4]
    assert refresh.within_budget(visits, 0).count() == 20


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [page("http://a/x", "one two three"), page("http://a/y", "one")]
    schema = "url string, source_name string, raw_html string, clean_text string"
    spark.createDataFrame(rows, schema).write.parquet(source)
    for text in ("one two three", "one two three four"):
        pages = spark.readStream.schema(schema).parquet(source)
        refresh_stream.start(pages, str(tmp_path / "store"), str(tmp_path / "ck"), lambda: NOW, POLICY).awaitTermination()
        spark.createDataFrame([page("http://a/z", text)], schema).write.mode("append").parquet(source)
    found = refresh_stream.read_store(spark, str(tmp_path / "store"))
    assert sorted(r["normalized_url"] for r in found.select(F.col("normalized_url")).collect()) == ["http://a/x", "http://a/z"]


def test_a_batch_tried_again_and_versions_that_expire(spark, pages, tmp_path):
    """An epoch keeps the time of its first try; untouched buckets stay where they are; old versions go."""
    times = iter(range(NOW, NOW + 10_000_000, 700_000))
    store = refresh_stream.BucketedStore(spark, str(tmp_path / "store"), buckets=8)
    urls = [f"http://a/{i}" for i in range(30)]
    store.merge(pages(*((u, "one two three") for u in urls)), 0, lambda: next(times), POLICY)
    first = store.version()
    some = [(u, "four five six") for u in urls[:2]]
    store.merge(pages(*some), 1, lambda: next(times), POLICY)
    once = sorted(map(repr, store.read().collect()))
    store.merge(pages(*some), 1, lambda: next(times), POLICY)  # again
    assert sorted(map(repr, store.read().collect())) == once
    changed = {b for b, e in store.version().items() if e == 1}
    assert 1 <= len(changed) <= 2 and all(store.version()[b] == first[b] for b in first if b not in changed)
    assert {r["clean_text"] for r in store.read().filter(F.col("updated_at") == NOW + 700_000).collect()} == {"four five six"}
    store.merge(pages(*((u, "x") for u in urls)), 2, lambda: next(times) + 700_000, POLICY)  # too short: all go
    assert store.read().count() == 0 and store.read(before=2).count() == 30
    store.merge(pages(("http://a/1", "seven eight nine")), 3, lambda: next(times), POLICY)
    assert store.epochs() == [2, 3] and store.read().count() == 1 and store._names("data") == ["000000000003"]
