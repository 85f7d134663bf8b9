"""URL lists in time, token-count deltas, shards in training order."""

import datetime as dt
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from paths import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skald.llm import entry, shards, token_counts, url_filters
from skald.llm.tokens import default_path


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


@pytest.fixture
def events(spark):
    rows = [
        ("bad.org", "l", "block", "add", day(10)), ("bad.org", "l", "block", "add", day(12)), ("bad.org", "l", "block", "remove", day(20)), ("bad.org", "l", "block", "add", day(30)),
        ("bad.org/ok", "l", "allow", "add", day(0)), ("tie.org", "l", "block", "add", day(0)), ("tie.org", "m", "allow", "add", day(0)), ("gone.org", "l", "block", "remove", day(1)),
        ("once.org", "l", "block", "add", day(5)), ("once.org", "l", "block", "remove", day(5)), (None, "l", "block", "add", day(0)), ("x.org", "l", "block", "odd", day(0)),
    ]
    return spark.createDataFrame(rows, "entry string, list string, verdict string, action string, at timestamp")


@pytest.mark.parametrize("most", [200_000, 1])
def test_lists_as_of_the_fetch(spark, events, most):
    cases = [
        ("http://bad.org/x", 9, False), ("http://bad.org/x", 10, True), ("http://www.BAD.org:80/x?q", 19, True), ("http://bad.org/x", 20, False), ("http://bad.org/x", 99, True),
        ("http://notbad.org/", 15, False), ("http://bad.org/ok/deep", 15, False), ("http://bad.org/okay", 15, True), ("http://u:p@bad.org", 15, True), ("http://tie.org", 3, True),
        ("http://gone.org", 3, False), ("http://once.org", 6, False), ("no url", 15, False), (None, 15, False), ("http://bad.org/x", None, False), ("http://bad.org/x", 10, True), ("http://x.org", 3, False),
    ]
    captures = spark.createDataFrame([(i, u, day(d) if d is not None else None, "clash") for i, (u, d, _) in enumerate(cases)], "page_id long, url string, fetched_at timestamp, entry string")
    got = {r["page_id"]: r["blocked"] for r in url_filters.judge(captures, events, most_broadcast=most).collect()}
    assert got == {i: b for i, (_, _, b) in enumerate(cases)}
    assert url_filters.judge(captures, events.limit(0)).filter("blocked").count() == 0
    assert url_filters.judge(captures.limit(0), events).count() == 0


def test_entries_in_any_case_and_clashing_columns(spark):
    rows = [("h.org/Docs//x/", "l", "block", "add", day(0)), ("Bad.org", "l", "block", "add", day(0)), ("bad.ORG", "l", "block", "remove", day(5)), ("h.org/b", "l", "block", "add", day(0))]
    events = spark.createDataFrame(rows, "entry string, list string, verdict string, action string, at timestamp")
    cases = [("http://H.org/Docs/x/y", 1, True), ("http://h.org//Docs/x", 1, True), ("http://h.org/docs/x", 1, False), ("http://h.org/Docs/xy", 1, False), ("http://sub.bad.org", 4, True), ("http://bad.org", 6, False), ("http://h.org/b", 1, True), ("http://h.org/", 1, False)]
    captures = spark.createDataFrame([(i, u, day(d), "a", 7, True, "c", "d", "e") for i, (u, d, _) in enumerate(cases)], "page_id long, url string, fetched_at timestamp, Host string, n_active int, blocked boolean, decided_by string, _u string, `a.b` string")
    out = url_filters.judge(captures, events)
    assert out.columns == ["page_id", "url", "fetched_at", "_u", "a.b", "host", "n_active", "decided_by", "blocked"]
    got = {r["page_id"]: r for r in out.collect()}
    assert {i: r["blocked"] for i, r in got.items()} == {i: b for i, (_, _, b) in enumerate(cases)}
    assert got[0]["host"] == "h.org" and got[0]["decided_by"] == "h.org/Docs/x" and got[0]["_u"] == "d"


def test_a_very_long_url(spark):
    """Its keys take time in proportion to its length."""
    events = spark.createDataFrame([("h.org/a", "l", "block", "add", day(0)), ("h.org/a/a/a/a", "l", "allow", "add", day(0))], "entry string, list string, verdict string, action string, at timestamp")
    captures = spark.createDataFrame([(1, "http://h.org" + "/a" * 200_000, day(1)), (2, "http://" + "a." * 50_000 + "h.org/a", day(1))], "page_id long, url string, fetched_at timestamp")
    began = time.time()
    got = {r["page_id"]: (r["n_active"], r["blocked"]) for r in url_filters.judge(captures, events).select("page_id", "n_active", "blocked").collect()}
    assert got == {1: (2, False), 2: (0, False)} and time.time() - began < 20


def test_url_and_rollup_queries_equal_sql(spark):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in entry.oracle_sql().items():
        ours, theirs = entry.queries()[name](spark, SF).toPandas(), con.execute(sql).df()
        columns = sorted(ours.columns)
        assert columns == sorted(theirs.columns)
        plain = lambda d: sorted(map(repr, d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False, name=None)))
        assert plain(ours) == plain(theirs), name


SCHEMA = "doc_id long, kind string, source string, lang string, tokenizer string, tokens long, seq int"


@pytest.mark.parametrize("share", [0.0, 0.5, 100.0])
def test_deltas_against_a_ledger(spark, tmp_path, share):
    """With a snapshot after every batch, now and then, and hardly ever."""
    store = token_counts.Rollup(spark, str(tmp_path / "roll"), share=share)
    batches = [
        [(1, "insert", "a", "en", "v1", 10, 0), (2, "insert", "a", "en", "v1", 5, 0), (3, "insert", None, None, "v1", 7, 0), (1, "insert", "a", "en", "v2", 20, 0), (None, "insert", "a", "en", "v1", 1, 0), (4, "odd", "a", "en", "v1", 1, 0)],
        [(1, "revise", "b", "en", "v1", 11, 0), (2, "delete", "a", "en", "v1", None, 0), (9, "delete", "a", "en", "v1", 3, 0), (8, "revise", "a", "de", "v1", None, 0), (3, "insert", None, None, "v1", 9, 1), (3, "delete", None, None, "v1", 9, 0)],
        [],
        [(2, "insert", "a", "en", "v1", 6, 0), (3, "delete", None, None, "v1", 0, 0), (1, "insert", "a", "en", "v2", 21, 0), (1, "insert", "a", "en", "v2", 21, 0)],
    ]
    now = {}
    for i, rows in enumerate(batches):
        changes = spark.createDataFrame(rows, SCHEMA)
        assert store.apply(str(i), changes)
        assert not store.apply(str(i), changes)  # a replay counts nothing
        last = {}
        for doc, kind, source, lang, version, n, seq in sorted(rows, key=lambda r: (r[6], r[1])):
            if doc is not None and kind != "odd":
                last[doc, version] = (kind, source, lang, n or 0)
        for key, (kind, source, lang, n) in last.items():
            now.pop(key, None)
            if kind != "delete":
                now[key] = (source, lang, n)
        docs, tokens = Counter(), Counter()
        for (_, version), (source, lang, n) in now.items():
            docs[source, lang, version] += 1
            tokens[source, lang, version] += n
        assert {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in store.totals().collect()} == {k: (docs[k], tokens[k]) for k in docs}
    assert store.batches() == ["0", "1", "2", "3"]
    assert len(store._names("snapshots")) == (3 if share == 0 else len(store._names("snapshots"))) and store._names("snapshots")
    with pytest.raises(ValueError):
        store.apply("../x", changes)


def test_a_batch_that_broke_off_leaves_nothing(spark, tmp_path):
    store = token_counts.Rollup(spark, str(tmp_path / "roll"))
    rows = spark.createDataFrame([(1, "insert", "a", "en", "v", 1, 0)], SCHEMA)
    broken = rows.withColumn("tokens", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        store.apply("0", broken)
    assert store.totals().count() == 0
    assert store.apply("0", rows) and store.totals().first()["n_tokens"] == 1


def test_counts_are_the_tokenizers(odd):
    plain = Tokenizer.from_file(default_path())
    plain.encode_special_tokens = True
    got = token_counts.bpe_counts(odd.select("doc_id", "text")).collect()
    want = [(r["doc_id"], len(plain.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect()]
    assert sorted(((r["doc_id"], r["tokens"]) for r in got), key=repr) == sorted(want, key=repr)


def test_shards_hold_every_id_in_slot_order(make, tmp_path):
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(60)] + [(60, None), (7, "text number 7 ")]
    docs, path = make(rows).repartition(3), f"file://{tmp_path}/s"
    stored = docs.cache()
    order = [(r["doc_id"], r["text"]) for r in stored.collect()]
    got = shards.write(stored, path, length=32, shard_rows=8).orderBy("slot").toPandas()
    n = len(got)
    assert got.slot.tolist() == list(range(n)) and n > 8
    plain = Tokenizer.from_file(default_path())
    want = Counter(t for _, x in order for t in [*plain.encode(x or "", add_special_tokens=False).ids, 0])
    read, seen = list(shards.read(path, 0, n, length=32, shard_rows=8)), Counter()
    for r, ids in zip(got.itertuples(), read):
        own = ids[: r.n_tokens].astype("<u4")
        assert zlib.crc32(own.tobytes()) == r.ids_crc32 and (ids[r.n_tokens :] == 0).all()
        assert (r.shard, r.byte_offset) == (r.slot // 8, r.slot % 8 * 64)
        seen.update(own.tolist())
    assert seen == want
    assert {d for x in got.doc_ids for d in x} == set(range(61))
    again = list(shards.read(path, 5, 6, length=32, shard_rows=8))
    assert all(np.array_equal(a, b) for a, b in zip(again, read[5:11]))
    shards.write(stored, path, length=32, shard_rows=8)  # a second try leaves the same bytes
    assert all(np.array_equal(a, b) for a, b in zip(read, shards.read(path, 0, n, length=32, shard_rows=8)))


def test_shards_of_odd_rows(odd, make, tmp_path):
    got = shards.write(odd, f"file://{tmp_path}/o", length=4096).toPandas()
    assert got.slot.nunique() == len(got)
    assert shards.write(make([(1, "x")]).limit(0), f"file://{tmp_path}/e").count() == 0


def test_shards_of_rows_in_no_fixed_order(spark, make, tmp_path):
    """Behind a shuffle whose order may change the input is read once: every document is there once."""
    docs = make([(i, f"text number {i} " * 5) for i in range(40)]).repartition(7).orderBy(F.rand())
    got = shards.write(docs, f"file://{tmp_path}/out", length=32, shard_rows=8).toPandas()
    assert sorted(got.slot) == list(range(len(got))) and Counter(d for x in got.doc_ids for d in set(x)).keys() == set(range(40))
    assert sum(got.n_tokens) == sum(len(x) for x in ([*Tokenizer.from_file(default_path()).encode(f"text number {i} " * 5, add_special_tokens=False).ids, 0] for i in range(40)))
