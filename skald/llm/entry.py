"""The registered queries of this package and the SQL that some of them equal."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skald.llm import ann, decontaminate, language_id, neardup, packing, quality, shards, substring, token_counts, url_filters
from skald.llm.common import drop, settle, shared_dir
from skald.sources.tables import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs).withColumn("held_out", language_id.held_out())
    return found.select("doc_id", "held_out", "lang_pred", "score", "margin", "entropy", "rejected")


def captures(pages: DataFrame) -> DataFrame:
    """The pages as captures: fetched 11 hours apart, in a cycle of two years from 2024 on."""
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.col("page_id"), F.lit(1600)) * 39_600)
    return pages.select("page_id", "url", at.alias("fetched_at"))


def list_events(pages: DataFrame) -> DataFrame:
    """A dated list about the pages' hosts, drawn by hash: half of the hosts are blocked at some day, most of these released later; a fifth of the top-level parts and some first path steps are listed too. Added hosts are written with a capital."""
    number = lambda x, n: F.pmod(F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"), F.lit(n))
    host = url_filters.host(F.col("url"))
    hosts = pages.select(host.alias("entry")).filter("entry is not null").distinct()
    parents = hosts.select(F.regexp_replace("entry", r"^[^.]*\.", "").alias("entry")).distinct()
    steps = pages.select(F.concat(host, F.lit("/"), F.regexp_extract("url", r"^[^:/?#]+://[^/?#]*/([^/?#]+)", 1)).alias("entry")).filter("entry is not null and not entry like '%/'").distinct()
    chosen = hosts.filter(number(F.col("entry"), 2) == 0).select("entry", F.lit("hosts").alias("list"), F.lit("block").alias("verdict"))
    chosen = chosen.union(parents.filter(number(F.col("entry"), 5) == 0).select("entry", F.lit("parents"), F.lit("block")))
    chosen = chosen.union(steps.filter(number(F.col("entry"), 4) == 0).select("entry", F.lit("paths"), F.lit("allow")))
    start = number(F.concat("entry", F.lit("+")), 400)
    written = F.concat(F.upper(F.substring("entry", 1, 1)), F.substring("entry", 2, 1 << 30)).alias("entry")
    added = chosen.select(written, "list", "verdict", F.lit("add").alias("action"), F.timestamp_seconds(F.lit(1_704_067_200) + start * 86_400).alias("at"))
    length = number(F.concat("entry", F.lit("-")), 500) + 1
    removed = chosen.filter(number(F.concat("entry", F.lit("-")), 3) > 0).select("*", F.lit("remove"), F.timestamp_seconds(F.lit(1_704_067_200) + (start + length) * 86_400))
    return added.union(removed)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.judge(captures(pages), list_events(pages))


def _rolled(spark: SparkSession, docs: DataFrame, count) -> DataFrame:
    """Totals after three batches: all documents, then revisions (a seventh of them, one token more) with deletions (an eleventh), tried twice, then half of the deleted again."""
    path = f"{shared_dir(spark).rstrip('/')}/skald-rollup-{uuid.uuid4().hex}"
    store = token_counts.Rollup(spark, path)
    counted = settle(count(docs))
    store.apply("0", counted.withColumn("kind", F.lit("insert")))
    gone, revised = F.col("doc_id") % 11 == 5, F.col("doc_id") % 7 == 3
    change = counted.filter(gone | revised).withColumn("kind", F.when(gone, "delete").otherwise("revise")).withColumn("tokens", F.col("tokens") + 1)
    store.apply("1", change)
    store.apply("1", change)
    store.apply("2", counted.filter(F.col("doc_id") % 22 == 5).withColumn("kind", F.lit("insert")))
    totals = settle(store.totals())
    drop(spark, path)
    return totals


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(spark, table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), token_counts.bpe_counts)


def word_count_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(spark, table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), token_counts.word_counts)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.classify(docs, table(spark, sf_dir, "labels")).withColumn("held_out", language_id.held_out())
    return found.select("doc_id", "held_out", "score", "predicted")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.write(table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/skald-shards-{uuid.uuid4().hex}")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_url_filters, op3_token_counts, word_count_rollup, op4_quality_classifier, op5_decontamination, op6_training_order, op7_best_fit_packing, op8_substring_dedup, op9_nearest_neighbours, op10_near_duplicates)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP5 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 8) AS m, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 7, 1))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS g
       FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM bw))),
found AS (SELECT doc_id, i, dw.m AS m, item FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS sha FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       coalesce(items.sha, sha256('')) AS items_sha256, coalesce(items.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


_OP2 = r"""
WITH p AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + to_seconds(((page_id % 1600) + 1600) % 1600 * 39600) AS fetched_at,
  nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host,
  list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS steps FROM pages),
hosts AS (SELECT DISTINCT host AS entry FROM p WHERE host IS NOT NULL),
chosen AS (
  SELECT entry, 'block' AS verdict, false AS path FROM hosts WHERE CAST('0x' || substr(md5(entry), 1, 8) AS BIGINT) % 2 = 0
  UNION ALL SELECT * FROM (SELECT DISTINCT regexp_replace(entry, '^[^.]*\.', '') AS entry, 'block', false FROM hosts) WHERE CAST('0x' || substr(md5(entry), 1, 8) AS BIGINT) % 5 = 0
  UNION ALL SELECT * FROM (SELECT DISTINCT host || '/' || steps[1] AS entry, 'allow', true FROM p WHERE host IS NOT NULL AND len(steps) > 0) WHERE CAST('0x' || substr(md5(entry), 1, 8) AS BIGINT) % 4 = 0),
v AS (SELECT entry, verdict, path, TIMESTAMP '2024-01-01' + to_days(CAST(CAST('0x' || substr(md5(entry || '+'), 1, 8) AS BIGINT) % 400 AS INTEGER)) AS f,
  CASE WHEN CAST('0x' || substr(md5(entry || '-'), 1, 8) AS BIGINT) % 3 > 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(CAST('0x' || substr(md5(entry || '+'), 1, 8) AS BIGINT) % 400 + CAST('0x' || substr(md5(entry || '-'), 1, 8) AS BIGINT) % 500 + 1 AS INTEGER)) END AS t FROM chosen),
m AS (SELECT page_id, entry, verdict FROM p JOIN v ON f <= fetched_at AND coalesce(fetched_at < t, true)
  AND CASE WHEN path THEN starts_with(host || '/' || array_to_string(steps, '/') || '/', entry || '/') ELSE ends_with('.' || host, '.' || entry) END),
best AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n, row_number() OVER (PARTITION BY page_id ORDER BY length(entry) DESC, (verdict = 'block') DESC, entry DESC) AS r FROM m)
SELECT p.page_id, p.url, p.fetched_at, p.host, CAST(coalesce(n, 0) AS BIGINT) AS n_active, best.entry AS decided_by, coalesce(verdict = 'block', false) AS blocked
FROM p LEFT JOIN best ON p.page_id = best.page_id AND r = 1
"""

_ROLLUP = r"""
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS n_docs,
  CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + CASE WHEN doc_id % 7 = 3 AND doc_id % 11 <> 5 THEN 1 ELSE 0 END) AS BIGINT) AS n_tokens
FROM documents WHERE doc_id % 11 <> 5 OR doc_id % 22 = 5 GROUP BY source, lang
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": _OP2, "op5_decontamination": _OP5, "word_count_rollup": _ROLLUP}
