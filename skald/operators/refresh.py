"""The document store and its incremental refresh.

One full outer join on the normalised url decides for every fetched page and
stored document what happens, in the order of ACTIONS' rules; the new store is
a projection of the same join, and counters are a count by action.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from skald.functions import text as X

METADATA = T.StructType([T.StructField("title", T.StringType()), T.StructField("language", T.StringType()), T.StructField("categories", T.ArrayType(T.StringType()))])
STORE = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("url", "normalized_url", "source_name", "raw_html", "clean_text")),
        T.StructField("word_count", T.IntegerType()),
        T.StructField("crawled_at", T.LongType()),
        T.StructField("updated_at", T.LongType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("metadata", METADATA),
    ]
)
#: What an update replaces; the rest stays as it was inserted.
UPDATED = ["raw_html", "clean_text", "updated_at", "content_hash", "metadata"]


@dataclass(frozen=True)
class Policy:
    """How often documents are fetched again and how long they must be."""

    min_words: int = 1000
    revisit_seconds: int = 7 * 86_400
    #: An update also sets word_count; False leaves the count of the first insert.
    refresh_word_count: bool = True

    @staticmethod
    def of_days(min_words: int, days: int) -> Policy:
        return Policy(min_words, days * 86_400)


def prepared(fetched: DataFrame) -> DataFrame:
    """Fetched pages (url, clean_text, ...) with normalized_url, content_hash and word_count; the first of equal urls, by visit_seq if there."""
    rows = fetched.withColumn("normalized_url", X.normalize_url(F.col("url"))).withColumn("content_hash", X.content_hash(F.col("clean_text")))
    if "word_count" not in fetched.columns:
        rows = rows.withColumn("word_count", X.count_words(F.col("clean_text")))
    order = ["visit_seq"] if "visit_seq" in fetched.columns else ["url", "content_hash"]
    return rows.withColumn("_r", F.row_number().over(W.partitionBy("normalized_url").orderBy(*order))).filter("_r = 1").drop("_r")


def decide(store: DataFrame, fetched: DataFrame, now: int, policy: Policy = Policy()) -> DataFrame:
    """Full outer join of store (s) and fetched (f) with `action` and `counter`.

    Actions: keep (not fetched), fresh, failed, delete, short, touch, update, insert.
    """
    s, f = store.alias("s"), fetched.alias("f")
    there, came = F.col("s.normalized_url").isNotNull(), F.col("f.normalized_url").isNotNull()
    fresh = F.lit(now) - F.coalesce("s.updated_at", F.lit(0)) < policy.revisit_seconds
    empty = F.coalesce("f.clean_text", F.lit("")) == ""
    short = F.coalesce("f.word_count", F.lit(0)) < policy.min_words
    same = F.col("s.content_hash") == F.col("f.content_hash")
    action = (
        F.when(~came, "keep")
        .when(there & fresh, "fresh")
        .when(F.col("f.clean_text").isNull(), "failed")
        .when(there & (short | empty), "delete")
        .when(short | empty, "short")
        .when(there & same, "touch")
        .when(there, "update")
        .otherwise("insert")
    )
    counter = F.when(action.isin("fresh", "failed", "touch"), "skipped").when(action.isin("delete", "short"), "too_short").when(action == "update", "updated").when(action == "insert", "downloaded")
    return s.join(f, F.col("s.normalized_url") == F.col("f.normalized_url"), "full").withColumn("action", action).withColumn("counter", counter)


def refresh(store: DataFrame, fetched: DataFrame, now: int, policy: Policy = Policy()) -> DataFrame:
    """The store after the fetched pages (prepared()) have been merged in at time now."""
    decided = decide(store, fetched, now, policy).filter(~F.col("action").isin("delete", "short") & ~((F.col("action") == "failed") & F.col("s.normalized_url").isNull()))
    new = set(fetched.columns)
    write = F.col("action").isin("update", "insert")
    inserted = {"crawled_at": F.lit(now), "updated_at": F.lit(now), "status": F.lit("processed")}
    replaced = {*UPDATED, *(["word_count"] if policy.refresh_word_count else [])}
    columns = []
    for field in STORE:
        n = field.name
        value = inserted.get(n, F.col(f"f.{n}") if n in new else F.lit(None)).cast(field.dataType)
        on_update = value if n in replaced else F.col(f"s.{n}")
        if n == "updated_at":
            kept = F.when(F.col("action") == "touch", F.lit(now).cast("long")).otherwise(F.col("s.updated_at"))
        else:
            kept = F.col(f"s.{n}")
        columns.append(F.when(F.col("action") == "insert", value).when(write, on_update).otherwise(kept).alias(n))
    return decided.select(*columns)


def action_counts(decided: DataFrame) -> DataFrame:
    """counter, n of the fetched pages: downloaded, updated, skipped, too_short."""
    return decided.filter("counter is not null").groupBy("counter").agg(F.count("*").alias("n"))


def within_budget(visits: DataFrame, limit: int, *, write_col: str = "is_write", order_col: str = "visit_seq") -> DataFrame:
    """The visits until limit writes have been made (0: all), in order."""
    if not limit:
        return visits
    from skald.operators.tokens import running_sum

    counted = visits.withColumn("_w", F.col(write_col).cast("int"))
    return running_sum(counted, order_col, "_w", "_before").filter(F.col("_before") < limit).drop("_w", "_before")


def due_for_revisit(store: DataFrame, now: int, days: int) -> DataFrame:
    """Documents whose last update lies more than days back."""
    return store.filter(F.col("updated_at") < now - days * 86_400)


def unique_urls(store: DataFrame) -> DataFrame:
    """One row for each normalized_url: the last updated."""
    rows = W.partitionBy("normalized_url").orderBy(F.desc("updated_at"), "content_hash")
    return store.withColumn("_r", F.row_number().over(rows)).filter("_r = 1").drop("_r")


def get_document(store: DataFrame, url: str) -> DataFrame:
    """The document of a url."""
    return store.filter(F.col("normalized_url") == X.normalize_url(F.lit(url)))


def existing(urls: DataFrame, store: DataFrame) -> DataFrame:
    """The urls that the store has."""
    return urls.join(store.select("normalized_url"), "normalized_url", "left_semi")


def visited_urls(store: DataFrame, limit: int = 10_000) -> DataFrame:
    """Up to limit urls of the store."""
    return store.select("normalized_url").limit(limit)


def export_corpus(store: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """doc_id, normalized_url, source_name, title, clean_text of the documents with text, one for each id, as strings."""
    rows = store.filter("clean_text is not null and clean_text <> ''")
    rows = rows.select(F.col(id_col).cast("string").alias("doc_id"), "normalized_url", "source_name", F.coalesce("metadata.title", F.lit("")).alias("title"), "clean_text")
    return rows.withColumn("_r", F.row_number().over(W.partitionBy("doc_id").orderBy("normalized_url", "clean_text"))).filter("_r = 1").drop("_r")
