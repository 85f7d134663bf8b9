"""Corpus, token and store statistics, each as one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skald.functions import text as X


def source_name(col: Column) -> Column:
    """A source trimmed; null and empty are UNKNOWN."""
    return F.trim(F.coalesce(F.nullif(col, F.lit("")), F.lit("UNKNOWN")))


def by_source(corpus: DataFrame, *, source_col: str = "source_name") -> DataFrame:
    """source_name, n."""
    return corpus.groupBy(source_name(F.col(source_col)).alias("source_name")).agg(F.count("*").alias("n"))


def as_map(groups: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """One row with a map from a small grouped table."""
    return groups.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(name))


def corpus_stats(corpus: DataFrame, *, text_col: str = "clean_text") -> DataFrame:
    """documents, clean_text_bytes_total, clean_text_bytes_avg, clean_text_chars_avg, clean_text_words_est_avg; 0 when empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return corpus.agg(
        F.count("*").alias("documents"),
        F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0)).alias("clean_text_bytes_total"),
        zero(F.avg(F.octet_length(text))).alias("clean_text_bytes_avg"),
        zero(F.avg(F.length(text))).alias("clean_text_chars_avg"),
        zero(F.avg(F.size(X.words(text)))).alias("clean_text_words_est_avg"),
    )


def sample_titles(corpus: DataFrame, *, order_col: str = "doc_id", title_col: str = "title", n: int = 10) -> DataFrame:
    """The first n titles that are not blank, in order."""
    return corpus.select(order_col, F.trim(title_col).alias("title")).filter("title <> ''").orderBy(order_col).limit(n)


def truncated_percentile(col: Column, p: float) -> Column:
    """The percentile by linear interpolation, cut to an integer; 0 for no rows."""
    return F.coalesce(F.floor(F.percentile(col, F.lit(min(1.0, max(0.0, p / 100))))), F.lit(0)).cast("long")


def tokens_per_doc_stats(index: DataFrame) -> DataFrame:
    """documents, total, avg, median, p95, min, max of token counts; 0 when empty."""
    n = F.col("token_count")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return index.agg(
        F.count("*").alias("documents"),
        F.coalesce(F.sum(n), F.lit(0)).alias("total"),
        zero(F.avg(n)).alias("avg"),
        zero(F.median(n)).alias("median"),
        truncated_percentile(n, 95).alias("p95"),
        F.coalesce(F.min(n), F.lit(0)).alias("min"),
        F.coalesce(F.max(n), F.lit(0)).alias("max"),
    )


def token_stats(tokens: DataFrame, index: DataFrame, top: int = 30) -> DataFrame:
    """tokens_total, tokens_total_from_docs_idx, avg_token_length_chars, tokens_per_doc (struct), top_tokens (array of structs)."""
    freq = tokens.groupBy("token").agg(F.count("*").alias("freq"))
    about = freq.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("tokens_total"), F.coalesce(F.sum(F.length("token") * F.col("freq")) / F.sum("freq"), F.lit(0.0)).alias("avg_token_length_chars"))
    first = freq.orderBy(F.desc("freq"), "token").limit(top).agg(F.array_sort(F.collect_list(F.struct((-F.col("freq")).alias("k"), "token"))).alias("t"))
    per = tokens_per_doc_stats(index)
    joined = about.crossJoin(first).crossJoin(per)  # one row each
    return joined.select(
        "tokens_total",
        F.col("total").alias("tokens_total_from_docs_idx"),
        "avg_token_length_chars",
        F.struct("avg", "median", "p95", "min", "max").alias("tokens_per_doc"),
        F.transform("t", lambda x: F.struct(x["token"].alias("token"), (-x["k"]).alias("freq"))).alias("top_tokens"),
    )


def raw_store_stats(store: DataFrame) -> DataFrame:
    """Counts, byte totals and averages of the pages and texts that are there."""
    raw, clean = F.col("raw_html"), F.col("clean_text")
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    size = lambda c: F.coalesce(F.sum(F.when(has(c), F.octet_length(c).cast("long"))), F.lit(0))
    return store.agg(
        F.count("*").alias("documents_total"),
        F.count_if(has(raw)).alias("documents_with_raw_html"),
        F.count_if(has(clean)).alias("documents_with_clean_text"),
        size(raw).alias("raw_html_bytes_total"),
        F.coalesce(F.try_divide(size(raw), F.count_if(has(raw))), F.lit(0.0)).alias("raw_html_bytes_avg"),
        size(clean).alias("clean_text_bytes_total"),
        F.coalesce(F.try_divide(size(clean), F.count_if(has(clean))), F.lit(0.0)).alias("clean_text_bytes_avg"),
    )


def store_stats(store: DataFrame) -> DataFrame:
    """total, processed, pending documents of a store."""
    return store.agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.col("status") == "processed", F.lit(False))).alias("processed")).select("total", "processed", (F.col("total") - F.col("processed")).alias("pending"))


def statistics(corpus: DataFrame, tokens: DataFrame, index: DataFrame, top: int = 30) -> DataFrame:
    """corpus_from_export and tokens, nested in one row: what the statistics file holds."""
    sources = as_map(by_source(corpus), "source_name", "n", "sources")
    about = corpus_stats(corpus).crossJoin(sources)  # one row each
    named = about.select(F.struct(*about.columns).alias("corpus_from_export"))
    counted = token_stats(tokens, index, top)
    return named.crossJoin(counted.select(F.struct(*counted.columns).alias("tokens")))


def report_text(statistics_row) -> str:
    """A readable report of a statistics() row."""
    corpus, tokens = statistics_row["corpus_from_export"], statistics_row["tokens"]
    lines = [f"Documents: {corpus['documents']}", f"Sources: {dict(corpus['sources'])}", f"Text bytes: {corpus['clean_text_bytes_total']} in all, {corpus['clean_text_bytes_avg']:.2f} a document", f"Characters a document: {corpus['clean_text_chars_avg']:.2f}", f"Words a document: {corpus['clean_text_words_est_avg']:.2f}", "", f"Tokens: {tokens['tokens_total']}", f"Mean token length: {tokens['avg_token_length_chars']:.2f}"]
    lines += [f"Tokens a document: {', '.join(f'{k} {v}' for k, v in tokens['tokens_per_doc'].asDict().items())}", "", *(f"{i:02d}. {t['token']}\t{t['freq']}" for i, t in enumerate(tokens["top_tokens"], 1))]
    return "\n".join(lines)


def first_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by falling order."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")
