"""Token tables: tokenizing, the per-document index, stemming, frequencies and Zipf ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skald.functions import text as X
from skald.sources.shared import settle


def tokenize(corpus: DataFrame, *, id_col: str = "doc_id", text_col: str = "clean_text", analyzer: str = "unicode") -> DataFrame:
    """doc_id, pos, token: each kept token and its place among the kept ones, from 0; invalid UTF-8 gives none."""
    text = F.try_validate_utf8(F.col(text_col))
    found = X.tokens(text) if analyzer == "unicode" else X.ascii_tokens(text)
    return corpus.select(F.col(id_col).alias("doc_id"), F.posexplode(found).alias("pos", "token"))


def occurrences(corpus: DataFrame, *, id_col: str = "doc_id", text_col: str = "clean_text", analyzer: str = "unicode") -> DataFrame:
    """doc_id, token without places: what counting needs; tokens are sifted as rows, in generated code."""
    text = F.try_validate_utf8(F.col(text_col))
    found = X.raw_tokens(text) if analyzer == "unicode" else X.ascii_tokens(text)
    rows = corpus.select(F.col(id_col).alias("doc_id"), F.explode(found).alias("token"))
    return rows.filter(X.keeps(F.col("token"))) if analyzer == "unicode" else rows


def docs_index(corpus: DataFrame, tokens: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """doc_id, byte_offset, token_count: where each document's rows would begin in a tab-separated token file in id order.

    Documents without tokens are there with a count of 0. Offsets are running
    sums over ranges of ids, so no task sees more than one range.
    """
    size = F.octet_length(F.col("doc_id").cast("string")) + F.length(F.col("pos").cast("string")) + F.octet_length("token") + 3
    sizes = tokens.groupBy("doc_id").agg(F.count("*").alias("token_count"), F.sum(size.cast("long")).alias("bytes"))
    docs = corpus.select(F.col(id_col).alias("doc_id")).join(sizes, "doc_id", "left").na.fill(0, ["token_count", "bytes"])
    return running_sum(docs, "doc_id", "bytes", "byte_offset").select("doc_id", "byte_offset", "token_count")


def running_sum(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """rows with the sum of value over all rows before them in the order of key.

    Rows are dealt out by ranges of key, summed inside each range and settled
    once, so that the ranges that are shifted are those that were summed.
    Rows of equal keys follow each other in any order; sums are whole numbers.
    """
    ranged = rows.repartitionByRange(key).withColumn("_part", F.spark_partition_id())
    inside = W.partitionBy("_part").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    local = settle(ranged.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0))))
    totals = local.groupBy("_part").agg(F.sum(value).alias("_total"))
    return _shifted(local, totals, (F.col("_local") + F.col("_shift")).cast("long").alias(name)).drop("_local")


def _shifted(local: DataFrame, totals: DataFrame, out: Column) -> DataFrame:
    """local with out, in which _shift is the total of the ranges before a row's own. totals: a row for each range."""
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shift = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_shift"))
    return local.join(F.broadcast(shift), "_part").select("*", out).drop("_part", "_shift")


def stem_tokens(tokens: DataFrame) -> DataFrame:
    """tokens with each token's stem; tokens of digits are dropped and places keep their gaps."""
    return tokens.withColumn("token", X.stem(F.col("token"))).filter("token is not null")


def stem_counters(tokens: DataFrame) -> DataFrame:
    """read, written, dropped_numeric, changed: one row about a stemming run. Stems are made once for each different token."""
    counts = term_freq(tokens).withColumn("stem", X.stem(F.col("term")))
    return counts.agg(
        F.coalesce(F.sum("freq"), F.lit(0)).alias("read"),
        F.coalesce(F.sum(F.when(F.col("stem").isNotNull(), F.col("freq"))), F.lit(0)).alias("written"),
        F.coalesce(F.sum(F.when(F.col("stem").isNull(), F.col("freq"))), F.lit(0)).alias("dropped_numeric"),
        F.coalesce(F.sum(F.when(F.col("stem") != F.col("term"), F.col("freq"))), F.lit(0)).alias("changed"),
    )


def term_freq(tokens: DataFrame) -> DataFrame:
    """term, freq."""
    return tokens.groupBy(F.col("token").alias("term")).agg(F.count("*").alias("freq"))


def stem_freq(terms: DataFrame) -> DataFrame:
    """Frequencies of stems from those of terms: each different term is stemmed once."""
    return terms.select(X.stem(F.col("term")).alias("term"), "freq").filter("term is not null").groupBy("term").agg(F.sum("freq").alias("freq"))


def ranked(terms: DataFrame) -> DataFrame:
    """rank, term, freq: numbered from 1 by falling frequency, then term.

    Rows are sorted by ranges of (freq, term) and settled once with their
    place in their range; the sizes of the ranges before are added. The
    vocabulary never meets in one task, and is shuffled once.
    """
    placed = terms.select("term", "freq").orderBy(F.desc("freq"), "term").withColumn("_at", F.monotonically_increasing_id())
    # the id has the partition in its upper bits and the row's place there in the 33 others
    local = settle(placed).select("term", "freq", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_n"))
    totals = local.groupBy("_part").agg((F.max("_n") + 1).alias("_total"))
    return _shifted(local, totals, (F.col("_n") + F.col("_shift") + 1).cast("long").alias("rank")).select("rank", "term", "freq")


def zipf(terms: DataFrame) -> DataFrame:
    """rank, freq, log10_rank, log10_freq, zipf_freq: the rank table with the law's C / rank, C the largest frequency."""
    table = ranked(terms)  # settled: its maximum costs no second count
    named = table.crossJoin(F.broadcast(table.agg(F.max("freq").alias("c"))))  # one row
    return named.select("rank", "freq", F.log10(F.col("rank").cast("double")).alias("log10_rank"), F.log10(F.col("freq").cast("double")).alias("log10_freq"), (F.col("c") / F.col("rank")).alias("zipf_freq"))


def zipf_plot(table: DataFrame) -> DataFrame:
    """The two curves of a log-log plot: log10_rank, log10_freq, log10_zipf."""
    return table.select("log10_rank", "log10_freq", F.log10("zipf_freq").alias("log10_zipf"))


PLOTTED = 2000


def thinned(points: DataFrame, n: int = PLOTTED) -> DataFrame:
    """At most about n points of a plot, evenly spread over the logarithm of the rank: the first of each step."""
    step = F.floor(F.col("log10_rank") * (n / 12))  # ranks of up to twelve digits
    return points.groupBy(step.alias("_s")).agg(F.min(F.struct(*points.columns)).alias("p")).select("p.*")


def top_terms(terms: DataFrame, n: int = 50) -> DataFrame:
    """rank, term, freq of the n most frequent terms."""
    top = terms.orderBy(F.desc("freq"), "term").limit(n)
    return top.select(F.row_number().over(W.orderBy(F.desc("freq"), "term")).cast("long").alias("rank"), "term", "freq")


def mean_length() -> Column:
    """Mean length of the tokens of a table in characters, 0 for none."""
    return F.coalesce(F.avg(F.length("token")), F.lit(0.0))


def throughput(tokens: int, kilobytes: float, seconds: float) -> dict[str, float]:
    """Speeds of a run: KB/s, microseconds a KB, tokens/s; 0 where nothing ran."""
    return {
        "kb_per_sec": kilobytes / seconds if seconds > 0 else 0.0,
        "us_per_kb": seconds * 1e6 / kilobytes if kilobytes > 0 else 0.0,
        "tokens_per_sec": tokens / seconds if seconds > 0 else 0.0,
    }
