"""Forward and inverted indexes.

The inverted index is (term, doc_id, tf): the multiset of a term's documents
with their multiplicity as a count. Written, it is sorted by term, so that a
query's few terms skip most row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skald.operators.tokens import occurrences, stem_tokens


def build_index(corpus: DataFrame, *, id_col: str = "doc_id", text_col: str = "clean_text", analyzer: str = "unicode", stemmed: bool = False) -> DataFrame:
    """term, doc_id, tf."""
    found = occurrences(corpus, id_col=id_col, text_col=text_col, analyzer=analyzer)
    counts = found.groupBy("token", "doc_id").agg(F.count("*").alias("tf"))
    if stemmed:  # after counting: a document's repeats are stemmed once
        counts = stem_tokens(counts).groupBy("token", "doc_id").agg(F.sum("tf").alias("tf"))
    return counts.select(F.col("token").alias("term"), "doc_id", "tf")


def nested(postings: DataFrame) -> DataFrame:
    """term, doc_ids with repeats, ascending: the list form, for inspection of chosen terms."""
    repeated = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "tf"))), lambda p: F.array_repeat(p["doc_id"], p["tf"].cast("int"))))
    return postings.groupBy("term").agg(repeated.alias("doc_ids"))


def direct_index(corpus: DataFrame, *, id_col: str = "doc_id", title_col: str = "title", url_col: str = "normalized_url") -> DataFrame:
    """doc_id, title, url; missing titles and urls are empty."""
    return corpus.select(F.col(id_col).alias("doc_id"), F.coalesce(title_col, F.lit("")).alias("title"), F.coalesce(url_col, F.lit("")).alias("url"))


def duplicate_ids(corpus: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n of the ids that occur more than once; the index counts all of their rows."""
    return corpus.groupBy(F.col(id_col).alias("doc_id")).agg(F.count("*").alias("n")).filter("n > 1")


def index_totals(postings: DataFrame, corpus: DataFrame) -> DataFrame:
    """documents, terms, tokens, tokens_per_term, mean_term_length, mean_token_length, tokens_per_doc: one row."""
    terms = postings.groupBy("term").agg(F.sum("tf").alias("tf"))
    about = terms.agg(
        F.count("*").alias("terms"),
        F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"),
        F.coalesce(F.avg(F.length("term")), F.lit(0.0)).alias("mean_term_length"),
        F.coalesce(F.sum(F.length("term") * F.col("tf")) / F.sum("tf"), F.lit(0.0)).alias("mean_token_length"),
    )
    joined = about.crossJoin(corpus.agg(F.count("*").alias("documents")))  # one row each
    per = lambda n: F.coalesce(F.try_divide("tokens", n), F.lit(0.0))
    return joined.select("documents", "terms", "tokens", per("terms").alias("tokens_per_term"), "mean_term_length", "mean_token_length", per("documents").alias("tokens_per_doc"))


def write_index(postings: DataFrame, path: str) -> None:
    """Parquet in ranges of terms, sorted by term."""
    postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """What write_index() wrote."""
    return spark.read.parquet(path)


def write_about(spark: SparkSession, path: str, *, analyzer: str = "unicode", stemmed: bool = False) -> None:
    """How an index read its texts, for those who ask it."""
    spark.createDataFrame([(analyzer, stemmed)], "analyzer string, stemmed boolean").coalesce(1).write.mode("overwrite").json(path)


def read_about(spark: SparkSession, path: str) -> dict:
    """What write_about() wrote; the default analyzer where there is nothing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return {"analyzer": "unicode", "stemmed": False}
    return spark.read.schema("analyzer string, stemmed boolean").json(path).first().asDict()


def write_direct(direct: DataFrame, path: str) -> None:
    """Parquet sorted by id in ranges."""
    direct.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").parquet(path)


def read_direct(spark: SparkSession, path: str) -> DataFrame:
    """What write_direct() wrote."""
    return spark.read.parquet(path)


def corpus_sequence(corpus: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """One row for each id (the first by the rest of its columns), for exports that keep the first of each."""
    rest = [c for c in corpus.columns if c != id_col]
    return corpus.withColumn("_r", F.row_number().over(W.partitionBy(id_col).orderBy(*rest))).filter("_r = 1").drop("_r")
