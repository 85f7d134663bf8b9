"""Readers and writers of the stages' file formats: JSON lines and tab-separated tables.

Parquet is the working format; these are for exchange. Malformed rows are
skipped, as each reader says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skald.functions.text import six_digits

CORPUS = T.StructType([T.StructField(n, T.StringType()) for n in ("doc_id", "normalized_url", "source_name", "title", "clean_text")])


def read_corpus(spark: SparkSession, path: str, *, strict: bool = True, literal: bool = False) -> DataFrame:
    """A JSON-lines corpus. strict drops rows without id or text; else missing fields are empty. Broken lines are dropped.

    literal reads lines as the plain extractor does: only doc_id and
    clean_text, found by their first keys, and escapes other than \\n, \\t
    and \\r stand for the character itself.
    """
    if literal:
        value = F.col("value")
        rows = spark.read.text(path).select(_plain_id(value).alias("doc_id"), _plain_text(value).alias("clean_text"))
        return rows.filter("doc_id is not null and clean_text is not null")
    schema = T.StructType([*CORPUS, T.StructField("_broken", T.StringType())])
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = spark.read.text(path).filter("trim(value) <> ''").select(parsed.alias("r")).filter("r is not null and r._broken is null").select("r.*").drop("_broken")
    if strict:
        return rows.filter("doc_id is not null and clean_text is not null")
    return rows.na.fill("")


def _behind(line: Column, key: str) -> Column:
    """What stands behind a key's colon and blanks; null without the key."""
    rest = F.regexp_extract(line, rf'(?s)^(?>.*?"{key}")[^:]*+:\x20*+(.*)$', 1)
    return F.when(rest != "", rest)


def _plain_id(line: Column) -> Column:
    """A quoted id or the digits of a number."""
    rest = _behind(line, "doc_id")
    return F.when(rest.rlike('^"[^"]*"'), F.regexp_extract(rest, '^"([^"]*)"', 1)).when(rest.rlike("^[0-9]"), F.regexp_extract(rest, "^([0-9]+)", 1))


def _plain_text(line: Column) -> Column:
    """A quoted text: escapes are marked first, so that the closing quote is the first one without a mark."""
    rest = _behind(line, "clean_text")
    marked = F.regexp_replace(F.substring(rest, 2, 1 << 30), "(?s)(?:\\\\|(?=\x01))(.)", "\x01$1")
    parts = F.split(marked, '(?<!\x01)"', 2)
    meant = lambda c: F.when(c == "n", "\n").when(c == "t", "\t").when(c == "r", "\r").otherwise(c)
    pieces = F.regexp_extract_all(parts[0], F.lit("(?s)\x01.|[^\x01]+"), F.lit(0))
    text = F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("\x01"), meant(F.substring(p, 2, 2))).otherwise(p)), "")
    return F.when(rest.startswith('"') & (F.size(parts) == 2), text)


def write_corpus(corpus: DataFrame, path: str) -> None:
    """A JSON-lines corpus, other scripts kept as they are."""
    corpus.select(*[F.col(c).cast("string") for c in CORPUS.names]).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def _tsv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The first columns of a headerless tab-separated file; a row with fewer has nulls, a carriage return at the end goes."""
    parts = F.split(F.regexp_replace("value", "\r$", ""), "\t", len(names))
    return spark.read.text(path).select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, pos, token of a token file; rows with an empty or missing field or a place that is no number are skipped."""
    rows = _tsv(spark, path, ["doc_id", "pos", "token"]).filter("doc_id <> '' and pos <> '' and token <> ''")
    return rows.withColumn("pos", F.expr("try_cast(pos as int)")).filter("pos is not null")


def read_token_column(spark: SparkSession, path: str, *, trimmed: bool = False) -> DataFrame:
    """token alone: only the third field has to be there. trimmed also strips it."""
    rows = _tsv(spark, path, ["doc_id", "pos", "token"]).select(F.trim("token").alias("token") if trimmed else "token")
    return rows.filter("token <> ''")


def read_docs_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, byte_offset, token_count; rows with other than three fields or a count that is no number are skipped."""
    parts = F.split(F.trim("value"), "\t")
    rows = spark.read.text(path).filter(F.size(parts) == 3).select(parts[0].alias("doc_id"), F.expr("try_cast(split(trim(value), '\\t')[1] as bigint)").alias("byte_offset"), F.expr("try_cast(split(trim(value), '\\t')[2] as bigint)").alias("token_count"))
    return rows.filter("token_count is not null")


def _write_lines(rows: DataFrame, path: str, *order: str) -> None:
    """Tab-separated rows, in ranges by order."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    ordered.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns]).alias("value")).write.mode("overwrite").text(path)


def write_tokens(tokens: DataFrame, path: str) -> None:
    """doc_id, pos, token without a header; stems keep their places."""
    _write_lines(tokens.select("doc_id", "pos", "token"), path, "doc_id", "pos")


def write_docs_index(index: DataFrame, path: str) -> None:
    """doc_id, byte_offset, token_count without a header."""
    _write_lines(index.select("doc_id", "byte_offset", "token_count"), path, "doc_id")


def write_zipf(table: DataFrame, path: str) -> None:
    """The rank table with a header; doubles with six significant digits."""
    shown = table.select("rank", "freq", *[six_digits(F.col(c)).alias(c) for c in ("log10_rank", "log10_freq", "zipf_freq")])
    shown.repartitionByRange("rank").sortWithinPartitions("rank").write.mode("overwrite").option("header", True).csv(path, sep="\t")


def read_zipf(spark: SparkSession, path: str) -> DataFrame:
    """A rank table."""
    schema = "rank bigint, freq bigint, log10_rank double, log10_freq double, zipf_freq double"
    return spark.read.schema(schema).option("header", True).csv(path, sep="\t")


def write_plot(points: DataFrame, path: str) -> None:
    """log10_rank, log10_freq, log10_zipf with a header, by rank."""
    points.repartitionByRange("log10_rank").sortWithinPartitions("log10_rank").write.mode("overwrite").option("header", True).csv(path, sep="\t")


def write_top_terms(terms: DataFrame, path: str) -> None:
    """rank, term, freq with a header."""
    terms.select("rank", "term", "freq").coalesce(1).sortWithinPartitions("rank").write.mode("overwrite").option("header", True).csv(path, sep="\t", quote="")


def read_top_terms(spark: SparkSession, path: str) -> DataFrame:
    """What write_top_terms() wrote."""
    return spark.read.schema("rank bigint, term string, freq bigint").option("header", True).csv(path, sep="\t", quote="")


def write_statistics(statistics: DataFrame, path: str) -> None:
    """A statistics row as JSON."""
    statistics.write.mode("overwrite").json(path)


def read_queries(spark: SparkSession, path: str) -> list[str]:
    """The non-blank lines of a query file, in order."""
    return [r["value"] for r in spark.read.text(path, wholetext=False).collect() if r["value"].strip()]


def choose_tokens(spark: SparkSession, stemmed: str, plain: str) -> tuple[str, str]:
    """The stemmed token file if it is there, else the plain one; and the name of the output that goes with it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(stemmed)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return (stemmed, "zipf_stem") if there else (plain, "zipf")
