"""Boolean search: any expression over one scan of the terms' postings.

The postings of all terms of all queries are read by one `term IN (...)` scan
and turned into a row for each document with a column for each term; every
query is then an arithmetic expression: AND is the least count, OR the
greatest, AND-NOT the difference from 0 up. So a batch of queries costs one
shuffle. Set semantics run the same expressions over 0/1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skald.functions import text as X
from skald.plans import query_language as Q


def _expression(node: Q.Node, column: dict[str, Column], empty: set[int]) -> Column:
    zero = F.lit(0).cast("long")
    if isinstance(node, Q.Term):
        return column[node.text]
    if isinstance(node, Q.Not):
        return F.when(_expression(node.of, column, empty) > 0, 0).otherwise(1).cast("long")
    left, right = _expression(node.left, column, empty), _expression(node.right, column, empty)
    if isinstance(node, Q.And):
        return F.least(left, right)
    if isinstance(node, Q.Or):
        return zero if id(node) in empty else F.greatest(left, right)
    return F.greatest(left - right, zero)


def _ors(node: Q.Node | None) -> list[Q.Or]:
    """OR nodes, inner ones first."""
    if node is None or isinstance(node, Q.Term):
        return []
    if isinstance(node, Q.Not):
        return _ors(node.of)
    return [*_ors(node.left), *_ors(node.right), *([node] if isinstance(node, Q.Or) else [])]


def analysis(spark: SparkSession, queries: Iterable[str], *, analyzer: str = "unicode", stemmed: bool = False) -> Callable[[str], list[str]]:
    """What read_infix() needs to read query words as an index of this analyzer read its texts: a word's terms, none if the analyzer drops it."""
    words = sorted({t.text for q in queries for t in Q.lex(q) if not t.paren and t.text not in Q.OPERATORS})
    found = (X.tokens if analyzer == "unicode" else X.ascii_tokens)(F.try_validate_utf8(F.col("word")))
    if stemmed:
        found = F.filter(F.transform(found, X.stem), lambda t: t.isNotNull())
    # a local relation: the engine reads the words while it plans, without a job
    rows = spark.createDataFrame(pa.table({"word": pa.array(words, pa.string())})).select("word", found.alias("terms")).collect()
    terms = {r["word"]: list(r["terms"] or []) for r in rows}
    return lambda word: terms.get(word, [])


def read_query(query: str, postings: DataFrame, *, syntax: str, analyze=None) -> Q.Node | None:
    """A query's tree; postfix queries ask the index which of their words are terms."""
    if syntax == "infix":
        return Q.read_infix(query, analyze) if analyze else Q.read_infix(query)
    words = [t.text for t in Q.lex(query) if not t.paren and t.text not in Q.OPERATORS]
    known = {r["term"] for r in postings.filter(F.col("term").isin(words)).select("term").distinct().collect()} if words else set()
    return Q.read_postfix(query, known.__contains__)


def search(postings: DataFrame, queries: Iterable[str], *, direct: DataFrame | None = None, syntax: str = "infix", semantics: str = "set", literal_or: bool = False, analyze=None) -> DataFrame:
    """query_id, query, doc_id, n of each hit; n is 1 for sets, the multiplicity for multisets.

    A query with NOT needs direct for the documents that no term names.
    literal_or makes an OR with an empty side empty.
    """
    asked = [(i, q, read_query(q, postings, syntax=syntax, analyze=analyze)) for i, q in enumerate(queries) if q.strip()]
    asked = [(i, q, tree) for i, q, tree in asked if tree is not None]
    vocabulary = list(dict.fromkeys(t for _, _, tree in asked for t in Q.terms(tree)))
    one = F.lit(1).cast("long")
    count = one if semantics == "set" else F.col("tf")
    columns = [F.coalesce(F.max(F.when(F.col("term") == t, count)), F.lit(0).cast("long")).alias(f"t{i}") for i, t in enumerate(vocabulary)]
    found = postings.filter(F.col("term").isin(vocabulary)).groupBy("doc_id").agg(*columns) if vocabulary else postings.select("doc_id").limit(0)
    if any(Q.has_not(tree) for _, _, tree in asked):
        if direct is None:
            raise ValueError("NOT needs the direct index, which names all documents")
        found = direct.select("doc_id").join(found, "doc_id", "left").na.fill(0, [f"t{i}" for i in range(len(vocabulary))])
    column = {t: F.col(f"t{i}") for i, t in enumerate(vocabulary)}
    empty: set[int] = set()
    if literal_or:
        for _, _, tree in asked:
            for node in _ors(tree):  # inner ones first: an outer one depends on them
                sides = found.agg(*[F.max(_expression(s, column, empty)).alias(x) for s, x in ((node.left, "l"), (node.right, "r"))]).first()
                if not sides["l"] or not sides["r"]:
                    empty.add(id(node))
    hit = lambda e: F.when(e > 0, one if semantics == "set" else e)
    rows = [F.struct(F.lit(i).alias("query_id"), F.lit(q).alias("query"), hit(_expression(tree, column, empty)).alias("n")) for i, q, tree in asked]
    if not rows:
        return found.select(F.lit(0).alias("query_id"), F.lit("").alias("query"), "doc_id", F.lit(0).cast("long").alias("n")).limit(0)
    hits = F.filter(F.array(*rows), lambda h: h["n"].isNotNull())  # before they become rows: most documents are hits of few queries
    return found.select("doc_id", F.explode(hits).alias("h")).select("h.query_id", "h.query", "doc_id", "h.n")


def with_documents(hits: DataFrame, direct: DataFrame) -> DataFrame:
    """hits with title and url; the engine chooses the join by the sides' sizes."""
    return hits.join(direct, "doc_id").select(*hits.columns, "title", "url")


def repeated(hits: DataFrame) -> DataFrame:
    """hits with each document as often as its multiplicity."""
    return hits.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_i")).drop("_i", "n")


def and_hits(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, n): the least multiplicity."""
    return left.alias("l").join(right.alias("r"), "doc_id").select("doc_id", F.least("l.n", "r.n").alias("n"))


def or_hits(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, n): the greatest multiplicity."""
    joined = left.withColumnRenamed("n", "a").join(right.withColumnRenamed("n", "b"), "doc_id", "full")
    return joined.select("doc_id", F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))).cast("long").alias("n"))


def minus_hits(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, n): what of left's multiplicity exceeds right's."""
    joined = left.join(right.withColumnRenamed("n", "b"), "doc_id", "left")
    return joined.select("doc_id", (F.col("n") - F.coalesce("b", F.lit(0))).alias("n")).filter("n > 0")
