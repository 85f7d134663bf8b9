"""Delta-maintained token counts (operator 3).

Totals of documents and tokens by source, language and tokenizer version are
kept as a sum of signed deltas. A batch of changes (insert, revise, delete) is
held against the rows of the batch's own documents: an insert writes +n, a
delete -n, a revision both. The batch's rows and their totals are written to a
staging folder that one rename makes part of the store under the batch's id,
so a batch counts once however often it is tried or replayed, and a lost
executor or driver leaves nothing half-counted. Totals read only the
pre-aggregated deltas.

When the batches since the last snapshot are larger than SHARE of it, they are
added up into a new one, with a row for each document that is there; one rename
makes it part of the store too. So a batch reads what is there now and a part
of that again, whatever the length of the store's history, and each row is
rewritten a number of times that grows with the logarithm of the store.

A store has one writer at a time: a batch is read against the state it found.
Readers may come at any time.

Defined results: null source and language are groups of their own; changes
with a null document id or an unknown kind are left out; an insert of a
document that is there revises it, a revision of one that is not inserts it, a
deletion of one that is not does nothing; of several changes of a document in
one batch the last by `seq`, then the greatest by kind and count, holds; a null
count is 0; an empty batch commits and changes nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from skald.llm.common import extended, others, parts, quoted
from skald.llm.tokens import BytePairs, default_path

GROUPS = ["source", "lang", "tokenizer"]
#: A snapshot is made when newer batches have more than this share of its bytes.
SHARE = 0.5


def bpe_counts(docs: DataFrame, *, tokenizer: str | None = None, version: str = "byte_bpe_50k", text_col: str = "text") -> DataFrame:
    """docs without the text, with `tokens`, its number of byte-level BPE ids, and `tokenizer`, the version; columns of these names are replaced."""
    path = tokenizer or default_path()
    kept = others(docs.columns, text_col, "tokens", "tokenizer")
    ordered = docs.select(*[F.col(quoted(c)) for c in kept], F.col(quoted(text_col)).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = BytePairs.load(path)
        for batch in (part for whole in batches for part in parts(whole, len(kept))):
            _, at = bpe.encode(batch.column(len(kept)))
            cols = [*batch.columns[:-1], pa.nulls(batch.num_rows, pa.string()), pa.array(np.diff(at))]  # texts stay behind
            yield pa.RecordBatch.from_arrays(cols, names=[str(i) for i in range(len(cols))])

    counted = extended(ordered, run, [T.StructField("tokens", T.LongType())])
    return counted.select(*[F.col(quoted(c)) for c in kept], "tokens", F.lit(version).alias("tokenizer"))


def word_counts(docs: DataFrame, *, version: str = "words-1", text_col: str = "text") -> DataFrame:
    """The same with the words between ASCII white space as tokens, natively."""
    words = F.size(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), 1))
    return docs.withColumn("tokens", words.cast("long")).withColumn("tokenizer", F.lit(version)).drop(text_col)


class Rollup:
    """A store of signed rows and their totals under a shared folder."""

    def __init__(self, spark: SparkSession, path: str, id_type: T.DataType | None = None, share: float = SHARE):
        self.spark, self.path, self.share = spark, path.rstrip("/"), share
        self.rows_schema = T.StructType([T.StructField("doc_id", id_type or T.LongType()), *(T.StructField(g, T.StringType()) for g in GROUPS), T.StructField("docs", T.LongType()), T.StructField("tokens", T.LongType())])
        self.totals_schema = T.StructType(self.rows_schema.fields[1:])

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def batches(self) -> list[str]:
        """The ids of the committed batches."""
        return self._names("batches")

    def _parts(self) -> list[str]:
        """Folders that together have everything: the last snapshot and the batches it does not cover."""
        snapshots = self._names("snapshots")
        if not snapshots:
            return [f"{self.path}/batches/{b}" for b in self.batches()]
        last = f"{self.path}/snapshots/{snapshots[-1]}"
        covered = {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{last}/covers").collect()}  # a name for each batch
        return [last, *(f"{self.path}/batches/{b}" for b in self.batches() if b not in covered)]

    def _read(self, kind: str, schema: T.StructType) -> DataFrame:
        found = [f"{p}/{kind}" for p in self._parts()]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        """Signed rows whose sums are the documents now there."""
        return self._read("rows", self.rows_schema)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of the documents now there; groups without documents are left out."""
        return self._read("totals", self.totals_schema).groupBy(*GROUPS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).filter("n_docs <> 0")

    def _added_up(self, rows: DataFrame) -> DataFrame:
        sums = rows.groupBy(*[c for c in rows.columns if c not in ("docs", "tokens")]).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter("docs <> 0 or tokens <> 0").select(*rows.columns)

    def _size(self, folder: str) -> int:
        fs, at = self._fs(folder)
        return fs.getContentSummary(at).getLength()

    def compact(self) -> None:
        """Add all batches up into a snapshot."""
        done, number = self.batches(), len(self._names("snapshots"))
        stage = f"{self.path}/staging/snapshot-{uuid.uuid4().hex}"
        self._added_up(self.rows()).write.parquet(f"{stage}/rows")
        self._added_up(self._read("totals", self.totals_schema)).coalesce(1).write.parquet(f"{stage}/totals")
        self.spark.createDataFrame([(b,) for b in done], "batch string").coalesce(1).write.parquet(f"{stage}/covers")
        self._commit(stage, "snapshots", f"{number:08d}")

    def _maybe_compact(self) -> None:
        first, *newer = self._parts() if self._names("snapshots") else ["", *self._parts()]
        if sum(self._size(f"{p}/rows") for p in newer) > self.share * self._size(f"{first}/rows") if first else len(newer) > 1:
            self.compact()

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit changes (doc_id, kind, source, lang, tokenizer, tokens[, seq]) as a batch; False if that batch is there already."""
        if not re.fullmatch(r"[A-Za-z0-9-]+", batch_id):
            raise ValueError("a batch id has letters, digits and hyphens")
        if batch_id in self.batches():
            return False
        if "seq" not in changes.columns:
            changes = changes.withColumn("seq", F.lit(0))
        changes = changes.select("doc_id", "kind", *GROUPS, F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), "seq").filter("doc_id is not null and kind in ('insert', 'revise', 'delete')")
        last = W.partitionBy("doc_id", "tokenizer").orderBy(F.desc("seq"), F.desc("kind"), F.desc("tokens"), F.desc("source"), F.desc("lang"))
        new = changes.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r", "seq")
        touched = new.select("doc_id", F.col("tokenizer").alias("_v"))
        there = self._touched(touched).groupBy("doc_id", *GROUPS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs > 0")
        minus = there.select("doc_id", *GROUPS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))
        plus = new.filter("kind <> 'delete'").select("doc_id", *GROUPS, F.lit(1).cast("long").alias("docs"), "tokens")
        stage = f"{self.path}/staging/{batch_id}-{uuid.uuid4().hex}"
        plus.union(minus).select(*self.rows_schema.names).write.parquet(f"{stage}/rows")
        signed = self.spark.read.schema(self.rows_schema).parquet(f"{stage}/rows")
        signed.groupBy(*GROUPS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).coalesce(1).write.parquet(f"{stage}/totals")
        done = self._commit(stage, "batches", batch_id)
        self._maybe_compact()
        return done

    def _touched(self, touched: DataFrame) -> DataFrame:
        """The rows of the documents and versions of a batch."""
        log = self.rows().alias("l")
        asked = touched.distinct().alias("t")
        return log.join(asked, (F.col("l.doc_id") == F.col("t.doc_id")) & F.col("l.tokenizer").eqNullSafe(F.col("t._v")), "left_semi")

    def _commit(self, stage: str, folder: str, name: str) -> bool:
        fs, source = self._fs(stage)
        _, parent = self._fs(f"{self.path}/{folder}")
        _, target = self._fs(f"{self.path}/{folder}/{name}")
        fs.mkdirs(parent)
        if not fs.exists(target) and fs.rename(source, target):
            return True
        fs.delete(source, True)
        return False
