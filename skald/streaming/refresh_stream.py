"""A continuous refresh: page files are merged into the store as they arrive.

The store's documents lie in buckets by the hash of their url. A micro-batch
reads and rewrites only the buckets that its pages fall into; a version, a list
of which epoch wrote each bucket last, is written after them and makes them
part of the store at once. The time that an epoch was first tried at is written
before all, and used again when it is tried again, so the store is the same as
after one try. What the last KEEP versions do not use is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skald.operators.refresh import STORE, Policy, prepared, refresh
from skald.sources.shared import drop

BUCKETS, KEEP = 256, 2


class BucketedStore:
    """Versions of a document store under a folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _put(self, rows: DataFrame, folder: str) -> None:
        """A small table under a name that is there only when it is whole."""
        staged = f"{self.path}/staging/{folder.replace('/', '-')}"
        rows.coalesce(1).write.mode("overwrite").parquet(staged)
        fs, source = self._fs(staged)
        _, target = self._fs(f"{self.path}/{folder}")
        fs.mkdirs(target.getParent())
        fs.delete(target, True)
        if not fs.rename(source, target):
            raise OSError(f"cannot rename {staged} to {folder}")

    def epochs(self) -> list[int]:
        """The epochs of the versions there are."""
        return [int(n) for n in self._names("versions")]

    def version(self, before: int | None = None) -> dict[int, int]:
        """The epoch that wrote each bucket of the last version (before an epoch)."""
        known = [e for e in self.epochs() if before is None or e < before]
        if not known:
            return {}
        rows = self.spark.read.schema("bucket int, epoch long").parquet(f"{self.path}/versions/{known[-1]:012d}").collect()  # a row for each bucket
        return {r["bucket"]: r["epoch"] for r in rows}

    def _folder(self, epoch: int, bucket: int) -> str:
        return f"{self.path}/data/{epoch:012d}/bucket={bucket}"

    def read(self, before: int | None = None, chosen: set[int] | None = None) -> DataFrame:
        """The documents of the last version (before an epoch), or those of some buckets."""
        paths = [self._folder(e, b) for b, e in self.version(before).items() if chosen is None or b in chosen]
        return self.spark.read.schema(STORE).parquet(*paths) if paths else self.spark.createDataFrame([], STORE)

    def bucket(self, url: Column) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(self.buckets)).cast("int")

    def time(self, epoch: int, clock) -> int:
        """When an epoch was first tried."""
        folder = f"times/{epoch:012d}"
        if f"{epoch:012d}" not in self._names("times"):
            self._put(self.spark.createDataFrame([(int(clock()),)], "at long"), folder)
        return self.spark.read.schema("at long").parquet(f"{self.path}/{folder}").first()["at"]

    def merge(self, fetched: DataFrame, epoch: int, clock, policy: Policy) -> None:
        """A new version with an epoch's pages (prepared())."""
        at, old = self.time(epoch, clock), self.version(epoch)
        touched = {r["b"] for r in fetched.select(self.bucket(F.col("normalized_url")).alias("b")).distinct().collect()}  # buckets at most
        merged = refresh(self.read(epoch, touched), fetched, at, policy).withColumn("bucket", self.bucket(F.col("normalized_url")))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{epoch:012d}")
        there = {int(n.removeprefix("bucket=")) for n in self._names(f"data/{epoch:012d}") if n.startswith("bucket=")}
        new = {b: e for b, e in old.items() if b not in touched} | {b: epoch for b in touched & there}
        self._put(self.spark.createDataFrame(sorted(new.items()), "bucket int, epoch long"), f"versions/{epoch:012d}")
        self.expire()

    def expire(self, keep: int = KEEP) -> None:
        """Remove all but the last versions, and the buckets that only older ones use."""
        epochs = self.epochs()
        kept, gone = epochs[-keep:], epochs[:-keep]
        if not gone:
            return
        used = {(e, b) for k in kept for b, e in self.version(k + 1).items()}
        drop(self.spark, *(f"{self.path}/versions/{e:012d}" for e in gone), *(f"{self.path}/times/{e:012d}" for e in gone))
        for name in self._names("data"):
            if int(name) <= kept[-1]:
                held = [n for n in self._names(f"data/{name}") if n.startswith("bucket=")]
                left = [n for n in held if (int(name), int(n.removeprefix("bucket="))) in used]
                drop(self.spark, *([f"{self.path}/data/{name}"] if not left else [f"{self.path}/data/{name}/{n}" for n in set(held) - set(left)]))


def read_store(spark: SparkSession, store_path: str, before: int | None = None) -> DataFrame:
    """The last complete version of the store (before an epoch); an empty store if there is none."""
    return BucketedStore(spark, store_path).read(before)


def start(pages: DataFrame, store_path: str, checkpoint: str, clock, policy: Policy = Policy(), buckets: int = BUCKETS, **trigger) -> StreamingQuery:
    """Merge each micro-batch of fetched pages into a new version of the store. clock() gives the time in seconds."""

    def merge(batch: DataFrame, epoch: int) -> None:
        fetched = prepared(batch).persist()
        try:
            BucketedStore(batch.sparkSession, store_path, buckets).merge(fetched, epoch, clock, policy)
        finally:
            fetched.unpersist()

    return pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
