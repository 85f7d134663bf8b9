"""Nearest neighbours by an adaptive dimension scan of probed lists (operator 9).

Unit vectors are put into lists by their nearest centroid and turned by one
random rotation, after which any leading dimensions are a fair sample of a
distance. There are about as many lists as the square root of the number of
vectors (LISTS at most, which bounds what is broadcast). Their centroids are
fitted by k-means on a sample of SAMPLE rows if that has 40 for each; else that
sample gives coarse cells, and the centroids of each cell are fitted, cell by
cell on the executors, on 40 sampled vectors for each. A query visits its
nearest lists; how many is measured on the sample of SAMPLE rows, as the count
that covers RECALL of its true neighbours. Within a list, vectors stand in
blocks of columns: after each block a hypothesis test compares the partial
distance d with the query's k-th best t so far and abandons a candidate when
d > t * seen/all * (1 + EPSILON / sqrt(seen))^2; the survivors of all blocks
are scored exactly, in double precision on the original vectors (times a power
of two, which changes no cosine, so that very large or small ones have one).

Every row is indexed. Lists are cut into chunks of about CHUNK candidates and a
list's queries into blocks of about QUERIES, dealt by hash, so no task holds
more than one chunk and one block however common a vector is.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part; rows that repeat a vec_id
count once; equal scores go to the smaller vec_id; with fewer than k
candidates, all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from skald.llm.common import settle, tidy

SAMPLE, RECALL, EPSILON, BLOCK, CHUNK, QUERIES, LISTS, EACH = 20_000, 0.985, 2.6, 16, 4096, 512, 1 << 16, 40


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to 0.5 to 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(x: np.ndarray, many: int, seed: int = 3) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    c = x[np.random.default_rng(seed).choice(len(x), many, replace=False)].copy()
    for _ in range(8):
        sums = np.zeros_like(c)
        np.add.at(sums, nearest(x, c), x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-300), c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The centroid nearest to each vector, some vectors at a time."""
    step = max(1, (1 << 23) // len(c))
    return np.concatenate([np.argmax(x[i : i + step] @ c.T, axis=1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


class Index:
    """Centroids, rotation, and how many lists a query visits."""

    def __init__(self, sample: np.ndarray, c: np.ndarray, k: int, recall: float = RECALL, seed: int = 3):
        rng = np.random.default_rng(seed)
        n, dim = sample.shape
        x = units(sample)
        self.centroids = c
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        near = nearest(x, c)
        asked = rng.choice(n, min(n, 400), replace=False)
        scores = x[asked] @ x.T
        scores[np.arange(len(asked)), asked] = -2
        k = min(k, n - 1)
        self.probes = len(c)
        if k > 0:
            best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
            rank = np.argsort(np.argsort(-(x[asked] @ c.T), axis=1), axis=1)
            needed = np.sort(np.take_along_axis(rank, near[best], axis=1).ravel())
            self.probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1

    def route(self, unit: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, list) rows of the lists each query visits: `probes` nearest, more while they hold fewer than least vectors."""
        order = np.argsort(-(unit @ self.centroids.T), axis=1, kind="stable")
        held = np.cumsum(counts[order], axis=1)
        many = np.maximum(self.probes, (held < least).sum(axis=1) + 1)
        query, place = np.nonzero(np.arange(len(counts)) < many[:, None])
        return query, order[query, place]


def scan(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rotation: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, row of the vector and cosine of each query's k best of the vectors (ids differ)."""
    dim = rotation.shape[0]
    q = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    qr, xr = q @ rotation, x @ rotation
    blocks = [(a, min(a + BLOCK, dim)) for a in range(0, dim, BLOCK)]
    columns = [np.ascontiguousarray(xr[:, a:b]) for a, b in blocks]
    limit = np.full(len(q), np.inf)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 64
    lo = 0
    while lo < len(x):
        hi = min(len(x), lo + size)
        size = 1024
        j, i = np.nonzero(query_ids[:, None] != ids[None, lo:hi])
        partial = np.zeros(len(i))
        for (a, b), col in zip(blocks, columns):
            here, mine = col[lo:hi], qr[:, a:b]
            if 4 * len(i) > (hi - lo) * len(q):  # most pairs are alive: one product for all
                d = (here**2).sum(1)[None, :] + (mine**2).sum(1)[:, None] - 2 * mine @ here.T
                partial += d[j, i]
            else:
                partial += ((here[i] - mine[j]) ** 2).sum(1)
            alive = partial <= limit[j] * (b / dim) * (1 + EPSILON / np.sqrt(b)) ** 2 + 1e-9 if b < dim else partial <= limit[j] + 1e-9
            i, j, partial = i[alive], j[alive], partial[alive]
        if len(i):
            score = np.empty(len(i))
            for s in range(0, len(i), 65536):
                e = s + 65536
                u, v = vectors[lo + i[s:e]], queries[j[s:e]]
                score[s:e] = (u * v).sum(1) / (np.sqrt((u * u).sum(1)) * np.sqrt((v * v).sum(1)))
            found = [_best(*(np.concatenate(c) for c in zip(*found, (j, lo + i, score))), ids, k)]
            fj, _, fs = found[0]
            many = np.bincount(fj, minlength=len(q))
            last = np.full(len(q), -np.inf)
            np.minimum.at(worst := np.full(len(q), np.inf), fj, fs)
            last[many >= k] = worst[many >= k]
            limit = np.where(many >= k, np.maximum(0.0, 2 - 2 * last), np.inf)
        lo = hi
    return found[0] if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _best(j: np.ndarray, i: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids[i], -score, j))
    j, i, score = j[order], i[order], score[order]
    first = np.searchsorted(j, j)
    keep = np.arange(len(j)) - first < k
    return j[keep], i[keep], score[keep]


def _matrix(col: pa.Array) -> np.ndarray:
    raw = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.stack([np.frombuffer(v, np.float64) for v in raw.to_pylist()]) if len(raw) else np.zeros((0, 1))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and vec (array<double>): one row for each id whose vector can take part."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("vec", lambda e: e != 0)
    return vectors.select(F.col(id_col).alias("id"), v.alias("vec")).filter(F.col("id").isNotNull() & fine).groupBy("id").agg(F.min("vec").alias("vec"))


def _cells(rows: DataFrame, coarse: np.ndarray, lists: int, total: int, flat) -> np.ndarray:
    """About lists centroids: each coarse cell has as many as it has vectors of a sample with EACH for each, fitted there."""
    spark = rows.sparkSession
    shared, seed = spark.sparkContext.broadcast(coarse), F.lit("cells")
    sampled = rows.filter(F.pmod(F.xxhash64("id", seed), F.lit(1_000_000_000)) < 1e9 * min(1.0, EACH * lists / total)).select("id", "vec")
    dim = coarse.shape[1]

    placed_schema = T.StructType([rows.schema["id"], T.StructField("cell", T.IntegerType()), T.StructField("vec", T.BinaryType())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = units(scaled(flat(batch.column(1))))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nearest(x, shared.value).astype(np.int32)), pa.array([r.tobytes() for r in x], pa.binary())], names=placed_schema.names)

    def fit(cell: pa.Table) -> pa.Table:
        x = _matrix(cell.column("vec"))
        c = centroids(x, max(1, len(x) // EACH))
        return pa.table({"vec": pa.array([r.tobytes() for r in c], pa.binary())})

    # cells are larger the more vectors look alike: those over four times the mean are dealt into parts of that size
    placed = settle(sampled.mapInArrow(tidy(split), placed_schema))
    most = 4 * max(1, EACH * lists // len(coarse))
    many = {r["cell"]: -(-r["count"] // most) for r in placed.groupBy("cell").count().collect()}  # a row for each coarse cell
    parts = F.element_at(F.array(*[F.lit(int(many.get(i, 1))) for i in range(len(coarse))]), F.col("cell") + 1)
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), parts))
    found = dealt.drop("id").groupBy("cell", "part").applyInArrow(fit, "vec binary").toPandas()["vec"]  # LISTS vectors at most, about
    return np.stack([np.frombuffer(v, np.float64) for v in found]).reshape(-1, dim)


def search(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows by cosine that the probed lists hold, for each row of is_query (on `id`)."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType
    rows = settle(usable(vectors, id_col, vec_col))
    out_schema = T.StructType([T.StructField("query_id", kind), T.StructField("vec_id", kind), T.StructField("score", T.DoubleType())])
    sizes = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if not sizes:
        return spark.createDataFrame([], T.StructType([out_schema[0], T.StructField("rank", T.IntegerType()), out_schema[1], out_schema[2]]))
    dim, total = sizes["dim"], sizes["count"]
    rows = rows.filter(F.size("vec") == dim)
    picked = rows.filter(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1_000_000)) < 1e6 * min(1.0, sample / total)).select("vec").toPandas()["vec"]
    if not len(picked):
        picked = rows.orderBy("id").limit(1).select("vec").toPandas()["vec"]
    picked = scaled(np.stack(picked.to_numpy()).astype(float))

    def flat(col: pa.Array) -> np.ndarray:
        return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    lists = max(1, min(LISTS, int(np.sqrt(total))))
    if EACH * lists <= max(len(picked), EACH):
        found = centroids(units(picked), min(lists, len(picked)))
    else:
        coarse = centroids(units(picked), max(1, min(int(np.sqrt(lists)), len(picked) // EACH)))
        found = _cells(rows, coarse, lists, total, flat)
    index = Index(picked, found, k, recall)
    shared = spark.sparkContext.broadcast(index)
    placed_schema = T.StructType([T.StructField("id", kind), T.StructField("list", T.IntegerType()), T.StructField("vec", T.BinaryType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = scaled(flat(batch.column(1)))
                near = nearest(units(x), shared.value.centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.astype(np.int32)), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "list", "vec"])

    placed = settle(rows.mapInArrow(tidy(place), placed_schema))
    sizes = settle(placed.groupBy("list").agg(F.count("*").alias("n")).withColumn("many", F.ceil(F.col("n") / CHUNK)))  # a row for each list
    counts = np.zeros(len(index.centroids), np.int64)
    for r in sizes.collect():
        counts[r["list"]] = r["n"]
    asked = rows.filter(is_query)
    chunks = np.maximum(1, -(-counts // CHUNK))
    n_asked = asked.count()
    blocks = max(1, -(-n_asked * index.probes // (len(counts) * QUERIES)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, (1 << 22) // len(counts))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                x = scaled(flat(part.column(1)))
                query, to = shared.value.route(units(x), counts, k + 1)
                raw = pa.array([r.tobytes() for r in x], pa.binary())
                for i in range(0, len(query), 1 << 14):
                    q, t = query[i : i + (1 << 14)], to[i : i + (1 << 14)]
                    many = chunks[t]
                    q, t, chunk = np.repeat(q, many), np.repeat(t, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(chunk.astype(np.int32)), part.column(0).take(pa.array(q)), raw.take(pa.array(q))], names=["list", "chunk", "id", "vec"])

    key = ["list", "chunk", "block"]
    block = F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int")
    left = asked.mapInArrow(tidy(route), T.StructType([T.StructField("list", T.IntegerType()), T.StructField("chunk", T.IntegerType()), *placed_schema[0:1], *placed_schema[2:3]])).withColumn("block", block)
    dealt = placed.join(F.broadcast(sizes.select("list", "many")), "list").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit("chunk")), F.col("many")).cast("int")).drop("many")
    right = dealt.withColumn("block", F.explode(F.array(*[F.lit(b) for b in range(blocks)])) if blocks < 1000 else F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def visit(queries: pa.Table, members: pa.Table) -> pa.Table:
        if not queries.num_rows or not members.num_rows:
            return pa.Table.from_arrays([pa.array([], queries.schema.field("id").type)] * 2 + [pa.array([], pa.float64())], names=["query_id", "vec_id", "score"])
        qid, vid = queries.column("id").to_numpy(), members.column("id").to_numpy()
        j, i, score = scan(_matrix(queries.column("vec")), qid, _matrix(members.column("vec")), vid, shared.value.rotation, k)
        return pa.Table.from_arrays([pa.array(qid[j], queries.schema.field("id").type), pa.array(vid[i], queries.schema.field("id").type), pa.array(score)], names=["query_id", "vec_id", "score"])

    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(visit, out_schema)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
