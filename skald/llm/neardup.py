"""MinHash near-duplicates with tensored banding (operator 10).

A document is the set of its distinct SHINGLE-word shingles (A-Z lower-cased,
words between ASCII white space; with fewer words, the whole sequence is one).
Two documents are linked if 100 * |intersection| >= percent * |union|, and the
links' connected components are the groups.

1. One pass makes, for each row, the size and a 128-bit digest of its set, two
   small collections of BANDS bands (ROWS minhashes each), a sketch of two
   bits a minhash, and a parity sketch, in which every shingle turns one of
   64 * PARITY bits. Rows of equal sets become one node.
2. A table key of the tensored banding is a pair (band of the first collection,
   band of the second): BANDS * BANDS tables from 2 * BANDS * ROWS minhashes
   instead of BANDS * BANDS * 2 * ROWS. A pair is missed only if all bands of
   one collection differ: under 1.5e-4 at 0.85 similarity, 6e-7 at 0.9. Bands
   that only one node has can make no shared key and are left out first.
3. A key's centre is the node whose bands are shared most: an original rather
   than one of its variants. Each node is paired with the best centre of its
   keys. Pairs that the sizes or the sketches rule out go: the bits in which
   parity sketches differ are at most the shingles in which the sets differ, so
   that loses nothing, and by the other sketch a linked pair passes with all
   but 2e-7. The others are confirmed on full sets, and confirmed
   links give components by alternating star steps.
4. Keys whose nodes are now in several components may still hide links: there
   pairs across components, and only those, are formed, sifted the same way,
   confirmed and added; each is formed once, at the first band of the one
   collection that both nodes have. So no candidate pair goes unseen, and a
   group of thousands of copies costs a star, not all its pairs.

Tables are keyed by hash and joined by Spark's own shuffles; least and largest
members are pre-aggregated, and adaptive execution splits what a hot key deals.

Defined results: null or empty text, or one without words, has an empty set,
is its own component and kept; rows that repeat a doc_id are one node's worth
of identity (they join whatever any of them is linked to) and each gets a row;
rows with a null id are linked with nothing (component null, not kept).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skald.llm.common import SPACED, Words, buffers, drop, grams, keys, mix, quoted, scratch, settle, slices, spread, tidy, unused

SHINGLE, BANDS, ROWS = 5, 10, 3
#: 64-bit words of a parity sketch.
PARITY = 16
#: Sketch cells (of 2 * BANDS * ROWS, 64 at most) in which a linked pair may differ.
SKETCH_SLACK = 21
_LOW_BITS = 0x5555555555555555
_SKETCH = ["s1", "s2", *(f"o{i}" for i in range(PARITY))]


def shingle_sets(col: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of the column: first row, all distinct shingle hashes (sorted within each row), where each row's begin."""
    raw, at = buffers(col)
    for lo, hi in slices(at):
        words = Words(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], SPACED)
        h = grams(words.hash, k)
        many = np.diff(words.at)
        parts = []
        for r, n in enumerate(many.tolist()):
            a = words.at[r]
            if n >= k:
                x = np.sort(h[a : a + n - k + 1])
                if len(x) > 1:
                    new = np.ones(len(x), bool)
                    np.not_equal(x[1:], x[:-1], out=new[1:])
                    x = x[new]
                parts.append(x)
            else:
                parts.append(grams(words.hash[a : a + n], n) if n else h[:0])
        begin = np.append(0, np.cumsum([len(x) for x in parts]))
        yield lo, np.concatenate(parts) if parts else h[:0], begin


def signatures(docs: DataFrame, *, id_col: str, text_col: str, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, n_shingles, digest (d1, d2), bands (array of 2 * bands hashes, none for the empty set), sketches (_SKETCH)."""
    m = 2 * bands * rows
    a, b = keys(m, 11) | np.uint64(1), keys(m, 12)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(x, T.LongType()) for x in ("n_shingles", "d1", "d2")), T.StructField("bands", T.ArrayType(T.LongType())), *(T.StructField(c, T.LongType()) for c in _SKETCH)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, x, at in shingle_sets(batch.column(1), k):
                n = np.diff(at)
                full = np.flatnonzero(n)
                low = np.zeros((len(full), m), np.uint64)
                d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                if full.size:
                    first = at[:-1][full]
                    for j in range(m):
                        low[:, j] = np.minimum.reduceat(x * a[j] + b[j], first)
                    d1[full] = np.add.reduceat(mix(x ^ keys(1, 13)[0]), first)
                    d2[full] = np.add.reduceat(mix(x ^ keys(1, 14)[0]), first)
                low = mix(low)
                band = np.zeros((len(full), 2 * bands), np.uint64)
                for i in range(2 * bands):
                    for j in range(rows):
                        band[:, i] = mix(band[:, i] ^ (low[:, i * rows + j] + np.uint64(i + 1)))
                cells = np.zeros((len(n), 2), np.uint64)
                for j in range(min(m, 64)):
                    cells[full, j // 32] |= (low[:, j] & np.uint64(3)) << np.uint64(2 * (j % 32))
                width = 64 * PARITY
                turned = np.bincount(spread(at) * width + (mix(x ^ keys(1, 15)[0]) % np.uint64(width)).astype(np.int64), minlength=len(n) * width)
                parity = np.packbits((turned & 1).astype(np.uint8)).view(np.int64).reshape(len(n), PARITY)
                begin = np.append(0, np.cumsum(np.where(n > 0, 2 * bands, 0))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(begin), pa.array(band.ravel().view(np.int64)))
                cols = [batch.column(0).slice(lo, len(n)), pa.array(n.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), lists, *(pa.array(np.ascontiguousarray(cells[:, i]).view(np.int64)) for i in (0, 1)), *(pa.array(np.ascontiguousarray(parity[:, i])) for i in range(PARITY))]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(tidy(run), schema)


def sets(docs: DataFrame, *, k: int = SHINGLE) -> DataFrame:
    """node and its set: sorted 64-bit shingle hashes as binary. docs has node and text."""
    schema = T.StructType([docs.schema["node"], T.StructField("items", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, x, at in shingle_sets(batch.column(1), k):
                raw = memoryview(np.ascontiguousarray(x)).cast("B") if len(x) else memoryview(b"")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(at) - 1), pa.array([bytes(raw[8 * p : 8 * q]) for p, q in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())], names=schema.names)

    return docs.select("node", "text").mapInArrow(tidy(run), schema)


def similar(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, set_a, set_b) with 100 * |intersection| >= percent * |union|, as (a, b)."""
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (xs, xat), (ys, yat) = buffers(batch.column(2)), buffers(batch.column(3))
            x, y, xat, yat = xs.view(np.uint64), ys.view(np.uint64), xat // 8, yat // 8
            good = []
            for r in range(batch.num_rows):
                p, q = x[xat[r] : xat[r + 1]], y[yat[r] : yat[r + 1]]
                both = np.sort(np.concatenate([p, q]))
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(100 * shared >= percent * (len(p) + len(q) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(tidy(run), schema)


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable from each node of the links (a, b), by alternating large and small stars.

    Each round is two grouped minima and joins on a shared-folder copy of the
    links; the rounds grow with the logarithm of a group's breadth, and links
    that are stars around their least nodes already need none.
    """
    links = settle(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    while True:
        roles = links.select(F.col("a").alias("node"), F.lit(1).alias("inner"), F.lit(0).alias("outer")).union(links.select("b", F.lit(0), F.lit(1)))
        if roles.groupBy("node").agg(F.max("inner").alias("inner"), F.sum("outer").alias("outer")).filter("inner + outer > 1").isEmpty():
            return links.select(F.col("b").alias("node"), F.col("a").alias("component"))
        # large star: neighbours above a node go to the least of it and its neighbours
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are settled, so that the joins read plain shuffles and a star with very many links is split
        least = settle(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = settle(both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct())
        # small star: a node and its neighbours below go to the least of them
        least = settle(large.groupBy("b").agg(F.min("a").alias("m")))
        links = large.join(least, "b").select("m", "a", "b")
        links = settle(links.select(F.col("m").alias("a"), "b").union(links.filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct())


def _close(slack: int, percent: int) -> Column:
    """Whether sizes and sketches of the two sides leave a link possible."""
    differ = F.lit(0)
    for s in ("s1", "s2"):
        x = F.col(f"x.{s}").bitwiseXOR(F.col(f"y.{s}"))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(_LOW_BITS)))
    turned = F.lit(0)
    for i in range(PARITY):
        turned = turned + F.bit_count(F.col(f"x.o{i}").bitwiseXOR(F.col(f"y.o{i}")))
    n = F.col("x.n_shingles"), F.col("y.n_shingles")
    return (turned * (100 + percent) <= (100 - percent) * (n[0] + n[1])) & (differ <= slack) & (100 * F.least(*n) >= percent * F.greatest(*n))


def links(docs: DataFrame, nodes: DataFrame, *, id_col: str, text_col: str, percent: int, k: int, bands: int, slack: int) -> DataFrame:
    """Confirmed links (a, b) that connect what all links connect. nodes: node, n_shingles, bands and sketches (settled)."""
    spark = docs.sparkSession
    # bands that several nodes share; a node that shares much is a good centre
    flat = nodes.select("node", F.posexplode("bands").alias("t", "v")).select("node", "t", F.xxhash64("t", "v").alias("band"))
    # settled, as below, so that the join reads plain shuffles, whose large partitions can be split
    shared = settle(flat.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("band", "n"))
    flat = flat.join(shared, "band")
    mine = flat.groupBy("node").agg(F.sum("n").alias("w"), F.collect_list(F.when(F.col("t") < bands, F.col("band"))).alias("p"), F.collect_list(F.when(F.col("t") >= bands, F.col("band"))).alias("q"))  # 2 * bands at most
    table = mine.select("node", "w", "q", F.explode("p").alias("p")).select("node", "w", "p", F.explode("q").alias("q")).select("node", "w", F.xxhash64("p", "q").alias("key"))
    table, table_path = scratch(table, "keys")
    top = settle(table.groupBy("key").agg(F.max_by("node", "w").alias("centre"), F.max("w").alias("cw"), F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("key", "centre", "cw"))
    light = nodes.select("node", "n_shingles", *_SKETCH)

    def sift(pairs: DataFrame) -> DataFrame:
        x, y = (light.select([F.col(c).alias("node_" + n if c == "node" else c) for c in light.columns]).alias(n) for n in "xy")
        near = pairs.alias("p").join(x, F.col("p.a") == F.col("x.node_x")).join(y, F.col("p.b") == F.col("y.node_y")).filter(_close(slack, percent))
        return near.select("p.a", "p.b")

    def confirm(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        texts = docs.select(F.col(id_col).alias("node"), F.col(text_col).cast("string").alias("text")).filter("node is not null").join(ids, "node", "left_semi")
        have, path = scratch(sets(texts, k=k), "sets")
        paths.append(path)
        wide = pairs.join(have.select(F.col("node").alias("a"), F.col("items").alias("set_a")), "a").join(have.select(F.col("node").alias("b"), F.col("items").alias("set_b")), "b")
        return settle(similar(wide, percent).distinct())

    paths = [table_path]
    centred = table.join(top, "key").filter("node <> centre").groupBy("node").agg(F.max_by("centre", "cw").alias("centre"))
    star = settle(sift(settle(centred.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct())))
    sure = confirm(star)
    # keys whose nodes the stars did not join: pairs of their nodes across components, each formed at its first common band
    comp = settle(components(sure))
    held = table.select("key", "node").join(top.select("key"), "key", "left_semi").join(comp, "node", "left").withColumn("c", F.coalesce("component", "node"))
    mixed = held.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
    open_nodes = held.join(mixed, "key", "left_semi").groupBy("node").agg(F.min("c").alias("c"))
    held, path = scratch(nodes.select("node", "n_shingles", "bands", *_SKETCH).join(open_nodes, "node").select("*", F.posexplode(F.slice("bands", 1, bands)).alias("t", "band")), "open")
    paths.append(path)
    same = lambda i: F.col("x.bands")[i] == F.col("y.bands")[i]
    first = reduce(and_, [(F.col("x.t") <= i) | ~same(i) for i in range(bands)])
    both = reduce(or_, [same(bands + i) for i in range(bands)])
    meet = (F.col("x.t") == F.col("y.t")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.c") < F.col("y.c"))
    across = held.alias("x").join(held.alias("y"), meet & _close(slack, percent) & both & first)
    across = across.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    across = settle(across)
    stars = comp.select(F.col("component").alias("a"), F.col("node").alias("b"))
    out = stars if across.isEmpty() else stars.union(confirm(across))
    drop(spark, *paths)
    return out


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, slack: int = SKETCH_SLACK) -> DataFrame:
    """One row for each document: its id, n_shingles, component_id (the least id reachable by links), kept (it is that one)."""
    signed, path = scratch(signatures(docs, id_col=id_col, text_col=text_col, k=k, bands=bands, rows=rows), "signatures")
    digest = ["n_shingles", "d1", "d2"]
    usable = signed.filter(F.col(id_col).isNotNull() & (F.col("n_shingles") > 0))
    nodes = settle(usable.groupBy(*digest).agg(F.min(id_col).alias("node"), F.first("bands").alias("bands"), *[F.first(c).alias(c) for c in _SKETCH]))
    found = links(docs, nodes, id_col=id_col, text_col=text_col, percent=percent, k=k, bands=bands, slack=slack)
    # rows that repeat an id with other texts are links too
    ids = usable.join(nodes.select(*digest, "node"), digest).select(F.col(id_col).alias("_id"), *digest, "node")
    same = ids.filter("_id <> node").select(F.least("_id", "node").alias("a"), F.greatest("_id", "node").alias("b")).join(nodes.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")
    comp = components(found.union(same))
    of = nodes.select(*digest, "node").join(comp, "node", "left").select(*digest, F.coalesce("component", "node").alias("_component"))
    rows_out = signed.select(id_col, *digest).join(of, digest, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col(id_col))
    out = rows_out.select(F.col(id_col), "n_shingles", F.when(F.col(id_col).isNotNull(), component).alias("component_id"))
    out = settle(out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False))))
    drop(docs.sparkSession, path)
    return out


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", nameless: bool = False, **options) -> DataFrame:
    """The documents, one of each group; rows with a null id stay if nameless is true.

    Where ids repeat, each different text of an id is a document of its own,
    and equal rows of an id and text leave one. Columns keep their names and
    values, whatever they are called.
    """
    key, th, own = unused(docs.columns, "_key", "_th", "_own")
    at = F.col(quoted(id_col))
    named, rest = docs.filter(at.isNotNull()), docs.filter(at.isNull() & F.lit(nameless))
    texts = named.select(at.alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    if texts.groupBy("id").count().filter("count > 1").isEmpty():
        info = settle(groups(texts, id_col="id", text_col="text", **options).filter("kept").select(F.col("id").alias(key)))
        return named.join(info, at == F.col(key)).select(*[F.col(quoted(c)) for c in docs.columns]).union(rest)
    keyed = texts.select(F.struct("id", F.xxhash64("text").alias("th")).alias("key"), "text")
    info = settle(groups(keyed, id_col="key", text_col="text", **options).filter("kept").select(F.col("key.id").alias(key), F.col("key.th").alias(th)).distinct())
    kept = named.withColumn(own, F.xxhash64(F.col(quoted(text_col)).cast("string")))
    kept = kept.join(info, (at == F.col(key)) & (F.col(own) == F.col(th)))
    return kept.dropDuplicates([key, th]).select(*[F.col(quoted(c)) for c in docs.columns]).union(rest)
