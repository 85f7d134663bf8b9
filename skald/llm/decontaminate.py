"""Benchmark decontamination by winnowing (operator 5).

Words are runs of digits, a-z (A-Z lower-cased) and characters outside ASCII.
A window is SPAN consecutive words of a benchmark item, or the whole item if
it has fewer. Both sides keep the least hash of every PICK consecutive K-grams,
K + PICK - 1 = SPAN, the rightmost of equals: two equal windows choose the same
K-gram at the same place, so joining the kept fingerprints finds every shared
window. Each joined fingerprint is then extended: the windows around it are
looked up whole. Items shorter than SPAN are one fingerprint of all their words.

The benchmark is the stated set, held against all documents. Up to BLOCK_WORDS
words its tables, a few bytes a word, are broadcast, and one pass over the
documents needs no shuffle. A larger one is joined: only a sieve of 2^SIEVE
bits over its fingerprints and windows is broadcast, the windows of documents
that pass it are shuffled (row, place and hash, no texts) and joined with the
benchmark's, and what they hit comes back to the documents by row. Texts of any
number cost time in proportion; nothing is gathered from the documents.

Defined results: null text or item has no words and no hits; an item without
words has no window; repeated rows are reported as often as they occur;
repeated item_ids are one item; a null item_id counts as an item named "";
documents' further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skald.llm.common import ALNUM, Words, buffers, drop, extended, grams, inside_rows, quoted, scratch, settle, slices, spread, tidy

SPAN, K = 8, 5
PICK = SPAN - K + 1
BLOCK_WORDS = 2_000_000
SIEVE = 27


def winnow(h: np.ndarray, ok: np.ndarray, pick: int) -> np.ndarray:
    """Which k-grams are the rightmost least of some run of pick usable ones (ok: a gram lies in one text)."""
    n = len(h) - pick + 1
    kept = np.zeros(len(h), bool)
    if n <= 0:
        return kept
    least, at = h[:n].copy(), np.zeros(n, np.int64)
    usable = ok[:n].copy()
    for j in range(1, pick):
        usable &= ok[j : j + n]
        better = h[j : j + n] <= least
        least[better] = h[j : j + n][better]
        at[better] = j
    kept[(np.arange(n) + at)[usable]] = True
    return kept


def lookup(sorted_keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Each hash's place among the sorted keys, or -1."""
    if not len(sorted_keys) or not len(h):
        return np.full(len(h), -1)
    i = np.minimum(np.searchsorted(sorted_keys, h), len(sorted_keys) - 1)
    return np.where(sorted_keys[i] == h, i, -1)


def starts(words: Words, row: np.ndarray, span: int, k: int, known) -> np.ndarray:
    """Where windows of span words can start: around each winnowed k-gram that is known."""
    h, pick = grams(words.hash, k), span - k + 1
    kept = np.flatnonzero(winnow(h, inside_rows(words.at, k, len(h)), pick))
    kept = kept[known(h[kept])]
    at = np.unique((kept[:, None] - np.arange(pick)).ravel())
    at = at[(at >= 0) & (at + span <= len(words))]
    return at[row[at] == row[at + span - 1]]


class Block:
    """The windows of some items: by length, the sorted hashes and the items of each; the full windows' fingerprints."""

    def __init__(self, ids: list[str], col: pa.Array, span: int = SPAN, k: int = K):
        self.span, self.k, self.pick = span, k, span - k + 1
        names = sorted(set(ids))
        number = {x: i for i, x in enumerate(names)}
        self.names = names
        item = np.array([number[x] for x in ids], np.int64)
        words = Words(*buffers(col), ALNUM)
        many = np.diff(words.at)
        self.n_words = np.bincount(item, many, minlength=len(names)).astype(np.int64)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({int(x) for x in np.minimum(many, span) if x}):
            h = grams(words.hash, size)
            first = words.at[:-1][many == size] if size < span else np.flatnonzero(inside_rows(words.at, size, len(h)))
            owner = item[np.searchsorted(words.at, first, "right") - 1]
            pair = np.unique(np.rec.fromarrays([h[first], owner], names="h,i"))
            keys, begin = np.unique(pair.h, return_index=True)
            self.windows[size] = keys, np.append(begin, len(pair)), np.ascontiguousarray(pair.i)
        self.marks = np.zeros(0, np.uint64)
        if span in self.windows:
            h = grams(words.hash, k)
            self.marks = np.unique(h[winnow(h, inside_rows(words.at, k, len(h)), self.pick)])
        sieve = np.zeros(1 << 16, bool)
        sieve[(self.marks >> np.uint64(48)).astype(np.int64)] = True
        self.sieve = sieve

    def known(self, h: np.ndarray) -> np.ndarray:
        """Which hashes are fingerprints of the items."""
        out = self.sieve[(h >> np.uint64(48)).astype(np.int64)]
        out[out] = lookup(self.marks, h[out]) >= 0
        return out

    def scan(self, words: Words) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which words are hit, and the items of each text."""
        n, hit = len(words), np.zeros(len(words) + 1, np.int64)
        row, found = spread(words.at), []
        for size, (keys, begin, owner) in self.windows.items():
            if size < self.span:
                h = grams(words.hash, size)
                at = np.flatnonzero(inside_rows(words.at, size, len(h)))
            else:
                at = starts(words, row, size, self.k, self.known)
                h = grams_of(words.hash[at[:, None] + np.arange(size)]) if at.size else np.zeros(0, np.uint64)
            which = lookup(keys, h if size == self.span else h[at])
            at, which = at[which >= 0], which[which >= 0]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + size, -1)
            found.append(expand(np.unique(np.stack([row[at], which]), axis=1), begin, owner))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
        cut = np.searchsorted(pairs[0], np.arange(len(words.at)))
        return np.cumsum(hit[:-1]) > 0, [pairs[1][a:b] for a, b in zip(cut[:-1], cut[1:])]


def grams_of(spans: np.ndarray) -> np.ndarray:
    """grams() of each row of words as one gram."""
    flat = grams(spans.ravel(), spans.shape[1])
    return flat[:: spans.shape[1]]


def expand(pairs: np.ndarray, begin: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """(text, window) pairs to (text, item) pairs."""
    many = begin[pairs[1] + 1] - begin[pairs[1]]
    place = np.repeat(begin[pairs[1]] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    return np.stack([np.repeat(pairs[0], many), owner[place]])


def find(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, k: int = K, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with _n_words, _spans (hit word ranges, end exclusive), _items (the item ids, as strings, whose windows occur) and _sizes (these items' words).

    docs must have no columns of these names, nor _row; clean() and report() see to that.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    letters = items.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    # a word and a blank are two characters at least
    return (_by_block if letters <= 2 * block_words else _by_join)(docs, items, docs.columns.index(text_col), span, k)


_NEW = [T.StructField("_n_words", T.LongType()), T.StructField("_spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("_items", T.ArrayType(T.StringType())), T.StructField("_sizes", T.ArrayType(T.LongType()))]


def _by_block(docs: DataFrame, items: DataFrame, where: int, span: int, k: int) -> DataFrame:
    """find() with all items' tables broadcast."""
    table = items.toArrow()  # BLOCK_WORDS words at most
    shared = docs.sparkSession.sparkContext.broadcast(Block(table.column("item").to_pylist(), table.column("text").combine_chunks(), span, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        for batch in batches:
            raw, at = buffers(batch.column(where))
            n_words, spans, items, sizes = [], [], [], []
            for lo, hi in slices(at):
                words = Words(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], ALNUM)
                hit, found = block.scan(words)
                n_words += np.diff(words.at).tolist()
                first, last = ranges(hit, words.at)
                cut = np.searchsorted(first, words.at)
                for r, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
                    spans.append((np.stack([first[a:b], last[a:b]], axis=1) - words.at[r]).tolist() if b > a else [])
                    items.append([block.names[i] for i in found[r]])
                    sizes.append(block.n_words[found[r]].tolist())
            cols = [*batch.columns, *(pa.array(x, t) for x, t in zip((n_words, spans, items, sizes), (pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()), pa.list_(pa.int64()))))]
            yield pa.RecordBatch.from_arrays(cols, names=[str(i) for i in range(len(cols))])

    return extended(docs, run, _NEW)


def _windows(items: DataFrame, span: int, k: int) -> DataFrame:
    """(item, size, h): an item's windows with their numbers of words, its fingerprints (size 0), and its number of words (size -1, in h)."""
    schema = "item string, size int, h long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = buffers(batch.column(1))
            for lo, hi in slices(at):
                words = Words(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], ALNUM)
                many, row = np.diff(words.at), spread(words.at)
                found = [(np.arange(hi - lo), -1, many.astype(np.uint64))]
                for size in sorted({int(x) for x in np.minimum(many, span) if x}):
                    h = grams(words.hash, size)
                    first = words.at[:-1][many == size] if size < span else np.flatnonzero(inside_rows(words.at, size, len(h)))
                    found.append((row[first], size, h[first]))
                h = grams(words.hash, k)
                kept = np.flatnonzero(winnow(h, inside_rows(words.at, k, len(h)), span - k + 1))
                found.append((row[kept], 0, h[kept]))
                for owner, size, value in found:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner + lo)), pa.array(np.full(len(owner), size, np.int32)), pa.array(value.view(np.int64))], names=["item", "size", "h"])

    return items.mapInArrow(tidy(run), schema)


def sieve(hashes: DataFrame) -> np.ndarray:
    """A table of 2^SIEVE bits, those of the hashes set; the driver gets its words, not the hashes."""
    at = F.shiftrightunsigned("h", 64 - SIEVE)
    bits = hashes.select(F.shiftright(at, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    words = bits.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(1 << (SIEVE - 6), np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return out


def passes(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - SIEVE)
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _by_join(docs: DataFrame, items: DataFrame, where: int, span: int, k: int) -> DataFrame:
    """find() by a join of the two sides' windows. Rows are numbered once, in the shared folder, and found again by that number."""
    spark = docs.sparkSession
    theirs, theirs_path = scratch(_windows(items, span, k), "windows")
    rows, rows_path = scratch(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    sizes = sorted(r["size"] for r in theirs.filter("size > 0").select("size").distinct().collect())  # span at most
    tables = spark.sparkContext.broadcast({0: sieve(theirs.filter("size = 0")), 1: sieve(theirs.filter("size > 0"))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, windows = tables.value[0], tables.value[1]
        for batch in batches:
            raw, at = buffers(batch.column(1))
            for lo, hi in slices(at):
                words = Words(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], ALNUM)
                row = spread(words.at)
                for size in sizes:
                    if size < span:
                        h = grams(words.hash, size)
                        first = np.flatnonzero(inside_rows(words.at, size, len(h)))
                        h = h[first]
                    else:
                        first = starts(words, row, size, k, lambda x: passes(marks, x))
                        h = grams_of(words.hash[first[:, None] + np.arange(size)]) if first.size else np.zeros(0, np.uint64)
                    good = passes(windows, h)
                    first, h = first[good], h[good]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[first] + lo)), pa.array((first - words.at[row[first]]).astype(np.int64)), pa.array(np.full(len(h), size, np.int32)), pa.array(h.view(np.int64))], names=["_row", "start", "size", "h"])

    text = F.col(quoted(docs.columns[where])).cast("string").alias("text")
    mine = rows.select("_row", text).mapInArrow(tidy(run), "_row long, start long, size int, h long")
    met = mine.join(theirs.filter("size > 0").distinct(), ["size", "h"])
    words = theirs.filter("size = -1").groupBy("item").agg(F.sum("h").alias("words"))
    hits = met.join(words, "item").groupBy("_row").agg(F.collect_set(F.array(F.col("start"), F.col("start") + F.col("size"))).alias("spans"), F.collect_set(F.struct("item", "words")).alias("found"))
    hits = settle(hits.select("_row", "spans", F.array_sort("found").alias("found")))
    joined = rows.join(hits, "_row", "left").select(*[F.col(quoted(c)) for c in docs.columns], F.col("spans").alias("_spans"), F.col("found.item").alias("_items"), F.col("found.words").alias("_sizes"))

    own = len(docs.columns)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = buffers(batch.column(where))
            many = [np.diff(Words(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], ALNUM).at) for lo, hi in slices(at)]
            spans, found, sizes = (batch.column(own + i).to_pylist() for i in range(3))
            new = [pa.array(np.concatenate(many) if many else np.zeros(0, np.int64)), pa.array([join_ranges(x or []) for x in spans], pa.list_(pa.list_(pa.int64()))), pa.array([x or [] for x in found], pa.list_(pa.string())), pa.array([x or [] for x in sizes], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[str(i) for i in range(batch.num_columns + 4)])

    names = [f"c{i}" for i in range(own)]
    out = extended(joined.toDF(*names, "_a", "_b", "_c"), finish, _NEW).drop("_a", "_b", "_c").toDF(*docs.columns, *(f.name for f in _NEW))
    out, _ = scratch(out.toDF(*names, *(f.name for f in _NEW)), "hits")
    drop(spark, theirs_path, rows_path)
    return out.toDF(*docs.columns, *(f.name for f in _NEW))


def ranges(hit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of each run of hit words, runs cut at text borders."""
    n = len(hit)
    opens, closes = hit.copy(), hit.copy()
    if n:
        border = np.zeros(n + 1, bool)
        border[at] = True
        opens[1:] &= ~hit[:-1] | border[1:-1]
        closes[:-1] &= ~hit[1:] | border[1:-1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def join_ranges(spans: list[list[int]]) -> list[list[int]]:
    """Overlapping or touching ranges as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each document: its id, n_words, n_hit, n_items, items_sha256, contaminated (two items or more)."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    options = {n: v for n, v in options.items() if n not in ("id_col", "text_col")}
    found = find(docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text")), benchmark, id_col="id", **options)
    n_items = F.size("_items").cast("long")
    return found.select(
        F.col("id").alias(id_col),
        F.col("_n_words").alias("n_words"),
        F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0]).alias("n_hit"),
        n_items.alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"),
        (n_items >= 2).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, *, min_items: int = 2, min_run: int = 13, min_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, without those that hold windows of min_items items, a run of min_run hit words, or hit words as many as min_share of an item's.

    Columns keep their names and values, whatever they are called.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, names))
    found = find(docs.toDF(*names), benchmark, id_col=of[id_col], text_col=of[text_col], **options)
    zero = F.lit(0).cast("long")
    longest = F.aggregate("_spans", zero, lambda n, s: F.greatest(n, s[1] - s[0]))
    n_hit = F.aggregate("_spans", zero, lambda n, s: n + s[1] - s[0])
    most = F.exists("_sizes", lambda n: n_hit >= n * min_share)
    return found.filter((F.size("_items") < min_items) & (longest < min_run) & ~most).select(*names).toDF(*docs.columns)
