"""Fuzzy passage deduplication by collinear chaining (operator 8).

Words are runs of digits, a-z (A-Z lower-cased) and characters outside ASCII.

1. Seeds are the K-word shingles that are least in some run of PICK, so a
   shared span of K + PICK - 1 words has a common seed. Every seed belongs to
   the least document that has it; a later document with SEEDS different seeds
   of an owner makes a pair with it. Beside its seeds a document has windows,
   the MIN_WORDS words from each seed on; the least document with a window makes
   a pair with each later one. So a passage that a third of all documents share
   makes one pair for each of them, not all pairs among them, and of a verbatim
   span of MIN_WORDS + PICK - 1 words at least MIN_WORDS are found whoever else
   holds parts of it: it has a window, and the window's owner has all of that.
   What these pairs leave of shared seeds gets new owners, the least of the
   documents in which the seed is left, for edited passages behind other
   holders of their seeds.
2. Of each pair, the words of both documents (16-bit hashes) meet in one row.
   Common K-word matches, all occurrences, are joined into diagonal runs, runs
   are chained in order with a gap cost through a Fenwick tree of prefix maxima, chains are
   split where either side has a long gap, aligned word by word in their gaps
   and over their ends, and kept if they have MIN_WORDS words of which
   SIMILAR match.
3. The passage is a repeat in the later document; the earliest keeps it.

Defined results: null, empty and short texts have no passages; rows with a
null id take no part and keep their text; equal rows that repeat an id get
equal results; of rows that repeat an id with other texts one takes part;
passages within one document are no repeats; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skald.llm.common import ALNUM, ODD, Words, buffers, drop, grams, inside_rows, mix, quoted, scratch, settle, slices, spread, tidy
from skald.llm.decontaminate import winnow

K, PICK, SEEDS, MIN_WORDS, SIMILAR, MAX_GAP, GAP_COST = 5, 8, 2, 45, 0.8, 24, 0.1
_ODD_INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))
#: Matches of one shingle that an alignment takes all.
FREQUENT = 64

SPAN = "struct<start:int,end:int,source_id:{id},source_start:int,source_end:int,similarity:double>"


class Fenwick:
    """Prefix maxima: put(i, value, what), and best(i) over all places up to i."""

    def __init__(self, n: int):
        self.value = [0.0] * (n + 1)
        self.what = [-1] * (n + 1)

    def put(self, i: int, value: float, what: int) -> None:
        i += 1
        while i < len(self.value):
            if self.what[i] < 0 or value > self.value[i]:
                self.value[i], self.what[i] = value, what
            i += i & -i

    def best(self, i: int) -> tuple[float, int]:
        i += 1
        value, what = 0.0, -1
        while i > 0:
            if self.what[i] >= 0 and (what < 0 or self.value[i] > value):
                value, what = self.value[i], self.what[i]
            i -= i & -i
        return value, what


def _met(x: np.ndarray, y: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places (in x, in y) of equal hashes, and whether some were too many: all of a hash with at most most of them; with most None one for every place in x."""
    ox, oy = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
    sx, sy = x[ox], y[oy]
    lo, hi = np.searchsorted(sy, sx), np.searchsorted(sy, sx, "right")
    first = np.searchsorted(sx, sx)
    n = hi - lo
    if most is None:
        hit = n > 0
        nth = np.arange(len(sx)) - first
        return ox[hit], oy[lo[hit] + nth[hit] % n[hit]], False
    more = n * (np.searchsorted(sx, sx, "right") - first) > most
    n[more] = 0
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(ox, n), oy[np.repeat(lo, n) + nth], bool(more.any())


def runs(a: np.ndarray, b: np.ndarray, k: int = K, least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """Diagonal runs (first shingle in a, in b, how many shingles) of common k-word shingles.

    A shingle meets all its occurrences, unless n in a and m in b make more
    than FREQUENT matches. For those the shingles of least words count, each
    of which is a passage by itself: every one in a meets one in b. Gaps
    between rarer shingles and ends are aligned word by word in any case.
    """
    x, y = grams(a.astype(np.uint64), k), grams(b.astype(np.uint64), k)
    if not len(x) or not len(y):
        return []
    if len(x) == len(y) and np.array_equal(x, y):
        return [(0, 0, len(x))]
    at_a, at_b, frequent = _met(x, y, FREQUENT)
    wide = max(least, k)
    if frequent:
        long_a, long_b, _ = _met(grams(a.astype(np.uint64), wide), grams(b.astype(np.uint64), wide), None)
        inner = np.arange(wide - k + 1)
        at_a, at_b = np.append(at_a, (long_a[:, None] + inner).ravel()), np.append(at_b, (long_b[:, None] + inner).ravel())
    if not len(at_a):
        return []
    n = len(a) + len(b) + 2
    points = np.unique((at_b - at_a + len(a)) * n + at_a)  # by diagonal, then place
    new = np.flatnonzero(np.append(True, np.diff(points) != 1))
    size = np.diff(np.append(new, len(points)))
    first = points[new] % n
    return sorted(zip(first.tolist(), (points[new] // n - len(a) + first).tolist(), size.tolist()))


def chains(found: list[tuple[int, int, int]], k: int = K, cost: float = GAP_COST) -> list[list[tuple[int, int, int]]]:
    """Disjoint collinear chains of runs, best first."""
    if len(found) == 1:
        return [found]
    found = sorted(found)
    n = len(found)
    ends = sorted({b + m for _, b, m in found})
    rank = {e: i for i, e in enumerate(ends)}
    tree = Fenwick(len(ends))
    import bisect

    by_end = sorted(range(n), key=lambda i: found[i][0] + found[i][2])
    score, back, done = [0.0] * n, [-1] * n, 0
    for i, (a, b, m) in enumerate(found):
        while done < n and found[by_end[done]][0] + found[by_end[done]][2] <= a and by_end[done] < i:
            j = by_end[done]
            ea, eb = found[j][0] + found[j][2], found[j][1] + found[j][2]
            tree.put(rank[eb], score[j] + cost * (ea + eb), j)
            done += 1
        score[i] = m + k - 1
        at = bisect.bisect_right(ends, b) - 1
        if at >= 0:
            value, j = tree.best(at)
            if j >= 0 and value - cost * (a + b) > 0:
                score[i] += value - cost * (a + b)
                back[i] = j
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(found[i])
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def _common(x: list[int], y: list[int]) -> int:
    """Words that an alignment of two short gaps matches (longest common subsequence)."""
    if not x or not y:
        return 0
    row = [0] * (len(y) + 1)
    for u in x:
        old = 0
        for j, v in enumerate(y, 1):
            old, row[j] = row[j], old + 1 if u == v else max(row[j], row[j - 1])
    return row[-1]


def _grow(a: np.ndarray, b: np.ndarray, i: int, j: int, step: int) -> tuple[int, int]:
    """How many words a passage grows from (i, j) on along its diagonal, and how many of them match."""
    best = matched = score = seen = same = 0
    while 0 <= i < len(a) and 0 <= j < len(b) and score > best - 4:
        seen += 1
        if a[i] == b[j]:
            same += 1
            score += 1
            if score > best:
                best, matched, grown = score, same, seen
        else:
            score -= 2
        i, j = i + step, j + step
    return (grown, matched) if best else (0, 0)


def _passages(a: np.ndarray, b: np.ndarray, *, k: int = K, least: int = MIN_WORDS, similar: float = SIMILAR, max_gap: int = MAX_GAP) -> list[tuple[int, int, int, int, float]]:
    """What passages() finds in one go; of passages that lie half or more in better ones none."""
    found = runs(a, b, k, least)
    if not found or (len(found) < 2 and found[0][2] + k - 1 + 2 * k < least):
        return []
    out, taken = [], np.zeros(len(a), bool)
    for chain in chains(found, k):
        parts, part = [], [chain[0]]
        for (pa_, pb, pm), r in zip(chain[:-1], chain[1:]):
            if max(r[0] - pa_ - pm, r[1] - pb - pm) > max_gap + k - 1:
                parts.append(part)
                part = []
            part.append(r)
        for part in [*parts, part]:
            if part[-1][0] + part[-1][2] + k - 1 - part[0][0] + 4 * k < least:
                continue
            same, at_a, at_b = 0, part[0][0], part[0][1]
            for ra, rb, m in part:
                if ra < at_a or rb < at_b:  # runs may overlap by less than k words
                    cut = max(at_a - ra, at_b - rb)
                    ra, rb, m = ra + cut, rb + cut, m - cut
                    if m + k - 1 <= 0:
                        continue
                same += _common(a[at_a:ra].tolist(), b[at_b:rb].tolist()) + m + k - 1
                at_a, at_b = ra + m + k - 1, rb + m + k - 1
            more, matched = _grow(a, b, at_a, at_b, 1)
            less, before = _grow(a, b, part[0][0] - 1, part[0][1] - 1, -1)
            start, end, s_start, s_end = part[0][0] - less, at_a + more, part[0][1] - less, at_b + more
            share = (same + matched + before) / max(end - start, s_end - s_start)
            if end - start >= least and share >= similar and 2 * np.count_nonzero(taken[start:end]) < end - start:
                taken[start:end] = True
                out.append((start, end, s_start, s_end, share))
    return out


def passages(a: np.ndarray, b: np.ndarray, *, k: int = K, least: int = MIN_WORDS, similar: float = SIMILAR, max_gap: int = MAX_GAP) -> list[tuple[int, int, int, int, float]]:
    """(start, end, source start, source end, similarity) of the passages that a shares with b, every copy in a.

    What the passages leave of a is held against all of b again, until nothing more is found.
    """
    out, rest = [], a.astype(np.int64)
    while found := _passages(rest, b, k=k, least=least, similar=similar, max_gap=max_gap):
        out += found
        for start, end, *_ in found:
            rest[start:end] = -1 - np.arange(start, end)  # equal to no word
        free = np.flatnonzero(np.diff(np.concatenate([[0], rest >= 0, [0]]).astype(np.int8)))
        if not len(free) or (free[1::2] - free[::2]).max() < least:
            break
    return out


def windows(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each place on: differences of one running sum of powers."""
    power = np.cumprod(np.append(np.uint64(1), np.full(len(h), ODD, np.uint64)))
    back = np.cumprod(np.append(np.uint64(1), np.full(len(h), _ODD_INVERSE, np.uint64)))
    total = np.append(np.uint64(0), np.cumsum(h * power[:-1]))
    return mix((total[at + n] - total[at]) * back[at])


def _fingerprints(docs: DataFrame, k: int, pick: int, least: int) -> DataFrame:
    """(seed, id, at, window): the seeds of each document, their first words' places, and the hash of the least words from there on (null if there are fewer). docs has id and text."""
    schema = T.StructType([T.StructField("seed", T.LongType()), docs.schema["id"], T.StructField("at", T.IntegerType()), T.StructField("window", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = buffers(batch.column(1))
            for lo, hi in slices(at):
                words = Words(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], ALNUM)
                h = grams(words.hash, k)
                kept = np.flatnonzero(winnow(h, inside_rows(words.at, k, len(h)), pick))
                row = spread(words.at)[kept]
                short = kept + least > words.at[row + 1]
                wide = np.zeros(len(kept), np.int64)
                wide[~short] = windows(words.hash, kept[~short], least).view(np.int64)
                cols = [pa.array(h[kept].view(np.int64)), batch.column(0).take(pa.array(row + lo)), pa.array((kept - words.at[row]).astype(np.int32)), pa.array(wide, mask=short)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.mapInArrow(tidy(run), schema)


def _owned(rows: DataFrame, key: str) -> DataFrame:
    """key and owner, the least of its ids, for each key that several ids have. Settled, so that what joins it reads plain shuffles, whose large partitions can be split."""
    return settle(rows.groupBy(key).agg(F.min("id").alias("owner"), F.max("id").alias("last")).filter("owner < last").select(key, "owner"))


def _pairs(rows: DataFrame, seeds: int) -> DataFrame:
    """(id, owner): later documents with enough different seeds of an owner. rows: id, owner, seed."""
    ends = rows.filter("id > owner").groupBy("id", "owner").agg(F.count("*").alias("n"), F.min("seed").alias("low"), F.max("seed").alias("high"))
    return ends.filter((F.col("n") >= seeds) & ((F.col("low") < F.col("high")) | F.lit(seeds < 2))).select("id", "owner")


def _word_codes(docs: DataFrame) -> DataFrame:
    """id, th, words: 16 bits of each word's hash. docs has id, th and text."""
    schema = T.StructType([docs.schema["id"], docs.schema["th"], T.StructField("words", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = buffers(batch.column(2))
            for lo, hi in slices(at):
                words = Words(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], ALNUM)
                data = memoryview((words.hash >> np.uint64(48)).astype("<u2")).cast("B")
                cols = [bytes(data[2 * p : 2 * q]) for p, q in zip(words.at[:-1].tolist(), words.at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(cols, pa.binary())], names=schema.names)

    return docs.mapInArrow(tidy(run), schema)


def _align(pairs: DataFrame, words: DataFrame, *, k: int, least: int, similar: float) -> DataFrame:
    """id, th and spans of the passages of each pair (id, owner). words: id, th, words."""
    kind = words.schema["id"].dataType
    wide = pairs.join(words.select("id", "th", "words"), "id").join(words.select(F.col("id").alias("owner"), F.col("words").alias("source")), "owner")
    span = T.StructType.fromDDL("x " + SPAN.format(id=kind.simpleString()))["x"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("th", T.LongType()), *span.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, xat), (y, yat) = buffers(batch.column(3)), buffers(batch.column(4))
            a, b = x.view("<u2"), y.view("<u2")
            which, got = [], []
            for r in range(batch.num_rows):
                for p in passages(a[xat[r] // 2 : xat[r + 1] // 2], b[yat[r] // 2 : yat[r + 1] // 2], k=k, least=least, similar=similar):
                    which.append(r)
                    got.append(p)
            at = pa.array(which, pa.int64())
            start, end, s_start, s_end, share = zip(*got) if got else ((),) * 5
            i32 = pa.int32()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(start, i32), pa.array(end, i32), batch.column(2).take(at), pa.array(s_start, i32), pa.array(s_end, i32), pa.array(share, pa.float64())], names=schema.names)

    flat = wide.select("id", "th", "owner", "words", "source").mapInArrow(tidy(run), schema)
    return settle(flat.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct(*span.names))).alias("spans")))  # a document's own passages


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, pick: int = PICK, seeds: int = SEEDS, least: int = MIN_WORDS, similar: float = SIMILAR) -> DataFrame:
    """id, th (hash of the text) and spans: each document's passages that an earlier document has, by start."""
    spark = docs.sparkSession
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text")).filter("id is not null and text is not null")
    shared = _fingerprints(rows, k, pick, least)
    owners = _owned(shared.select("seed", "id"), "seed")
    mine, mine_path = scratch(shared.join(owners, "seed"), "seeds")
    wide = mine.filter("window is not null").select("window", "id")
    held = wide.join(_owned(wide, "window"), "window").filter("id > owner").select("id", "owner")
    pairs = settle(_pairs(mine, seeds).union(held).distinct())
    coded = _word_codes(rows.join(mine.select("id").distinct(), "id", "left_semi").select("id", F.xxhash64("text").alias("th"), "text"))
    words, words_path = scratch(coded.groupBy("id").agg(F.min(F.struct("th", "words")).alias("w")).select("id", "w.th", "w.words"), "words")
    options = {"k": k, "least": least, "similar": similar}
    first = _align(pairs, words, **options)
    # seeds outside what was found; their owners' own stay with them
    inside = F.exists("spans", lambda s: (s["start"] <= F.col("at")) & (F.col("at") + k <= s["end"]))
    rest, rest_path = scratch(mine.filter("id <> owner").select("id", "seed", "at").join(first.select("id", "spans"), "id", "left").filter(~F.coalesce(inside, F.lit(False))).select("id", "seed"), "rest")
    more = settle(_pairs(rest.join(_owned(rest, "seed"), "seed"), seeds).join(pairs, ["id", "owner"], "left_anti"))
    out = first
    if not more.isEmpty():
        both = first.union(_align(more, words, **options))
        out = settle(both.groupBy("id", "th").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans")))
    drop(spark, mine_path, words_path, rest_path)
    return out


def repeats(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """One row for each repeated passage: the later document's id, start and end (in words), source_id with its start and end, similarity. Documents without any are not there."""
    return find(docs, id_col=id_col, **options).select(F.col("id").alias(id_col), F.explode("spans").alias("s")).select(id_col, "s.*")


def _covered(spans: str) -> F.Column:
    """Words that the spans, sorted by start, cover."""
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["to"], x["start"]))).alias("n"), F.greatest(s["to"], x["end"]).alias("to"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step, lambda s: s["n"])


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each document: its id, n_words, n_repeated (words in passages of earlier documents), n_passages, source_ids, spans."""
    found = find(docs, id_col=id_col, text_col=text_col, **options)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("th", T.LongType()), T.StructField("n_words", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = buffers(batch.column(2))
            many = [np.diff(Words(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], ALNUM).at) for lo, hi in slices(at)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(many) if many else np.zeros(0, np.int64))], names=schema.names)

    sized = docs.select(F.col(id_col), F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.col(text_col).cast("string")).mapInArrow(tidy(count), schema)
    out = sized.join(found.withColumnRenamed("id", id_col), [id_col, "th"], "left")
    spans = F.coalesce(F.col("spans"), F.array().cast(found.schema["spans"].dataType))
    return out.withColumn("spans", spans).select(id_col, "n_words", _covered("spans").cast("long").alias("n_repeated"), F.size("spans").cast("long").alias("n_passages"), F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["source_id"]))).alias("source_ids"), "spans")


def remove(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """docs without the passages that an earlier document has, and without documents of which no word is left; chars_col is counted anew. Other columns stay, whatever they are called."""
    found = find(docs, id_col=id_col, text_col=text_col, **options).select(F.col("id").alias("_id"), F.col("th").alias("_th"), F.transform("spans", lambda s: F.array(s["start"], s["end"])).alias("_spans"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    where = docs.columns.index(text_col)
    counted = docs.columns.index(chars_col) if chars_col in docs.columns else None
    same = (F.col(names[docs.columns.index(id_col)]) == F.col("_id")) & (F.xxhash64(F.col(names[where]).cast("string")) == F.col("_th"))
    joined = docs.toDF(*names).join(found, same, "left").select(*names, "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns[:-1])
            changed = pc.is_valid(batch.column(len(cols)))
            at_rows = np.flatnonzero(changed.to_numpy(zero_copy_only=False))
            keep = np.ones(batch.num_rows, bool)
            if at_rows.size:
                raw, at = buffers(cols[where])
                spans = batch.column(len(cols)).take(pa.array(at_rows)).to_pylist()
                texts = []
                for r, own in zip(at_rows.tolist(), spans):
                    part = raw[at[r] : at[r + 1]]
                    texts.append(cut_out(part, Words(part, np.array([0, len(part)]), ALNUM), own))
                keep[at_rows] = [t is not None for t in texts]
                cols[where] = pc.replace_with_mask(cols[where], changed, pa.array([t or "" for t in texts], cols[where].type))
                if counted is not None:
                    cols[counted] = pc.replace_with_mask(cols[counted], changed, pa.array([len(t or "") for t in texts], cols[counted].type))
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-1]).filter(pa.array(keep))

    return joined.mapInArrow(tidy(run), joined.drop("_spans").schema).toDF(*docs.columns)


def cut_out(raw: np.ndarray, words: Words, spans: list[list[int]]) -> str | None:
    """The text without the words of the spans and what stands directly behind them; None if no word is left."""
    gone = np.zeros(len(words), bool)
    for a, b in spans:
        gone[a:b] = True
    if gone.all():
        return None
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    parts, at = [], 0
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        parts.append(bytes(raw[at : words.start[a]]).decode("utf-8", "replace").strip())
        at = int(words.start[b]) if b < len(words) else len(raw)
    parts.append(bytes(raw[at:]).decode("utf-8", "replace").strip())
    return "\n".join(p for p in parts if p)
