"""Best-fit packing by exact-complement hashing (operator 7).

Only the histogram of piece lengths decides which lengths share a sequence,
and it has as many entries as a sequence has tokens. So the driver plans on
counts: an availability table by length answers which single, pair or triple
of lengths sums exactly to a gap, each found combination is consumed as often
as the counts allow, and best-fit decreasing places what is left. Every
consumption empties a length, so a plan has a few thousand patterns whatever
the input's size. The executors then number the pieces of each length (salted,
so that a very common length makes no large group) and look their place up.

Defined results: a null text is empty and makes one piece, its end token;
repeated rows are packed as often as they occur; an empty table gives no rows;
columns besides the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from skald.llm.common import parts, settle, tidy
from skald.llm.tokens import BytePairs, default_path

#: Pieces that are numbered together: a thousandth of all, from FEWEST to GROUP.
FEWEST, GROUP = 64, 50_000


class Plan:
    """Sequences by pattern: `patterns` lists (lengths, times); n is how many sequences there are."""

    def __init__(self, counts: np.ndarray):
        self.cap = len(counts) - 1
        self.patterns: list[tuple[tuple[int, ...], int]] = []
        left = counts.astype(np.int64).copy()
        left[0] = 0
        self._exact(left)
        self._best_fit(left)
        self.n = sum(times for _, times in self.patterns)
        rows = []
        base = 0
        used = np.zeros(self.cap + 1, np.int64)
        for lengths, times in self.patterns:
            offset = 0
            for x in lengths:
                rows.append((x, used[x], base, offset))
                used[x] += times
                offset += x
            base += times
        rows.sort()
        length, first, self.base, self.offset = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
        self.first, self.key = first, length << 40 | first

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the rank-th piece of a length."""
        i = np.searchsorted(self.key, length.astype(np.int64) << 40 | rank, "right") - 1
        return self.base[i] + rank - self.first[i], self.offset[i]

    def _take(self, left: np.ndarray, lengths: tuple[int, ...]) -> int:
        times = min(int(left[x]) // lengths.count(x) for x in set(lengths))
        if times:
            for x in lengths:
                left[x] -= times
            self.patterns.append((lengths, times))
        return times

    @staticmethod
    def _pair(there: np.ndarray, total: int) -> np.ndarray:
        """The larger parts of all pairs of lengths at hand that sum to total, largest first."""
        if total < 2:
            return np.zeros(0, np.int64)
        half = (total + 1) // 2
        return (np.flatnonzero(there[half:total] & there[1 : total - half + 1][::-1]) + half)[::-1]

    def _exact(self, left: np.ndarray) -> None:
        cap = self.cap
        if left[cap]:
            self._take(left, (cap,))
        for a in range(cap - 1, 0, -1):
            gap = cap - a
            if left[a] and left[gap]:
                self._take(left, (a, gap))
            for b in self._pair(left > 0, gap) if left[a] else ():
                self._take(left, (a, int(b), gap - int(b)))
                if not left[a]:
                    break
            for b in range(gap - 2, 0, -1) if left[a] else ():
                if not left[b]:
                    continue
                for c in self._pair(left > 0, gap - b):
                    if c <= b:
                        self._take(left, (a, b, int(c), gap - b - int(c)))
                    if not left[a] or not left[b]:
                        break
                if not left[a]:
                    break

    def _best_fit(self, left: np.ndarray) -> None:
        bins: list[list[list]] = [[] for _ in range(self.cap + 1)]  # by gap: [lengths, times]
        for a in range(self.cap, 0, -1):
            while left[a]:
                gap = next((g for g in range(a, self.cap) if bins[g]), self.cap)
                if gap == self.cap:
                    each = min(self.cap // a, int(left[a]))
                    times = int(left[a]) // each
                    bins[self.cap - each * a].append([(a,) * each, times])
                    left[a] -= each * times
                    continue
                lengths, times = bins[gap].pop()
                used = min(times, int(left[a]))
                if used < times:
                    bins[gap].append([lengths, times - used])
                bins[gap - a].append([(*lengths, a), used])
                left[a] -= used
        self.patterns += [(lengths, times) for group in bins for lengths, times in group]


def cut(total: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of documents of total tokens: row, number, start, length. Only the first of several may be shorter than cap."""
    many = (total + cap - 1) // cap
    row = np.repeat(np.arange(len(total)), many)
    number = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    short = total - (many - 1) * cap
    start = np.where(number > 0, short[row] + (number - 1) * cap, 0)
    return row, number, start, np.where(number > 0, cap, short[row])


def ended(bpe: BytePairs, col: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the end token after each document, and the documents' offsets."""
    ids, at = bpe.encode(col)
    return np.insert(ids, at[1:], end), at + np.arange(len(at))


def pieces(docs: DataFrame, *, tokenizer: str, cap: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's pieces of at most cap tokens: id, piece, start, length, ids_crc32, and the ids if with_ids."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("piece", T.IntegerType()), *(T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32"))])
    if with_ids:
        schema.add("ids", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = BytePairs.load(tokenizer)
        for batch in (part for whole in batches for part in parts(whole, 1)):
            ids, at = ended(bpe, batch.column(1), end_id)
            row, number, start, length = cut(np.diff(at), cap)
            begin = at[row] + start
            view = memoryview(ids.astype("<u4")).cast("B")
            spans = [view[4 * a : 4 * b] for a, b in zip(begin.tolist(), (begin + length).tolist())]
            cols = [batch.column(0).take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in spans], pa.int64())]
            if with_ids:
                cols.append(pa.array([bytes(x) for x in spans], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(tidy(run), schema)


def assign(cut_up: DataFrame, *, cap: int = 2048, by: tuple[str, ...] = ("doc_id", "piece")) -> tuple[DataFrame, int]:
    """Give each piece its sequence_id (0 to n - 1) and offset; also n. cut_up is read three times: pass a settled table."""
    spark = cut_up.sparkSession
    counts = np.zeros(cap + 1, np.int64)
    for row in cut_up.groupBy("length").count().collect():  # at most cap rows
        counts[row["length"]] = row["count"]
    plan = Plan(counts)
    group = max(FEWEST, min(GROUP, int(counts.sum()) // 1000))
    salts = F.array(*[F.lit(max(1, -(-int(n) // group))) for n in counts])
    salted = cut_up.withColumn("_salt", F.pmod(F.xxhash64(*by), F.element_at(salts, (F.col("length") + 1).cast("int"))))
    by_salt = ["length", "_salt"]
    before = salted.groupBy(*by_salt).agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(W.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    ranked = salted.withColumn("_row", F.row_number().over(W.partitionBy(*by_salt).orderBy(*by))).join(before, by_salt)
    ranked = ranked.withColumn("_rank", F.col("_row") + F.col("_before") - 1).drop("_salt", "_row", "_before")
    shared = spark.sparkContext.broadcast(plan)
    schema = T.StructType([*(ranked.schema[c] for c in cut_up.columns), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = cut_up.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = {n: i for i, n in enumerate(batch.schema.names)}
            seq, offset = shared.value.place(batch.column(where["length"]).to_numpy(), batch.column(where["_rank"]).to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(where[n]) for n in names), pa.array(seq), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(tidy(run), schema), plan.n


def pack(docs: DataFrame, *, tokenizer: str | None = None, cap: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents into sequences of at most cap tokens: id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut_up = settle(pieces(docs, tokenizer=tokenizer or default_path(), cap=cap, end_id=end_id, id_col=id_col, text_col=text_col))
    return assign(cut_up, cap=cap, by=(id_col, "piece"))[0]
