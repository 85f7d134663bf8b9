"""What the operators of this package share: shared-folder tables, word scans over Arrow text, hashing.

Texts are read as Arrow buffers and handled as numpy arrays, a few megabytes
at a time, so that a worker's memory does not depend on how many rows a batch
has. Null texts count as empty.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skald.sources.shared import drop, scratch, settle, shared_dir

__all__ = ["drop", "scratch", "settle", "shared_dir"]

#: Bytes of text that a scan handles at once (a longer document makes a slice of its own).
SLICEBYTES = 2 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
ODD = np.uint64(0xD6E8FEB86659FD93)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores at its end as it takes to be no column's (case does not count)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def others(columns: list[str], *new: str) -> list[str]:
    """The columns that an operator's new ones do not replace (case does not count)."""
    return [c for c in columns if c.lower() not in {n.lower() for n in new}]


def extended(df: DataFrame, run, fields: list[T.StructField]) -> DataFrame:
    """df with new columns at its end: run gets batches of df's columns (by place; their names may be anything) and yields them with the new ones."""
    old = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema)]
    schema = T.StructType([*old, *(T.StructField(f"n{i}", f.dataType) for i, f in enumerate(fields))])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=schema.names)

    return df.toDF(*(f.name for f in old)).mapInArrow(tidy(named), schema).toDF(*df.columns, *(f.name for f in fields))


def quoted(name: str) -> str:
    """A column name as Spark's expressions take it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


#: What else a worker can give back between tasks.
AT_REST: list = []


def release() -> None:
    """Give a worker's free memory back; it may live on for other tasks."""
    for rest in AT_REST:
        rest()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library is glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_large() -> None:
    """From now on large arrays get pages of their own, which go back as soon as they are freed, whatever else lives on."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD


def tidy(run):
    """run over batches, and release() when its task ends."""

    def tidied(batches):
        map_large()
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def keys(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit words."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + (np.uint64(seed) << np.uint64(32))) * GOLDEN)


BYTE = keys(256, 7) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_class(word: bytes = b"", outside: bytes | None = None) -> np.ndarray:
    """A table of which bytes are part of words: those of word, or all but those of outside."""
    table = np.zeros(256, bool)
    if outside is None:
        table[np.frombuffer(word, np.uint8)] = True
        return table
    table[:] = True
    table[np.frombuffer(outside, np.uint8)] = False
    return table


#: Words of digits, a-z and all that is not ASCII; words between ASCII white space.
ALNUM = byte_class(word=bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
SPACED = byte_class(outside=bytes([0x20, *range(0x09, 0x0E)]))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and where each row starts (n + 1 offsets); null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(at: np.ndarray, most: int = SLICEBYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows lo..hi whose texts have about most bytes."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts in a column have about SLICE_BYTES."""
    for lo, hi in slices(buffers(batch.column(column))[1]):
        yield batch.slice(lo, hi - lo)


class Words:
    """The words of some texts: hash, first byte, end byte; `at` has each text's first word (n + 1 entries)."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, table: np.ndarray):
        n = len(raw)
        low = _LOWER[raw]
        inside = table[low]
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edge = at[(at > 0) & (at < n)]
            first[edge] = inside[edge]
            last[edge - 1] = inside[edge - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.start, at)
        size = self.end - self.start
        if len(size):
            place = np.arange(n) - np.repeat(self.start, np.diff(np.append(self.start, n)), axis=0) if self.start[0] == 0 else np.arange(n) - np.concatenate([np.zeros(self.start[0], np.int64), np.repeat(self.start, np.diff(np.append(self.start, n)))])
            np.minimum(place, int(size.max()) - 1, out=place)  # bytes after a word's end weigh nothing
            power = np.cumprod(np.full(int(size.max()), ODD, np.uint64))
            value = BYTE[low] * power[place]
            value[~inside] = 0
            self.hash = mix(np.add.reduceat(value, self.start) + size.astype(np.uint64) * GOLDEN)
        else:
            self.hash = np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.hash)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive words, over text borders too: len(h) - k + 1 entries, 0 at least."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, np.uint64((k * int(GOLDEN)) & 0xFFFFFFFFFFFFFFFF), np.uint64)
    factor = ODD
    for j in range(k):
        out += h[j : j + n] * factor
        factor = np.uint64((int(factor) * int(ODD)) & 0xFFFFFFFFFFFFFFFF)
    return mix(out)


def inside_rows(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n grams of k words start and end in one text."""
    ok = np.ones(max(0, n), bool)
    for j in range(1, k):
        cut = at[1:-1] - j
        ok[cut[(cut >= 0) & (cut < n)]] = False
    return ok


def spread(at: np.ndarray) -> np.ndarray:
    """The row of each item, from offsets."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))
