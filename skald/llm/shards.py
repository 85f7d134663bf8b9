"""Training-order materialisation into fixed-stride shards (operator 6).

Documents' token ids, each ended by `end_id`, are joined into one stream for
each input partition and cut into sequences of `length` ids; a partition's last
one is padded. The sequences are written once to the shared folder, so whatever
becomes of executors or of the input later, they are numbered as they were cut:
the partitions' counts give every sequence an index in 0..N-1. A keyed Feistel
network over the least even number of bits that holds N, walked along its cycle
until it falls under N, is a permutation and gives each its slot in training
order. Shard s holds slots s * rows to (s + 1) * rows - 1, at a stride of
`length` ids, so a reader finds any slot by arithmetic and resumes anywhere.

A task writes a range of shards in order, slot by slot, each to a name of its
own and then renamed: a task that is tried again replaces the shard by the same
bytes. The tasks are as many as the shards, TASKS at most.

Defined results: a null or empty text adds only its end id; repeated rows are
written as often as they occur; an empty table gives no sequences and no shard;
columns besides the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skald.llm.common import drop, keys, mix, parts, quoted, scratch, settle, tidy
from skald.llm.packing import ended
from skald.llm.tokens import BytePairs, default_path

LENGTH, SHARD_ROWS, ROUNDS, TASKS = 2048, 4096, 6, 16_384


def permute(index: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """The slot of each index in 0..n-1: a keyed bijection of that range."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    salts = keys(rounds, key & 0x7FFFFFFF)
    out = index.astype(np.uint64)
    left = np.arange(len(out))
    while left.size:
        a, b = out[left] >> np.uint64(half), out[left] & low
        for salt in salts:
            a, b = b, a ^ (mix(b + salt) & low)
        out[left] = a << np.uint64(half) | b
        left = left[out[left] >= n]
    return out.astype(np.int64)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Where a shared folder's files can be written and read from any machine."""
    for scheme in ("s3a://", "s3n://"):
        uri = uri.replace(scheme, "s3://", 1) if uri.startswith(scheme) else uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write(docs: DataFrame, path: str, *, key: int = 20240229, tokenizer: str | None = None, length: int = LENGTH, shard_rows: int = SHARD_ROWS, end_id: int = 0, pad_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards under path; a row for each sequence: slot, shard, byte_offset, n_tokens, ids_crc32 (of its little-endian 32-bit ids, unpadded), first_token (of the first document), doc_ids."""
    spark, bpe_path = docs.sparkSession, tokenizer or default_path()
    kind = docs.schema[id_col].dataType
    text = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    wide = 2 if len(BytePairs.load(bpe_path).size) <= 1 << 16 else 4
    own = [T.StructField("ids", T.BinaryType()), T.StructField("first_token", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind))]
    stored = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("number", T.LongType()), *own])
    store = T.StructType([T.StructField("slot", T.LongType()), *own])

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, bpe = TaskContext.get().partitionId(), BytePairs.load(bpe_path)
        rest, owner, places = np.zeros(0, np.uint32), [], np.zeros(0, np.int64)
        done = 0

        def cut(final: bool) -> pa.RecordBatch:
            nonlocal rest, owner, places, done
            many = -(-len(rest) // length) if final else len(rest) // length
            data = memoryview(rest.astype("<u2" if wide == 2 else "<u4")).cast("B")
            lists, starts = [], []
            for i in range(many):
                a, b = i * length, min((i + 1) * length, len(rest))
                p = int(np.searchsorted(places, a, "right")) - 1
                q = int(np.searchsorted(places, b, "left"))
                lists.append(owner[p:q])
                starts.append(a - int(places[p]))
            cols = [pa.array(np.full(many, part, np.int32)), pa.array(np.arange(done, done + many)), pa.array([bytes(data[wide * i * length : wide * (i + 1) * length]) for i in range(many)], pa.binary()), pa.array(starts, pa.int64()), pa.array(lists, pa.list_(kind_arrow))]
            done += many
            p = max(0, int(np.searchsorted(places, many * length, "right")) - 1) if len(places) else 0
            rest, owner, places = rest[many * length :], owner[p:], places[p:] - many * length
            return pa.RecordBatch.from_arrays(cols, names=stored.names)

        kind_arrow = None
        for batch in (part for whole in batches for part in parts(whole, 1)):
            kind_arrow = batch.column(0).type
            ids, at = ended(bpe, batch.column(1), end_id)
            places = np.concatenate([places, len(rest) + at[:-1]])
            owner = owner + batch.column(0).to_pylist()
            rest = np.concatenate([rest, ids])
            yield cut(False)
        if kind_arrow is not None:
            yield cut(True)

    cut_up, cut_path = scratch(text.mapInArrow(tidy(sequences), stored), "sequences", compression="zstd")
    counted = sorted(cut_up.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row for each input partition
    n = sum(r["n"] for r in counted)
    first = np.zeros(counted[-1]["part"] + 1 if counted else 0, np.int64)
    first[[r["part"] for r in counted]] = np.cumsum([0, *(r["n"] for r in counted)])[:-1]
    shared = spark.sparkContext.broadcast(first)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = shared.value[batch.column(0).to_numpy()] + batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(permute(index, n, key)), *batch.columns[2:]], names=store.names)

    slotted = cut_up.mapInArrow(tidy(place), store).withColumn("shard", F.floor(F.col("slot") / shard_rows))
    manifest = T.StructType([*(T.StructField(x, T.LongType()) for x in ("slot", "shard", "byte_offset", "n_tokens", "ids_crc32", "first_token")), T.StructField("doc_ids", T.ArrayType(kind))])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        fs.create_dir(folder, recursive=True)
        task = TaskContext.get()
        shard, out, temp = -1, None, ""

        def close() -> None:
            if out is not None:
                out.close()
                fs.move(temp, f"{folder}/{shard_name(shard)}")

        for batch in batches:
            rows = []
            for slot, raw, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist()):
                if number != shard:
                    close()
                    shard, temp = number, f"{folder}/.{shard_name(number)}-{task.taskAttemptId()}"
                    out = fs.open_output_stream(temp)
                ids = np.frombuffer(raw, "<u2" if wide == 2 else "<u4")
                out.write(raw)
                if len(ids) < length:
                    out.write(np.full(length - len(ids), pad_id, ids.dtype).tobytes())
                rows.append((slot, number, (slot - number * shard_rows) * length * wide, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            cols = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 5)]
            yield pa.RecordBatch.from_arrays([*cols, batch.column(2), batch.column(3)], names=manifest.names)
        close()

    many = max(1, -(-n // shard_rows))
    each = -(-many // TASKS)  # shards of a task
    dealt = slotted.repartitionById(-(-many // each), F.floor(F.col("shard") / each).cast("int"))
    out = settle(dealt.sortWithinPartitions("slot").mapInArrow(tidy(put), manifest))
    drop(spark, cut_path)
    return out


def read(path: str, slot: int, n: int, *, length: int = LENGTH, shard_rows: int = SHARD_ROWS, wide: int = 2) -> Iterator[np.ndarray]:
    """The n sequences from slot on, in training order, by position alone."""
    fs, folder = filesystem(path)
    while n > 0:
        shard, row = divmod(slot, shard_rows)
        many = min(n, shard_rows - row)
        with fs.open_input_file(f"{folder}/{shard_name(shard)}") as f:
            f.seek(row * length * wide)
            for _ in range(many):
                yield np.frombuffer(f.read(length * wide), "<u2" if wide == 2 else "<u4")
        slot, n = slot + many, n - many
