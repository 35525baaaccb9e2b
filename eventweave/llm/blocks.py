"""Blocks of documents, and exchanges of hashed values between blocks and value buckets.

`pack` puts neighbouring rows into compressed blocks of about 2 MB of text. A block is the unit of
work and of answers: it sends its distinct values, sorted and delta-coded per bucket, and gets
back one small answer per bucket in the order in which it sent them. So a value costs about 4
bytes on the way, a value that is frequent in a block travels once per block, and a value that a
third of all rows hold meets in its bucket as one entry per block.

A block is a function of its task's input. Input that cannot be read again in the same order (a
random sample, say) has to be written first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import partitions, text_bytes
from .words import CHUNK_BYTES, cuts, release, utf8_buffer

BUCKET_BYTES = 8 << 20  # of text
PACKED = "block long, rows binary"
SENT = "bucket int, block long, n int, vals binary, counts binary, anchors binary"
ANSWER = "block long, bucket int, answer binary"
_LOW = np.uint64((1 << 40) - 1)


def buckets(docs: DataFrame, text: str = "text") -> int:
    """Enough buckets for BUCKET_BYTES of text each, and a few per shuffle partition."""
    return min(max(4 * partitions(docs.sparkSession), -(-text_bytes(docs, text) // BUCKET_BYTES)), 1 << 23)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))
    waiting: list[pa.RecordBatch] = []
    held = 0

    def block() -> pa.RecordBatch:
        nonlocal number
        table = pa.Table.from_batches(waiting).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=options) as out:
            out.write_table(table)
        number += 1
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
            ["block", "rows"])

    for batch in batches:
        _, offsets = utf8_buffer(batch.column("text"))
        for low, high in cuts(offsets):
            size = int(offsets[high] - offsets[low])
            if waiting and held + size > CHUNK_BYTES:
                yield block()
                waiting, held = [], 0
            waiting.append(batch.slice(low, high - low))
            held += size
    if waiting:
        yield block()
    waiting = []
    release()


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """block, rows: compressed (doc_id, text) of some rows; null texts are empty."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(_pack, PACKED)


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def keyed(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """64-bit hashes as (bucket, low 40 bits) in one number."""
    bucket = ((hashes >> np.uint64(40)) * np.uint64(n_buckets)) >> np.uint64(24)
    return (bucket << np.uint64(40)) | (hashes & _LOW)


def squeeze(data: bytes) -> bytes:
    return pa.compress(data, "zstd", asbytes=True) if data else b""


def expand(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, "zstd", asbytes=True) if size else b""


def encode(values: np.ndarray) -> bytes:
    """Sorted numbers below 2**40: byte planes of the differences, compressed."""
    steps = np.diff(values, prepend=np.uint64(0))
    return squeeze(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes())


def decode(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :5] = np.frombuffer(expand(data, 5 * n), np.uint8).reshape(5, n).T
    return np.cumsum(out.reshape(-1).view(np.uint64), dtype=np.uint64)


def bits(flags: np.ndarray) -> bytes:
    return squeeze(np.packbits(flags).tobytes())


def flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(expand(data, (n + 7) // 8), np.uint8), count=n).astype(bool)


def spans(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, first, end) of the runs of equal buckets in sorted keys."""
    bucket = (keys >> np.uint64(40)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else np.zeros(0, int)
    return bucket[first], first, np.append(first[1:], len(keys))


def send(block: int, keys: np.ndarray, counts: np.ndarray, anchors: np.ndarray) -> pa.RecordBatch:
    """Rows of SENT for the sorted distinct keys of a block; counts are cut to 255 for the way."""
    rows = [(int(b), block, int(e - f), encode(keys[f:e] & _LOW), squeeze(np.minimum(counts[f:e], 255).astype(np.uint8).tobytes()),
             bits(anchors[f:e])) for b, f, e in zip(*spans(keys))]
    columns = list(zip(*rows)) if rows else [[]] * 6
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                      ["bucket", "block", "n", "vals", "counts", "anchors"])


def _tally(answer):
    """Bucket by bucket: counts of equal values over all blocks -> one answer per block."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        values = np.concatenate([decode(v, n) for v, n in zip(rows["vals"], rows["n"])])
        counts = np.concatenate([np.frombuffer(expand(c, n), np.uint8) for c, n in zip(rows["counts"], rows["n"])])
        anchors = np.concatenate([flags(a, n) for a, n in zip(rows["anchors"], rows["n"])])
        order = np.argsort(values, kind="stable")
        new = np.concatenate([[True], np.diff(values[order]) > 0])
        group = np.empty(len(values), np.int64)
        group[order] = np.cumsum(new) - 1
        total = np.bincount(group, counts)
        known = np.bincount(group, anchors) > 0
        del values, counts, order, new
        ends = np.cumsum(rows["n"])
        out = [answer(total[group[e - n:e]], known[group[e - n:e]], anchors[e - n:e])
               for e, n in zip(ends, rows["n"])]
        del group, total, known, anchors
        release()
        return pa.table({"block": pa.array(rows["block"], pa.int64()), "bucket": pa.array(rows["bucket"], pa.int32()),
                         "answer": pa.array(out, pa.binary())})

    return run


def tally(sent: DataFrame, answer) -> DataFrame:
    """ANSWER rows; `answer(total, known, anchors)` makes the bytes for the values of a block."""
    return sent.groupBy("bucket").applyInArrow(_tally(answer), ANSWER)
