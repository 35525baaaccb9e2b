"""Substring dedup by fixed-block anchors.

Words `[^\\x20\\x09-\\x0D]+` of whole texts. A window of `window` words that starts at two places
or more is a repeat; all words it covers go. With blocks of (window + 1) / 2 words, every window
holds a whole block of its own document, and at its other place the same words are a rolling
window. So:

1. Index: the non-overlapping blocks of every document. Probe: every rolling window of block
   size. Both meet by hash, in value buckets; a block that starts at two places or more is a hit.
2. Extension: hits are extended to windows of full length all of whose own blocks are hits, and
   these are matched by a 96-bit hash of all their words. Runs of matched windows are the maximal
   exact repeats. No pair of places is ever listed: a passage with a million copies is one value
   with a count.

Blocks of documents send each distinct value once (see blocks.py). Texts move compressed, twice,
by block number, and never meet by content.

Defined cases: a null text has no words, a document shorter than a window loses nothing, a repeat
inside one document counts, repeated rows are documents of their own (so both lose their long
texts), an empty table gives no rows, other columns are not read.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from .shared import cut_lineage
from .words import SPACES, Chunk, release, utf8_buffer, window_hashes

WINDOW = 35
RESULT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<first: long, end: long>>"
WIDE = "bucket int, block long, n int, one binary, two binary, many binary"


class Block:
    """A block of documents with its anchors and rolling probes."""

    def __init__(self, data: bytes, window: int, n_buckets: int):
        self.window, self.size, self.n_buckets = window, (window + 1) // 2, n_buckets
        table = B.unpack(data)
        self.ids = table.column("doc_id").to_pylist()
        self.chunk = Chunk(*utf8_buffer(table.column("text")), SPACES, False)
        self.hashes = self.chunk.word_hashes()

    def probes(self):
        """Distinct rolling windows of block size: keys, counts, whether an anchor, and per start."""
        c = self.chunk
        starts = c.window_starts(self.size)
        keys, inverse, counts = np.unique(B.keyed(window_hashes(self.hashes, starts, self.size), self.n_buckets),
                                          return_inverse=True, return_counts=True)
        first = np.repeat(c.row_first[:-1], c.n_words)[starts] if len(starts) else starts
        own = (starts - first) % self.size == 0
        anchors = np.zeros(len(keys), bool)
        anchors[inverse[own]] = True
        return keys, counts, anchors, starts[own], inverse[own]

    def candidates(self, answers: dict[int, bytes]):
        """Starts of full windows whose own blocks are all hits, and their two hashes."""
        keys, _, anchors, at, which = self.probes()
        hit = np.zeros(len(keys), bool)
        for bucket, first, end in zip(*B.spans(keys)):
            known = np.flatnonzero(anchors[first:end]) + first
            hit[known] = B.flags(answers[int(bucket)], len(known))
        n = len(self.hashes)
        blocks, hits = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        blocks[at + 1] = 1
        hits[at[hit[which]] + 1] = 1
        blocks, hits = np.cumsum(blocks), np.cumsum(hits)
        starts = self.chunk.window_starts(self.window)
        last = starts + self.window - self.size + 1
        starts = starts[blocks[last] - blocks[starts] == hits[last] - hits[starts]]
        return starts, window_hashes(self.hashes, starts, self.window, "one"), window_hashes(
            self.hashes, starts, self.window, "two")

    def wide(self, answers: dict[int, bytes]):
        """Distinct candidate windows sorted by bucket and hash: first hash, second, counts, per start."""
        starts, one, two = self.candidates(answers)
        two = (two >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[:len(a)]
        group = np.cumsum(new) - 1
        inverse = np.empty(len(a), np.int64)
        inverse[order] = group
        return a[new], b[new], np.bincount(group, minlength=int(new.sum())), starts, inverse


def _bucket_of(one: np.ndarray, n_buckets: int) -> np.ndarray:
    return (((one >> np.uint64(40)) * np.uint64(n_buckets)) >> np.uint64(24)).astype(np.int64)


def _wide_tally(table: pa.Table) -> pa.Table:
    rows = table.to_pydict()
    one = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["one"]])
    two = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["two"]])
    many = np.concatenate([B.flags(x, n) for x, n in zip(rows["many"], rows["n"])])
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    group = np.empty(len(a), np.int64)
    group[order] = np.cumsum(new) - 1
    again = np.bincount(group, 1 + many) > 1
    del one, two, many, order, a, b, new
    ends = np.cumsum(rows["n"])
    return pa.table({"block": pa.array(rows["block"], pa.int64()), "bucket": pa.array(rows["bucket"], pa.int32()),
                     "answer": pa.array([B.bits(again[group[e - n:e]]) for e, n in zip(ends, rows["n"])], pa.binary())})


def _answers(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column("bucket").to_pylist(), table.column("answer").to_pylist()))


def _hit(total: np.ndarray, known: np.ndarray, anchors: np.ndarray) -> bytes:
    """Answer of the first exchange: of a block's anchors, which start at two places or more."""
    return B.bits((total > 1)[anchors])


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space) and removed (spans of
    word numbers, the end excluded), one row per row of `docs`."""
    n_buckets = B.buckets(docs, text)
    packed = B.pack(docs, doc_id, text)

    def probe(batches):
        for batch in batches:
            for number, data in zip(batch.column("block").to_pylist(), batch.column("rows").to_pylist()):
                keys, counts, anchors, _, _ = Block(data, window, n_buckets).probes()
                yield B.send(number, keys, counts, anchors)
                del keys, counts, anchors
                release()

    hits = cut_lineage(B.tally(packed.mapInArrow(probe, B.SENT), _hit))

    def extend(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for number, data in zip(rows.column("block").to_pylist(), rows.column("rows").to_pylist()):
            one, two, counts, _, _ = Block(data, window, n_buckets).wide(_answers(answers))
            bucket = _bucket_of(one, n_buckets)
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[:len(bucket)])
            for f, e in zip(first, np.append(first[1:], len(bucket))):
                out.append((int(bucket[f]), number, int(e - f), one[f:e].tobytes(), two[f:e].tobytes(),
                            B.bits(counts[f:e] > 1)))
        release()
        columns = list(zip(*out)) if out else [[]] * 6
        types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)],
                        ["bucket", "block", "n", "one", "two", "many"])

    wide = packed.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(extend, WIDE)
    repeats = cut_lineage(wide.groupBy("bucket").applyInArrow(_wide_tally, B.ANSWER))
    both = hits.selectExpr("block", "bucket", "answer", "false AS wide").unionByName(
        repeats.selectExpr("block", "bucket", "answer", "true AS wide"))

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        out = []
        narrow = answers.filter(pc.invert(answers.column("wide")))
        full = _answers(answers.filter(answers.column("wide")))
        for data in rows.column("rows").to_pylist():
            block = Block(data, window, n_buckets)
            one, _, _, starts, inverse = block.wide(_answers(narrow))
            bucket = _bucket_of(one, n_buckets)
            repeat = np.zeros(len(one), bool)
            for b in np.unique(bucket):
                here = np.flatnonzero(bucket == b)
                repeat[here] = B.flags(full[int(b)], len(here))
            c = block.chunk
            step = np.zeros(len(block.hashes) + 1, np.int64)
            again = starts[repeat[inverse]]
            np.add.at(step, again, 1)
            np.add.at(step, again + window, -1)
            gone = np.cumsum(step[:-1]) > 0
            raw = c.data.tobytes()
            for r, i in enumerate(block.ids):
                lo, hi = int(c.row_first[r]), int(c.row_first[r + 1])
                words = raw[c.offsets[r]:c.offsets[r + 1]].split()
                drop = gone[lo:hi]
                ranges = []
                if drop.any():
                    words = list(compress(words, ~drop))
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], drop, [False]]).astype(np.int8)))
                    ranges = [{"first": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])]
                out.append((i, hi - lo, int(drop.sum()), b" ".join(words).decode(), ranges))
        release()
        columns = list(zip(*out)) if out else [[]] * 5
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(),
                 pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)],
                        ["doc_id", "n_words", "n_removed", "kept_text", "removed"])

    return packed.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(finish, RESULT)
