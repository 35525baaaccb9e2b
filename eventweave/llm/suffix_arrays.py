"""Benchmark decontamination by suffix arrays over shards of the training texts.

Each task cuts its documents into shards of whole documents. Of a shard it sorts all suffixes
(word positions) that can hold a window of the benchmark, by their words, as deep as the longest
item. Every distinct window of the benchmark is then binary-searched: the range of suffixes that
share it gives all occurrences. `longest_table` searches every suffix of every item instead: the
neighbours of its place give its longest verbatim match. Words are numbered by the benchmark's vocabulary; other words are 0, match nothing, and a
0 also stands between documents, so no match crosses documents.

The benchmark is the stated query set. It goes to the tasks in blocks of whole items of at most
`block_bytes` (a longer item is a block of its own); with several blocks the marks of a document
are merged by row. Documents are never shuffled.

Words: A-Z lower-cased, then runs of letters a-z, digits and non-ASCII characters. A window is
`window` consecutive words of an item; an item of fewer, but not none, is one window.

Defined cases: a null text has no words and is clean, an item without words has no windows, items
that share an id count once, a null item id is reported as "null", an empty benchmark hits
nothing, repeated rows are judged each on its own, other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import NOT_ALNUM, Chunk, cuts, release, utf8_buffer, window_hashes

WINDOW = 10
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 2 << 20
MARKS = "row long, doc_id long, n_words long, hit binary, items array<string>"


@dataclass
class Items:
    """A block of the benchmark: word ids of all items in a row, and its distinct windows."""

    vocabulary: np.ndarray   # sorted word hashes; the id of a word is its place + 1
    words: np.ndarray        # ids, items one after the other
    suffix_end: np.ndarray   # per word: end of its item
    suffix_item: np.ndarray  # per word: item row
    window_at: np.ndarray    # per distinct window: a position where it starts
    window_size: np.ndarray
    owner_first: np.ndarray  # owners[owner_first[w]:owner_first[w + 1]]: item names of window w
    owners: np.ndarray
    names: list[str]         # distinct item ids as strings, sorted

    @property
    def depth(self) -> int:
        return int((self.suffix_end - np.arange(len(self.words))).max(initial=0))


def index_items(ids: list, texts: list, window: int = WINDOW) -> Items:
    data, offsets = utf8_buffer(pa.array(texts, pa.string()))
    chunk = Chunk(data, offsets, NOT_ALNUM, True)
    hashes = chunk.word_hashes()
    vocabulary = np.unique(hashes)
    row = chunk.row_of_word()
    end = chunk.row_first[1:][row] if len(row) else np.zeros(0, np.int64)
    size = np.minimum(window, chunk.n_words)[row] if len(row) else np.zeros(0, np.int64)
    at = np.flatnonzero(np.arange(len(row)) + size <= end)
    size = size[at]
    key = window_hashes(hashes, at, size)
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    label = ["null" if i is None else str(i) for i in ids]
    names = sorted(set(label))
    place = {n: k for k, n in enumerate(names)}
    owner = np.array([place[label[r]] for r in row[at]], np.int64)
    pairs = np.unique(np.stack([which.reshape(-1), owner], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
    return Items(vocabulary, np.searchsorted(vocabulary, hashes) + 1, end, row, at[first], size[first],
                 np.searchsorted(pairs[:, 0], np.arange(len(first) + 1)), pairs[:, 1], names)


class Shard:
    """Suffix array of some documents, over the words of a benchmark block."""

    def __init__(self, chunk: Chunk, items: Items):
        self.chunk, self.items = chunk, items
        hashes = chunk.word_hashes()
        ids = np.zeros(len(hashes), np.int64)
        if len(items.vocabulary):
            place = np.minimum(np.searchsorted(items.vocabulary, hashes), len(items.vocabulary) - 1)
            ids = np.where(items.vocabulary[place] == hashes, place + 1, 0)
        # one 0 behind every document; `at` is the place of each word among them
        self.at = np.arange(len(ids)) + chunk.row_of_word()
        self.ids = np.zeros(len(ids) + chunk.n_rows + items.depth + 1, np.int64)
        self.ids[self.at] = ids
        # suffixes that begin with enough known words for the shortest window
        least = int(items.window_size.min(initial=1))
        known = self.ids > 0
        run = np.cumsum(np.concatenate([[0], known]))
        self.suffixes = self.at[(run[np.minimum(self.at + least, len(known))] - run[self.at]) == least]
        self.sort()

    def sort(self) -> None:
        """Order by words, some words at a time, until no ties are left or the items end."""
        bits = max(int(len(self.items.vocabulary)).bit_length(), 1)
        per_key = max(63 // bits, 1)
        order = self.suffixes
        rank = np.zeros(len(order), np.int64)
        open_ = np.arange(len(order))
        depth, deepest = 0, self.items.depth
        while len(open_) and depth < deepest:
            key = np.zeros(len(open_), np.int64)
            for k in range(per_key):
                spot = np.minimum(order[open_] + depth + k, len(self.ids) - 1)
                key = (key << bits) | self.ids[spot]
            sub = np.lexsort((key, rank[open_]))
            order[open_] = order[open_][sub]
            key, group = key[sub], rank[open_]
            new = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
            # the rank of a suffix is the place of the first one it is tied with
            rank[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
            tied = np.zeros(len(open_), bool)
            tied[1:] = ~new[1:]
            tied[:-1] |= ~new[1:]
            open_ = open_[tied]
            depth += per_key
        self.suffixes = order

    def common(self, test: np.ndarray, size: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """Equal words of the item suffixes at `test` and the shard suffixes, up to `size`."""
        n = np.zeros(len(test), np.int64)
        live = np.flatnonzero(n < size)
        while len(live):
            same = self.items.words[test[live] + n[live]] == self.ids[suffix[live] + n[live]]
            live = live[same]
            n[live] += 1
            live = live[n[live] < size[live]]
        return n

    def bound(self, test: np.ndarray, size: np.ndarray, upper: bool, low=None, high=None) -> np.ndarray:
        """First suffix not below (`upper`: above) the first `size` words of each item suffix."""
        low = np.zeros(len(test), np.int64) if low is None else low.copy()
        high = np.full(len(test), len(self.suffixes)) if high is None else high.copy()
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                return low
            mid = (low[live] + high[live]) // 2
            suffix = self.suffixes[mid]
            n = self.common(test[live], size[live], suffix)
            equal = n == size[live]
            k = np.where(equal, 0, n)
            below = ~equal & (self.ids[suffix + k] < self.items.words[test[live] + k])
            if upper:
                below |= equal
            low[live[below]] = mid[below] + 1
            high[live[~below]] = mid[~below]

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """(window, place of its first word) of every occurrence of every distinct window."""
        at, size = self.items.window_at, self.items.window_size
        low = self.bound(at, size, False)
        some = np.flatnonzero((low < len(self.suffixes)))
        some = some[self.common(at[some], size[some], self.suffixes[low[some]]) == size[some]]
        high = self.bound(at[some], size[some], True, low[some])
        n = high - low[some]
        which = np.repeat(some, n)
        step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return which, self.suffixes[np.repeat(low[some], n) + step]

    def longest(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item word, shard place, length) of the longest match of every item suffix, if it has
        `least` words or is a whole item."""
        test = np.arange(len(self.items.words))
        size = self.items.suffix_end - test
        if not len(self.suffixes):
            return test[:0], test[:0], test[:0]
        spot = self.bound(test, size, False)
        best, place = np.zeros(len(test), np.int64), np.zeros(len(test), np.int64)
        for near in (np.maximum(spot - 1, 0), np.minimum(spot, len(self.suffixes) - 1)):
            n = self.common(test, size, self.suffixes[near])
            place = np.where(n > best, self.suffixes[near], place)
            best = np.maximum(best, n)
        begin = np.concatenate([[True], self.items.suffix_item[1:] != self.items.suffix_item[:-1]])
        keep = np.flatnonzero((best >= least) | (begin & (best == size)))
        return test[keep], place[keep], best[keep]

    def marks(self) -> tuple[np.ndarray, np.ndarray]:
        """Per word whether it is hit; distinct (row, item name) pairs."""
        which, place = self.occurrences()
        step = np.zeros(len(self.ids) + 1, np.int64)
        np.add.at(step, place, 1)
        np.add.at(step, place + self.items.window_size[which], -1)
        hit = np.cumsum(step)[self.at] > 0
        rows = np.repeat(np.arange(self.chunk.n_rows), self.chunk.n_words)
        row_at = np.zeros(len(self.ids), np.int64)
        row_at[self.at] = rows
        pairs = np.unique(np.stack([row_at[place], which], 1), axis=0) if len(which) else np.zeros((0, 2), np.int64)
        first, n = self.items.owner_first[pairs[:, 1]], np.diff(self.items.owner_first)[pairs[:, 1]]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        named = np.stack([np.repeat(pairs[:, 0], n), self.items.owners[np.repeat(first, n) + step]], 1)
        return hit, np.unique(named, axis=0) if len(named) else named


def shards(column: pa.Array, items: Items) -> Iterator[tuple[int, int, Shard]]:
    data, offsets = utf8_buffer(column)
    for low, high in cuts(offsets, SHARD_BYTES):
        chunk = Chunk(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], NOT_ALNUM, True)
        yield low, high, Shard(chunk, items)
        release()


def _blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_bytes: int) -> list:
    """The benchmark as broadcast blocks; the driver holds one block at a time."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).filter("length(t) > 0")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-2 * total // block_bytes))  # a hash deals out unevenly: aim at half
    out = []
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("t"), F.lit(n)) == k).collect() if n > 1 else rows.collect()
        out.append(spark.sparkContext.broadcast(index_items([r.i for r in part], [r.t for r in part], window)))
    return out


def _digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def _marker(block):
    """rows (row, doc_id, text) -> MARKS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = block.value
        for batch in batches:
            for low, high, shard in shards(batch.column("text"), items):
                hit, named = shard.marks()
                first = shard.chunk.row_first
                spans = np.searchsorted(named[:, 0], np.arange(high - low + 1))
                yield pa.RecordBatch.from_arrays([
                    batch.column("row").slice(low, high - low),
                    batch.column("doc_id").slice(low, high - low),
                    pa.array(shard.chunk.n_words, pa.int64()),
                    pa.array([np.packbits(hit[first[r]:first[r + 1]]).tobytes() for r in range(high - low)],
                             pa.binary()),
                    pa.array([[items.names[i] for i in named[spans[r]:spans[r + 1], 1]]
                              for r in range(high - low)], pa.list_(pa.string())),
                ], ["row", "doc_id", "n_words", "hit", "items"])

    return run


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = [int(np.unpackbits(np.frombuffer(h, np.uint8)).sum()) for h in batch.column("hit").to_pylist()]
        items = [sorted(set(x)) for x in batch.column("items").to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()),
            pa.array([len(x) for x in items], pa.int64()), pa.array([_digest(x) for x in items]),
            pa.array([h > 0 for h in hits]),
        ], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _merge(table: pa.Table) -> pa.Table:
    """Marks of one row from several blocks."""
    bits = [np.frombuffer(h, np.uint8) for h in table.column("hit").to_pylist()]
    names = sorted({n for x in table.column("items").to_pylist() for n in x})
    head = table.slice(0, 1).to_pydict()
    return pa.table({
        "row": pa.array(head["row"], pa.int64()), "doc_id": pa.array(head["doc_id"], pa.int64()),
        "n_words": pa.array(head["n_words"], pa.int64()),
        "hit": pa.array([np.bitwise_or.reduce(bits).tobytes()], pa.binary()),
        "items": pa.array([names], pa.list_(pa.string()))})


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, one row per document row."""
    blocks = _blocks(benchmark, item_id, item_text, window, block_bytes)
    rows = docs.select(F.monotonically_increasing_id().alias("row"),
                       F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marks = rows.mapInArrow(_marker(blocks[0]), MARKS)
    for block in blocks[1:]:
        marks = marks.unionByName(rows.mapInArrow(_marker(block), MARKS))
    if len(blocks) > 1:
        marks = marks.groupBy("row").applyInArrow(_merge, MARKS)
    return marks.mapInArrow(
        _report, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def longest_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """item_row and item_word of every item suffix with a match of `window` words or a whole item,
    with doc_id, doc_word and length of its longest match in each shard."""
    parts = []
    for block in _blocks(benchmark, item_id, item_text, window, BLOCK_BYTES):

        def run(batches, block=block):
            items = block.value
            start = np.searchsorted(items.suffix_item, items.suffix_item)
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for low, _, shard in shards(batch.column("text"), items):
                    test, place, size = shard.longest(window)
                    word = np.searchsorted(shard.at, place)
                    row = shard.chunk.row_of_word()[word] if len(word) else word
                    yield pa.RecordBatch.from_arrays([
                        pa.array(items.suffix_item[test], pa.int64()), pa.array(test - start[test], pa.int64()),
                        pa.array([ids[low + r] for r in row], pa.int64()),
                        pa.array(word - shard.chunk.row_first[row], pa.int64()), pa.array(size, pa.int64()),
                    ], ["item_row", "item_word", "doc_id", "doc_word", "length"])

        parts.append(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
            run, "item_row long, item_word long, doc_id long, doc_word long, length long"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def longest_table(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, item_hash, item_word, doc_id, doc_word, length: the longest match over all documents
    of every item suffix that has one of `window` words or of its whole item. item_hash (xxhash64 of
    the text) tells items of one id apart; equal items count once. Of several longest matches
    one is given. Columns item_id and doc_id keep their values."""
    spark = benchmark.sparkSession
    kind = benchmark.schema[item_id].dataType.simpleString()
    items = benchmark.select(F.col(item_id).alias("item_id"), F.xxhash64(item_text).alias("item_hash"),
                             F.col(item_text).alias("t")).filter("length(t) > 0").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-2 * total // block_bytes))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for k in range(n):
        part = items.filter(F.pmod("item_hash", F.lit(n)) == k).collect()
        block = spark.sparkContext.broadcast((
            index_items([r.item_id for r in part], [r.t for r in part], window),
            [None if r.item_id is None else str(r.item_id) for r in part], [r.item_hash for r in part]))

        def run(batches, block=block):
            found, names, hashes = block.value
            start = np.searchsorted(found.suffix_item, found.suffix_item)
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for low, _, shard in shards(batch.column("text"), found):
                    test, place, size = shard.longest(window)
                    word = np.searchsorted(shard.at, place)
                    row = shard.chunk.row_of_word()[word] if len(word) else word
                    of = found.suffix_item[test]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([names[i] for i in of], pa.string()), pa.array([hashes[i] for i in of], pa.int64()),
                        pa.array(test - start[test], pa.int64()), pa.array([ids[low + r] for r in row], pa.int64()),
                        pa.array(word - shard.chunk.row_first[row], pa.int64()), pa.array(size, pa.int64()),
                    ], ["item_id", "item_hash", "item_word", "doc_id", "doc_word", "length"])

        part = rows.mapInArrow(run, "item_id string, item_hash long, item_word long, doc_id long, doc_word long, length long")
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("item_id", "item_hash", "item_word").agg(F.min_by(
        F.struct("doc_id", "doc_word", "length"), F.struct(-F.col("length"), "doc_id", "doc_word")).alias("m"))
    return best.select(F.col("item_id").cast(kind).alias("item_id"), "item_hash", "item_word", "m.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` with no hit word, all columns kept; one narrow pass per block."""
    # inside, columns go by number: Spark's Arrow functions take no names with dots
    names, at = docs.columns, docs.columns.index(text)
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
    for block in _blocks(benchmark, item_id, item_text, window, block_bytes):

        def run(batches, block=block):
            items = block.value
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for low, _, shard in shards(batch.column(at), items):
                    hit, _ = shard.marks()
                    clean[low + shard.chunk.row_of_word()[hit]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs.toDF(*names)
