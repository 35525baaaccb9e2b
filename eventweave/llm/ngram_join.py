"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersections.

A document's set is its distinct `n`-word shingles (64-bit hashes). Two sets link when
100 * |intersection| >= percent * |union|.

1. Blocks of documents send their distinct shingles to value buckets and learn in how many
   documents each one is. Shingles of one document only are in no intersection: a set with more
   than (100 - percent) % of them links with nothing and is settled, which leaves near copies.
2. Equal sets become one set. Of each set only the rarest shingles (the prefix that any link must
   touch, by (number of documents, hash)) are used to find sets that could meet: sets that touch a
   shingle hang on its smallest set, and what hangs together is a group.
3. A group is a tile. One beyond `TILE_BYTES` is cut into tiles by size band (neighbouring bands
   hold all sets that the size bound lets link) and hash. In a tile, sets are compared in order of
   size and only with sets they are not yet connected to: sizes and the bit counts of two parity
   bitmaps bound the overlap from above, and what passes is decided by exact intersection of the
   sorted arrays. So a tile of m near copies costs about m intersections, not m * m / 2.
4. Tiles of one group are compared with its first tile of each band, joined up, and then pairs of
   tiles that are not yet one class as a whole; nothing is capped.
5. Links between sets (a spanning forest of each tile) give the classes.

Words: A-Z lower-cased, runs of anything but ASCII white space. Defined cases: a document with
fewer than `n` words has its whole sequence as its one shingle; without words or text it has no
shingle and is a class of its own; repeated rows have equal sets and share a class (rows that also
share the id count as one node); null ids are one node, smaller than all others, and stay null; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.components import components
from . import blocks as B
from .shared import cut_lineage, finish_phase, packed
from .words import SPACES, Chunk, release, utf8_buffer, window_hashes

N = 5
PERCENT = 75
TILE_BYTES = 8 << 20
SET_BYTES = 2 << 10
BITS = 1024
NO_ID = -(1 << 63)  # stands for a null id inside
SETS = "doc_id long, n_shingles long, set_key binary, shingles binary, prefix binary"


class Block:
    """A block of documents: (row, shingle) pairs, distinct, sorted by row and shingle."""

    def __init__(self, data: bytes, n: int):
        table = B.unpack(data)
        self.ids = table.column("doc_id").to_pylist()
        chunk = Chunk(*utf8_buffer(table.column("text")), SPACES, True)
        words = chunk.word_hashes()
        starts = chunk.window_starts(n)
        short = np.flatnonzero((chunk.n_words > 0) & (chunk.n_words < n))
        values = np.concatenate([window_hashes(words, starts, n),
                                 window_hashes(words, chunk.row_first[short], chunk.n_words[short])])
        rows = np.concatenate([chunk.row_of_word()[starts], short])
        order = np.lexsort((values, rows))
        values, rows = values[order], rows[order]
        new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])])[:len(rows)]
        self.values, rows = values[new], rows[new]
        self.first = np.searchsorted(rows, np.arange(chunk.n_rows + 1))

    def sent(self, n_buckets: int):
        """Distinct keys of the block, number of documents of each, and per value its key's place."""
        keys, inverse, counts = np.unique(B.keyed(self.values, n_buckets), return_inverse=True, return_counts=True)
        return keys, counts, inverse


def _document_class(total: np.ndarray, known: np.ndarray, anchors: np.ndarray) -> bytes:
    """Answer: 0 for values of one document, else 1 + the binary logarithm of the count."""
    return B.squeeze(np.where(total > 1, 1 + np.log2(np.maximum(total, 1)).astype(np.int64), 0).astype(np.uint8).tobytes())


def prefix_size(n: int, percent: int) -> int:
    """Any set that links with one of n shingles shares one of its first `prefix_size`."""
    least = -(-percent * n // 100)
    return n - least + 1


def prepared_sets(docs: DataFrame, doc_id: str, text: str, n: int, percent: int) -> DataFrame:
    """SETS, one row per document. set_key is null for sets that link with nothing; shingles
    (shared ones, sorted) and prefix stand in the first row of an equal set in a block."""
    n_buckets = B.buckets(docs, text)
    packed = B.pack(docs, doc_id, text)

    def send(batches):
        for batch in batches:
            for number, data in zip(batch.column("block").to_pylist(), batch.column("rows").to_pylist()):
                keys, counts, _ = Block(data, n).sent(n_buckets)
                yield B.send(number, keys, counts, np.zeros(len(keys), bool))
                del keys, counts
                release()

    classes = finish_phase(B.tally(packed.mapInArrow(send, B.SENT), _document_class))

    def settle(rows: pa.Table, answers: pa.Table) -> pa.Table:
        told = dict(zip(answers.column("bucket").to_pylist(), answers.column("answer").to_pylist()))
        out = []
        for data in rows.column("rows").to_pylist():
            block = Block(data, n)
            keys, _, inverse = block.sent(n_buckets)
            known = np.zeros(len(keys), np.uint8)
            for bucket, first, end in zip(*B.spans(keys)):
                known[first:end] = np.frombuffer(B.expand(told[int(bucket)], int(end - first)), np.uint8)
            known = known[inverse]
            seen = set()
            for r, i in enumerate(block.ids):
                f, e = int(block.first[r]), int(block.first[r + 1])
                size = e - f
                shared = np.flatnonzero(known[f:e]) + f
                if not size or 100 * len(shared) < percent * size:
                    out.append((i, size, None, None, None))
                    continue
                key = hashlib.blake2b(block.values[f:e].tobytes(), digest_size=16).digest()
                if key in seen:
                    out.append((i, size, key, None, None))
                    continue
                seen.add(key)
                values = block.values[shared]
                rare = np.lexsort((values, known[shared]))[:prefix_size(size, percent) - (size - len(shared))]
                out.append((i, size, key, values.tobytes(), values[rare].tobytes()))
        release()
        columns = list(zip(*out)) if out else [[]] * 5
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)],
                        ["doc_id", "n_shingles", "set_key", "shingles", "prefix"])

    return packed.groupBy("block").cogroup(classes.groupBy("block")).applyInArrow(settle, SETS)


def _prefix_rows(batches):
    for batch in batches:
        found = [np.frombuffer(p, np.int64) for p in batch.column("prefix").to_pylist()]
        if found:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.array(batch.column("rep").to_pylist(), np.int64), [len(p) for p in found])),
                pa.array(np.concatenate(found))], ["rep", "shingle"])


def signature(shingles: np.ndarray) -> np.ndarray:
    """Parity bitmap: bit b is set when an odd number of shingles hash to b."""
    odd = np.bincount((shingles % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(bool)).view(np.uint64)


def link_sets(reps, sizes, arrays, side, label, percent: int) -> list[tuple[int, int]]:
    """Links that join up the classes of these sets; `side` (0 or 1) of None compares all, else
    only sets of different sides. Sets of equal label count as joined from the start."""
    order = np.argsort(sizes, kind="stable")
    reps, sizes, label = reps[order], sizes[order], np.unique(label[order], return_inverse=True)[1]
    arrays = [arrays[i] for i in order]
    side = None if side is None else side[order]
    bitmaps = np.stack([signature(a) for a in arrays])
    links = []
    for x in range(len(reps) - 1):
        end = int(np.searchsorted(sizes, sizes[x] * 100 // percent, "right"))
        near = np.arange(x + 1, end)
        near = near[label[near] != label[x]]
        if side is not None:
            near = near[side[near] != side[x]]
        if not len(near):
            continue
        both = sizes[x] + sizes[near]
        apart = np.bitwise_count(bitmaps[near] ^ bitmaps[x]).sum(1, dtype=np.int64)
        # shared shingles are compared only; the rest of the sizes is apart for certain
        shared = len(arrays[x]) + np.array([len(arrays[y]) for y in near])
        bound = (shared - apart) // 2
        for y in near[(100 + percent) * bound >= percent * both]:
            if label[y] == label[x]:
                continue
            common = len(np.intersect1d(arrays[x], arrays[y], assume_unique=True))
            if (100 + percent) * common >= percent * (sizes[x] + sizes[y]):
                links.append((int(reps[x]), int(reps[y])))
                label[label == label[y]] = label[x]
    return links


def _linker(percent: int, sided: bool):
    def run(table: pa.Table) -> pa.Table:
        links = []
        if table.num_rows > 1:
            links = link_sets(
                np.array(table.column("rep").to_pylist(), np.int64), np.array(table.column("n").to_pylist(), np.int64),
                [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()],
                np.array(table.column("side").to_pylist()) if sided else None,
                np.array(table.column("label").to_pylist(), np.int64), percent)
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _classes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """rep, label for all nodes, from links a-b."""
    spread = links.select(F.col("a").alias("node"), F.col("a").alias("key")).unionByName(
        links.select(F.col("b").alias("node"), F.col("a").alias("key")))
    found = components(spread).withColumnRenamed("node", "rep")
    return nodes.select("rep").join(found, "rep", "left").select("rep", F.coalesce("component", "rep").alias("label"))


def tiles(sets: DataFrame, tile_bytes: int, percent: int) -> DataFrame:
    """Tiles of `sets` (grp, rep, n, bytes): band and part; a group that fits is one tile."""
    band = F.floor(F.ln(F.col("n").cast("double")) / math.log(100 / percent)).cast("long")
    sets = sets.withColumn("_band", band)
    # a small set counts as SET_BYTES, so a tile is bounded in sets as well
    size = F.sum(F.greatest(F.col("bytes").cast("long"), F.lit(SET_BYTES))).alias("s")
    cells = sets.groupBy("grp", "_band").agg(size)
    whole = cells.groupBy("grp").agg(F.sum("s").alias("all"))
    cells = cells.join(whole, "grp").withColumn("parts", F.ceil(F.col("s") / tile_bytes))
    return sets.join(cells, ["grp", "_band"]).withColumn("split", F.col("all") > tile_bytes).withColumn(
        "band", F.when(F.col("split"), F.col("_band")).otherwise(-1)).withColumn(
        "part", F.when(F.col("split"), F.pmod(F.xxhash64("rep"), F.col("parts"))).otherwise(0)).select(
        "grp", "band", "part", "split", "rep")


def _across(tiled: DataFrame, sets: DataFrame, labels: DataFrame, first_only: bool, percent: int) -> DataFrame:
    """Links between tiles of the split groups: pairs of tiles in bands that can meet and that are
    not one class already; `first_only`: with the first tile of a band only."""
    t = tiled.join(labels, "rep")
    known = t.groupBy("grp", "band", "part").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    left, right = known.select(*[F.col(c).alias(f"l_{c}") for c in known.columns]), known
    pairs = left.join(right, F.col("l_grp") == F.col("grp")).filter(
        ((F.col("l_band") == F.col("band")) & (F.col("l_part") < F.col("part")) | (F.col("l_band") + 1 == F.col("band")))
        & ~((F.col("l_low") == F.col("l_high")) & (F.col("low") == F.col("high")) & (F.col("l_low") == F.col("low"))))
    if first_only:
        pairs = pairs.filter((F.col("l_part") == 0) | (F.col("part") == 0))
    pairs = pairs.select(F.struct("grp", "l_band", "l_part", "band", "part").alias("pair"), F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("l_band").alias("band"), F.col("l_part").alias("part")),
        F.struct(F.lit(1).alias("side"), "band", "part"))).alias("t"), "grp").select("pair", "grp", "t.*")
    rows = t.join(pairs, ["grp", "band", "part"]).select("pair", "side", "rep", "label").join(sets, "rep")
    return rows.groupBy("pair").applyInArrow(_linker(percent, True), "a long, b long")


def similar_sets(sets: DataFrame, percent: int, tile_bytes: int) -> DataFrame:
    """rep, label of distinct sets (rep, n, shingles, prefix)."""
    touch = sets.select("rep", "prefix").mapInArrow(_prefix_rows, "rep long, shingle long")
    hubs = touch.groupBy("shingle").agg(F.min("rep").alias("hub"), F.count("*").alias("c")).filter("c > 1")
    hung = cut_lineage(touch.join(hubs, "shingle").select(F.col("rep").alias("node"), F.col("hub").alias("key")).distinct())
    groups = components(hung).select(F.col("node").alias("rep"), F.col("component").alias("grp"))
    # tiles are dealt out by sizes alone; shingles join them when a tile is compared
    dealt = finish_phase(tiles(sets.select("rep", "n", F.octet_length("shingles").alias("bytes")).join(
        groups, "rep"), tile_bytes, percent))
    rows = sets.select("rep", "n", "shingles")
    links = finish_phase(rows.join(dealt, "rep").withColumn("label", F.col("rep")).groupBy(
        "grp", "band", "part").applyInArrow(_linker(percent, False), "a long, b long"))
    split = dealt.filter("split")
    if not split.isEmpty():
        for first_only in (True, False):
            more = _across(split, rows, _classes(split, links), first_only, percent)
            links = finish_phase(links.unionByName(more))
    return _classes(sets, links)


def ngram_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N,
                  percent: int = PERCENT, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per row of `docs`."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text).alias("text"))
    found = finish_phase(prepared_sets(rows, "doc_id", "text", n, percent))
    alone = found.filter(F.col("set_key").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    near = found.filter(F.col("set_key").isNotNull())
    sets = finish_phase(near.groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"),
        F.first("shingles", ignorenulls=True).alias("shingles"), F.first("prefix", ignorenulls=True).alias("prefix")))
    label = sets.select("set_key", "rep").join(similar_sets(sets, percent, tile_bytes), "rep").select("set_key", "label")
    out = alone.unionByName(near.select("doc_id", "n_shingles", "set_key").join(label, "set_key").select(
        "doc_id", "n_shingles", F.col("label").alias("component_id")))
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_shingles",
                      F.nullif("component_id", F.lit(NO_ID)).alias("component_id"))


def count_links(reps, sizes, copies, arrays, side, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(reps, copies of the other sets that each links with), all pairs decided; `side` as in
    `link_sets`."""
    order = np.argsort(sizes, kind="stable")
    reps, sizes, copies = reps[order], sizes[order], copies[order]
    arrays = [arrays[i] for i in order]
    side = None if side is None else side[order]
    bitmaps = np.stack([signature(a) for a in arrays])
    held = np.array([len(a) for a in arrays])
    out = np.zeros(len(reps), np.int64)
    for x in range(len(reps) - 1):
        near = np.arange(x + 1, int(np.searchsorted(sizes, sizes[x] * 100 // percent, "right")))
        if side is not None:
            near = near[side[near] != side[x]]
        apart = np.bitwise_count(bitmaps[near] ^ bitmaps[x]).sum(1, dtype=np.int64)
        bound = (held[x] + held[near] - apart) // 2
        for y in near[(100 + percent) * bound >= percent * (sizes[x] + sizes[near])]:
            common = len(np.intersect1d(arrays[x], arrays[y], assume_unique=True))
            if (100 + percent) * common >= percent * (sizes[x] + sizes[y]):
                out[x] += copies[y]
                out[y] += copies[x]
    return reps, out


def _counter(percent: int, sided: bool):
    def run(table: pa.Table) -> pa.Table:
        reps, found = count_links(
            *[np.array(table.column(c).to_pylist(), np.int64) for c in ("rep", "n", "copies")],
            [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()],
            np.array(table.column("side").to_pylist()) if sided else None, percent)
        return pa.table({"rep": pa.array(reps, pa.int64()), "links": pa.array(found, pa.int64())})

    return run


def ngram_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N,
                percent: int = PERCENT, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """doc_id, n_links, one row per row of `docs`: with how many other rows it links. All pairs in
    tiles and pairs of tiles are decided, so a tile of m near copies costs m * m / 2 intersections."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text).alias("text"))
    found = finish_phase(prepared_sets(rows, "doc_id", "text", n, percent))
    near = found.filter(F.col("set_key").isNotNull())
    # rows of one id can have several sets, so a set goes by a number of its own
    sets = finish_phase(near.groupBy("set_key").agg(
        F.count("*").alias("copies"), F.first("n_shingles").alias("n"),
        F.first("shingles", ignorenulls=True).alias("shingles"), F.first("prefix", ignorenulls=True).alias("prefix"),
    ).withColumn("rep", F.monotonically_increasing_id()))
    touch = sets.select("rep", "prefix").mapInArrow(_prefix_rows, "rep long, shingle long")
    hubs = touch.groupBy("shingle").agg(F.min("rep").alias("hub"), F.count("*").alias("c")).filter("c > 1")
    hung = cut_lineage(touch.join(hubs, "shingle").select(F.col("rep").alias("node"), F.col("hub").alias("key")).distinct())
    groups = components(hung).select(F.col("node").alias("rep"), F.col("component").alias("grp"))
    dealt = finish_phase(tiles(sets.select("rep", "n", F.octet_length("shingles").alias("bytes")).join(
        groups, "rep"), tile_bytes, percent))
    held = sets.select("rep", "n", "copies", "shingles")
    within = held.join(dealt, "rep").groupBy("grp", "band", "part").applyInArrow(
        _counter(percent, False), "rep long, links long")
    cells = dealt.filter("split").select("grp", "band", "part").distinct()
    left = cells.select(*[F.col(c).alias(f"l_{c}") for c in cells.columns])
    pairs = left.join(cells, F.col("l_grp") == F.col("grp")).filter(
        (F.col("l_band") == F.col("band")) & (F.col("l_part") < F.col("part")) | (F.col("l_band") + 1 == F.col("band")))
    pairs = pairs.select("grp", F.struct("grp", "l_band", "l_part", "band", "part").alias("pair"), F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("l_band").alias("band"), F.col("l_part").alias("part")),
        F.struct(F.lit(1).alias("side"), "band", "part"))).alias("t")).select("pair", "grp", "t.*")
    across = dealt.join(pairs, ["grp", "band", "part"]).select("pair", "side", "rep").join(held, "rep").groupBy(
        "pair").applyInArrow(_counter(percent, True), "rep long, links long")
    links = within.unionByName(across).groupBy("rep").agg(F.sum("links").alias("links"))
    of_set = sets.select("set_key", "rep", "copies").join(links, "rep", "left").select(
        "set_key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return found.select("doc_id", "set_key").join(of_set, "set_key", "left").select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def ngram_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of `docs` that stay: one of each class, that with the smallest id."""
    stay = ngram_classes(docs, doc_id, text, **how).filter("doc_id <=> component_id").select(
        F.col("doc_id").alias("stay")).distinct()
    given = docs.select(packed(docs).alias("given"), F.col(doc_id).cast("long").alias("id"))
    return given.join(stay, F.col("id").eqNullSafe(F.col("stay")), "left_semi").select("given.*")
