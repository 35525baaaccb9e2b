"""Exact dedup by sorting contents.

Rows are range-partitioned by sampled splitters over (first characters, content hash, id) and
sorted inside each partition by (first characters, content hash, text, id), which places equal
texts next to each other; neighbours are compared in full. The id is the last part of the
splitter, so a group of copies that holds a third of all rows spreads over many partitions. Only
the first and the last run of a partition can go on in another one: those runs are summed up per
content and joined back, at most two rows per range partition.

Defined cases: null text counts as empty, the empty text is a content like any other, rows with
equal text and equal id form one group and all but one of them are dropped, a null id sorts below
every id and such a row stays only if its group has nothing else, an empty table gives no rows,
other columns are never touched (their names may clash with the result's).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import cut_lineage, finish_phase, packed, partitions

SCHEMA = ("row long, doc_id long, text_sha256 string, run_best long, run_size long, run_rank long, "
          "border boolean")
PREFIX = 64  # characters in a splitter: keeps the sampled splitters small, whatever the texts


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of a sorted partition with equal texts become runs.

    Kept in memory: the text of the open run and the ids of its rows."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId() << 40
    text, ids, out, first, n = None, [], [], True, 0

    def close(border: bool) -> None:
        nonlocal n
        if not ids:
            return
        digest = hashlib.sha256(text).hexdigest()
        known = [i for i in ids if i is not None]
        best = max(known) if known else None
        for rank, i in enumerate(ids):  # ids come largest first, so rank 0 is the best
            out.append((part + n, i, digest, best, len(ids), rank, border))
            n += 1
        ids.clear()

    def table() -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [[]] * 7
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        done = pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, types)],
            ["row", "doc_id", "text_sha256", "run_best", "run_size", "run_rank", "border"])
        out.clear()
        return done

    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist()):
            if t != text:
                if text is not None:
                    close(first)
                    first = False
                text = t
            ids.append(i)
        if len(out) >= 10_000:
            yield table()
    close(True)
    yield table()


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 normalise: Callable[[Column], Column] | None = None,
                 n_partitions: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, one row per row of `docs`.

    `normalise` maps the text column before the comparison (default: unchanged)."""
    n = n_partitions or partitions(docs.sparkSession)
    content = F.coalesce(F.col(text), F.lit(""))
    if normalise is not None:
        content = normalise(content)
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), content.alias("content"))
    keyed = keyed.select(
        "doc_id", F.col("content").cast("binary").alias("content"),
        F.substring("content", 1, PREFIX).alias("head"), F.xxhash64("content").alias("hash"))
    order = [F.col("head"), F.col("hash"), F.col("content"), F.col("doc_id").desc_nulls_last()]
    dealt = keyed.repartitionByRange(n, "head", "hash", F.col("doc_id").desc_nulls_last())
    runs = finish_phase(dealt.sortWithinPartitions(*order).select("doc_id", "content")
                       .mapInArrow(_runs, SCHEMA))
    # Runs at the ends of partitions: at most two contents per partition, so the side is bounded.
    ends = (runs.filter("border").groupBy(F.col("text_sha256").alias("end_sha")).agg(
        F.max("doc_id").alias("end_best"), F.count("*").alias("end_size"),
        F.min(F.when(F.col("run_rank") == 0, F.struct(F.col("run_best").isNull().alias("no"),
                                                     (-F.col("run_best")).alias("best"),
                                                     "row"))).alias("end_first")))
    joined = runs.join(F.broadcast(ends), F.col("border") & (F.col("text_sha256") == F.col("end_sha")),
                       "left")
    best = F.when(F.col("border"), F.col("end_best")).otherwise(F.col("run_best"))
    size = F.when(F.col("border"), F.col("end_size")).otherwise(F.col("run_size"))
    kept = F.when(F.col("border"), F.col("row") == F.col("end_first.row")).otherwise(
        F.col("run_rank") == 0)
    return joined.select("doc_id", best.alias("keep_id"), size.alias("group_size"),
                         kept.alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                normalise: Callable[[Column], Column] | None = None,
                n_partitions: int | None = None) -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    Rows are dropped by an anti join on (id, content). Where a row that stays has a twin of the
    same id and content, nothing tells the two apart and one of them is taken."""
    groups = exact_groups(docs, doc_id, text, normalise, n_partitions)
    content = F.coalesce(F.col(text), F.lit(""))
    tagged = docs.select(packed(docs).alias("given"), F.col(doc_id).cast("long").alias("id"),
                         F.sha2(content if normalise is None else normalise(content), 256).alias("sha"))

    def side(df: DataFrame) -> DataFrame:
        return df.select(F.col("doc_id").alias("at"), F.col("text_sha256").alias("sha_of")).distinct()

    same = F.col("id").eqNullSafe(F.col("at")) & (F.col("sha") == F.col("sha_of"))
    gone = side(groups.filter(~F.col("kept")))
    stay = tagged.join(gone, same, "left_anti").select("given.*")
    twins = cut_lineage(side(groups.filter("kept")).intersect(gone))
    if twins.isEmpty():
        return stay
    again = tagged.join(twins, same, "left_semi").dropDuplicates(["id", "sha"])
    return stay.unionByName(again.select("given.*"))
