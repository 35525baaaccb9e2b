"""Ordered operators that do not put a hot key into one task.

A ranked window is fine when only its first rows are kept (Spark prunes before the
shuffle). Running values over whole keys are not: a key with a third of all rows
would be sorted by one task. These helpers cut each key into blocks, work inside
the blocks, and carry a one-row summary per block over to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    ).select(*keys, "_r.*")


def _with_block(df: DataFrame, keys: list[str], order: list[str], block: Column | None) -> DataFrame:
    """Rows with `_block`: the given one, or the partitions of a range sort by (keys, order), written
    once, so that blocks are even however the rows of a key lie, also at one instant."""
    if block is not None:
        return df.withColumn("_block", block)
    return cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_block", F.spark_partition_id()))


def running_number(df: DataFrame, keys: list[str], order: list[str], block: Column | None,
                   name: str) -> DataFrame:
    """1-based row number per key; `block` must not decrease along `order`, None for range blocks."""
    df = _with_block(df, keys, order, block)
    inner = Window.partitionBy(*keys, "_block").orderBy(*order)
    sizes = df.groupBy(*keys, "_block").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    ranked = df.withColumn("_row", F.row_number().over(inner))
    return (
        ranked.join(offsets, [*keys, "_block"])
        .withColumn(name, F.col("_before") + F.col("_row"))
        .drop("_block", "_row", "_before", "_size")
    )


def running_lag(df: DataFrame, keys: list[str], order: list[str], block: Column | None,
                values: list[str], name: str) -> DataFrame:
    """struct(values) of the row before, per key (NULL for the first); blocks as in `running_number`."""
    df = _with_block(df, keys, order, block)
    inner = Window.partitionBy(*keys, "_block").orderBy(*order)
    value = F.struct(*values)
    tails = df.groupBy(*keys, "_block").agg(F.max_by(value, F.struct(*order)).alias("_t"))
    carried = tails.select(
        *keys, "_block", F.lag("_t").over(Window.partitionBy(*keys).orderBy("_block")).alias("_carried"))
    return (
        df.withColumn("_within", F.lag(value).over(inner))
        .join(carried, [*keys, "_block"])
        .withColumn(name, F.coalesce("_within", "_carried"))
        .drop("_block", "_within", "_carried")
    )


def top_rows(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """The first n rows per key; Spark keeps n per key and task before shuffling."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
