"""Small helpers of the operators: settings, input checks."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage, set_checkpoint_folder

__all__ = ["columns", "cut_lineage", "finish_phase", "free_name", "packed", "partitions", "read", "set_checkpoint_folder", "text_bytes"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores after it as long as `df` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns(df: DataFrame) -> list[Column]:
    """The columns of `df`, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def packed(df: DataFrame) -> Column:
    """All columns of `df` in one struct, so that no name of theirs can meet another one."""
    return F.struct(*columns(df))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def finish_phase(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and let Spark remove the shuffle and checkpoint files of
    the phase behind it now. Its cleaner goes by the driver's garbage collections, which a driver
    that plans much and holds little may not have for a long time."""
    done = cut_lineage(df)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return done
