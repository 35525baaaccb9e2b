"""Session settings the library expects, and how it cuts lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Settings a cluster deployment should carry; none of them names a machine.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a batch of texts is held several times over in a Python worker
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    # collect_list/max_by partial aggregates stay hash based for many keys
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
    # keep the map-side top-k pruning of ranked windows for every bound we use
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
}


def use_utc(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def bound_batches(spark: SparkSession) -> None:
    """Batches that go to Python end at 8 MB of data, unless another bound is set. Spark's own bounds, 10 000 rows or
    64 MB, let whole texts take some hundred MB in every worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = spark.conf.get(name)
    if bound.lower() in ("64mb", "67108864b", "67108864"):
        spark.conf.set(name, RECOMMENDED[name])


def _checkpoint_dir_set(spark: SparkSession) -> bool:
    return spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()


def set_checkpoint_folder(spark: SparkSession) -> None:
    """Use the cluster's `spark.checkpoint.dir`. Only in local mode, where neither that setting
    nor a folder exists, a temporary one serves."""
    if _checkpoint_dir_set(spark):
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        import tempfile

        folder = tempfile.mkdtemp(prefix="eventweave-ckpt-")
    spark.sparkContext.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` reliably in the checkpoint folder."""
    set_checkpoint_folder(df.sparkSession)
    return _bounded_estimate(df.checkpoint(eager=True))


def _bounded_estimate(df: DataFrame) -> DataFrame:
    """`df`, as rows of unknown size where the size that Spark estimates is past all bounds.

    Spark takes the product of both sides as the size of a join, and a checkpoint keeps the estimate of its
    plan. In a loop the digits of that number multiply from round to round, until single numbers fill the
    driver. Spark prints sizes from 2^71 bytes on with an exponent."""
    plan = df._jdf.queryExecution()
    if "E+" not in plan.optimizedPlan().stats().simpleString():
        return df
    session = df.sparkSession
    return DataFrame(session._jsparkSession.internalCreateDataFrame(plan.toRdd(), df._jdf.schema(), False), session)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name beside the checkpoints, for the tables of one run."""
    import uuid

    set_checkpoint_folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/run-{uuid.uuid4().hex}"
