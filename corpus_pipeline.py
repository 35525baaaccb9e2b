"""The corpus pipeline: five of the training-data operators, one after the other.

Each stage takes what its predecessor kept, from Parquet, and decides on all of it. Stages but the
last return the columns of `documents`; the mix adds mix_copy, mix_shard and mix_position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventweave.llm import content_sort, mixing, ngram_join, ppm, suffix_arrays
from eventweave.llm.shared import columns
from eventweave.session import scratch_folder

MIN_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: not `und`, and the best language holds at least half of
    the posterior. Texts of less than `ppm.EVIDENCE` bytes are too short for that and stay if not `und`."""
    teach = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(0)) != 2
    judged = ppm.identify(docs, ppm.fit(docs, teach))
    lang, score = (F.col(name) for name in judged.columns[-2:])  # their names depend on those of docs
    told = (score >= MIN_SCORE) | (F.octet_length("text") < ppm.EVIDENCE)
    return judged.filter((lang != "und") & told).select(*columns(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return content_sort.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five-word shingles, 75 %) the one with the smallest id."""
    return ngram_join.ngram_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of the benchmark."""
    return suffix_arrays.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights, dealt to shards."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: The mix draws by hash and language ID is a trained model: SQL cannot state them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    folder = scratch_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
