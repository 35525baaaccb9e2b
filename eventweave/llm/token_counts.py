"""Token counts from an exact length histogram.

Documents are encoded with a public byte-level vocabulary (its file is a parameter) and at once
reduced to (length, number of documents), combined before the shuffle: what moves is one row per
distinct length and task. Running sums over the lengths, taken in blocks of lengths, then answer
every context limit: documents and tokens up to it, documents beyond it, tokens kept when texts
are cut at it, and quantiles.

Defined cases: a null text counts as empty, an empty text has length 0, repeated rows count
each, special-token strings in a text are ordinary text, an empty table gives no rows, other
columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import cut_lineage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_VOCABULARY_BYTES = 64 << 20
BLOCK = 1024
PIECE = 1 << 16
_encodings: dict = {}


def _vocabulary(spark: SparkSession, path: str):
    """The vocabulary file as a broadcast; its size is checked."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def _encoding(data: bytes):
    key = hash(data)
    if key not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _encodings[key] = tiktoken.Encoding("lengths", pat_str=PATTERN, mergeable_ranks=ranks,
                                            special_tokens={})
    return _encodings[key]


_BREAK = re.compile(r"(?<=\S)(?=\s)")


def pieces(text: str) -> Iterator[str]:
    """Long texts in pieces. No token goes from a non-space on to a space, so cuts at such places
    leave the encoding as it is."""
    low = 0
    while len(text) - low > PIECE:
        found = _BREAK.search(text, low + PIECE)
        if found is None:
            break
        yield text[low:found.start()]
        low = found.start()
    yield text[low:]


def encoded_length(encoding, text: str) -> int:
    return sum(len(encoding.encode_ordinary(p)) for p in pieces(text))


def document_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of every row."""
    data = _vocabulary(docs.sparkSession, vocabulary)

    def run(batches):
        encoding = _encoding(data.value)
        for batch in batches:
            n = [encoded_length(encoding, t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())],
                                             ["doc_id", "n_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long")


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """n_tokens, n_docs; tasks hand on one row per distinct length of a batch."""
    data = _vocabulary(docs.sparkSession, vocabulary)

    def run(batches):
        encoding = _encoding(data.value)
        for batch in batches:
            n = np.array([encoded_length(encoding, t or "") for t in batch.column("text").to_pylist()], np.int64)
            length, count = np.unique(n, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(count.astype(np.int64))],
                                             ["n_tokens", "n_docs"])

    counts = docs.select(F.col(text).alias("text")).mapInArrow(run, "n_tokens long, n_docs long")
    return counts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def limit_table(histogram: DataFrame) -> DataFrame:
    """For each occurring length taken as context limit: n_docs and n_tokens up to it, docs_beyond,
    tokens_cut (tokens left when every text is cut at the limit), and share of documents up to it."""
    h = cut_lineage(histogram).select(F.col("n_tokens").alias("limit"), "n_docs", F.floor(F.col("n_tokens") / BLOCK).alias("b"),
                         (F.col("n_tokens") * F.col("n_docs")).alias("t"))
    inner = Window.partitionBy("b").orderBy("limit")
    # one row per block of lengths: as many as the longest text has thousands of tokens
    over = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = h.groupBy("b").agg(F.sum("n_docs").alias("bd"), F.sum("t").alias("bt"))
    before = blocks.select(
        "b", F.coalesce(F.sum("bd").over(over), F.lit(0)).alias("pd"),
        F.coalesce(F.sum("bt").over(over), F.lit(0)).alias("pt"), F.sum("bd").over(every).alias("total_docs"),
        F.sum("bt").over(every).alias("total_tokens"))
    run = h.withColumn("rd", F.sum("n_docs").over(inner)).withColumn("rt", F.sum("t").over(inner))
    docs, tokens = F.col("rd") + F.col("pd"), F.col("rt") + F.col("pt")
    return run.join(before, "b").select(
        "limit", "n_docs", docs.alias("docs_up_to"), tokens.alias("tokens_up_to"),
        (F.col("total_docs") - docs).alias("docs_beyond"),
        (tokens + F.col("limit") * (F.col("total_docs") - docs)).alias("tokens_cut"),
        (docs / F.col("total_docs")).alias("share"), "total_docs", "total_tokens")


def quantile(table: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least `share` of the documents do not exceed."""
    return table.filter(F.col("share") >= share).agg(F.min("limit").alias("limit"))


def tokens_at(table: DataFrame, limit: int) -> DataFrame:
    """tokens_cut and docs_beyond for any limit, from the nearest length below it."""
    below = table.filter(F.col("limit") <= limit).agg(
        F.max_by(F.struct("tokens_up_to", "docs_beyond"), "limit").alias("r"))
    total = table.agg(F.max("total_docs").alias("all"))
    beyond = F.coalesce(F.col("r.docs_beyond"), F.col("all"), F.lit(0))
    return below.join(total).select(
        (F.coalesce(F.col("r.tokens_up_to"), F.lit(0)) + beyond * limit).alias("tokens_cut"),
        beyond.alias("docs_beyond"))
