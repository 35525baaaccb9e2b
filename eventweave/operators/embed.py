"""Article and story vectors."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from math import isfinite

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from .. import policy
from ..functions.text import embedding_input, let

# Provider name -> (model key, dimension, factory of a texts -> vectors callable or None for
# the built-in hash embedding). Users add their own with `register_provider`.
_PROVIDERS: dict[str, tuple[str, int, str | Callable | None]] = {
    "hash": (policy.HASH_MODEL_KEY, policy.HASH_DIMENSION, None),
}


def register_provider(name: str, model_key: str, dimension: int, factory: str | Callable) -> None:
    """`factory()` is called once per Python worker (a callable, or 'module:function')."""
    if not 1 <= dimension <= policy.MAX_DIMENSION:
        raise ValueError("dimension out of range")
    _PROVIDERS[name] = (model_key, dimension, factory)


def provider_identity(name: str) -> tuple[str, int]:
    return _PROVIDERS[name][:2]


def _load(factory):
    if isinstance(factory, str):
        module, _, attr = factory.partition(":")
        factory = getattr(importlib.import_module(module), attr)
    return factory()


def provider_udf(factory, dimension: int, batch: int = policy.EMBEDDING_BATCH):
    """Arrow UDF text -> vector; the model is loaded once per task, texts go in batches."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _load(factory)
        for texts in batches:
            vectors = []
            for i in range(0, len(texts), batch):
                vectors.extend(model(texts.iloc[i:i + batch].tolist()))
            if len(vectors) != len(texts):
                raise ValueError("provider returned another number of vectors than texts")
            vectors = [list(map(float, v)) for v in vectors]
            if any(len(v) != dimension or not all(map(isfinite, v)) for v in vectors):
                raise ValueError("provider returned a vector of another length or one that is not finite")
            yield pd.Series(vectors, index=texts.index, dtype=object)

    return embed


def hash_embedding(text: Column, dimension: int = policy.HASH_DIMENSION) -> Column:
    """Deterministic signed bag of words, unit length, without a shuffle.

    Every word adds +1 or -1 to one bucket by its SHA-256; a text without words, or whose
    words cancel out, is hashed whole.
    """
    place = lambda digest: F.struct(
        F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(dimension))
        .cast("int").alias("b"),
        F.when(F.substring(digest, 10, 1).isin(*"13579bdf"), 1.0).otherwise(-1.0).alias("s"),
    )
    hashed = lambda xs: F.transform(F.transform(xs, lambda x: F.sha2(x, 256)), place)
    spread = lambda places: F.transform(
        F.sequence(F.lit(0), F.lit(dimension - 1)),
        lambda i: F.coalesce(F.element_at(places, i), F.lit(0.0)),
    )
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_]+"), 0)
    tokens = F.when(F.size(tokens) == 0, F.array(text)).otherwise(tokens)
    # sum the signs of each bucket in one fold over the sorted placements
    placed = F.array_sort(hashed(tokens))
    start = F.struct(F.lit(-1).alias("b"), F.lit(0.0).alias("s"),
                     F.array().cast("array<struct<b:int,s:double>>").alias("done"))
    folded = F.aggregate(
        placed, start,
        lambda acc, x: F.when(
            acc["b"] == x["b"],
            F.struct(acc["b"].alias("b"), (acc["s"] + x["s"]).alias("s"), acc["done"].alias("done")),
        ).otherwise(F.struct(
            x["b"].alias("b"), x["s"].alias("s"),
            F.concat(acc["done"], F.array(F.struct(acc["b"].alias("b"), acc["s"].alias("s"))))
            .alias("done"),
        )),
        lambda acc: F.concat(
            acc["done"], F.array(F.struct(acc["b"].alias("b"), acc["s"].alias("s")))),
    )
    counts = let(F.map_from_entries(F.filter(folded, lambda x: x["b"] >= 0)), spread)
    norm2 = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    whole = spread(F.map_from_entries(hashed(F.array(text))))
    directed = let(counts, lambda c: F.when(norm2(c) == 0.0, whole).otherwise(c))
    return let(directed, lambda c: let(
        F.sqrt(norm2(c)), lambda n: F.transform(c, lambda x: x / n)))


def embed_articles(articles: DataFrame, existing: DataFrame, provider: str = "hash", *,
                   max_chars: int | None = None) -> DataFrame:
    """New article_embedding rows for the articles without one under the provider's model."""
    model_key, dimension, factory = _PROVIDERS[provider]
    missing = articles.join(
        existing.filter(F.col("model_key") == model_key).select("article_id"),
        "article_id", "left_anti")
    text = embedding_input("title", "description", "body_text", max_chars)
    prepared = missing.select("article_id", text.alias("_t"))
    vector = hash_embedding(F.col("_t"), dimension) if factory is None else provider_udf(factory, dimension)("_t")
    rows = prepared.select(
        "article_id", F.lit(model_key).alias("model_key"),
        vector.alias("vector"), F.length("_t").alias("input_chars"))
    return rows.select("article_id", "model_key", F.size("vector").alias("dimension"),
                       F.col("vector").cast("array<float>").alias("vector"), "input_chars")


def finite(vector: Column) -> Column:
    return F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def vector_validity(embeddings: DataFrame) -> DataFrame:
    """Rows with a problem: wrong_length, not_finite, or a dimension other than the model's."""
    usual = embeddings.groupBy("model_key").agg(
        F.min("dimension").alias("_lo"), F.max("dimension").alias("_hi"))
    v = F.col("vector")
    return (
        embeddings.join(usual, "model_key")
        .withColumn("problem",
                    F.when(F.size(v) != F.col("dimension"), "wrong_length")
                    .when(~finite(v), "not_finite")
                    .when(F.col("_lo") != F.col("_hi"), "mixed_dimension"))
        .filter("problem IS NOT NULL").drop("_lo", "_hi")
    )


def story_vector(membership: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Unit-length mean of the members' vectors per (story, model).

    The sum is a partial aggregate over dense vectors, so a story with very many members is
    combined before the shuffle. Mixed dimensions fail; a sum without direction gives NULL.
    """
    summed = (
        membership.select("story_id", "article_id").join(embeddings, "article_id")
        .groupBy("story_id", "model_key")
        .agg(Summarizer.sum(array_to_vector("vector")).alias("_s"),
             F.count("*").alias("member_count"))
        .withColumn("_v", vector_to_array("_s"))
        .withColumn("_n", F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x)))
    )
    usable = (F.col("_n") > 0) & (F.col("_n") < float("inf"))
    return summed.select(
        "story_id", "model_key", F.size("_v").alias("dimension"),
        F.when(usable, F.transform("_v", lambda x: x / F.col("_n"))).alias("vector"), "member_count")


def embed_stories(membership: DataFrame, embeddings: DataFrame, existing: DataFrame) -> DataFrame:
    """Vectors of (story, model) pairs that have none yet."""
    have = existing.select("story_id", "model_key")
    pairs = membership.join(embeddings.select("article_id", "model_key"), "article_id").select(
        "story_id", "model_key").distinct().join(have, ["story_id", "model_key"], "left_anti")
    members = membership.join(pairs.select("story_id").distinct(), "story_id", "left_semi")
    return story_vector(members, embeddings).join(pairs, ["story_id", "model_key"], "left_semi")


def withdraw_member(membership: DataFrame, embeddings: DataFrame, story_vectors: DataFrame,
                    touched: DataFrame) -> DataFrame:
    """Story vectors after members left `touched` stories (membership is already reduced).

    A touched vector is rebuilt from all remaining members, dropped if one of them has no
    embedding for its model, and left as it was when the story is empty.
    """
    touched = touched.select("story_id").distinct()
    members = membership.select("story_id", "article_id").join(touched, "story_id", "left_semi")
    sizes = members.groupBy("story_id").agg(F.count("*").alias("_members"))
    rebuilt = story_vector(members, embeddings).join(
        story_vectors.select("story_id", "model_key"), ["story_id", "model_key"], "left_semi")
    rebuilt = rebuilt.join(sizes, "story_id").filter("member_count = _members").drop("_members")
    kept = story_vectors.join(sizes.select("story_id"), "story_id", "left_anti")
    return kept.select(*rebuilt.columns).unionByName(rebuilt)


__all__ = ["embed_articles", "embed_stories", "hash_embedding",
           "provider_udf", "register_provider", "story_vector", "vector_validity",
           "withdraw_member"]
