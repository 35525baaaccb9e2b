"""Pair-counting quality of a clustering, from contingency counts instead of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _pairs(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("long")


def contingency(expected: DataFrame, assigned: DataFrame) -> DataFrame:
    """(event, story_id, n) with story_id NULL for unassigned articles."""
    joined = expected.select("article_id", "expected_event").join(
        assigned.select("article_id", "story_id"), "article_id", "left")
    return joined.groupBy("expected_event", "story_id").agg(F.count("*").alias("n"))


def stray_assignments(expected: DataFrame, assigned: DataFrame) -> DataFrame:
    """Assigned articles without an expected event (an error for the scores)."""
    return assigned.select("article_id").join(expected, "article_id", "left_anti")


def _ratio(a: Column, b: Column, empty: float) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def pairwise_quality(expected: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row: precision, recall, false merges and splits over pairs of articles."""
    cells = contingency(expected, assigned)
    placed = F.col("story_id").isNotNull()
    events = cells.groupBy("expected_event").agg(
        F.sum("n").alias("n"), F.sum(F.when(placed, F.col("n")).otherwise(0)).alias("m"))
    per_event = events.agg(F.sum(_pairs(F.col("n"))).alias("expected_pairs"),
                           F.sum(_pairs(F.col("m"))).alias("placed_pairs"))
    per_story = cells.filter(placed).groupBy("story_id").agg(F.sum("n").alias("n")).agg(
        F.sum(_pairs(F.col("n"))).alias("predicted_pairs"))
    per_cell = cells.agg(
        F.sum(F.when(placed, _pairs(F.col("n"))).otherwise(0)).alias("true_pairs"),
        F.sum(F.when(placed, 0).otherwise(F.col("n"))).alias("unassigned"))
    # three one-row aggregates
    one = per_event.withColumn("k", F.lit(1)).join(per_story.withColumn("k", F.lit(1)), "k").join(
        per_cell.withColumn("k", F.lit(1)), "k").fillna(0)
    e, p, t = F.col("expected_pairs"), F.col("predicted_pairs"), F.col("true_pairs")
    merges, splits = p - t, F.col("placed_pairs") - t
    return one.select(
        _ratio(t, p, 1.0).alias("precision"), _ratio(t, e, 1.0).alias("recall"),
        e.alias("expected_pair_count"), p.alias("predicted_pair_count"), t.alias("true_pair_count"),
        merges.alias("false_merge_count"), _ratio(merges, p, 0.0).alias("false_merge_rate"),
        splits.alias("false_split_count"), _ratio(splits, e, 0.0).alias("false_split_rate"),
        F.col("unassigned").alias("unassigned_count"))


def false_merges(expected: DataFrame, assigned: DataFrame) -> DataFrame:
    """(story_id, first_event, second_event, pair_count) of events merged in one story.

    Event pairs of a story are the result itself; they come from counts, not from articles."""
    cells = contingency(expected, assigned).filter("story_id IS NOT NULL")
    a = cells.select("story_id", F.col("expected_event").alias("first_event"), F.col("n").alias("na"))
    b = cells.select("story_id", F.col("expected_event").alias("second_event"), F.col("n").alias("nb"))
    return a.join(b, "story_id").filter("first_event < second_event").select(
        "story_id", "first_event", "second_event", (F.col("na") * F.col("nb")).alias("pair_count"))


def false_splits(expected: DataFrame, assigned: DataFrame) -> DataFrame:
    """(event, story_count, pair_count) of events spread over several stories."""
    cells = contingency(expected, assigned).filter("story_id IS NOT NULL")
    n = cells.groupBy("expected_event").agg(
        F.count("*").alias("story_count"), F.sum("n").alias("total"), F.sum(_pairs(F.col("n"))).alias("within"))
    return n.filter("story_count > 1").select(
        "expected_event", "story_count", (_pairs(F.col("total")) - F.col("within")).alias("pair_count"))
