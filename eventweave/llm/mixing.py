"""Mixing sources to target weights by a splitting tree. Column expressions only.

1. Every source gets a target: its weight's share of all words, at most `max_epochs` times its own
   size, the excess reshared by weight until no source is above (solved in closed form over the
   sources sorted by size per weight).
2. Documents fall into blocks of about `block_words` words of their source, by hash. A source
   gives each block once per whole pass, and in the last, partial pass the first blocks of a
   permutation until its target is reached; the block on the edge gives the documents that fit.
3. A binary tree deals the drawn blocks out to `shards` output shards: at each node the left half
   gets an exact quota from every source, drawn from the multivariate hypergeometric distribution
   (source by source, each by inversion over twelve standard deviations). So shards hold equal
   numbers of blocks and each is an unbiased sample of the mix.
4. The blocks of a source, permuted, go to the shards by these quotas, disjointly, and each shard
   is ordered by a hash of (document, copy).

Sources are few against documents: one row per source goes through a global window and into one
array. Blocks are at most `max_blocks` plus one per source. Document rows only meet them in equi
joins, on (source, block), so a source that holds a third of all rows is spread over its blocks.
All randomness is a hash of `seed` and content, so reruns agree.

Defined cases: a null source is a source of its own, sorted last; null or empty texts have size 0
and take part in their blocks without weight; sources of size 0 have target 0; repeated rows are
drawn like any other row of their block, each on its own; an empty table gives no rows; other
columns pass through, internal names start with `_mx_`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import let
from .shared import cut_lineage, free_name, packed

CYCLE = (1, 2, 3)
MAX_EPOCHS = 3
BLOCK_WORDS = 50_000
MAX_BLOCKS = 100_000
SHARDS = 16
EDGE_WALKS = 4
WORD = r"[^\x20\x09-\x0D]+"


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def targets(docs: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """_mx_source, _mx_rank, _mx_source_size, _mx_target of rows with _mx_source and _mx_size."""
    s = docs.groupBy("_mx_source").agg(F.sum("_mx_size").cast("long").alias("_mx_source_size"))
    by_name = Window.orderBy(F.col("_mx_source").asc_nulls_last())
    s = s.withColumn("_mx_rank", F.row_number().over(by_name))
    cycle = F.array(*[F.lit(float(w)) for w in CYCLE])
    s = s.withColumn("_w", F.element_at(cycle, (F.col("_mx_rank") - 1) % len(CYCLE) + 1))
    s = s.withColumn("_cap", F.col("_mx_source_size") * float(max_epochs)).withColumn("_r", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_r", "_mx_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumn("_level", (F.sum("_mx_source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
                     / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    # the first source that does not reach its cap sets the level of all that follow
    s = s.withColumn("_free", F.min(F.when(F.col("_r") >= F.col("_level"), F.struct("_r", "_mx_rank", "_level"))).over(every))
    held = F.col("_free").isNull() | (F.struct("_r", "_mx_rank") < F.struct("_free._r", "_free._mx_rank"))
    return s.select("_mx_source", "_mx_rank", "_mx_source_size",
                    F.when(held, F.col("_cap")).otherwise(F.col("_w") * F.col("_free._level")).alias("_mx_target"))


def hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """Number of good ones among `draws` from `total` without replacement, by inversion of `u`.

    Weights are taken relative to the mode, so none over- or underflows; each pass is linear in the
    numbers considered, those within twelve standard deviations."""
    good, total, draws = (c.cast("double") for c in (good, total, draws))
    some = F.greatest(total, F.lit(1.0))
    mean = draws * good / some
    spread = F.sqrt(F.greatest(mean * (1 - good / some), F.lit(0.0))) * 12 + 12
    low = F.greatest(F.lit(0.0), draws - (total - good), F.floor(mean - spread).cast("double"))
    high = F.greatest(low, F.least(good, draws, F.ceil(mean + spread).cast("double")))
    mode = F.floor((draws + 1) * (good + 1) / (total + 2)).cast("double")
    range_ = F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"),
                      F.least(F.greatest(mode, low), high).cast("long").alias("mode"))

    def ratio(x: Column) -> Column:  # weight of x + 1 over weight of x
        x = x.cast("double")
        return F.coalesce(F.try_divide((good - x) * (draws - x), (x + 1) * (total - good - draws + x + 1)), F.lit(0.0))

    def pick(r: Column) -> Column:
        xs = F.sequence(r["low"], r["high"])
        # logarithm of weight(mode) / weight(low)
        rise = F.aggregate(xs, F.lit(0.0), lambda a, x: F.when(x < r["mode"], a + F.ln(ratio(x))).otherwise(a))

        def walk(first: Column) -> Column:
            every = F.aggregate(
                xs, F.struct(first.alias("w"), F.lit(0.0).alias("sum")),
                lambda a, x: F.struct((a["w"] * ratio(x)).alias("w"), (a["sum"] + a["w"]).alias("sum")),
                lambda a: a["sum"] * u)
            return let(every, lambda goal: F.aggregate(
                xs, F.struct(first.alias("w"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("n")),
                lambda a, x: F.when(a["sum"] > goal, a).otherwise(F.struct(
                    (a["w"] * ratio(x)).alias("w"), (a["sum"] + a["w"]).alias("sum"), (a["n"] + 1).alias("n"))),
                lambda a: r["low"] + a["n"]))

        return let(F.exp(-rise), walk)

    return let(range_, pick)


def split(counts: Column, draws: Column, key: Column, seed: int) -> Column:
    """One node: how many of `draws` each source gets, exactly `draws` in all."""
    start = F.struct(F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c).alias("total"),
                     draws.cast("long").alias("draws"), F.array().cast("array<long>").alias("out"))

    def step(acc: Column, item: Column) -> Column:
        x = hypergeometric(item["c"], acc["total"], acc["draws"], unit(F.lit(seed), key, item["i"])).cast("long")
        return F.struct((acc["total"] - item["c"]).alias("total"), (acc["draws"] - x).alias("draws"),
                        F.concat(acc["out"], F.array(x)).alias("out"))

    items = F.transform(counts, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.aggregate(items, start, step, lambda acc: acc["out"])


def shard_quotas(per_source: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """_mx_rank, _mx_ends: running block quotas of the source over the shards.

    `per_source` has _mx_rank (1, 2, ...) and _mx_draws."""
    levels = int(math.log2(shards))
    if 1 << levels != shards:
        raise ValueError("shards must be a power of two")
    nodes = per_source.agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_mx_rank", "_mx_draws"))), lambda s: s["_mx_draws"]).alias("counts")
    ).select(F.lit(1).alias("node"), "counts")
    for _ in range(levels):
        half = F.floor(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c) / 2)
        # the split is a value of its own before it is used twice
        nodes = cut_lineage(nodes.withColumn("left", split(F.col("counts"), half, F.col("node"), seed)))
        right = F.zip_with("counts", "left", lambda c, x: c - x)
        nodes = nodes.select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("counts")),
            F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("counts")))).alias("n")).select("n.*")
    quotas = nodes.select("node", F.posexplode("counts").alias("_i", "q"))
    w = Window.partitionBy("_i").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    return quotas.withColumn("end", F.sum("q").over(w)).groupBy((F.col("_i") + 1).alias("_mx_rank")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("node", "end"))), lambda s: s["end"]).alias("_mx_ends"))


def prepared(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """`docs` with _mx_source, _mx_size and _mx_hash."""
    return docs.withColumns({
        "_mx_source": F.col(source), "_mx_size": F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"),
        "_mx_hash": F.xxhash64(F.col(doc_id), F.col(text))})


def draw(rows: DataFrame, measured: DataFrame | None = None, shards: int = SHARDS, seed: int = 0,
         block_words: int = BLOCK_WORDS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """`rows` (as from `prepared`) with _mx_source_size, _mx_target and _mx_draws: array<struct<copy, shard>>.

    `measured`: the same rows without their other columns, if they are kept somewhere."""
    slim = cut_lineage(rows.select("_mx_source", "_mx_size", "_mx_hash")) if measured is None else measured
    per_source = targets(slim, max_epochs)
    total = F.sum("_mx_source_size").over(Window.partitionBy())
    size = F.greatest(F.lit(float(block_words)), total / MAX_BLOCKS)
    full = F.least(F.floor(F.try_divide(F.col("_mx_target"), F.col("_mx_source_size").cast("double"))), F.lit(max_epochs))
    per_source = per_source.withColumn("_mx_blocks", F.greatest(F.lit(1), F.ceil(F.col("_mx_source_size") / size)).cast("long"))
    per_source = per_source.withColumn("_mx_full", F.coalesce(full, F.lit(0)).cast("int")).withColumn(
        "_mx_rest", F.when(F.col("_mx_full") < max_epochs, F.col("_mx_target") - F.col("_mx_full") * F.col("_mx_source_size")).otherwise(0.0))
    per_source = cut_lineage(per_source)

    def placed(df: DataFrame) -> DataFrame:
        side = per_source.withColumnRenamed("_mx_source", "_mx_name")
        return df.join(side, F.col("_mx_source").eqNullSafe(F.col("_mx_name"))).withColumn(
            "_mx_block", F.pmod(F.xxhash64(F.lit(seed), "_mx_hash"), F.col("_mx_blocks"))).drop("_mx_name", "_mx_blocks")

    docs = placed(slim)
    blocks = docs.groupBy("_mx_rank", "_mx_block", "_mx_full", "_mx_rest").agg(F.sum("_mx_size").alias("words"))
    permuted = Window.partitionBy("_mx_rank").orderBy(F.xxhash64(F.lit(seed + 1), "_mx_rank", "_mx_block"), "_mx_block")
    blocks = blocks.withColumn("before", F.coalesce(
        F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    left = F.col("_mx_rest") - F.col("before")
    blocks = cut_lineage(blocks.withColumn("part", F.when(left <= 0, "none").when(left >= F.col("words"), "whole")
                                           .otherwise("edge")).withColumn("left", left))

    # documents of the block on the edge (one per source): walks along the hash order that take
    # what still fits, then the one document that fits best
    edge = blocks.filter("part = 'edge'").select("_mx_rank", "_mx_block", "left")
    inside = docs.select("_mx_rank", "_mx_block", "_mx_hash", "_mx_size").join(edge, ["_mx_rank", "_mx_block"])
    inside = inside.groupBy("_mx_rank", "_mx_hash", F.col("left").alias("gap")).agg(F.sum("_mx_size").alias("s"))
    walk = Window.partitionBy("_mx_rank").orderBy("_mx_hash").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("_mx_rank")
    inside = inside.withColumn("in", F.lit(False))
    for _ in range(EDGE_WALKS):
        fits = ~F.col("in") & (F.col("s") <= F.col("gap"))
        new = fits & (F.col("upto") <= F.col("gap"))
        inside = inside.withColumn("upto", F.sum(F.when(fits, F.col("s"))).over(walk)).withColumn("new", new).select(
            "_mx_rank", "_mx_hash", "s", (F.col("in") | F.col("new")).alias("in"),
            (F.col("gap") - F.coalesce(F.sum(F.when(F.col("new"), F.col("s"))).over(whole), F.lit(0))).alias("gap"))
    fit = F.min(F.when(~F.col("in"), F.struct(F.abs(F.col("s") - F.col("gap")).alias("miss"), F.col("_mx_hash").alias("h")))
                ).over(whole)
    inside = inside.withColumn("fit", fit)
    picked = cut_lineage(inside.filter(F.col("in") | ((F.col("fit.h") == F.col("_mx_hash")) & (F.col("fit.miss") < F.col("gap"))))
                         .select(F.col("_mx_rank").alias("_mx_r"), F.col("_mx_hash").alias("_mx_h")))

    # one row per drawn block, permuted within the source, dealt to the shards by their quotas
    copies = F.col("_mx_full") + F.when(F.col("part") == "none", 0).otherwise(1)
    drawn = blocks.filter(copies > 0).select(
        "_mx_rank", "_mx_block", F.explode(F.sequence(F.lit(1), copies)).alias("copy"),
        ((F.col("part") == "edge")).alias("edge"), "_mx_full")
    drawn = drawn.withColumn("edge", F.col("edge") & (F.col("copy") > F.col("_mx_full"))).drop("_mx_full")
    counts = per_source.select("_mx_rank").join(
        drawn.groupBy("_mx_rank").agg(F.count("*").alias("n")), "_mx_rank", "left").select(
        "_mx_rank", F.coalesce("n", F.lit(0)).cast("long").alias("_mx_draws"))
    ends = shard_quotas(counts, shards, seed)
    mixed = Window.partitionBy("_mx_rank").orderBy(F.xxhash64(F.lit(seed + 2), "_mx_rank", "_mx_block", "copy"), "_mx_block", "copy")
    dealt = drawn.withColumn("n", F.row_number().over(mixed)).join(ends, "_mx_rank").select(
        "_mx_rank", "_mx_block", F.struct("copy", F.size(F.filter("_mx_ends", lambda e: e < F.col("n"))).alias("shard"), "edge").alias("d"))
    dealt = cut_lineage(dealt.groupBy("_mx_rank", "_mx_block").agg(F.array_sort(F.collect_list("d")).alias("_mx_dealt")))

    out = placed(rows).join(dealt, ["_mx_rank", "_mx_block"], "left").join(
        picked, (F.col("_mx_rank") == F.col("_mx_r")) & (F.col("_mx_hash") == F.col("_mx_h")), "left")
    draws = F.filter(F.coalesce("_mx_dealt", F.array()), lambda d: ~d["edge"] | F.col("_mx_h").isNotNull())
    return out.withColumn("_mx_draws", F.transform(draws, lambda d: F.struct(d["copy"].alias("copy"), d["shard"].alias("shard")))
                          ).drop("_mx_dealt", "_mx_h", "_mx_r", "_mx_full", "_mx_rest", "_mx_block", "_mx_rank")


def mix_sizes(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, draws, one row per document row."""
    slim = cut_lineage(prepared(docs, doc_id, source, text).select(
        F.col(doc_id).alias("doc_id"), "_mx_source", "_mx_size", "_mx_hash"))
    out = draw(slim, slim.select("_mx_source", "_mx_size", "_mx_hash"), **how)
    return out.select("doc_id", F.col("_mx_size").alias("size"), F.col("_mx_source_size").alias("source_size"), F.col("_mx_target").alias("target"),
                      (F.col("_mx_size") * F.size("_mx_draws")).cast("long").alias("taken"),
                      F.col("_mx_draws").alias("draws"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 0,
        n_partitions: int | None = None, **how) -> DataFrame:
    """The mix: the rows of `docs`, once per draw, with mix_copy, mix_shard and mix_position, each
    shard in the order of mix_position. Where `docs` has such a column, the new one's name gets underscores."""
    given = docs.select(packed(docs).alias("given"), F.col(doc_id).alias("id"), F.col(source).alias("source"),
                        F.col(text).alias("text"))
    out = draw(prepared(given, "id", "source", "text"), seed=seed, **how).withColumn("_mx_d", F.explode("_mx_draws"))
    copy, shard, position = (free_name(docs, f"mix_{name}") for name in ("copy", "shard", "position"))
    out = out.select("given.*", F.col("_mx_d.copy").alias(copy), F.col("_mx_d.shard").alias(shard),
                     F.xxhash64(F.lit(seed + 3), "_mx_hash", "_mx_d.copy").alias(position))
    n = n_partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionByRange(n, shard, position).sortWithinPartitions(shard, position)
