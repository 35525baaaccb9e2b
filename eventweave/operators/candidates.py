"""Similarity retrieval: time-bucketed, blocked, exact top-k, and member evidence.

A range predicate alone would plan as a nested-loop join. Both sides get an equi key
(model, language, time bucket), and each bucket is cut into blocks of bounded size on
both sides, so a hot bucket becomes many tasks. A task multiplies one article block with
one story block and returns at most k rows per article. Stories of a bucket lie in cells around
pivots, and the triangle inequality on angles tells which cells an article need not visit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .. import policy
from ..functions.names import anchors, shared_anchor_count
from ..functions.text import embedding_input, language_key
from ..session import cut_lineage
from .skew import top_rows

_BUCKET = ["model_key", "lang", "dim", "bucket"]
HOUR_US = 3_600_000_000


def member_stats(membership: DataFrame, member_times: DataFrame) -> DataFrame:
    """Per story: member count, first and last event time."""
    return membership.select("story_id", "article_id").join(
        member_times.select("article_id", "event_time"), "article_id"
    ).groupBy("story_id").agg(
        F.count("*").alias("member_count"), F.min("event_time").alias("first_time"),
        F.max("event_time").alias("last_time"))


def _matrix(rows: pa.Table) -> np.ndarray:
    """The vectors of `rows`, all of one length and without NULL (`usable`), one per line."""
    values = rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(rows.num_rows, -1)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return (a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))


PAIR = "left_id long, right_id long, distance double"


def _block_topk(k: int, earlier_only: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["left_id", "right_id", "distance"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        right = right.sort_by("id")
        dist = np.round(1.0 - _cosines(_matrix(left), _matrix(right)), 12)
        t, lid, far = (left[c].to_numpy()[:, None] for c in ("t", "id", "far"))
        lo, hi, rid = (right[c].to_numpy()[None, :] for c in ("lo", "hi", "id"))
        ok = (lo <= t) & (t <= hi) & (dist <= far)
        if earlier_only:
            ok &= (lo < t) | (rid < lid)
        rows, cols = np.nonzero(ok)
        # only the pairs within reach are sorted; columns are in id order, so a stable sort breaks ties by id
        order = np.lexsort((dist[rows, cols], rows))
        rows, cols = rows[order], cols[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        rows, cols = rows[rank < k], cols[rank < k]
        return pa.table([lid[rows, 0], rid[0, cols], dist[rows, cols]], names)

    return run


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose vector can be compared (not NULL, not empty, finite), with its length as `dim`; only
    vectors of one length meet. `embed.vector_validity` reports the others."""
    return rows.withColumn("dim", F.size("vector")).filter(
        "dim > 0 AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")


def _fresh(df: DataFrame) -> DataFrame:
    """`df` under names of its own, which keeps columns apart where both sides of a join stem from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _bucketed(left: DataFrame, right: DataFrame, bucket_us: int) -> tuple[DataFrame, DataFrame]:
    left = usable(left).withColumn("bucket", F.floor(F.col("t") / bucket_us))
    right = usable(_fresh(right)).withColumn("bucket", F.explode(F.sequence(
        F.floor(F.col("lo") / bucket_us), F.floor(F.col("hi") / bucket_us))))
    return left, right


def _every(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _part(n: str) -> Column:
    return F.pmod(F.xxhash64("id"), F.col(n)).cast("int")


def _near_pairs(left: DataFrame, right: DataFrame, group: list[str], k: int, earlier_only: bool,
                block_rows: int) -> DataFrame:
    """At most k pairs of a left row in each block pair, within its `far`. Both sides of a group are
    cut into blocks of about `block_rows` rows, and each block of one side meets each of the other.

    The sizes, a short row per group, are broadcast: vectors move once, to their block pairs, and no group as a whole."""
    count = lambda df, name: df.groupBy(*group).agg(
        F.ceil(F.count("*") / block_rows).cast("int").alias(name))
    sizes = F.broadcast(_fresh(_fresh(count(left, "nl")).join(_fresh(count(right, "nr")), group)))
    keys = [*group, "lb", "rb"]
    lhs = left.join(sizes, group).withColumn("lb", _part("nl")).withColumn("rb", _every("nr"))
    rhs = right.join(sizes, group).withColumn("rb", _part("nr")).withColumn("lb", _every("nl"))
    return (
        lhs.select(*keys, "id", "t", "far", "vector").groupBy(*keys)
        .cogroup(rhs.select(*keys, "id", "lo", "hi", "vector").groupBy(*keys))
        .applyInArrow(_block_topk(k, earlier_only), PAIR)
    )


def blocked_topk(left: DataFrame, right: DataFrame, *, k: int, max_distance: float,
                 bucket_us: int, earlier_only: bool = False, block_rows: int = 2048) -> DataFrame:
    """(left_id, right_id, distance, rank): the k nearest right rows of each left row.

    left(id, model_key, lang, t, vector), right(id, model_key, lang, lo, hi, vector); times
    in microseconds; a pair needs lo <= t <= hi. A left row lies in one bucket only, so no
    pair is met twice. Every block of a bucket meets every other; see `pivot_topk`.
    """
    left, right = _bucketed(left, right, bucket_us)
    pairs = _near_pairs(left.withColumn("far", F.lit(float(max_distance))), right, _BUCKET, k, earlier_only, block_rows)
    return top_rows(pairs, ["left_id"], ["distance", "right_id"], k)


#: Most cells of a bucket, and room for rounding in angles (distances are rounded to 12 digits,
#: which is 1.5e-6 in an angle near 0).
MAX_CELLS = 256
SLACK = 1e-5
#: Rows that a task compares with the pivots at once.
CHUNK_ROWS = 8192


def _angles(rows: pa.Table, pivots: pa.Table) -> np.ndarray:
    return np.arccos(np.clip(_cosines(_matrix(rows), _matrix(pivots)), -1.0, 1.0))


def _to_cell(rows: pa.Table, pivots: pa.Table) -> pa.Table:
    """`rows` with the cell of the nearest pivot and the angle to it."""
    if not rows.num_rows or not pivots.num_rows:
        return rows.slice(0, 0).append_column("cell", pa.array([], pa.int32())).append_column("angle", pa.array([], pa.float64()))
    pivots = pivots.sort_by("cell")
    angles = _angles(rows, pivots)
    nearest = np.argmin(angles, axis=1)
    return rows.append_column("cell", pa.array(pivots["cell"].to_numpy()[nearest], pa.int32())).append_column(
        "angle", pa.array(angles[np.arange(len(angles)), nearest]))


def _to_cells(widest: float):
    """`rows` with the cell of the nearest pivot (`home`) and, as `cells` and `bounds`, all cells that can
    hold a row within the angle `widest`: a cell whose rows are between `lo` and `hi` away from its
    pivot has no row nearer than the angle to the pivot less `hi`, or `lo` less that angle. Its rows are
    nearer to its pivot than to any other, so none is nearer than half of what the angle to its pivot has
    over that to the home pivot."""
    def run(rows: pa.Table, cells: pa.Table) -> pa.Table:
        ints, floats = pa.list_(pa.int32()), pa.list_(pa.float64())
        if not rows.num_rows or not cells.num_rows:
            none = rows.slice(0, 0).append_column("home", pa.array([], pa.int32()))
            return none.append_column("cells", pa.array([], ints)).append_column("bounds", pa.array([], floats))
        cells = cells.sort_by("cell")
        number = cells["cell"].to_numpy()
        angles = _angles(rows, cells)
        bounds = np.maximum(angles - cells["hi"].to_numpy(), cells["lo"].to_numpy() - angles)
        bounds = np.maximum(bounds, (angles - angles.min(axis=1, keepdims=True)) / 2)
        kept = bounds <= widest
        ends = pa.array(np.concatenate([[0], np.cumsum(kept.sum(axis=1))]), pa.int32())
        return rows.append_column("home", pa.array(number[np.argmin(angles, axis=1)], pa.int32())).append_column(
            "cells", pa.ListArray.from_arrays(ends, pa.array(number[np.nonzero(kept)[1]], pa.int32()))).append_column(
            "bounds", pa.ListArray.from_arrays(ends, pa.array(bounds[kept])))

    return run


def _beside(rows: DataFrame, pivots: DataFrame, chunk_rows: int, run, schema: str) -> DataFrame:
    """`run` on chunks of the rows of a bucket, each beside all pivots of the bucket (MAX_CELLS at most)."""
    sizes = F.broadcast(_fresh(rows.groupBy(*_BUCKET).agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks"))))
    keys = [*_BUCKET, "chunk"]
    lhs = rows.join(sizes, _BUCKET).withColumn("chunk", _part("chunks")).drop("chunks")
    rhs = _fresh(pivots).join(sizes, _BUCKET).withColumn("chunk", _every("chunks")).drop("chunks")
    kept = [f.name for f in rows.schema]
    return lhs.groupBy(*keys).cogroup(rhs.groupBy(*keys)).applyInArrow(
        lambda a, b: run(a.select(kept), b), schema)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def pivot_cells(right: DataFrame, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """Right rows with `cell` and `angle`, and the cells (bucket, cell, vector of the pivot, lo, hi): the
    rows of a bucket are hashed into slots of `cell_rows`, MAX_CELLS at most, the row with the smallest id of
    a slot is a pivot, and each row goes to the cell of the nearest pivot."""
    right = right.filter("exists(vector, x -> x <> 0)")  # a zero vector has no angle and no distance
    sizes = F.broadcast(_fresh(right.groupBy(*_BUCKET).agg(
        F.least(F.ceil(F.count("*") / cell_rows), F.lit(MAX_CELLS)).cast("int").alias("slots"))))
    heads = F.broadcast(_fresh(right.select(*_BUCKET, "id").join(sizes, _BUCKET).groupBy(
        *_BUCKET, _part("slots").alias("cell")).agg(F.min("id").alias("id"))))  # MAX_CELLS a bucket
    pivots = cut_lineage(right.select(*_BUCKET, "id", "vector").join(heads, [*_BUCKET, "id"]).select(
        *_BUCKET, "cell", "vector").dropDuplicates([*_BUCKET, "cell"]))
    dealt = cut_lineage(_beside(right, pivots, CHUNK_ROWS, _to_cell, _ddl(right) + ", cell int, angle double"))
    spans = dealt.groupBy(*_BUCKET, "cell").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"))
    return dealt, _fresh(pivots).join(_fresh(spans), [*_BUCKET, "cell"])


def pivot_visits(left: DataFrame, cells: DataFrame, max_distance: float) -> DataFrame:
    """Left rows with `home`, `cells` and `bounds` (`_to_cells`)."""
    widest = float(np.arccos(np.clip(1.0 - max_distance, -1.0, 1.0))) + SLACK
    return _beside(left.filter("exists(vector, x -> x <> 0)"), cells, CHUNK_ROWS, _to_cells(widest),
                   _ddl(left) + ", home int, cells array<int>, bounds array<double>")


def still_open(visits: DataFrame, first: DataFrame, k: int, max_distance: float) -> DataFrame:
    """One row per left row and cell beyond its home that can hold a nearer row than the k-th found at home."""
    kth = first.groupBy(F.col("left_id").alias("id")).agg(F.count("*").alias("found"), F.max("distance").alias("kth"))
    far = F.when(F.col("found") >= k, F.col("kth")).otherwise(F.lit(float(max_distance)))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1.0 - F.col("far")))) + SLACK
    return (
        visits.join(kth, "id", "left").withColumn("far", far).withColumn("within", angle)
        .withColumn("visit", F.explode(F.arrays_zip("cells", "bounds")))
        .filter("visit.cells <> home AND visit.bounds <= within")
        .select(*_BUCKET, F.col("visit.cells").alias("cell"), "id", "t", "far", "vector"))


def pivot_topk(left: DataFrame, right: DataFrame, *, k: int, max_distance: float, bucket_us: int,
               earlier_only: bool = False, block_rows: int = 2048, cell_rows: int | None = None) -> DataFrame:
    """The rows of `blocked_topk`, with a pivot index in each bucket that skips cells exactly.

    Angles obey the triangle inequality, so an article need not visit a cell whose nearest possible row is
    farther than `max_distance` or than the k-th story found in the article's own cell. Rows of a vector
    without length (all zeros) pair with nothing. Cells above `block_rows` are cut into blocks.
    """
    left, right = _bucketed(left, right, bucket_us)
    right, cells = pivot_cells(right, cell_rows or block_rows)
    visits = cut_lineage(pivot_visits(left, cells, max_distance))
    group = [*_BUCKET, "cell"]
    home = visits.select(*_BUCKET, F.col("home").alias("cell"), "id", "t", F.lit(float(max_distance)).alias("far"), "vector")
    first = cut_lineage(top_rows(_near_pairs(home, right, group, k, earlier_only, block_rows),
                                 ["left_id"], ["distance", "right_id"], k).drop("rank"))
    more = _near_pairs(still_open(visits, first, k, max_distance), right, group, k, earlier_only, block_rows)
    return top_rows(first.unionByName(more), ["left_id"], ["distance", "right_id"], k)


#: Up to this distance (an angle of 0.14) an article needs few cells, whatever the vectors; blocks would send each
#: vector to every block of its bucket.
NARROW = 0.01


def nearest_rows(left: DataFrame, right: DataFrame, *, k: int, max_distance: float, indexed: bool | None = None, **how) -> DataFrame:
    """`pivot_topk` if `indexed`, by default if `max_distance` is narrow, else `blocked_topk`; the rows are the same."""
    search = pivot_topk if (max_distance <= NARROW if indexed is None else indexed) else blocked_topk
    return search(left, right, k=k, max_distance=max_distance, **how)


def _targets(article_emb: DataFrame, articles: DataFrame) -> DataFrame:
    return article_emb.select("article_id", "model_key", "vector").join(
        articles.select("article_id", "language", "event_time"), "article_id"
    ).select(F.col("article_id").alias("id"), "model_key", language_key("language").alias("lang"),
             F.unix_micros("event_time").alias("t"), "vector")


def story_candidates(article_emb: DataFrame, articles: DataFrame, story_emb: DataFrame,
                     stories: DataFrame, membership: DataFrame, member_times: DataFrame, *,
                     k: int = policy.CANDIDATE_LIMIT,
                     max_distance: float = policy.CANDIDATE_DISTANCE,
                     window_hours: float = policy.CANDIDATE_WINDOW_HOURS,
                     block_rows: int = 2048, indexed: bool | None = None) -> DataFrame:
    """The k nearest ACTIVE stories of the same model and language whose member time range
    overlaps the window around the article, nearest first, ties by story id.

    Searched by `nearest_rows`. The index writes its cells first and pays where the bound is narrow or vectors
    lie in clusters that few cells cover.
    """
    if k < 1:
        raise ValueError("k must be positive")
    window = int(window_hours * HOUR_US)
    side = (
        story_emb.select("story_id", "model_key", "vector")
        .join(stories.filter("status = 'ACTIVE'").select("story_id", "status", "language"), "story_id")
        .join(member_stats(membership, member_times), "story_id")
    )
    right = side.select(
        F.col("story_id").alias("id"), "model_key", language_key("language").alias("lang"),
        (F.unix_micros("first_time") - window).alias("lo"),
        (F.unix_micros("last_time") + window).alias("hi"), "vector")
    targets = _targets(article_emb, articles)
    near = nearest_rows(targets, right, k=k, max_distance=max_distance, indexed=indexed, bucket_us=window, block_rows=block_rows)
    facts = side.select("story_id", "member_count", "first_time", "last_time", "language", "status").distinct()
    return near.select(F.col("left_id").alias("article_id"), F.col("right_id").alias("story_id"),
                       "distance", "rank").join(facts, "story_id")


def missing_embedding(articles: DataFrame, article_emb: DataFrame, model_key: str) -> DataFrame:
    """Articles that have no vector for the model (not the same as having no candidate)."""
    return articles.select("article_id").join(
        article_emb.filter(F.col("model_key") == model_key), "article_id", "left_anti")


def recent_members(membership: DataFrame, member_times: DataFrame, n: int) -> DataFrame:
    """The n latest members per story by (event time, article id), newest first."""
    timed = membership.select("story_id", "article_id").join(
        member_times.select("article_id", "event_time"), "article_id")
    return top_rows(timed, ["story_id"], [F.desc("event_time"), F.desc("article_id")], n, "recency")


def article_anchors(articles: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(article_id, capitalized, strong); the text is description and body, whole by default."""
    body = embedding_input(F.lit(""), "description", "body_text", max_chars)
    return articles.select("article_id", anchors(F.col("title"), body).alias("a")).select(
        "article_id", "a.capitalized", "a.strong")


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0),
        lambda s, v: s + v)
    return F.round(F.lit(1.0) - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)), 12)


def member_evidence(candidates: DataFrame, membership: DataFrame, member_times: DataFrame,
                    article_emb: DataFrame, texts: DataFrame, *, model_key: str,
                    max_members: int = 20) -> DataFrame:
    """Per (article, story): nearest of the latest other members, members checked and shared
    names. One spare member is read so that the article itself can be left out; names are
    extracted from the texts of the articles and members concerned only."""
    pairs = candidates.select("article_id", "story_id").distinct()
    recent = recent_members(
        membership.join(pairs.select("story_id").distinct(), "story_id", "left_semi"),
        member_times, max_members + 1,
    ).withColumnRenamed("article_id", "member_id")
    joined = pairs.join(recent, "story_id").filter("member_id <> article_id")
    checked = top_rows(joined, ["article_id", "story_id"], ["recency"], max_members, "_n").select(
        "article_id", "story_id", "member_id")
    needed = checked.select("article_id").unionByName(
        checked.select(F.col("member_id").alias("article_id"))).distinct()
    names = article_anchors(texts.join(needed, "article_id", "left_semi"))
    vec = article_emb.filter(F.col("model_key") == model_key).select("article_id", "vector")
    other = {"article_id": "member_id", "vector": "_mv", "capitalized": "_mc", "strong": "_ms"}
    found = (
        checked.join(vec.withColumnsRenamed(other), "member_id", "left")
        .join(names.withColumnsRenamed(other), "member_id", "left")
        .join(vec.withColumnRenamed("vector", "_v"), "article_id", "left")
        .withColumn("_d", cosine_distance(F.col("_v"), F.col("_mv")))
        .groupBy("article_id", "story_id")
        .agg(F.min("_d").alias("nearest_member_distance"),
             F.count("*").alias("members_checked"),
             F.array_distinct(F.flatten(F.collect_list("_mc"))).alias("_mc"),
             F.array_distinct(F.flatten(F.collect_list("_ms"))).alias("_ms"))
    )
    shared = shared_anchor_count(F.col("strong"), F.col("capitalized"), F.col("_ms"), F.col("_mc"))
    return found.join(names, "article_id", "left").select(
        "article_id", "story_id", "nearest_member_distance", "members_checked",
        F.greatest(F.coalesce(shared, F.lit(0)), F.lit(0)).cast("long").alias("shared_anchors"))


__all__ = ["article_anchors", "blocked_topk", "cosine_distance", "member_evidence",
           "member_stats", "missing_embedding", "nearest_rows", "pivot_topk", "recent_members", "story_candidates"]
