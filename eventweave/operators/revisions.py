"""Append-only payload revisions, intake rules and run accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import policy
from ..functions.text import payload_json
from .skew import first_rows, running_lag, top_rows

KEY = ["endpoint_id", "key_kind", "external_key"]


def distinct_revisions(arrivals: DataFrame) -> DataFrame:
    """One row per (key, payload hash): its first arrival."""
    return first_rows(arrivals, [*KEY, "payload_hash"], ["created_at", "raw_id"])


def revision_chain(arrivals: DataFrame) -> DataFrame:
    """Persisted revisions with `supersedes`, the latest earlier revision of the key."""
    chained = running_lag(distinct_revisions(arrivals), KEY, ["created_at", "raw_id"], None, ["raw_id"], "_prev")
    return chained.withColumn("supersedes", F.col("_prev.raw_id")).drop("_prev")


def revision_class(arrivals: DataFrame) -> DataFrame:
    """Each arrival as created, changed or unchanged. A payload seen before for its key is
    unchanged, also after other payloads in between."""
    firsts = distinct_revisions(arrivals).select(
        *KEY, "payload_hash", F.col("raw_id").alias("_first_hash"), "created_at")
    first_key = firsts.groupBy(*KEY).agg(
        F.min_by("_first_hash", F.struct("created_at", "_first_hash")).alias("_first_key"))
    firsts = firsts.drop("created_at").join(first_key, KEY)
    return arrivals.join(firsts, [*KEY, "payload_hash"]).withColumn(
        "revision_class",
        F.when(F.col("raw_id") == F.col("_first_key"), "created")
        .when(F.col("raw_id") == F.col("_first_hash"), "changed")
        .otherwise("unchanged"),
    ).drop("_first_hash", "_first_key")


def ingest_revisions(arrivals: DataFrame, existing: DataFrame) -> DataFrame:
    """New revisions to append: first arrivals whose (key, hash) the table lacks."""
    return distinct_revisions(arrivals).join(
        existing.select(*KEY, "payload_hash"), [*KEY, "payload_hash"], "left_anti")


def run_item_cap(items: DataFrame, run: str, order: list[str],
                 limit: int = policy.RUN_ITEM_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Accepted items (the first `limit` of each run) and the overflow count per run."""
    accepted = top_rows(items, [run], order, limit, "_position").drop("_position")
    overflow = items.groupBy(run).agg(
        F.greatest(F.count("*") - limit, F.lit(0)).alias("overflow"))
    return accepted, overflow


_PAYLOAD = ["authors", "content_html", "external_id", "language", "published_at", "raw",
            "summary_html", "title", "truncated", "updated_at", "url"]


def bound_payload(item: dict[str, Column], max_bytes: int = policy.PAYLOAD_BYTES,
                  field_chars: int = policy.PAYLOAD_FIELD_CHARS) -> Column:
    """Payload struct, fields in sorted order. If its JSON is too large the bodies, authors
    and raw data are dropped and the identity fields cut."""
    absent = F.lit(None).cast("string")
    get = lambda name: item.get(name, absent)
    authors = item.get("authors", F.array().cast("array<string>"))
    raw = item.get("raw", F.map_from_arrays(F.array(), F.array()).cast("map<string,string>"))

    def build(full: bool) -> Column:
        values = {n: get(n) for n in _PAYLOAD if n not in ("authors", "raw", "truncated")}
        values["authors"], values["raw"], values["truncated"] = authors, raw, F.lit(not full)
        if not full:
            values["summary_html"] = values["content_html"] = absent
            values["authors"] = F.array().cast("array<string>")
            values["raw"] = F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")
            for n in ("title", "url", "external_id", "language"):
                values[n] = F.substring(values[n], 1, field_chars)
        return F.struct(*[values[n].alias(n) for n in _PAYLOAD])

    full = build(True)
    return F.when(F.octet_length(payload_json(full)) <= max_bytes, full).otherwise(build(False))


# --- runs ------------------------------------------------------------------------


def run_counters(outcomes: DataFrame, run: str = "run_id") -> DataFrame:
    """Counts per run from rows of (run, stage, result)."""
    is_ = lambda stage, result: (F.col("stage") == stage) & (F.col("result") == result)
    count = lambda cond, name: F.count_if(cond).alias(name)
    return outcomes.groupBy(run).agg(
        count(F.col("stage").isin("intake", "reject"), "items_received"),
        count(F.col("stage") == "reject", "items_rejected"),
        count(is_("intake", "created"), "raw_created"),
        count(is_("intake", "changed"), "raw_changed"),
        count(is_("intake", "unchanged"), "raw_unchanged"),
        count((F.col("stage") == "process") & (F.col("result") != "ERROR"), "items_processed"),
        count(is_("process", "ERROR"), "items_failed"),
        count(is_("process", "IDENTITY_DUPLICATE"), "identity_duplicates"),
        count(is_("process", "CONTENT_DUPLICATE"), "content_duplicates"),
        count((F.col("stage") == "process")
              & F.col("result").isin("REJECTED", "IDENTITY_CONFLICT", "SOURCE_IDENTITY_CONFLICT"),
              "raw_rejected"),
        count(is_("process", "SOURCE_IDENTITY_CONFLICT"), "source_identity_conflicts"),
        count((F.col("stage") == "process") & F.col("result").isin(
            "ARTICLE_CREATED", "ARTICLE_UPDATED", "IDENTITY_DUPLICATE", "CONTENT_DUPLICATE"),
            "processed_ok"),
    )


def run_status(counters: DataFrame) -> DataFrame:
    """FAILED, NO_CHANGE, PARTIAL or SUCCEEDED from the counters and the fetch result."""
    c = F.col
    failed = c("fetch_failed") if "fetch_failed" in counters.columns else F.lit(False)
    same = c("not_modified") if "not_modified" in counters.columns else F.lit(False)
    return counters.withColumn(
        "status",
        F.when(failed, "FAILED").when(same, "NO_CHANGE")
        .when((c("items_rejected") > 0) | (c("items_failed") > 0) | (c("raw_rejected") > 0), "PARTIAL")
        .when((c("raw_created") > 0) | (c("raw_changed") > 0) | (c("processed_ok") > 0), "SUCCEEDED")
        .otherwise("NO_CHANGE"),
    )


def reset_rejected(raw: DataFrame, raw_ids: DataFrame) -> DataFrame:
    """The named REJECTED revisions become PENDING again; all else is unchanged."""
    hit = raw_ids.select("raw_id").distinct().withColumn("_hit", F.lit(True))
    named = F.coalesce(F.col("_hit"), F.lit(False)) & (F.col("status") == "REJECTED")
    return raw.join(hit, "raw_id", "left").select(
        *[F.when(named, F.lit("PENDING")).otherwise(F.col("status")).alias("status")
          if c == "status" else
          F.when(named, F.lit("")).otherwise(F.col(c)).alias(c)
          if c in ("rejection_reason", "outcome") else F.col(c)
          for c in raw.columns])


def prune_runs(runs: DataFrame, now, days: int = policy.RUN_RETENTION_DAYS) -> DataFrame:
    """Runs to keep: RUNNING ones, and those not finished before the retention cutoff."""
    if days < 1:
        raise ValueError("retention must be at least one day")
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    old = (F.col("status") != "RUNNING") & F.coalesce(F.col("finished_at") < cutoff, F.lit(False))
    return runs.filter(~old)


def unlink_pruned(raw: DataFrame, kept_runs: DataFrame) -> DataFrame:
    """Revisions with the link to a pruned run set to NULL."""
    kept = kept_runs.select("run_id", F.lit(True).alias("_kept"))
    return raw.join(kept, "run_id", "left").withColumn(
        "run_id", F.when(F.col("_kept"), F.col("run_id"))).drop("_kept")


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.groupBy("endpoint_id").agg(
        F.max_by(F.struct("status", "started_at", "run_id"), F.struct("started_at", "run_id"))
        .alias("r")
    ).select("endpoint_id", F.col("r.status").alias("latest_status"),
             F.col("r.started_at").alias("latest_started_at"), F.col("r.run_id").alias("latest_run_id"))


def endpoint_due(endpoints: DataFrame, runs: DataFrame, now,
                 stale_seconds: int = policy.STALE_RUNNING_SECONDS) -> DataFrame:
    """Each endpoint as inactive, running, not_due or dispatched at `now`."""
    at = F.lit(now).cast("timestamp")
    running = (F.col("latest_status") == "RUNNING") & (
        F.col("latest_started_at") > at - F.make_dt_interval(secs=F.lit(stale_seconds)))
    due_at = F.timestamp_micros(
        F.unix_micros("latest_started_at") + F.col("fetch_interval_seconds") * 1_000_000)
    return endpoints.join(latest_run(runs), "endpoint_id", "left").withColumn(
        "due_state",
        F.when(~(F.col("is_active") & F.col("source_active")), "inactive")
        .when(F.coalesce(running, F.lit(False)), "running")
        .when(F.coalesce(due_at > at, F.lit(False)), "not_due")
        .otherwise("dispatched"),
    )


def recent_runs(runs: DataFrame, last: int, endpoint_id=None) -> DataFrame:
    picked = runs if endpoint_id is None else runs.filter(F.col("endpoint_id") == endpoint_id)
    return picked.orderBy(F.desc("started_at"), F.desc("run_id")).limit(last)


def stale_runs(runs: DataFrame, now, seconds: int = policy.STALE_RUNNING_SECONDS) -> DataFrame:
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds))
    return runs.filter((F.col("status") == "RUNNING") & (F.col("started_at") < cutoff))


def pending_select(raw: DataFrame, now, limit: int = policy.PENDING_LIMIT,
                   seconds: int = policy.RECONCILE_AFTER_SECONDS) -> DataFrame:
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds))
    return raw.filter((F.col("status") == "PENDING") & (F.col("created_at") <= cutoff)).orderBy(
        "created_at", "raw_id").limit(limit)
