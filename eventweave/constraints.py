"""The keys and checks of the stored tables, as data, and one job that audits any of them.

A unique rule is (columns, condition); a check is a SQL condition that NULL satisfies. `ROW_KEYS`
names the column that identifies a row in check reports.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .operators.audit import check_violations, unique_violations
from .schemas import schema

UNIQUE: dict[str, dict[str, tuple[list[str], str | None]]] = {
    "source": {"slug": (["slug"], None)},
    "source_endpoint": {"url": (["url"], None)},
    "raw_article": {"payload": (["endpoint_id", "key_kind", "external_key", "payload_hash"], None)},
    "article": {"canonical_url": (["canonical_url"], None),
                "source_external_id": (["source_id", "external_id"], "external_id <> ''")},
    "story_article": {"story_article": (["story_id", "article_id"], None), "one_primary": (["article_id"], "is_primary")},
    "article_embedding": {"article_model": (["article_id", "model_key"], None)},
    "story_embedding": {"story_model": (["story_id", "model_key"], None)},
    "article_story_processing": {"article": (["article_id"], None)},
    "story_topic": {"story_slug": (["story_id", "slug"], None)},
    "story_entity": {"story_entity": (["story_id", "kind", "key"], None)},
    "story_synthesis": {"one_current": (["story_id"], "is_current")},
    "bookmark": {"user_story": (["user_id", "story_id"], None)},
    "feed_impression": {"user_event": (["user_id", "event_id"], None),
                        "user_session_story": (["user_id", "feed_session_id", "story_id"], "story_id IS NOT NULL")},
}

_COUNTERS = ("items_received items_rejected raw_created raw_changed raw_unchanged items_processed items_failed "
             "identity_duplicates content_duplicates raw_rejected source_identity_conflicts").split()

CHECKS: dict[str, dict[str, str]] = {
    "source_endpoint": {"interval": "fetch_interval_seconds > 0"},
    "ingestion_run": {c: f"{c} >= 0" for c in _COUNTERS},
    "article": {"not_self_duplicate": "duplicate_of <> article_id"},
    "story": {"status": "status IN ('ACTIVE', 'ARCHIVED')",
              "refresh_state": "refresh_state IN ('CURRENT', 'STALE', 'FAILED')",
              "counts": "article_count >= 0 AND source_count >= 0"},
    "story_article": {"method": "method IN ('CREATED_STORY', 'MATCHED')", "similarity": "similarity BETWEEN -1 AND 1"},
    "article_embedding": {"dimension": "size(vector) = dimension"},
    "story_embedding": {"member_count": "member_count >= 1", "dimension": "size(vector) = dimension"},
    "article_story_processing": {
        "matched_keys": "state <> 'MATCHED' OR (embedding_model_key <> '' AND matcher_key <> '')"},
    "story_topic": {"score": "score BETWEEN 0 AND 1"},
    "story_entity": {"score": "score BETWEEN 0 AND 1"},
    "feed_impression": {"position": "position >= 0"},
}

ROW_KEYS = {"source_endpoint": "endpoint_id", "ingestion_run": "run_id", "feed_impression": "event_id"}


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, constraint, key, n) over the given tables; rules whose columns a table lacks are left
    out. One aggregate per unique rule, one pass for all checks of a table."""
    parts = []
    for name, table in tables.items():
        has, stored = set(table.columns), set(schema(name).names)
        needs = lambda text: set(re.findall("[a-z_]+", text)) & stored
        for rule, (keys, condition) in UNIQUE.get(name, {}).items():
            if set(keys) | needs(condition or "") <= has:
                parts.append(unique_violations(table, keys, rule, condition).withColumn("table", F.lit(name)))
        key = ROW_KEYS.get(name, "article_id" if "article_id" in has else "story_id")
        rules = {r: c for r, c in CHECKS.get(name, {}).items() if needs(c) <= has}
        if rules and key in has:
            parts.append(check_violations(table, key, rules).select(
                F.col("rule").alias("constraint"), F.col(key).cast("string").alias("key"),
                F.lit(1).cast("long").alias("n"), F.lit(name).alias("table")))
    return reduce(DataFrame.unionByName, parts).select("table", "constraint", "key", "n")
