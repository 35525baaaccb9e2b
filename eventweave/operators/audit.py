"""Integrity audits: what a database would enforce, as set-based jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import policy


def unique_violations(table: DataFrame, keys: list[str], name: str, condition: str | None = None) -> DataFrame:
    """(constraint, key, n) of keys that occur more than once where `condition` holds."""
    rows = table if condition is None else table.filter(condition)
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(
        F.lit(name).alias("constraint"),
        F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"), "n")


def check_violations(table: DataFrame, key: str, rules: dict[str, str | Column]) -> DataFrame:
    """(key, rule) of rows that break a rule; all rules in one pass. NULL counts as satisfied."""
    expr = lambda r: F.expr(r) if isinstance(r, str) else r
    broken = F.array_compact(F.array(*[
        F.when(~F.coalesce(expr(r), F.lit(True)), F.lit(n)) for n, r in rules.items()]))
    return table.select(F.col(key), F.explode(broken).alias("rule"))


def foreign_key_orphans(child: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return child.filter(F.col(column).isNotNull()).join(
        parent.select(F.col(parent_key).alias(column)), column, "left_anti")


# One JSON string, with the colon after it if it is a key.
_STRING = '"[^"\\\\]*+(?:\\\\.[^"\\\\]*+)*+"\\s*:?'


def json_keys(text: Column) -> Column:
    """Every object key at any depth of a JSON text. Strings are read one after the other, so
    what looks like a key inside a value is not one."""
    strings = F.regexp_extract_all(text, F.lit(_STRING), 0)
    return F.transform(F.filter(strings, lambda x: x.endswith(":")),
                       lambda x: F.regexp_replace(x, '^"|"\\s*:$', ""))


CONTENT_KEYS = ["title", "body_text", "description", "payload"]
SECRET = "(?i)token|key|secret|password|authorization"


def evidence_guard(edges: DataFrame, evidence_json: str = "evidence_json",
                   max_bytes: int = policy.EVIDENCE_BYTES) -> DataFrame:
    """Edges whose evidence is no object, too large, or holds publication text."""
    text = F.col(evidence_json)
    named = F.arrays_overlap(json_keys(text), F.array(*[F.lit(k) for k in CONTENT_KEYS]))
    kind = F.schema_of_variant(F.try_parse_json(text))
    problem = (
        F.when(~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), "not_object")
        .when(named, "content_key").when(F.octet_length(text) > max_bytes, "too_large"))
    return edges.withColumn("problem", problem).filter("problem IS NOT NULL")


def config_secret_scan(endpoints: DataFrame, config_json: str = "adapter_config") -> DataFrame:
    """Endpoints whose configuration has a secret-like key at any depth, with those keys."""
    found = F.filter(json_keys(F.col(config_json)), lambda k: k.rlike(SECRET))
    return endpoints.withColumn("secret_keys", F.array_sort(F.array_distinct(found))).filter(
        F.size("secret_keys") > 0)


def primary_violations(edges: DataFrame) -> DataFrame:
    """Articles with more than one primary story."""
    return unique_violations(edges, ["article_id"], "one_primary", "is_primary")
