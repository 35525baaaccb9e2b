"""Named queries over the given tables, each with the equal SQL where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_TS = "TIMESTAMP '2024-01-01 00:00:00'"

# Domain tables as SQL; the same adapters as sources/tables.py.
TABLES: dict[str, str] = {
    "article": f"""
        SELECT doc_id AS article_id, source AS source_id, '' AS external_id,
          'https://' || source || '.example/' || doc_id AS canonical_url,
          substr(split_part(text, chr(10), 1), 1, 512) AS title, '' AS description,
          text AS body_text, lang AS language,
          {_TS} + INTERVAL (doc_id) MINUTE AS first_seen_at,
          CASE WHEN doc_id % 7 <> 0 THEN {_TS} + INTERVAL (doc_id) MINUTE END AS published_at,
          {_TS} + INTERVAL (doc_id) MINUTE AS event_time
        FROM documents""",
    "source_t": """
        SELECT source AS source_id, min(lang) AS default_language, source AS slug,
          upper(source) AS name FROM documents GROUP BY source""",
    "page_item": """
        SELECT page_id AS item_id, regexp_extract(url, '^https?://([^/]+)', 1) AS source_id, url,
          regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, html AS content_html,
          regexp_extract(html, '<html lang="([^"]*)"', 1) AS language FROM pages""",
    "vec": "SELECT vec_id AS article_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings",
    "vart": f"""
        SELECT vec_id AS article_id, 'src' || (vec_id % 9) AS source_id,
          CASE vec_id % 4 WHEN 0 THEN 'fr' WHEN 1 THEN 'en-GB' ELSE 'EN' END AS language,
          {_TS} + INTERVAL (vec_id) HOUR AS event_time FROM embeddings""",
    "vmember": """
        SELECT CAST(label AS BIGINT) * 100000 + vec_id // 100 AS story_id, vec_id AS article_id
        FROM embeddings""",
    "vstory": """
        SELECT DISTINCT story_id,
          CASE WHEN story_id % 7 = 6 THEN 'ARCHIVED' ELSE 'ACTIVE' END AS status,
          CASE WHEN (story_id // 100000) % 3 = 0 THEN 'fr' ELSE 'en' END AS language FROM vmember""",
    "vsum": """
        SELECT story_id, i, sum(vector[i]) AS s FROM (
          SELECT story_id, vector, unnest(range(1, len(vector) + 1)) AS i
          FROM vmember JOIN vec USING (article_id)) GROUP BY story_id, i""",
    "vnorm": "SELECT story_id, sqrt(sum(s * s)) AS n FROM vsum GROUP BY story_id",
    "vstoryvec": """
        SELECT story_id, list(s / n ORDER BY i) AS vector FROM vsum JOIN vnorm USING (story_id)
        GROUP BY story_id""",
    "vstats": """
        SELECT story_id, count(*) AS member_count, min(event_time) AS first_time,
          max(event_time) AS last_time
        FROM vmember JOIN vart USING (article_id) GROUP BY story_id""",
    "member": """
        SELECT doc_id // 12 AS story_id, doc_id AS article_id, true AS is_primary,
          CASE WHEN doc_id % 12 = 0 THEN 'CREATED_STORY' ELSE 'MATCHED' END AS method,
          CASE WHEN doc_id % 12 <> 0 THEN 1.0::DOUBLE - (doc_id % 12) / 100.0::DOUBLE END AS similarity
        FROM documents""",
    "story": f"""
        SELECT story_id,
          CASE WHEN story_id % 11 = 10 THEN 'ARCHIVED' ELSE 'ACTIVE' END AS status,
          CASE story_id % 5 WHEN 3 THEN 'STALE' WHEN 4 THEN 'FAILED' ELSE 'CURRENT' END AS refresh_state,
          'sig' || story_id AS member_signature,
          CASE WHEN story_id % 5 = 4 THEN CASE WHEN story_id % 2 = 0
            THEN 'story_synthesis:INVALID_OUTPUT' ELSE 'TIMEOUT' END ELSE '' END AS refresh_error,
          count(*) + CASE WHEN story_id % 4 = 1 THEN 1 ELSE 0 END AS article_count,
          1 AS source_count, 'en' AS language,
          {_TS} + INTERVAL (story_id // 2) HOUR AS created_at
        FROM member GROUP BY story_id""",
    "synth": f"""
        SELECT story_id, story_id * 2 + g AS synthesis_id,
          'extractive:lead-sentences@1' AS model_key,
          {_TS} + INTERVAL (story_id * 2 + g) HOUR AS generated_at,
          CASE WHEN story_id % 13 = 0 OR g = 0 THEN 'old' ELSE 'sig' || story_id END AS member_signature,
          g = 1 AS is_current
        FROM story, (VALUES (0), (1)) t(g) WHERE story_id % 6 <> 0""",
    "element": """
        SELECT story_id * 2 + 1 AS synthesis_id, story_id,
          CASE WHEN article_id % 12 = 0 THEN 'TITLE' WHEN article_id % 12 <= 3 THEN 'SUMMARY'
            ELSE 'CONTEXT' END AS kind, article_id % 12 AS ord, title AS text, article_id
        FROM member JOIN article USING (article_id) WHERE story_id % 6 <> 0""",
    "validity": """
        SELECT synth.*, coalesce(n BETWEEN 1 AND 20 AND t = 1 AND bad = 0, false) AS valid
        FROM synth LEFT JOIN (
          SELECT synthesis_id, count(*) AS n, count(*) FILTER (kind = 'TITLE') AS t,
            count(*) FILTER (text = '' OR length(text) > 1000) AS bad
          FROM element GROUP BY synthesis_id) USING (synthesis_id)""",
    "ev": """
        SELECT event_id, ts, user_id, event_type, value,
          CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events""",
    "run": """
        SELECT event_id AS run_id, user_id AS endpoint_id, ts AS started_at,
          CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'RUNNING'
            WHEN 'click' THEN 'PARTIAL' WHEN 'purchase' THEN 'NO_CHANGE' ELSE 'SUCCEEDED' END AS status,
          CASE WHEN event_type <> 'signup'
            THEN ts + INTERVAL (CAST(floor(value * 100) AS BIGINT)) MILLISECOND END AS finished_at
        FROM ev""",
    "endpoint": """
        SELECT endpoint_id, endpoint_id % 10 <> 0 AS is_active, endpoint_id % 17 <> 1 AS source_active,
          900 * (1 + endpoint_id % 40) AS fetch_interval_seconds
        FROM run GROUP BY endpoint_id""",
    "latest": """
        SELECT endpoint_id, status AS latest_status, started_at AS latest_started_at,
          run_id AS latest_run_id
        FROM run QUALIFY row_number() OVER (
          PARTITION BY endpoint_id ORDER BY started_at DESC, run_id DESC) = 1""",
    "arrival": """
        SELECT event_id AS raw_id, user_id AS endpoint_id, 'k' || k AS external_key,
          sha256(event_type) AS payload_hash, ts AS created_at FROM ev""",
    "imp": """
        SELECT user_id, user_id || ':' || strftime(ts, '%Y%m%d%H') AS batch_id, event_id AS seq,
          'e' || (event_id % 1500) AS event_key, user_id || '-' || strftime(ts, '%Y%m%d') AS session_id,
          k + 1 AS story_id, event_id % 50 AS position, ts AS occurred_at,
          ts + INTERVAL (CAST(floor(value) AS BIGINT)) SECOND AS received_at
        FROM ev WHERE event_type IN ('view', 'click')""",
    "known": "SELECT DISTINCT k + 1 AS story_id FROM ev WHERE k < 80",
    "cmd": """
        SELECT user_id, k + 1 AS story_id, event_id AS seq,
          CASE WHEN event_type = 'purchase' THEN 'save' ELSE 'remove' END AS op, ts AS cmd_at
        FROM ev WHERE event_type IN ('purchase', 'signup')""",
    "bookmark": """
        SELECT user_id, story_id, min(cmd_at) AS created_at FROM (
          SELECT s.*, max(CASE WHEN op = 'remove' THEN (cmd_at, seq) END) OVER (
            PARTITION BY user_id, story_id) AS r FROM cmd s)
        WHERE op = 'save' AND (r IS NULL OR (cmd_at, seq) > r) AND story_id IN (SELECT story_id FROM known)
        GROUP BY user_id, story_id""",
    "proc": f"""
        SELECT event_id AS article_id,
          CASE event_type WHEN 'view' THEN 'MATCHED' WHEN 'click' THEN 'MATCHED'
            WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'PENDING' ELSE 'EMBEDDED' END AS state,
          k % 9 AS attempts,
          CASE WHEN event_type <> 'error' THEN '' WHEN k % 4 = 0 THEN 'PROVIDER_FAILED'
            WHEN k % 4 = 1 THEN 'MISSING_EMBEDDING' ELSE 'UNEXPECTED' END AS error_kind,
          CASE WHEN k % 5 = 0 THEN 'old' ELSE 'vec:test@1' END AS embedding_model_key,
          'm1' AS matcher_key, ts AS updated_at
        FROM ev WHERE event_id % 10 <> 9""",
    "pjoin": """
        SELECT d.doc_id AS article_id, p.state, p.attempts, p.error_kind, p.embedding_model_key,
          p.matcher_key, p.updated_at, d.doc_id % 3 <> 0 AS has_primary,
          e.vec_id IS NOT NULL AS embedded
        FROM documents d LEFT JOIN proc p ON p.article_id = d.doc_id
          LEFT JOIN embeddings e ON e.vec_id = d.doc_id AND p.embedding_model_key = 'vec:test@1'""",
}


def _needed(sql: str) -> list[str]:
    """Names of the domain tables a statement uses, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name, body in TABLES.items():
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def with_tables(sql: str) -> str:
    parts = [f"{n} AS ({TABLES[n]})" for n in _needed(sql)]
    sql = sql.strip()
    if sql[:5].upper() == "WITH ":
        return "WITH " + ", ".join([*parts, sql[5:]])
    return f"WITH {', '.join(parts)} {sql}" if parts else sql


def query(name: str, sql: str | None = None):
    """Register a query and, if SQL can express it, the statement that must agree."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return fn

    return add


def words(items: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in items) + "]"
