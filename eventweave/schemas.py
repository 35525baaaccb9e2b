"""Explicit schemas of the stored tables (readers never infer)."""

from __future__ import annotations

from pyspark.sql import types as T

_PAYLOAD = ("struct<authors:array<string>,content_html:string,external_id:string,language:string,"
            "published_at:string,raw:map<string,string>,summary_html:string,title:string,"
            "truncated:boolean,updated_at:string,url:string>")
_EVIDENCE = (
    "struct<reason:string,rule:string,kept_current_story:boolean,distance:double,"
    "candidate_count:bigint,candidates:array<struct<story_id:bigint,distance:double>>,"
    "verification:array<struct<story_id:bigint,distance:double,result:string,"
    "member_distance:double,members_checked:bigint,shared_anchors:bigint>>,"
    "max_distance:double,secondary_max_distance:double,secondary_max_member_distance:double,"
    "max_time_gap_hours:double,embedding_model_key:string>")

_DDL = {
    "source": "source_id bigint, slug string, name string, homepage_url string, "
              "default_language string, is_active boolean",
    "source_endpoint": "endpoint_id bigint, source_id bigint, kind string, url string, "
                       "is_active boolean, fetch_interval_seconds int, adapter_config string, "
                       "etag string, last_modified string",
    "ingestion_run": "run_id bigint, endpoint_id bigint, trigger string, attempt int, status string, "
                     "started_at timestamp, finished_at timestamp, http_status int, error_kind string, "
                     "will_retry boolean, items_received int, items_rejected int, raw_created int, "
                     "raw_changed int, raw_unchanged int, items_processed int, items_failed int, "
                     "identity_duplicates int, content_duplicates int, raw_rejected int, "
                     "source_identity_conflicts int, duration_ms bigint",
    "raw_article": "raw_id bigint, endpoint_id bigint, run_id bigint, key_kind string, "
                   f"external_key string, external_id string, url string, payload {_PAYLOAD}, "
                   "payload_hash string, supersedes bigint, fetched_at timestamp, status string, "
                   "outcome string, rejection_reason string, processed_at timestamp, "
                   "article_id bigint, created_at timestamp, ingest_date date",
    "article": "article_id bigint, source_id bigint, endpoint_id bigint, raw_id bigint, "
               "external_id string, canonical_url string, title string, description string, "
               "body_text string, byline string, published_at timestamp, language string, "
               "content_fingerprint string, duplicate_of bigint, first_seen_at timestamp, "
               "created_at timestamp, updated_at timestamp",
    "story": "story_id bigint, status string, refresh_state string, member_signature string, "
             "refreshed_at timestamp, refresh_error string, article_count bigint, "
             "source_count bigint, first_published_at timestamp, last_published_at timestamp, "
             "language string, created_at timestamp",
    "story_article": "story_id bigint, article_id bigint, is_primary boolean, "
                     "associated_at timestamp, method string, similarity double, "
                     f"matcher_key string, evidence {_EVIDENCE}",
    "article_embedding": "article_id bigint, model_key string, dimension int, "
                         "vector array<float>, input_chars int",
    "story_embedding": "story_id bigint, model_key string, dimension int, vector array<double>, "
                       "member_count bigint, member_signature string",
    "article_story_processing": "article_id bigint, state string, attempts bigint, "
                                "error_kind string, embedding_model_key string, "
                                "matcher_key string, updated_at timestamp",
    "story_topic": "story_id bigint, slug string, label string, score double, model_key string, "
                   "member_signature string",
    "story_entity": "story_id bigint, kind string, key string, name string, score double, "
                    "model_key string, member_signature string",
    "story_synthesis": "synthesis_id bigint, story_id bigint, model_key string, "
                       "generated_at timestamp, is_current boolean, member_signature string, "
                       "elements array<struct<kind:string,position:int,text:string,"
                       "article_ids:array<bigint>>>",
    "bookmark": "user_id bigint, story_id bigint, created_at timestamp",
    "feed_impression": "user_id bigint, story_id bigint, original_story_id bigint, event_id string, "
                       "feed_session_id string, position int, surface string, policy_version int, "
                       "occurred_at timestamp, received_at timestamp",
    "feed_document": "endpoint_id bigint, document_id bigint, kind string, body string, "
                     "fetched_at timestamp",
    "visibility_report": "user_id bigint, session_id string, t_ms bigint, seq bigint, "
                         "gate_open boolean, cards array<struct<story_id:bigint,position:bigint,"
                         "share:double>>",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(_DDL[table])


TABLES = tuple(_DDL)
