"""Story state: signatures, counters, refresh of a whole generation, processing state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import policy
from ..functions.text import event_time
from ..session import cut_lineage
from . import enrich, synthesis
from .embed import story_vector


def _iso(ts: Column) -> Column:
    """UTC ISO text with microseconds only when there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.concat(whole, F.when(micros == 0, F.lit("")).otherwise(
        F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))), F.lit("+00:00"))


def member_signature(members: DataFrame) -> DataFrame:
    """(story_id, member_signature, member_count) from (story_id, article_id, updated_at).

    The `id:revision` lines are hashed one by one and the eight 32-bit parts of their SHA-256 are
    added up, part by part; the signature is the SHA-256 of the sums. It does not depend on order,
    changes with any line, and is combined before the shuffle, whatever the size of a story.
    """
    line = F.concat_ws(":", F.col("article_id").cast("string"), _iso(F.col("updated_at")))
    digest = members.select("story_id", F.sha2(line, 256).alias("d"))
    piece = lambda i: F.sum(F.conv(
        F.substring("d", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string")
    return digest.groupBy("story_id").agg(
        F.sha2(F.concat_ws("|", *[piece(i) for i in range(8)]), 256).alias("member_signature"),
        F.count("*").alias("member_count"))


def story_counters(membership: DataFrame, articles: DataFrame) -> DataFrame:
    """Exact article and source counts and the publication window."""
    facts = articles.select("article_id", "source_id", event_time().alias("t"))
    return membership.select("story_id", "article_id").join(facts, "article_id").groupBy("story_id").agg(
        F.count_distinct("article_id").alias("article_count"),
        F.count_distinct("source_id").alias("source_count"),
        F.min("t").alias("first_published_at"), F.max("t").alias("last_published_at"))


def counter_drift(stories: DataFrame, membership: DataFrame, articles: DataFrame) -> DataFrame:
    """Stories whose stored counters differ from the current membership."""
    live = story_counters(membership, articles).select(
        "story_id", F.col("article_count").alias("live_articles"),
        F.col("source_count").alias("live_sources"))
    return stories.join(live, "story_id", "left").fillna(0, ["live_articles", "live_sources"]).filter(
        (F.col("article_count") != F.col("live_articles"))
        | (F.col("source_count") != F.col("live_sources")))


def mark_stale(stories: DataFrame, touched: DataFrame) -> DataFrame:
    """Stories in `touched` (story_id) become STALE without an error."""
    hit = touched.select("story_id").distinct().withColumn("_hit", F.lit(True))
    return stories.join(hit, "story_id", "left").select(*[
        F.when(F.col("_hit"), F.lit({"refresh_state": "STALE", "refresh_error": ""}[c]))
        .otherwise(F.col(c)).alias(c) if c in ("refresh_state", "refresh_error") else F.col(c)
        for c in stories.columns])


def refresh_select(stories: DataFrame, limit: int) -> DataFrame:
    return stories.filter(F.col("refresh_state").isin("STALE", "FAILED")).orderBy("story_id").limit(limit)


def refresh_stories(stories: DataFrame, membership: DataFrame, articles: DataFrame,
                    embeddings: DataFrame, *, max_articles: int | None = None,
                    max_chars: int | None = None, now=None, topics: DataFrame | None = None,
                    entities: DataFrame | None = None) -> dict[str, DataFrame]:
    """One new generation for the STALE and FAILED stories. `topics` and `entities` take the place of the rules'
    own output (`enrich.extract_with`); where they break the output rules the story FAILS as a whole.

    Keys: stories (all, updated), story_emb, topics, entities, elements, signatures (those the work started from, for
    `promote`). A story whose
    signature is unchanged and CURRENT is not touched; one without members is ARCHIVED; one
    whose members lack vectors or an uncontested title becomes FAILED and keeps its old rows.
    """
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    due = stories.filter(F.col("refresh_state").isin("STALE", "FAILED")).select("story_id")
    members = membership.join(due, "story_id", "left_semi")
    signed = member_signature(
        members.select("story_id", "article_id").join(
            articles.select("article_id", "updated_at"), "article_id")
    ).withColumnRenamed("member_signature", "_sig").drop("member_count")
    counted = story_counters(members, articles).withColumnsRenamed({
        c: f"_{c}" for c in ("article_count", "source_count", "first_published_at", "last_published_at")})
    # a model is published only if every member has its vector
    vectors = cut_lineage(story_vector(members, embeddings).filter("vector IS NOT NULL").join(
        counted.select("story_id", "_article_count"), "story_id").filter(
        F.col("member_count") == F.col("_article_count")).drop("_article_count"))
    # one prepared input for topics and entities, written once
    texts = cut_lineage(enrich.member_text(members, articles, max_articles=max_articles, max_chars=max_chars))
    found = cut_lineage(enrich.mentions(texts))
    # the rules' own output keeps the output rules; a user's is checked
    given = [cut_lineage(rows) for rows in (topics, entities) if rows is not None]
    refused = due.filter(F.lit(False))
    for rows in given:
        refused = refused.unionByName(enrich.invalid_scores(rows).select("story_id"))
    refused = refused.distinct().withColumn("_refused", F.lit(True))
    if topics is None:
        topics = enrich.topic_scores(texts, found=found).withColumnRenamed("word", "label")
    else:
        topics = enrich.valid_scores(given.pop(0))
    entities = enrich.entity_scores(texts, found=found).drop("key") if entities is None else enrich.valid_scores(given.pop(0))
    # every table of the generation asks for the stories that are ready, so what tells that is written once
    elements = cut_lineage(synthesis.synthesize(members, articles, max_articles=max_articles, max_chars=max_chars))
    titled = elements.filter("kind = 'TITLE'").select("story_id").distinct().withColumn("_title", F.lit(True))
    whole = vectors.select("story_id").distinct().withColumn("_vector", F.lit(True))
    state = cut_lineage(
        stories.join(due.withColumn("_due", F.lit(True)), "story_id", "left")
        .join(signed, "story_id", "left").join(counted, "story_id", "left")
        .join(titled, "story_id", "left").join(whole, "story_id", "left").join(refused, "story_id", "left")
    )
    is_due, empty = F.col("_due").isNotNull(), F.col("_sig").isNull()
    good = is_due & (empty | (F.col("_title").isNotNull() & F.col("_vector").isNotNull() & F.col("_refused").isNull()))
    empty_sig = F.sha2(F.lit(""), 256)
    new = {
        "status": F.when(good & empty, "ARCHIVED").otherwise(F.col("status")),
        "refresh_state": F.when(good, "CURRENT").when(is_due, "FAILED").otherwise(F.col("refresh_state")),
        "member_signature": F.when(good, F.coalesce("_sig", empty_sig)).otherwise(F.col("member_signature")),
        "refresh_error": F.when(good, "").when(
            is_due & F.col("_vector").isNull(), "story_embedding:MISSING_EMBEDDING").when(
            is_due & F.col("_refused"), "story_enrichment:INVALID_OUTPUT").when(
            is_due, "story_synthesis:SYNTHESIZER_FAILED").otherwise(F.col("refresh_error")),
        "article_count": F.when(good, F.coalesce("_article_count", F.lit(0))).otherwise(F.col("article_count")),
        "source_count": F.when(good, F.coalesce("_source_count", F.lit(0))).otherwise(F.col("source_count")),
        "first_published_at": F.when(good, F.col("_first_published_at")),
        "last_published_at": F.when(good, F.col("_last_published_at")),
        "refreshed_at": F.when(good, at),
    }
    keep = ("first_published_at", "last_published_at", "refreshed_at")
    for name in keep:
        if name in stories.columns:
            new[name] = F.when(good, new[name]).otherwise(F.col(name))
    published = state.select(
        *[(new[c] if c in new else F.col(c)).alias(c) for c in stories.columns],
        *[new[c].alias(c) for c in keep if c not in stories.columns])
    ready = state.filter(good & ~empty).select("story_id", F.col("_sig").alias("member_signature"))
    stamp = lambda df: df.join(ready, "story_id")
    return {
        "stories": published, "story_emb": stamp(vectors),
        "signatures": signed.withColumnRenamed("_sig", "member_signature"),
        "topics": stamp(enrich.merge_topics(topics)),
        "entities": stamp(enrich.merge_entities(entities)),
        "elements": stamp(elements),
    }


def promote(made: dict[str, DataFrame], before: DataFrame, membership: DataFrame, articles: DataFrame) -> dict[str, DataFrame]:
    """What of a refresh may be published, given the members as they stand now.

    `made` is the outcome of `refresh_stories` on the stories `before`. A refreshed or failed story whose
    member signature has moved since is not published: its row stays as it was but STALE without an
    error, so the next refresh takes it, and its other rows are left out.
    """
    due = before.filter(F.col("refresh_state").isin("STALE", "FAILED")).select("story_id")
    used = made["signatures"].select("story_id", F.col("member_signature").alias("_used"))
    now = member_signature(membership.join(due, "story_id", "left_semi").select("story_id", "article_id").join(
        articles.select("article_id", "updated_at"), "article_id")).select("story_id", F.col("member_signature").alias("_now"))
    moved = cut_lineage(due.join(used, "story_id", "left").join(now, "story_id", "left").filter(
        ~F.col("_used").eqNullSafe(F.col("_now"))).select("story_id"))
    out = {name: rows.join(moved, "story_id", "left_anti") for name, rows in made.items() if name != "signatures"}
    columns = made["stories"].columns
    held = mark_stale(before, moved).join(moved, "story_id", "left_semi")
    held = held.select(*[c if c in before.columns else F.lit(None).cast(made["stories"].schema[c].dataType).alias(c) for c in columns])
    return out | {"stories": out["stories"].unionByName(held)}


# --- row-set table changes ---------------------------------------------------------


def insert_missing(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing plus the rows of `new` whose key it lacks; one row per new key."""
    fresh = new.join(existing.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return existing.unionByName(fresh)


def missing_items(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return new.select(*keys).distinct().join(existing.select(*keys), keys, "left_anti")


def upsert_rows(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new)


def replace_set(existing: DataFrame, new: DataFrame, group: str, groups: DataFrame) -> DataFrame:
    """All rows of the named groups are replaced by `new` (possibly none)."""
    return existing.join(groups.select(group).distinct(), group, "left_anti").unionByName(new)


# --- processing state --------------------------------------------------------------

_EMBEDDING_KINDS = ["INVALID_MODEL", "INVALID_INPUT", "PROVIDER_FAILED", "PROVIDER_UNAVAILABLE",
                    "INVALID_OUTPUT", "DIMENSION_MISMATCH"]
_MATCHING_KINDS = ["MISSING_EMBEDDING", "STORY_NO_LONGER_ACTIVE"]


def failed_step(error_kind, embedded) -> Column:
    error_kind = F.col(error_kind) if isinstance(error_kind, str) else error_kind
    embedded = F.col(embedded) if isinstance(embedded, str) else embedded
    return (F.when(error_kind.isin(_EMBEDDING_KINDS), "article_embedding")
            .when(error_kind.isin(_MATCHING_KINDS) | embedded, "story_matching")
            .otherwise("article_embedding"))


def split_refresh_error(value) -> tuple[Column, Column]:
    """(step, kind) of `step:kind`; a value without a colon is a kind alone."""
    value = F.col(value) if isinstance(value, str) else value
    at = F.instr(value, ":")
    return (F.when(at > 0, F.substring_index(value, ":", 1)).otherwise(F.lit("")),
            F.when(at > 0, value.substr(at + 1, F.length(value))).otherwise(value))


def processing_state(articles: DataFrame, embeddings: DataFrame, edges: DataFrame,
                     errors: DataFrame, *, model_key: str, matcher_key: str) -> DataFrame:
    """State per article from facts: a fresh primary edge, an embedding, or a recorded failure
    (errors: article_id, error_kind, at, model_key, matcher_key)."""
    fresh = edges.filter(
        F.col("is_primary") & (F.col("matcher_key") == matcher_key)
        & (F.col("embedding_model_key") == model_key)
    ).select("article_id", F.lit(True).alias("_m"))
    emb = embeddings.filter(F.col("model_key") == model_key).select("article_id", F.lit(True).alias("_e"))
    bad = errors.filter((F.col("model_key") == model_key) & (F.col("matcher_key") == matcher_key)).groupBy(
        "article_id").agg(F.count("*").alias("_n"), F.max_by("error_kind", F.struct("at", "error_kind")).alias("_k"))
    joined = articles.select("article_id").join(fresh, "article_id", "left").join(
        emb, "article_id", "left").join(bad, "article_id", "left")
    done = F.col("_m").isNotNull()
    return joined.select(
        "article_id",
        F.when(done, "MATCHED").when(F.col("_n") > 0, "FAILED").when(F.col("_e"), "EMBEDDED")
        .otherwise("PENDING").alias("state"),
        F.when(done, 0).otherwise(F.coalesce("_n", F.lit(0))).cast("long").alias("attempts"),
        F.when(done, "").otherwise(F.coalesce("_k", F.lit(""))).alias("error_kind"))


def processing_join(articles: DataFrame, processing: DataFrame, edges: DataFrame,
                    embeddings: DataFrame) -> DataFrame:
    """Articles with their processing row, whether a primary edge exists, and whether an
    embedding exists for the recorded model."""
    primary = edges.filter("is_primary").select("article_id", F.lit(True).alias("_p")).distinct()
    emb = embeddings.select("article_id", F.col("model_key").alias("embedding_model_key"),
                            F.lit(True).alias("_e")).distinct()
    return (
        articles.select("article_id").join(processing, "article_id", "left")
        .join(primary, "article_id", "left")
        .join(emb, ["article_id", "embedding_model_key"], "left")
        .withColumn("has_primary", F.coalesce("_p", F.lit(False)))
        .withColumn("embedded", F.coalesce("_e", F.lit(False))).drop("_p", "_e")
    )


def _same_pair(model_key: str, matcher_key: str) -> Column:
    return F.coalesce((F.col("embedding_model_key") == model_key)
                      & (F.col("matcher_key") == matcher_key), F.lit(False))


def article_backlog(joined: DataFrame, *, model_key: str, matcher_key: str) -> DataFrame:
    """Articles whose processing is not complete, with category and failing step."""
    pair, state = _same_pair(model_key, matcher_key), F.col("state")
    category = (
        F.when(state.isNull(), "MISSING")
        .when((state == "MATCHED") & ~F.col("has_primary"), "UNASSIGNED")
        .when((state == "MATCHED") & ~pair, "STALE").when(state != "MATCHED", state))
    return joined.withColumn("category", category).filter("category IS NOT NULL").withColumn(
        "failed_step", F.when(F.col("category") == "FAILED", failed_step("error_kind", "embedded"))
        .otherwise(F.lit("")))


def backlog_counts(backlog: DataFrame) -> DataFrame:
    return backlog.agg(F.count("*").alias("listed"), F.count_if(F.col("category") == "MISSING").alias("missing"),
                       F.count_if(F.col("category") == "FAILED").alias("failed"))


def reconcile_select(joined: DataFrame, now, *, model_key: str, matcher_key: str,
                     limit: int = policy.RECONCILE_BATCH,
                     seconds: int = policy.RECONCILE_AFTER_SECONDS,
                     max_attempts: int = policy.MAX_ATTEMPTS) -> DataFrame:
    """Articles missing, stale, stuck, retryable or unassigned, by id."""
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds))
    state = F.col("state")
    work = (
        ~_same_pair(model_key, matcher_key) | state.isin("PENDING", "EMBEDDED")
        | ((state == "FAILED") & (F.col("attempts") < max_attempts))
        | ((state == "MATCHED") & ~F.col("has_primary")))
    return joined.filter(state.isNull() | ((F.col("updated_at") <= cutoff) & work)).orderBy(
        "article_id").limit(limit)


def claim(processing: DataFrame, chosen: DataFrame, now, *, model_key: str, matcher_key: str) -> DataFrame:
    """Processing rows after `chosen` articles were handed out: touched, or created PENDING."""
    ids = chosen.select("article_id").withColumn("_c", F.lit(True))
    at = F.lit(now).cast("timestamp")
    touched = processing.join(ids, "article_id", "left").withColumn(
        "updated_at", F.when(F.col("_c"), at).otherwise(F.col("updated_at"))).drop("_c")
    created = chosen.select("article_id").join(processing, "article_id", "left_anti").select(
        "article_id", F.lit("PENDING").alias("state"), F.lit(0).cast("long").alias("attempts"),
        F.lit("").alias("error_kind"), F.lit(model_key).alias("embedding_model_key"),
        F.lit(matcher_key).alias("matcher_key"), at.alias("updated_at"))
    return touched.unionByName(created.select(*touched.columns))
