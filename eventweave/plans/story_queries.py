"""Embeddings, retrieval, matching, synthesis, refresh, reads and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import policy
from ..operators import candidates as cd
from ..operators import dedup, embed, match, quality, read, refresh, synthesis
from ..operators.enrich import extract_with, merge_entities, merge_topics, valid_scores
from ..policy import MatchPolicy
from ..session import cut_lineage, scratch_folder
from ..sources import layout, tables as t
from ..sources.tables import VECTOR_KEY
from .registry import query
from .text_queries import (_ANCHOR_SQL, ENTITY_PARTS, MENTION_SQL, SENTENCES, TOPIC_PARTS, collapse, content_sql, figures_sql, name_key,
                           story_texts)

# The given vectors are far apart; distances are scaled, the rules are the same.
DISTANCE = 0.9
SCALED = MatchPolicy(max_distance=0.55, max_time_gap_hours=48.0, secondary_max_distance=0.8,
                     secondary_max_member_distance=0.75, min_anchors=1, max_members=20)

# Tighter bounds for the jobs that run in rounds.
CLOSE = MatchPolicy(max_distance=0.6, max_time_gap_hours=48.0, secondary_max_distance=0.7,
                    secondary_max_member_distance=0.68, min_anchors=1, max_members=20)

COSINE = """round(1 - list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) *
    list_dot_product({b}, {b})), 12)"""


def _cos(a: str, b: str) -> str:
    return COSINE.format(a=a, b=b)


# --- vectors -----------------------------------------------------------------------


def _story_emb(spark, d):
    return embed.story_vector(t.vector_membership(spark, d), t.vector_embeddings(spark, d))


@query("story_vector", """
    SELECT story_id, i - 1 AS i, round(s / n, 9) + 0.0 AS x FROM vsum JOIN vnorm USING (story_id)""")
def story_vector(spark, d):
    return _story_emb(spark, d).select("story_id", F.posexplode("vector").alias("i", "x")).select(
        "story_id", F.col("i").cast("long").alias("i"), (F.round("x", 9) + 0.0).alias("x"))


@query("member_stats", """
    SELECT story_id, member_count, epoch(first_time)::BIGINT AS first_time, epoch(last_time)::BIGINT AS last_time
    FROM vstats""")
def member_stats(spark, d):
    return cd.member_stats(t.vector_membership(spark, d), t.vector_articles(spark, d)).select(
        "story_id", "member_count", F.unix_timestamp("first_time").alias("first_time"),
        F.unix_timestamp("last_time").alias("last_time"))


_HASH_SQL = f"""
    WITH txt AS (SELECT article_id, rtrim(array_to_string(list_filter([{collapse('title')},
        {collapse('body_text')}], lambda x: x <> ''), chr(10) || chr(10))) AS text FROM article),
    tok AS (SELECT article_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM txt),
    cnt AS (SELECT article_id, w, count(*) AS n FROM tok GROUP BY ALL),
    hashed AS (SELECT article_id, n, sha256(w) AS h FROM cnt),
    bucket AS (SELECT article_id, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS i,
        sum(n * CASE WHEN substr(h, 10, 1) IN ('1','3','5','7','9','b','d','f') THEN 1 ELSE -1 END) AS s
      FROM hashed GROUP BY ALL),
    hv AS (SELECT article_id, i, s / sqrt(sum(s * s) OVER (PARTITION BY article_id)) AS x FROM bucket)
"""


@query("hash_embedding", _HASH_SQL + """
    SELECT article_id, i, round(x, 9) AS x FROM hv WHERE x <> 0""")
def hash_embedding(spark, d):
    """Whole texts; buckets other than zero."""
    from ..functions.text import embedding_input, posexploded

    text = embedding_input("title", "description", "body_text", None)
    texts = t.articles(spark, d).select("article_id", text.alias("t"))
    return posexploded(texts, ["article_id"], embed.hash_embedding(F.col("t")), "i", "x").filter("x <> 0").select(
        "article_id", F.col("i").cast("long").alias("i"), F.round("x", 9).alias("x"))


@query("embed_articles", f"""
    SELECT article_id, '{policy.HASH_MODEL_KEY}' AS model_key, 64 AS dimension, length(rtrim(array_to_string(
      list_filter([{collapse('title')}, {collapse('body_text')}], lambda x: x <> ''), chr(10) || chr(10))))
      AS input_chars
    FROM article WHERE article_id NOT IN (SELECT vec_id FROM embeddings)""")
def embed_articles(spark, d):
    """Articles without a stored vector, under the built-in provider."""
    have = t.vector_embeddings(spark, d).withColumn("model_key", F.lit(policy.HASH_MODEL_KEY))
    new = embed.embed_articles(t.articles(spark, d), have, max_chars=None)
    return new.select("article_id", "model_key", F.col("dimension").cast("long").alias("dimension"),
                      F.col("input_chars").cast("long").alias("input_chars"))


@query("embedding_udf", f"""
    SELECT article_id, 'example:lengths@1' AS model_key, 4 AS dimension, CAST(length(array_to_string(
      list_filter([{collapse('title')}, {collapse('body_text')}], lambda x: x <> ''), chr(10) || chr(10)))
      AS DOUBLE) AS first
    FROM article""")
def embedding_udf(spark, d):
    """A user provider through the Arrow hook, over whole texts."""
    embed.register_provider("lengths", "example:lengths@1", 4, length_model)
    new = embed.embed_articles(t.articles(spark, d), t.vector_embeddings(spark, d), "lengths", max_chars=None)
    return new.select("article_id", "model_key", "dimension", F.element_at("vector", 1).alias("first"))


def length_model():
    """A provider factory: four simple counts of a text."""

    def embed_texts(texts: list[str]) -> list[list[float]]:
        return [[float(len(s)), float(s.count(" ")), float(s.count(".")), 1.0] for s in texts]

    return embed_texts


@query("embed_stories", """
    SELECT story_id, 'vec:test@1' AS model_key, count(*) AS member_count FROM vmember
    WHERE story_id % 2 = 0 GROUP BY story_id""")
def embed_stories(spark, d):
    have = t.vector_stories(spark, d).filter("story_id % 2 = 1").select(
        "story_id", F.lit(VECTOR_KEY).alias("model_key"))
    made = embed.embed_stories(t.vector_membership(spark, d), t.vector_embeddings(spark, d), have)
    return made.select("story_id", "model_key", "member_count")


@query("withdraw_member", """
    WITH rest AS (SELECT * FROM vmember WHERE article_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 6 = 0)),
    touched AS (SELECT DISTINCT story_id FROM vmember WHERE article_id % 6 = 0),
    s AS (SELECT story_id, i, sum(vector[i]) AS s FROM (SELECT story_id, vector,
        unnest(range(1, len(vector) + 1)) AS i FROM rest JOIN vec USING (article_id)
        WHERE story_id IN (FROM touched)) GROUP BY ALL),
    v AS (SELECT story_id, i, s / sqrt(sum(s * s) OVER (PARTITION BY story_id)) AS x FROM s)
    SELECT story_id, count(*) AS dimension, round(sum(x * i), 6) AS weight FROM v GROUP BY story_id
    UNION ALL SELECT story_id, count(*), round(sum(vector[i] * i), 6) FROM (
      SELECT story_id, vector, unnest(range(1, len(vector) + 1)) AS i FROM vstoryvec
      WHERE story_id NOT IN (FROM touched) OR story_id NOT IN (SELECT story_id FROM rest)) GROUP BY story_id""")
def withdraw_member(spark, d):
    """Every sixth article leaves its story."""
    members = t.vector_membership(spark, d)
    rest, gone = members.filter("article_id % 6 <> 0"), members.filter("article_id % 6 = 0")
    after = embed.withdraw_member(rest, t.vector_embeddings(spark, d), _story_emb(spark, d), gone)
    weight = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return after.select("story_id", F.col("dimension").cast("long").alias("dimension"),
                        F.round(weight, 6).alias("weight"))


@query("vector_validity", """
    SELECT article_id, CASE WHEN article_id % 10 = 1 THEN 'wrong_length' WHEN article_id % 10 = 2
      THEN 'not_finite' END AS problem FROM vec WHERE article_id % 10 IN (1, 2)""")
def vector_validity(spark, d):
    n = F.col("article_id") % 10
    broken = t.vector_embeddings(spark, d).withColumn(
        "vector", F.when(n == 1, F.slice("vector", 1, 63))
        .when(n == 2, F.transform("vector", lambda x: x * F.lit(float("nan")))).otherwise(F.col("vector")))
    return embed.vector_validity(broken).select("article_id", "problem")


# --- retrieval ---------------------------------------------------------------------


def _candidates(spark, d, **options):
    return cd.story_candidates(
        t.vector_embeddings(spark, d), t.vector_articles(spark, d), _story_emb(spark, d),
        t.vector_stories(spark, d), t.vector_membership(spark, d), t.vector_articles(spark, d),
        max_distance=DISTANCE, **options)


_CAND_SQL = f"""
    WITH pair AS (SELECT a.article_id, s.story_id, {_cos('v.vector', 'sv.vector')} AS distance,
        a.event_time, s.first_time, s.last_time, s.member_count, st.language, st.status, a.language AS lang
      FROM vart a JOIN vec v USING (article_id), vstats s JOIN vstory st USING (story_id)
        JOIN vstoryvec sv USING (story_id)
      WHERE st.status = 'ACTIVE' AND lower(split_part(st.language, '-', 1)) = lower(split_part(a.language, '-', 1))
        AND s.first_time <= a.event_time + INTERVAL 168 HOUR AND s.last_time >= a.event_time - INTERVAL 168 HOUR),
    cand AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY distance, story_id) AS rank
      FROM pair WHERE distance <= {DISTANCE} QUALIFY rank <= 10)
"""


@query("story_candidates", _CAND_SQL + """
    SELECT article_id, story_id, rank, round(distance, 6) AS distance, member_count,
      epoch(first_time)::BIGINT AS first_time, epoch(last_time)::BIGINT AS last_time, language, status
    FROM cand""")
def story_candidates(spark, d):
    return _candidates(spark, d).select(
        "article_id", "story_id", F.col("rank").cast("long").alias("rank"),
        F.round("distance", 6).alias("distance"), "member_count",
        F.unix_timestamp("first_time").alias("first_time"), F.unix_timestamp("last_time").alias("last_time"),
        "language", "status")


@query("candidate_topk", _CAND_SQL + """
    SELECT article_id, count(*) AS found, round(min(distance), 6) AS nearest, max(rank) AS last_rank
    FROM cand WHERE rank <= 3 GROUP BY article_id""")
def candidate_topk(spark, d):
    return _candidates(spark, d, k=3, indexed=True, block_rows=256).groupBy("article_id").agg(
        F.count("*").alias("found"), F.round(F.min("distance"), 6).alias("nearest"),
        F.max("rank").cast("long").alias("last_rank"))


@query("missing_embedding", """
    SELECT article_id FROM article WHERE article_id NOT IN (SELECT vec_id FROM embeddings)""")
def missing_embedding(spark, d):
    return cd.missing_embedding(t.articles(spark, d), t.vector_embeddings(spark, d), VECTOR_KEY)


@query("recent_members", """
    SELECT story_id, article_id, row_number() OVER (
      PARTITION BY story_id ORDER BY event_time DESC, article_id DESC) AS recency
    FROM member JOIN article USING (article_id) QUALIFY recency <= 5""")
def recent_members(spark, d):
    return cd.recent_members(t.text_membership(spark, d), t.article_times(spark, d), 5).select(
        "story_id", "article_id", F.col("recency").cast("long").alias("recency"))


_JUDGED_SQL = _CAND_SQL + f""",
    judged AS (SELECT *, greatest(epoch_us(first_time) - epoch_us(event_time),
        epoch_us(event_time) - epoch_us(last_time), 0) <= 48 * 3600000000 AS compatible FROM cand),
    near AS (SELECT article_id, min(distance) AS near FROM judged WHERE compatible GROUP BY article_id),
    second AS (SELECT article_id, story_id, distance FROM judged JOIN near USING (article_id)
      WHERE compatible AND near > {SCALED.max_distance} AND distance <= {SCALED.secondary_max_distance})
"""
_EVIDENCE_SQL = _ANCHOR_SQL + ", " + _JUDGED_SQL.strip()[5:] + f""",
    ranked AS (SELECT s.article_id, s.story_id, m.article_id AS member_id, row_number() OVER (
        PARTITION BY s.article_id, s.story_id ORDER BY a.event_time DESC, a.article_id DESC) AS r
      FROM second s JOIN vmember m USING (story_id) JOIN vart a ON a.article_id = m.article_id
      WHERE m.article_id <> s.article_id QUALIFY r <= {SCALED.max_members}),
    dist AS (SELECT r.article_id, r.story_id, min({_cos('x.vector', 'y.vector')}) AS nearest, count(*) AS checked
      FROM ranked r JOIN vec x ON x.article_id = r.article_id JOIN vec y ON y.article_id = r.member_id
      GROUP BY ALL),
    common AS (SELECT r.article_id, r.story_id, count(DISTINCT o.term) AS shared
      FROM ranked r JOIN anchor o ON o.article_id = r.article_id
        JOIN anchor p ON p.article_id = r.member_id AND p.term = o.term
      WHERE o.strong OR p.strong GROUP BY ALL),
    evidence AS (SELECT article_id, story_id, nearest, checked, coalesce(shared, 0) AS shared
      FROM dist LEFT JOIN common USING (article_id, story_id))
"""


def _judged(spark, d):
    found = _candidates(spark, d).select(*match.CANDIDATE_COLS)
    return match.compatible(found, t.vector_articles(spark, d), SCALED)


@query("member_evidence", _EVIDENCE_SQL + """
    SELECT article_id, story_id, round(nearest, 6) AS nearest, checked, shared FROM evidence""")
def member_evidence(spark, d):
    pairs = match.secondary_candidates(_judged(spark, d), SCALED)
    found = cd.member_evidence(
        pairs, t.vector_membership(spark, d), t.vector_articles(spark, d), t.vector_embeddings(spark, d),
        t.articles(spark, d), model_key=VECTOR_KEY, max_members=SCALED.max_members)
    return found.select("article_id", "story_id", F.round("nearest_member_distance", 6).alias("nearest"),
                        F.col("members_checked").alias("checked"), F.col("shared_anchors").alias("shared"))


@query("candidate_union", _JUDGED_SQL + f"""
    SELECT article_id, story_id FROM second
    UNION SELECT j.article_id, j.story_id FROM judged j JOIN vmember m
      ON m.article_id = j.article_id AND m.story_id = j.story_id
    WHERE compatible AND distance > {SCALED.max_distance} AND distance <= {SCALED.secondary_max_distance}""")
def candidate_union(spark, d):
    """Secondary candidates and the story each article is in."""
    current = t.vector_membership(spark, d).withColumnRenamed("story_id", "current_story_id")
    return match.secondary_candidates(_judged(spark, d), SCALED, current)


# --- matching ----------------------------------------------------------------------

_DECIDE_SQL = _EVIDENCE_SQL + f""",
    checked AS (SELECT s.article_id, s.story_id, s.distance, CASE
        WHEN lower(split_part(a.language, '-', 1)) <> 'en' THEN 'LANGUAGE_UNSUPPORTED'
        WHEN e.nearest IS NULL THEN 'NO_MEMBER_EVIDENCE'
        WHEN e.nearest > {SCALED.secondary_max_member_distance} THEN 'MEMBER_TOO_FAR'
        WHEN e.shared < {SCALED.min_anchors} THEN 'NO_SHARED_ANCHOR' ELSE 'ACCEPTED' END AS result
      FROM second s JOIN vart a USING (article_id) LEFT JOIN evidence e USING (article_id, story_id)),
    acc AS (SELECT * FROM checked WHERE result = 'ACCEPTED' QUALIFY row_number() OVER (
      PARTITION BY article_id ORDER BY distance, story_id) = 1),
    best AS (SELECT * FROM judged WHERE compatible QUALIFY row_number() OVER (
      PARTITION BY article_id ORDER BY distance, story_id) = 1),
    n AS (SELECT article_id, count(*) AS candidate_count FROM cand GROUP BY article_id),
    v AS (SELECT c.article_id, count(*) AS verified FROM checked c LEFT JOIN acc USING (article_id)
      WHERE acc.distance IS NULL OR (c.distance, c.story_id) <= (acc.distance, acc.story_id) GROUP BY c.article_id),
    decision AS (SELECT x.article_id,
      CASE WHEN b.distance <= {SCALED.max_distance} OR acc.story_id IS NOT NULL THEN 'MATCH'
        ELSE 'CREATE_NEW_STORY' END AS kind,
      CASE WHEN n.candidate_count IS NULL THEN 'NO_CANDIDATES' WHEN b.story_id IS NULL
        THEN 'NO_COMPATIBLE_CANDIDATE' WHEN b.distance <= {SCALED.max_distance} THEN 'WITHIN_THRESHOLD'
        WHEN acc.story_id IS NOT NULL THEN 'VERIFIED_SAME_EVENT' WHEN v.verified > 0
        THEN 'VERIFICATION_REJECTED' ELSE 'ABOVE_THRESHOLD' END AS reason,
      CASE WHEN b.distance <= {SCALED.max_distance} THEN 'PRIMARY_DISTANCE'
        WHEN acc.story_id IS NOT NULL THEN 'SECONDARY_EVENT_VERIFY' END AS rule,
      CASE WHEN b.distance <= {SCALED.max_distance} THEN b.story_id ELSE acc.story_id END AS story_id,
      round(CASE WHEN b.distance <= {SCALED.max_distance} THEN b.distance
        ELSE coalesce(acc.distance, b.distance) END, 6) AS distance,
      coalesce(n.candidate_count, 0) AS candidate_count, coalesce(v.verified, 0) AS verified
    FROM vart x LEFT JOIN n USING (article_id) LEFT JOIN best b USING (article_id)
      LEFT JOIN acc USING (article_id) LEFT JOIN v USING (article_id))
"""


def _decisions(spark, d, current=None):
    return match.decide_snapshot(
        t.vector_articles(spark, d), t.vector_embeddings(spark, d), t.vector_stories(spark, d),
        _story_emb(spark, d), t.vector_membership(spark, d), t.vector_articles(spark, d),
        t.articles(spark, d), model_key=VECTOR_KEY, policy=SCALED, max_distance=DISTANCE, current=current)


@query("match_articles", _DECIDE_SQL + "SELECT * FROM decision")
def match_articles(spark, d):
    """The decision of every article against the stories as they stand."""
    return _decisions(spark, d).select(
        "article_id", "kind", "reason", "rule", "story_id", F.round("distance", 6).alias("distance"),
        "candidate_count", F.size("verifications").cast("long").alias("verified"))


@query("apply_matches", _DECIDE_SQL + f"""
    SELECT article_id, CASE WHEN kind = 'MATCH' THEN story_id ELSE article_id + 9000000 END AS story_id,
      CASE WHEN kind = 'MATCH' THEN 'MATCHED' ELSE 'CREATED_STORY' END AS method,
      CASE WHEN kind = 'MATCH' THEN round(1 - distance, 6) END AS similarity,
      '{SCALED.matcher_key}' AS matcher_key, reason,
      CASE WHEN kind = 'MATCH' THEN NULL ELSE 1 END AS new_vectors FROM decision""")
def apply_matches(spark, d):
    done = match.apply_matches(_decisions(spark, d), t.vector_articles(spark, d), t.vector_embeddings(spark, d),
                               model_key=VECTOR_KEY, policy=SCALED, story_id_base=9_000_000)
    made = done.story_emb.select("story_id", F.col("member_count").alias("new_vectors"))
    return done.edges.join(made, "story_id", "left").select(
        "article_id", "story_id", "method", F.round("similarity", 6).alias("similarity"), "matcher_key",
        "evidence.reason", "new_vectors")


@query("keep_current_story")
def keep_current_story(spark, d):
    """Every article re-decided with its present story preferred."""
    current = t.vector_membership(spark, d).select("article_id", F.col("story_id").alias("current_story_id"))
    return _decisions(spark, d, current).select(
        "article_id", "kind", "reason", "story_id", F.round("distance", 6).alias("distance"), "kept_current_story")


@query("match_rounds")
def match_rounds(spark, d):
    """All articles from nothing: stories found in rounds."""
    none = t.vector_stories(spark, d).filter("false")
    done = match.match_articles(
        t.vector_articles(spark, d), t.vector_embeddings(spark, d), none,
        _story_emb(spark, d).filter("false"), t.vector_membership(spark, d).filter("false"),
        t.vector_articles(spark, d), t.articles(spark, d), model_key=VECTOR_KEY, policy=CLOSE,
        max_distance=DISTANCE)
    return done.edges.select("article_id", "story_id", "method", F.round("similarity", 6).alias("similarity"))


@query("reprocess_articles")
def reprocess_articles(spark, d):
    """Every fifth article is taken out of its story and matched again."""
    members = t.vector_membership(spark, d)
    edges = match.reprocess_articles(
        members.filter("article_id % 5 = 0"), t.vector_articles(spark, d), t.vector_embeddings(spark, d),
        t.vector_stories(spark, d), _story_emb(spark, d), members, t.vector_articles(spark, d),
        t.articles(spark, d), model_key=VECTOR_KEY, policy=CLOSE, max_distance=DISTANCE, story_id_base=9_000_000).edges
    return edges.select("article_id", "story_id", "method")


@query("explain_match", _DECIDE_SQL + """
    SELECT article_id, kind AS decision, reason, coalesce(rule, '') AS rule, candidate_count,
      reason = 'NO_CANDIDATES' AS no_candidate_text, kind = 'MATCH' AS joined_text FROM decision""")
def explain_match(spark, d):
    done = match.apply_matches(_decisions(spark, d), t.vector_articles(spark, d), t.vector_embeddings(spark, d),
                               model_key=VECTOR_KEY, policy=SCALED, story_id_base=9_000_000)
    return read.explain_match(done.edges).select(
        "article_id", "decision", "reason", "rule", "candidate_count",
        (F.col("summary") == "created a new Story: no candidate was retrieved").alias("no_candidate_text"),
        F.col("summary").startswith("joined Story").alias("joined_text"))


# --- dedup -------------------------------------------------------------------------

_NORMAL_SQL = """
    norm AS (SELECT article_id + 1000000 AS raw_id, source_id,
        CASE WHEN article_id % 4 = 0 THEN 'x' || article_id % 50 ELSE '' END AS external_id,
        CASE WHEN article_id % 3 = 0 THEN canonical_url ELSE canonical_url || '/new' END AS canonical_url,
        sha256(FOLDED) AS fp, length(FOLDED) AS n FROM article),
    stored AS (SELECT article_id, source_id, canonical_url, sha256(FOLDED) AS fp, first_seen_at AS created_at,
        CASE WHEN article_id % 8 = 0 THEN 'x' || article_id % 50 ELSE '' END AS external_id
      FROM article WHERE article_id % 2 = 0),
    ext AS (SELECT source_id, external_id, min(article_id) AS e FROM stored WHERE external_id <> '' GROUP BY ALL),
    url AS (SELECT canonical_url, min(article_id) AS u FROM stored GROUP BY ALL),
    first_fp AS (SELECT fp, arg_min(article_id, (created_at, article_id)) AS f FROM stored GROUP BY fp),
    c AS (SELECT norm.*, e, u, CASE WHEN e IS NULL AND u IS NULL AND n >= 200 THEN f END AS f
      FROM norm LEFT JOIN ext USING (source_id, external_id) LEFT JOIN url USING (canonical_url)
        LEFT JOIN first_fp USING (fp))
""".replace("FOLDED", "replace(lower(title), 'ß', 'ss') || chr(10) || " + collapse("body_text"))


def _revisions(spark, d):
    """Normalized revisions: some keep an article's URL, some carry provider ids."""
    a = dedup_material(t.articles(spark, d))
    i = F.col("article_id")
    return a.select(
        (i + 1_000_000).alias("raw_id"), "source_id",
        F.when(i % 4 == 0, F.concat(F.lit("x"), (i % 50).cast("string"))).otherwise("").alias("external_id"),
        F.when(i % 3 == 0, F.col("canonical_url")).otherwise(F.concat("canonical_url", F.lit("/new")))
        .alias("canonical_url"),
        "title", "description", "body_text", "byline", "published_at", "language",
        "content_fingerprint", "fingerprint_input_length",
        F.col("created_at"), F.col("created_at").alias("fetched_at"))


def dedup_material(articles):
    from ..functions.text import fingerprint_input

    finger = fingerprint_input("title", "body_text", "description")
    return articles.withColumn("content_fingerprint", F.sha2(finger, 256)).withColumn(
        "fingerprint_input_length", F.length(finger))


def _stored(spark, d):
    i = F.col("article_id")
    return dedup_material(t.articles(spark, d)).filter(i % 2 == 0).drop("fingerprint_input_length").withColumn(
        "external_id", F.when(i % 8 == 0, F.concat(F.lit("x"), (i % 50).cast("string"))).otherwise(""))


@query("identity_candidates", f"WITH {_NORMAL_SQL} SELECT raw_id, e, u, f FROM c")
def identity_candidates(spark, d):
    return dedup.identity_candidates(_revisions(spark, d), _stored(spark, d)).select(
        "raw_id", F.col("by_external_id.article_id").alias("e"),
        F.col("by_canonical_url.article_id").alias("u"), F.col("by_fingerprint.article_id").alias("f"))


@query("dedup_decide", f"""WITH {_NORMAL_SQL}
    SELECT raw_id, CASE WHEN e IS NOT NULL AND u IS NOT NULL AND u <> e THEN
        CASE WHEN us.source_id <> c.source_id THEN 'SOURCE_IDENTITY_CONFLICT' ELSE 'IDENTITY_CONFLICT' END
      WHEN e IS NOT NULL AND es.canonical_url = c.canonical_url AND es.fp = c.fp THEN 'IDENTITY_DUPLICATE'
      WHEN e IS NOT NULL THEN 'UPDATE' WHEN us.source_id <> c.source_id THEN 'SOURCE_IDENTITY_CONFLICT'
      WHEN us.fp = c.fp THEN 'IDENTITY_DUPLICATE' WHEN u IS NOT NULL THEN 'UPDATE'
      WHEN f IS NOT NULL AND fs.canonical_url <> c.canonical_url THEN 'CONTENT_DUPLICATE' ELSE 'CREATE' END AS decision
    FROM c LEFT JOIN stored es ON es.article_id = e LEFT JOIN stored us ON us.article_id = u
      LEFT JOIN stored fs ON fs.article_id = f""")
def dedup_decide(spark, d):
    return dedup.dedup_decide(_revisions(spark, d), _stored(spark, d)).select("raw_id", "decision")


@query("process_raw")
def process_raw(spark, d):
    """All revisions in order: outcomes and links."""
    stored = _stored(spark, d).withColumn("duplicate_of", F.lit(None).cast("long"))
    raw, _, _ = dedup.process_raw(_revisions(spark, d), stored)
    return raw.select("raw_id", "status", "outcome", "article_id")


# --- synthesis ---------------------------------------------------------------------


@query("story_input_cap", f"""
    SELECT story_id, article_id, position, length(text) AS chars FROM (
      SELECT story_id, article_id, row_number() OVER (
          PARTITION BY story_id ORDER BY event_time, article_id) AS position,
        rtrim(substr(array_to_string(list_filter([{collapse('title')}, {collapse('body_text')}],
          lambda x: x <> ''), chr(10) || chr(10)), 1, 4000)) AS text
      FROM member JOIN article USING (article_id)) WHERE position <= 7""")
def story_input_cap(spark, d):
    """The bounded input itself: the earliest members and their first characters."""
    from ..operators.enrich import member_text

    return member_text(t.text_membership(spark, d), t.articles(spark, d), max_articles=7, max_chars=4000).select(
        "story_id", "article_id", F.col("position").cast("long").alias("position"),
        F.length("text").cast("long").alias("chars"))


_CLAIM_SQL = f"""
    WITH inp AS (SELECT story_id, article_id, row_number() OVER (
        PARTITION BY story_id ORDER BY event_time, article_id) AS position, {collapse('title')} AS title,
        {collapse('body_text')} AS text, {SENTENCES} AS ss FROM member JOIN article USING (article_id)),
    line AS (SELECT story_id, article_id, position, -1 AS ord, title AS line FROM inp
      UNION ALL SELECT story_id, article_id, position, i - 1, ss[i] FROM (
        SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM inp)),
    claim AS (SELECT *, {figures_sql('line')} AS figures, {content_sql('line')} AS words FROM line),
    figured AS (SELECT * FROM claim WHERE len(figures) > 0),
    contested AS (SELECT DISTINCT a.story_id, a.article_id, a.ord FROM figured a JOIN figured b
      ON a.story_id = b.story_id AND a.article_id <> b.article_id AND a.figures <> b.figures
      WHERE len(list_intersect(a.words, b.words)) >= 2 AND len(list_intersect(a.words, b.words)) * 2
        >= greatest(least(len(a.words), len(b.words)), 1))
"""


def _inputs(spark, d):
    return synthesis.synthesis_input(t.text_membership(spark, d), t.articles(spark, d), max_chars=None)


@query("contested_claims", _CLAIM_SQL + "SELECT * FROM contested")
def contested_claims(spark, d):
    found = synthesis.contested_claims(synthesis.claims(_inputs(spark, d)))
    return found.select("story_id", "article_id", F.col("ord").cast("long").alias("ord"))


_LEAD_SQL = _CLAIM_SQL + """,
    usable AS (SELECT * FROM line WHERE (story_id, article_id, ord) NOT IN (
      SELECT (story_id, article_id, ord) FROM contested)),
    title AS (SELECT story_id, arg_min(line, position) AS line FROM usable WHERE ord = -1 AND line <> ''
      GROUP BY story_id),
    first AS (SELECT story_id, article_id, position, ord, line FROM usable WHERE ord >= 0
      QUALIFY row_number() OVER (PARTITION BY story_id, article_id ORDER BY ord) = 1),
    lead AS (SELECT story_id, line, row_number() OVER (PARTITION BY story_id ORDER BY pos) AS r FROM (
      SELECT story_id, line, min((position, ord)) AS pos FROM first GROUP BY ALL) QUALIFY r <= 3),
    ctx AS (SELECT story_id, line, row_number() OVER (PARTITION BY story_id ORDER BY pos) AS r FROM (
      SELECT story_id, line, min((position, ord)) AS pos FROM usable WHERE ord >= 0 AND (story_id, line) NOT IN (
        SELECT (story_id, line) FROM lead) GROUP BY ALL) QUALIFY r <= 4),
    chosen AS (SELECT story_id, 'TITLE' AS kind, 0 AS position, line AS text FROM title
      UNION ALL SELECT story_id, 'SUMMARY', r - 1, line FROM lead
      UNION ALL SELECT story_id, 'CONTEXT', r - 1, line FROM ctx)
"""


@query("lead_sentences", _LEAD_SQL + """
    SELECT story_id, kind, position, text FROM chosen WHERE story_id IN (SELECT story_id FROM title)""")
def lead_sentences(spark, d):
    lines = cut_lineage(synthesis.claims(_inputs(spark, d)))
    rows = synthesis.lead_sentences(lines, synthesis.contested_claims(lines))
    return rows.withColumn("position", F.col("position").cast("long"))


@query("sentence_supporters", _LEAD_SQL + """
    SELECT c.story_id, c.kind, c.position, string_agg(i.article_id, ',' ORDER BY i.position) AS supporters
    FROM chosen c JOIN inp i ON i.story_id = c.story_id
      AND CASE WHEN c.kind = 'TITLE' THEN i.title = c.text ELSE contains(i.text, c.text) END
    WHERE c.story_id IN (SELECT story_id FROM title) GROUP BY c.story_id, c.kind, c.position""")
def sentence_supporters(spark, d):
    rows = synthesis.synthesize(t.text_membership(spark, d), t.articles(spark, d), max_chars=None)
    return rows.select("story_id", "kind", F.col("position").cast("long").alias("position"),
                       F.array_join(F.col("article_ids").cast("array<string>"), ",").alias("supporters"))


@query("synthesis_udf", _CLAIM_SQL + """,
    offer AS (SELECT story_id, article_id, position, 'TITLE' AS kind, 0 AS ord, title AS text FROM inp WHERE title <> ''
      UNION ALL SELECT story_id, article_id, position, 'SUMMARY', i - 1, ss[i] FROM (
        SELECT *, unnest(range(1, least(len(ss), 2) + 1)) AS i FROM inp)),
    ranked AS (SELECT story_id, kind, text, row_number() OVER (PARTITION BY story_id, kind ORDER BY min((position, ord)), text) - 1 AS position
      FROM offer GROUP BY story_id, kind, text)
    SELECT r.story_id, r.kind, r.position, r.text, string_agg(DISTINCT o.article_id::VARCHAR, ',') AS cited
    FROM ranked r JOIN (SELECT story_id, kind, text, article_id FROM offer) o USING (story_id, kind, text)
    WHERE r.position < CASE kind WHEN 'TITLE' THEN 1 ELSE 3 END GROUP BY ALL""".replace(
        "string_agg(DISTINCT o.article_id::VARCHAR, ',')",
        "array_to_string(list_transform(list_sort(list_distinct(list(o.article_id))), lambda x: x::VARCHAR), ',')"))
def synthesis_udf(spark, d):
    """A user synthesizer through the hook, then the output rules, which refuse none here."""
    inputs = _inputs(spark, d)
    rows = cut_lineage(synthesis.synthesize_with(inputs, first_lines))
    bad = synthesis.invalid_syntheses(rows, inputs)
    return rows.join(bad, "story_id", "left_anti").select(
        "story_id", "kind", F.col("position").cast("long").alias("position"), "text",
        F.array_join(F.array_sort(F.col("article_ids")).cast("array<string>"), ",").alias("cited"))


def first_lines(members):
    """A synthesizer: each member offers its title and its first two whole sentences."""
    import re

    import pandas as pd

    rows = []
    for story, article, title, text in members[["story_id", "article_id", "title", "text"]].itertuples(index=False):
        lines = [s for s in re.split("(?<=[.!?]) (?=[\"“‘'A-Z0-9])", text)
                 if re.search("[.!?]$", re.sub("[\"”’']+$", "", s)) and len(s.split(" ")) >= policy.MIN_SENTENCE_WORDS
                 and len(s) <= policy.MAX_SENTENCE_CHARS]
        rows += [(story, article, "TITLE", 0, title)] if title else []
        rows += [(story, article, "SUMMARY", i, s) for i, s in enumerate(lines[:2])]
    return pd.DataFrame(rows, columns=["story_id", "article_id", "kind", "ord", "text"])


_LABEL_SQL = """, support AS (SELECT story_id, label, count(DISTINCT article_id) AS a FROM said GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY a DESC, label) AS rank FROM support QUALIFY rank <= LIMIT),
    sized AS (SELECT top.*, a / m AS score FROM top JOIN (
      SELECT story_id, count(*) AS m FROM member GROUP BY story_id) USING (story_id)),
    keyed AS (SELECT *, KEY AS key FROM sized WHERE story_id NOT IN (SELECT story_id FROM sized WHERE KEY = ''))"""


@query("topic_udf", MENTION_SQL + """,
    said AS (SELECT story_id, article_id, list_max(list_transform(regexp_extract_all(text, '\\S+'),
        lambda x: {'n': length(x), 'w': x})).w AS label FROM txt WHERE regexp_matches(text, '\\S'))""" + _LABEL_SQL.replace(
        "LIMIT", "8").replace("KEY", f"""substr(regexp_replace(regexp_replace(strip_accents({name_key('label')}),
          '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', '-', 'g').trim('-'), 1, 100)""") + """
    SELECT story_id, key AS slug, arg_max(substr(label, 1, 100), rank) AS label, round(max(score), 6) AS score
    FROM keyed GROUP BY story_id, key""")
def topic_udf(spark, d):
    """A user topic extractor through the hook."""
    rows = cut_lineage(extract_with(story_texts(spark, d), longest_word, "label string", policy.MAX_TOPICS))
    return merge_topics(valid_scores(rows)).select("story_id", "slug", "label", F.round("score", 6).alias("score"))


def longest_word(members):
    """A topic extractor: the longest word of each member, of equally long ones the last in code-point order."""
    found = members.assign(label=members["text"].map(
        lambda s: max(s.split(), key=lambda x: (len(x), x), default=None)))
    return found[["story_id", "article_id", "label"]].dropna()


@query("entity_udf", MENTION_SQL + """,
    said AS (SELECT story_id, article_id, unnest(list_filter(regexp_extract_all(text, '\\S+'),
        lambda x: length(x) > 1 AND regexp_matches(x, '^[A-Z0-9.-]*[A-Z][A-Z0-9.-]*$'))) AS label FROM txt)""" + _LABEL_SQL.replace(
        "LIMIT", "20").replace("KEY", f"substr({name_key('label')}, 1, 200)") + """
    SELECT story_id, 'OTHER' AS kind, key, arg_min(substr(label, 1, 200), rank) AS name, round(max(score), 6) AS score
    FROM keyed GROUP BY story_id, key""")
def entity_udf(spark, d):
    """A user entity extractor through the hook."""
    rows = cut_lineage(extract_with(story_texts(spark, d), shouted_words, "kind string, name string", policy.MAX_ENTITIES))
    return merge_entities(valid_scores(rows)).select("story_id", "kind", "key", "name", F.round("score", 6).alias("score"))


def shouted_words(members):
    """An entity extractor: the words in plain capitals."""
    import re

    shout = re.compile("(?=.*[A-Z])[A-Z0-9.-]{2,}").fullmatch
    rows = [(story, article, "OTHER", w) for story, article, text in
            members[["story_id", "article_id", "text"]].itertuples(index=False) for w in {*text.split()} if shout(w)]
    import pandas as pd

    return pd.DataFrame(rows, columns=["story_id", "article_id", "kind", "name"])


@query("current_generation", """
    SELECT synthesis_id, story_id, synthesis_id % 2 = 1 AS is_current FROM synth""")
def current_generation(spark, d):
    return synthesis.current_generation(t.text_syntheses(spark, d)).select("synthesis_id", "story_id", "is_current")


@query("element_positions", """
    SELECT synthesis_id, kind, ord, row_number() OVER (PARTITION BY synthesis_id, kind ORDER BY ord) - 1 AS position,
      CASE kind WHEN 'TITLE' THEN 0 WHEN 'SUMMARY' THEN 1 ELSE 2 END AS kind_order FROM element""")
def element_positions(spark, d):
    return synthesis.element_positions(t.text_elements(spark, d)).select(
        "synthesis_id", "kind", "ord", F.col("position").cast("long").alias("position"),
        F.col("kind_order").cast("long").alias("kind_order"))


# --- story state -------------------------------------------------------------------


@query("member_signature", """
    SELECT story_id, count(*) AS member_count, sha256(concat_ws('|', """ + ", ".join(
        f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)::VARCHAR" for i in range(8)) + """)) AS member_signature
    FROM (SELECT story_id, sha256(article_id || ':' || strftime(first_seen_at, '%Y-%m-%dT%H:%M:%S') || '+00:00') AS h
      FROM member JOIN article USING (article_id)) GROUP BY story_id""")
def member_signature(spark, d):
    rows = t.text_membership(spark, d).join(t.article_times(spark, d), "article_id")
    return refresh.member_signature(rows)


@query("story_counters", """
    SELECT story_id, count(DISTINCT article_id) AS article_count, count(DISTINCT source_id) AS source_count,
      epoch(min(event_time))::BIGINT AS first_t, epoch(max(event_time))::BIGINT AS last_t
    FROM member JOIN article USING (article_id) GROUP BY story_id""")
def story_counters(spark, d):
    return refresh.story_counters(t.text_membership(spark, d), t.articles(spark, d)).select(
        "story_id", "article_count", "source_count", F.unix_timestamp("first_published_at").alias("first_t"),
        F.unix_timestamp("last_published_at").alias("last_t"))


@query("live_member_counts", """
    SELECT story_id, count(DISTINCT article_id) AS articles, count(DISTINCT source_id) AS sources
    FROM member JOIN article USING (article_id) GROUP BY story_id""")
def live_member_counts(spark, d):
    return refresh.story_counters(t.text_membership(spark, d), t.articles(spark, d)).select(
        "story_id", F.col("article_count").alias("articles"), F.col("source_count").alias("sources"))


@query("counter_drift", """
    SELECT story_id, story.article_count, story.source_count, a AS live_articles, s AS live_sources
    FROM story JOIN (SELECT story_id, count(DISTINCT article_id) AS a, count(DISTINCT source_id) AS s
      FROM member JOIN article USING (article_id) GROUP BY story_id) USING (story_id)
    WHERE story.article_count <> a OR story.source_count <> s""")
def counter_drift(spark, d):
    return refresh.counter_drift(t.text_stories(spark, d), t.text_membership(spark, d), t.articles(spark, d)).select(
        "story_id", "article_count", "source_count", "live_articles", "live_sources")


@query("mark_stale", """
    SELECT story_id, CASE WHEN hit THEN 'STALE' ELSE refresh_state END AS refresh_state,
      CASE WHEN hit THEN '' ELSE refresh_error END AS refresh_error
    FROM (SELECT *, story_id IN (SELECT story_id FROM member WHERE article_id % 30 = 0) AS hit FROM story)""")
def mark_stale(spark, d):
    touched = t.text_membership(spark, d).filter("article_id % 30 = 0")
    return refresh.mark_stale(t.text_stories(spark, d), touched).select("story_id", "refresh_state", "refresh_error")


@query("refresh_select", """
    SELECT story_id, refresh_state FROM story WHERE refresh_state IN ('STALE', 'FAILED') ORDER BY story_id LIMIT 25""")
def refresh_select(spark, d):
    return refresh.refresh_select(t.text_stories(spark, d), 25).select("story_id", "refresh_state")


@query("refresh_stories", _LEAD_SQL + f"""
    , {MENTION_SQL.strip().removeprefix("WITH ")}{TOPIC_PARTS}{ENTITY_PARTS}
    , titled AS (SELECT story_id FROM title), cnt AS (SELECT story_id, count(*) AS a, count(DISTINCT source_id) AS s
      FROM member JOIN article USING (article_id) GROUP BY story_id),
    made AS (SELECT story_id FROM story WHERE refresh_state <> 'CURRENT' AND story_id IN (SELECT story_id FROM titled)),
    made_topic AS (SELECT story_id, least(count(DISTINCT word), 8) AS topics FROM topic GROUP BY story_id),
    made_entity AS (SELECT story_id, count(DISTINCT kind || '/' || substr(key, 1, 200)) AS entities FROM scored GROUP BY story_id),
    made_element AS (SELECT story_id, count(*) AS elements FROM chosen GROUP BY story_id)
    SELECT story_id, status, CASE WHEN refresh_state = 'CURRENT' THEN 'CURRENT' WHEN titled.story_id IS NOT NULL
        THEN 'CURRENT' ELSE 'FAILED' END AS refresh_state,
      CASE WHEN refresh_state <> 'CURRENT' AND titled.story_id IS NOT NULL THEN a ELSE story.article_count END
        AS article_count,
      CASE WHEN refresh_state <> 'CURRENT' AND titled.story_id IS NOT NULL THEN s ELSE story.source_count END
        AS source_count,
      CASE WHEN made.story_id IS NULL THEN 0 ELSE 1 END AS vectors,
      CASE WHEN made.story_id IS NULL THEN 0 ELSE coalesce(topics, 0) END AS topics,
      CASE WHEN made.story_id IS NULL THEN 0 ELSE coalesce(entities, 0) END AS entities,
      CASE WHEN made.story_id IS NULL THEN 0 ELSE elements END AS elements
    FROM story JOIN cnt USING (story_id) LEFT JOIN titled USING (story_id) LEFT JOIN made USING (story_id)
      LEFT JOIN made_topic USING (story_id) LEFT JOIN made_entity USING (story_id) LEFT JOIN made_element USING (story_id)""")
def refresh_stories(spark, d):
    """A whole generation for the stale stories, with the hash embedding: all its tables are published, and each
    story comes with the numbers of its rows in them."""
    arts = t.articles(spark, d)
    emb = embed.embed_articles(arts, t.vector_embeddings(spark, d).filter("false"), max_chars=None)
    made = refresh.refresh_stories(t.text_stories(spark, d), t.text_membership(spark, d), arts, emb,
                                   max_chars=None, now="2024-06-01 00:00:00")
    root = scratch_folder(spark)
    number = layout.publish_generation(spark, root, made)
    rows = layout.read_generation(spark, root, "stories", number).select(
        "story_id", "status", "refresh_state", "article_count", "source_count")
    parts = {"story_emb": "vectors", "topics": "topics", "entities": "entities", "elements": "elements"}
    for table, name in parts.items():
        rows = rows.join(layout.read_generation(spark, root, table, number).groupBy("story_id").agg(
            F.count("*").alias(name)), "story_id", "left")
    return rows.fillna(0, [*parts.values()])


@query("refresh_elements", _LEAD_SQL + """
    SELECT story_id, count(*) AS elements, count(*) FILTER (kind = 'SUMMARY') AS summary FROM chosen
    WHERE story_id IN (SELECT story_id FROM title)
      AND story_id IN (SELECT story_id FROM story WHERE refresh_state <> 'CURRENT') GROUP BY story_id""")
def refresh_elements(spark, d):
    arts = t.articles(spark, d)
    emb = embed.embed_articles(arts, t.vector_embeddings(spark, d).filter("false"), max_chars=None)
    made = refresh.refresh_stories(t.text_stories(spark, d), t.text_membership(spark, d), arts, emb,
                                   max_chars=None, now="2024-06-01 00:00:00")
    return made["elements"].groupBy("story_id").agg(
        F.count("*").alias("elements"), F.count_if(F.col("kind") == "SUMMARY").alias("summary"))


# --- reads -------------------------------------------------------------------------


def _generations(spark, d):
    return synthesis.current_generation(t.text_syntheses(spark, d))


def _elements(spark, d):
    return t.text_elements(spark, d).withColumn("cited", F.lit(1))


@query("live_story_semi", """
    SELECT story_id FROM story WHERE story_id IN (SELECT story_id FROM member) AND (story_id, member_signature) IN (
      SELECT (story_id, member_signature) FROM synth WHERE is_current)""")
def live_story_semi(spark, d):
    return read.live_story_semi(t.text_stories(spark, d), t.text_membership(spark, d), _generations(spark, d)).select(
        "story_id")


@query("feed_page", """
    SELECT story_id, epoch(created_at)::BIGINT AS created, row_number() OVER (
      ORDER BY created_at DESC, story_id DESC) - 1 AS slot FROM story
    WHERE status = 'ACTIVE' AND refresh_state = 'CURRENT' AND (story_id, member_signature) IN (
        SELECT (story_id, member_signature) FROM synth WHERE is_current)
      AND (created_at, story_id) <= (TIMESTAMP '2024-01-02 06:00:00', 61)
      AND (created_at, story_id) < (TIMESTAMP '2024-01-02 05:00:00', 58)
    ORDER BY created_at DESC, story_id DESC LIMIT 11""")
def feed_page(spark, d):
    """The page after story 58 under the watermark of story 61."""
    page = read.feed_page(
        t.text_stories(spark, d), _generations(spark, d), t.text_membership(spark, d),
        watermark=("2024-01-02 06:00:00", 61), last=("2024-01-02 05:00:00", 58), limit=10)
    return page.select("story_id", F.unix_timestamp("created_at").alias("created"),
                       F.col("slot").cast("long").alias("slot"))


@query("sources_page", """
    SELECT article_id FROM member WHERE story_id = 7 AND article_id > 86 ORDER BY article_id LIMIT 6""")
def sources_page(spark, d):
    signatures = t.text_stories(spark, d).select("story_id", "member_signature")
    return read.sources_page(t.text_membership(spark, d), signatures, 7, last_id=86, limit=5,
                             expected_signature="sig7").select("article_id")


@query("recent_stories", """
    SELECT story_id, refresh_state, coalesce(model_key, '') AS model FROM story LEFT JOIN (
      SELECT story_id, model_key FROM synth WHERE is_current) USING (story_id)
    WHERE refresh_state = 'CURRENT' ORDER BY created_at DESC, story_id DESC LIMIT 15""")
def recent_stories(spark, d):
    return read.recent_stories(t.text_stories(spark, d), _generations(spark, d), 15, "CURRENT").select(
        "story_id", "refresh_state", F.col("synthesis_model_key").alias("model"))


@query("generation_validity", "SELECT synthesis_id, story_id, valid, is_current FROM validity")
def generation_validity(spark, d):
    return read.generation_validity(_generations(spark, d), _elements(spark, d)).select(
        "synthesis_id", "story_id", "valid", "is_current")


@query("shown_topics", """
    WITH topic AS (SELECT DISTINCT story_id, 't' || article_id % 12 AS slug,
        CASE WHEN article_id % 5 = 0 OR story_id % 3 = 0 THEN 'old' ELSE 'sig' || story_id END AS member_signature FROM member),
      mine AS (SELECT * FROM topic JOIN story USING (story_id, member_signature))
    SELECT story_id, slug FROM mine WHERE story_id IN (SELECT story_id FROM mine GROUP BY story_id HAVING count(*) <= 9)""")
def shown_topics(spark, d):
    """Topics of the story's own signature, shown where there are no more than allowed."""
    i, s = F.col("article_id"), F.col("story_id")
    topics = t.text_membership(spark, d).select("story_id", F.concat(F.lit("t"), (i % 12).cast("string")).alias("slug"), F.when(
        (i % 5 == 0) | (s % 3 == 0), "old").otherwise(F.concat(F.lit("sig"), s.cast("string"))).alias("member_signature")).distinct()
    return read.shown_topics(topics, t.text_stories(spark, d), 9).select("story_id", "slug")


_STATE_SQL = """
    state AS (SELECT story.*, good.synthesis_id AS gid, CASE WHEN status <> 'ACTIVE' THEN 'UNAVAILABLE'
        WHEN good.synthesis_id IS NULL THEN 'PREPARING' WHEN refresh_state = 'CURRENT' THEN 'CURRENT'
        ELSE 'UPDATING' END AS content_state
      FROM story LEFT JOIN (SELECT * FROM validity WHERE valid AND is_current) good
        ON good.story_id = story.story_id AND good.member_signature = story.member_signature)
"""


@query("freshness_matrix", f"WITH {_STATE_SQL} SELECT story_id, content_state FROM state")
def freshness_matrix(spark, d):
    valid = read.generation_validity(_generations(spark, d), _elements(spark, d))
    return read.freshness_matrix(t.text_stories(spark, d), t.text_membership(spark, d), valid).select(
        "story_id", "content_state")


@query("story_detail", f"""WITH {_STATE_SQL}
    SELECT story_id, content_state, gid AS synthesis_id,
      CASE WHEN gid IS NULL THEN 'Story being prepared' ELSE title END AS title,
      CASE WHEN gid IS NULL THEN 0 ELSE article_count END AS article_count,
      CASE WHEN gid IS NULL THEN 0 ELSE source_count END AS source_count, ca AS current_article_count,
      cs AS current_source_count, CASE WHEN gid IS NULL THEN 0 ELSE cited END AS cited_count
    FROM state JOIN (SELECT story_id, count(DISTINCT article_id) AS ca, count(DISTINCT source_id) AS cs
        FROM member JOIN article USING (article_id) GROUP BY story_id) USING (story_id)
      LEFT JOIN (SELECT synthesis_id, min(text) FILTER (kind = 'TITLE') AS title,
        count(DISTINCT article_id) AS cited FROM element GROUP BY synthesis_id) e ON e.synthesis_id = gid
    WHERE content_state <> 'UNAVAILABLE'""")
def story_detail(spark, d):
    valid = read.generation_validity(_generations(spark, d), _elements(spark, d))
    return read.story_detail(t.text_stories(spark, d), t.text_membership(spark, d), t.articles(spark, d), valid,
                             t.text_elements(spark, d))


@query("card_projection", f"""WITH {_STATE_SQL},
    topic AS (SELECT DISTINCT story_id, 't' || article_id % 11 AS slug, 'T' || article_id % 11 AS label, (article_id % 11) % 3 AS score,
        CASE WHEN story_id % 3 = 0 AND article_id % 11 > 4 THEN 'old' ELSE 'sig' || story_id END AS member_signature FROM member),
    tl AS (SELECT story_id, member_signature, CASE WHEN count(*) > 8 THEN '' ELSE string_agg(slug || '=' || label, ',' ORDER BY score DESC, slug) END
      AS topics FROM topic GROUP BY ALL)
    SELECT story_id, CASE WHEN gid IS NULL THEN 'PREPARING' WHEN refresh_state = 'CURRENT' THEN 'CURRENT'
        ELSE 'UPDATING' END AS content_state,
      CASE WHEN gid IS NULL THEN 'Story being prepared' ELSE title END AS title,
      CASE WHEN gid IS NULL THEN NULL ELSE kinds END AS kinds,
      CASE WHEN gid IS NULL THEN '' ELSE coalesce(topics, '') END AS topics
    FROM (SELECT * FROM state) LEFT JOIN (SELECT synthesis_id, min(text) FILTER (kind = 'TITLE') AS title,
      string_agg(kind, ',' ORDER BY ord) AS kinds FROM element GROUP BY synthesis_id) e ON e.synthesis_id = gid
      LEFT JOIN tl USING (story_id, member_signature)""")
def card_projection(spark, d):
    """Cards with elements and the topics of their generation; some stories have too many topics, or older ones."""
    el = synthesis.element_positions(t.text_elements(spark, d)).withColumn(
        "article_ids", F.array("article_id"))
    n, s = F.col("article_id") % 11, F.col("story_id")
    topics = t.text_membership(spark, d).select(
        "story_id", F.concat(F.lit("t"), n.cast("string")).alias("slug"), F.concat(F.lit("T"), n.cast("string")).alias("label"),
        (n % 3).alias("score"), F.when((s % 3 == 0) & (n > 4), "old").otherwise(
            F.concat(F.lit("sig"), s.cast("string"))).alias("member_signature")).distinct()
    cards = read.card_projection(t.text_stories(spark, d), _generations(spark, d), el, topics)
    return cards.select("story_id", "content_state", "title", F.array_join(
        F.transform("elements", lambda e: e["kind"]), ",").alias("kinds"), F.array_join(F.transform(
            "topics", lambda x: F.concat(x["slug"], F.lit("="), x["label"])), ",").alias("topics"))


@query("citations", """
    SELECT DISTINCT story_id, article_id, slug, article_id % 5 <> 0 AS is_current_member
    FROM element JOIN article USING (article_id) JOIN source_t USING (source_id)""")
def citations(spark, d):
    shown, _ = read.citations(t.text_elements(spark, d), t.articles(spark, d), t.sources(spark, d),
                              t.text_membership(spark, d).filter("article_id % 5 <> 0"))
    return shown.select("story_id", "article_id", "slug", "is_current_member")


@query("citation_except", """
    SELECT DISTINCT story_id, article_id FROM element WHERE article_id NOT IN (SELECT vec_id FROM embeddings)""")
def citation_except(spark, d):
    """Cited publications absent from a smaller article table (ids that have vectors)."""
    some = t.articles(spark, d).join(t.vector_embeddings(spark, d).select("article_id"), "article_id", "left_semi")
    _, lost = read.citations(t.text_elements(spark, d), some, t.sources(spark, d), t.text_membership(spark, d))
    return lost


@query("story_members_report", """
    SELECT m.story_id, m.article_id, a.source_id, epoch(a.event_time)::BIGINT AS t, m.method,
      round(1 - m.similarity, 6) AS distance, e.article_id IS NOT NULL AS cited
    FROM member m JOIN article a USING (article_id)
      LEFT JOIN (SELECT DISTINCT story_id, article_id FROM element) e
        ON e.story_id = m.story_id AND e.article_id = m.article_id""")
def story_members_report(spark, d):
    rows = read.story_members_report(t.text_membership(spark, d), t.articles(spark, d), t.text_elements(spark, d))
    return rows.select("story_id", "article_id", "source_id", F.unix_timestamp("event_time").alias("t"), "method",
                       F.round("distance", 6).alias("distance"), "cited")


# --- quality -----------------------------------------------------------------------


def _labels(spark, d):
    e = t.read(spark, d, "embeddings")
    expected = e.select(F.col("vec_id").alias("article_id"),
                        F.concat(F.lit("event"), F.col("label").cast("string")).alias("expected_event"))
    return expected, _candidates(spark, d, k=1).select("article_id", "story_id")


_QUALITY_SQL = _CAND_SQL + """,
    cell AS (SELECT 'event' || label AS e, story_id, count(*) AS n FROM embeddings
      LEFT JOIN (SELECT article_id, story_id FROM cand WHERE rank = 1) ON article_id = vec_id GROUP BY ALL)
"""


@query("pairwise_quality", _QUALITY_SQL + """,
    x AS (SELECT (SELECT sum(n * (n - 1) // 2) FROM (SELECT sum(n) AS n FROM cell GROUP BY e))::BIGINT AS expected,
      (SELECT sum(n * (n - 1) // 2) FROM (SELECT sum(n) AS n FROM cell WHERE story_id IS NOT NULL GROUP BY e))::BIGINT
        AS placed,
      (SELECT sum(n * (n - 1) // 2) FROM (SELECT sum(n) AS n FROM cell WHERE story_id IS NOT NULL
        GROUP BY story_id))::BIGINT AS predicted,
      (SELECT sum(n * (n - 1) // 2) FROM cell WHERE story_id IS NOT NULL)::BIGINT AS truly,
      (SELECT coalesce(sum(n), 0) FROM cell WHERE story_id IS NULL)::BIGINT AS unassigned)
    SELECT round(truly / predicted, 6) AS precision, round(truly / expected, 6) AS recall,
      expected AS expected_pair_count, predicted AS predicted_pair_count, truly AS true_pair_count,
      predicted - truly AS false_merge_count, round((predicted - truly) / predicted, 6) AS false_merge_rate,
      placed - truly AS false_split_count, round((placed - truly) / expected, 6) AS false_split_rate,
      unassigned AS unassigned_count FROM x""")
def pairwise_quality(spark, d):
    expected, assigned = _labels(spark, d)
    q = quality.pairwise_quality(expected, assigned)
    return q.select(*[F.round(c, 6).alias(c) if c in (
        "precision", "recall", "false_merge_rate", "false_split_rate") else F.col(c) for c in q.columns])


@query("stray_assignments", "SELECT vec_id AS article_id FROM embeddings WHERE label % 4 = 1")
def stray_assignments(spark, d):
    """Assigned articles whose event nobody stated."""
    known = t.read(spark, d, "embeddings").filter("label % 4 <> 1").select(F.col("vec_id").alias("article_id"))
    return quality.stray_assignments(known, t.vector_membership(spark, d))


@query("quality_offenders", _QUALITY_SQL + """
    SELECT 'merge' AS type, a.story_id, a.e AS first_event, b.e AS second_event, a.n * b.n AS pair_count
    FROM cell a JOIN cell b ON a.story_id = b.story_id AND a.e < b.e
    UNION ALL SELECT 'split', count(*), e, '', ((sum(n) * (sum(n) - 1)) // 2 - sum(n * (n - 1) // 2))::BIGINT
    FROM cell WHERE story_id IS NOT NULL GROUP BY e HAVING count(*) > 1""")
def quality_offenders(spark, d):
    expected, assigned = _labels(spark, d)
    merges = quality.false_merges(expected, assigned).select(
        F.lit("merge").alias("type"), "story_id", "first_event", "second_event", "pair_count")
    splits = quality.false_splits(expected, assigned).select(
        F.lit("split").alias("type"), F.col("story_count").alias("story_id"),
        F.col("expected_event").alias("first_event"), F.lit("").alias("second_event"), "pair_count")
    return merges.unionByName(splits)
