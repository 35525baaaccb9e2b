"""Product reads: feed, saved and source pages, cards, story detail and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import policy
from ..functions.text import collapse
from ..functions.urls import safe_link
from .skew import top_rows
from .synthesis import kind_order

TITLE_CHARS, BYLINE_CHARS = 500, 512


def _keyset(df: DataFrame, time: str, key: str, last, watermark) -> DataFrame:
    """Rows at or before `watermark` and strictly after `last` in (time desc, key desc) order."""
    at = F.struct(F.col(time), F.col(key))
    pair = lambda p: F.struct(F.lit(p[0]).cast("timestamp").alias(time),
                              F.lit(p[1]).cast("long").alias(key))
    if watermark is not None:
        df = df.filter(at <= pair(watermark))
    if last is not None:
        df = df.filter(at < pair(last))
    return df.orderBy(F.desc(time), F.desc(key))


def live_story_semi(stories: DataFrame, membership: DataFrame, syntheses: DataFrame | None = None) -> DataFrame:
    """Stories with a member and, given generations, with a current one of the same signature."""
    live = stories.join(membership.select("story_id"), "story_id", "left_semi")
    if syntheses is None:
        return live
    current = syntheses.filter("is_current").select("story_id", "member_signature")
    return live.join(current, ["story_id", "member_signature"], "left_semi")


def feed_page(stories: DataFrame, syntheses: DataFrame, membership: DataFrame, *, watermark=None,
              last=None, limit: int = 20, elements: DataFrame | None = None) -> DataFrame:
    """One page of CURRENT stories, newest first, with one row more than `limit` telling that
    there is a next page (`is_extra`). With `elements`, cards of unusable generations are left out."""
    open_ = stories.filter("status = 'ACTIVE' AND refresh_state = 'CURRENT'")
    page = _keyset(live_story_semi(open_, membership, syntheses), "created_at", "story_id",
                   last, watermark).limit(limit + 1)
    from pyspark.sql import Window

    # at most limit + 1 rows reach this window
    slot = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("created_at"), F.desc("story_id")))
    page = page.withColumn("slot", slot - 1).withColumn("is_extra", F.col("slot") >= limit)
    if elements is None:
        return page
    good = generation_validity(syntheses, elements).filter("valid AND is_current").select(
        "story_id", "member_signature")
    return page.join(good, ["story_id", "member_signature"], "left_semi")


def saved_order(bookmarks: DataFrame, user_id, *, watermark=None, last=None, limit: int = 20) -> DataFrame:
    """One user's bookmarks by (created_at, story id) descending, limit + 1 rows."""
    return _keyset(bookmarks.filter(F.col("user_id") == user_id), "created_at", "story_id",
                   last, watermark).limit(limit + 1)


def saved_page(bookmarks: DataFrame, stories: DataFrame, membership: DataFrame) -> DataFrame:
    """Bookmarks with `availability`: AVAILABLE with its card state, or a tombstone."""
    cards = live_story_semi(stories.filter("status = 'ACTIVE'"), membership).select(
        "story_id", "language", F.lit(True).alias("_card"))
    return bookmarks.join(cards, "story_id", "left").withColumn(
        "availability", F.when(F.col("_card"), "AVAILABLE").otherwise("UNAVAILABLE")).drop("_card")


def viewer_flag(cards: DataFrame, bookmarks: DataFrame, user_id) -> DataFrame:
    mine = bookmarks.filter(F.col("user_id") == user_id).select("story_id", F.lit(True).alias("_b"))
    return cards.join(mine, "story_id", "left").withColumn(
        "bookmarked", F.col("_b").isNotNull()).drop("_b")


def sources_page(membership: DataFrame, signatures: DataFrame, story_id: int, *, last_id: int | None = None,
                 limit: int = 20, expected_signature: str | None = None) -> DataFrame:
    """Current members of a story by article id, limit + 1 rows with `member_signature`; rows
    fail if the membership changed since the first page (`expected_signature`)."""
    rows = membership.filter(F.col("story_id") == story_id).select("story_id", "article_id").join(
        signatures.filter(F.col("story_id") == story_id).select("story_id", "member_signature"), "story_id")
    if expected_signature is not None:
        rows = rows.filter(F.when(F.col("member_signature") == expected_signature, True).otherwise(
            F.raise_error(F.lit("membership changed")).cast("boolean")))
    if last_id is not None:
        rows = rows.filter(F.col("article_id") > last_id)
    return rows.orderBy("article_id").limit(limit + 1)


def recent_stories(stories: DataFrame, syntheses: DataFrame, last: int,
                   refresh_state: str | None = None) -> DataFrame:
    if not 1 <= last <= 1000:
        raise ValueError("last must be 1..1000")
    picked = stories if refresh_state is None else stories.filter(F.col("refresh_state") == refresh_state)
    current = syntheses.filter("is_current").select("story_id", F.col("model_key").alias("synthesis_model_key"))
    newest = picked.orderBy(F.desc("created_at"), F.desc("story_id")).limit(last)
    return newest.join(current, "story_id", "left").fillna("", ["synthesis_model_key"])


# --- projections -------------------------------------------------------------------


def source_row(articles: DataFrame, sources: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Publication rows as shown: clamped texts, safe link, member flag."""
    text = lambda c, n: F.substring(collapse(c), 1, n)
    by = text("byline", BYLINE_CHARS)
    rows = articles.join(sources.select("source_id", "name", "slug"), "source_id").select(
        "article_id", text("title", TITLE_CHARS).alias("title"),
        safe_link("canonical_url").alias("canonical_url"),
        F.struct("source_id", "name", "slug").alias("source"), "published_at", "first_seen_at",
        F.when(by != "", by).alias("byline"),
        *([F.col("duplicate_of")] if "duplicate_of" in articles.columns else []))
    if members is None:
        return rows.withColumn("is_current_member", F.lit(True))
    current = members.select("article_id", F.lit(True).alias("_m")).distinct()
    return rows.join(current, "article_id", "left").withColumn(
        "is_current_member", F.col("_m").isNotNull()).drop("_m")


def card_elements(elements: DataFrame, max_elements: int = policy.MAX_ELEMENTS) -> DataFrame:
    """(synthesis_id, title, elements array in reading order); elements: synthesis_id, kind,
    position, text, article_ids. A generation holds at most `max_elements` rows; larger ones
    are not shown, so no group grows beyond that."""
    sizes = elements.groupBy("synthesis_id").agg(F.count("*").alias("_n")).filter(
        F.col("_n") <= max_elements).select("synthesis_id")
    return elements.join(sizes, "synthesis_id", "left_semi").groupBy("synthesis_id").agg(
        F.min(F.when(F.col("kind") == "TITLE", F.col("text"))).alias("title"),
        F.sort_array(F.collect_list(F.struct(
            kind_order().alias("o"), "position", "kind", "text", "article_ids"))).alias("_e"),
    ).select("synthesis_id", "title", F.transform("_e", lambda e: F.struct(
        e["kind"].alias("kind"), e["position"].alias("position"), e["text"].alias("text"),
        e["article_ids"].alias("article_ids"))).alias("elements"))


def topic_lists(topics: DataFrame, n: int = policy.MAX_TOPICS) -> DataFrame:
    """(story_id, member_signature, topics array<struct<slug, label>>) by score, then slug; empty where there are more
    than n. At most n + 1 topics of a signature are gathered."""
    key = ["story_id", "member_signature"]
    kept = top_rows(topics.select(*key, "slug", "label", "score"), key, [F.desc("score"), "slug"], n + 1)
    rows = F.array_sort(F.collect_list(F.struct("rank", "slug", "label")))
    return kept.groupBy(*key).agg(rows.alias("_t")).select(*key, F.when(F.size("_t") <= n, F.transform(
        "_t", lambda x: F.struct(x["slug"].alias("slug"), x["label"].alias("label")))).alias("topics"))


def card_projection(stories: DataFrame, syntheses: DataFrame, elements: DataFrame,
                    topics: DataFrame | None = None) -> DataFrame:
    """The product fields of a card; a story without a usable generation is a placeholder.

    With `topics` (story_id, member_signature, slug, label, score) also those of the generation's own signature."""
    usable = generation_validity(syntheses, elements).filter("valid AND is_current")
    body = usable.select("story_id", "member_signature", "synthesis_id", "generated_at").join(
        card_elements(elements), "synthesis_id")
    if topics is not None:
        body = body.join(topic_lists(topics), ["story_id", "member_signature"], "left").withColumn(
            "topics", F.coalesce("topics", F.array().cast("array<struct<slug:string,label:string>>")))
    ready = F.col("synthesis_id").isNotNull()
    return stories.join(body, ["story_id", "member_signature"], "left").select(
        *([F.coalesce("topics", F.array().cast("array<struct<slug:string,label:string>>")).alias("topics")] if topics is not None else []),
        "story_id", "language", "created_at",
        F.when(~ready, "PREPARING").when(F.col("refresh_state") == "CURRENT", "CURRENT")
        .otherwise("UPDATING").alias("content_state"),
        "synthesis_id", F.col("generated_at").alias("synthesized_at"),
        F.coalesce("title", F.lit("Story being prepared")).alias("title"), "elements",
        F.when(ready, F.col("article_count")).otherwise(0).alias("article_count"),
        F.when(ready, F.col("source_count")).otherwise(0).alias("source_count"))


# --- freshness and validity --------------------------------------------------------


def generation_validity(syntheses: DataFrame, elements: DataFrame, *,
                        max_elements: int = policy.MAX_ELEMENTS,
                        max_chars: int = policy.MAX_ELEMENT_CHARS) -> DataFrame:
    """Generations with `valid`: 1..n elements, exactly one TITLE, all cited and bounded.

    elements: synthesis_id, kind, text, article_ids (or a column `cited`, the citation count)."""
    cited = F.col("cited") if "cited" in elements.columns else F.size("article_ids")
    shape = elements.groupBy("synthesis_id").agg(
        F.count("*").alias("_n"), F.count_if(F.col("kind") == "TITLE").alias("_t"),
        F.count_if((cited < 1) | (F.col("text") == "") | (F.length("text") > max_chars)).alias("_bad"))
    ok = F.col("_n").between(1, max_elements) & (F.col("_t") == 1) & (F.col("_bad") == 0)
    return syntheses.join(shape, "synthesis_id", "left").withColumn(
        "valid", F.coalesce(ok, F.lit(False))).drop("_n", "_t", "_bad")


def freshness_matrix(stories: DataFrame, membership: DataFrame, validity: DataFrame) -> DataFrame:
    """Each story as CURRENT, UPDATING, PREPARING or UNAVAILABLE."""
    live = membership.select("story_id").distinct().withColumn("_live", F.lit(True))
    good = validity.filter("valid AND is_current").select(
        "story_id", "member_signature", F.lit(True).alias("_good"))
    return stories.join(live, "story_id", "left").join(
        good, ["story_id", "member_signature"], "left").withColumn(
        "content_state",
        F.when((F.col("status") != "ACTIVE") | F.col("_live").isNull(), "UNAVAILABLE")
        .when(F.col("_good").isNull(), "PREPARING")
        .when(F.col("refresh_state") == "CURRENT", "CURRENT").otherwise("UPDATING"),
    ).drop("_live", "_good")


def shown_topics(story_topics: DataFrame, stories: DataFrame, n: int = policy.MAX_TOPICS) -> DataFrame:
    """Topics of the story's own signature; all are omitted where there are more than n."""
    mine = story_topics.join(stories.select("story_id", "member_signature"),
                             ["story_id", "member_signature"], "left_semi")
    few = mine.groupBy("story_id").agg(F.count("*").alias("_n")).filter(F.col("_n") <= n)
    return mine.join(few.select("story_id"), "story_id", "left_semi")


def citations(element_sources: DataFrame, articles: DataFrame, sources: DataFrame,
              membership: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cited publications per story with member flag, cited article ids that do not exist).

    element_sources: story_id, article_id."""
    cited = element_sources.select("story_id", "article_id").distinct()
    rows = cited.join(articles.select("article_id", "source_id"), "article_id").join(
        sources.select("source_id", "slug"), "source_id")
    current = membership.select("story_id", "article_id", F.lit(True).alias("_m"))
    flagged = rows.join(current, ["story_id", "article_id"], "left").withColumn(
        "is_current_member", F.col("_m").isNotNull()).drop("_m")
    return flagged, cited.join(articles.select("article_id"), "article_id", "left_anti")


def story_detail(stories: DataFrame, membership: DataFrame, articles: DataFrame, validity: DataFrame,
                 elements: DataFrame) -> DataFrame:
    """Facts per available story: state, title, cited and current counts.

    elements: synthesis_id, kind, text, article_id (one row per citation)."""
    state = freshness_matrix(stories, membership, validity).filter("content_state <> 'UNAVAILABLE'")
    counts = membership.select("story_id", "article_id").join(
        articles.select("article_id", "source_id"), "article_id").groupBy("story_id").agg(
        F.count_distinct("article_id").alias("current_article_count"),
        F.count_distinct("source_id").alias("current_source_count"))
    good = validity.filter("valid AND is_current").select("story_id", "member_signature", "synthesis_id")
    body = elements.groupBy("synthesis_id").agg(
        F.min(F.when(F.col("kind") == "TITLE", F.col("text"))).alias("_title"),
        F.count_distinct("article_id").alias("_cited"))
    ready = F.col("synthesis_id").isNotNull()
    return (
        state.join(counts, "story_id")
        .join(good, ["story_id", "member_signature"], "left").join(body, "synthesis_id", "left")
        .select(
            "story_id", "content_state", "synthesis_id",
            F.when(ready, F.col("_title")).otherwise("Story being prepared").alias("title"),
            F.when(ready, F.col("article_count")).otherwise(0).alias("article_count"),
            F.when(ready, F.col("source_count")).otherwise(0).alias("source_count"),
            "current_article_count", "current_source_count",
            F.coalesce("_cited", F.lit(0)).alias("cited_count"))
    )


def recorded_distance(method: Column, evidence_distance: Column, similarity: Column) -> Column:
    return F.when((method == "MATCHED") & evidence_distance.isNotNull(), evidence_distance).otherwise(
        1.0 - similarity)


def story_members_report(membership: DataFrame, articles: DataFrame, cited: DataFrame) -> DataFrame:
    """Members with method, recorded distance and whether the current generation cites them."""
    times = articles.select("article_id", "source_id", "canonical_url", "title",
                            F.coalesce("published_at", "first_seen_at").alias("event_time"))
    marks = cited.select("story_id", "article_id", F.lit(True).alias("_c")).distinct()
    ev = F.col("evidence.distance") if "evidence" in membership.columns else F.lit(None).cast("double")
    return membership.join(times, "article_id").join(marks, ["story_id", "article_id"], "left").select(
        "story_id", "article_id", "source_id", "canonical_url", "title", "event_time", "method",
        "is_primary", recorded_distance(F.col("method"), ev, F.col("similarity")).alias("distance"),
        F.col("_c").isNotNull().alias("cited"))


def explain_match(edges: DataFrame) -> DataFrame:
    """Decision, reason, rule and a one-sentence summary from the stored evidence."""
    e = lambda f: F.col(f"evidence.{f}")
    number = lambda c: F.when(c.isNull(), "-").otherwise(F.format_string("%.6f", c))
    plain = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    decision = F.when(F.col("method") == "MATCHED", "MATCH").when(
        F.col("method") == "CREATED_STORY", "CREATE_NEW_STORY").otherwise(F.col("method"))
    reason = F.coalesce(e("reason"), F.lit(""))
    rule = F.when(e("rule").isNull() & (decision == "MATCH") & (reason == "WITHIN_THRESHOLD"),
                  "PRIMARY_DISTANCE").otherwise(F.coalesce(e("rule"), F.lit("")))
    mine = F.get(F.filter(e("verification"), lambda v: v["story_id"] == F.col("story_id")), F.lit(0))
    story = F.concat(F.lit("Story "), F.col("story_id").cast("string"))
    dist = number(e("distance"))
    rejected = F.array_join(F.transform(e("verification"), lambda v: F.format_string(
        "Story %d at %s: %s (nearest member %s, %d shared name(s))", v["story_id"],
        number(v["distance"]), v["result"], number(v["member_distance"]), v["shared_anchors"])), "; ")
    near = F.get(e("candidates"), F.lit(0))["story_id"]
    summary = (
        F.when((decision == "MATCH") & e("kept_current_story"), F.concat(
            F.lit("stayed in "), story, F.lit(" when its stale assignment was re-decided at distance "),
            dist, F.lit(" ("), reason, F.lit(")")))
        .when((decision == "MATCH") & (reason == "VERIFIED_SAME_EVENT"), F.concat(
            F.lit("joined "), story, F.lit(" by secondary verification: distance "), dist,
            F.lit(" above "), plain(e("max_distance")), F.lit(" and within "),
            plain(e("secondary_max_distance")), F.lit("; nearest member "),
            number(mine["member_distance"]), F.lit(", "), plain(mine["shared_anchors"]),
            F.lit(" shared name(s)")))
        .when(decision == "MATCH", F.concat(
            F.lit("joined "), story, F.lit(": nearest compatible candidate at distance "), dist,
            F.lit(", within "), plain(e("max_distance"))))
        .when(reason == "NO_CANDIDATES", "created a new Story: no candidate was retrieved")
        .when(reason == "NO_COMPATIBLE_CANDIDATE", F.concat(
            F.lit("created a new Story: "), plain(e("candidate_count")),
            F.lit(" candidate(s), none compatible within "), plain(e("max_time_gap_hours")), F.lit(" h")))
        .when(reason == "VERIFICATION_REJECTED", F.concat(
            F.lit("created a new Story: verification rejected every candidate within "),
            plain(e("secondary_max_distance")), F.lit(": "), rejected))
        .when(reason == "ABOVE_THRESHOLD", F.concat(
            F.lit("created a new Story: nearest compatible candidate (Story "), plain(near),
            F.lit(") at distance "), dist, F.lit(", above "), plain(e("max_distance"))))
        .otherwise(F.concat(F.lit("decision "), decision, F.lit(" with reason "), reason))
    )
    return edges.select("article_id", "story_id", decision.alias("decision"), reason.alias("reason"),
                        rule.alias("rule"), e("distance").alias("distance"),
                        e("candidate_count").alias("candidate_count"), summary.alias("summary"))
