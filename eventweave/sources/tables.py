"""Domain tables derived from the given parquet tables.

Each adapter is a plain projection, aggregate or explode of a whole table, so
every registered query grows with its input. `plans/oracle.py` holds the same
adapters as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import event_time
from ..session import bound_batches, use_utc

EPOCH = "timestamp'2024-01-01 00:00:00'"
VECTOR_KEY = "vec:test@1"
TEXT_STORY_SIZE = 12
VECTOR_STORY_SPAN = 100


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when a small table arrives in fewer splits than there are cores.

    A table of usual size has more splits than cores and is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if splits * 2 <= cores else df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    bound_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # text work is heavy per row
    return spread(df) if name in ("documents", "pages") else df


def after_epoch(amount: Column, unit: str) -> Column:
    seconds = {"minutes": 60, "hours": 3600, "seconds": 1}[unit]
    return F.timestamp_seconds(F.lit(1704067200) + amount.cast("long") * seconds)


# --- publications ----------------------------------------------------------------


def articles(spark, sf_dir) -> DataFrame:
    """documents as articles: one publication per document."""
    d = read(spark, sf_dir, "documents")
    seen = after_epoch(F.col("doc_id"), "minutes")
    return d.select(
        F.col("doc_id").alias("article_id"),
        F.col("source").alias("source_id"),
        F.lit("").alias("external_id"),
        F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string"))
        .alias("canonical_url"),
        F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 512).alias("title"),
        F.lit("").alias("description"),
        F.col("text").alias("body_text"),
        F.lit("").alias("byline"),
        F.when(F.col("doc_id") % 7 != 0, seen).alias("published_at"),
        F.col("lang").alias("language"),
        seen.alias("first_seen_at"),
        seen.alias("created_at"),
        seen.alias("updated_at"),
    )


def sources(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.groupBy(F.col("source").alias("source_id")).agg(
        F.min("lang").alias("default_language"), F.min("source").alias("slug"),
    ).withColumn("name", F.upper("slug"))


def page_items(spark, sf_dir) -> DataFrame:
    """pages as syndicated items of the host they came from."""
    p = read(spark, sf_dir, "pages")
    return p.select(
        F.col("page_id").alias("item_id"),
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("source_id"),
        F.lit("").alias("external_id"), "url",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.lit("").alias("summary_html"), F.col("html").alias("content_html"),
        F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("language"),
    )


# --- vector stories --------------------------------------------------------------


def vector_embeddings(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("article_id"), F.lit(VECTOR_KEY).alias("model_key"),
        F.size("embedding").alias("dimension"), F.col("embedding").alias("vector"),
    )


def vector_articles(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    m = F.col("vec_id") % 4
    return e.select(
        F.col("vec_id").alias("article_id"),
        F.concat(F.lit("src"), (F.col("vec_id") % 9).cast("string")).alias("source_id"),
        F.when(m == 0, "fr").when(m == 1, "en-GB").otherwise("EN").alias("language"),
        after_epoch(F.col("vec_id"), "hours").alias("event_time"),
        after_epoch(F.col("vec_id"), "hours").alias("updated_at"),
    )


def _vector_story_id() -> Column:
    return (F.col("label").cast("long") * 100_000
            + F.floor(F.col("vec_id") / VECTOR_STORY_SPAN)).alias("story_id")


def vector_membership(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(_vector_story_id(), F.col("vec_id").alias("article_id"))


def vector_stories(spark, sf_dir) -> DataFrame:
    ids = vector_membership(spark, sf_dir).select("story_id").distinct()
    return ids.select(
        "story_id",
        F.when(F.col("story_id") % 7 == 6, "ARCHIVED").otherwise("ACTIVE").alias("status"),
        F.when(F.floor(F.col("story_id") / 100_000) % 3 == 0, "fr").otherwise("en").alias("language"),
    )


# --- text stories ----------------------------------------------------------------


def text_membership(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.floor(F.col("doc_id") / TEXT_STORY_SIZE).alias("story_id"),
        F.col("doc_id").alias("article_id"),
        F.lit(True).alias("is_primary"),
        F.when(F.col("doc_id") % TEXT_STORY_SIZE == 0, "CREATED_STORY").otherwise("MATCHED")
        .alias("method"),
        F.when(F.col("doc_id") % TEXT_STORY_SIZE != 0,
               F.lit(1.0) - (F.col("doc_id") % TEXT_STORY_SIZE) / 100.0).alias("similarity"),
    )


def text_stories(spark, sf_dir) -> DataFrame:
    ids = text_membership(spark, sf_dir).groupBy("story_id").agg(
        F.count("*").alias("members"))
    s = F.col("story_id")
    return ids.select(
        "story_id",
        F.when(s % 11 == 10, "ARCHIVED").otherwise("ACTIVE").alias("status"),
        F.when(s % 5 == 3, "STALE").when(s % 5 == 4, "FAILED").otherwise("CURRENT")
        .alias("refresh_state"),
        F.concat(F.lit("sig"), s.cast("string")).alias("member_signature"),
        F.when(s % 5 == 4, F.when(s % 2 == 0, "story_synthesis:INVALID_OUTPUT").otherwise("TIMEOUT"))
        .otherwise("").alias("refresh_error"),
        (F.col("members") + F.when(s % 4 == 1, 1).otherwise(0)).alias("article_count"),
        F.lit(1).cast("long").alias("source_count"),
        F.lit("en").alias("language"),
        after_epoch(F.floor(s / 2), "hours").alias("created_at"),
    )


def text_syntheses(spark, sf_dir) -> DataFrame:
    """Two generations per story for most stories; some carry an old signature."""
    s = F.col("story_id")
    base = text_stories(spark, sf_dir).filter(s % 6 != 0).select(
        "story_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("g"))
    return base.select(
        "story_id", (s * 2 + F.col("g")).alias("synthesis_id"),
        F.lit("extractive:lead-sentences@1").alias("model_key"),
        after_epoch(s * 2 + F.col("g"), "hours").alias("generated_at"),
        F.when((s % 13 == 0) | (F.col("g") == 0), F.lit("old"))
        .otherwise(F.concat(F.lit("sig"), s.cast("string"))).alias("member_signature"),
    )


def text_elements(spark, sf_dir) -> DataFrame:
    """Elements of the newest generation: a title from the first member, a summary of each."""
    m = text_membership(spark, sf_dir).join(
        articles(spark, sf_dir).select("article_id", "title"), "article_id")
    n = F.col("article_id") % TEXT_STORY_SIZE
    return m.filter(F.col("story_id") % 6 != 0).select(
        (F.col("story_id") * 2 + 1).alias("synthesis_id"), "story_id",
        F.when(n == 0, "TITLE").when(n <= 3, "SUMMARY").otherwise("CONTEXT").alias("kind"),
        n.alias("ord"), F.col("title").alias("text"), "article_id",
    )


def article_times(spark, sf_dir) -> DataFrame:
    return articles(spark, sf_dir).select(
        "article_id", "source_id", "updated_at", event_time().alias("event_time"))


# --- event log -------------------------------------------------------------------


def events(spark, sf_dir) -> DataFrame:
    return event_columns(read(spark, sf_dir, "events"))


def event_columns(e: DataFrame) -> DataFrame:
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def runs(spark, sf_dir) -> DataFrame:
    """events as ingestion runs of the endpoint `user_id`."""
    e = events(spark, sf_dir)
    t = F.col("event_type")
    status = (F.when(t == "error", "FAILED").when(t == "signup", "RUNNING")
              .when(t == "click", "PARTIAL").when(t == "purchase", "NO_CHANGE")
              .otherwise("SUCCEEDED"))
    return e.select(
        F.col("event_id").alias("run_id"), F.col("user_id").alias("endpoint_id"),
        status.alias("status"), F.col("ts").alias("started_at"),
        F.when(t != "signup", F.timestamp_micros(
            F.unix_micros("ts") + F.floor(F.col("value") * 100).cast("long") * 1000))
        .alias("finished_at"),
    )


def endpoints(spark, sf_dir) -> DataFrame:
    u = F.col("endpoint_id")
    return runs(spark, sf_dir).groupBy("endpoint_id").agg(F.count("*").alias("n")).select(
        "endpoint_id", (u % 10 != 0).alias("is_active"), (u % 17 != 1).alias("source_active"),
        (F.lit(900) * (1 + u % 40)).alias("fetch_interval_seconds"),
    )


def arrivals(spark, sf_dir) -> DataFrame:
    """events as received item payloads: key 'k', payload identity 'event_type'."""
    return events(spark, sf_dir).select(
        F.col("event_id").alias("raw_id"), F.col("user_id").alias("endpoint_id"),
        F.lit("EXTERNAL_ID").alias("key_kind"),
        F.concat(F.lit("k"), F.col("k").cast("string")).alias("external_key"),
        F.sha2("event_type", 256).alias("payload_hash"), F.col("ts").alias("created_at"),
    )


def impression_events(spark, sf_dir) -> DataFrame:
    return impressions_of(events(spark, sf_dir))


def impressions_of(log: DataFrame) -> DataFrame:
    """'view' and 'click' events as reported impressions, batched by user and hour.

    A click repeats the identity of the view family (user, k), so both unique keys collide.
    """
    e = log.filter(F.col("event_type").isin("view", "click"))
    day = F.date_format("ts", "yyyyMMdd")
    return e.select(
        "user_id",
        F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMddHH"))
        .alias("batch_id"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("e"), (F.col("event_id") % 1500).cast("string")).alias("event_key"),
        F.concat_ws("-", F.col("user_id").cast("string"), day).alias("session_id"),
        (F.col("k") + 1).alias("story_id"),
        (F.col("event_id") % 50).alias("position"),
        F.col("ts").alias("occurred_at"),
        F.timestamp_micros(F.unix_micros("ts") + F.floor(F.col("value")).cast("long") * 1_000_000)
        .alias("received_at"),
    )


def known_stories(spark, sf_dir) -> DataFrame:
    """Stories 1..80 of the k + 1 reported; the others do not exist."""
    return events(spark, sf_dir).filter("k < 80").select((F.col("k") + 1).alias("story_id")).distinct()


def bookmark_commands(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir).filter(F.col("event_type").isin("purchase", "signup"))
    return e.select(
        "user_id", (F.col("k") + 1).alias("story_id"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "purchase", "save").otherwise("remove").alias("op"),
        F.col("ts").alias("at"),
    )


def visibility_reports(spark, sf_dir) -> DataFrame:
    return visibility_reports_of(events(spark, sf_dir))


def visibility_reports_of(log: DataFrame) -> DataFrame:
    """One card per report; 'error' closes the gate."""
    e = log.filter(F.col("event_type").isin("view", "click", "error"))
    return e.select(
        "user_id",
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))
        .alias("session_id"),
        F.unix_millis("ts").alias("t_ms"), F.col("event_id").alias("seq"),
        (F.col("event_type") != "error").alias("gate_open"),
        F.array(F.struct(
            (F.col("k") % 2).alias("story_id"), (F.col("k") % 10).alias("position"),
            (F.col("value") - F.floor("value")).alias("share"),
        )).alias("cards"),
    )
