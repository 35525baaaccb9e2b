"""Reader data: feed impressions, bookmarks, exposure qualification, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import policy
from ..functions.text import extended_iso
from ..session import cut_lineage
from .skew import running_number

_UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
EVENT_FIELDS = ["event_id", "feed_session_id", "occurred_at", "policy_version", "position",
                "story_id", "surface"]
_ZONED = ("^\\d{4}-\\d{1,2}-\\d{1,2}[T ]\\d{1,2}:\\d{2}(:\\d{2}([.,]\\d{1,6}\\d{0,6})?)?"
          "\\s*(Z|[+-]\\d{2}(:?\\d{2})?)$")


# --- validation --------------------------------------------------------------------


def impression_checks(events: DataFrame, event_json="event_json", received_at="received_at",
                      max_age_seconds: int = policy.IMPRESSION_MAX_AGE_SECONDS,
                      ahead_seconds: int = policy.IMPRESSION_AHEAD_SECONDS) -> DataFrame:
    """Adds the parsed fields and `errors` (names of broken fields) to rows with one JSON event.

    Fields are read as raw JSON text, so that a number and a string of digits stay apart.
    """
    raw = F.from_json(event_json, "map<string,string>")
    variant = F.try_parse_json(event_json)
    kind = lambda f: F.schema_of_variant(F.try_variant_get("_v", f"$.{f}", "variant"))
    text = lambda f: F.when(kind(f) == "STRING", F.try_variant_get("_v", f"$.{f}", "string"))
    whole = lambda f: F.when(kind(f) == "BIGINT",
                             F.try_variant_get("_v", f"$.{f}", "bigint"))
    df = events.withColumn("_v", variant).withColumn("_m", raw)
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    names = F.coalesce(F.map_keys("_m"), F.array().cast("array<string>"))
    fields = F.array(*[F.lit(f) for f in EVENT_FIELDS])
    stamp = extended_iso(text("occurred_at"))
    when = F.when(
        (F.length(text("occurred_at")) <= 40) & stamp.rlike(_ZONED),
        F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.regexp_replace(
            stamp, ",", "."), "\\s+(?=Z|[+-])", ""), "([+-]\\d{2})(\\d{2})$", "$1:$2")))
    story = text("story_id")
    parsed = {
        "event_id": F.lower(text("event_id")), "feed_session_id": F.lower(text("feed_session_id")),
        "story_id": F.when(story.rlike("^[1-9][0-9]{0,18}$"), F.expr(
            "try_cast(try_variant_get(_v, '$.story_id', 'string') AS BIGINT)")),
        "position": whole("position"), "surface": text("surface"),
        "policy_version": whole("policy_version"), "occurred_at": when,
    }
    df = df.select("*", *[c.alias(f"p_{n}") for n, c in parsed.items()])
    late = F.unix_micros("p_occurred_at") < F.unix_micros(received_at) - max_age_seconds * 1_000_000
    early = F.unix_micros("p_occurred_at") > F.unix_micros(received_at) + ahead_seconds * 1_000_000
    no = lambda cond: ~F.coalesce(cond, F.lit(False))
    rules = [
        ("event_id", no(F.col("p_event_id").rlike(_UUID))),
        ("feed_session_id", no(F.col("p_feed_session_id").rlike(_UUID))),
        ("occurred_at", no(~(late | early))),
        ("policy_version", no(F.col("p_policy_version") == policy.IMPRESSION_POLICY)),
        ("position", no(F.col("p_position").between(0, policy.IMPRESSION_MAX_POSITION))),
        ("story_id", F.col("p_story_id").isNull()),
        ("surface", no(F.col("p_surface") == policy.IMPRESSION_SURFACE)),
    ]
    shape = F.concat(F.array_except(names, fields), F.array_except(fields, names))
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))
    return df.withColumn(
        "errors",
        F.when(~is_object, F.array(F.lit("event"))).when(F.size(shape) > 0, F.array_sort(shape))
        .otherwise(broken),
    ).drop("_v", "_m")


def batch_validity(checked: DataFrame, batch: str = "batch_id",
                   max_events: int = policy.IMPRESSION_BATCH) -> DataFrame:
    """(batch, events, valid): a batch is taken whole or not at all."""
    return checked.groupBy(batch).agg(
        F.count("*").alias("events"),
        ((F.count("*") <= max_events) & F.bool_and(F.size("errors") == 0)).alias("valid"))


# --- acceptance --------------------------------------------------------------------


def accept_batches(checked: DataFrame, stories: DataFrame, accepted: DataFrame | None = None, *,
                   batch: str = "batch_id", seq: str = "seq",
                   max_events: int = policy.IMPRESSION_BATCH) -> DataFrame:
    """Outcome and code of every event of `impression_checks` rows (with user_id and received_at).

    A batch with a broken event or too many events is refused whole: nothing of it is taken, all its
    events are `invalid`. The others are accepted in the order of receipt, batch and place in the
    batch, after what `accepted` holds."""
    valid = batch_validity(checked, batch, max_events).select(batch, "valid")
    rows = checked.join(valid, batch).select(
        "user_id", batch, seq, "received_at", "valid", F.col("p_event_id").alias("event_key"),
        F.col("p_feed_session_id").alias("session_id"), F.col("p_story_id").alias("story_id"),
        F.col("p_position").alias("position"), F.col("p_occurred_at").alias("occurred_at"))
    judged = accept_impressions(rows.filter("valid").drop("valid"), stories, accepted,
                                body=["position", "occurred_at"], order=["received_at", batch, seq])
    refused = rows.filter("NOT valid").drop("valid").withColumn("outcome", F.lit("invalid")).withColumn(
        "code", F.lit("invalid_batch"))
    return judged.unionByName(refused)


def accept_impressions(events: DataFrame, stories: DataFrame, accepted: DataFrame | None = None, *,
                       body: list[str], order: list[str]) -> DataFrame:
    """Each event with outcome and code, as if users' events were taken one by one in `order`.

    events: user_id, event_key, session_id, story_id, body columns, order columns. Only an
    accepted row occupies its event key and its (session, story), so acceptance is the first-come
    matching of keys: copies are merged first, then in every round the rows that are earliest at
    both keys are accepted and the rows they exclude are settled. Rows whose event key has one
    body only (nearly all) need a single round, and no user is gathered in one task.
    """
    full = ["session_id", "story_id", *body]
    known = stories.select("story_id").distinct().withColumn("_known", F.lit(True))
    ev = events.join(known, "story_id", "left")
    edges = ev.filter("_known").groupBy("user_id", "event_key", *full).agg(
        F.min(F.struct(*order)).alias("at"))
    won = None
    if accepted is not None:
        won = accepted.select("user_id", "event_key", *full,
                              F.lit(None).cast(edges.schema["at"].dataType).alias("at"))
        edges = edges.join(won, ["user_id", "event_key"], "left_anti").join(
            won, ["user_id", "session_id", "story_id"], "left_anti").select(edges.columns)
    open_edges = cut_lineage(edges)
    while True:  # the earliest open row is accepted or excluded in every round
        by_event = open_edges.groupBy("user_id", "event_key").agg(F.min("at").alias("_e"))
        by_slot = open_edges.groupBy("user_id", "session_id", "story_id").agg(F.min("at").alias("_s"))
        first = open_edges.join(by_event, ["user_id", "event_key"]).join(
            by_slot, ["user_id", "session_id", "story_id"]).filter("at = _e AND at = _s")
        first = cut_lineage(first.select(*open_edges.columns))
        cols = ["user_id", "event_key", *full, "at"]
        won = first.select(*cols) if won is None else won.select(*cols).unionByName(first.select(*cols))
        open_edges = cut_lineage(
            open_edges.join(first, ["user_id", "event_key"], "left_anti")
            .join(first, ["user_id", "session_id", "story_id"], "left_anti"))
        if open_edges.isEmpty():
            break
    return _outcomes(ev, won, full, order)


def _outcomes(ev: DataFrame, won: DataFrame, full: list[str], order: list[str]) -> DataFrame:
    """Rows against the winners. A winner counts only for rows after it: before it, the row
    was judged without it, and then only an earlier winner of its slot can have excluded it."""
    key = won.select("user_id", "event_key", F.struct(*full).alias("_body"), F.col("at").alias("_at"),
                     F.lit(True).alias("_hit"))
    rows = ev.join(key, ["user_id", "event_key"], "left").withColumn("_me", F.struct(*order))
    seen = F.col("_hit") & F.coalesce(F.col("_at") < F.col("_me"), F.lit(True))
    mine = F.col("_hit") & F.coalesce(F.col("_at") == F.col("_me"), F.lit(False))
    same = F.col("_body") == F.struct(*full)
    return rows.select(
        *[c for c in ev.columns if c != "_known"],
        F.when(mine, "accepted").when(seen & same, "duplicate").otherwise("rejected").alias("outcome"),
        F.when(mine | (seen & same), F.lit(""))
        .when(seen, "event_conflict").when(F.col("_known").isNull(), "story_not_found")
        .otherwise("event_conflict").alias("code"),
    )


def impression_outcome_counts(outcomes: DataFrame, batch: str = "batch_id") -> DataFrame:
    return outcomes.groupBy(batch).agg(
        F.count("*").alias("count"),
        F.count_if(F.col("outcome") == "accepted").alias("accepted_count"),
        F.count_if(F.col("outcome") == "duplicate").alias("duplicate_count"),
        F.count_if(F.col("code") == "event_conflict").alias("conflict_count"),
        F.count_if(F.col("code") == "story_not_found").alias("rejected_count"))


def known_story(events: DataFrame, stories: DataFrame) -> DataFrame:
    """Events whose story exists, archived or not."""
    return events.join(stories.select("story_id"), "story_id", "left_semi")


def prune_impressions(impressions: DataFrame, cutoff, now,
                      min_days: int = policy.IMPRESSION_RETENTION_DAYS) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one row with the eligible count); the cutoff may not be inside retention."""
    at, now = F.lit(cutoff).cast("timestamp"), F.lit(now).cast("timestamp")
    allowed = at <= now - F.make_dt_interval(F.lit(min_days))
    old = (F.col("received_at") < at) & F.when(allowed, True).otherwise(
        F.raise_error(F.lit("cutoff is inside the retention period")).cast("boolean"))
    return impressions.filter(~old), impressions.agg(F.count_if(old).alias("eligible"))


def erase_account(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Bookmarks or impressions without those of erased users."""
    return rows.join(users.select("user_id"), "user_id", "left_anti")


def story_deleted(impressions: DataFrame, bookmarks: DataFrame, deleted: DataFrame
                  ) -> tuple[DataFrame, DataFrame]:
    """(impressions with the link to deleted stories nulled, stories that may not be deleted
    because they are bookmarked)."""
    blocked = deleted.select("story_id").join(bookmarks.select("story_id"), "story_id", "left_semi")
    gone = deleted.select("story_id").join(blocked, "story_id", "left_anti").select(
        "story_id", F.lit(True).alias("_gone"))
    kept = impressions.join(gone, "story_id", "left").withColumn(
        "story_id", F.when(F.col("_gone").isNull(), F.col("story_id"))).drop("_gone")
    return kept, blocked


# --- bookmarks ---------------------------------------------------------------------


def bookmark_set(commands: DataFrame, eligible: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Bookmarks after a log of save/remove commands (user_id, story_id, at, seq, op).

    The last remove counts; the first save after it sets created_at. A save of a story that is
    not eligible is void, unless the bookmark already stands, when it changes nothing anyway.
    """
    key = ["user_id", "story_id"]
    ok = eligible.select("story_id").distinct().withColumn("_ok", F.lit(True))
    order = F.struct("at", "seq")
    last_remove = commands.filter("op = 'remove'").groupBy(*key).agg(F.max(order).alias("_r"))
    saves = commands.filter("op = 'save'").join(ok, "story_id", "left_semi").join(last_remove, key, "left")
    made = saves.filter(F.col("_r").isNull() | (order > F.col("_r"))).groupBy(*key).agg(
        F.min(order).alias("_s")).select(*key, F.col("_s.at").alias("created_at"))
    if existing is None:
        return made
    standing = existing.select(*key, "created_at").join(last_remove, key, "left_anti")
    return standing.unionByName(made.join(standing, key, "left_anti"))


# --- exposure ----------------------------------------------------------------------


def visible_share(top: Column, height: Column, offset: Column, viewport: Column) -> Column:
    """Visible height over the smaller of card and viewport height, 0..1."""
    shown = F.least(top + height, offset + viewport) - F.greatest(top, offset)
    return F.when((height <= 0) | (viewport <= 0) | (shown <= 0), F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), shown / F.least(height, viewport)))


def dwell_islands(reports: DataFrame, *, share: float = policy.EXPOSURE_SHARE,
                  dwell_ms: int = policy.EXPOSURE_DWELL_MS, block_ms: int = 3_600_000) -> DataFrame:
    """Maximal runs of consecutive reports of a session in which a card is eligible.

    Columns: user_id, session_id, story_id, since_ms, end_ms (the report that broke the run; NULL
    if none did), qualified_ms, position (the last one reported before the qualifying instant).
    Reports: user_id, session_id, t_ms, seq, gate_open, cards(story_id, position, share).
    Reports of a session are numbered block-wise, so one long session is many tasks.
    """
    session, block = ["user_id", "session_id"], F.floor(F.col("t_ms") / block_ms)
    numbered = running_number(
        reports.select(*session, "t_ms", "seq", "gate_open", "cards"), session, ["t_ms", "seq"],
        block, "n")
    times = numbered.select(*session, (F.col("n") - 1).alias("last_n"), F.col("t_ms").alias("end_ms"))
    cards = numbered.filter("gate_open").select(*session, "n", "t_ms", F.explode("cards").alias("c"))
    seen = cards.filter(F.col("c.share") >= share).select(
        *session, F.col("c.story_id").alias("story_id"), "n", "t_ms",
        F.col("c.position").alias("position"))
    key = [*session, "story_id"]
    ranked = running_number(seen, key, ["n"], F.floor(F.col("t_ms") / block_ms), "r")
    since = ranked.withColumn("island", F.col("n") - F.col("r")).groupBy(*key, "island").agg(
        F.min("t_ms").alias("since_ms"), F.max("n").alias("last_n"))
    before = ranked.withColumn("island", F.col("n") - F.col("r")).join(since, [*key, "island"]).filter(
        (F.col("t_ms") < F.col("since_ms") + dwell_ms) | (F.col("t_ms") == F.col("since_ms")))
    placed = before.groupBy(*key, "island", "since_ms", "last_n").agg(
        F.max_by("position", "n").alias("position"))
    return placed.join(times, [*session, "last_n"], "left").select(
        *key, "since_ms", "end_ms", (F.col("since_ms") + dwell_ms).alias("qualified_ms"), "position")


def qualify_exposures(reports: DataFrame, *, share: float = policy.EXPOSURE_SHARE,
                      dwell_ms: int = policy.EXPOSURE_DWELL_MS, until_ms: int | None = None,
                      block_ms: int = 3_600_000) -> DataFrame:
    """The first qualifying run of each card per session. A run nothing broke qualifies by its
    timer (if `until_ms`, the end of observation, leaves time for it)."""
    runs = dwell_islands(reports, share=share, dwell_ms=dwell_ms, block_ms=block_ms)
    end = F.col("end_ms") if until_ms is None else F.coalesce("end_ms", F.lit(until_ms))
    long_enough = F.coalesce(end - F.col("since_ms") >= dwell_ms, F.lit(True))
    return runs.filter(long_enough).groupBy("user_id", "session_id", "story_id").agg(
        F.min_by(F.struct("position", "qualified_ms"), "since_ms").alias("q")
    ).select("user_id", "session_id", "story_id", "q.position", F.col("q.qualified_ms").alias("occurred_ms"))


def first_slot_dedupe(slots: DataFrame, session: list[str], order: list[str], item: str = "story_id") -> DataFrame:
    """Flattened pages: an item keeps its first slot of a session; zero-based positions."""
    first = slots.groupBy(*session, item).agg(F.min(F.struct(*order)).alias("_o")).select(
        *session, item, "_o.*")
    return running_number(first, session, order, None, "_slot").withColumn(
        "position", F.col("_slot") - 1).drop("_slot")
