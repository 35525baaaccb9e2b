"""Normalisation of payloads and identity/content deduplication of publications."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import policy
from ..functions import text as tx
from ..functions.urls import canonical_url
from ..session import bound_batches, cut_lineage
from .components import components
from .skew import running_lag, top_rows


def normalize_articles(items: DataFrame, sources: DataFrame | None = None, *,
                       max_body: int = policy.MAX_BODY_CHARS) -> tuple[DataFrame, DataFrame]:
    """(articles, rejects). Items carry title, summary_html, content_html, url, external_id,
    language and optionally authors and published_at (ISO text); other columns pass through."""
    bound_batches(items.sparkSession)
    have = set(items.columns)
    if sources is not None:
        items = items.join(
            sources.select("source_id", F.col("default_language").alias("_default")),
            "source_id", "left")
    else:
        items = items.withColumn("_default", F.lit(""))
    # A filter on plain columns would be pushed below them, and the parsers would run there and once more above.
    # None passes a generator, so each of the two results parses an item once.
    read = F.struct(
        tx.clean_text("title").alias("_title"), tx.html_text("summary_html").alias("description"),
        tx.html_text("content_html").alias("body_text"), canonical_url("url").alias("canonical_url"))
    parsed = items.withColumn("_read", F.explode_outer(F.array(read))).select(
        *[c for c in items.columns if c not in {"_title", "description", "body_text", "canonical_url"}], "_read.*")
    empty = (F.col("_title") == "") & (F.col("description") == "") & (F.col("body_text") == "")
    parsed = parsed.withColumn(
        "reject_reason",
        F.when(empty, "EMPTY_ENTRY")
        .when(F.col("_title") == "", "MISSING_TITLE")
        .when(F.length("body_text") > max_body, "BODY_TOO_LARGE")
        .when(F.col("canonical_url").isNull(), "MISSING_CANONICAL_URL"),
    )
    passed = [c for c in items.columns if c not in {
        "title", "summary_html", "content_html", "url", "external_id", "language", "authors",
        "published_at", "_default"}]
    title = F.substring("_title", 1, policy.MAX_TITLE_CHARS)
    finger = tx.fingerprint_input(title, F.col("body_text"), F.col("description"))
    articles = parsed.filter("reject_reason IS NULL").select(
        *passed,
        tx.clean_text("external_id").alias("external_id"), "canonical_url",
        title.alias("title"), "description", "body_text",
        (tx.byline("authors") if "authors" in have else F.lit("")).alias("byline"),
        (tx.parse_zoned("published_at") if "published_at" in have
         else F.lit(None).cast("timestamp")).alias("published_at"),
        tx.article_language("language", "_default").alias("language"),
        F.sha2(finger, 256).alias("content_fingerprint"),
        F.length(finger).alias("fingerprint_input_length"),
        F.when(F.length("_title") > policy.MAX_TITLE_CHARS, "TITLE_TRUNCATED").alias("note"),
    )
    rejects = parsed.filter("reject_reason IS NOT NULL").select(*passed, "reject_reason")
    return articles, rejects


# --- one decision against a fixed article table -----------------------------------

_SNAP = ["article_id", "source_id", "canonical_url", "content_fingerprint"]


def _lookups(rows: DataFrame, kept: list[Column]) -> DataFrame:
    """(kind, key, *kept): the external id within its source, the URL and the fingerprint of every row."""
    keys = F.array(
        F.struct(F.lit("external_id").alias("kind"), F.when(F.col("external_id") != "", F.concat(
            "source_id", F.lit("\u0001"), "external_id")).alias("key")),
        F.struct(F.lit("url").alias("kind"), F.col("canonical_url").alias("key")),
        F.struct(F.lit("fingerprint").alias("kind"), F.col("content_fingerprint").alias("key")))
    return rows.select(F.inline(keys), *kept).filter("key IS NOT NULL")


def identity_candidates(normalized: DataFrame, articles: DataFrame,
                        min_chars: int = policy.MIN_FINGERPRINT_CHARS) -> DataFrame:
    """Adds by_external_id, by_canonical_url and by_fingerprint (structs or NULL).

    The pending rows and what the article table has for their keys are written once each; the three
    lookups are one aggregate over the keys that were asked for."""
    normalized = cut_lineage(normalized)
    asked = _lookups(normalized, []).distinct()
    # of one fingerprint the oldest article, of the other keys the lowest id
    age = F.when(F.col("kind") == "fingerprint", F.col("created_at"))
    held = cut_lineage(_lookups(articles, [F.struct(*_SNAP).alias("_snap"), F.col("created_at")]).join(
        asked, ["kind", "key"], "left_semi").groupBy("kind", "key").agg(
        F.min_by("_snap", F.struct(age, F.col("_snap.article_id"))).alias("_snap")))
    # rows that look nothing up get keys that match nothing and differ, so they stay spread out
    none = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("canonical_url", "content_fingerprint"), F.lit(65_536)))

    def looked_up(rows: DataFrame, kind: str, key: Column, name: str) -> DataFrame:
        found = held.filter(F.col("kind") == kind).select(F.col("key").alias("_k"), F.col("_snap").alias(name))
        return rows.withColumn("_k", F.coalesce(key, none)).join(found, "_k", "left").drop("_k")

    rows = looked_up(normalized, "external_id", F.when(F.col("external_id") != "", F.concat(
        "source_id", F.lit("\u0001"), "external_id")), "by_external_id")
    rows = looked_up(rows, "url", F.col("canonical_url"), "by_canonical_url")
    usable = (F.col("by_external_id").isNull() & F.col("by_canonical_url").isNull()
              & (F.col("fingerprint_input_length") >= min_chars))
    return looked_up(rows, "fingerprint", F.when(usable, F.col("content_fingerprint")), "by_fingerprint")


def _decide(ext: Column, url: Column, fp: Column, min_chars: int) -> tuple[Column, Column]:
    """(decision, article id) in precedence order."""
    c = F.col
    foreign = url["source_id"] != c("source_id")
    split = ext.isNotNull() & url.isNotNull() & (url["article_id"] != ext["article_id"])
    same_fp = lambda a: a["content_fingerprint"] == c("content_fingerprint")
    content = (fp.isNotNull() & (fp["canonical_url"] != c("canonical_url"))
               & (c("fingerprint_input_length") >= min_chars))
    rules = [
        (split & foreign, "SOURCE_IDENTITY_CONFLICT", url["article_id"]),
        (split, "IDENTITY_CONFLICT", ext["article_id"]),
        (ext.isNotNull() & (ext["canonical_url"] == c("canonical_url")) & same_fp(ext),
         "IDENTITY_DUPLICATE", ext["article_id"]),
        (ext.isNotNull(), "UPDATE", ext["article_id"]),
        (url.isNotNull() & foreign, "SOURCE_IDENTITY_CONFLICT", url["article_id"]),
        (url.isNotNull() & same_fp(url), "IDENTITY_DUPLICATE", url["article_id"]),
        (url.isNotNull(), "UPDATE", url["article_id"]),
        (content, "CONTENT_DUPLICATE", fp["article_id"]),
    ]
    kind, article = F, F
    for cond, name, ref in rules:
        kind, article = kind.when(cond, name), article.when(cond, ref)
    return kind.otherwise("CREATE"), article


def dedup_decide(normalized: DataFrame, articles: DataFrame, *,
                 min_fingerprint_chars: int = policy.MIN_FINGERPRINT_CHARS) -> DataFrame:
    """Each normalized revision with its decision against the article table as it stands."""
    cand = identity_candidates(normalized, articles, min_fingerprint_chars)
    kind, article = _decide(F.col("by_external_id"), F.col("by_canonical_url"),
                            F.col("by_fingerprint"), min_fingerprint_chars)
    return cand.select(
        *normalized.columns, kind.alias("decision"), article.alias("decision_article_id"),
        F.when(kind == "IDENTITY_CONFLICT", F.col("by_canonical_url.article_id"))
        .alias("conflicting_article_id"),
    )


# --- ordered processing of pending revisions ---------------------------------------

_ROW = ["raw_id", "created_at", "source_id", "external_id", "canonical_url", "content_fingerprint"]
_STATE = ["article_id", "source_id", "external_id", "canonical_url", "content_fingerprint"]
_FOLDED = "raw_id long, kind string, article_id long"


def _keys(df: DataFrame, node: Column) -> DataFrame:
    ext = F.when(F.col("external_id") != "", F.concat_ws("\u0001", F.lit("e"), "source_id", "external_id"))
    url = F.concat_ws("\u0001", F.lit("u"), "canonical_url")
    return df.select(node.alias("node"), F.explode(F.array_compact(F.array(ext, url))).alias("key"))


def _fold(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    """Apply revisions of one component in order to the articles they can meet."""
    arts = {r.article_id: (r.source_id, r.external_id, r.canonical_url, r.content_fingerprint)
            for r in state.itertuples()}
    by_ext = {(a[0], a[1]): i for i, a in arts.items() if a[1]}
    by_url = {a[2]: i for i, a in arts.items()}
    out = []
    for r in rows.sort_values(["created_at", "raw_id"]).itertuples():
        ext = by_ext.get((r.source_id, r.external_id)) if r.external_id else None
        url = by_url.get(r.canonical_url)
        new = (r.source_id, r.external_id, r.canonical_url, r.content_fingerprint)
        hit = ext if ext is not None else url
        if url is not None and url != hit or (url is not None and arts[url][0] != r.source_id):
            foreign = arts[url][0] != r.source_id
            out.append((r.raw_id, "SOURCE_IDENTITY_CONFLICT" if foreign else "IDENTITY_CONFLICT",
                        url if foreign else ext))
            continue
        if hit is None:
            hit, kind = r.raw_id, "INSERT"
        elif arts[hit][2:] == new[2:]:
            out.append((r.raw_id, "IDENTITY_DUPLICATE", hit))
            continue
        else:
            kind = "UPDATE"
            old = arts[hit]
            by_url.pop(old[2], None)
            if old[1]:
                by_ext.pop((old[0], old[1]), None)
        arts[hit] = new
        by_url[new[2]] = hit
        if new[1]:
            by_ext[(new[0], new[1])] = hit
        out.append((r.raw_id, kind, hit))
    return pd.DataFrame(out, columns=["raw_id", "kind", "article_id"])


def _fold_groups(rows: DataFrame, state: DataFrame) -> DataFrame:
    def run(_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _fold(left, right)

    # both sides may stem from one table; fresh names keep their columns apart
    state = state.select(*[F.col(c).alias(c) for c in state.columns])
    return rows.groupBy("component").cogroup(state.groupBy("component")).applyInPandas(run, _FOLDED)


def _chains(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Components of one publication: every revision is judged by the one before it."""
    prior = state.select("component", F.col("article_id").alias("_aid"),
                         F.struct("canonical_url", "content_fingerprint").alias("_a"))
    first = rows.groupBy("component").agg(
        F.min_by("raw_id", F.struct("created_at", "raw_id")).alias("_first"))
    lagged = running_lag(rows, ["component"], ["created_at", "raw_id"], None,
                         ["canonical_url", "content_fingerprint"], "_p")
    joined = lagged.join(prior, "component", "left").join(first, "component")
    before = F.coalesce("_p", "_a")
    return joined.select(
        "raw_id",
        F.when(before.isNull(), "INSERT")
        .when(before == F.struct("canonical_url", "content_fingerprint"), "IDENTITY_DUPLICATE")
        .otherwise("UPDATE").alias("kind"),
        F.coalesce("_aid", "_first").alias("article_id"),
    )


def _after(rows: DataFrame, folded: DataFrame, state: DataFrame) -> DataFrame:
    """Article identities after the folded revisions."""
    changed = folded.filter(F.col("kind").isin("INSERT", "UPDATE")).join(rows, "raw_id")
    last = changed.groupBy("article_id").agg(
        F.max_by(F.struct("component", *_STATE[1:]), F.struct("created_at", "raw_id")).alias("s"))
    kept = state.join(last.select("article_id"), "article_id", "left_anti")
    return kept.select("article_id", "component", *_STATE[1:]).unionByName(
        last.select("article_id", "s.component", *[f"s.{c}" for c in _STATE[1:]]))


FOLD_ROWS = 100_000  # six short columns each: some tens of MB in a task


def identity_outcomes(pending: DataFrame, articles: DataFrame, *, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """(raw_id, kind, article_id) as if the revisions were processed one by one in
    (created_at, raw_id) order. A new article takes the id of the revision that made it.

    Revisions that share no key with others, and components in which one article takes all
    revisions (one source with one external id throughout, or with one URL throughout), need no
    sequential step. The rest is folded per connected component, at most `fold_rows`
    revisions of a component at a time, so no task grows with a component.
    """
    # short columns of whole texts, used many times below, written once
    rows, state = cut_lineage(pending.select(*_ROW)), cut_lineage(articles.select(*_STATE))
    row_keys = _keys(rows, F.struct(F.lit("r").alias("t"), F.col("raw_id").alias("id")))
    art_keys = _keys(state, F.struct(F.lit("a").alias("t"), F.col("article_id").alias("id")))
    touched = art_keys.join(row_keys.select("key").distinct(), "key", "left_semi").select("node").distinct()
    art_keys = art_keys.join(touched, "node", "left_semi")
    comp = components(row_keys.unionByName(art_keys)).select(
        F.col("node.t").alias("t"), F.col("node.id").alias("id"),
        F.concat(F.col("component.t"), F.col("component.id").cast("string")).alias("component"))
    rows = rows.join(comp.filter("t = 'r'").select(F.col("id").alias("raw_id"), "component"), "raw_id")
    state = state.join(
        comp.filter("t = 'a'").select(F.col("id").alias("article_id"), "component"), "article_id")

    both = rows.select("component", F.lit(1).alias("n"), F.lit(0).alias("a"), *_STATE[1:4]).unionByName(
        state.select("component", F.lit(0).alias("n"), F.lit(1).alias("a"), *_STATE[1:4]))
    same = lambda c: F.min(c) == F.max(c)
    shape = both.groupBy("component").agg(
        F.sum("n").alias("rows"),
        ((F.sum("a") <= 1) & same("source_id") & same("external_id")
         & ((F.min("external_id") != "") | same("canonical_url"))
         | (F.sum("a") <= 1) & same("source_id") & same("canonical_url")).alias("chain"))
    shape = cut_lineage(shape)
    chain = shape.filter("chain").select("component")
    mixed = shape.filter("NOT chain").select("component")
    result = _chains(rows.join(chain, "component", "left_semi"),
                     state.join(chain, "component", "left_semi"))

    todo, now = rows.join(mixed, "component", "left_semi"), state.join(mixed, "component", "left_semi")
    # one number: how many slices the largest mixed component needs
    largest = shape.filter("NOT chain").agg(F.max("rows")).first()[0] or 0
    for _ in range(-(-largest // fold_rows)):
        part = top_rows(todo, ["component"], ["created_at", "raw_id"], fold_rows).drop("rank")
        if largest > fold_rows:
            part = cut_lineage(part)
        keys = _keys(part, F.col("raw_id")).select("key").distinct()
        met = _keys(now, F.col("article_id")).join(keys, "key", "left_semi").select(
            F.col("node").alias("article_id")).distinct()
        folded = _fold_groups(part, now.join(met, "article_id", "left_semi"))
        if largest > fold_rows:
            folded = cut_lineage(folded)
            now = cut_lineage(_after(part, folded, now))
            todo = todo.join(part.select("raw_id"), "raw_id", "left_anti")
        result = result.unionByName(folded)
    return result


def _content_originals(pending: DataFrame, outcomes: DataFrame, articles: DataFrame,
                       min_chars: int) -> DataFrame:
    """(raw_id, duplicate_of) of inserted revisions whose exact content an earlier article
    carries at that moment.

    Inserting never depends on content, so this is settled after identity. Articles whose
    fingerprint never changes are reduced to the earliest per fingerprint; only versions of
    changed articles that are older than that one are looked at singly.
    """
    at0 = F.lit("0001-01-01 00:00:00").cast("timestamp")
    changed = outcomes.filter(F.col("kind").isin("INSERT", "UPDATE")).join(
        pending.select("raw_id", "created_at", "content_fingerprint", "fingerprint_input_length"),
        "raw_id")
    # articles that were there before rank before the new ones
    age = lambda new: F.struct(F.lit(new).alias("new"), F.col("created_at").alias("at"))
    born = articles.select("article_id", age(0).alias("born")).unionByName(
        changed.filter("kind = 'INSERT'").select("article_id", age(1).alias("born")))
    versions = articles.select(
        "article_id", "content_fingerprint", at0.alias("since"), F.lit(-1).cast("long").alias("seq")
    ).unionByName(changed.select(
        "article_id", "content_fingerprint", F.col("created_at").alias("since"),
        F.col("raw_id").alias("seq")))
    versions = versions.join(born, "article_id")
    steady = versions.groupBy("article_id", "born").agg(
        F.min("content_fingerprint").alias("content_fingerprint"),
        F.max("content_fingerprint").alias("_max"), F.min("since").alias("since"),
        F.min("seq").alias("seq"))
    moving = steady.filter("content_fingerprint <> _max").select("article_id")
    earliest = steady.filter("content_fingerprint = _max").groupBy("content_fingerprint").agg(
        F.min(F.struct("born", "article_id")).alias("base"))
    # validity of each version of a changed article: until the next version
    mv = versions.join(moving, "article_id", "left_semi").withColumn(
        "_o", -F.unix_micros("since")).withColumn("_q", -F.col("seq"))
    mv = running_lag(mv, ["article_id"], ["_o", "_q"], None, ["since", "seq"], "until")
    mv = mv.join(earliest, "content_fingerprint", "left").filter(
        F.col("base").isNull() | (F.struct("born", "article_id") < F.col("base")))
    ins = changed.filter((F.col("kind") == "INSERT")
                         & (F.col("fingerprint_input_length") >= min_chars)).select(
        "raw_id", "content_fingerprint", F.struct("created_at", "raw_id").alias("at"))
    special = ins.join(
        mv.select("content_fingerprint", F.struct(F.col("since").alias("created_at"),
                                                  F.col("seq").alias("raw_id")).alias("from"),
                  F.struct(F.col("until.since").alias("created_at"),
                           F.col("until.seq").alias("raw_id")).alias("to"),
                  F.col("until").isNull().alias("open"), F.struct("born", "article_id").alias("m")),
        "content_fingerprint",
    ).filter((F.col("from") < F.col("at")) & (F.col("open") | (F.col("at") <= F.col("to"))))
    special = special.groupBy("raw_id").agg(F.min("m").alias("m"))
    return ins.join(earliest, "content_fingerprint", "left").join(special, "raw_id", "left").select(
        "raw_id",
        F.least("m", F.when(
            F.col("base") < F.struct(
                F.struct(F.lit(1).alias("new"), F.col("at.created_at").alias("at")).alias("born"),
                F.col("raw_id").alias("article_id")),
            F.col("base")))["article_id"].alias("duplicate_of"),
    ).filter("duplicate_of IS NOT NULL")


def process_raw(pending: DataFrame, articles: DataFrame, *,
                min_fingerprint_chars: int = policy.MIN_FINGERPRINT_CHARS,
                fold_rows: int = FOLD_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(raw outcomes, articles', revised article ids) for normalized pending revisions.

    UPDATE replaces the material and the endpoint/revision of an article but keeps its id,
    source, first_seen_at and duplicate_of; duplicates and conflicts change no article.
    """
    done = cut_lineage(identity_outcomes(pending, articles, fold_rows=fold_rows))
    copies = _content_originals(pending, done, articles, min_fingerprint_chars)
    done = done.join(copies, "raw_id", "left")
    kind = F.col("kind")
    conflict = kind.endswith("CONFLICT")
    raw = done.select(
        "raw_id",
        F.when(conflict, "REJECTED").otherwise("PROCESSED").alias("status"),
        F.when((kind == "INSERT") & F.col("duplicate_of").isNotNull(), "CONTENT_DUPLICATE")
        .when(kind == "INSERT", "ARTICLE_CREATED").when(kind == "UPDATE", "ARTICLE_UPDATED")
        .otherwise(kind).alias("outcome"),
        F.when(conflict, kind).otherwise("").alias("rejection_reason"),
        F.when(kind != "IDENTITY_CONFLICT", F.col("article_id")).alias("article_id"),
    )
    material = [c for c in articles.columns if c not in {
        "article_id", "source_id", "duplicate_of", "first_seen_at", "created_at", "updated_at"}]
    applied = done.filter(kind.isin("INSERT", "UPDATE")).join(
        pending.withColumnRenamed("raw_id", "_raw").withColumn("raw_id", F.col("_raw")), "raw_id")
    order = F.struct("created_at", "raw_id")
    last = applied.groupBy("article_id").agg(
        F.max_by(F.struct(*material, "source_id", F.col("created_at").alias("at")), order).alias("v"),
        F.min_by(F.struct(F.col("fetched_at").alias("first_seen_at"), "created_at", "duplicate_of"),
                 order).alias("b"))
    old = articles.select("article_id", F.struct(
        "source_id", "first_seen_at", "created_at", "duplicate_of", "updated_at").alias("o"),
        F.struct(*material).alias("om"))
    merged = old.join(last, "article_id", "full").select(
        "article_id",
        F.coalesce("o.source_id", "v.source_id").alias("source_id"),
        *[F.when(F.col("v").isNotNull(), F.col(f"v.{c}")).otherwise(F.col(f"om.{c}")).alias(c)
          for c in material],
        F.when(F.col("o").isNotNull(), F.col("o.duplicate_of")).otherwise(F.col("b.duplicate_of"))
        .alias("duplicate_of"),
        F.coalesce("o.first_seen_at", "b.first_seen_at").alias("first_seen_at"),
        F.coalesce("o.created_at", "b.created_at").alias("created_at"),
        F.coalesce("v.at", "o.updated_at").alias("updated_at"),
    ).select(*articles.columns)
    revised = done.filter("kind = 'UPDATE'").select("article_id").distinct()
    return raw, merged, revised
