"""Feed documents in a table column to neutral items, inside the JVM.

`parse_rss` and `parse_jsonfeed` return one row per entry with `reject_reason` (NULL for a
usable item); a document that cannot be read gives one row with position NULL and reason
MALFORMED. `SOURCE_ADAPTERS` maps a feed kind to its parser and may be extended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .. import policy
from ..functions.text import SPACE, parse_zoned

ITEM_COLUMNS = ["external_id", "url", "title", "summary_html", "content_html", "published_at",
                "updated_at", "authors", "language", "raw"]


def _nonblank(value: Column) -> Column:
    return F.when(value.rlike(f"[^{SPACE}]"), value)


def _first(*values: Column) -> Column:
    return F.coalesce(*[F.when(v != "", v) for v in values])


def _reject(malformed: Column) -> Column:
    blank = lambda c: _nonblank(F.coalesce(F.col(c), F.lit(""))).isNull()
    return (
        F.when(malformed, "MALFORMED_ENTRY")
        .when(blank("external_id") & blank("url"), "MISSING_IDENTITY")
        .when(blank("title") & blank("summary_html") & blank("content_html"), "EMPTY_ENTRY")
    )


# --- RSS 2.0, RSS 1.0 (RDF) and Atom ------------------------------------------------

_LINK = "array<struct<_VALUE:string,_rel:string,_href:string,_type:string,_length:string>>"
_CATEGORY = "array<struct<_VALUE:string,_domain:string,_term:string,_scheme:string,_label:string>>"
_ENCLOSURE = "array<struct<_url:string,_type:string,_length:string>>"
_ITEM = (
    f"struct<title:string,link:{_LINK},guid:struct<_VALUE:string,_isPermaLink:string>,"
    "description:string,`content:encoded`:string,pubDate:string,`dc:date`:string,updated:string,"
    "author:string,`dc:creator`:array<string>,`dc:language`:string,language:string,"
    f"category:{_CATEGORY},enclosure:{_ENCLOSURE},"
    "source:struct<_VALUE:string,_url:string>>"
)
_ENTRY = (
    f"struct<`_xml:lang`:string,id:string,title:string,link:{_LINK},summary:string,"
    "content:array<struct<_VALUE:string,_type:string,`_xml:lang`:string>>,published:string,"
    f"updated:string,author:array<struct<name:string>>,category:{_CATEGORY}>"
)
_FEED = (
    f"`_xml:lang` string, channel struct<language:string,`dc:language`:string,item:array<{_ITEM}>>, "
    f"item array<{_ITEM}>, entry array<{_ENTRY}>, _bad string"
)
_XHTML = '(<content[^>]*type="(?:xhtml|application/xhtml\\+xml)"[^>]*>)([\\s\\S]*?)(</content>)'
# Zone names a feed date may carry, with their offsets.
_ZONES = {"GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EST": "-0500",
          "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600",
          "PST": "-0800", "PDT": "-0700"}


def feed_date(value: Column) -> Column:
    """RFC 822 or ISO date as an instant, else NULL."""
    text = F.regexp_replace(F.trim(value), "^[A-Za-z]{3,9},?\\s+(?=\\d)", "")
    zone = F.regexp_extract(text, "\\s([A-Za-z]{1,3})$", 1)
    named = F.element_at(F.create_map(*[F.lit(x) for kv in _ZONES.items() for x in kv]), F.upper(zone))
    text = F.when(zone != "", F.regexp_replace(text, "\\s[A-Za-z]{1,3}$", "")).otherwise(text)
    text = F.when((zone != "") & named.isNotNull(), F.concat_ws(" ", text, named)).otherwise(text)
    shaped = text.rlike("^\\d{1,2} [A-Z][a-z]{2} \\d{4} \\d{2}:\\d{2}(:\\d{2})? [+-]\\d{4}$")
    full = F.when(text.rlike("\\d{2}:\\d{2}:\\d{2} "), text).otherwise(
        F.regexp_replace(text, "(\\d{2}:\\d{2}) ", "$1:00 "))
    day = F.to_date(F.when(F.trim(value).rlike("^\\d{4}-\\d{2}-\\d{2}$"), F.trim(value)))
    return F.coalesce(
        F.when(shaped, F.try_to_timestamp(full, F.lit("d MMM yyyy HH:mm:ss xx"))),
        parse_zoned(value), day.cast("timestamp"))


def _person(value: Column) -> Column:
    """The name in `mail@host (Name)`, else the text."""
    name = F.regexp_extract(value, "^\\s*\\S+@\\S+\\s*\\(([^)]*)\\)", 1)
    return F.when(name != "", name).otherwise(value)


def _date_error(pairs: dict[str, tuple[Column, Column]]) -> Column:
    errors = [F.when(F.coalesce(text, F.lit("")).rlike("\\S") & at.isNull(), F.lit(n))
              for n, (text, at) in pairs.items()]
    return F.array_join(F.array_compact(F.array(*errors)), ",")


def _raw_map(entries: dict[str, Column]) -> Column:
    """map of the entries that are neither NULL nor empty; lists are JSON text."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
                      for k, v in entries.items()])
    return F.map_from_entries(F.filter(
        pairs, lambda p: F.coalesce(~p["value"].isin("", "[]", "{}"), F.lit(False))))


def _bounded(value: Column) -> Column:
    return F.substring(value, 1, policy.RAW_TEXT_CHARS)


def _tags(category: Column) -> Column:
    return F.to_json(F.transform(
        F.slice(F.coalesce(category, F.array().cast(_CATEGORY)), 1, policy.RAW_LIST_ITEMS),
        lambda c: F.struct(_bounded(F.coalesce(c["_term"], c["_VALUE"])).alias("term"),
                           _bounded(F.coalesce(c["_scheme"], c["_domain"])).alias("scheme"),
                           _bounded(c["_label"]).alias("label"))))


def parse_rss(documents: DataFrame, body: str = "body") -> DataFrame:
    """Syndication documents to entries."""
    keep = [c for c in documents.columns if c != body]
    fenced = F.regexp_replace(body, _XHTML, "$1<![CDATA[$2]]>$3")
    feed = documents.select(*keep, F.from_xml(
        fenced, _FEED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"))
    feed = feed.withColumn("_lang", _first(F.col("x.channel.language"), F.col("x.channel.`dc:language`"),
                                           F.col("x.`_xml:lang`")))
    no_entries = (F.coalesce(F.size("x.channel.item"), F.lit(-1)) < 1) & (
        F.coalesce(F.size("x.item"), F.lit(-1)) < 1) & (F.coalesce(F.size("x.entry"), F.lit(-1)) < 1)
    broken = feed.filter(F.col("x._bad").isNotNull() & no_entries)

    items = feed.select(*keep, "_lang", F.posexplode(F.concat(
        F.coalesce("x.channel.item", F.array().cast(f"array<{_ITEM}>")),
        F.coalesce("x.item", F.array().cast(f"array<{_ITEM}>")))).alias("position", "i"))
    g, link = F.col("i.guid._VALUE"), F.get(F.filter(
        F.col("i.link"), lambda x: F.coalesce(x["_VALUE"], F.lit("")) != ""), F.lit(0))["_VALUE"]
    alternate = F.get(F.filter(F.col("i.link"), lambda x: x["_rel"] == "alternate"), F.lit(0))["_href"]
    permalink = F.when(F.coalesce(F.col("i.guid._isPermaLink"), F.lit("true")) != "false", g)
    published, updated = feed_date(_first(F.col("i.pubDate"), F.col("i.`dc:date`"))), feed_date(F.col("i.updated"))
    creators = F.filter(F.coalesce("i.`dc:creator`", F.array().cast("array<string>")), lambda a: a != "")
    authors = F.when(F.coalesce(F.col("i.author"), F.lit("")) != "", F.array(_person(F.col("i.author"))))
    content = _first(F.col("i.`content:encoded`"))
    rss = items.select(
        *keep, "position",
        _first(g).alias("external_id"), _first(alternate, link, permalink).alias("url"),
        _first(F.col("i.title")).alias("title"),
        _first(F.col("i.description"), content).alias("summary_html"), content.alias("content_html"),
        F.coalesce(published, updated).alias("published_at"), updated.alias("updated_at"),
        F.coalesce(authors, creators).alias("authors"),
        _first(F.col("i.language"), F.col("i.`dc:language`"), F.col("_lang")).alias("language"),
        _raw_map({
            "tags": _tags(F.col("i.category")),
            "enclosures": F.to_json(F.transform(
                F.slice(F.coalesce("i.enclosure", F.array().cast(_ENCLOSURE)), 1, policy.RAW_LIST_ITEMS),
                lambda e: F.struct(_bounded(e["_url"]).alias("href"), _bounded(e["_type"]).alias("type"),
                                   _bounded(e["_length"]).alias("length")))),
            "source": F.to_json(F.struct(_bounded(F.col("i.source._VALUE")).alias("title"),
                                         _bounded(F.col("i.source._url")).alias("href"))),
            "guid": _bounded(g), "guidislink": F.when(g.isNotNull(), permalink.isNotNull()),
            "date_parse_error": _date_error({
                "published": (_first(F.col("i.pubDate"), F.col("i.`dc:date`")), published),
                "updated": (F.col("i.updated"), updated)}),
        }).alias("raw"))

    entries = feed.select(*keep, "_lang", F.posexplode("x.entry").alias("position", "e"))
    typed = lambda kinds: F.get(F.filter(
        F.col("e.content"), lambda c: F.lower(F.coalesce(c["_type"], F.lit("text"))).isin(*kinds)), F.lit(0))
    best = F.coalesce(*[F.when(part["_VALUE"].isNotNull(), part["_VALUE"]) for part in (
        typed(["text/html", "html"]), typed(["application/xhtml+xml", "xhtml"]),
        typed(["text/plain", "text", "plain"]))])
    links = F.col("e.link")
    alt = F.get(F.filter(links, lambda x: (F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
                         & (F.coalesce(x["_href"], F.lit("")) != "")), F.lit(0))["_href"]
    published, updated = feed_date(F.col("e.published")), feed_date(F.col("e.updated"))
    part_lang = F.get(F.filter(F.col("e.content"), lambda c: c["_xml:lang"].isNotNull()), F.lit(0))["_xml:lang"]
    atom = entries.select(
        *keep, "position",
        _first(F.col("e.id")).alias("external_id"), _first(alt).alias("url"),
        _first(F.col("e.title")).alias("title"), _first(F.col("e.summary"), best).alias("summary_html"),
        _first(best).alias("content_html"), F.coalesce(published, updated).alias("published_at"),
        updated.alias("updated_at"),
        F.filter(F.coalesce(F.transform("e.author", lambda a: a["name"]), F.array().cast("array<string>")),
                 lambda n: n != "").alias("authors"),
        _first(F.col("e.`_xml:lang`"), part_lang, F.col("_lang")).alias("language"),
        _raw_map({
            "tags": _tags(F.col("e.category")),
            "enclosures": F.to_json(F.transform(
                F.slice(F.filter(links, lambda x: x["_rel"] == "enclosure"), 1, policy.RAW_LIST_ITEMS),
                lambda e: F.struct(_bounded(e["_href"]).alias("href"), _bounded(e["_type"]).alias("type"),
                                   _bounded(e["_length"]).alias("length")))),
            "date_parse_error": _date_error({
                "published": (F.col("e.published"), published),
                "updated": (F.col("e.updated"), updated)}),
        }).alias("raw"))
    found = rss.unionByName(atom)
    return _finish(found.withColumn("_m", F.lit(False)), broken.select(*keep), keep)


def _finish(found: DataFrame, broken: DataFrame, keep: list[str]) -> DataFrame:
    rows = found.withColumn("reject_reason", _reject(F.col("_m"))).select(
        *keep, "position", *ITEM_COLUMNS, "reject_reason")
    empty = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ["position", *ITEM_COLUMNS]]
    return rows.unionByName(broken.select(*keep, *empty, F.lit("MALFORMED").alias("reject_reason")))


# --- JSON Feed ---------------------------------------------------------------------

_RFC3339 = "^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?(Z|[+-]\\d{2}:\\d{2})$"


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _string(v: Column, path: str) -> Column:
    """The value at `path` if it is a nonblank JSON string."""
    got = F.try_variant_get(v, path, "variant")
    return F.when(_kind(got) == "STRING", _nonblank(F.try_variant_get(v, path, "string")))


def _list(v: Column, path: str) -> Column:
    return F.coalesce(F.when(_kind(F.try_variant_get(v, path, "variant")).startswith("ARRAY"),
                             F.try_variant_get(v, path, "array<variant>")),
                      F.array().cast("array<variant>"))


def parse_jsonfeed(documents: DataFrame, body: str = "body") -> DataFrame:
    """JSON Feed 1.x documents to entries."""
    keep = [c for c in documents.columns if c != body]
    doc = documents.select(*keep, F.try_parse_json(body).alias("v"))
    version = F.when(_kind(F.try_variant_get("v", "$.version", "variant")) == "STRING",
                     F.try_variant_get("v", "$.version", "string"))
    usable = F.coalesce(
        _kind(F.col("v")).startswith("OBJECT")
        & version.rlike("^https://jsonfeed\\.org/version/1(\\.[0-9]+)?$")
        & _kind(F.try_variant_get("v", "$.items", "variant")).startswith("ARRAY"), F.lit(False))
    doc = doc.withColumn("_ok", usable)
    e = doc.filter("_ok").select(
        *keep, _string(F.col("v"), "$.language").alias("_lang"),
        F.posexplode(_list(F.col("v"), "$.items")).alias("position", "e"))
    item = F.col("e")
    type_of = lambda f: _kind(F.try_variant_get(item, f"$.{f}", "variant"))
    wrong = lambda f: F.coalesce(~type_of(f).isin("STRING", "VOID"), F.lit(False))
    malformed = ~F.coalesce(_kind(item).startswith("OBJECT"), F.lit(False)) | wrong("id") | wrong("url")

    def date(f: str) -> Column:
        text = F.when(type_of(f) == "STRING", F.try_variant_get(item, f"$.{f}", "string"))
        return F.when(text.rlike(_RFC3339), F.try_to_timestamp(text))

    present = lambda f: F.coalesce(type_of(f) != "VOID", F.lit(False))
    published, updated = date("date_published"), date("date_modified")
    names = F.filter(F.transform(_list(item, "$.authors"), lambda a: _string(a, "$.name")),
                     lambda n: n.isNotNull())
    one = _string(item, "$.author.name")
    authors = F.when(F.size(names) > 0, names).otherwise(F.array_compact(F.array(one)))
    number = lambda a, f: F.when(
        F.try_variant_get(a, f"$.{f}", "double").between(0, 1e12)
        & ~F.coalesce(_kind(F.try_variant_get(a, f"$.{f}", "variant")).isin("STRING", "BOOLEAN"), F.lit(True)),
        F.try_variant_get(a, f"$.{f}", "double"))
    tags = F.slice(F.filter(F.transform(
        _list(item, "$.tags"), lambda t: _bounded(_string(t, "$"))), lambda t: t.isNotNull()),
        1, policy.RAW_LIST_ITEMS)
    attachments = F.transform(
        F.slice(_list(item, "$.attachments"), 1, policy.RAW_LIST_ITEMS),
        lambda a: F.struct(
            *[_bounded(_string(a, f"$.{f}")).alias(f) for f in ("url", "mime_type", "title")],
            *[number(a, f).alias(f) for f in ("size_in_bytes", "duration_in_seconds")]))
    errors = F.array_join(F.array_compact(F.array(*[
        F.when(present(f) & at.isNull(), F.lit(f))
        for f, at in (("date_published", published), ("date_modified", updated))])), ",")
    rows = e.select(
        *keep, "position", malformed.alias("_m"),
        _string(item, "$.id").alias("external_id"), _string(item, "$.url").alias("url"),
        _string(item, "$.title").alias("title"), _string(item, "$.summary").alias("summary_html"),
        F.coalesce(_string(item, "$.content_html"), _string(item, "$.content_text")).alias("content_html"),
        published.alias("published_at"), updated.alias("updated_at"), authors.alias("authors"),
        F.coalesce(_string(item, "$.language"), F.col("_lang")).alias("language"),
        _raw_map({"tags": F.to_json(tags), "external_url": _bounded(_string(item, "$.external_url")),
                  "attachments": F.to_json(F.filter(attachments, lambda a: F.to_json(a) != "{}")),
                  "date_parse_error": errors}).alias("raw"))
    return _finish(rows, doc.filter("NOT _ok").select(*keep), keep)


SOURCE_ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "RSS": parse_rss, "JSON_FEED": parse_jsonfeed,
}


def parse_documents(documents: DataFrame, kind: str = "kind") -> DataFrame:
    """Documents of several kinds, each through its adapter."""
    parts = [adapter(documents.filter(F.col(kind) == name)) for name, adapter in SOURCE_ADAPTERS.items()]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def items(entries: DataFrame) -> DataFrame:
    return entries.filter("reject_reason IS NULL").drop("reject_reason")


def rejects(entries: DataFrame) -> DataFrame:
    return entries.filter("reject_reason IS NOT NULL").drop(*ITEM_COLUMNS)
