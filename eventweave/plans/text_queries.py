"""Scalar rules over whole texts, pages and URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import policy
from ..functions import sentences as sn
from ..functions import text as tx
from ..functions import urls, words as w
from ..operators import dedup, enrich, read, reading, refresh
from ..operators.candidates import article_anchors
from ..operators.revisions import bound_payload
from ..policy import DEFAULT_POLICY
from ..sources import tables as t
from .registry import query, words

# --- SQL spellings of the text rules ------------------------------------------------


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def name_key(x: str) -> str:
    return collapse(f"regexp_replace({fold(x)}, '[\\p{{P}}\\p{{S}}]', ' ', 'g')")


L = "[\\p{L}\\p{Nl}\\p{No}]"

CANONICAL = """
    parts AS (
      SELECT *, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?([^#]*))?',
        ['scheme', 'netloc', 'path', 'q', 'query']) AS p FROM raw_url),
    split AS (
      SELECT *, lower(p.scheme) AS s, lower(split_part(p.netloc, ':', 1)) AS h,
        CASE WHEN p.netloc LIKE '%:%' THEN TRY_CAST(split_part(p.netloc, ':', 2) AS INT) END AS port,
        list_filter(list_transform(string_split(p.query, '&'), lambda x, i: {'k': split_part(x, '=', 1),
          'i': i, 'raw': x}), lambda x: NOT (starts_with(lower(x.k), 'utm_') OR
          list_contains(TRACKING, lower(x.k)))) AS items FROM parts),
    canon AS (
      SELECT *, CASE WHEN s IN ('http', 'https') AND h <> '' AND p.netloc NOT LIKE '%@%' THEN
        s || '://' || h || CASE WHEN port IS NULL OR port = CASE s WHEN 'http' THEN 80 ELSE 443 END
          THEN '' ELSE ':' || port END
        || CASE WHEN p.path = '' THEN '/' ELSE p.path END
        || CASE WHEN p.query = '' OR len(items) = 0 THEN '' ELSE '?' || array_to_string(
          list_transform(list_sort(items), lambda x: x.raw), '&') END END AS curl FROM split)
""".replace("TRACKING", words(w.TRACKING_KEYS))


def _pages(spark, d):
    return t.read(spark, d, "pages")


def _docs(spark, d):
    return t.read(spark, d, "documents")


# markup that patterns would read wrongly: stray quotes, quoted ">", elements closed by an outer one
_ODD = """<p title=it's>one</p><a title=5">two</a><svg><g><svg></g>no<p>no</p></svg><b x="a>b" y='<p>'>three</b><p>"""
_ODD_TEXT = "one\ntwothree"


def visible(html: str) -> str:
    """The visible lines of the given pages' markup, whose tags nest and quote nothing."""
    bare = f"regexp_replace({html}, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<!DOCTYPE[^>]*>', '', 'g')"
    bare = f"regexp_replace({bare}, '</?({'|'.join(sorted(w.HTML_BLOCKS))}|br)(\\s[^>]*)?/?>', chr(10), 'g')"
    bare = f"regexp_replace({bare}, '</?[a-zA-Z][^>]*>', '', 'g')"
    for name, sign in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        bare = f"regexp_replace({bare}, '&{name};?', '{sign}', 'g')"
    return (f"array_to_string(list_filter(list_transform(string_split({bare}, chr(10)), "
            f"lambda x: {collapse('x')}), lambda x: x <> ''), chr(10))")


@query("html_text", f"""
    SELECT page_id, '{_ODD_TEXT}' || chr(10) || {visible("coalesce(html, '')")} AS text FROM pages""")
def html_text(spark, d):
    return _pages(spark, d).select("page_id", tx.html_text(F.concat(F.lit(_ODD), F.coalesce("html", F.lit("")))).alias("text"))


@query("collapse_text", f"SELECT doc_id, {collapse('text')} AS text FROM documents")
def collapse_text(spark, d):
    return _docs(spark, d).select("doc_id", tx.clean_text("text").alias("text"))


@query("canonical_url", f"WITH raw_url AS (SELECT page_id, url FROM pages), {CANONICAL} "
                        "SELECT page_id, curl AS canonical_url FROM canon")
def canonical_url(spark, d):
    return _pages(spark, d).select("page_id", urls.canonical_url("url").alias("canonical_url"))


@query("external_key", f"""
    WITH raw_url AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN 'id' || page_id ELSE ' ' END AS eid
      FROM pages), {CANONICAL}
    SELECT page_id, CASE WHEN trim(eid) <> '' THEN 'EXTERNAL_ID' WHEN curl IS NOT NULL
      THEN 'CANONICAL_URL' END AS kind, CASE WHEN trim(eid) <> '' THEN eid ELSE curl END AS value
    FROM canon""")
def external_key(spark, d):
    eid = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("id"), F.col("page_id").cast("string"))).otherwise(" ")
    return _pages(spark, d).select("page_id", urls.external_key(eid, F.col("url")).alias("k")).select(
        "page_id", "k.kind", "k.value")


@query("payload_hash", """
    SELECT page_id, sha256('{"html":' || j.h || ',"lang":null,"url":"' || url || '"}') AS hash,
      octet_length(encode('{"html":' || j.h || ',"lang":null,"url":"' || url || '"}')) AS bytes
    FROM (SELECT *, {'h': '"' || replace(replace(replace(html, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n')
      || '"'} AS j FROM pages)""")
def payload_hash(spark, d):
    body = F.struct("html", F.lit(None).cast("string").alias("lang"), "url")
    return _pages(spark, d).select(
        "page_id", tx.payload_hash(body).alias("hash"),
        F.octet_length(tx.payload_json(body)).cast("long").alias("bytes"))


_FINGER = (f"{fold('title')} || chr(10) || " + collapse("body_text"))


@query("content_fingerprint", f"""
    SELECT article_id, sha256({_FINGER}) AS content_fingerprint, length({_FINGER}) AS input_length
    FROM article""")
def content_fingerprint(spark, d):
    a = t.articles(spark, d)
    finger = tx.fingerprint_input("title", "body_text", "description")
    return a.select("article_id", F.sha2(finger, 256).alias("content_fingerprint"),
                    F.length(finger).cast("long").alias("input_length"))


@query("parse_published", """
    SELECT event_id, CASE WHEN event_id % 4 <> 1 AND event_id % 4 <> 2 THEN
      epoch_us(ts) - CASE WHEN event_id % 4 = 3 THEN 7200000000 ELSE 0 END END AS micros FROM events""")
def parse_published(spark, d):
    e = t.events(spark, d)
    m = F.col("event_id") % 4
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    raw = F.when(m == 0, F.concat(text, F.lit("Z"))).when(m == 1, text).when(
        m == 2, F.concat(text, F.lit(" soon"))).otherwise(F.concat(text, F.lit("+02:00")))
    return e.select("event_id", F.unix_micros(tx.parse_zoned(raw)).alias("micros"))


@query("byline", """
    SELECT user_id, substr(coalesce(string_agg(n, ', ' ORDER BY i), ''), 1, 512) AS byline FROM (
      SELECT user_id, event_id AS i, CASE event_type WHEN 'view' THEN '' ELSE event_type || ' ' || k END AS n
      FROM ev) WHERE n <> '' GROUP BY user_id""")
def byline(spark, d):
    """Each user's event names as authors."""
    e = t.events(spark, d).withColumn("n", F.when(F.col("event_type") == "view", "  ").otherwise(
        F.concat(F.lit(" "), "event_type", F.lit("  "), F.col("k").cast("string"))))
    # only as many names are gathered as the bounded line can hold
    from ..operators.skew import top_rows

    kept = top_rows(e.filter(F.trim("n") != ""), ["user_id"], ["event_id"], policy.MAX_BYLINE_CHARS)
    names = kept.groupBy("user_id").agg(F.transform(F.sort_array(
        F.collect_list(F.struct("event_id", "n"))), lambda x: x["n"]).alias("a"))
    return names.select("user_id", tx.byline("a").alias("byline"))


@query("article_language", """
    SELECT doc_id, substr(lower(CASE WHEN trim(l) <> '' THEN trim(l) ELSE default_language END), 1, 16)
      AS language
    FROM (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE upper(lang) || '-Latn-extended-x' END
      AS l FROM documents) JOIN source_t ON source = source_id""")
def article_language(spark, d):
    docs = _docs(spark, d).select("doc_id", F.col("source").alias("source_id"), F.when(
        F.col("doc_id") % 3 == 0, " ").otherwise(F.concat(F.upper("lang"), F.lit("-Latn-extended-x"))).alias("l"))
    return docs.join(t.sources(spark, d), "source_id").select(
        "doc_id", tx.article_language("l", "default_language").alias("language"))


@query("normalize_articles", f"""
    WITH raw_url AS (SELECT item_id, CASE WHEN item_id % 10 = 5 THEN 'http://bad host/' ELSE url END AS url FROM page_item),
    {CANONICAL},
    plain AS (SELECT item_id, language, CASE WHEN item_id % 10 = 3 THEN '' ELSE {collapse('title')} END AS title,
        CASE WHEN item_id % 1000 = 7 THEN concat_ws(chr(10), nullif({visible('content_html')}, ''),
          rtrim(repeat('word ', {policy.MAX_BODY_CHARS // 5 + 1}))) ELSE {visible('content_html')} END AS body FROM page_item),
    judged AS (SELECT p.*, c.curl, CASE WHEN title = '' AND body = '' THEN 'EMPTY_ENTRY' WHEN title = '' THEN 'MISSING_TITLE'
        WHEN length(body) > {policy.MAX_BODY_CHARS} THEN 'BODY_TOO_LARGE' WHEN c.curl IS NULL OR contains(c.url, ' ') THEN 'MISSING_CANONICAL_URL'
        ELSE '' END AS reject_reason FROM plain p JOIN canon c USING (item_id))
    SELECT item_id, CASE WHEN ok THEN curl END AS canonical_url, CASE WHEN ok THEN substr(title, 1, 512) END AS title,
      CASE WHEN ok THEN length(body) END AS body_chars, CASE WHEN ok THEN lower(language) END AS language,
      CASE WHEN ok THEN sha256({fold('substr(title, 1, 512)')} || chr(10) || {collapse('body')}) END AS content_fingerprint,
      reject_reason FROM (SELECT *, reject_reason = '' AS ok FROM judged)""")
def normalize_articles(spark, d):
    """Pages as publications; titles that look empty, broken URLs and bodies made longer than the
    rule's bound are rejected."""
    items = t.page_items(spark, d)
    n = F.col("item_id") % 10
    longer = F.repeat(F.lit(" word"), policy.MAX_BODY_CHARS // 5 + 1)
    items = items.withColumn("content_html", F.when(F.col("item_id") % 1000 == 7, F.concat(
        "content_html", F.lit("<p>"), longer, F.lit("</p>"))).otherwise(F.col("content_html")))
    items = items.withColumn("title", F.when(n == 3, " ").otherwise(F.col("title"))).withColumn(
        "url", F.when(n == 5, F.lit("http://bad host/")).otherwise(F.col("url")))
    good, bad = dedup.normalize_articles(items)
    return good.select(
        "item_id", "canonical_url", "title", F.length("body_text").cast("long").alias("body_chars"),
        "language", "content_fingerprint", F.lit("").alias("reject_reason")
    ).unionByName(bad.select("item_id", "reject_reason"), allowMissingColumns=True)


@query("normalize_documents", f"""
    SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'MISSING_TITLE' WHEN n > {policy.MAX_BODY_CHARS} THEN 'BODY_TOO_LARGE'
        WHEN doc_id % 10 = 5 THEN 'MISSING_CANONICAL_URL' ELSE '' END AS reject_reason,
      CASE WHEN doc_id % 10 IN (3, 5) OR n > {policy.MAX_BODY_CHARS} THEN NULL ELSE n END AS body_chars,
      CASE WHEN doc_id % 10 IN (3, 5) OR n > {policy.MAX_BODY_CHARS} THEN NULL ELSE
        sha256({fold('substr(tt, 1, 512)')} || chr(10) || {collapse('b')}) END AS content_fingerprint
    FROM (SELECT doc_id, {collapse("split_part(text, chr(10), 1)")} AS tt, b, length(b) AS n FROM (
      SELECT *, array_to_string(list_filter(list_transform(string_split(text, chr(10)),
        lambda x: {collapse('x')}), lambda x: x <> ''), chr(10)) AS b
      FROM (SELECT doc_id, translate(text, '<&', '()') || CASE WHEN doc_id % 1000 = 8
          THEN chr(10) || rtrim(repeat('word ', {policy.MAX_BODY_CHARS // 5 + 1})) ELSE '' END AS text FROM documents)))""")
def normalize_documents(spark, d):
    """Documents as plain text publications: markup signs are spelled otherwise, as SQL reads none. Some bodies are made
    longer than the rule's bound."""
    n = F.col("doc_id") % 10
    longer = F.concat(F.lit("\nword"), F.repeat(F.lit(" word"), policy.MAX_BODY_CHARS // 5))
    docs = _docs(spark, d).withColumn("text", F.concat(
        F.translate("text", "<&", "()"), F.when(F.col("doc_id") % 1000 == 8, longer).otherwise("")))
    items = docs.select(
        "doc_id", F.lit("").alias("external_id"), F.lit("").alias("summary_html"),
        F.when(n == 3, " ").otherwise(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"),
        F.col("text").alias("content_html"),
        F.when(n == 5, "nowhere").otherwise(F.concat(F.lit("https://e.example/"), F.col("doc_id").cast("string")))
        .alias("url"), F.col("lang").alias("language"))
    good, bad = dedup.normalize_articles(items)
    return good.select(
        "doc_id", F.lit("").alias("reject_reason"), F.length("body_text").cast("long").alias("body_chars"),
        "content_fingerprint").unionByName(bad, allowMissingColumns=True)


@query("language_key", """
    SELECT doc_id, lower(split_part(trim(l), '-', 1)) AS language_key FROM (
      SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN upper(lang) || '-GB' WHEN 1 THEN ' ' || lang ELSE lang END AS l
      FROM documents)""")
def language_key(spark, d):
    m = F.col("doc_id") % 3
    raw = F.when(m == 0, F.concat(F.upper("lang"), F.lit("-GB"))).when(
        m == 1, F.concat(F.lit(" "), "lang")).otherwise(F.col("lang"))
    return _docs(spark, d).select("doc_id", tx.language_key(raw).alias("language_key"))


@query("event_time", "SELECT article_id, epoch(coalesce(published_at, first_seen_at))::BIGINT AS t FROM article")
def event_time(spark, d):
    return t.articles(spark, d).select("article_id", F.unix_timestamp(tx.event_time()).alias("t"))


@query("time_gap", """
    SELECT article_id, story_id, greatest(epoch_us(first_time) - epoch_us(event_time),
      epoch_us(event_time) - epoch_us(last_time), 0) AS gap_us
    FROM vart JOIN vmember USING (article_id)
      JOIN (SELECT story_id - 1 AS story_id, first_time, last_time FROM vstats) USING (story_id)""")
def time_gap(spark, d):
    """Each article against the next story of its label."""
    from ..operators.candidates import member_stats
    from ..operators.match import time_gap as gap

    members, arts = t.vector_membership(spark, d), t.vector_articles(spark, d)
    stats = member_stats(members, arts).withColumn("story_id", F.col("story_id") - 1)
    return members.join(arts, "article_id").join(stats, "story_id").select(
        "article_id", "story_id",
        gap(F.col("event_time"), F.col("first_time"), F.col("last_time")).alias("gap_us"))


@query("embedding_input", f"""
    SELECT article_id, rtrim(substr(array_to_string(list_filter([{collapse('title')},
      {collapse('body_text')}], lambda x: x <> ''), chr(10) || chr(10)), 1, {policy.EMBEDDING_CHARS})) AS text
    FROM article""")
def embedding_input(spark, d):
    return t.articles(spark, d).select("article_id", tx.embedding_input(
        "title", "description", "body_text", policy.EMBEDDING_CHARS).alias("text"))


# words of a text with sentence position, as the anchor rule sees them
_ANCHOR_SQL = f"""
    WITH body AS (SELECT article_id, title, {collapse('body_text')} AS text FROM article),
    sent AS (
      SELECT article_id, false AS is_text, unnest(string_split(regexp_replace(regexp_replace(
        title, '([.!?:;])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1))) AS s FROM body
      UNION ALL
      SELECT article_id, true, unnest(string_split(regexp_replace(regexp_replace(
        text, '([.!?:;])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1))) FROM body),
    tok AS (SELECT article_id, is_text, regexp_extract_all(s, '{L}+(?:[''’-]{L}+)*') AS ws FROM sent),
    occ AS (SELECT article_id, is_text, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM tok),
    term AS (
      SELECT article_id, {fold("regexp_replace(w, '[''’]s$', '')")} AS term,
        bool_and(regexp_matches(w, '^\\p{{Lu}}')) AS always,
        bool_or(is_text AND i > 0 AND regexp_matches(w, '^\\p{{Lu}}')) AS strong
      FROM occ GROUP BY ALL),
    anchor AS (SELECT article_id, term, strong FROM term WHERE always AND length(term) > 1
      AND NOT list_contains({words(w.ANCHOR_FUNCTION_WORDS + w.CALENDAR)}, term))
"""


@query("anchor_terms", _ANCHOR_SQL + "SELECT article_id, term, strong FROM anchor")
def anchor_terms(spark, d):
    a = article_anchors(t.articles(spark, d))
    return tx.exploded(a, ["article_id", "strong"], F.col("capitalized"), "term").select(
        "article_id", "term", F.array_contains("strong", F.col("term")).alias("strong"))


@query("shared_anchor_count", _ANCHOR_SQL + """
    SELECT a.article_id, count(DISTINCT a.term) FILTER (a.strong OR b.strong) AS shared
    FROM anchor a JOIN anchor b ON b.article_id = a.article_id + 1 AND a.term = b.term
    GROUP BY a.article_id HAVING count(*) FILTER (a.strong OR b.strong) > 0""")
def shared_anchor_count(spark, d):
    """Each article with the next one."""
    from ..functions.names import shared_anchor_count as shared

    a = article_anchors(t.articles(spark, d))
    b = a.select((F.col("article_id") - 1).alias("article_id"), F.col("capitalized").alias("mc"),
                 F.col("strong").alias("ms"))
    return a.join(b, "article_id").select("article_id", shared(
        F.col("strong"), F.col("capitalized"), F.col("ms"), F.col("mc")).cast("long").alias("shared")
    ).filter("shared > 0")


@query("anchor_set_ops", _ANCHOR_SQL + """
    SELECT story_id, count(DISTINCT term) AS capitalized, count(DISTINCT term) FILTER (strong) AS strong
    FROM anchor JOIN member USING (article_id) GROUP BY story_id""")
def anchor_set_ops(spark, d):
    """Union of the members' anchors per story, as rows."""
    m = t.text_membership(spark, d).select("story_id", "article_id")
    joined = m.join(article_anchors(t.articles(spark, d)), "article_id")
    terms = tx.exploded(joined, ["story_id", F.col("strong").alias("s")], F.col("capitalized"), "term").select(
        "story_id", "term", F.array_contains("s", F.col("term")).alias("strong"))
    union = terms.groupBy("story_id", "term").agg(F.bool_or("strong").alias("strong"))
    return union.groupBy("story_id").agg(
        F.count("*").alias("capitalized"), F.count_if("strong").alias("strong"))


@query("normalize_name", f"SELECT article_id, {name_key('title')} AS key FROM article")
def normalize_name(spark, d):
    return t.articles(spark, d).select("article_id", tx.normalize_name("title").alias("key"))


@query("slugify", f"""
    SELECT article_id, regexp_replace(regexp_replace(strip_accents({name_key('title')}), '[^a-z0-9]+', '-', 'g'),
      '^-+|-+$', '', 'g') AS slug FROM article""")
def slugify(spark, d):
    return t.articles(spark, d).select("article_id", tx.slugify("title").alias("slug"))


# sentences: boundaries are marked, since the SQL regexps cannot look around
SENTENCES = f"""list_filter(string_split(regexp_replace({collapse('body_text')},
    '([.!?]) (["“‘''A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)),
    lambda s: regexp_matches(regexp_replace(s, '["”’'']+$', ''), '[.!?]$')
      AND len(string_split(s, ' ')) >= 4 AND length(s) <= 400)"""


@query("split_sentences", f"""
    SELECT article_id, i - 1 AS ord, ss[i] AS sentence FROM (
      SELECT article_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM (
        SELECT article_id, {SENTENCES} AS ss FROM article))""")
def split_sentences(spark, d):
    return tx.posexploded(t.articles(spark, d), ["article_id"], sn.sentences(F.col("body_text")),
                          "ord", "sentence").withColumn("ord", F.col("ord").cast("long"))


def figures_sql(x: str) -> str:
    return (f"list_sort(list_distinct(list_transform(regexp_extract_all({x}, '\\d+(?:[.,]\\d+)*'), "
            "lambda f: replace(f, ',', ''))))")


def content_sql(x: str) -> str:
    return (f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z]{{3,}}')), "
            f"lambda c: NOT list_contains({words(w.SENTENCE_STOPWORDS)}, c))")


@query("figures", f"""
    SELECT article_id, array_to_string({figures_sql('body_text')}, '|') AS figures,
      len({content_sql('body_text')}) AS content_words FROM article""")
def figures(spark, d):
    return t.articles(spark, d).select(
        "article_id", F.array_join(sn.figures(F.col("body_text")), "|").alias("figures"),
        F.size(sn.content_words(F.col("body_text"))).cast("long").alias("content_words"))


@query("content_words", f"""
    SELECT article_id, unnest({content_sql('body_text')}) AS word FROM article""")
def content_words(spark, d):
    return tx.exploded(t.articles(spark, d), ["article_id"], sn.content_words(F.col("body_text")), "word")


@query("same_point", f"""
    SELECT a.article_id, len(list_intersect(a.w, b.w)) AS shared,
      len(list_intersect(a.w, b.w)) >= 2 AND len(list_intersect(a.w, b.w)) * 2
        >= greatest(least(len(a.w), len(b.w)), 1) AS same_point
    FROM (SELECT article_id, {content_sql('title')} AS w FROM article) a
      JOIN (SELECT article_id - 1 AS article_id, {content_sql('title')} AS w FROM article) b USING (article_id)""")
def same_point(spark, d):
    """Titles of neighbouring articles."""
    a = t.articles(spark, d).select("article_id", sn.content_words(F.col("title")).alias("w"))
    b = a.select((F.col("article_id") - 1).alias("article_id"), F.col("w").alias("v"))
    return a.join(b, "article_id").select(
        "article_id", F.size(F.array_intersect("w", "v")).cast("long").alias("shared"),
        sn.same_point(F.col("w"), F.col("v")).alias("same_point"))


@query("safe_link", """
    SELECT page_id, CASE WHEN page_id % 6 IN (2, 3, 4) THEN NULL ELSE link END AS link FROM (
      SELECT page_id, CASE page_id % 6 WHEN 1 THEN 'http://8.8.' || (page_id % 250) || '.1/x' ELSE url END AS link
      FROM pages)""")
def safe_link(spark, d):
    m, u = F.col("page_id") % 6, F.col("url")
    n = (F.col("page_id") % 250).cast("string")
    link = (F.when(m == 1, F.concat(F.lit("http://8.8."), n, F.lit(".1/x")))
            .when(m == 2, F.concat(F.lit("http://10.0."), n, F.lit(".1/x")))
            .when(m == 3, F.concat(F.lit("https://u:p@h.example/"), n))
            .when(m == 4, F.concat(F.lit("ftp://h.example/"), n)).otherwise(u))
    return _pages(spark, d).select("page_id", urls.safe_link(link).alias("link"))


@query("visible_share", """
    SELECT event_id, round(CASE WHEN least(top + height, 800.0) - greatest(top, 0.0) <= 0 THEN 0.0
      ELSE least(1.0, (least(top + height, 800.0) - greatest(top, 0.0)) / least(height, 800.0)) END, 6) AS share
    FROM (SELECT event_id, CAST(value AS DOUBLE) * 4 - 200 AS top, CAST(k * 20 + 10 AS DOUBLE) AS height FROM ev)""")
def visible_share(spark, d):
    e = t.events(spark, d)
    share = reading.visible_share(F.col("value") * 4 - 200, (F.col("k") * 20 + 10).cast("double"),
                                  F.lit(0.0), F.lit(800.0))
    return e.select("event_id", F.round(share, 6).alias("share"))


@query("version_keys", f"""
    SELECT source_id, 'fast:' || source_id || '@1' AS model_key,
      'fast:' || source_id || '@1|{DEFAULT_POLICY.matcher_key}' AS pipeline_key FROM source_t""")
def version_keys(spark, d):
    key = F.concat(F.lit("fast:"), "source_id", F.lit("@1"))
    return t.sources(spark, d).select("source_id", key.alias("model_key"), F.concat(
        key, F.lit("|" + DEFAULT_POLICY.matcher_key)).alias("pipeline_key"))


@query("failed_step", """
    SELECT story_id, CASE WHEN refresh_error LIKE '%:%' THEN split_part(refresh_error, ':', 1) ELSE '' END AS step,
      CASE WHEN refresh_error LIKE '%:%' THEN split_part(refresh_error, ':', 2) ELSE refresh_error END AS kind
    FROM story""")
def failed_step(spark, d):
    step, kind = refresh.split_refresh_error("refresh_error")
    return t.text_stories(spark, d).select("story_id", step.alias("step"), kind.alias("kind"))


@query("source_row", f"""
    SELECT article_id, substr({collapse('title')}, 1, 500) AS title, canonical_url AS link, slug, name,
      article_id % 2 = 0 AS is_current_member
    FROM article JOIN source_t USING (source_id)""")
def source_row(spark, d):
    members = t.text_membership(spark, d).filter("article_id % 2 = 0")
    rows = read.source_row(t.articles(spark, d), t.sources(spark, d), members)
    return rows.select("article_id", "title", F.col("canonical_url").alias("link"), "source.slug",
                       "source.name", "is_current_member")


@query("bound_payload", """
    SELECT page_id, n > 6000 AS truncated, CASE WHEN n > 6000 THEN NULL ELSE length(html) END AS html_chars,
      substr(url, 1, CASE WHEN n > 6000 THEN 30 ELSE 100000 END) AS url
    FROM (SELECT *, octet_length(encode('{"authors":[],"content_html":"' ||
      replace(replace(replace(html, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') ||
      '","external_id":null,"language":null,"published_at":null,"raw":{},"summary_html":null,"title":null,'
      || '"truncated":false,"updated_at":null,"url":"' || url || '"}')) AS n FROM pages)""")
def bound_payload_query(spark, d):
    p = bound_payload({"content_html": F.col("html"), "url": F.col("url")}, max_bytes=6_000, field_chars=30)
    return _pages(spark, d).select("page_id", p.alias("p")).select(
        "page_id", "p.truncated", F.length("p.content_html").cast("long").alias("html_chars"), "p.url")


# --- names ---------------------------------------------------------------------------

_CAP = "[A-Z][\\p{L}\\p{N}_''’-]*"
_PHRASE = f"{_CAP}(?:\\s+(?:(?:of|and|de|da|do)\\s+)?{_CAP})*"
MENTION_SQL = f"""
    WITH txt AS (SELECT story_id, article_id, array_to_string(list_filter([{collapse('title')},
        {collapse('body_text')}], lambda x: x <> ''), chr(10) || chr(10)) AS text
      FROM article JOIN member USING (article_id)),
    pieces AS (SELECT *, string_split(regexp_replace(text, '({_PHRASE})', chr(1) || '\\1' || chr(2), 'g'), chr(1))
      AS p FROM txt),
    m0 AS (SELECT story_id, article_id, p, unnest(range(2, len(p) + 1)) AS i FROM pieces),
    m1 AS (SELECT story_id, article_id, regexp_split_to_array(split_part(p[i], chr(2), 1), '\\s+') AS ws,
        regexp_replace(right(CASE WHEN i = 2 THEN p[1] ELSE split_part(p[i - 1], chr(2), 2) END, 8),
          '[ \\t]+$', '') AS b FROM m0),
    m2 AS (SELECT *, list_position(list_transform(ws, lambda x: NOT list_contains({words(w.LEADING_WORDS)},
        lower(x))), true) AS lead FROM m1),
    m3 AS (SELECT *, ws[lead:] AS w1, lead = 1 AND (b = '' OR regexp_matches(b, '[.!?\\n]$')) AS start
      FROM m2 WHERE lead > 0),
    m4 AS (SELECT *, list_contains({words(w.PERSON_TITLES)}, lower(w1[1])) AS titled FROM m3),
    m5 AS (SELECT *, list_filter(CASE WHEN titled THEN w1[2:] ELSE w1 END,
        lambda x: NOT list_contains({words(w.CALENDAR)}, lower(x))) AS w2 FROM m4),
    mention AS (SELECT story_id, article_id, array_to_string(w2, ' ') AS name, CASE
        WHEN len(w2) = 1 AND NOT titled AND start THEN '_SENTENCE_START'
        WHEN list_contains({words(w.ORGANIZATION_WORDS)}, lower(w2[-1])) THEN 'ORGANIZATION'
        WHEN list_contains({words(w.PLACE_WORDS)}, lower(w2[-1])) THEN 'PLACE'
        WHEN titled OR len(w2) BETWEEN 2 AND 3 THEN 'PERSON' ELSE 'OTHER' END AS kind
      FROM m5 WHERE len(w2) > 0),
    named AS (SELECT *, {name_key('name')} AS key FROM mention),
    mentions AS (
      SELECT story_id, article_id, kind, key, name FROM named WHERE kind <> '_SENTENCE_START'
      UNION ALL SELECT story_id, article_id, 'OTHER', key, name FROM named WHERE kind = '_SENTENCE_START'
        AND (story_id, key) IN (SELECT (story_id, key) FROM named WHERE kind <> '_SENTENCE_START'))
"""


def story_texts(spark, d):
    """Whole texts of all members of the document stories."""
    return enrich.member_text(t.text_membership(spark, d), t.articles(spark, d), max_chars=None)


@query("entity_mentions", MENTION_SQL + """
    SELECT story_id, article_id, kind, key, name, count(*) AS n FROM mentions GROUP BY ALL""")
def entity_mentions(spark, d):
    return enrich.mentions(story_texts(spark, d)).select("story_id", "article_id", "kind", "key", "name", "n")


TOPIC_PARTS = f""",
    entity_word AS (SELECT DISTINCT story_id, unnest(string_split(key, ' ')) AS word FROM mentions),
    tw AS (SELECT story_id, article_id, unnest(regexp_extract_all({name_key('text')}, '[a-z]{{4,}}')) AS word FROM txt),
    topic AS (SELECT story_id, article_id, word, count(*) AS n FROM tw
      WHERE NOT list_contains({words(w.TOPIC_STOPWORDS)}, word)
        AND (story_id, word) NOT IN (SELECT (story_id, word) FROM entity_word) GROUP BY ALL)
"""
_TOPIC_SQL = MENTION_SQL + TOPIC_PARTS


@query("topic_words", _TOPIC_SQL + "SELECT story_id, article_id, word, n FROM topic")
def topic_words(spark, d):
    return enrich.topic_words(story_texts(spark, d)).select("story_id", "article_id", "word", "n")


@query("topic_scores", _TOPIC_SQL + """
    SELECT story_id, word, rank, round(a / m, 6) AS score FROM (
      SELECT story_id, word, a, row_number() OVER (PARTITION BY story_id ORDER BY a DESC, u DESC, word) AS rank
      FROM (SELECT story_id, word, count(*) AS a, sum(n) AS u FROM topic GROUP BY ALL))
    JOIN (SELECT story_id, count(*) AS m FROM member GROUP BY story_id) USING (story_id) WHERE rank <= 8""")
def topic_scores(spark, d):
    return enrich.topic_scores(story_texts(spark, d)).select(
        "story_id", "word", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


ENTITY_PARTS = """,
    spelled AS (SELECT story_id, kind, key, name, count(*) AS uses FROM mentions GROUP BY ALL),
    shown AS (SELECT story_id, kind, key, arg_min(name, (-uses, name)) AS name FROM spelled GROUP BY ALL),
    scored AS (SELECT story_id, kind, key, rank, a / m AS score FROM (
        SELECT story_id, kind, key, a, row_number() OVER (
          PARTITION BY story_id ORDER BY a DESC, key, kind) AS rank
        FROM (SELECT story_id, kind, key, count(DISTINCT article_id) AS a FROM mentions GROUP BY ALL))
      JOIN (SELECT story_id, count(*) AS m FROM member GROUP BY story_id) USING (story_id) WHERE rank <= 20)
"""
_ENTITY_SQL = MENTION_SQL + ENTITY_PARTS


@query("entity_scores", _ENTITY_SQL + """
    SELECT story_id, kind, key, name, rank, round(score, 6) AS score
    FROM scored JOIN shown USING (story_id, kind, key)""")
def entity_scores(spark, d):
    return enrich.entity_scores(story_texts(spark, d)).select(
        "story_id", "kind", "key", "name", F.col("rank").cast("long").alias("rank"),
        F.round("score", 6).alias("score"))


@query("merge_scores", _ENTITY_SQL + """
    SELECT 'entity' AS type, story_id, kind || '/' || substr(key, 1, 200) AS key,
      arg_min(substr(name, 1, 200), rank) AS name, round(max(score), 6) AS score
    FROM scored JOIN shown USING (story_id, kind, key) GROUP BY story_id, kind, substr(key, 1, 200)""")
def merge_scores(spark, d):
    e = enrich.merge_entities(enrich.entity_scores(story_texts(spark, d)).drop("key"))
    return e.select(F.lit("entity").alias("type"), "story_id", F.concat_ws("/", "kind", "key").alias("key"),
                    "name", F.round("score", 6).alias("score"))


