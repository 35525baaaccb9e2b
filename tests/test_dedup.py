"""Ordered processing against a one-row-at-a-time model."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window, functions as F

from eventweave.operators import dedup, skew
from eventweave.operators.components import components
from eventweave.plans import QUERIES

T0 = datetime(2024, 1, 1)
COLS = ("raw_id long, source_id long, external_id string, canonical_url string, title string, "
        "description string, body_text string, byline string, published_at timestamp, "
        "language string, content_fingerprint string, fingerprint_input_length int, "
        "created_at timestamp, fetched_at timestamp")
ARTICLE = ("article_id long, source_id long, external_id string, canonical_url string, title string, "
           "description string, body_text string, byline string, published_at timestamp, "
           "language string, content_fingerprint string, duplicate_of long, first_seen_at timestamp, "
           "created_at timestamp, updated_at timestamp")


def revision(i, source, ext, url, fp, length=300, minute=None):
    at = T0 + timedelta(minutes=i if minute is None else minute)
    return (1000 + i, source, ext, url, f"t{i}", "", fp, "", None, "en", fp, length, at, at)


def article(i, source, ext, url, fp):
    at = T0 - timedelta(days=1) + timedelta(minutes=i)
    return (i, source, ext, url, f"a{i}", "", fp, "", None, "en", fp, None, at, at, at)


def model(revisions, articles):
    """The rule table, one revision after the other."""
    arts = {a[0]: dict(id=a[0], src=a[1], ext=a[2], url=a[3], fp=a[10], title=a[4], dup=None) for a in articles}
    created = {a[0]: (0, a[13], a[0]) for a in articles}
    out = {}
    for r in sorted(revisions, key=lambda r: (r[12], r[0])):
        raw, src, ext, url, fp, length = r[0], r[1], r[2], r[3], r[10], r[11]
        e = next((a for a in arts.values() if ext and a["src"] == src and a["ext"] == ext), None)
        u = next((a for a in arts.values() if a["url"] == url), None)
        f = min((a for a in arts.values() if a["fp"] == fp), key=lambda a: created[a["id"]], default=None)
        if e and u and e is not u:
            out[raw] = ("SOURCE_IDENTITY_CONFLICT", u["id"]) if u["src"] != src else ("IDENTITY_CONFLICT", None)
            continue
        if not e and u and u["src"] != src:
            out[raw] = ("SOURCE_IDENTITY_CONFLICT", u["id"])
            continue
        hit = e or u
        if hit and hit["url"] == url and hit["fp"] == fp:
            out[raw] = ("IDENTITY_DUPLICATE", hit["id"])
        elif hit:
            hit.update(ext=ext, url=url, fp=fp, title=r[4])
            out[raw] = ("ARTICLE_UPDATED", hit["id"])
        else:
            dup = f["id"] if f and length >= 200 else None
            arts[raw] = dict(id=raw, src=src, ext=ext, url=url, fp=fp, title=r[4], dup=dup)
            created[raw] = (1, r[12], raw)
            out[raw] = ("CONTENT_DUPLICATE" if dup is not None else "ARTICLE_CREATED", raw)
    return out, arts


def run(spark, revisions, articles, **options):
    raw, after, revised = dedup.process_raw(
        spark.createDataFrame(revisions, COLS), spark.createDataFrame(articles, ARTICLE), **options)
    outcomes = {r.raw_id: (r.outcome, r.article_id) for r in raw.collect()}
    state = {r.article_id: (r.source_id, r.external_id, r.canonical_url, r.content_fingerprint, r.title,
                            r.duplicate_of) for r in after.collect()}
    return outcomes, state, {r.article_id for r in revised.collect()}


@pytest.mark.parametrize("seed,fold_rows", [(1, 5000), (3, 15)])
def test_matches_one_by_one(spark, seed, fold_rows):
    rng = random.Random(seed)
    articles, seen = [], set()
    for i in range(8):
        key = (rng.randrange(2), rng.choice(["", "x1", "x2", "x3"]), f"u{i}")
        if key[1] and key[:2] in seen:
            continue
        seen.add(key[:2])
        articles.append(article(i, *key, f"f{rng.randrange(4)}"))
    revisions = [
        revision(i, rng.randrange(2), rng.choice(["", "", "x1", "x2", "x3", f"y{rng.randrange(20)}"]),
                 f"u{rng.randrange(30)}", f"f{rng.randrange(6)}", rng.choice([199, 200, 300]))
        for i in range(60)]
    want, arts = model(revisions, articles)
    got, state, revised = run(spark, revisions, articles, fold_rows=fold_rows)
    assert got == want
    assert state == {k: (a["src"], a["ext"], a["url"], a["fp"], a["title"], a["dup"]) for k, a in arts.items()}
    assert revised == {v[1] for v in want.values() if v[0] == "ARTICLE_UPDATED"}


def test_one_hot_publication(spark):
    """A third of all rows revise one URL: judged without one task folding them."""
    revisions = [revision(i, 1, "", "hot", f"f{i // 3 % 2}", minute=i * 60) for i in range(80)]
    revisions += [revision(500 + i, 1, "", f"u{i}", "copy") for i in range(80)]
    want, _ = model(revisions, [])
    got, _, _ = run(spark, revisions, [], fold_rows=10)
    assert got == want


def test_one_hot_url(spark, monkeypatch):
    """One URL under ever new external ids, some of them again, is one article: nothing is folded in order."""
    monkeypatch.setattr(dedup, "_fold", None)
    revisions = [revision(i, 1, ["", f"e{i}", f"e{i % 7}"][i % 3], "hot", f"f{i // 4 % 3}", minute=0 if i < 40 else i) for i in range(80)]
    revisions += [revision(500 + i, 1, f"x{i}", f"u{i}", "copy") for i in range(30)]
    for stored in ([], [article(1, 1, "e3", "hot", "f0")]):
        want, _ = model(revisions, stored)
        got, _, _ = run(spark, revisions, stored, fold_rows=10)
        assert got == want


def test_blocks_are_even(spark):
    """A third of all rows at one instant of one key: range blocks stay even, numbers and lags are right."""
    rows = spark.range(6_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.when(
        F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 11).alias("t"), "id")
    order = ["t", "id"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small blocks would be put together
    try:
        cut = skew._with_block(rows, ["k"], order, None)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    blocks = [r["count"] for r in cut.groupBy("_block").count().collect()]
    assert len(blocks) >= 4 and max(blocks) <= 2 * sorted(blocks)[len(blocks) // 2]
    w = Window.partitionBy("k").orderBy(*order)
    want = rows.withColumn("n", F.row_number().over(w)).withColumn("before", F.lag("id").over(w))
    got = skew.running_lag(skew.running_number(rows, ["k"], order, None, "n"), ["k"], order, None, ["id"], "l")
    assert sorted(got.select("k", "t", "id", "n", F.col("l.id").alias("before")).collect(), key=lambda r: r.id) == sorted(
        want.collect(), key=lambda r: r.id)


def test_decision_table(spark):
    stored = [article(1, 1, "e1", "u1", "f1"), article(2, 2, "", "u2", "f2"), article(3, 1, "", "u3", "f3")]
    cases = [
        (("e1", "u1", "f1"), "IDENTITY_DUPLICATE"), (("e1", "u1", "f9"), "UPDATE"),
        (("e1", "u9", "f1"), "UPDATE"), (("e1", "u3", "f1"), "IDENTITY_CONFLICT"),
        (("e1", "u2", "f1"), "SOURCE_IDENTITY_CONFLICT"), (("", "u2", "f2"), "SOURCE_IDENTITY_CONFLICT"),
        (("", "u3", "f3"), "IDENTITY_DUPLICATE"), (("", "u3", "f1"), "UPDATE"),
        (("", "u7", "f2"), "CONTENT_DUPLICATE"), (("", "u7", "f7"), "CREATE"),
    ]
    rows = [revision(i, 1, *c) for i, (c, _) in enumerate(cases)]
    rows += [revision(90, 1, "", "u8", "f2", 199), revision(91, 1, "", "u8", "f2", 200)]
    got = {r.raw_id: r.decision for r in dedup.dedup_decide(
        spark.createDataFrame(rows, COLS), spark.createDataFrame(stored, ARTICLE)).collect()}
    assert got == {**{1000 + i: d for i, (_, d) in enumerate(cases)}, 1090: "CREATE", 1091: "CONTENT_DUPLICATE"}


def test_components(spark):
    links = [(i, f"k{i // 2}") for i in range(10)] + [(i, f"m{(i + 1) // 2}") for i in range(6)] + [(99, "z")]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "node long, key string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 6, 7: 6, 8: 8, 9: 8, 99: 99}


def test_normalize_rejects(spark):
    items = spark.createDataFrame(
        [(1, "", "", "", "http://a/", "", "en"), (2, " ", "d", "", "http://a/", "", "en"),
         (3, "T", "", "x" * 50, "http://a/", "", ""), (4, "T", "", "ok", "nope", "", ""),
         (5, "T" * 600, "<p>s</p>", "<p>b</p>", "HTTP://A.example:80", " id ", "")],
        "n int, title string, summary_html string, content_html string, url string, external_id string, language string")
    good, bad = dedup.normalize_articles(items, max_body=20)
    assert {r.n: r.reject_reason for r in bad.collect()} == {
        1: "EMPTY_ENTRY", 2: "MISSING_TITLE", 3: "BODY_TOO_LARGE", 4: "MISSING_CANONICAL_URL"}
    row = good.first()
    assert (row.canonical_url, len(row.title), row.note, row.external_id, row.body_text) == (
        "http://a.example/", 512, "TITLE_TRUNCATED", "id", "b")
    assert good.filter(F.col("content_fingerprint").isNull()).isEmpty()


def test_normalize_parses_an_item_once_for_each_result(spark):
    items = spark.createDataFrame([(1, "T", "", "<p>b</p>", "http://a.example/", "", "")], "n int, title string, summary_html string, "
                                  "content_html string, url string, external_id string, language string")
    for part in dedup.normalize_articles(items):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert sum("_html_udf" in line.split("], [")[0] for line in plan.splitlines() if "ArrowEvalPython [" in line) == 1


def test_normalize_sends_bounded_batches_to_python(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    page = spark.range(1).select(F.lit("T").alias("title"), F.lit("").alias("summary_html"), F.lit("").alias("content_html"),
                                 F.lit("u").alias("url"), F.lit("").alias("external_id"), F.lit("").alias("language"))
    dedup.normalize_articles(page)
    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("t"))
    sizes = texts.mapInPandas(lambda frames: (f[["t"]].head(1).assign(t=f["t"].map(len).sum()) for f in frames), "t long").collect()
    assert sum(r.t for r in sizes) == 30_000_000 and max(r.t for r in sizes) <= 9_000_000


def test_normalize_query_takes_every_body_within_the_rule(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.item_id: r for r in QUERIES["normalize_articles"](spark, sf).collect()}
    assert max(r.body_chars or 0 for r in got.values()) > 5_000
    assert {i for i, r in got.items() if r.reject_reason == "BODY_TOO_LARGE"} == {i for i in got if i % 1000 == 7}


def test_components_read_their_links_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(rows):
        for row in rows:
            read.add(1)
            yield row

    links = spark.createDataFrame([(i, f"k{i // 2}") for i in range(10)], "node long, key string")
    links = spark.createDataFrame(links.rdd.mapPartitions(counted), links.schema)
    assert components(links).count() == 10 and read.value == 10
