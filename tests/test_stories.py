"""Retrieval, matching, synthesis and quality on small hand-made rows."""

import re
import unicodedata
from collections import Counter
from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F


from eventweave import policy
from eventweave.functions import words
from eventweave.operators import candidates as cd
from eventweave.operators import embed, enrich, match, quality, read, refresh, synthesis
from eventweave.session import cut_lineage


T0 = datetime(2024, 1, 1)
KEY = "m"


def unit(*angles):
    """A vector on the unit circle; 1 - cos of the angle between two is their distance."""
    return [float(np.cos(a)) for a in angles] + [float(np.sin(a)) for a in angles]


def at_distance(d):
    return float(np.arccos(1 - d))


def test_blocked_topk(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(40, 5)), rng.normal(size=(30, 5))
    t, lo = rng.integers(0, 1000, 40), rng.integers(0, 1000, 30)
    left = spark.createDataFrame([(i, KEY, "en", int(t[i]), a[i].tolist()) for i in range(40)],
                                 "id long, model_key string, lang string, t long, vector array<double>")
    right = spark.createDataFrame([(j, KEY, "en", int(lo[j]), int(lo[j]) + 300, b[j].tolist()) for j in range(30)],
                                  "id long, model_key string, lang string, lo long, hi long, vector array<double>")
    got = {(r.left_id, r["rank"]): r.right_id for r in cd.blocked_topk(
        left, right, k=3, max_distance=0.9, bucket_us=100, block_rows=4).collect()}
    want = {}
    for i in range(40):
        near = sorted((round(1 - a[i] @ b[j] / np.linalg.norm(a[i]) / np.linalg.norm(b[j]), 12), j)
                      for j in range(30) if lo[j] <= t[i] <= lo[j] + 300)
        want.update({(i, n + 1): j for n, (d, j) in enumerate([x for x in near if x[0] <= 0.9][:3])})
    assert got == want


def vectors(spark, n, dims, seed):
    """n stories of n / 20 events, all at one time."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(max(1, n // 20), dims))
    rows = centre[rng.integers(0, len(centre), n)] + 0.15 * rng.normal(size=(n, dims))
    return spark.createDataFrame([(i, KEY, "en", 0, 0, 0, v.tolist()) for i, v in enumerate(rows)],
                                 "id long, model_key string, lang string, t long, lo long, hi long, vector array<double>")


@pytest.mark.parametrize("k,max_distance,dims", [(3, 0.5, 16), (40, 2.0, 3)])
def test_pivot_topk_is_exact(spark, k, max_distance, dims):
    rows = vectors(spark, 300, dims, 1)
    odd = spark.createDataFrame(
        [(1000, KEY, "en", 0, 0, 0, [0.0] * dims), (1001, KEY, "en", 0, 0, 0, [1.0] * dims), (1002, KEY, "en", 0, 0, 0, [1.0] * dims),
         (1003, KEY, "en", 0, 0, 0, [2.0] * dims), (1004, KEY, "en", 0, 5, 9, [1.0] * dims), (1005, KEY, "xx", 0, 0, 0, [1.0] * dims),
         (1006, KEY, "en", 0, 0, 0, []), (1007, KEY, "en", 0, 0, 0, None), (1008, KEY, "en", 0, 0, 0, [-1.0] * dims)], rows.schema)
    rows = rows.unionByName(odd)
    how = {"k": k, "max_distance": max_distance, "bucket_us": 100}
    want = {tuple(r) for r in cd.blocked_topk(rows, rows, **how).collect()}
    assert {tuple(r) for r in cd.pivot_topk(rows, rows, block_rows=16, **how).collect()} == want
    assert len(want) > 300
    assert cd.pivot_topk(rows, rows.limit(0), **how).isEmpty()


def test_pivot_index_compares_less_than_the_square(spark):
    def compared(n):
        left, right = cd._bucketed(vectors(spark, n, 8, 2), vectors(spark, n, 8, 2), 100)
        dealt, cells = cd.pivot_cells(right, 16)
        visits = cd.pivot_visits(left, cells, 0.5)
        group = [*cd._BUCKET, "cell"]
        home = visits.withColumnRenamed("home", "cell").withColumn("far", F.lit(0.5))
        first = cd.top_rows(cd._near_pairs(home, dealt, group, 3, False, 64), ["left_id"], ["distance", "right_id"], 3)
        sizes = dealt.groupBy(*group).count()
        asked = home.select(*group).unionByName(cd.still_open(visits, first, 3, 0.5).select(*group))
        return asked.join(sizes, group).agg(F.sum("count")).first()[0]

    small, large = compared(500), compared(2000)
    assert large < 0.25 * 2000 ** 2
    assert large < 10 * small  # 16 times as many pairs


def world(spark, articles):
    """articles: (id, angle, hours, text)"""
    arts = spark.createDataFrame(
        [(i, "en", T0 + timedelta(hours=h), "", "", text) for i, _, h, text in articles],
        "article_id long, language string, event_time timestamp, title string, description string, body_text string")
    emb = spark.createDataFrame([(i, KEY, 2, unit(a)) for i, a, _, _ in articles],
                                "article_id long, model_key string, dimension int, vector array<double>")
    return arts, emb


def empty(spark):
    return (spark.createDataFrame([], "story_id long, status string, language string"),
            spark.createDataFrame([], "story_id long, model_key string, dimension int, vector array<double>, member_count long"),
            spark.createDataFrame([], "story_id long, article_id long"))


def test_match_rounds(spark):
    same, near = at_distance(0.10), at_distance(0.20)
    rows = [
        (1, 0.0, 0, "A storm hit Elsby."), (2, same, 1, "x"), (3, near, 2, "People in Elsby fled the storm."),
        (4, -near, 3, "Nothing in common here."),      # near enough, no shared name
        (5, 0.0, 100, "x"),                               # same text, 48 h later than all members
        (6, 2.0, 1, "far"), (7, 2.0 + same, 2, "far too"), (8, 2.0, 3, "x")]
    arts, emb = world(spark, rows)
    stories, vecs, members = empty(spark)
    done = match.match_articles(arts, emb, stories, vecs, members, arts, arts, model_key=KEY)
    got = {r.article_id: (r.story_id, r.method) for r in done.edges.collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6, 8: 6}
    rules = {r.article_id: (r.evidence.reason, r.evidence.rule) for r in done.edges.collect()}
    assert rules[2] == ("WITHIN_THRESHOLD", "PRIMARY_DISTANCE")
    assert rules[3] == ("VERIFIED_SAME_EVENT", "SECONDARY_EVENT_VERIFY")
    assert rules[4][0] == "VERIFICATION_REJECTED" and rules[5][0] == "NO_CANDIDATES"
    assert done.stories.count() == 4
    text = {r.article_id: r.summary for r in read.explain_match(done.edges).collect()}
    assert text[3].startswith("joined Story 1 by secondary") and "NO_SHARED_ANCHOR" in text[4]


def size_estimate(df):
    """What Spark takes `df` to be, as text: sizes beyond all bounds have an exponent."""
    return df._jdf.queryExecution().optimizedPlan().stats().simpleString()


def test_checkpoints_of_a_loop_keep_a_bounded_size_estimate(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(5)], "id long, x double")
    for _ in range(12):
        rows = cut_lineage(rows.join(rows.select("id", F.col("x").alias("y")), "id").select("id", F.greatest("x", "y").alias("x")))
        assert "E+" not in size_estimate(rows)
    assert sorted(tuple(r) for r in rows.collect()) == [(i, float(i)) for i in range(5)]
    assert rows.columns == ["id", "x"]


def test_keep_current_story(spark):
    """A stale edge stays where the rule alone still accepts it, though another is nearer."""
    rows = [(1, 0.0, 0, ""), (2, at_distance(0.15), 0, ""), (3, at_distance(0.02), 1, ""), (4, 0.0, 0, "")]
    arts, emb = world(spark, rows)
    stories = spark.createDataFrame([(10, "ACTIVE", "en"), (20, "ACTIVE", "en")], "story_id long, status string, language string")
    members = spark.createDataFrame([(10, 2), (20, 1), (20, 4), (10, 3)], "story_id long, article_id long")
    vecs = embed.story_vector(members, emb)
    stale = spark.createDataFrame([(3, 10)], "article_id long, story_id long")
    kept = match.rematch_stale(stale, arts, emb, stories, vecs, members, arts, arts, model_key=KEY)[1].first()
    assert (kept.story_id, kept.evidence.kept_current_story) == (10, True)
    # without the preference the nearer story wins
    free = match.reprocess_articles(stale, arts, emb, stories, vecs, members, arts, arts, model_key=KEY)[1].first()
    assert free.story_id == 20


def test_matching_again_keeps_a_bounded_size_estimate(spark):
    rows = [(i, at_distance(0.05 * i), i, "") for i in range(6)]
    arts, emb = world(spark, rows)
    stories = spark.createDataFrame([(10, "ACTIVE", "en"), (20, "ACTIVE", "en")], "story_id long, status string, language string")
    members = spark.createDataFrame([(10 + 10 * (i % 2), i) for i in range(6)], "story_id long, article_id long")
    done = match.reprocess_articles(members.filter("article_id < 4"), arts, emb, stories, embed.story_vector(members, emb),
                                    members, arts, arts, model_key=KEY)
    assert "E+" not in size_estimate(done.edges)
    assert sorted(r.article_id for r in done.edges.collect()) == [0, 1, 2, 3]


def test_matching_again_decides_once_a_round(spark, monkeypatch):
    """Articles that start stories are not judged a second time against the stories their round has judged them by."""
    arts, emb = world(spark, [(1, 0.0, 0, ""), (2, 2.0, 0, ""), (3, 2.0, 1, "")])
    stories = spark.createDataFrame([(10, "ACTIVE", "en"), (20, "ACTIVE", "en")], "story_id long, status string, language string")
    members = spark.createDataFrame([(10, 1), (20, 2)], "story_id long, article_id long")
    asked, decide = [], match.decide_snapshot
    monkeypatch.setattr(match, "decide_snapshot", lambda *a, **k: asked.append(1) or decide(*a, **k))
    done = match.reprocess_articles(members, arts, emb, stories, embed.story_vector(members, emb), members, arts, arts, model_key=KEY)
    assert {(r.article_id, r.story_id, r.method) for r in done.edges.collect()} == {(1, 1, "CREATED_STORY"), (2, 2, "CREATED_STORY")}
    assert len(asked) == 1


def test_story_vector_and_withdrawal(spark):
    _, emb = world(spark, [(1, 0.0, 0, ""), (2, 1.0, 0, ""), (3, 0.0, 0, ""), (4, float(np.pi), 0, "")])
    members = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 4), (3, 9)], "story_id long, article_id long")
    got = {r.story_id: r.vector for r in embed.story_vector(members, emb).collect()}
    assert got[1] == pytest.approx(unit(0.5)) and got.keys() == {1, 2}
    vecs = spark.createDataFrame([(s, KEY, 2, [1.0, 0.0], 2) for s in (1, 2, 3, 4)],
                                 "story_id long, model_key string, dimension int, vector array<double>, member_count long")
    left = spark.createDataFrame([(1, 1), (3, 9)], "story_id long, article_id long")
    touched = spark.createDataFrame([(1,), (2,), (3,)], "story_id long")
    after = {r.story_id: r.vector for r in embed.withdraw_member(left, emb, vecs, touched).collect()}
    # 1 rebuilt, 2 emptied and untouched, 3 dropped (a member without vector), 4 not touched
    assert after.keys() == {1, 2, 4} and after[1] == pytest.approx([1.0, 0.0])


ARTICLES = ("article_id long, source_id long, title string, description string, body_text string, "
            "published_at timestamp, first_seen_at timestamp, updated_at timestamp")


def test_contested_figures(spark):
    shared = "Rescue boats reached the flooded village on Sunday."
    rows = [
        (1, 1, "Flood cuts off Almen", "", f"{shared} Officials counted 12 people missing after the flood.", T0, T0, T0),
        (2, 2, "Almen flood", "", f"{shared} Officials counted 15 people missing after the flood. "
            "The road stays closed until Tuesday.", T0 + timedelta(hours=1), T0, T0)]
    arts = spark.createDataFrame(rows, ARTICLES)
    members = spark.createDataFrame([(5, 1), (5, 2)], "story_id long, article_id long")
    got = {(r.kind, r.position): (r.text, r.article_ids) for r in synthesis.synthesize(members, arts).collect()}
    assert got == {("TITLE", 0): ("Flood cuts off Almen", [1]), ("SUMMARY", 0): (shared, [1, 2]),
                   ("CONTEXT", 0): ("The road stays closed until Tuesday.", [2])}


def test_refresh_generation(spark):
    rows = [(1, 1, "Storm hits Elsby", "", "The storm reached Elsby harbor on Monday.", T0, T0, T0),
            (2, 2, "Rates", "", "", T0, T0, T0)]
    arts = spark.createDataFrame(rows, ARTICLES)
    emb = embed.embed_articles(arts.filter("article_id = 1"), spark.createDataFrame([], "article_id long, model_key string"))
    stories = spark.createDataFrame(
        [(s, "ACTIVE", "STALE" if s != 4 else "CURRENT", "", "", 0, 0) for s in (1, 2, 3, 4)],
        "story_id long, status string, refresh_state string, member_signature string, refresh_error string, "
        "article_count long, source_count long")
    members = spark.createDataFrame([(1, 1), (2, 2)], "story_id long, article_id long")
    made = refresh.refresh_stories(stories, members, arts, emb, now="2024-02-01 00:00:00")
    state = {r.story_id: (r.status, r.refresh_state, r.article_count, r.refresh_error) for r in made["stories"].collect()}
    assert state == {1: ("ACTIVE", "CURRENT", 1, ""), 2: ("ACTIVE", "FAILED", 0, "story_embedding:MISSING_EMBEDDING"),
                     3: ("ARCHIVED", "CURRENT", 0, ""), 4: ("ACTIVE", "CURRENT", 0, "")}
    assert {r.kind for r in made["elements"].collect()} == {"TITLE", "SUMMARY"}
    assert made["topics"].filter("story_id = 1").count() > 0


STORIES = ("story_id long, status string, refresh_state string, member_signature string, refresh_error string, "
           "article_count long, source_count long")


def test_moved_signatures_are_not_published(spark):
    """A story that gained, lost or changed a member during the refresh stays as it was, STALE; the rest is published."""
    rows = [(i, i, f"Storm hits Elsby {i}", "", "The storm reached Elsby harbor on Monday.", T0, T0, T0) for i in range(1, 7)]
    arts = spark.createDataFrame(rows, ARTICLES)
    emb = embed.embed_articles(arts, spark.createDataFrame([], "article_id long, model_key string"))
    stories = spark.createDataFrame([(s, "ACTIVE", "FAILED" if s == 2 else "CURRENT" if s == 6 else "STALE", f"old{s}", "e" if s == 2 else "", 9, 9)
                                     for s in range(1, 7)], STORIES)
    link = "story_id long, article_id long"
    members = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4), (6, 6)], link)
    made = refresh.refresh_stories(stories, members, arts, emb, now="2024-02-01 00:00:00")
    later = spark.createDataFrame([(1, 1), (2, 2), (2, 6), (4, 4), (5, 5)], link)  # 2 gained, 3 lost, 5 is not empty any more
    changed = arts.withColumn("updated_at", F.when(F.col("article_id") == 4, F.col("updated_at") + F.expr("INTERVAL 1 HOUR")).otherwise(
        F.col("updated_at")))
    out = refresh.promote(made, stories, later, changed)
    state = {r.story_id: (r.status, r.refresh_state, r.refresh_error, r.member_signature.startswith("old"), r.article_count)
             for r in out["stories"].collect()}
    held = ("ACTIVE", "STALE", "", True, 9)
    assert state == {1: ("ACTIVE", "CURRENT", "", False, 1), 2: held, 3: held, 4: held, 5: held, 6: ("ACTIVE", "CURRENT", "", True, 9)}
    assert set(out) == {"stories", "story_emb", "topics", "entities", "elements"}
    for name in set(out) - {"stories"}:
        assert {r.story_id for r in out[name].select("story_id").distinct().collect()} <= {1}


def test_extractor_over_many_tasks(spark):
    """A story with most of the members is read in any number of slices; ties go by label."""
    def words_said(members):
        import pandas as pd

        rows = [(s, a, w) for s, a, t in members[["story_id", "article_id", "text"]].itertuples(index=False) for w in {*t.split()}]
        return pd.DataFrame(rows, columns=["story_id", "article_id", "label"])

    n = 3_000
    texts = spark.createDataFrame([(1 if i % 3 else 2 + i % 50, i, f"all w{i % 10} x{i % 2}") for i in range(n)],
                                  "story_id long, article_id long, text string").repartition(16)
    parts = {r.p for r in texts.filter("story_id = 1").select(F.spark_partition_id().alias("p")).distinct().collect()}
    assert len(parts) == 16
    got = [(r.label, round(r.score, 6), r["rank"]) for r in enrich.extract_with(texts, words_said, "label string", 5).filter(
        "story_id = 1").orderBy("rank").collect()]
    assert got == [("all", 1.0, 1), ("x0", 0.5, 2), ("x1", 0.5, 3), ("w0", 0.1, 4), ("w1", 0.1, 5)]


def test_broken_output_is_refused_whole(spark):
    topics = spark.createDataFrame([(1, "good", .5, 1), (1, "--", .5, 2), (2, "Fine one", .5, 1), (2, "fine  one", .7, 2)],
                                   "story_id long, label string, score double, rank int")
    assert [tuple(r) for r in enrich.merge_topics(enrich.valid_scores(topics)).collect()] == [(2, "fine-one", "fine one", .7)]
    with pytest.raises(Exception, match="usable name"):
        enrich.merge_topics(topics).collect()
    rows = [(i, i, "Storm hits Elsby", "", "The storm reached Elsby harbor on Monday.", T0, T0, T0) for i in (1, 2)]
    arts = spark.createDataFrame(rows, ARTICLES)
    emb = embed.embed_articles(arts, spark.createDataFrame([], "article_id long, model_key string"))
    stories = spark.createDataFrame([(s, "ACTIVE", "STALE", "", "", 0, 0) for s in (1, 2)], STORIES)
    members = spark.createDataFrame([(1, 1), (2, 2)], "story_id long, article_id long")
    made = refresh.refresh_stories(stories, members, arts, emb, topics=topics)
    assert {r.story_id: (r.refresh_state, r.refresh_error) for r in made["stories"].collect()} == {
        1: ("FAILED", "story_enrichment:INVALID_OUTPUT"), 2: ("CURRENT", "")}
    assert {r.story_id for r in made["topics"].collect()} == {2} == {r.story_id for r in made["elements"].collect()}


def test_proposed_elements(spark):
    def offer(members):
        import pandas as pd

        rows = [(s, a, k, o, x) for s, a, t, b in members[["story_id", "article_id", "title", "text"]].itertuples(index=False)
                for k, o, x in [("TITLE", 0, t), *(("SUMMARY", i, y) for i, y in enumerate(b.split("/")))]]
        return pd.DataFrame(rows, columns=["story_id", "article_id", "kind", "ord", "text"])

    at = lambda i: (T0 + timedelta(hours=9 - i), i)
    inputs = spark.createDataFrame([(1, i, at(i), f"t{i}", "b/a" if i % 2 else "a/c") for i in range(1, 9)],
                                   "story_id long, article_id long, at struct<event_time: timestamp, article_id: long>, title string, text string")
    got = {(r.kind, r.position): (r.text, r.article_ids) for r in synthesis.synthesize_with(
        inputs.repartition(5), offer, {"TITLE": 1, "SUMMARY": 2}).collect()}
    assert got == {("TITLE", 0): ("t8", [8]), ("SUMMARY", 0): ("a", [8, 7, 6, 5, 4, 3, 2, 1]), ("SUMMARY", 1): ("c", [8, 6, 4, 2])}


def brute_quality(expected, assigned):
    e = p = t = m = s = 0
    for a, b in combinations(sorted(expected), 2):
        same, x, y = expected[a] == expected[b], assigned.get(a), assigned.get(b)
        both = x is not None and y is not None
        e += same
        p += both and x == y
        t += same and both and x == y
        m += both and x == y and not same
        s += same and both and x != y
    return e, p, t, m, s


@pytest.mark.parametrize("assigned", [
    {1: 1, 2: 1, 3: 2, 4: 2, 5: 3}, {i: 1 for i in range(1, 6)}, {i: i for i in range(1, 6)}, {1: 1, 2: 2}, {}])
def test_quality(spark, assigned):
    expected = {1: "a", 2: "a", 3: "a", 4: "b", 5: "b"}
    q = quality.pairwise_quality(
        spark.createDataFrame(list(expected.items()), "article_id long, expected_event string"),
        spark.createDataFrame(list(assigned.items()), "article_id long, story_id long")).first()
    assert (q.expected_pair_count, q.predicted_pair_count, q.true_pair_count, q.false_merge_count,
            q.false_split_count) == brute_quality(expected, assigned)
    if not q.predicted_pair_count:
        assert (q.precision, q.false_merge_rate) == (1.0, 0.0)


def test_extractor_gets_bounded_slices(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    texts = spark.range(0, 3000, 1, 1).select((F.col("id") % 3).alias("story_id"), F.col("id").alias("article_id"),
                                              F.repeat(F.lit("x"), 10_000).alias("text"))

    def told(members):
        return members[["story_id", "article_id"]].assign(label=str(members["text"].map(len).sum()))

    rows = enrich.extract_with(texts, told, "label string", 8).collect()
    assert rows and max(int(r.label) for r in rows) <= 9_000_000


def test_topic_words_of_all_scripts_without_the_name_rules(spark):
    """Words are as the name rules leave them, but whole texts do not pass through those (a sign at a time)."""
    from eventweave.functions.text import normalize_name

    said = ["straße «market» don't…stop", "ＦＵＬＬ width ﬁnance Ⅻ text", "harbour—bridge\u2009toll ÀLAmode", "Ελλάδα river´s", ""]
    texts = spark.createDataFrame([(1, i, s) for i, s in enumerate(said)], "story_id long, article_id long, text string")
    found = spark.createDataFrame([], "story_id long, article_id long, kind string, key string, name string, n long")
    got = enrich.topic_words(texts, found)
    assert "translate(" not in got._jdf.queryExecution().optimizedPlan().toString()
    old = texts.select("article_id", F.explode(F.regexp_extract_all(normalize_name("text"), F.lit("[a-z]{4,}"), 0)).alias("word"))
    stop = set(words.TOPIC_STOPWORDS)
    assert {(r.article_id, r.word) for r in got.collect()} == {tuple(r) for r in old.collect() if r.word not in stop}
    assert {"strasse", "full", "finance", "harbour"} <= {r.word for r in got.collect()}


def test_topics_are_added_up_before_entity_words_are_left_out(spark):
    """The rows of single members do not go to the join with the entity words, and the topics are those of `topic_words`."""
    said = ["The Elsby harbour closed. Boats waited near Elsby harbour.", "Boats left the harbour; boats came to Elsby.", "Boats came."]
    texts = spark.createDataFrame([(1, i, x) for i, x in enumerate(said)] + [(2, 0, said[0]), (2, 0, said[0])],
                                  "story_id long, article_id long, text string")
    found = spark.createDataFrame([(1, 0, "PLACE", "elsby boats", "Elsby Boats", 1)],
                                  "story_id long, article_id long, kind string, key string, name string, n long")
    got = enrich.topic_scores(texts, found=found)
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = [line for line in plan[next(i for i, line in enumerate(plan) if "LeftAnti" in line):] if "Aggregate [" in line]
    assert "article_id" not in below[0].split("], [")[0]
    words_of = {}
    for r in enrich.topic_words(texts, found).collect():
        a, u = words_of.get((r.story_id, r.word), (0, 0))
        words_of[r.story_id, r.word] = (a + 1, u + r.n)
    best = sorted((s, -a, -u, w) for (s, w), (a, u) in words_of.items())
    ranked = [(r.story_id, r.word) for r in got.orderBy("story_id", "rank").collect()]
    assert ranked == [(s, w) for s, _, _, w in best] and (1, "boats") not in ranked and (2, "boats") in ranked
    assert {r.score for r in got.filter("word = 'harbour' AND story_id = 1").collect()} == {2 / 3}


def test_refresh_query_makes_the_whole_generation(spark, tmp_path):
    """The query's rows tell of every table of the generation, and nothing of a generation is left out."""
    from eventweave.plans.registry import QUERIES

    text = "Storm hits Elsby\nThe storm reached Elsby harbour on Monday. Fishing boats left the quay near Port Almen."
    spark.createDataFrame([(i, text if i // 12 != 4 else "", "en", "wire", len(text)) for i in range(72)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.story_id: r.asDict() for r in QUERIES["refresh_stories"](spark, str(tmp_path)).collect()}
    assert got[3]["refresh_state"] == "CURRENT" and got[4]["refresh_state"] == "FAILED" and len(got) == 6
    made = {s: (r["vectors"], r["topics"], r["entities"], r["elements"]) for s, r in got.items()}
    whole = "Storm hits Elsby\n\n" + text.replace("\n", " ")
    texts = spark.createDataFrame([(3, i, whole) for i in range(36, 48)], "story_id long, article_id long, text string")
    assert made.pop(3) == (1, enrich.topic_scores(texts).count(), enrich.entity_scores(texts).count(), 3)
    assert set(made.values()) == {(0, 0, 0, 0)}


def test_synthesis_writes_only_lines_that_can_be_taken(spark, monkeypatch):
    """Elements and supporters are those of all lines, but plain lines that no story can take are not written."""
    say = lambda i, j: [f"Plain line number {'abcdefgh'[(i * j) % 8]} is said again.", f"In Almen {j % 3 + i % 2} boats left the harbour quay.",
                        f"Member {'xyz'[i % 3]} speaks of point {'klmnopqrstuvw'[j % 13]} here."][(i + j) % 3]
    rows = [(i, i, f"Title {i // 4}", "", " ".join(say(i, j) for j in range(40)), T0 + timedelta(hours=i % 3), T0, T0) for i in range(12)]
    arts = spark.createDataFrame(rows, ARTICLES)
    members = spark.createDataFrame([(i // 4, i) for i in range(12)] + [(0, 11), (2, 11)], "story_id long, article_id long")
    written = []
    monkeypatch.setattr(synthesis, "cut_lineage", lambda df: written.append(df) or df)
    got = synthesis.synthesize(members, arts)
    inputs = synthesis.synthesis_input(members, arts)
    lines = synthesis.claims(inputs)
    wanted = synthesis.lead_sentences(lines, synthesis.contested_claims(lines))
    cited = wanted.alias("e").join(inputs.select("story_id", "article_id", "at", "title", F.col("text").alias("body")), "story_id").filter(
        F.expr("CASE WHEN kind = 'TITLE' THEN title = e.text ELSE contains(body, e.text) END"))
    want = {}
    for r in cited.orderBy("at").collect():
        want.setdefault((r.story_id, r.kind, r.position, r.text), []).append(r.article_id)
    assert {(r.story_id, r.kind, r.position, r.text): r.article_ids for r in got.collect()} == want and len(want) > 12
    plain = written[0].filter("ord >= 0 AND size(figures) = 0").groupBy("story_id", "article_id").count()
    assert plain.agg(F.max("count")).first()[0] <= 2 * (policy.MAX_SUMMARY + policy.MAX_CONTEXT) and written[0].count() < lines.count()


def test_topics_move_words_once_and_write_no_mentions(spark, monkeypatch):
    """Words are counted before they move, go once to their story and word, and mentions are not written on the way. Members with
    several texts are added up."""
    said = ["Boats left. The old harbour harbour near Elsby closed.", "Elsby boats: harbour ﬁnance Élsby, strasse STRASSE straße.", "", "Closed harbour.",
            "Near Elsby Harbour boats boats."]
    rows = [(i % 3 if i < 20 else None, i % 7, said[i % 5]) for i in range(24)]
    texts = spark.createDataFrame(rows, "story_id long, article_id long, text string")
    found = [r for r in enrich.mentions(texts).collect()]
    names = {(r.story_id, w) for r in found for w in r.key.split(" ")}
    n = Counter()
    for s, a, t in rows:
        for w in re.findall("[a-z]{4,}", unicodedata.normalize("NFKC", t).casefold()):
            if w not in words.TOPIC_STOPWORDS and (s is None or (s, w) not in names):
                n[s, a, w] += 1

    def written(df):
        raise AssertionError("mentions are written")

    monkeypatch.setattr(enrich, "cut_lineage", written)
    got = enrich.topic_words(texts)
    assert {(r.story_id, r.article_id, r.word): r.n for r in got.collect()} == n and got.count() == len(n) > 30
    top = enrich.topic_scores(texts, 100)
    best = sorted((s, -sum(x == (s, w) for x in ((k[0], k[2]) for k in n)), -sum(c for k, c in n.items() if (k[0], k[2]) == (s, w)), w)
                  for s, w in {(k[0], k[2]) for k in n if k[0] is not None})
    assert [(r.story_id, r.word) for r in top.orderBy("story_id", "rank").collect()] == [(s, w) for s, _, _, w in best]
    for df in (got, top):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(story_id#\d+L?, article_id#\d+L?, word", plan)


def test_narrow_bounds_visit_few_cells(spark):
    """Under a narrow bound an article visits the cells around it only, and the rows, also the earlier ones, are those of all blocks."""
    rng = np.random.default_rng(5)
    vectors = [rng.normal(size=24) for _ in range(300)]
    vectors += [v + rng.normal(scale=1e-3, size=24) for v in vectors[:60]] + vectors[:30]
    made = [(i, KEY, "en", 1000 * (i % 97), 1000 * (i % 97), 10 ** 9, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows = spark.createDataFrame(made, "id long, model_key string, lang string, t long, lo long, hi long, vector array<double>")
    for earlier in (False, True):
        how = {"k": 2, "max_distance": 1e-4, "bucket_us": 10 ** 12, "earlier_only": earlier, "block_rows": 16}
        want = {tuple(r) for r in cd.blocked_topk(rows, rows, **how).collect()}
        assert {tuple(r) for r in cd.nearest_rows(rows, rows, **how).collect()} == want and len(want) > 50
        assert "home" in cd.nearest_rows(rows, rows, **how)._jdf.queryExecution().analyzed().toString()
    left, right = cd._bucketed(rows, rows, 10 ** 12)
    dealt, cells = cd.pivot_cells(right, 16)
    visits = cd.pivot_visits(left, cells, 1e-4).agg(F.avg(F.size("cells"))).first()[0]
    assert cells.count() > 15 and visits < 3


def test_no_text_is_moved_where_no_pair_is_in_doubt(spark, monkeypatch):
    """Texts are asked for the evidence of doubtful pairs only."""
    asked = []
    evidence = match.member_evidence
    monkeypatch.setattr(match, "member_evidence", lambda *a, **k: asked.append(a[4]) or evidence(*a, **k))
    batch = spark.createDataFrame([(1, "en", T0)], "article_id long, language string, event_time timestamp")
    emb = spark.createDataFrame([(1, KEY, [1.0, 0.0]), (2, KEY, [1.0, 0.0])], "article_id long, model_key string, vector array<float>")
    stories = spark.createDataFrame([(7, "ACTIVE", "en")], "story_id long, status string, language string")
    story_emb = spark.createDataFrame([(7, KEY, [1.0, 0.0])], "story_id long, model_key string, vector array<double>")
    members = spark.createDataFrame([(7, 2)], "story_id long, article_id long")
    times = spark.createDataFrame([(2, T0)], "article_id long, event_time timestamp")
    texts = spark.createDataFrame([(i, "Elsby", "", "Elsby") for i in (1, 2)], "article_id long, title string, description string, body_text string")
    got = match.decide_snapshot(batch, emb, stories, story_emb, members, times, texts, model_key=KEY).collect()
    assert [(r.kind, r.rule, r.story_id) for r in got] == [("MATCH", "PRIMARY_DISTANCE", 7)]
    assert asked[0]._jdf.queryExecution().optimizedPlan().maxRows().get() == 0
