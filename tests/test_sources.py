"""Feed documents, the labelled corpus and published generations."""

import json
from datetime import datetime

import pytest

from eventweave.sources import feeds, layout
from eventweave.sources.tables import read


def test_rss_and_atom(spark):
    rss = ("<?xml version='1.0'?><rss version='2.0' xmlns:content='http://c' xmlns:dc='http://dc'><channel>"
           "<language>en-us</language><item><title>A &amp; B</title><link>http://e/1</link>"
           "<guid isPermaLink='false'>g1</guid><description>&lt;p&gt;d&lt;/p&gt;</description>"
           "<content:encoded><![CDATA[<p>full</p>]]></content:encoded>"
           "<pubDate>Wed, 21 Oct 2015 07:28:00 GMT</pubDate><dc:creator>Jane</dc:creator></item>"
           "<item><guid>http://perma</guid><title>P</title><pubDate>soon</pubDate></item>"
           "<item><title>only</title></item></channel></rss>")
    atom = ("<feed xmlns='http://www.w3.org/2005/Atom' xml:lang='pt-BR'><entry xml:lang='fr'><id>u1</id>"
            "<title>One</title><updated>2015-10-21T07:28:00Z</updated><link rel='self' href='http://self'/>"
            "<link rel='alternate' href='http://e/a'/><content type=\"xhtml\"><div>hi <b>you</b></div></content>"
            "<author><name>N</name></author></entry></feed>")
    docs = spark.createDataFrame([(1, rss), (2, atom), (3, "<rss><channel>"), (4, "")], "n int, body string")
    entries = feeds.parse_rss(docs).cache()
    got = {(r.n, r.position): r for r in feeds.items(entries).collect()}
    a, b, c = got[1, 0], got[1, 1], got[2, 0]
    assert (a.external_id, a.url, a.title, a.summary_html, a.content_html, a.authors, a.language) == (
        "g1", "http://e/1", "A & B", "<p>d</p>", "<p>full</p>", ["Jane"], "en-us")
    assert a.published_at == datetime(2015, 10, 21, 7, 28)
    assert (b.url, b.published_at, b.raw["date_parse_error"]) == ("http://perma", None, "published")
    assert (c.external_id, c.url, c.language, c.authors) == ("u1", "http://e/a", "fr", ["N"])
    assert c.content_html == "<div>hi <b>you</b></div>" and c.published_at == c.updated_at
    assert {(r.n, r.position, r.reject_reason) for r in feeds.rejects(entries).collect()} == {
        (1, 2, "MISSING_IDENTITY"), (3, None, "MALFORMED"), (4, None, "MALFORMED")}


def test_labeled_corpus(spark, tmp_path):
    record = {"source_slug": "s", "title": "T", "body": "B", "language": "en", "expected_event": "e", "note": "n"}
    doc = {"schema_version": 1, "anchor": "2024-01-01T00:00:00Z",
           "articles": [{"id": "a", "published_offset_minutes": 90, **record},
                        {"id": "a", "published_offset_minutes": 0, **record},
                        {"id": "b", "published_offset_minutes": 5, "syndicated_from": "c", **record},
                        {"id": "c", "published_offset_minutes": 5, "syndicated_from": "a", **record}],
           "scenarios": {"x": {"description": "d", "article_ids": ["a", "zz"]}}}
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps(doc))
    parts = layout.labeled_corpus(spark, str(path))
    assert parts["articles"].filter("position = 0").first().published_at == datetime(2024, 1, 1, 1, 30)
    assert {(r.problem, r.id) for r in parts["problems"].collect()} == {
        ("duplicate_id", "a"), ("syndicated_from_not_earlier", "b"), ("unknown_scenario_member", "zz")}


def test_generations(spark, tmp_path):
    root = str(tmp_path / "gold")
    one = spark.createDataFrame([(1, "x")], "id int, v string")
    assert layout.current_generation_id(spark, root) == 0
    assert layout.publish_generation(spark, root, {"t": one}) == 1
    assert layout.publish_generation(spark, root, {"t": one.union(one)}) == 2
    assert layout.read_generation(spark, root, "t").count() == 2
    assert layout.read_generation(spark, root, "t", 1).count() == 1


def test_lost_race(spark, tmp_path):
    """Of two jobs that follow the same generation one publishes; the other's tables stay invisible."""
    root, rows = str(tmp_path), lambda n: spark.range(n)
    seen = layout.publish_generation(spark, root, {"t": rows(1)})
    assert layout.publish_generation(spark, root, {"t": rows(2), "u": rows(7)}, after=seen) == 2
    with pytest.raises(layout.LostRace):
        layout.publish_generation(spark, root, {"t": rows(3)}, after=seen)
    assert layout.read_generation(spark, root, "t").count() == 2
    assert layout.publish_generation(spark, root, {"t": rows(4)}) == 3
    # a publisher that died between claim and manifest
    path, fs = layout._fs(spark, f"{root}/_published/{4:012d}.json")
    fs.create(path, False).close()
    assert layout.current_generation_id(spark, root) == 3
    with pytest.raises(layout.LostRace):
        layout.publish_generation(spark, root, {"t": rows(5)})
    assert layout.drop_empty_claim(spark, root, 4) and not layout.drop_empty_claim(spark, root, 3)
    assert layout.publish_generation(spark, root, {"t": rows(5)}) == 4
    with pytest.raises(FileNotFoundError):
        layout.read_generation(spark, f"{root}/none", "t")


def test_small_tables_use_all_cores(spark):
    assert read(spark, "/root/testdata/sf0.001", "documents").rdd.getNumPartitions() > 1
