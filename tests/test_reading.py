"""Reader rules against one-at-a-time models."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventweave.operators import reading, refresh, skew

T0 = datetime(2024, 1, 1)
EVENTS = "user_id long, event_key string, session_id string, story_id long, position long, seq long"


def accept_model(rows, known, accepted=()):
    by_event = {(a[0], a[1]): a[2:5] for a in accepted}
    slots = {(a[0], a[2], a[3]) for a in accepted}
    out = {}
    for user, key, session, story, position, seq in sorted(rows, key=lambda r: r[5]):
        body = (session, story, position)
        if (user, key) in by_event:
            out[seq] = "duplicate" if by_event[user, key] == body else "event_conflict"
        elif story not in known:
            out[seq] = "story_not_found"
        elif (user, session, story) in slots:
            out[seq] = "event_conflict"
        else:
            by_event[user, key] = body
            slots.add((user, session, story))
            out[seq] = "accepted"
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_accept_impressions(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(2), f"e{rng.randrange(14)}", f"s{rng.randrange(3)}", rng.randrange(7),
             rng.randrange(2), i) for i in range(150)]
    prior = [(0, "e1", "s0", 1, 0), (1, "e2", "s1", 2, 1)]
    old = spark.createDataFrame([(*p, 0) for p in prior], EVENTS).drop("seq")
    known = spark.createDataFrame([(i,) for i in range(5)], "story_id long")
    got = reading.accept_impressions(spark.createDataFrame(rows, EVENTS), known, old,
                                     body=["position"], order=["seq"])
    result = {r.seq: r.outcome if r.outcome != "rejected" else r.code for r in got.collect()}
    assert result == accept_model(rows, set(range(5)), prior)


def test_bookmarks(spark):
    rng = random.Random(3)
    cmds = [(rng.randrange(3), rng.randrange(4), T0 + timedelta(minutes=i // 2), i, rng.choice(["save", "save", "remove"]))
            for i in range(60)]
    eligible = {0, 1, 2}
    want = {(0, 3): T0, (1, 1): T0}
    start = dict(want)
    for user, story, at, _, op in cmds:
        if op == "remove":
            want.pop((user, story), None)
        elif (user, story) not in want and story in eligible:
            want[user, story] = at
    got = reading.bookmark_set(
        spark.createDataFrame(cmds, "user_id long, story_id long, at timestamp, seq long, op string"),
        spark.createDataFrame([(i,) for i in eligible], "story_id long"),
        spark.createDataFrame([(*k, v) for k, v in start.items()], "user_id long, story_id long, created_at timestamp"))
    assert {(r.user_id, r.story_id): r.created_at for r in got.collect()} == want


def exposure_model(reports, share, dwell):
    """The report-by-report rule for one session."""
    since, done, out = {}, set(), {}
    for t, gate, cards in [*reports, (10**9, False, [])]:
        for story, (start, pos) in list(since.items()):
            if t - start >= dwell:
                out[story] = (pos, start + dwell)
                done.add(story)
                del since[story]
        shown = {s: p for s, p, x in cards if gate and x >= share and s not in done}
        since = {s: (since[s][0] if s in since else t, p) for s, p in shown.items()}
    return out


@pytest.mark.parametrize("seed", [5, 6])
def test_exposures(spark, seed):
    rng = random.Random(seed)
    reports, rows = {}, []
    for session in ("a", "b"):
        t = 0
        for n in range(40):
            t += rng.choice([100, 400, 600, 1000])
            cards = [(s, rng.randrange(9), rng.choice([0.2, 0.49, 0.5, 0.9, 0.9])) for s in range(3) if rng.random() < 0.8]
            gate = rng.random() < 0.85
            reports.setdefault(session, []).append((t, gate, cards))
            rows.append((1, session, t, n, gate, cards))
    df = spark.createDataFrame(rows, "user_id long, session_id string, t_ms long, seq long, gate_open boolean, "
                                     "cards array<struct<story_id:long,position:long,share:double>>")
    got = {(r.session_id, r.story_id): (r.position, r.occurred_ms)
           for r in reading.qualify_exposures(df, block_ms=2_000).collect()}
    assert got == {(s, k): v for s, rs in reports.items() for k, v in exposure_model(rs, 0.5, 1000).items()}


GOOD = {"event_id": "00000000-0000-4000-8000-00000000000A", "story_id": "12",
        "feed_session_id": "00000000-0000-4000-8000-000000000001", "position": 0, "surface": "HOME_FEED",
        "policy_version": 1, "occurred_at": "2024-01-01T00:00:00Z"}


@pytest.mark.parametrize("change,errors", [
    ({}, []), ({"position": 100000}, []), ({"position": 100001}, ["position"]), ({"position": -1}, ["position"]),
    ({"position": True}, ["position"]), ({"position": 1.5}, ["position"]), ({"position": "1"}, ["position"]),
    ({"story_id": 12}, ["story_id"]), ({"story_id": "012"}, ["story_id"]), ({"story_id": "9223372036854775807"}, []),
    ({"story_id": "9223372036854775808"}, ["story_id"]), ({"event_id": "x"}, ["event_id"]),
    ({"event_id": 5}, ["event_id"]), ({"surface": "SEARCH"}, ["surface"]), ({"policy_version": 2}, ["policy_version"]),
    ({"policy_version": "1"}, ["policy_version"]), ({"policy_version": True}, ["policy_version"]),
    ({"occurred_at": "2024-01-01T00:00:00"}, ["occurred_at"]), ({"occurred_at": None}, ["occurred_at"]),
    ({"occurred_at": "2024-01-02T00:05:00Z"}, []), ({"occurred_at": "2024-01-02T00:05:00.000001Z"}, ["occurred_at"]),
    ({"occurred_at": "2023-12-31T23:59:59.999999Z"}, ["occurred_at"]),
    ({"occurred_at": "2024-01-01T02:00:00+02:00"}, []),
    ({"extra": 1}, ["extra"]), ({"surface": ...}, ["surface"]), ({"extra": 1, "position": ...}, ["extra", "position"]),
])
def test_impression_checks(spark, change, errors):
    body = {k: v for k, v in {**GOOD, **change}.items() if v is not ...}
    # received one day after T0: events may be from T0 to T0 + 1 day + 5 minutes
    df = spark.createDataFrame([(json.dumps(body), T0 + timedelta(days=1))], "event_json string, received_at timestamp")
    assert reading.impression_checks(df).first().errors == errors


def test_not_an_object(spark):
    df = spark.createDataFrame([("[1]", T0), ("oops", T0), ("null", T0)], "event_json string, received_at timestamp")
    assert [r.errors for r in reading.impression_checks(df).collect()] == [["event"]] * 3


def test_blocked_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaab"), i, rng.randrange(100)) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    block = F.floor(F.col("o") / 7)
    number = skew.running_number(df, ["k"], ["o"], block, "n")
    lagged = skew.running_lag(df, ["k"], ["o"], block, ["v"], "p")
    seen, n, prev = {}, {}, {}
    for k, o, v in rows:
        n[k] = n.get(k, 0) + 1
        seen[o] = (n[k], prev.get(k))
        prev[k] = v
    assert {r.o: r.n for r in number.collect()} == {o: x[0] for o, x in seen.items()}
    assert {r.o: r.p.v if r.p else None for r in lagged.collect()} == {o: x[1] for o, x in seen.items()}


def test_signature_is_one_formula_for_every_size(spark):
    import hashlib

    rows = [(1, i, T0 + timedelta(microseconds=i)) for i in range(6)]
    df = spark.createDataFrame(rows, "story_id long, article_id long, updated_at timestamp")
    digests = [hashlib.sha256(f"{i}:{t.isoformat()}+00:00".encode()).hexdigest() for _, i, t in rows]
    sums = "|".join(str(sum(int(d[8 * k:8 * k + 8], 16) for d in digests)) for k in range(8))
    want = hashlib.sha256(sums.encode()).hexdigest()
    assert refresh.member_signature(df).first().member_signature == want
    assert refresh.member_signature(df.orderBy(F.desc("article_id")).repartition(3)).first().member_signature == want
    moved = df.withColumn("updated_at", F.when(F.col("article_id") == 3, F.lit(T0)).otherwise(F.col("updated_at")))
    assert refresh.member_signature(moved).first().member_signature != want


def test_prune_inside_retention(spark):
    df = spark.createDataFrame([(1, T0)], "user_id long, received_at timestamp")
    kept, count = reading.prune_impressions(df, "2024-01-02 00:00:00", "2024-03-01 00:00:00")
    assert kept.count() == 0 and count.first().eligible == 1
    with pytest.raises(Exception, match="retention"):
        reading.prune_impressions(df, "2024-02-20 00:00:00", "2024-03-01 00:00:00")[1].collect()
