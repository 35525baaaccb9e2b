"""Decontamination, mixing, chat formatting, WARC, URL filters, token counts and language ID."""

import base64
import gzip
import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventweave.llm import chat_format, mixing, ppm, suffix_arrays, token_counts, url_model, warc

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum(t):
    return ALNUM.findall((t or "").translate(LOWER))


def brute_contamination(docs, items, window):
    wins = defaultdict(set)
    for i, t in items:
        w = alnum(t)
        k = min(window, len(w))
        if k:
            for p in range(len(w) - k + 1):
                wins[tuple(w[p:p + k])].add("null" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, names = alnum(t), set(), set()
        for k in {len(x) for x in wins}:
            for p in range(len(w) - k + 1):
                found = wins.get(tuple(w[p:p + k]))
                if found:
                    names |= found
                    hit |= set(range(p, p + k))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def contaminated_corpus(window):
    rng = random.Random(4)
    voc = [f"v{i}é" if i % 7 == 0 else f"V{i}" for i in range(30)]
    say = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    items = [(i, say(rng.randrange(1, 3 * window))) for i in range(12)]
    items += [(3, items[0][1]), (20, None), (21, ""), (22, "..."), (None, say(window + 2)), (23, "rare-word"), (24, items[1][1])]
    docs = [(0, None), (1, ""), (2, "!!!"), (3, say(200))]
    for k in range(30):
        t = say(rng.randrange(0, 40))
        if k % 2:
            t += "; " + items[k % 12][1].lower().replace(" ", ", ") + ". " + say(5)
        docs.append((10 + k, t))
    docs += [(50, docs[5][1]), (50, docs[5][1]), (51, "a rare\nWORD b"), (52, say(20_000))]
    return docs, items


@pytest.mark.parametrize("block_bytes", [8 << 20, 300])
@pytest.mark.parametrize("window", [3, 10])
def test_contamination(spark, make, window, block_bytes):
    docs, items = contaminated_corpus(window)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = suffix_arrays.contamination(make(docs), bench, window=window, block_bytes=block_bytes).collect()
    want = brute_contamination(docs, items, window)
    assert sorted(tuple(r) for r in got) == want
    frame = make(docs).withColumn("row", F.lit(1)).withColumn("hit", F.lit("x"))
    clean = suffix_arrays.decontaminate(frame, bench, window=window, block_bytes=block_bytes)
    assert clean.columns == frame.columns
    assert sorted(r.doc_id for r in clean.collect()) == [w[0] for w in want if not w[5]]


def test_longest_matches(spark, make):
    docs, items = contaminated_corpus(4)
    items = [x for x in items if x[1]]
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    got = suffix_arrays.longest_matches(make(docs, 1), bench, window=4).collect()
    split = {i: alnum(t) for i, t in docs}
    flat = [alnum(t) for _, t in items]
    best = {}
    for r in got:
        w = flat[r.item_row][r.item_word:]
        at = split[r.doc_id][r.doc_word:]
        assert w[:r.length] == at[:r.length]
        best[r.item_row, r.item_word] = max(r.length, best.get((r.item_row, r.item_word), 0))
    for a, w in enumerate(flat):
        for b in range(len(w)):
            n = 0
            for d in split.values():
                for p in range(len(d)):
                    k = 0
                    while k < len(w) - b and p + k < len(d) and d[p + k] == w[b + k]:
                        k += 1
                    n = max(n, k)
            if n >= 4 or (b == 0 and n == len(w)):
                assert best[a, b] == n


@pytest.mark.parametrize("block_bytes", [400, 8 << 20])
def test_longest_table_over_all_shards_and_blocks(spark, make, block_bytes):
    docs, items = contaminated_corpus(4)
    items = items + [items[0], (items[0][0], "other words of one id " + docs[-1][1][:60]), (None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = suffix_arrays.longest_table(make(docs, 3), bench, window=4, block_bytes=block_bytes).collect()
    hashes = {(r.item_id, r.text): r.h for r in bench.select("*", F.xxhash64("text").alias("h")).collect()}
    split = [(i, alnum(t)) for i, t in docs]
    want = {}
    for i, t in {x for x in items if x[1]}:
        w = alnum(t)
        for b in range(len(w)):
            n = 0
            for _, d in split:
                for p in range(len(d)):
                    k = 0
                    while k < len(w) - b and p + k < len(d) and d[p + k] == w[b + k]:
                        k += 1
                    n = max(n, k)
            if n >= 4 or (b == 0 and n == len(w)):
                want[i, hashes[i, t], b] = n
    assert len(got) == len(want) and {(r.item_id, r.item_hash, r.item_word): r.length for r in got} == want
    texts = {(h, i): alnum(t) for (i, t), h in hashes.items() if t}
    for r in got:
        w = texts[r.item_hash, r.item_id][r.item_word:][:r.length]
        assert any(d[r.doc_word:][:r.length] == w for i, d in split if i == r.doc_id)


def test_contamination_empty(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    got = suffix_arrays.contamination(make([(1, "a b")]), none).collect()
    assert [tuple(r) for r in got] == [(1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)]
    assert suffix_arrays.contamination(make([]), none).count() == 0


def water(size, cap=3):
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    held, total = set(), sum(size.values())
    while True:
        free = [s for s in names if s not in held]
        level = (total - sum(cap * size[s] for s in held)) / max(sum(weight[s] for s in free), 1)
        new = {s for s in free if level * weight[s] > cap * size[s]}
        if not new:
            return {s: float(cap * size[s]) if s in held else level * weight[s] for s in names}
        held |= new


def test_mixing(make):
    rng = random.Random(3)
    rows = []
    for k in range(600):
        s = rng.choice(["a", "a", "a", "a", "b", "c", "Z", None, "é"])
        rows.append((k, " ".join(["w"] * rng.randrange(0, 60)) if s != "c" or k < 200 else "x", "en", s))
    rows += [(900, None, None, "a"), (901, "", None, "zero"), (5, rows[5][1], "en", rows[5][3])]
    docs = make(rows).withColumn("target", F.lit("mine")).withColumn("size", F.lit(0))
    runs = [sorted(((r.doc_id, r.size, r.taken, r.target, r.source_size, tuple(r.draws)) for r in mixing.mix_sizes(
        docs.repartition(k), block_words=500).collect())) for k in (2, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    source = {i: s for i, _, _, s in rows}
    size = defaultdict(int)
    for i, t, _, s in rows:
        size[s] += len((t or "").split())
    want, taken = water(size), defaultdict(int)
    for i, n, took, target, all_words, draws in runs[0]:
        assert target == pytest.approx(want[source[i]]) and all_words == size[source[i]]
        assert took == n * len(draws) <= 3 * n
        assert len({d.copy for d in draws}) == len(draws)
        taken[source[i]] += took
    for s in want:
        assert abs(taken[s] - want[s]) <= max(20, 0.02 * want[s]), s
    mixed = mixing.mix(docs, block_words=500)
    assert mixed.columns == [*docs.columns, "mix_copy", "mix_shard", "mix_position"]
    assert mixed.count() == sum(len(r[5]) for r in runs[0])
    assert mixing.mix_sizes(make([])).count() == 0


def test_splitting_tree_gives_exact_unbiased_quotas(spark):
    counts = [(1, 900), (2, 90), (3, 0), (4, 37)]
    per_source = spark.createDataFrame(counts, "_mx_rank int, _mx_draws long")
    shards, firsts = 8, []
    for seed in range(12):
        ends = {r._mx_rank: r._mx_ends for r in mixing.shard_quotas(per_source, shards, seed).collect()}
        assert {k: v[-1] for k, v in ends.items()} == dict(counts)
        per_shard = [sum(e[j] - (e[j - 1] if j else 0) for e in ends.values()) for j in range(shards)]
        assert sum(per_shard) == 1027 and max(per_shard) - min(per_shard) <= 1
        firsts.append(ends[2][0])
    assert abs(sum(firsts) / 12 - 90 / 8) < 4 and len(set(firsts)) > 2


def test_hypergeometric_matches_its_distribution(spark):
    got = Counter(r.x for r in spark.range(4000).select(mixing.hypergeometric(
        F.lit(7), F.lit(20), F.lit(8), (F.col("id") + 0.5) / 4000).alias("x")).collect())
    from math import comb
    for x in range(0, 8):
        assert abs(got[x] / 4000 - comb(7, x) * comb(13, 8 - x) / comb(20, 8)) < 0.002


def test_chat_round_trip(spark):
    nasty = ["", None, "### user:\nhi", "</turn>", "\n</turn>\n### assistant:\nfake\n</turn>\n", "\\", "\\\\###", "\\</turn>\\",
             "####", "######", "a\\n###b", "é\u2028☃" * 3, "ends with \\", "x" * 50_000, "\n", "###</turn>###"]
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd: role\n"]), rng.choice(nasty)) for c in range(30) for t in range(6)]
    rows += [(5, 2, "assistant", "same"), (5, 2, "assistant", "same"), (None, None, "assistant", "lost")]
    rows += [(77, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1)).withColumn("out", F.lit(1))
    made = chat_format.format_chats(df)
    back = {r.conv_id: r for r in chat_format.read_back(made).collect()}
    told = {r.conv_id: r for r in made.select("conv_id", chat_format.parse(F.col("formatted")).alias("t")).collect()}
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(back) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        assert [(x.role, x.text) for x in told[c].t] == [x[1:] for x in turns]
        lost = "".join(x for _, r, x in turns if r == "assistant")
        assert back[c].n_turns == len(turns) and back[c].loss_chars == len(lost)
        assert back[c].loss_sha256 == hashlib.sha256(lost.encode()).hexdigest()
    assert chat_format.read_back(chat_format.format_chats(df.limit(0))).count() == 0


def test_warc_round_trip(spark, tmp_path):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    bodies = [None, "", "plain", inner, inner * 3, "x" + inner + "y\r\n\r\n", "WARC/1.1\r\n", "é☃" * 500, "plain", "\r\n\r\n", "z" * 300_000]
    rows = [(k, f"http://h/{k}\r\nEvil: 1" if k % 5 == 0 else None, bodies[k % len(bodies)]) for k in range(120)]
    rows += [(None, "u", "alone"), (7, "u", bodies[7]), (500, "u", "tail")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("first", F.lit(1)).withColumn("sha", F.lit(1))
    got = warc.round_trip(pages, records_per_file=13).collect()
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = least.get(h or "", i)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((str(i), len(data), digest, "response" if i == first else "revisit", str(None if i == first else first)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    big = warc.round_trip(pages, records_per_file=13, min_bytes=1000).filter("record_type = 'revisit'").collect()
    assert {r.payload_bytes >= 1000 for r in big} == {True}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_ppm_learns_from_whole_texts(spark, make, monkeypatch):
    head, tails = "lorem ipsum " * 2000, {"de": "der hund und die katze ", "en": "the dog and the cat "}
    docs = spark.createDataFrame([(k, head + tails[x] * 40, x) for k, x in enumerate(["de", "en"] * 3)],
                                 "doc_id long, text string, lang string")
    model = ppm.fit(docs, F.lit(True))
    got = ppm.identify(make([(1, "und die katze"), (2, "and the cat")]), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "de", 2: "en"}
    data, offsets = ppm.utf8_buffer(pa.array(["skipped", "der hund und die katze", "", "öl", "a" * 40]))
    for size in (1, 2, 3, 7, 1 << 20):
        monkeypatch.setattr(ppm, "CHUNK", size)
        found = [Counter() for _ in range(4)]
        for parts in ppm._pieces(data, offsets, [1, 2, 3, 4], 3):
            for k in range(4):
                found[k].update(g for p in parts[k] for g in p.tolist())
        texts = [bytes(data[offsets[r]:offsets[r + 1]]) for r in (1, 2, 3, 4)]
        assert found == [Counter(int.from_bytes(t[i:i + k], "big") for t in texts for i in range(len(t) - k + 1))
                         for k in (1, 2, 3, 4)]


def test_ppm_sample_counts_only_ids_that_can_be_picked(spark):
    ids = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), F.lit("de").alias("lang"))
    far = F.shiftrightunsigned(F.xxhash64("id"), 11).cast("double") / float(1 << 53) > 0.5
    few = spark.range(100_000, 100_100).filter(far).select(
        F.col("id").alias("doc_id"), F.lit("der hund").alias("text"), F.lit("de").alias("lang"))
    assert ppm.sampled(ids.unionByName(few), "doc_id", "text", "lang", F.lit(True)).count() == few.count() > 0
    often = few.limit(2).crossJoin(spark.range(5_000)).drop("id")
    assert ppm.sampled(often, "doc_id", "text", "lang", F.lit(True)).count() == 10_000


def slow_candidates(content):
    """Each magic string on its own: header to the next blank line, last line of a name wins."""
    out, at = [], content.find(warc.MAGIC)
    while at >= 0:
        end = content.find(b"\r\n\r\n", at)
        head = content[at:end + 2] if end >= 0 else b""
        fields = {k: v.rstrip(b"\r") for k, v in re.findall(rb"^([A-Za-z-]+): (.*)$", head, re.M)}
        size = fields.get(b"Content-Length", b"")
        if size.isdigit() and content[end + 4 + int(size):end + 8 + int(size)] == b"\r\n\r\n":
            block = content[end + 4:end + 4 + int(size)]
            http, blank, body = block.partition(b"\r\n\r\n")
            payload = body if blank else block
            said = re.search(rb"\r\nContent-Length: (\d+)\r\n", http + b"\r\n") if blank else None
            kind = fields.get(b"WARC-Type", b"").decode()
            n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if kind == "revisit":
                n = int(said[1]) if said else 0
                digest = fields.get(b"WARC-Payload-Digest", b"").removeprefix(b"sha1:").decode()
            ids = [re.fullmatch(rb"<urn:x-page:(-?\d+)>", fields.get(f, b"")) for f in (b"WARC-Record-ID", b"WARC-Refers-To")]
            out.append((at, end + 8 + int(size), ids[0] and int(ids[0][1]), n, digest, kind, ids[1] and int(ids[1][1])))
        at = content.find(warc.MAGIC, at + 1)
    return out


def test_warc_candidates_in_odd_bytes():
    rng = random.Random(5)
    parts = [b"WARC/1.1\r\n", b"\r\n", b"\r\n\r\n", b"WARC-Type: response\r\n", b"WARC-Type: revisit\r\n", b"x: WARC/1.1\r\n",
             b"WARC-Record-ID: <urn:x-page:4>\r\n", b"WARC-Refers-To: <urn:x-page:-2>\r\n", b"abc", b"\n",
             b"Content-Length: 3\r\n\r\nabc\r\n\r\n", b"Content-Length: 10\r\n\r\nWARC/1.1\r\n\r\n\r\n",
             b"Content-Length: 26\r\n\r\nx\r\nContent-Length: 6\r\n\r\nWARC\r\n\r\n",
             b"WARC-Payload-Digest: sha1:QQ\r\n", *[b"Content-Length: %d\r\n" % n for n in (0, 3, 4, 7, 10, 21, 33)]]
    found = 0
    for _ in range(4000):
        content = b"".join(rng.choice(parts) for _ in range(rng.randrange(60)))
        want = slow_candidates(content)
        assert warc.candidates_of(content) == want
        found += len(want)
    assert found > 1000
    began = time.time()
    assert warc.candidates_of(warc.MAGIC * 1_000_000) == []
    assert warc.candidates_of(warc.MAGIC * 1_000_000 + b"Content-Length: 9\r\n\r\n") == []
    assert warc.candidates_of(b"Content-Length: " + b"9" * 5_000_000 + b"\r\n\r\n") == []
    assert warc.candidates_of(warc.MAGIC + b"Content-Length: " + b"9" * 5_000_000 + b"\r\n\r\n") == []
    many = warc.candidates_of(warc.MAGIC * 300_000 + b"Content-Length: 9\r\n\r\n123456789\r\n\r\n")
    assert len(many) == 300_000 and {c[3] for c in many} == {9}
    assert time.time() - began < 30


def test_warc_of_gzip_members(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", "same" if k % 3 == 0 else f"body {k} WARC/1.1\r\n") for k in range(30)],
                                  "page_id long, url string, html string")
    folder, packed = tmp_path / "plain", tmp_path / "packed"
    warc.write(pages, str(folder), records_per_file=7)
    packed.mkdir()
    for n, file in enumerate(sorted(folder.glob("*.txt"))):
        data = file.read_bytes()
        cuts = [0, *[c[1] for c in warc.candidates_of(data)]]
        assert cuts[-1] == len(data)
        (packed / f"{n}.warc.gz").write_bytes(b"".join(gzip.compress(data[a:b]) for a, b in zip(cuts, cuts[1:])))
    want = sorted(map(tuple, warc.read(spark, str(folder)).collect()), key=str)
    assert sorted(map(tuple, warc.read(spark, str(packed)).collect()), key=str) == want and len(want) == 30


def test_warc_round_trip_packs_its_archives(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "WARC/1.1\r\n", "é☃", "\x1f\x8b"]) for _ in range(n))
    rows = [(k, f"http://h/{k}", say(400)) for k in range(60)] + [(60, None, None), (61, "u", ""), (None, "u", say(5)), (62, "u", say(60_000))]
    rows += [(100 + k, "u", rows[k][2]) for k in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    plain = tmp_path / "plain"
    warc.write(pages, str(plain), records_per_file=20)
    want = sorted(map(tuple, warc.read(spark, str(plain)).collect()), key=str)
    monkeypatch.setattr(warc, "scratch_folder", lambda spark: str(tmp_path / "trip"))
    assert sorted(map(tuple, warc.round_trip(pages, records_per_file=20).collect()), key=str) == want and len(want) == len(rows)
    # every record stands whole in the packed files, which take a fraction of the plain ones
    packed = [f.read_bytes() for f in (tmp_path / "trip" / "warc").glob("part-*")]
    ends = [f.read_bytes() for f in plain.glob("part-*")]
    cut = lambda files: sorted(d[c[0]:c[1]] for d in files for c in warc.candidates_of(d))
    assert cut(map(warc.plain, packed)) == cut(ends) and len(cut(ends)) == len(rows)
    assert sum(map(len, packed)) < 0.5 * sum(map(len, ends))


def test_warc_broken_chain_is_an_error(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nrubbish")
    with pytest.raises(ValueError):
        warc.read(spark, str(tmp_path)).count()


def test_url_rules_and_model(spark):
    rng = random.Random(2)
    urls = [None, "", "no scheme", "://", "HTTP://WWW.Example.COM/en/7?x#y", "http://com/en/", "http://xcom/en/1", "http://a.example.net/de/81",
            "http://b.net/de/8", "x://a.org/es/#f", "x://h?p", "http://é.org/fr/1", "http://user@a.com:80/en/x", "a://b.com/en/://c"]
    urls += [f"http://{rng.choice(['www', 'm', 'spam', 'shop'])}.{rng.choice('abcd')}{k}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{k}" for k in range(300)]
    rows = [(k, u) for k, u in enumerate(urls)] + [(0, "http://a.org/es/"), (None, "http://spam.b.org/fr/9")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("triple", F.lit(1))
    got = {(r.page_id, r.url): r for r in url_model.judge(pages).join(
        spark.createDataFrame(rows, "id long, url string"), F.col("page_id").eqNullSafe(F.col("id"))).collect()}
    assert url_model.judge(pages).count() == len(rows)
    for i, u in rows[1:len(urls)]:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in url_model.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = got[i, u]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None), u
        assert r.verdict == max(fits)[2] if fits else r.verdict in ("allow", "block")
    assert url_model.judge(pages.limit(0)).count() == 0


def test_url_difference_table_matches_a_direct_count(spark):
    good, bad = ["http://aa/b", "http://ab/c"], ["ftp://zz/z"]
    data = [(True, u) for u in good] + [(False, u) for u in bad]
    df = spark.createDataFrame(data, "accepted boolean, url string").select("accepted", F.explode(url_model.triples(F.col("url"))).alias("triple"))
    table = {r.triple: r.gain for r in url_model.difference_table(df).collect()}

    def codes(u):
        return [url_model.START] * 2 + [url_model.LETTERS.find(c) + 1 for c in u]

    def model(texts):
        n = [Counter(), Counter(), Counter()]
        for t in texts:
            p = codes(t)
            for k in range(2, len(p)):
                for size in range(3):
                    n[size][tuple(p[k - size:k + 1])] += 1

        def prob(gram):
            p = 1 / 64
            for size in range(3):
                g = gram[2 - size:]
                follow = [v for x, v in n[size].items() if x[:-1] == g[:-1]]
                if follow:
                    p = (n[size][g] + len(follow) * p) / (sum(follow) + len(follow))
            return p
        return prob

    import math
    yes, no = model(good), model(bad)
    for gram in [(62, 62, 8), (1, 1, 32), (26, 26, 26), (0, 5, 9), (20, 20, 16)]:
        assert table[(gram[0] * 64 + gram[1]) * 64 + gram[2]] == pytest.approx(math.log(yes(gram)) - math.log(no(gram)))


def test_token_counts(make):
    texts = [None, "", "hello world", "hello world", "a  b\n\n c", "<|endoftext|>", "word " * 30_000, "é☃ naïve", "don't 123,456"]
    docs = make([(i, t) for i, t in enumerate(texts)])
    n = {r.doc_id: r.n_tokens for r in token_counts.document_tokens(docs).collect()}
    with open(token_counts.VOCABULARY, "rb") as f:
        encoding = token_counts._encoding(f.read())
    assert n == {i: len(encoding.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    table = token_counts.limit_table(token_counts.length_histogram(docs))
    got = {r.limit: r for r in table.collect()}
    assert set(got) == set(n.values())
    for limit, r in got.items():
        assert r.docs_up_to == sum(v <= limit for v in n.values()) and r.docs_beyond == sum(v > limit for v in n.values())
        assert r.tokens_cut == sum(min(v, limit) for v in n.values()) and r.total_tokens == sum(n.values())
    assert token_counts.tokens_at(table, 7).first().tokens_cut == sum(min(v, 7) for v in n.values())
    assert token_counts.quantile(table, 0.5).first().limit == sorted(n.values())[(len(n) - 1) // 2]
    assert token_counts.limit_table(token_counts.length_histogram(make([]))).count() == 0


def test_pieces_do_not_change_the_encoding():
    rng = random.Random(0)
    with open(token_counts.VOCABULARY, "rb") as f:
        encoding = token_counts._encoding(f.read())
    text = "".join(rng.choice(["a", "bc", " ", "  ", "\n", "'s", "12", "é", ".", "\t "]) for _ in range(90_000))
    assert len(list(token_counts.pieces(text))) > 1 and "".join(token_counts.pieces(text)) == text
    assert token_counts.encoded_length(encoding, text) == len(encoding.encode_ordinary(text))


def brute_ppm(samples, order):
    """bits(data, lang) by walking the tree byte by byte."""
    from math import log2
    trees = {}
    for lang, data in samples:
        tree = trees.setdefault(lang, defaultdict(Counter))
        for b in data:
            for k in range(len(b)):
                for size in range(order + 1):
                    if k >= size:
                        tree[b[k - size:k]][b[k]] += 1
    seen = {x for _, data in samples for b in data for x in b}

    def bits(b, lang):
        total = 0.0
        for k in range(len(b)):
            done = False
            for size in range(min(order, k), -1, -1):
                ctx = b[k - size:k]
                follow = trees[lang].get(ctx)
                if not follow:
                    continue
                n, d = sum(follow.values()), len(follow)
                if follow[b[k]]:
                    total += log2((n + d) / follow[b[k]])
                    done = True
                    break
                total += log2((n + d) / d)
            if not done:
                total += 8.0
        return total
    return bits, seen


def test_ppm_code_lengths_match_a_tree_walk(spark):
    samples = [("de", ["der hund und die katze".encode(), "das öl".encode()]), ("en", [b"the dog and the cat", b"then"])]
    rows = [(lang, t.decode()) for lang, data in samples for t in data]
    model = ppm.learn(spark.createDataFrame(rows, "lang string, text string"), order=3)
    bits, seen = brute_ppm(samples, 3)
    import numpy as np
    texts = ["the hund", "then cat", "ddd", "öl and"]
    assert all(set(t.encode()) <= seen for t in texts)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    got = ppm.code_lengths(model, data, offsets)
    for r, t in enumerate(texts):
        for c, lang in enumerate(model.languages):
            assert got[r, c] == pytest.approx(bits(t.encode(), lang), rel=1e-4), (t, lang)


def test_language_id_edges_and_accuracy(spark, make):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    teach = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    model = ppm.fit(docs, teach)
    held = ppm.identify(docs.filter(~teach), model)
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count()
    odd = make([(1, None), (2, ""), (3, "123 !?"), (4, docs.first().text), (4, docs.first().text)]).withColumn("score", F.lit("x"))
    got = {r.doc_id: (r.lang_pred, r.s) for r in ppm.identify(odd, model, score="s").collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == docs.first().lang and 0.5 < got[4][1] <= 1
    assert {r.lang_pred for r in ppm.identify(odd, None, score="s").collect()} == {"und"}
    assert ppm.fit(docs, F.lit(False)) is None


def test_one_language_with_nearly_all_rows(spark, make):
    """The sample is that of the smallest hashes, whatever share a language has; no task gets the language whole."""
    docs = make([(i % 1500, f"text {i % 1500} x", "en") for i in range(3000)] + [(5000 + i, f"wort {i}", "de") for i in range(20)]
                + [(None, "none", "fr"), (7000, "", "fr"), (7001, None, "fr"), (7002, "x", None)], 8)
    sample = ppm.sampled(docs, "doc_id", "text", "lang", F.lit(True), per_language=50)
    place = {r.doc_id: r.h for r in docs.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id"), 11).alias("h")).distinct().collect()}
    first = sorted(range(1500), key=lambda i: place[i])[:50]
    got = Counter((r.lang, r.text) for r in sample.collect())
    assert got == Counter({**{("en", f"text {i} x"): 2 for i in first}, **{("de", f"wort {i}"): 1 for i in range(20)}, ("fr", "none"): 1})


def test_many_languages_stay_in_bounds(spark, make, monkeypatch):
    """60 languages with letters of their own: the table keeps to its bound and still tells them apart."""
    rng = random.Random(6)
    monkeypatch.setattr(ppm, "MODEL_BYTES", 40 << 20)
    letters = [[chr(0x4E00 + 20 * k + j) for j in range(20)] for k in range(60)]
    say = lambda k: " ".join("".join(rng.choices(letters[k], k=6)) for _ in range(30))
    docs = make([(60 * i + k, say(k), f"l{k:02}") for i in range(6) for k in range(60)])
    model = ppm.fit(docs, F.col("doc_id") < 240)
    assert model.bits.nbytes <= 40 << 20 and len(model.languages) == 60
    judged = ppm.identify(docs.filter("doc_id >= 240"), model)
    wrong = [(r.lang, r.lang_pred, r.score) for r in judged.collect() if r.lang_pred != r.lang]
    assert not wrong, (model.order, model.bits.nbytes, wrong)
