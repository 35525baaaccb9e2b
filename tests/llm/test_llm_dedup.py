"""Substring dedup, exact dedup and the n-gram join against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from eventweave.llm import anchors, content_sort, ngram_join

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def corpus(seed=1):
    """Copies, near copies, a hot passage, repeats inside a document, odd white space and edges."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 50))
    base = " ".join(words(rng, 120))
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one two"), (4, "one two"), (5, "ONE two"), (6, "One two")]
    rows += [(10 + i, base) for i in range(12)]
    for i in range(25):
        w = base.split()
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = f"n{i}"
        rows.append((40 + i, " ".join(w)))
    for i in range(20):
        rows.append((80 + i, " ".join(words(rng, 60)) + "\n" + passage.replace(" ", "\t" if i % 2 else "  ") + " " + " ".join(words(rng, 30))))
    twice = " ".join(words(rng, 40))
    rows.append((120, twice + " x y z " + twice))
    rows.append((121, " ".join(["same"] * 90)))
    rows.append((122, " ".join(words(rng, 30_000, 3000))))
    rows += [(130, "é ü ñ " * 20), (130, "é ü ñ " * 20), (131, base), (131, base)]
    return rows


def brute_substring(rows, window):
    split = [SPACED.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, split):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if count[tuple(w[p:p + window])] > 1:
                gone[p:p + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("window", [35, 8])
def test_substring(make, window):
    rows = corpus()
    got = anchors.substring_dedup(make(rows), window=window).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_substring(rows, window)
    assert all(sum(s.end - s.first for s in r.removed) == r.n_removed for r in got)


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        for i in ids:
            out.append((i, max(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 7])
def test_exact_groups(make, parts):
    rows = corpus()
    got = content_sort.exact_groups(make(rows), n_partitions=parts).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_exact(rows)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({t or "" for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_keeps_one_row_each_with_all_columns(make):
    rows = corpus()
    docs = make(rows).withColumn("kept", F.lit("mine")).withColumn("row", F.lit(1)).withColumn("_id", F.lit(2))
    got = content_sort.exact_dedup(docs)
    assert got.columns == docs.columns
    assert sorted((r.text or "", r.doc_id) for r in got.collect()) == sorted(
        (t, max(i for i, u in rows if (u or "") == t)) for t in {t or "" for _, t in rows})


def test_exact_normalise_and_null_id(make):
    docs = make([(1, "A"), (2, "a"), (None, "a"), (None, "b")])
    got = content_sort.exact_groups(docs, normalise=F.lower).collect()
    assert sorted((r.keep_id or 0, r.doc_id or 0, r.kept) for r in got) == [
        (0, 0, True), (2, 0, False), (2, 1, False), (2, 2, True)]
    assert content_sort.exact_dedup(docs, normalise=F.lower).count() == 2


def brute_classes(rows, n=5, percent=75):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = SPACED.findall((t or "").translate(lower))
        sets.append({tuple(w[j:j + n]) for j in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if rows[a][0] == rows[b][0] or (both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("tile_bytes", [1 << 20, 6000])
def test_ngram_classes(make, tile_bytes):
    rows = corpus(5)
    rng = random.Random(9)
    chain = words(rng, 200)  # neighbours link, ends do not
    for k in range(12):
        rows.append((200 + k, " ".join(chain)))
        chain = chain[12:] + words(rng, 12)
    got = ngram_join.ngram_classes(make(rows), tile_bytes=tile_bytes).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_classes(rows)


@pytest.mark.parametrize("tile_bytes", [3000, 8 << 20])
def test_ngram_links(make, tile_bytes):
    rows = [r for r in corpus(5) if r[0] != 122]
    got = ngram_join.ngram_links(make(rows), tile_bytes=tile_bytes).collect()
    sets = []
    for _, t in rows:
        w = [re.sub("[A-Z]", lambda c: c[0].lower(), x) for x in SPACED.findall(t or "")]
        sets.append({tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    want = [(i, sum(1 for b, y in enumerate(sets) if a != b and x and 100 * len(x & y) >= 75 * len(x | y)))
            for a, ((i, _), x) in enumerate(zip(rows, sets))]
    assert sorted((r.doc_id, r.n_links) for r in got) == sorted(want)


def test_ngram_tiles_are_split_and_signatures_bound(spark, make):
    sets = spark.createDataFrame([(1, r, 100 + r, 800) for r in range(40)], "grp long, rep long, n long, bytes long")
    tiled = ngram_join.tiles(sets, 4000, 75)
    assert tiled.filter("split").count() == 40
    assert tiled.groupBy("band", "part").count().count() > 3
    rng = random.Random(2)
    import numpy as np
    for _ in range(50):
        pool = np.array([rng.getrandbits(64) for _ in range(60)], np.uint64)
        a, b = np.unique(rng.sample(list(pool), 40)), np.unique(rng.sample(list(pool), 30))
        apart = np.bitwise_count(ngram_join.signature(a) ^ ngram_join.signature(b)).sum()
        assert (len(a) + len(b) - int(apart)) // 2 >= len(np.intersect1d(a, b))


def test_ngram_dedup(make):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x y z"), (4, None), (5, ""), (None, "a b c d e f g")]
    docs = make(rows).withColumn("n", F.lit(1)).withColumn("rep", F.lit(1))
    got = ngram_join.ngram_dedup(docs)
    assert got.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got.collect()) == [-1, 3, 4, 5]


def test_empty_tables(make):
    empty = make([])
    assert anchors.substring_dedup(empty).count() == 0
    assert content_sort.exact_groups(empty).count() == 0
    assert content_sort.exact_dedup(empty).count() == 0
    assert ngram_join.ngram_classes(empty).count() == 0
