"""The pipeline against brute force, stage by stage, and the registration."""

from collections import defaultdict

from test_llm_dedup import brute_classes
from test_llm_text import brute_contamination, water

import __spark_entry__ as entry
import corpus_pipeline
from eventweave.llm.queries import ORACLES, QUERIES


def test_registered():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert set(ORACLES) <= set(entry.oracle_sql()) and corpus_pipeline.ORACLE_SQL is None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "mix"]


def test_pipeline_matches_brute_force(spark, make, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(120).collect()
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in source]
    long = max(source, key=lambda r: len(r.text)).text.split()
    near = list(long)
    near[len(near) // 2] = "changed"
    rows += [(1000, None, "en", "src0"), (1001, "", "en", "src0"), (1002, "123 456", None, None), (1003, rows[3][1], "en", "src1"),
             (1004, rows[3][1], "en", "src2"), (1005, " ".join(near), None, "src3"), (1006, " ".join(long), "en", None),
             (1007, rows[5][1] + " " + bench[7].text, "en", "src0")]
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench).write.parquet(str(tmp_path / "benchmark.parquet"))

    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != "mix":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{number}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{number}"))
        kept.append({r.doc_id: r for r in docs.collect()})

    texts = {r[0]: r[1] for r in rows}
    want = set(texts) - {1000, 1001, 1002}
    assert set(kept[0]) == want
    groups = defaultdict(list)
    for i in want:
        groups[texts[i]].append(i)
    want = {max(g) for g in groups.values()}
    assert set(kept[1]) == want
    want = {i for i, _, c in brute_classes([(i, texts[i]) for i in sorted(want)]) if i == c}
    assert set(kept[2]) == want
    items = [(b.item_id, b.text) for b in bench]
    want = {r[0] for r in brute_contamination([(i, texts[i]) for i in sorted(want)], items, 10) if not r[5]}
    assert set(kept[3]) == want and 1007 not in want
    size = defaultdict(int)
    source_of = {r[0]: r[3] for r in rows}
    for i in want:
        size[source_of[i]] += len(texts[i].split())
    target, taken = water(size), defaultdict(int)
    for r in docs.collect():
        assert r.doc_id in want and r.text == texts[r.doc_id] and 1 <= r.mix_copy <= 3
        taken[r.source] += len(r.text.split())
    # a source of few documents can miss by up to half of one
    largest = {s: max(len(texts[i].split()) for i in want if source_of[i] == s) for s in size}
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in size)
    assert docs.groupBy("doc_id", "mix_copy").count().filter("count > 1").isEmpty()
    whole = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "mix_copy", "mix_shard")
    assert sorted(whole.collect()) == sorted(docs.select("doc_id", "mix_copy", "mix_shard").collect())


def test_empty_corpus(spark, make, tmp_path):
    make([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_short_texts_are_not_dropped_for_lack_of_evidence(spark, make, monkeypatch):
    judged = [(1, "Re.", "en", 0.3), (2, "a text of more than twenty-four bytes", "en", 0.3), (3, "?!", "und", 0.0),
              (4, "a text of more than twenty-four bytes", "en", 0.6)]
    monkeypatch.setattr(corpus_pipeline.ppm, "fit", lambda docs, teach: None)
    monkeypatch.setattr(corpus_pipeline.ppm, "identify", lambda docs, model, **names: spark.createDataFrame(
        judged, "doc_id long, text string, _lang_pred string, _score double"))
    got = corpus_pipeline.language_id(spark, make([]).select("doc_id", "text"), "")
    assert sorted(r.doc_id for r in got.collect()) == [1, 4]


CLASHING = ["_id", "_score", "_lang_pred", "_sha", "_stay", "mix_copy", "mix_shard", "mix_position", "lang_pred", "score", "id", "at",
            "given", "stay", "sha", "row", "rep", "grp", "band", "component_id", "keep_id", "kept", "hash", "u", "r", "h", "of",
            "item_id", "_mx_block", "_mx_source", "_mx_d", "start", "content", "Doc", "a.b", "select"]


def test_extra_columns_pass_untouched(spark, make, tmp_path):
    """Every stage keeps columns of any name, with their values; the mix adds its own beside them."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()
    plain = [(r.doc_id, r.text, r.lang, r.source) for r in rows] + [(900, rows[3].text, "en", "s"), (900, rows[3].text, "en", "s")]
    docs = make(plain)
    for number, name in enumerate(CLASHING):
        docs = docs.withColumn(name, (docs["doc_id"] * 100 + number))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    make(plain).write.parquet(str(tmp_path / "plain" / "documents.parquet"))
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    for folder in (tmp_path, tmp_path / "plain"):
        bench.write.parquet(str(folder / "benchmark.parquet"))
    sides = {False: spark.read.parquet(str(tmp_path / "plain" / "documents.parquet")), True: spark.read.parquet(str(tmp_path / "documents.parquet"))}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for extra, df in sides.items():
            out = stage(spark, df, str(tmp_path))
            assert out.columns[:len(df.columns)] == df.columns
            assert name == "mix" or out.columns == df.columns
            out.write.parquet(str(tmp_path / f"{number}{extra}"))
            sides[extra] = spark.read.parquet(str(tmp_path / f"{number}{extra}"))
        got = sides[True].collect()
        assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in sides[False].collect()) and got
        for n, column in enumerate(CLASHING):
            assert all(r[column] == r.doc_id * 100 + n for r in got), (name, column)
    assert sides[True].columns[-3:] == ["mix_copy_", "mix_shard_", "mix_position_"]


def test_queries_ignore_other_columns(spark, make, tmp_path):
    """The queries on tables with such columns give what they give without."""
    names = [c for c in CLASHING if c not in ("item_id",)]
    for table in ("documents", "benchmark", "pages", "conversations"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet")
        for number, name in enumerate(names):
            df = df.withColumn(name, df[df.columns[0]] + number)
        df.write.parquet(str(tmp_path / f"{table}.parquet"))
    for name in ("op1_substring_dedup", "op2_exact_dedup", "op3_source_mixing", "op4_ngram_join", "op5_url_filters", "op6_warc",
                 "op7_benchmark_decontamination", "op9_chat_formatting", "op10_language_id", "op11_spelling_variants",
                 "op12_secret_scans", "op13_conversation_repair"):
        want = QUERIES[name](spark, "/root/testdata/sf0.001")
        got = QUERIES[name](spark, str(tmp_path))
        assert got.columns == want.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())), name
