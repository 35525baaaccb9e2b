"""Registered queries of this package, each with the equal SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (anchors, chat_format, chat_repair, content_sort, mixing, ngram_join, ppm, secrets,
               spelling_variants, suffix_arrays, token_counts, url_model, warc)
from .shared import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query("op1_substring_dedup", f"""
    WITH doc AS (SELECT doc_id, {_SPACED} AS w FROM documents),
      win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
        FROM (SELECT *, unnest(range(1, len(w) - 33)) AS i FROM doc WHERE len(w) >= 35)),
      again AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
      gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM again),
      kept AS (SELECT doc_id, w[p] AS word, p FROM (
        SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM doc) ANTI JOIN gone USING (doc_id, p)),
      text AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM kept GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM doc LEFT JOIN text USING (doc_id)""")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = anchors.substring_dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op2_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
      doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_groups(read(spark, sf_dir, "documents"))


_OP7_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op7_benchmark_decontamination", f"""
    WITH item AS (SELECT item_id, {_OP7_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
      win AS (SELECT DISTINCT item_id, least(10, len(w)) AS k,
          array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
        FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
      doc AS (SELECT doc_id, coalesce({_OP7_WORDS}, []) AS w FROM documents),
      size AS (SELECT DISTINCT k FROM win),
      dwin AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
        FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM doc, size WHERE len(w) >= k)),
      found AS (SELECT doc_id, i, k, item_id FROM dwin JOIN win USING (k, s)),
      hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
        SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
      items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (
        SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_arrays.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.limit_table(token_counts.length_histogram(read(spark, sf_dir, "documents")))


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = ppm.fit(docs, ~held_out)
    return ppm.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op9_chat_formatting", r"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
      UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(length(role) + length(regexp_replace(text, '(\\*)(###|</turn>)', '+\1\2', 'g')) + 15)::BIGINT
        AS formatted_chars
    FROM c GROUP BY conv_id""")
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.sql("SELECT -7L AS conv_id, 0L AS turn, 'user' AS role UNION ALL SELECT -7L, 1L, 'assistant'")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(
        extra.withColumn("text", F.lit(said)))
    return chat_format.read_back(chat_format.format_chats(rows))


@query("op3_source_mixing")
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(read(spark, sf_dir, "documents")).drop("draws")


@query("op4_ngram_join")
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_classes(read(spark, sf_dir, "documents"))


@query("op6_warc", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
      h AS (SELECT *, sha1(body) AS x, min(page_id) OVER (PARTITION BY body) AS first FROM p)
    SELECT page_id, octet_length(encode(body)) AS payload_bytes,
      list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST((('0x' || substr(x, (k // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31 AS BIGINT) + 1, 1)),
        'string_agg', '') AS payload_digest,
      CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> first THEN first END AS refers_to
    FROM h""")
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


@query("op5_url_filters")
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_model.judge(read(spark, sf_dir, "pages"))


def _crc32_sql(text: str) -> str:
    """The CRC-32 of a short text's UTF-8 bytes, bit by bit."""
    step = "list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b))"
    data = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({data}, lambda c, b: {step}, 4294967295::BIGINT), 4294967295)"


@query("op11_spelling_variants", f"""
    WITH RECURSIVE run AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
      seen AS (SELECT id, w, count(*) AS c, id || ':' || w AS k FROM run WHERE length(w) >= 6 GROUP BY ALL),
      hashed AS (SELECT w, c, {_crc32_sql("k")} AS h FROM seen),
      v AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM (SELECT c, CASE WHEN h % 199 = 0
          THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word FROM hashed)
        WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
      cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
        FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
      near AS (SELECT a.word, b.word AS x, b.n AS m FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word
        UNION SELECT a.word, v.word, v.n FROM cut a JOIN v ON v.word = a.rest
        UNION SELECT v.word, a.word, a.n FROM cut a JOIN v ON v.word = a.rest),
      best AS (SELECT word, count(*) AS n_near, first(x ORDER BY m DESC, x) AS x, max(m) AS m FROM near GROUP BY word),
      f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN x END AS form,
        CASE WHEN m >= 5 * n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
      up(word, top, depth) AS (SELECT word, word, 0 FROM f UNION ALL
        SELECT up.word, f.form, depth + 1 FROM up JOIN f ON f.word = up.top WHERE f.form IS NOT NULL)
    SELECT word, form, root, n, n_near, form_n
    FROM f JOIN (SELECT word, arg_max(top, depth) AS root FROM up GROUP BY word) USING (word)""")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(read(spark, sf_dir, "documents"))


@query("op12_secret_scans")
def op12_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents")))


_SPACE = r"\x20\x09-\x0D"
_OP13_DONE = "{'c': 0::BIGINT, 'a': '', 't': ''}"
_OP13_NONE = "{'c': 1000000000::BIGINT, 'a': '', 't': ''}"


def _op13_edit(cost: str, letter: str, line: str, rest: str) -> str:
    return f"{{'c': {rest}.c + {cost}, 'a': '{letter}' || {rest}.a, 't': {line} || {rest}.t}}"


def _op13_state(state: str, after: str, role: str, keeps: str) -> str:
    """The cheapest way on from a state, given the ways on (g) after row r."""
    line = lambda name: f"chr(10) || {name} || ':' || r.text"
    ways = [_op13_edit("2", "D", "''", f"g.{state}"),
            f"CASE WHEN r.f IN ('b', 'd') THEN {_OP13_NONE} ELSE "
            + _op13_edit("(1 + r.p)", "R", line(f"'{role}'"), f"g.{after}") + " END"]
    ways += [f"CASE WHEN r.i = '{i}' AND r.f NOT IN ('b', 'd') THEN "
             + _op13_edit("r.p", "K", line("r.role"), f"g.{to}") + f" ELSE {_OP13_NONE} END"
             for i, to in (k.split(">") for k in keeps.split())]
    return f"least({', '.join(ways)})"


def _op13_insert(state: str, after: str, role: str) -> str:
    return f"least(n.{state}, " + _op13_edit("5", "I", f"chr(10) || '{role}:'", f"n.{after}") + ")"


_OP13_STEP = ("{'st': %s, 's': %s, 'u': %s, 'a': %s}" % (
    _op13_state("st", "u", "user", "s>s u>u"), _op13_state("s", "u", "user", "u>u"),
    _op13_state("u", "a", "assistant", "a>a"), _op13_state("a", "u", "user", "u>u")))
_OP13_INSERTS = ("list_reduce(range(3), lambda n, k: {'st': %s, 's': %s, 'u': %s, 'a': %s}, %%s)" % (
    _op13_insert("st", "u", "user"), _op13_insert("s", "u", "user"),
    _op13_insert("u", "a", "assistant"), _op13_insert("a", "u", "user")))
_OP13_END = f"{{'st': {_OP13_DONE}, 's': {_OP13_NONE}, 'u': {_OP13_NONE}, 'a': {_OP13_DONE}}}"


@query("op13_conversation_repair", f"""
    WITH told AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
      hashed AS (SELECT *, {_crc32_sql("k")} % 20 AS h FROM told),
      damaged AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
          CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM hashed, (SELECT unnest([1, 2]) AS copy) WHERE h <> 0 AND (copy = 1 OR h = 3)),
      judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{_SPACE}]') THEN 'b'
          WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 THEN 'd'
          WHEN NOT regexp_matches(text, '[.!?][{_SPACE}]*$') THEN 't' ELSE '' END AS f,
          lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM damaged),
      chat AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
          count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
          count(*) FILTER (before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
          list({{'i': left(role, 1), 'role': role, 'text': text, 'f': f, 'p': CASE WHEN f = 't' THEN 5 ELSE 0 END}}
            ORDER BY turn DESC NULLS LAST, role DESC, text DESC, f = 'd' DESC) AS rows FROM judged GROUP BY conv_id),
      done AS (SELECT *, list_reduce(rows, lambda g, r: {_OP13_INSERTS % _OP13_STEP}, {_OP13_INSERTS % _OP13_END}).st AS best
        FROM chat)
    SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
      coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
      coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN done d ON c.conv_id IS NOT DISTINCT FROM d.conv_id""")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair_report(read(spark, sf_dir, "conversations"))
