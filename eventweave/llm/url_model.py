"""URL filters: host and path rules, and a character language-model ratio for what no rule decides.
Column expressions only.

Rules label the URLs they fit. From all labelled URLs but one fold, two smoothed variable-order
Markov models are counted, one of the accepted and one of the rejected ones: a character is
predicted by the two before it, backed off to one, none and a uniform distribution with
Witten-Bell weights. Their difference is one table over character triples, ALPHABET ** 3 = 262,144
rows at most, whatever the input, which is why it may be broadcast. A URL's score is the mean
difference per character; the threshold is calibrated on the fold that was left out, as the value
that keeps the mean of both error rates lowest (in steps of 1/64; 0 without labelled URLs on both
sides). A URL without characters scores 0.

Counts of triples are combined before the shuffle; so are the scores, per row.

Defined cases: a null URL or one without "://" has empty host and path, fits no rule and is scored
as it is (null: as empty); of rules of one length the one listed last wins; repeated rows are
judged each on its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import exploded, let
from .shared import cut_lineage

#: Fixed values: (verdict, host, path) of the registered query.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = _LOWER + "0123456789" + "-._~:/?#[]@!$&'()*+,;=%"
START = 62  # before the first character; 0 is any other character
ALPHABET = 64
STEPS = 64


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def apply_rules(host: Column, path: Column, rules: list) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, f"{h}{p}").otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def triples(url: Column) -> Column:
    """Codes (a * 64 + b) * 64 + c of each character c and the two before it."""
    letters = F.filter(F.split(F.translate(url, _UPPER, _LOWER), ""), lambda c: c != "")
    codes = F.transform(letters, lambda c: F.call_function("locate", c, F.lit(LETTERS)))
    padded = F.concat(F.array(F.lit(START), F.lit(START)), codes)
    return let(padded, lambda p: F.transform(
        F.slice(p, F.lit(3), F.size(p)), lambda c, i: (F.get(p, i) * ALPHABET + F.get(p, i + 1)) * ALPHABET + c))


def _order(counts: DataFrame, size: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Witten-Bell terms of order `size`: n(context, c) per gram; n(context), d(context)."""
    width = ALPHABET ** (size + 1)
    grams = counts.groupBy("accepted", F.pmod("triple", F.lit(width)).alias("g")).agg(F.sum("n").alias("n"))
    ctx = grams.groupBy("accepted", F.floor(F.col("g") / ALPHABET).alias("c")).agg(
        F.sum("n").alias("cn"), F.count("*").alias("cd"))
    return grams.select(
        "accepted", F.col("g").alias(f"g{name}"), F.col("n").alias(f"n{name}")), ctx.select(
        "accepted", F.col("c").alias(f"c{name}"), F.col("cn").alias(f"t{name}"), F.col("cd").alias(f"d{name}"))


def difference_table(labelled: DataFrame) -> DataFrame:
    """triple, gain = ln P(accepted) - ln P(rejected) of every triple of symbols.

    `labelled` has accepted (boolean) and triple, one row per character."""
    spark = labelled.sparkSession
    counts = labelled.groupBy("accepted", "triple").agg(F.count("*").alias("n"))
    cells = spark.range(ALPHABET ** 3).select(
        F.col("id").alias("triple"), F.explode(F.array(F.lit(True), F.lit(False))).alias("accepted"))
    p = F.lit(1.0 / ALPHABET)
    for size in (0, 1, 2):
        grams, contexts = _order(counts, size, str(size))
        gram = F.pmod(F.col("triple"), F.lit(ALPHABET ** (size + 1)))
        cells = cells.withColumn(f"g{size}", gram).withColumn(f"c{size}", F.floor(gram / ALPHABET)).join(
            grams, ["accepted", f"g{size}"], "left").join(contexts, ["accepted", f"c{size}"], "left")
        n, t, d = (F.coalesce(f"{x}{size}", F.lit(0)) for x in "ntd")
        p = F.when(t > 0, (n + d * p) / (t + d)).otherwise(p)
    return cells.withColumn("p", F.ln(p)).groupBy("triple").agg(
        (F.max(F.when(F.col("accepted"), F.col("p"))) - F.max(F.when(~F.col("accepted"), F.col("p")))).alias("gain"))


def scored(rows: DataFrame, table: DataFrame, url: str, name: str) -> DataFrame:
    """`rows` (one row per value of their columns) with the mean gain per character of `url`."""
    keep = rows.columns
    chars = rows.select(*keep, F.explode_outer(triples(F.coalesce(F.col(url), F.lit("")))).alias("triple"))
    found = chars.join(F.broadcast(table), "triple", "left")
    return found.groupBy(*keep).agg(F.coalesce(F.avg("gain"), F.lit(0.0)).alias(name))


def threshold(judged: DataFrame) -> float:
    """The score from which URLs are accepted, from rows with accepted and score."""
    w = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    # at most 16 * STEPS + 1 steps
    step = F.floor(F.greatest(F.least("score", F.lit(8.0)), F.lit(-8.0)) * STEPS)
    h = judged.groupBy(step.alias("step")).agg(F.count_if("accepted").alias("good"), F.count_if(~F.col("accepted")).alias("bad"))
    lost, wrong = F.coalesce(F.sum("good").over(w), F.lit(0)), F.sum("bad").over(every) - F.coalesce(F.sum("bad").over(w), F.lit(0))
    error = F.try_divide(lost, F.sum("good").over(every)) + F.try_divide(wrong, F.sum("bad").over(every))
    best = h.withColumn("error", error).filter("error IS NOT NULL").orderBy("error", F.abs("step"), "step").first()
    return 0.0 if best is None else best["step"] / STEPS


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: list = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (null where a rule decides)."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(page_id).alias("page_id"),
                        F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    rule, said = apply_rules(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("said", said)
    labelled = rows.filter(F.col("said").isNotNull()).withColumn("accepted", F.col("said") == "allow")
    apart = F.crc32("url") % 4 == 2
    table = difference_table(exploded(labelled.filter(~apart), ["accepted"], triples(F.col("url")), "triple"))
    table = cut_lineage(table)
    limit = threshold(scored(labelled.filter(apart).select("row", "accepted", "url"), table, "url", "score"))
    free = scored(rows.filter(F.col("said").isNull()), table, "url", "score").withColumn(
        "said", F.when(F.col("score") >= limit, "allow").otherwise("block"))
    ruled = rows.filter(F.col("said").isNotNull()).withColumn("score", F.lit(None).cast("double"))
    return ruled.unionByName(free).select("page_id", "host", "path", "rule", F.col("said").alias("verdict"), "score")
