"""Spelling variants of one word, grouped under their commonest form, by asymmetric q-chunks.

Words are maximal letter runs of whole texts with A-Z lower-cased. A run whose hash with its
document is divisible by `divisor` loses one code point (a planted typing error; None turns
that off). The vocabulary holds the words of enough code points and occurrences.

Two words are near when one insertion, deletion or replacement of a code point turns one into
the other. Of two words the longer one (of equally long ones each) gives two disjoint chunks of
half its length, the other one all positional grams of that size. One edit lies in at most one
chunk; the first chunk stays where it is, the second moves by the difference of the lengths, which is
at most one. So every near pair shares a key (chunk word's length, position, gram), an equi
join that Spark splits where a gram is frequent. Candidates are verified by their edit distance
inside the join, and a pair met through both chunks is counted once.

A word's form is its near word with the most occurrences (ties: the smallest in code-point order),
if it has `ratio` times the word's own. Along forms the occurrences grow by that factor, so
chains are logarithmic in the largest count and the roots take a handful of pointer jumps.

Defined cases: null texts have no words, a null id counts as empty text in the hash, repeated rows
count each, an empty table gives no rows, other columns are not read. No word is dropped or
capped; texts are read whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import exploded
from .shared import cut_lineage

MIN_CHARS, MIN_COUNT, RATIO, DIVISOR = 6, 5, 5, 199
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def mistyped(doc_id: Column, word: Column, divisor: int) -> Column:
    """The word, less one code point where `divisor` divides crc32("<doc_id>:<word>")."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    rest = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(h % divisor == 0, rest).otherwise(word)


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, min_chars: int = MIN_CHARS,
               min_count: int = MIN_COUNT, divisor: int | None = DIVISOR) -> DataFrame:
    """word, n: occurrences over all documents. Shorter runs cannot become long enough."""
    runs = F.regexp_extract_all(F.translate(F.col(text), _UPPER, _LOWER),
                                F.lit(f"[a-zÀ-ÿ]{{{min_chars},}}"), F.lit(0))
    words = exploded(docs, [F.col(doc_id).alias("doc_id")], runs, "run")
    word = F.col("run") if divisor is None else mistyped(F.col("doc_id"), F.col("run"), divisor)
    return (words.select(word.alias("word")).filter(F.length("word") >= min_chars)
            .groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count))


def _half(size: Column) -> Column:
    return F.floor(size / 2).cast("int")


def chunks(words: DataFrame) -> DataFrame:
    """(size, start, gram) keys of the two disjoint chunks of each word, at the places they can take
    in a word as long (size = length) and in one shorter by one."""
    size = F.length("word")
    half = _half(size)
    first, second = F.substring(F.col("word"), F.lit(1), half), F.substring(F.col("word"), half + 1, half)
    place = lambda other, start, gram: F.struct(
        size.alias("size"), other.alias("other"), start.cast("int").alias("start"), gram.alias("gram"))
    keys = F.array(place(size, F.lit(0), first), place(size, half, second),
                   place(size - 1, F.lit(0), first), place(size - 1, half - 1, second))
    return words.select(F.col("word").alias("long_word"), F.col("n").alias("long_n"), F.inline(keys))


def grams(words: DataFrame) -> DataFrame:
    """All positional grams of each word, of the chunk sizes of words as long and longer by one."""
    def of(size: Column) -> Column:
        half = _half(size)
        return F.transform(F.sequence(F.lit(0), F.length("word") - half), lambda p: F.struct(
            size.alias("size"), F.length("word").alias("other"), p.cast("int").alias("start"),
            F.substring(F.col("word"), p + 1, half).alias("gram")))

    keys = F.concat(of(F.length("word")), of(F.length("word") + 1))
    return words.select(F.col("word").alias("short_word"), F.col("n").alias("short_n"), F.inline(keys))


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near, near_n: every ordered pair of words one edit apart, from words(word, n)."""
    met = chunks(words).join(grams(words), ["size", "other", "start", "gram"]).filter(
        ((F.col("size") > F.col("other")) | (F.col("long_word") < F.col("short_word")))
        & (F.levenshtein("long_word", "short_word", 1) == 1))
    pairs = met.select("long_word", "long_n", "short_word", "short_n").distinct()
    turned = pairs.select(F.col("short_word").alias("word"), F.col("long_word").alias("near"), F.col("long_n").alias("near_n"))
    return pairs.select(F.col("long_word").alias("word"), F.col("short_word").alias("near"),
                        F.col("short_n").alias("near_n")).unionAll(turned)


def _roots(forms: DataFrame, jumps: int) -> DataFrame:
    """word, root of forms(word, form), by pointer jumping."""
    ups = forms.select("word", F.col("form").alias("root"))
    for _ in range(jumps):
        above = ups.select(F.col("word").alias("root"), F.col("root").alias("_above"))
        ups = cut_lineage(ups.join(above, "root", "left").select(
            "word", F.coalesce("_above", "root").alias("root")))
    return ups


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of words(word, n), a written table."""
    best = near_pairs(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    judged = words.join(best, "word", "left").withColumn(
        "_formed", -F.col("best.less") >= ratio * F.col("n")).select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("_formed"), F.col("best.near")).alias("form"),
        F.when(F.col("_formed"), -F.col("best.less")).alias("form_n"))
    judged = cut_lineage(judged)
    low, high = words.agg(F.min("n"), F.max("n")).first()
    hops = int(math.log(high / low, ratio)) + 1 if low else 1
    roots = _roots(judged.filter("form IS NOT NULL").select("word", "form"), math.ceil(math.log2(hops + 1)))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, min_chars: int = MIN_CHARS,
                      min_count: int = MIN_COUNT, ratio: int = RATIO, divisor: int | None = DIVISOR) -> DataFrame:
    """The vocabulary of `docs` with the form and the root of every word."""
    if min_chars < 3 or ratio < 2:
        raise ValueError("chunks need words of at least 3 code points, chains a ratio of at least 2")
    words = vocabulary(docs, doc_id, text, min_chars=min_chars, min_count=min_count, divisor=divisor)
    return group_variants(cut_lineage(words), ratio)
