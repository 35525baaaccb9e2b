"""Proper names found from capitalisation, as row-local array expressions (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import words
from .text import LETTER, SPACE, let, listing

_BREAK = f"(?<=[.!?:;])[{SPACE}]+|\\n+"
_WORD = f"{LETTER}+(?:['’-]{LETTER}+)*"


def _in(value: Column, items: list[str]) -> Column:
    return F.array_contains(listing(items), value)


def _folded(value: Column) -> Column:
    # inside lambdas no UDF may run; the caller folds unusual rows beforehand
    return F.replace(F.lower(F.regexp_replace(value, "['’]s$", "")), F.lit("ß"), F.lit("ss"))


def _occurrences(text: Column) -> Column:
    """array<struct<term, cap, mid>> for each word, with sentence position."""
    per_sentence = F.transform(
        F.split(text, _BREAK),
        lambda s: F.transform(
            F.regexp_extract_all(s, F.lit(_WORD), 0),
            lambda w, i: F.struct(
                _folded(w).alias("term"), w.rlike("^\\p{IsUppercase}").alias("cap"),
                (i > 0).alias("mid"),
            ),
        ),
    )
    return F.flatten(per_sentence)


def anchors(title: Column, text: Column) -> Column:
    """struct<capitalized: array<string>, strong: array<string>> of one report.

    A term counts if it is capitalised wherever it occurs; it is strong if it also
    occurs capitalised inside a sentence of the text.
    """
    both = F.struct(_occurrences(F.coalesce(title, F.lit(""))).alias("a"),
                    _occurrences(F.coalesce(text, F.lit(""))).alias("b"))
    return let(both, lambda o: _anchor_sets(F.concat(o["a"], o["b"]), o["b"]))


def _anchor_sets(occ: Column, occ_text: Column) -> Column:
    terms = lambda xs, keep: F.array_distinct(
        F.transform(F.filter(xs, keep), lambda o: o["term"])
    )
    excluded = listing(words.ANCHOR_FUNCTION_WORDS + words.CALENDAR)
    always = F.array_except(
        F.array_except(terms(occ, lambda o: o["cap"] & (F.length(o["term"]) > 1)),
                       terms(occ, lambda o: ~o["cap"])),
        excluded,
    )
    mid = terms(occ_text, lambda o: o["cap"] & o["mid"])
    return let(always, lambda names: F.struct(
        names.alias("capitalized"), F.array_intersect(names, mid).alias("strong")))


def shared_anchor_count(strong, capitalized, member_strong, member_capitalized) -> Column:
    """Names strong on one side and capitalised on the other."""
    return F.size(
        F.array_union(
            F.array_intersect(strong, member_capitalized),
            F.array_intersect(member_strong, capitalized),
        )
    )


# --- entities --------------------------------------------------------------------

_CAP = "[A-Z][\\p{L}\\p{N}_'’-]*"
_CONNECTOR = "(?:" + "|".join(words.NAME_CONNECTORS) + ")"
PHRASE = f"{_CAP}(?:[{SPACE}]+(?:{_CONNECTOR}[{SPACE}]+)?{_CAP})*"
SENTENCE_START = "_SENTENCE_START"


def entity_mentions(text: Column) -> Column:
    """array<struct<kind, name>> of every capitalised phrase in one text.

    The phrases are fenced with control characters so that each piece still carries
    the text before it, which tells whether it opens a sentence.
    """
    fenced = F.split(F.regexp_replace(text, PHRASE, "\u0001$0\u0002"), "\u0001")
    return let(fenced, _classify)


def _classify(pieces: Column) -> Column:
    raw = F.transform(
        F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p, i: F.struct(
            F.split(F.substring_index(p, "\u0002", 1), f"[{SPACE}]+").alias("w"),
            F.right(F.substring_index(F.element_at(pieces, i + 1), "\u0002", -1), F.lit(8)).alias("b"),
        ),
    )

    def trimmed(x):
        lead = F.array_position(
            F.transform(x["w"], lambda w: ~_in(F.lower(w), words.LEADING_WORDS)), F.lit(True)
        ).cast("int")
        before = F.regexp_replace(x["b"], "[ \\t]+$", "")
        rest = F.when(lead == 0, F.slice(x["w"], 1, 0)).otherwise(
            F.slice(x["w"], F.greatest(lead, F.lit(1)), F.size(x["w"]))
        )
        return F.struct(
            rest.alias("w"),
            ((lead <= 1) & ((before == "") | before.rlike("[.!?\\n]$"))).alias("start"),
        )

    def titled(x):
        is_title = (F.size(x["w"]) > 0) & F.coalesce(
            _in(F.lower(F.get(x["w"], F.lit(0))), words.PERSON_TITLES), F.lit(False)
        )
        w = F.when(is_title, F.slice(x["w"], 2, F.size(x["w"]))).otherwise(x["w"])
        return F.struct(
            F.filter(w, lambda v: ~_in(F.lower(v), words.CALENDAR)).alias("w"),
            x["start"].alias("start"), is_title.alias("titled"),
        )

    def named(x):
        last, n = F.lower(F.element_at(x["w"], -1)), F.size(x["w"])
        kind = (
            F.when((n == 1) & ~x["titled"] & x["start"], SENTENCE_START)
            .when(_in(last, words.ORGANIZATION_WORDS), "ORGANIZATION")
            .when(_in(last, words.PLACE_WORDS), "PLACE")
            .when(x["titled"] | n.between(2, 3), "PERSON")
            .otherwise("OTHER")
        )
        return F.struct(kind.alias("kind"), F.array_join(x["w"], " ").alias("name"))

    stages = F.filter(F.transform(F.transform(raw, trimmed), titled), lambda x: F.size(x["w"]) > 0)
    return F.transform(stages, named)
