"""Sentences, figures and content words as row-local array expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import policy
from . import words
from .text import collapse, listing

_BOUNDARY = "(?<=[.!?]) (?=[\"“‘'A-Z0-9])"


def sentences(text: Column, max_chars: int = policy.MAX_SENTENCE_CHARS,
              min_words: int = policy.MIN_SENTENCE_WORDS) -> Column:
    """Complete sentences in order; fragments, short and long ones are left out."""
    return F.filter(
        F.split(collapse(text), _BOUNDARY),
        lambda s: F.regexp_replace(s, "[\"”’']+$", "").rlike("[.!?]$")
        & (F.size(F.split(s, " ")) >= min_words)
        & (F.length(s) <= max_chars),
    )


def figures(text: Column) -> Column:
    """Sorted distinct numbers, thousands commas removed."""
    found = F.regexp_extract_all(text, F.lit("\\p{Nd}+(?:[.,]\\p{Nd}+)*"), 0)
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")))))


def content_words(text: Column) -> Column:
    """Distinct runs of three or more ASCII letters that carry meaning."""
    stop = listing(words.SENTENCE_STOPWORDS)
    return F.array_except(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), 0), stop)


def same_point(left_words: Column, right_words: Column) -> Column:
    """Two shared content words, and half of the shorter set."""
    shared = F.size(F.array_intersect(left_words, right_words))
    smaller = F.greatest(F.least(F.size(left_words), F.size(right_words)), F.lit(1))
    return (shared >= 2) & (shared * 2 >= smaller)
