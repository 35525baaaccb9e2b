"""Registered queries over the given tables."""

from . import reader_queries, story_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
