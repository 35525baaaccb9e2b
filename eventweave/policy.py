"""Named bounds. Every operator takes them as parameters; these are the defaults.

Fixed values: they must equal the published policy for results to agree.
"""

from __future__ import annotations

from dataclasses import dataclass

MAX_TITLE_CHARS = 512
MAX_BYLINE_CHARS = 512
MAX_BODY_CHARS = 200_000
MAX_LANGUAGE_CHARS = 16
MIN_FINGERPRINT_CHARS = 200

RUN_ITEM_LIMIT = 500
PAYLOAD_BYTES = 256 * 1024
PAYLOAD_FIELD_CHARS = 4096
RAW_LIST_ITEMS = 8
RAW_TEXT_CHARS = 256

EMBEDDING_CHARS = 2000
EMBEDDING_BATCH = 32
MAX_DIMENSION = 2000

CANDIDATE_LIMIT = 10
CANDIDATE_DISTANCE = 0.5
CANDIDATE_WINDOW_HOURS = 168
EVIDENCE_CANDIDATES = 5

STORY_INPUT_ARTICLES = 20
STORY_INPUT_CHARS = 4000
MAX_TOPICS = 8
MAX_ENTITIES = 20
MAX_ELEMENTS = 20
MAX_ELEMENT_CHARS = 1000
MAX_SUMMARY = 3
MAX_CONTEXT = 4
MAX_SENTENCE_CHARS = 400
MIN_SENTENCE_WORDS = 4

STALE_RUNNING_SECONDS = 180
RUN_RETENTION_DAYS = 30
RECONCILE_AFTER_SECONDS = 600
RECONCILE_BATCH = 200
MAX_ATTEMPTS = 6
PENDING_LIMIT = 1000

EVIDENCE_BYTES = 4096

IMPRESSION_BATCH = 20
IMPRESSION_MAX_AGE_SECONDS = 24 * 3600
IMPRESSION_AHEAD_SECONDS = 300
IMPRESSION_MAX_POSITION = 100_000
IMPRESSION_SURFACE = "HOME_FEED"
IMPRESSION_POLICY = 1
IMPRESSION_RETENTION_DAYS = 30

EXPOSURE_SHARE = 0.5
EXPOSURE_DWELL_MS = 1000

HASH_DIMENSION = 64
HASH_MODEL_KEY = "deterministic:sha256-token-hash@1"


@dataclass(frozen=True)
class MatchPolicy:
    """Thresholds of the article-to-story decision; all are part of the key."""

    max_distance: float = 0.18
    max_time_gap_hours: float = 48.0
    secondary_max_distance: float = 0.25
    secondary_max_member_distance: float = 0.22
    min_anchors: int = 1
    max_members: int = 20

    def __post_init__(self) -> None:
        problems = []
        if not 0 < self.max_distance <= 2:
            problems.append("max_distance outside (0, 2]")
        if self.max_time_gap_hours <= 0:
            problems.append("max_time_gap_hours not positive")
        if not self.max_distance < self.secondary_max_distance <= 2:
            problems.append("secondary_max_distance not in (max_distance, 2]")
        if not 0 < self.secondary_max_member_distance <= self.secondary_max_distance:
            problems.append("secondary_max_member_distance not in (0, secondary_max_distance]")
        if self.min_anchors < 1 or self.max_members < 1:
            problems.append("counts must be positive")
        if problems:
            raise ValueError("; ".join(problems))

    @property
    def matcher_key(self) -> str:
        floats = ("max_distance", "max_time_gap_hours", "secondary_max_distance",
                  "secondary_max_member_distance")
        parts = [f"{n}={float(getattr(self, n))!r}" for n in floats]
        parts += [f"{n}={int(getattr(self, n))}" for n in ("min_anchors", "max_members")]
        return "story-match-v3;" + ";".join(parts)


DEFAULT_POLICY = MatchPolicy()


def model_key(provider: str, model: str, revision: str) -> str:
    return f"{provider}:{model}@{revision}"


def pipeline_key(embedding_key: str, matcher_key: str) -> str:
    return f"{embedding_key}|{matcher_key}"
