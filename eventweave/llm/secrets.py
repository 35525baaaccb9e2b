"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class.

Patterns (leftmost matches of each kind that do not overlap; matches that fail their length are
dropped): `assign`, a password-like name given a value; `access`, an access key id; `hex`, a run
of hex digits. Spans are those of whole matches, in code points, the end exclusive.

Entropy adds the kind `entropy`. Candidates are maximal runs of token characters. Inside one, a
window slides over each stretch of every character class (`CLASSES`); counts of its characters
are kept up by one entering and one leaving, and with them the sum of c*log2(c) as an integer
(units of 2^-20 bit), so window entropy is exact and the same everywhere. A window of `size`
characters is hot when its entropy log2(size) - sum/size reaches the class's bound and it holds
enough digits and letters; hot windows that touch become one span.

Suppressed are: spans inside a pattern's match (reported already), candidates that are listed in
`allow` (strings known to be harmless) or match `ALLOWED` (UUIDs, alphabets, placeholders), and
candidates that are part of an address (`://` before them in the same word).

Every row is scanned on its own in its Arrow batch, so nothing is shuffled or gathered. Defined
cases: a null text counts as empty and has no spans, repeated rows and null ids come out as they
are, an empty table gives no rows, other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("assign", "access", "hex", "entropy")  # the order among spans that start together
_VALUE, _ACCESS, _HEX = 12, 18, 16


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = re.compile(rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# these runs are maximal, so their least length can stand in the pattern
_ACCESS_KEY = re.compile(rf"AKIA[A-Z0-9]{{{_ACCESS - 4},}}")
_HEX_RUN = re.compile(rf"[0-9a-f]{{{_HEX},}}")


class CharClass(NamedTuple):
    """Windows of `size` characters of `chars` are hot from `bits` of entropy on."""

    chars: str
    size: int
    bits: float


_DIGITS = "0123456789"
_SMALL = "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharClass(_DIGITS + "ABCDEF", 20, 3.2),
    CharClass(_DIGITS + _SMALL, 20, 3.7),
    CharClass(_DIGITS + _SMALL.upper(), 20, 3.7),
    CharClass(_DIGITS + _SMALL + _SMALL.upper() + "+/_-=", 20, 3.9),
)
MIN_DIGITS = 2
MIN_LETTERS = 2
#: Harmless shapes of whole candidates.
ALLOWED = re.compile(
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|.*(0123456789|1234567890|abcdefghij|ABCDEFGHIJ).*"
    r"|(?i:.*(example|sample|dummy|placeholder|changeme|xxxxx).*)", re.S)
_UNIT = 1 << 20
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % min(c.size for c in CLASSES))
_BREAK = re.compile(r"[\x20\x09-\x0D]|://")


class _Window:
    """Steps of the sum of c*log2(c), in units, when a count goes from c to c + 1, and the largest
    sum at which a window is still hot."""

    def __init__(self, rule: CharClass):
        self.rule, self.members = rule, frozenset(rule.chars)
        whole = [0, 0] + [round(c * math.log2(c) * _UNIT) for c in range(2, rule.size + 1)]
        self.step = [b - a for a, b in zip(whole, whole[1:])]
        self.most = math.floor(rule.size * (math.log2(rule.size) - rule.bits) * _UNIT)

    def hot(self, run: str) -> Iterator[tuple[int, int]]:
        """Spans of the hot windows of a run of this class, touching ones joined."""
        size, step, counts = self.rule.size, self.step, dict.fromkeys(self.rule.chars, 0)
        total = digits = 0
        begin = end = -1
        for i, c in enumerate(run):
            if i >= size:
                old = run[i - size]
                counts[old] -= 1
                total -= step[counts[old]]
                digits -= old in _DIGITS
            total += step[counts[c]]
            counts[c] += 1
            digits += c in _DIGITS
            if i + 1 >= size and total <= self.most and MIN_DIGITS <= digits <= size - MIN_LETTERS:
                if i + 1 - size > end:
                    if begin >= 0:
                        yield begin, end
                    begin = i + 1 - size
                end = i + 1
        if begin >= 0:
            yield begin, end

    def stretches(self, candidate: str) -> Iterator[tuple[int, int]]:
        """Hot spans over the candidate's maximal stretches of this class."""
        start, size = 0, self.rule.size
        for i, c in enumerate(candidate):
            if c not in self.members:
                if i - start >= size:
                    yield from ((start + a, start + b) for a, b in self.hot(candidate[start:i]))
                start = i + 1
        if len(candidate) - start >= size:
            yield from ((start + a, start + b) for a, b in self.hot(candidate[start:]))


_WINDOWS = tuple(_Window(rule) for rule in CLASSES)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns, by start, then kind as listed."""
    found = [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= _VALUE]
    found += [(*m.span(), "access") for m in _ACCESS_KEY.finditer(text)]
    found += [(*m.span(), "hex") for m in _HEX_RUN.finditer(text)]
    return in_order(found)


def in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans; touching ones become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def entropy_spans(text: str, base: list[tuple[int, int, str]], allow: frozenset[str] = frozenset()
                  ) -> list[tuple[int, int, str]]:
    """(start, end, "entropy") of hot windows that nothing suppresses."""
    out, covered, at = [], joined((a, b) for a, b, _ in base), 0
    looked, address = 0, False  # where the search for word breaks stands, whether `://` came since the last one
    for m in _CANDIDATE.finditer(text):
        run, begin = m.group(), m.start()
        hot = joined(span for w in _WINDOWS for span in w.stretches(run))
        if not hot or run in allow or ALLOWED.fullmatch(run):
            continue
        for mark in _BREAK.finditer(text, looked, begin + 2):
            address = mark.group() == "://"
        looked = begin
        if address:
            continue
        for a, b in ((begin + a, begin + b) for a, b in hot):
            while at < len(covered) and covered[at][1] < b:
                at += 1
            if at == len(covered) or covered[at][0] > a:
                out.append((a, b, "entropy"))
    return out


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, allow: Iterable[str] = ()) -> DataFrame:
    """doc_id, spans: array<struct<kind, start, end>> by start, then kind as listed in KINDS."""
    known = frozenset(allow)
    element = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def batch_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                t = value.as_py() or ""
                base = base_spans(t)
                rows.append([{"kind": k, "start": a, "end": b}
                             for a, b, k in in_order(base + entropy_spans(t, base, known))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows, pa.list_(element))], ["doc_id", "spans"])

    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(batch_spans, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, a count per pattern, base_sha256 and all spans as text, from scan()."""
    def listing(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), count("entropy"),
                        F.sha2(listing(base), 256).alias("base_sha256"), listing(F.col("spans")).alias("spans"))
