"""Text expressions. Built-in Spark functions carry ASCII and Latin-1 letters;
only rows with other characters pass through an Arrow UDF for the Unicode forms
Spark has no function for (NFKC, full case folding, accent stripping)."""

from __future__ import annotations

import re
import unicodedata
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from . import words

# Whitespace as Unicode defines it; Java's \s is ASCII only.
SPACE = (
    "\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a"
    "\\u2028\\u2029\\u202f\\u205f\\u3000"
)
# Typographic signs that NFKC and folding leave alone (but for the ellipsis, see `nfkc`).
TYPOGRAPHIC = "¡¢£¤¥¦§©«¬®°±¶·»¿‐‒–—―‘’‚‛“”„‟†‡•…‰′‹›€"
# Characters whose NFKC form is themselves and whose folding is `lower` (but for ß).
PLAIN = "\\x00-\\x7F\\u00C0-\\u00FF" + TYPOGRAPHIC
_UNUSUAL = f"[\\x{{80}}-\\x{{10FFFF}}&&[^\\u00C0-\\u00FF{TYPOGRAPHIC}]]"
# A run to replace: anything but one plain space.
_RUN = f"[{SPACE.replace('\\x1c-\\x20', '\\x1c-\\x1f')}][{SPACE}]*| [{SPACE}]+"
LETTER = "[\\p{L}\\p{Nl}\\p{No}]"


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """`body` applied to `value`, which is computed once even if `body` names it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@F.pandas_udf(T.StringType())
def _nfkc_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def _casefold_udf(s: pd.Series) -> pd.Series:
    return s.map(str.casefold, na_action="ignore")


@F.pandas_udf(T.StringType())
def _name_udf(s: pd.Series) -> pd.Series:
    def fold(v: str) -> str:
        v = unicodedata.normalize("NFKC", v).casefold()
        return " ".join(
            "".join(" " if unicodedata.category(c)[0] in "PS" else c for c in v).split()
        )

    return s.map(fold, na_action="ignore")


@F.pandas_udf(T.StringType())
def _folded_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFKC", v).casefold(), na_action="ignore")


@F.pandas_udf(T.StringType())
def _unaccent_udf(s: pd.Series) -> pd.Series:
    def strip(v: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c))

    return s.map(strip, na_action="ignore")


def _unusual(value: Column) -> Column:
    # `[^PLAIN]`, written so that ASCII is settled by one comparison and not by each of the signs
    return value.rlike(_UNUSUAL)


def _branch(value: Column, native: Column, udf) -> Column:
    """Native for plain rows; the others alone are shipped to Python (plain rows as NULL)."""
    return F.when(_unusual(value), udf(F.when(_unusual(value), value))).otherwise(native)


def exploded(df: DataFrame, keep: list, array: Column, name: str) -> DataFrame:
    """One row per element. For a plain explode Spark adds a filter on the array's size, which
    computes a costly array twice, and below any repartition; the outer form has none."""
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def posexploded(df: DataFrame, keep: list, array: Column, pos: str, name: str) -> DataFrame:
    return df.select(*keep, F.posexplode_outer(array).alias(pos, name)).filter(F.col(name).isNotNull())


def counted(items: Column) -> Column:
    """array<struct<item, n>>: the different items of an array and how often each occurs, by one sort."""
    def runs(s):
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda p, k: F.struct(
            F.get(s, p).alias("item"), (F.coalesce(F.get(at, k + 1), F.size(s)) - p).cast("long").alias("n"))))

    return let(F.array_sort(items), lambda s: F.when(F.size(s) > 0, runs(s)))


def listing(items: list[str]) -> Column:
    """A constant array of words (folded once by the optimizer)."""
    return F.split(F.lit(" ".join(items)), " ")


def strip(value: Column | str) -> Column:
    return F.regexp_replace(_c(value), f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse(value: Column | str) -> Column:
    """Runs of whitespace to one space, ends trimmed; NULL stays NULL."""
    return F.trim(F.regexp_replace(_c(value), _RUN, " "))


def nfkc(value: Column | str) -> Column:
    value = _c(value)
    return _branch(value, F.replace(value, F.lit("…"), F.lit("...")), _nfkc_udf)


def casefold(value: Column | str) -> Column:
    value = _c(value)
    return _branch(value, F.replace(F.lower(value), F.lit("ß"), F.lit("ss")), _casefold_udf)


def folded(value: Column | str) -> Column:
    """NFKC, then case folding: what `normalize_name` is before signs become spaces. Long texts cost far less."""
    value = _c(value)
    native = F.replace(F.replace(F.lower(value), F.lit("ß"), F.lit("ss")), F.lit("…"), F.lit("..."))
    return _branch(value, native, _folded_udf)


def clean_text(value: Column | str) -> Column:
    """NFKC and whitespace collapse; NULL becomes ''."""
    return collapse(nfkc(F.coalesce(_c(value), F.lit(""))))


def language_key(value: Column | str) -> Column:
    """Primary subtag, folded: en, en-GB and EN agree."""
    return F.lower(F.substring_index(F.trim(_c(value)), "-", 1))


# Punctuation and symbols among the plain characters.
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~×÷" + TYPOGRAPHIC


def normalize_name(value: Column | str) -> Column:
    """Folded name with punctuation and symbols as spaces."""
    value = _c(value)
    folded = F.replace(F.lower(value), F.lit("ß"), F.lit("ss"))
    native = collapse(F.translate(folded, _SIGNS, " " * len(_SIGNS)))
    return _branch(value, native, _name_udf)


_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_BARE = "aaaaaaceeeeiiiinooooouuuuyy"


def slugify(value: Column | str) -> Column:
    """Folded, accent-free ASCII runs joined by hyphens."""
    name = normalize_name(value)
    bare = _branch(name, F.translate(name, _ACCENTED, _BARE), _unaccent_udf)
    # characters outside ASCII vanish before runs are cut
    ascii_only = F.regexp_replace(bare, "[^\\x00-\\x7F]", "")
    return F.regexp_replace(F.regexp_replace(ascii_only, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def first_chars(value: Column | str, n: int | None) -> Column:
    value = _c(value)
    return value if n is None else F.substring(value, 1, n)


# --- HTML ------------------------------------------------------------------------


_HIDDEN = frozenset(words.HTML_SUPPRESSED)
_BLOCKS = frozenset(words.HTML_BLOCKS)
# Their content is no markup; it ends at the closing tag of the name.
_RAW = {name: re.compile(rf"</\s*{name}\s*>", re.I) for name in ("script", "style")}
# A start tag. Quotes delimit a value right after its "=" only, there they may hold ">"; elsewhere they are
# ordinary characters. Every part is possessive, so a tag is read once, whether it ends or not.
_START_TAG = re.compile(r"""
    <(?P<name>[a-z][^\t\n\r\f\ />\x00]*+)
    (?: (?:\s|/(?!>))++
      | (?<=["'\s/])[^\s/>][^\s/=>]*+ (?:\s*+ (?:
          =++\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^>\s]*+)
        | =++(?=\s) | ==++[^>\s]*+ ))?+  # a quote that is never closed
      )*+
    (?P<void>/?+)>""", re.X | re.I)
_END_NAME = re.compile(r"\s*([a-z][-.a-z0-9:_]*)\s*\Z|([a-z][^\t\n\r\f />\x00]*)", re.I)
_SECTION = re.compile(r"(temp|cdata|ignore|include|rcdata)|(if|else|endif)", re.I)


class _Hidden:
    """The open elements inside a hidden one, counted by name; closing one closes those inside it."""

    def __init__(self):
        self.order, self.places = [], {}

    def __bool__(self) -> bool:
        return bool(self.order)

    def opened(self, name: str) -> None:
        self.places.setdefault(name, []).append(len(self.order))
        self.order.append(name)

    def closed(self, name: str) -> None:
        if self.places.get(name):
            keep = self.places[name][-1]
            while len(self.order) > keep:
                self.places[self.order.pop()].pop()


class _Reader:
    """One pass over markup. `at` only moves on, and no search that failed is made again."""

    def __init__(self, html: str):
        self.html, self.at, self.shown, self.hidden = html, 0, [], _Hidden()
        self.last_end = html.rfind(">")  # behind it nothing can be a tag
        self.missing: set[str] = set()  # closing signs that do not come any more

    def text(self) -> str:
        while self.at < len(self.html):
            sign = self.html.find("<", self.at)
            if not 0 <= sign < self.last_end:
                self.say(len(self.html))
                break
            self.say(sign)
            if not self.markup():
                self.say(self.html.find(">", sign + 1) + 1)  # broken markup is text
        return "".join(self.shown)

    def say(self, end: int) -> None:
        if not self.hidden:
            self.shown.append(unescape(self.html[self.at:end]))
        self.at = end

    def skip_to(self, sign: str, start: int) -> bool:
        """Go on behind the next `sign`, if there is one."""
        found = -1 if sign in self.missing else self.html.find(sign, start)
        if found < 0:
            self.missing.add(sign)
            return False
        self.at = found + len(sign)
        return True

    def skip_match(self, sign: re.Pattern, start: int) -> bool:
        found = None if sign.pattern in self.missing else sign.search(self.html, start)
        if found is None:
            self.missing.add(sign.pattern)
            return False
        self.at = found.end()
        return True

    def markup(self) -> bool:
        """Read what starts with the "<" at `at`; False if it is broken."""
        html, at = self.html, self.at
        kind = html[at + 1:at + 2]
        if kind.isascii() and kind.isalpha():
            return self.start_tag()
        if kind == "/":
            return self.end_tag()
        if kind == "?":
            return self.skip_to(">", at + 2)
        if html.startswith("<!--", at):
            return self.skip_match(_COMMENT_END, at + 4)
        if html.startswith("<![", at):
            section = _SECTION.match(html, at + 3)
            if section:
                return self.skip_match(_SECTION_END if section[1] else _CONDITION_END, at + 3)
        if kind == "!":
            return self.skip_to(">", at + 2)
        self.say(at + 1)
        return True

    def start_tag(self) -> bool:
        tag = _START_TAG.match(self.html, self.at)
        if tag is None:
            return False
        self.at, name = tag.end(), tag["name"].lower()
        if tag["void"]:
            self.line_break(name)
        else:
            if self.hidden or name in _HIDDEN:
                self.hidden.opened(name)
            else:
                self.line_break(name)
            end = _RAW.get(name)
            if end:
                rest = end.search(self.html, self.at)
                if not self.hidden:
                    self.shown.append(self.html[self.at:rest.start() if rest else self.at])
                self.at = rest.start() if rest else len(self.html)
        return True

    def line_break(self, name: str) -> None:
        if not self.hidden and (name in _BLOCKS or name == "br"):
            self.shown.append("\n")

    def end_tag(self) -> bool:
        start = self.at
        if not self.skip_to(">", start + 2):
            return False
        found = _END_NAME.match(self.html[start + 2:self.at - 1])
        if found:
            name = (found[1] or found[2]).lower()
            if self.hidden:
                self.hidden.closed(name)
            elif name in _BLOCKS:
                self.shown.append("\n")
        return True


_COMMENT_END = re.compile(r"--\s*>")
_SECTION_END = re.compile(r"]\s*]\s*>")
_CONDITION_END = re.compile(r"]\s*>")


def readable_text(html: str | None) -> str:
    """Visible text of markup: hidden elements are left out, block tags break lines. Linear in its length."""
    tidy = (" ".join(line.split()) for line in _Reader(html or "").text().splitlines())
    return "\n".join(filter(None, tidy))


@F.pandas_udf(T.StringType())
def _html_udf(s: pd.Series) -> pd.Series:
    return s.map(readable_text, na_action="ignore")


def html_text(value: Column | str) -> Column:
    """Readable text of markup. Values without '<' or '&' need no parser and stay in the JVM."""
    value = F.coalesce(_c(value), F.lit(""))
    markup = value.rlike("[<&\\x00]")
    lines = F.transform(F.split(value, "\r\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"),
                        lambda line: collapse(line))
    plain = F.array_join(F.filter(lines, lambda line: line != ""), "\n")
    return F.when(markup, _html_udf(F.when(markup, value))).otherwise(plain)


# --- hashes ----------------------------------------------------------------------


def fingerprint_input(title, body, description) -> Column:
    """Folded title, newline, collapsed body (or description when the body is empty)."""
    title, body, description = (F.coalesce(_c(v), F.lit("")) for v in (title, body, description))
    content = F.when(body != "", body).otherwise(description)
    return F.concat(casefold(nfkc(title)), F.lit("\n"), collapse(content))


def content_fingerprint(title, body, description) -> Column:
    return F.sha2(fingerprint_input(title, body, description), 256)


def payload_json(payload: Column) -> Column:
    """JSON text of a struct; the caller lists fields in sorted order, NULLs are kept."""
    return F.to_json(payload, {"ignoreNullFields": "false"})


def payload_hash(payload: Column) -> Column:
    return F.sha2(payload_json(payload), 256)


def embedding_input(title, description, body, max_chars: int | None) -> Column:
    """Title, description, body; collapsed, blanks left out, cut, right-trimmed."""
    parts = F.array(*[collapse(F.coalesce(_c(v), F.lit(""))) for v in (title, description, body)])
    joined = F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")
    return F.regexp_replace(first_chars(joined, max_chars), f"[{SPACE}]+$", "")


# --- times -----------------------------------------------------------------------

_ZONED = (
    "^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}(:\\d{2}([.,]\\d{1,9})?)?"
    "(Z|[+-]\\d{2}:?\\d{2}(:?\\d{2})?)$"
)


def extended_iso(text: Column) -> Column:
    """ISO basic times (20240101T000000Z) in the extended form, with seconds."""
    dated = F.regexp_replace(text, "^(\\d{4})(\\d{2})(\\d{2})(?=[T ])", "$1-$2-$3")
    timed = F.regexp_replace(dated, "(?<=[T ])(\\d{2})(\\d{2})(?=\\d{2}|[Z+-]|$)", "$1:$2")
    full = F.regexp_replace(timed, "(?<=[T ]\\d{2}:\\d{2})(\\d{2})(?=[.,Z+-]|$)", ":$1")
    return F.regexp_replace(full, "(?<=[T ]\\d{2}:\\d{2})(?=Z|[+-])", ":00")


def parse_zoned(value: Column | str) -> Column:
    """ISO timestamp with an explicit zone as an instant; anything else is NULL."""
    text = extended_iso(strip(value))
    iso = F.regexp_replace(F.regexp_replace(text, ",", "."), "([+-]\\d{2})(\\d{2})$", "$1:$2")
    return F.when(text.rlike(_ZONED), F.try_to_timestamp(iso))


def event_time(published="published_at", first_seen="first_seen_at") -> Column:
    return F.coalesce(_c(published), _c(first_seen))


def byline(authors: Column | str, max_chars: int = 512) -> Column:
    """Nonblank cleaned author names joined by ', '. Each author is cleaned as one joined
    string, since a UDF cannot run inside a lambda."""
    sep = "\u0001"
    joined = nfkc(F.coalesce(F.array_join(_c(authors), sep), F.lit("")))
    names = F.transform(F.split(joined, sep), lambda a: collapse(a))
    return F.substring(F.array_join(F.filter(names, lambda a: a != ""), ", "), 1, max_chars)


def article_language(item_language, source_language) -> Column:
    item = clean_text(item_language)
    return F.substring(
        F.lower(F.when(item != "", item).otherwise(clean_text(source_language))), 1, 16
    )
