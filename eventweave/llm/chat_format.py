"""Chat formatting with a grammar that reads its own output back. Column expressions only.

    turn := "### " role ":\\n" body "\\n</turn>\\n"

`###` and `</turn>` are control strings: bare, they are structure. The parser refuses a body that
holds a bare one and takes one backslash off in front of the others (after more backslashes, if
any). A turn is rendered as it is, reparsed and compared with its source; if they differ its
content is escaped (one more backslash before each control string and its backslashes) and the
comparison is made again; a turn that would still differ raises. Role names are URL-encoded, so
they hold neither ":" nor a line break.

The result has one row per conversation, so a conversation is gathered in one row, whatever its
length; sizes are those of one formatted training example. Offsets and order come from one window
on the same key, so there is one shuffle.

Defined cases: null text and null role count as empty, turns are ordered by (turn, role, text),
null turns first, repeated turns stay, a null conv_id is a conversation of its own, only the role
"assistant" is under the loss mask, an empty table gives no rows, other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

CLOSE = "\n</turn>\n"
_CONTROL = r"(#{3,}|</turn>)"  # a run of hashes is one control string
_BARE = r"(?<![\\#])#{3,}|(?<!\\)</turn>"
_HEAD = r"^### ([^:\n]*):\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\*)" + _CONTROL, r"\\$1$2")


def unescape(body: Column) -> Column:
    return F.regexp_replace(body, r"\\(\\*)" + _CONTROL, "$1$2")


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit("### "), F.url_encode(role), F.lit(":\n"), body, F.lit(CLOSE))


def head_bytes(role: Column) -> Column:
    return F.octet_length(F.url_encode(role)) + 6


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted text; a turn that breaks the grammar is null."""
    parts = F.split(formatted, CLOSE, -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(p: Column) -> Column:
        body = F.regexp_replace(p, _HEAD, "")
        good = p.rlike(_HEAD) & ~body.rlike(_BARE)
        return F.when(good, F.struct(F.url_decode(F.regexp_extract(p, _HEAD, 1)).alias("role"),
                                     unescape(body).alias("text")))

    return F.transform(parts, turn)


def _reads_back(formatted: Column, role: Column, text: Column) -> Column:
    """Whether the parser finds exactly this one turn."""
    turns = parse(formatted)
    return F.coalesce((F.size(turns) == 1) & (turns[0]["role"] == role) & (turns[0]["text"] == text), F.lit(False))


def format_chats(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, loss: array<struct<start, bytes>>, byte spans of the assistant bodies."""
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    plain, safe = render(F.col("role"), F.col("text")), render(F.col("role"), escape(F.col("text")))
    # only texts that hold a control string can fail the first comparison
    rows = rows.withColumn("out", F.when(
        ~F.col("text").rlike(_CONTROL) | _reads_back(plain, F.col("role"), F.col("text")), plain)
        .when(_reads_back(safe, F.col("role"), F.col("text")), safe)
        .otherwise(F.raise_error(F.lit("a turn cannot be read back"))))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    size = F.octet_length("out")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn(
        "start", F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size)
    span = F.when(F.col("role") == "assistant", F.struct(
        (F.col("start") + head_bytes(F.col("role"))).alias("start"),
        (size - head_bytes(F.col("role")) - len(CLOSE)).cast("long").alias("bytes")))
    turns = F.array_sort(F.collect_list(F.struct("n", "out", span.alias("span"))))
    return rows.groupBy("conv_id").agg(turns.alias("turns")).select(
        "conv_id", F.array_join(F.col("turns.out"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss"))


def loss_text(formatted: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask."""
    data = formatted.cast("binary")
    return F.array_join(F.transform(loss, lambda s: unescape(
        F.substring(data, (s["start"] + 1).cast("int"), s["bytes"].cast("int")).cast("string"))), "")


def read_back(formatted: DataFrame) -> DataFrame:
    """What a reader finds in the output: turns and loss text, with digests."""
    found = formatted.withColumn("turns", parse(F.col("formatted"))).withColumn(
        "lost", loss_text(F.col("formatted"), F.col("loss")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
