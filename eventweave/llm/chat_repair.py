"""Repair of conversation structure at the least cost, decided by integer minima.

A sound conversation's role initials read (s?(ua)+)?. Edits make any conversation sound: Keep, Rerole
(to user or assistant), Delete, Insert (an empty text of user or assistant). Blank and repeated
rows must go; a truncated row may stay at a price.

The weight of an edit is one big integer: its cost in the high digits, and below them a row of
fixed-width digits, one per audit letter, of which the edit fills the one of its place
(D < I < K < R; 0 pads the end, so a shorter audit comes before its continuations). A node of the
graph is (rows taken, state of the grammar, letters inserted): it knows its place, so weights
simply add up, paths to a node have equally many letters, and the smaller integer is the cheaper path
or, at equal costs, the one with the smaller audit. Nothing else decides, and the edits are read
back from the digits of the winner.

Rows are coded by one character each (role, fault), and texts take no part until the end. Codes go
through the graph in blocks of at most `BLOCK` rows, each solved for every state it may be entered
in; a second graph of the same kind joins the blocks of a conversation, with the block's digits at
their place. So one conversation may hold any share of the rows: blocks are slices of a range sort, and
only its audit, a letter per row, comes together. Copies are found by aggregates over digests of
(role, text). Texts are shuffled once, by conversation, to be handed out in order.

Defined cases: a null conv_id is a conversation of its own; null role and text count as one space;
rows go by turn, null turns first, rows of one turn by the digest of role and text (equal rows are
interchangeable); an empty role fits nowhere; a conversation without rows is not listed by
`repair`; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import cut_lineage

BLOCK_BITS = 10
BLOCK = 1 << BLOCK_BITS


class Costs(NamedTuple):
    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5  # on top, for a truncated row that stays


# --- the graph -----------------------------------------------------------------------

_LETTERS = "\0DIKR"  # digit 0 is the padding; the digits keep the letters' order
_BITS = 3
_START, _AFTER_S, _AFTER_U, _AFTER_A = range(4)
_DONE = (_START, _AFTER_A)
_STEP = {("s", _START): _AFTER_S, ("u", _START): _AFTER_U, ("u", _AFTER_S): _AFTER_U,
         ("u", _AFTER_A): _AFTER_U, ("a", _AFTER_U): _AFTER_A}
#: The role that an inserted or reroled row takes in a state, and the state after it.
_NEXT = {state: (role, after) for (role, state), after in _STEP.items() if role != "s"}

# a row's code: its role's initial ("-" for roles that fit nowhere); upper case for a truncated row,
# "!" for a row that must go
GONE = "!"
Node = tuple[int, int]  # (state, letters inserted)


def _keep_cheapest(layer: dict[Node, int], shift: int) -> dict[Node, int]:
    """Costs only add up, so of a state's nodes only those of the least cost can win."""
    least: dict[int, int] = {}
    for (state, _), weight in layer.items():
        cost = weight >> shift
        least[state] = min(cost, least.get(state, cost))
    return {node: weight for node, weight in layer.items() if weight >> shift == least[node[0]]}


def _inserted(layer: dict[Node, int], row: int, places: int, costs: Costs) -> dict[Node, int]:
    """The layer with what inserts reach before the next row; three in a row pass every state."""
    shift, done, edge = _BITS * places, dict(layer), layer
    for _ in range(3):
        reached: dict[Node, int] = {}
        for (state, k), weight in edge.items():
            node = _NEXT[state][1], k + 1
            new = weight + (costs.insert << shift) + (_LETTERS.index("I") << _BITS * (places - 1 - row - k))
            if new < done.get(node, new + 1):
                reached[node] = done[node] = new
        edge = reached
    return _keep_cheapest(done, shift)


def _letters(weight: int, places: int, count: int) -> str:
    return "".join(_LETTERS[weight >> _BITS * (places - 1 - p) & 7] for p in range(count))


@lru_cache(maxsize=20_000)
def solve_block(codes: str, costs: Costs) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, letters) of the best edits of a block. Where edits of different lengths
    cost the same, one of each length, since their order depends on the letters that follow."""
    places = 4 * (len(codes) + 1)
    shift, found = _BITS * places, []
    for entered in range(4):
        layer: dict[Node, int] = _inserted({(entered, 0): 0}, 0, places, costs)
        for row, code in enumerate(codes):
            role, extra = code.lower(), costs.truncated * code.isupper()
            after: dict[Node, int] = {}
            for (state, k), weight in layer.items():
                arcs = [("D", state, costs.delete)]
                if code != GONE:
                    arcs.append(("R", _NEXT[state][1], costs.rerole + extra))
                    if (role, state) in _STEP:
                        arcs.append(("K", _STEP[role, state], costs.keep + extra))
                for letter, to, cost in arcs:
                    new = weight + (cost << shift) + (_LETTERS.index(letter) << _BITS * (places - 1 - row - k))
                    if new < after.get((to, k), new + 1):
                        after[to, k] = new
            layer = _inserted(_keep_cheapest(after, shift), row + 1, places, costs)
        found += [(entered, state, weight >> shift, _letters(weight, places, len(codes) + k))
                  for (state, k), weight in layer.items()]
    return found


def _digits(letters: str) -> int:
    value = 0
    for c in letters:
        value = value << _BITS | _LETTERS.index(c)
    return value


def join_blocks(blocks: list[list[tuple[int, int, int, str]]]) -> tuple[int, list[str]]:
    """(cost, letters per block) of the best path through solved blocks of one conversation."""
    if len(blocks) == 1:  # one block holds the whole graph
        _, cost, letters = min((_padded(c, s, blocks[0]), c, s) for i, o, c, s in blocks[0] if i == _START and o in _DONE)
        return cost, [letters]
    places = sum(max((len(s) for *_, s in b), default=0) for b in blocks)
    shift = _BITS * places
    layer: dict[tuple[int, int], tuple[int, tuple]] = {(_START, 0): (0, ())}
    for block in blocks:
        arcs = [(i, o, c << shift, _digits(s), s) for i, o, c, s in block]
        after: dict[tuple[int, int], tuple[int, tuple]] = {}
        for (state, taken), (weight, path) in layer.items():
            for before, to, cost, digits, letters in arcs:
                if before == state:
                    place = taken + len(letters)
                    new = weight + cost + (digits << _BITS * (places - place))
                    if (to, place) not in after or new < after[to, place][0]:
                        after[to, place] = new, (path, letters)
        cheap = _keep_cheapest({node: weight for node, (weight, _) in after.items()}, shift)
        layer = {node: after[node] for node in cheap}
    weight, path = min((found for (state, _), found in layer.items() if state in _DONE), key=lambda f: f[0])
    parts: list[str] = []
    while path:
        path, letters = path
        parts.append(letters)
    return weight >> shift, parts[::-1]


def _padded(cost: int, letters: str, block: list[tuple[int, int, int, str]]) -> int:
    places = max(len(s) for *_, s in block)
    return (cost << _BITS * places) + (_digits(letters) << _BITS * (places - len(letters)))


_NAMES = {"s": "system", "u": "user", "a": "assistant"}


def read_edits(parts: list[str], codes: list[str]) -> list[list[tuple[int, int, str]]]:
    """Per block (row, place among its inserts, role) of what stays: row is the index of a kept ("" as its role) or
    reroled row; for an inserted row it is the index of the row before it, -1 at the block's start."""
    state, put, out = _START, 0, []
    for letters, block in zip(parts, codes):
        row, stays = -1, []
        for letter in letters:
            if letter == "I":
                put += 1
            else:
                row, put = row + 1, 0
            if letter == "K":
                state = _STEP[block[row].lower(), state]
                stays.append((row, 0, ""))
            elif letter != "D":
                role, state = _NEXT[state]
                stays.append((row, put, _NAMES[role]))
        out.append(stays)
    return out


# --- rows ----------------------------------------------------------------------------

def damage(conversations: DataFrame) -> DataFrame:
    """Known faults by crc32("conv_id:turn") % 20 (nulls: one space): 0 drops the row, 1 empties its text, 2 takes its
    [.!?] away, 3 repeats it, 4 makes it the user's."""
    told = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"),
                                fault.alias("fault")).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(
        F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _digest(role: str, text: str) -> Column:
    """What equal rows of a conversation share; the role's length keeps the two parts apart."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), F.col(role), F.col(text)), 256))


def _given(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    space = F.lit(" ")
    return rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
                       F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"))


def _facts(given: DataFrame) -> DataFrame:
    """One short row per row, in order: pos rises with (conv_id, turn, digest). Written, so pos holds."""
    initial = F.substring("role", 1, 1)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fits = F.when(initial.isin("s", "u", "a"), initial).otherwise("-")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest"]
    facts = given.select("conv_id", "turn", fits.alias("initial"), blank.alias("blank"), cut.alias("cut"),
                         _digest("role", "text").alias("digest"))
    return cut_lineage(facts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "pos", F.monotonically_increasing_id()))


def _blocks(facts: DataFrame) -> DataFrame:
    """conv_id, block, rows: array<struct<pos, initial, fault, code, digest>> of at most BLOCK rows each."""
    copies = facts.groupBy("conv_id", "digest").agg(F.min("pos").alias("_first"), F.count("*").alias("_n")).filter(
        "_n > 1").select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "_first")
    marked = facts.join(copies, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left")
    fault = F.when(F.col("blank"), "b").when(F.col("pos") > F.col("_first"), "d").when(F.col("cut"), "t").otherwise("")
    marked = marked.withColumn("fault", fault)
    code = F.when(F.col("fault").isin("b", "d"), GONE).when(
        F.col("fault") == "t", F.when(F.col("initial") == "-", "T").otherwise(F.upper("initial"))).otherwise(F.col("initial"))
    return marked.groupBy("conv_id", F.shiftright("pos", BLOCK_BITS).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "initial", "fault", code.alias("code"), "digest"))).alias("rows"))


_SOLVED = "array<struct<i:int,o:int,cost:bigint,letters:string>>"


def _solve(blocks: DataFrame, costs: Costs) -> DataFrame:
    """conv_id, block, codes, solved: the first graph, block by block."""
    element = pa.struct([("i", pa.int32()), ("o", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            solved = [[dict(zip(("i", "o", "cost", "letters"), path)) for path in solve_block(c, costs)]
                      for c in batch.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(solved, pa.list_(element))],
                                             [*batch.schema.names, "solved"])

    coded = blocks.select("conv_id", "block", F.array_join("rows.code", "").alias("codes"))
    key = coded.schema["conv_id"].dataType.simpleString()
    return coded.mapInArrow(run, f"conv_id {key}, block bigint, codes string, solved {_SOLVED}")


def _join(solved: DataFrame) -> DataFrame:
    """conv_id, cost, audit, parts: array<struct<block, stays>>: the second graph, per conversation."""
    stay = pa.struct([("row", pa.int32()), ("put", pa.int32()), ("role", pa.string())])
    part = pa.struct([("block", pa.int64()), ("stays", pa.list_(stay))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blocks in batch.column("blocks").to_pylist():
                cost, letters = join_blocks([[tuple(p.values()) for p in b["solved"]] for b in blocks])
                stays = read_edits(letters, [b["codes"] for b in blocks])
                out.append((cost, "".join(letters), [
                    {"block": b["block"], "stays": [dict(zip(("row", "put", "role"), s)) for s in found]}
                    for b, found in zip(blocks, stays)]))
            cost, audit, parts = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(cost, pa.int64()), pa.array(audit, pa.string()),
                 pa.array(parts, pa.list_(part))], ["conv_id", "cost", "audit", "parts"])

    whole = solved.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("block", "codes", "solved"))).alias("blocks"))
    key = whole.schema["conv_id"].dataType.simpleString()
    return whole.mapInArrow(run, f"conv_id {key}, cost bigint, audit string, parts array<struct<block:bigint,"
                                 "stays:array<struct<row:int,put:int,role:string>>>>")


def _report(facts: DataFrame, blocks: DataFrame, joined: DataFrame) -> DataFrame:
    big = lambda c: c.cast("decimal(38,0)")
    turns = facts.groupBy("conv_id", "turn").agg(F.lit(1).alias("_one")).groupBy("conv_id").agg(
        F.coalesce((big(F.max("turn")) - big(F.min("turn")) + 1 - F.count("turn")).cast("long"), F.lit(0)).alias("gaps"))
    rows = F.col("rows")
    faults = lambda kind: F.sum(F.size(F.filter(
        rows["fault"], lambda f: f == kind)).cast("long"))
    # neighbours inside a block, then the last and first rows of neighbouring blocks
    pairs = F.zip_with(F.slice(rows["initial"], F.lit(1), F.size(rows) - 1), F.slice(rows["initial"], F.lit(2), F.size(rows)),
                       lambda a, b: F.concat(a, b))
    bad = lambda pair: ~pair.isin("su", "ua", "au")
    inner = blocks.select("conv_id", "rows", F.size(F.filter(pairs, bad)).cast("long").alias("_bad"), F.struct(
        "block", F.element_at(rows["initial"], 1).alias("first"), F.element_at(rows["initial"], -1).alias("last")).alias("_ends"))
    counts = inner.groupBy("conv_id").agg(
        faults("b").alias("blank"), faults("d").alias("duplicate"), faults("t").alias("truncated"),
        F.sum("_bad").alias("_bad"), F.array_sort(F.collect_list("_ends")).alias("_ends"))
    ends = F.col("_ends")
    borders = F.zip_with(F.slice(ends["last"], F.lit(1), F.size(ends) - 1), F.slice(ends["first"], F.lit(2), F.size(ends)),
                         lambda a, b: F.concat(a, b))
    counts = counts.select("conv_id", "blank", "duplicate", "truncated",
                           (F.col("_bad") + F.size(F.filter(borders, bad))).alias("illegal"))
    both = joined.select("conv_id", "cost", "audit")
    for part in (turns, counts):
        other = part.withColumnRenamed("conv_id", "_conv")
        both = both.join(other, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return both.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _turns(given: DataFrame, blocks: DataFrame, joined: DataFrame) -> DataFrame:
    """conv_id, pos, put, role, text of what stays or was inserted; each conversation lies in one partition, in order."""
    parts = joined.select("conv_id", F.inline("parts")).select(
        F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), "stays")
    met = parts.join(blocks, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")))
    at = lambda s: F.get(F.col("rows"), s["row"])
    made = F.transform("stays", lambda s: F.struct(
        F.coalesce(at(s)["pos"], F.get(F.col("rows"), F.lit(0))["pos"] - 1).alias("pos"), s["put"].alias("put"),
        s["role"].alias("role"), F.when(s["put"] == 0, at(s)["digest"]).alias("digest")))
    acts = met.select("conv_id", F.inline(made))
    # an inserted row meets no text: its key is its own place
    acts = acts.select("conv_id", F.coalesce("digest", F.concat_ws(":", "pos", "put").cast("binary")).alias("digest"),
                       F.struct("pos", "put", "role").alias("act"), F.lit(None).cast("struct<role:string,text:string>").alias("said"))
    texts = given.select("conv_id", _digest("role", "text").alias("digest"),
                         F.lit(None).cast(acts.schema["act"].dataType).alias("act"), F.struct("role", "text").alias("said"))
    # what stays is unlike anything else in its conversation, so a digest has one act at most
    together = texts.unionAll(acts).repartition("conv_id").groupBy("conv_id", "digest").agg(
        F.max("act").alias("act"), F.max("said").alias("said")).filter("act IS NOT NULL")
    return together.select(
        "conv_id", "act.pos", "act.put",
        F.when(F.col("act.role") == "", F.col("said.role")).otherwise(F.col("act.role")).alias("role"),
        F.coalesce("said.text", F.lit("")).alias("text")).sortWithinPartitions("conv_id", "pos", "put")


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", *,
           costs: Costs = Costs()) -> tuple[DataFrame, DataFrame]:
    """(report, turns). report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, a row per conversation.
    turns: conv_id, pos, put, role, text of the repaired conversations, ordered by (pos, put)."""
    if costs.insert <= 0 or min(costs) < 0:
        raise ValueError("costs are not negative, inserts cost something")
    given = _given(rows, conv_id, turn, role, text)
    facts = _facts(given)
    blocks = cut_lineage(_blocks(facts))
    joined = cut_lineage(_join(_solve(blocks, costs)))
    return _report(facts, blocks, joined), _turns(given, blocks, joined)


def turn_digests(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the repaired turns as "role:text" lines, hashed as they stream by."""
    key = turns.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        current, state = None, None
        for batch in batches:
            ids, digests = [], []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if state is None or conv != current:
                    if state is not None:
                        ids.append(current)
                        digests.append(state.hexdigest())
                    current, state = conv, hashlib.sha256()
                    line = f"{role}:{text}"
                else:
                    line = f"\n{role}:{text}"
                state.update(line.encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, to_arrow_type(key)), pa.array(digests, pa.string())],
                                             ["conv_id", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], to_arrow_type(key)), pa.array([state.hexdigest()])],
                                             ["conv_id", "repaired_sha256"])

    return turns.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {key.simpleString()}, repaired_sha256 string")


def repair_report(conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row per conversation of the table before damage(): what was found, the edits, a digest of the repaired turns."""
    report, turns = repair(damage(conversations), costs=costs)
    out = conversations.select("conv_id").distinct()
    for part in (report, turn_digests(turns)):
        other = part.withColumnRenamed("conv_id", "_conv")
        out = out.join(other, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in numbers],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
