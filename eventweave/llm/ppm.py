"""Language ID by prediction by partial matching.

Per language a byte context tree of orders 0 to `order` is counted over a bounded sample of
labelled rows. Frozen, it gives each byte an exact code length: the longest context that has been
seen predicts the byte if it has followed it, with n(context, byte) / (n + d), or escapes with
d / (n + d) to the next shorter context (n followers, d distinct ones), down to a uniform code
over the 256 bytes. The language with the shortest code for the whole text wins.

The trees of all languages are flattened into one table (context, next byte) -> bits per language,
so a byte costs two lookups. Bytes that no sample has share one symbol. The table goes to the
tasks as a broadcast; the sample (`per_language` ids, their texts whole) bounds it, and so does
`MODEL_BYTES`: where many languages would make it larger, the order is lowered.

Defined cases: null texts and texts without a letter are `und` with score 0; languages that tie go
to the first by code point; with no labelled row everything is `und`; null labels never teach;
repeated rows are judged each on its own; other columns pass through untouched. The score is the
posterior of the winner under equal priors, with the code lengths scaled to `EVIDENCE` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .shared import free_name
from .words import cuts, release, utf8_buffer

ORDER = 3
PER_LANGUAGE = 400
EVIDENCE = 24
CHUNK = 1 << 20
PARTS = (64, 8, 1)  # each divides the one before
MODEL_BYTES = 256 << 20  # trees whose table would be larger are cut to a lower order


@dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray   # byte -> symbol, 0 for bytes that no sample has
    state: np.ndarray    # packed last `order` symbols -> context number
    bits: np.ndarray     # (context * symbols + symbol, language) -> code length
    n_symbols: int
    order: int


def sampled(docs: DataFrame, doc_id: str, text: str, label: str, teach: Column,
            per_language: int = PER_LANGUAGE) -> DataFrame:
    """lang, text of at most `per_language` labelled rows of each language: those whose ids have the
    smallest hashes. Ranked are (language, id) pairs, within fewer and fewer parts of each language (`PARTS`), so that
    a language with nearly all rows is many tasks and the last one gets little; texts are read for the
    picked ids."""
    given = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"),
                        F.when(teach, F.col(label)).alias("lang"))
    rows = given.filter(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "id")
    h = F.xxhash64("id")
    near = rows.withColumn("u", F.shiftrightunsigned(h, 11))
    for parts in PARTS:
        # repeats of an id share a dense rank; Spark drops what is behind the limit before it shuffles
        inside = Window.partitionBy("lang", F.pmod(F.xxhash64("id"), F.lit(parts))).orderBy("u", "id")
        near = near.withColumn("r", F.dense_rank().over(inside)).filter(F.col("r") <= per_language).select("lang", "id", "u")
        near = near.distinct() if parts == PARTS[0] else near
    picked = near.select(F.col("lang").alias("of"), F.col("id").alias("at"))
    return given.join(F.broadcast(picked), F.col("id").eqNullSafe(F.col("at")) & (F.col("lang") == F.col("of"))
                      ).select("lang", "text")


def _pieces(data: np.ndarray, offsets: np.ndarray, rows: list[int], order: int) -> Iterator[list[list[np.ndarray]]]:
    """Per about CHUNK bytes of these rows the k-byte strings of k = 1 to order + 1. A string counts
    where it ends, so long rows are taken piece by piece and whole."""
    parts, held = [[] for _ in range(order + 1)], 0
    for r in rows:
        first, end = int(offsets[r]), int(offsets[r + 1])
        for low in range(first, end, CHUNK):
            back, high = max(low - order, first), min(low + CHUNK, end)
            b = data[back:high].astype(np.int64)
            gram = np.zeros(len(b), np.int64)
            for k in range(1, order + 2):
                if len(b) < k:
                    break
                gram = (gram[:len(b) - k + 1] << 8) | b[k - 1:]
                parts[k - 1].append(gram[max(low - back - k + 1, 0):])
            held += high - low
            if held >= CHUNK:
                yield parts
                parts, held = [[] for _ in range(order + 1)], 0
    if held:
        yield parts


def _gram_counts(order: int):
    """rows (lang, text) of one task -> (lang, k, gram, n): counts of k-byte strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            data, offsets = utf8_buffer(batch.column("text"))
            for lang in sorted(set(langs)):
                rows = [i for i, x in enumerate(langs) if x == lang]
                for parts in _pieces(data, offsets, rows, order):
                    for k, found in enumerate(parts, 1):
                        if found:
                            gram, n = np.unique(np.concatenate(found), return_counts=True)
                            yield pa.RecordBatch.from_arrays([
                                pa.array([lang] * len(gram), pa.string()), pa.array(np.full(len(gram), k), pa.int64()),
                                pa.array(gram), pa.array(n.astype(np.int64))], ["lang", "k", "gram", "n"])

    return run


def learn(sample: DataFrame, order: int = ORDER) -> Model | None:
    """The flattened trees; the counts are as large as the bounded sample at most."""
    counts = sample.mapInArrow(_gram_counts(order), "lang string, k long, gram long, n long").groupBy(
        "lang", "k", "gram").agg(F.sum("n").alias("n")).toArrow()
    while order > 1 and table_bytes(counts, order) > MODEL_BYTES:
        order -= 1
    return build(counts, order) if len(counts) else None


def table_bytes(counts: pa.Table, order: int) -> int:
    """Size of the table of that order: contexts x symbols x languages."""
    k, gram = counts.column("k").to_numpy(), counts.column("gram").to_numpy()
    contexts = 1 + sum(len(np.unique(gram[k == length])) for length in range(1, order + 1))
    return 4 * contexts * (len(np.unique(gram[k == 1])) + 1) * len(pc.unique(counts.column("lang")))


def build(counts: pa.Table, order: int) -> Model:
    """The model from rows (lang, k, gram, n)."""
    names = counts.column("lang").combine_chunks().dictionary_encode()
    lang_of, k_of = names.indices.to_numpy(), counts.column("k").to_numpy()
    gram_of, n_of = counts.column("gram").to_numpy(), counts.column("n").to_numpy()
    known = names.dictionary.to_pylist()
    languages = sorted(known)
    one = np.unique(gram_of[k_of == 1])
    symbol = np.zeros(256, np.int64)
    symbol[one] = np.arange(1, len(one) + 1)
    size = len(one) + 1
    # contexts of `order` bytes that any language has; others fall back to their last bytes
    state = np.zeros(size ** order, np.int32)
    contexts: list[tuple[int, int]] = [(0, 0)]  # (length, packed symbols)
    packed = {k: [] for k in range(1, order + 2)}
    table = {}
    for lang in languages:
        for k in range(1, order + 2):
            rows = (lang_of == known.index(lang)) & (k_of == k)
            gram = gram_of[rows]
            code = np.zeros(len(gram), np.int64)
            for j in range(k):
                code = code * size + symbol[(gram >> (8 * (k - 1 - j))) & 255]
            table[lang, k] = (code, n_of[rows].astype(np.float64))
            packed[k].append(code)
    for length in range(1, order + 1):  # longer contexts overwrite the shorter ones they end with
        found = np.unique(np.concatenate(packed[length]))
        numbers = np.arange(len(contexts), len(contexts) + len(found), dtype=np.int32)
        contexts += [(length, int(c)) for c in found]
        view = state.reshape(-1, size ** length)
        view[:, found] = numbers
    bits = np.empty((len(contexts) * size, len(languages)), np.float32)
    lengths = np.array([c[0] for c in contexts])
    codes = np.array([c[1] for c in contexts])
    for column, lang in enumerate(languages):
        # p[context, symbol], from the shortest contexts to the longest
        cost = np.full((len(contexts), size), 8.0)
        for length in range(order + 1):
            here = np.flatnonzero(lengths == length)
            base = codes[here]
            if length:  # start from the cost in the context without its first symbol
                shorter = base % size ** (length - 1)
                low = np.flatnonzero(lengths == length - 1)
                spot = np.searchsorted(codes[low], shorter)
                back = low[np.minimum(spot, len(low) - 1)]
                # a suffix of a seen context has been seen, unless a text begins with it
                cost[here] = np.where((codes[back] == shorter)[:, None], cost[back], 8.0)
            code, n = table[lang, length + 1]
            owner = np.searchsorted(base, code // size)
            total = np.bincount(owner, n, len(here))
            kinds = np.bincount(owner, None, len(here)).astype(np.float64)
            seen = total > 0
            escape = np.zeros(len(here))
            escape[seen] = np.log2((total[seen] + kinds[seen]) / kinds[seen])
            cost[here] += escape[:, None]
            cost[here[owner], code % size] = np.log2((total[owner] + kinds[owner]) / n)
        bits[:, column] = cost.reshape(-1)
    return Model(languages, symbol, state, bits, size, order)


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, languages): bits of every whole row."""
    out = np.zeros((len(offsets) - 1, len(model.languages)))
    for low in range(0, len(data), CHUNK):
        high = min(low + CHUNK, len(data))
        back = max(low - model.order, 0)
        s = model.symbol[data[back:high]]
        n, lead = high - low, low - back
        last = np.zeros(n, np.int64)  # packed symbols before each byte; 0 before the start of a row
        row = np.searchsorted(offsets, np.arange(low, high), "right") - 1
        since = np.arange(low, high) - offsets[row]
        for k in range(model.order, 0, -1):
            shifted = np.zeros(n, np.int64)
            src = np.arange(lead - k, lead - k + n)
            good = src >= 0
            shifted[good] = s[src[good]]
            shifted[since < k] = 0
            last = last * model.n_symbols + shifted
        cell = model.state[last].astype(np.int64) * model.n_symbols + s[lead:]
        begin = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
        cost = model.bits[cell]
        for column in range(cost.shape[1]):
            out[row[begin], column] += np.add.reduceat(cost[:, column], begin, dtype=np.float64)
    return out


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the best language, its score) per row."""
    bits = code_lengths(model, data, offsets)
    n = np.maximum(np.diff(offsets), 1)[:, None]
    best = bits.argmin(1)
    gap = (bits - bits.min(1, keepdims=True)) / n * np.minimum(n, EVIDENCE)
    return best, 1 / np.exp2(-np.minimum(gap, 1000)).sum(1)


def predict_batch(model: Model | None, column: pa.Array) -> tuple[pa.Array, pa.Array]:
    letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    lang = np.full(len(column), "und", object)
    score = np.zeros(len(column))
    if model is not None and letters.any():
        data, offsets = utf8_buffer(column)
        names = np.array(model.languages, object)
        for low, high in cuts(offsets):
            best, value = scores(model, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
            lang[low:high], score[low:high] = names[best], value
        lang[~letters], score[~letters] = "und", 0.0
    return pa.array(lang, pa.string()), pa.array(score)


def fit(docs: DataFrame, teach: Column, doc_id: str = "doc_id", text: str = "text", label: str = "lang",
        order: int = ORDER, per_language: int = PER_LANGUAGE) -> Model | None:
    return learn(sampled(docs, doc_id, text, label, teach, per_language), order)


def identify(docs: DataFrame, model: Model | None, text: str = "text", lang_pred: str = "lang_pred",
             score: str = "score") -> DataFrame:
    """`docs` with two more columns; a narrow pass, no shuffle. Where `docs` has a column of such a name, the new
    one gets underscores after its name."""
    names = [*docs.columns, free_name(docs, lang_pred), free_name(docs, score)]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # inside, columns go by number: Spark's Arrow functions take no names with dots
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            lang, value = predict_batch(shared.value, batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, lang, value], inner)
            release()

    inner = [*plain.columns, "lang", "score"]
    schema = T.StructType([*plain.schema.fields, T.StructField("lang", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    return plain.mapInArrow(run, schema).toDF(*names)
