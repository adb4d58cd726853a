"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to ORDER bytes holds symbol counts. A symbol that a context has not
seen costs that context's escape and is left to the context that is one byte shorter, at last to equal odds. The
statistics are frozen after training, so the exact cost of each symbol in each context can be laid out as a table,
and a text's code length in each language is a sum of table rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from .memory import tidy
from .scratch import cut, small

UNKNOWN = "und"
#: Longest context in bytes; training documents of each language (the bound of the sample); times a longest context
#: must have been seen to get a node; bytes that count in full for the score.
ORDER, SAMPLE, SEEN, SCORE_BYTES = 3, 300, 2, 64
CHUNK = 1 << 18

#: Symbols: letters without case, white space, digits, other ASCII, and each byte from 128 on.
_SYMBOL = np.full(256, 28, np.uint8)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(26)
_SYMBOL[[9, 10, 11, 12, 13, 32]] = 26
_SYMBOL[48:58] = 27
_SYMBOL[128:] = 29 + np.arange(128)
N, BLANK = 157, 26


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and each text's start, without a copy; nulls are empty."""
    a = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int64, len(a) + 1, a.offset * 8) if offsets else np.zeros(len(a) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def _chunks(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about CHUNK bytes; a longer text is a run of its own."""
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
        yield i, j
        i = j


def _grams(data: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols with `order` blanks before each text, starts of the texts there, lengths)."""
    n = np.diff(at)
    start = at[:-1] - at[0] + order * np.arange(len(n))
    out = np.full(int(at[-1] - at[0]) + order * len(n), BLANK, np.uint8)
    where = np.arange(int(at[-1] - at[0])) + np.repeat(order * np.arange(1, len(n) + 1), n)
    out[where] = _SYMBOL[data[at[0] : at[-1]]]
    return out, start, n


def _codes(s: np.ndarray, k: int) -> np.ndarray:
    """The number of each run of k symbols."""
    c = s[: len(s) - k + 1].astype(np.uint32)
    for i in range(1, k):
        c = c * np.uint32(N) + s[i : len(s) - k + 1 + i]
    return c


def train(rows: DataFrame, text: str, lang: str, order: int = ORDER) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """(languages, context numbers, costs in bits) from a bounded sample; what reaches the driver is bounded by it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = text_bytes(b.column(0))
            langs = b.column(1).to_pylist()
            for i, name in enumerate(langs):
                s, _, n = _grams(data, at[i : i + 2], order)
                code, times = np.unique(_codes(s, order + 1), return_counts=True) if n[0] else (np.zeros(0, np.uint32), np.zeros(0, int))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(times.astype(np.int64))], ["lang", "code", "n"])

    grams = rows.select(text, lang).mapInArrow(tidy(count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    if grams.empty:
        return None
    langs = sorted(grams["lang"].unique())
    li, code, times = grams["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(), grams["code"].to_numpy(np.int64), grams["n"].to_numpy(np.float64)
    table, cost = np.zeros(1, np.int32), np.full((1, N, len(langs)), 1.0 / N)
    all_costs, first = [], 0
    for k in range(order + 1):
        own = code % N ** (k + 1)  # the last k + 1 symbols
        contexts, total = np.unique(own // N, return_inverse=True)
        seen = np.bincount(total, times) >= (SEEN if k == order and order else 0)
        contexts, number = contexts[seen], np.cumsum(seen) - 1
        keep = seen[total]
        counts = np.zeros((len(contexts), N, len(langs)))
        np.add.at(counts, (number[total[keep]], own[keep] % N, li[keep]), times[keep])
        n, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        # the node of the context that is one symbol shorter
        parent = cost[table[contexts % N ** max(k - 1, 0)] - (first - len(cost))] if k else np.broadcast_to(cost, counts.shape)
        with np.errstate(invalid="ignore", divide="ignore"):
            p = np.where(counts > 0, counts / (n + kinds), np.where(n > 0, kinds / (n + kinds), 1.0) * parent)
        table = np.tile(table, N) if k else np.zeros(1, np.int32)
        if k:
            # contexts without a node keep the number of the shorter one
            table = table.copy()
            table[contexts] = first + np.arange(len(contexts))
        all_costs.append(p)
        # shorter contexts stay reachable: costs of all nodes so far stand behind one another
        cost = np.concatenate(all_costs)
        first += len(p)
    return langs, table, (-np.log2(cost)).astype(np.float32).reshape(-1, len(langs))


def code_lengths(data: np.ndarray, at: np.ndarray, model: tuple, order: int = ORDER) -> np.ndarray:
    """Bits of each text in each language."""
    langs, table, costs = model
    out = np.zeros((len(at) - 1, len(langs)))
    for i, j in _chunks(at):
        s, start, n = _grams(data, at[i : j + 1], order)
        full = n > 0
        if not full.any():
            continue
        for low in [None] if len(s) <= 4 * CHUNK else range(0, int(n[0]), CHUNK):  # a very long text goes in pieces
            piece = s if low is None else s[low : low + CHUNK + order]
            if len(piece) <= order:
                continue
            row = table[_codes(piece[:-1], order)].astype(np.int64) * N + piece[order:]
            bits = costs[row]
            if low is None:
                edges = np.stack([start[full], start[full] + n[full]], 1).ravel()
                sums = np.add.reduceat(np.concatenate([bits, np.zeros((1, len(langs)), np.float32)]), np.minimum(edges, len(bits)), axis=0, dtype=np.float64)
                out[i:j][full] = sums[::2]
            else:
                out[i] += bits.sum(0, dtype=np.float64)
    return out


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def teaching(training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that can teach: with a language, an id and a letter."""
    return training.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & has_letter(F.col(text_col)))


def identify(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None, sample: int = SAMPLE, judge: bool = False) -> DataFrame:
    """Add lang_pred and score to the columns `keep` (id alone) of every document.

    `training` rows without a language, without an id or without a letter teach nothing; of each language at most
    `sample` documents do, those with the smallest hash of their id, each with its whole text. Texts that are null
    or hold no letter, and all texts if nothing could be learned, are `und` with score 0. Ties go to the language
    that is first in order. The score is the odds of the best language, its lead in bits counted for SCORE_BYTES
    bytes at most. Empty tables give empty tables, and repeated rows are judged alike. Kept columns named lang_pred
    or score give way to the new ones. With `judge` a text of SCORE_BYTES bytes or more is `und` as well if
    no language's code for it is shorter than equal odds of all symbols, as for noise.
    """
    spark = docs.sparkSession
    rows = teaching(training, id_col, text_col, lang_col)
    by_hash = Window.partitionBy(lang_col).orderBy(F.xxhash64(id_col), id_col)
    chosen = rows.select(id_col, lang_col).withColumn("_n", F.row_number().over(by_hash)).where(F.col("_n") <= sample).select(id_col).distinct()
    # at most `sample` ids for each language, however many languages there are
    model = train(rows.join(small(cut(chosen, "language-sample")), id_col), text_col, lang_col)
    shared = spark.sparkContext.broadcast(model)
    keep = [c for c in keep or [id_col] if c not in ("lang_pred", "score")]
    lean = docs.select(*keep, F.when(has_letter(F.col(text_col)), F.col(text_col)).alias("_judged"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            names, scores = np.full(b.num_rows, UNKNOWN, object), np.zeros(b.num_rows)
            if shared.value is not None and b.num_rows:
                data, at = text_bytes(texts)
                bits, n = code_lengths(data, at, shared.value), np.diff(at)
                known = (n > 0) & ((bits.min(1) < n * np.log2(N)) | (n < SCORE_BYTES) if judge else True)
                lead = (bits - bits.min(1, keepdims=True)) * (np.minimum(n, SCORE_BYTES) / np.maximum(n, 1))[:, None]
                scores = np.where(known, 1 / np.exp2(-np.minimum(lead, 900)).sum(1), 0.0)
                names = np.where(known, np.array(shared.value[0], object)[bits.argmin(1)], UNKNOWN)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names[:-1], "lang_pred", "score"])

    return lean.mapInArrow(tidy(run), StructType([*docs.select(*keep).schema, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def held_out(key: str, folds: int = 5) -> Column:
    """Whether a document is kept from training; a null id is not held out (and teaches nothing)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(False))
