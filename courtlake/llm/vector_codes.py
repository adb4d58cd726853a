"""Product codes of vectors, each part's nearest codebook entry found by Orchard's search."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouped import matrix
from .memory import tidy
from .scratch import cut, small

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Parts that are searched at once, and neighbours that each of them looks at in one step.
BATCH, STEP = 4096, 8
#: Copies of a label's row where labels are too many to broadcast.
SALT = 16


class Book:
    """The entries of one part position, with every entry's neighbours sorted by distance (ties: lower index first)."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        n = len(entries)
        far = np.stack([((entries - e) ** 2).sum(1) for e in entries]) if n else np.zeros((0, 0), np.int64)
        self.order = np.argsort(far, axis=1, kind="stable")
        width = -n % STEP
        self.far = np.pad(np.take_along_axis(far, self.order, 1), ((0, 0), (0, width)), constant_values=np.iinfo(np.int64).max)
        self.order = np.pad(self.order, ((0, 0), (0, width)))

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each part, ties to the lower index.

        A part holds a best entry and walks along that entry's list. It jumps to the list of the first better entry it
        meets, leaves out entries that it has marked, and stops where the list goes beyond twice its distance (four
        times, squared): by the triangle inequality nothing there is as near. At exactly twice a tie is possible.
        """
        n, k = len(parts), len(self.entries)
        best = np.zeros(n, np.int64)
        dist = ((parts - self.entries[0]) ** 2).sum(1)
        marked = np.zeros((n, k), bool)
        marked[:, 0] = True
        at = np.zeros(n, np.int64)
        live = np.arange(n)
        while len(live):
            row, cols = best[live][:, None], at[live][:, None] + np.arange(STEP)
            near, seen = self.order[row, cols], self.far[row, cols] <= 4 * dist[live][:, None]
            more = seen[:, -1]
            fresh = seen & ~marked[live[:, None], near]
            who, what = np.nonzero(fresh)
            e, q = near[who, what], live[who]
            marked[q, e] = True
            d = np.full(near.shape, np.iinfo(np.int64).max)
            d[who, what] = ((parts[q] - self.entries[e]) ** 2).sum(1)
            first = np.lexsort((near, d), axis=1)[:, 0]
            step = np.arange(len(live))
            d, e = d[step, first], near[step, first]
            better = (d < dist[live]) | ((d == dist[live]) & (e < best[live]) & fresh[step, first])
            dist[live[better]], best[live[better]] = d[better], e[better]
            at[live] = np.where(better, 0, at[live] + STEP)
            live = live[better | (more & (at[live] < k))]
        return best, dist


def _assign(books: list[Book], x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    width = x.shape[1] // PARTS
    for p, book in enumerate(books):
        got = [book.nearest(x[at : at + BATCH, p * width : (p + 1) * width]) for at in range(0, len(x), BATCH)]
        yield np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


def _sums(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, position, total and members (position -1) of one round's assignment, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, width = [Book(b) for b in books], books.shape[2]
        total = np.zeros((*books.shape[:2], width + 1), np.int64)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("_x")).astype(np.int64)
                for p, (code, _) in enumerate(_assign(own, x)):
                    np.add.at(total[p], code, np.pad(x[:, p * width : (p + 1) * width], ((0, 0), (0, 1)), constant_values=1))
        p, e, j = np.nonzero(total[:, :, -1:].astype(bool) & np.ones_like(total, bool))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[p, e, j])], ["part", "entry", "position", "total"])

    dealt = rows.select("_x").mapInArrow(tidy(run), "part int, entry int, position int, total long")
    return dealt.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"))


def usable(vector: Column) -> Column:
    """Not null, not empty, without null or non-finite components."""
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component in whole numbers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def within(vector: Column, limit: int) -> Column:
    """The vector, or an error where a component is beyond `limit`, for sums would leave 64 bits."""
    return F.when(F.exists(vector, lambda x: (x > limit) | (x < -limit)), F.raise_error(F.lit(f"a scaled component is beyond {limit}")).cast("array<bigint>")).otherwise(vector)


def train(rows: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (part, entry, component): they start as the first ENTRIES rows by `_id`, then follow their members' means."""
    start = [r["_x"] for r in rows.orderBy(F.col("_id").asc_nulls_last(), "_x").limit(ENTRIES).collect()]  # at most ENTRIES rows
    if not start:
        return np.zeros((PARTS, 0, 0), np.int64)
    x = np.array(start, np.int64)
    books = np.stack(np.split(x, PARTS, axis=1))
    for _ in range(rounds):
        total = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
        for r in _sums(rows, books).toLocalIterator():  # one number for each component of each entry
            total[r["part"], r["entry"], r["position"]] = r["total"]
        n = total[:, :, -1:]
        books = np.where(n > 0, total[:, :, :-1] // np.maximum(n, 1), books)
    return books


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(id, code, error, label_error, codebooks_sha256) rows, and the codebooks.

    Vectors that are null, empty or hold null or non-finite components go, and so do those whose length isn't that of
    the smallest id's. A length that PARTS doesn't divide is filled up with zeros. Repeated rows each have a row and
    weigh in each mean; rows without an id come last in the start and stay; a null label is a label of its own. Ties
    of ids at the start go by the vector. Fewer rows than ENTRIES make smaller codebooks, no rows none. Other columns
    are left out. A round moves one sum for each task, entry and component; nothing else leaves the tasks, and the
    driver holds the codebooks alone.
    """
    v = F.col(vector_col)
    kept = vectors.where(usable(v)).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), scaled(v, SCALE).alias("_x"))
    first = kept.orderBy(F.col("_id").asc_nulls_last(), "_x").select(F.size("_x").alias("d")).first()
    d = first["d"] if first else 0
    limit = math.isqrt((1 << 60) // max(1, -(-d // PARTS))) // 2  # four times a squared distance then stays within 64 bits
    rows = cut(kept.where(F.size("_x") == d).withColumn("_x", F.concat(within(F.col("_x"), limit), F.array_repeat(F.lit(0).cast("long"), -d % PARTS))), "code-rows")
    books = train(rows, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Book(b) for b in books]
        for b in batches:
            if b.num_rows:
                got = list(_assign(own, matrix(b.column("_x")).astype(np.int64)))
                codes = [bytes(c).hex() for c in np.stack([g[0] for g in got], 1).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_label"), pa.array(codes), pa.array(sum(g[1] for g in got))], ["_id", "_label", "code", "error"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("_id", "_label")}
    coded = cut(rows.mapInArrow(tidy(run), f"_id {kinds['_id']}, _label {kinds['_label']}, code string, error long"), "codes")
    sums = cut(coded.groupBy("_label").agg(F.sum("error").alias("label_error")).withColumnRenamed("_label", "_of"), "code-labels")
    side = small(sums)
    if side is sums:  # a label may hold many rows: they are dealt by a salt as well
        sums, coded = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), coded.withColumn("_salt", F.pmod(F.xxhash64("_id", "code"), F.lit(SALT)).cast("int"))
        both = coded.join(sums, F.col("_label").eqNullSafe(F.col("_of")) & (coded["_salt"] == sums["_salt"]))
    else:
        both = coded.join(side, F.col("_label").eqNullSafe(F.col("_of")))
    return both.select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")), books
