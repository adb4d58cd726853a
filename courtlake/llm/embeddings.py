"""Near copies among vectors: cross-polytope hashing after fast Hadamard rotations, with probes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .grouped import BLOCK, deal_blocks, map_groups, matrix
from .scratch import cut

COSINE = 0.98
#: Hash tables, buckets that a vector enters in each of them (its own one first), coordinates that a probe may take.
TABLES, PROBES, RUNNERS_UP = 12, 4, 3
SEED = 77


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform; columns are a power of two."""
    n, d = x.shape
    for s in signs:
        x = x * s
        h = 1
        while h < d:
            y = x.reshape(n, d // (2 * h), 2, h)
            x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
            h *= 2
        x = x / math.sqrt(d)
    return x


def buckets(x: np.ndarray, functions: int, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """(unit vectors, tables, probes) bucket numbers, a vector's own bucket first.

    A cross-polytope hash is the nearest of the 2d signed axes. A table joins `functions` of them. Probes replace an
    axis by a runner-up, cheapest first by the squares of what is given up.
    """
    n, d = x.shape
    width = 1 << max(1, math.ceil(math.log2(d)))
    x = np.pad(x, ((0, 0), (0, width - d)))
    rng = np.random.default_rng(SEED)
    r = min(RUNNERS_UP, width)
    combos = np.stack(np.meshgrid(*[np.arange(r)] * functions, indexing="ij"), -1).reshape(-1, functions)
    out = np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        axes, loss = [], []
        for _ in range(functions):
            y = rotate(x, rng.choice([-1.0, 1.0], (3, width)))
            top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :r]
            v = np.take_along_axis(y, top, 1)
            axes.append(2 * top + (v < 0))
            loss.append((np.abs(v[:, :1]) - np.abs(v)) ** 2)
        cost = sum(loss[f][:, combos[:, f]] for f in range(functions))
        best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        code = sum(axes[f][:, combos[:, f]].astype(np.int64) * (2 * width) ** f for f in range(functions))
        got = np.take_along_axis(code, best, 1)
        out[:, t] = np.pad(got, ((0, 0), (0, probes - got.shape[1])), mode="edge")
    return out


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    x = matrix(column)
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very large or small numbers would leave the range of doubles
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def hashed(vectors: DataFrame, functions: int) -> DataFrame:
    """group (label and length), table, bucket, id, own: the buckets of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                sizes = b.column("d").to_numpy()
                for d in np.unique(sizes):
                    part = b.filter(pa.array(sizes == d))
                    code = buckets(_unit(part.column("vector")), functions)
                    n, t, p = code.shape
                    rep = np.repeat(np.arange(n), t * p)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("label").take(pa.array(rep)), part.column("d").take(pa.array(rep)).cast(pa.int32()), pa.array(np.tile(np.repeat(np.arange(t, dtype=np.int32), p), n)), pa.array(code.ravel()), part.column("id").take(pa.array(rep)), pa.array(np.tile(np.arange(p) == 0, n * t))],
                        ["label", "d", "t", "bucket", "id", "own"],
                    )

    kind = vectors.schema["label"].dataType.simpleString()
    rows = vectors.select("label", "d", "id", "vector").mapInArrow(run, f"label {kind}, d int, t int, bucket long, id long, own boolean")
    return rows.groupBy("label", "d", "t", "bucket", "id").agg(F.max("own").alias("own"))


def _tree(t: pa.Table) -> tuple | None:
    """A spanning tree of the links in one block pair. A vector leaves the search once something reached it."""
    if t.num_rows < 2:
        return None
    x, own, ids = _unit(t.column("vector")), t.column("own").to_numpy(), t.column("id").to_numpy()
    left = np.arange(len(ids))
    a, b = [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            reached = []
            for at in range(0, len(front), BLOCK):
                f = front[at : at + BLOCK]
                near = (x[f] @ x[left].T >= COSINE) & (own[f][:, None] | own[left][None])
                hit = near.any(0)
                a.append(ids[f[near[:, hit].argmax(0)]])
                b.append(ids[left[hit]])
                reached.append(left[hit])
                left = left[~hit]
            front = np.concatenate(reached)
    return (np.concatenate(a), np.concatenate(b)) if a else None


def _degrees(t: pa.Table) -> tuple | None:
    """The links, copies included, that each vector of a block pair has there."""
    part, i, j = t.column("_b").to_numpy(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
    x, ids, copies = _unit(t.column("vector")), t.column("id").to_numpy(), t.column("copies").to_numpy()
    left, right = np.nonzero(part == i)[0], np.nonzero(part == j)[0]
    got, back = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
    for at in range(0, len(left), BLOCK):
        rows = left[at : at + BLOCK]
        near = x[rows] @ x[right].T >= COSINE
        if i == j:
            near[np.arange(len(rows)), at + np.arange(len(rows))] = False
        got[at : at + BLOCK] = near @ copies[right]
        back += copies[rows] @ near
    return (ids[left], got) if i == j else (np.concatenate([ids[left], ids[right]]), np.concatenate([got, back]))


def exact_label(rows: DataFrame, column: str) -> Column:
    """The label as a whole number where its type is one, else as text that equal labels alone share."""
    kind = rows.schema[column].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.col(column).cast("long")
    plain = F.col(column) + F.lit(0.0).cast(kind) if kind in ("float", "double") else F.col(column)  # -0.0 is 0.0
    return plain.cast("string")


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, n_links, component_id and kept of every vector.

    Vectors link within a label (of any type; null labels never) if their cosine in double precision is COSINE or more. Vectors
    that are null, empty, zero or hold null or non-finite components, and rows without an id, link with nothing.
    Copies are collapsed first and counted. Buckets propose pairs of which one stands in its own bucket; each bucket
    gives a spanning tree of its verified links, and within the components of those all pairs are verified, so that
    every link between members of a component counts. Neither pairs nor copies are written out. The number of joined
    hash functions follows the number of vectors, so that buckets outnumber them. Repeated rows of an id are vectors
    of their own that share the id's answer by vector.
    """
    v = F.col(vector_col)
    fine = F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(F.size(v) > 0, F.lit(False))
    finite = F.coalesce(F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0), F.lit(False))
    keyed = rows.select(F.col(id_col), v.alias("vector"), exact_label(rows, label_col).alias("label"), (fine & finite).alias("_ok"))
    keyed = keyed.select(id_col, "vector", "label", F.when(F.col("_ok"), F.xxhash64("label", "vector")).alias("h1"), F.when(F.col("_ok"), F.xxhash64(F.lit(SEED), "vector", "label")).alias("h2"))
    ids = cut(keyed.select(id_col, "h1", "h2"), "vector-ids")
    distinct = cut(
        keyed.where("h1 is not null").groupBy("h1", "h2").agg(F.min(id_col).alias("id"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector")).withColumn("d", F.size("vector")),
        "vectors",
    )
    n, d = distinct.agg(F.count(F.lit(1)), F.max("d")).first()
    functions = max(1, math.ceil(math.log(max(n, 2)) / math.log(2 << max(1, math.ceil(math.log2(d or 2))))))
    bucket = ["label", "d", "t", "bucket"]
    found = hashed(distinct, functions)
    shared = found.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"), F.max("own").alias("_any")).where("_n > 1 and _any").select(*bucket)
    met = cut(found.join(shared, bucket), "bucket-rows")
    blocks = deal_blocks(met, bucket).join(distinct.select("id", "vector"), "id")
    trees = map_groups(blocks, [*bucket, "i", "j"], _tree, "a long, b long", ["a", "b"], [pa.int64()] * 2)
    groups = cut(components(trees), "vector-components")
    linked = deal_blocks(distinct.join(groups, "id"), ["component"])
    degrees = map_groups(linked, ["component", "i", "j"], _degrees, "id long, links long", ["id", "links"], [pa.int64()] * 2).groupBy("id").agg(F.sum("links").alias("links"))
    answers = distinct.select("h1", "h2", "id", "copies").join(groups, "id", "left").join(degrees, "id", "left")
    answers = answers.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = ids.join(answers, ["h1", "h2"], "left").select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.col(id_col)).alias("component_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))
