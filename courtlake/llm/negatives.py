"""Hard negatives by inner product, from an R-tree packed by sort-tile-recursive order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .grouped import matrix
from .memory import tidy
from .scratch import cut
from .vector_codes import scaled, usable, within

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
#: Rows of a leaf, nodes of an inner node, coordinates that tiles are cut by within a block.
LEAF, FAN, AXES = 64, 8, 3
#: Components of a block's vectors, blocks that one cell reads at most in turn, cells that are made even for few rows, anchors of a cell.
BLOCK, TURN, CELLS, ANCHORS = 1 << 17, 64, 256, 512
NONE = -(1 << 62)


def tile(x: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Sort-tile-recursive order of rows: sorted by one coordinate, cut into slabs, each sorted by the next; runs of `leaf` are leaves."""

    def cut_up(rows: np.ndarray, axes: np.ndarray) -> list[np.ndarray]:
        if len(rows) <= leaf or not len(axes):
            return [rows]
        leaves = -(-len(rows) // leaf)
        step = -(-leaves // math.ceil(leaves ** (1 / len(axes)))) * leaf
        rows = rows[np.argsort(x[rows, axes[0]], kind="stable")]
        return [o for at in range(0, len(rows), step) for o in cut_up(rows[at : at + step], axes[1:])]

    return np.concatenate(cut_up(np.arange(len(x)), np.argsort(-x.var(0), kind="stable")[:AXES]))


class Tree:
    """Boxes over a block's rows, which are in tile order: inner nodes first, then leaves."""

    def __init__(self, t: pa.Table) -> None:
        self.x, self.at, self.ids, self.labels = matrix(t.column("x")), t.column("at").to_numpy(), t.column("id").to_numpy(), t.column("label").to_numpy()
        starts = np.arange(0, len(self.x), LEAF)
        low, high = np.minimum.reduceat(self.x, starts), np.maximum.reduceat(self.x, starts)
        inner = np.arange(0, len(starts), FAN)
        self.inner, self.leaves = len(inner), len(starts)
        self.low, self.high = np.concatenate([np.minimum.reduceat(low, inner), low]), np.concatenate([np.maximum.reduceat(high, inner), high])

    def children(self, node: int) -> np.ndarray:
        return self.inner + np.arange(node * FAN, min((node + 1) * FAN, self.leaves))

    def rows(self, node: int) -> slice:
        return slice((node - self.inner) * LEAF, (node - self.inner + 1) * LEAF)


class Search:
    """The best rows of many queries over blocks that come one after another.

    A query has a vector, a label, a window of scores and wants rows of its label or of others. All queries go through
    a block's tree together, each with a queue of its own: a round takes each query's node of the largest upper bound,
    and queries that took the same node are answered by one product of matrices.
    """

    def __init__(self, x: np.ndarray, at: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> None:
        self.up, self.down = np.maximum(x, 0), np.minimum(x, 0)
        self.x, self.at, self.labels, self.low, self.high, self.same = x, at, labels, low, high, same
        self.scores, self.ids = np.full((len(x), k), NONE), np.full((len(x), k), np.iinfo(np.int64).max)

    def floor(self, q: np.ndarray) -> np.ndarray:
        """What a score must reach: the window's lower end, and the k-th best so far, ties with it included."""
        return np.maximum(self.low[q], self.scores[q, -1])

    def bounds(self, tree: Tree, nodes: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Upper bounds of nodes whose interval of inner products meets the window and reaches the floor; -inf for others.

        A coordinate's products lie between those with the box's two ends; the sums of their ends bound the score.
        """
        most = self.up[q] @ tree.high[nodes].T + self.down[q] @ tree.low[nodes].T
        least = self.up[q] @ tree.low[nodes].T + self.down[q] @ tree.high[nodes].T
        return np.where((most >= self.floor(q)[:, None]) & (least <= self.high[q][:, None]), most, -np.inf)

    def visit(self, tree: Tree) -> None:
        q = np.arange(len(self.x))
        queue = np.full((len(q), tree.inner + tree.leaves), -np.inf)
        queue[:, : tree.inner] = self.bounds(tree, np.arange(tree.inner), q)
        while len(q):
            node = queue[q].argmax(1)
            best = queue[q, node]
            open_ = (best > -np.inf) & (best >= self.floor(q))
            q, node = q[open_], node[open_]
            queue[q, node] = -np.inf
            order = np.argsort(node, kind="stable")
            for run in np.split(order, np.nonzero(np.diff(node[order]))[0] + 1):
                if len(run):
                    at = int(node[run[0]])
                    if at < tree.inner:
                        queue[np.ix_(q[run], tree.children(at))] = self.bounds(tree, tree.children(at), q[run])
                    else:
                        self.score(tree, tree.rows(at), q[run])

    def score(self, tree: Tree, rows: slice, q: np.ndarray) -> None:
        s = (self.x[q] @ tree.x[rows].T).astype(np.int64)
        fits = (s >= self.floor(q)[:, None]) & (s <= self.high[q][:, None]) & ((self.labels[q][:, None] == tree.labels[rows][None]) == self.same) & (self.at[q][:, None] != tree.at[rows][None])
        some = fits.any(1)
        if some.any():
            q, s, fits = q[some], s[some], fits[some]
            scores = np.concatenate([self.scores[q], np.where(fits, s, NONE)], axis=1)
            ids = np.concatenate([self.ids[q], np.where(fits, tree.ids[rows][None], np.iinfo(np.int64).max)], axis=1)
            best = np.lexsort((ids, -scores), axis=1)[:, : self.scores.shape[1]]
            self.scores[q], self.ids[q] = np.take_along_axis(scores, best, 1), np.take_along_axis(ids, best, 1)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows of equal keys, one table at a time."""
    rest = None
    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            new = np.zeros(t.num_rows - 1, bool)
            for k in keys:
                c = t.column(k).to_numpy()
                new |= c[1:] != c[:-1]
            edges = np.concatenate([[0], np.nonzero(new)[0] + 1])
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                yield t.slice(s, e - s)
            rest = t.slice(edges[-1])
    if rest is not None:
        yield rest


def pack(rows: DataFrame, n: int, d: int) -> DataFrame:
    """Rows dealt to blocks and put in tile order: block, at (a row's own number, in order within the block), id, label, x, anchor.

    A range shuffle by the first coordinate cuts slabs, with a hash of the id after it so that equal vectors don't fall
    into one. A block is full at its size, however many rows a slab got.
    """
    size = max(LEAF, BLOCK // max(d, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, held = TaskContext.get().partitionId() << 40, 0, []

        def block(t: pa.Table) -> pa.RecordBatch:
            t = t.take(pa.array(tile(matrix(t.column("x"))))).combine_chunks()
            cols = [pa.array(np.full(t.num_rows, part + done)), pa.array(part + done + np.arange(t.num_rows)), *(t.column(c) for c in ("id", "label", "x", "anchor"))]
            return pa.Table.from_arrays(cols, ["block", "at", "id", "label", "x", "anchor"]).combine_chunks().to_batches()[0]

        for b in batches:
            held.append(pa.Table.from_batches([b]))
            while sum(t.num_rows for t in held) >= size:
                t = pa.concat_tables(held).combine_chunks()
                yield block(t.slice(0, size))
                done += size
                held = [t.slice(size)]
        if sum(t.num_rows for t in held):
            yield block(pa.concat_tables(held).combine_chunks())

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label", "x", "anchor")}
    dealt = rows.repartitionByRange(max(1, -(-n // size)), F.get("x", F.lit(0)), F.xxhash64("id"))
    return dealt.select("id", "label", "x", "anchor").mapInArrow(tidy(run), "block long, at long, " + ", ".join(f"{c} {k}" for c, k in kinds.items()))


def best_rows(packed: DataFrame, queries: DataFrame, same: bool, k: int, blocks: int, n_queries: int) -> DataFrame:
    """q, w, id and score: the first k rows (score descending, then id) for each window of each query.

    `queries` has q (its own row's `at`), label, x and arrays lo and hi of windows. Queries are dealt to chunks of a
    bounded number, blocks to groups, and each pair of them is a cell that holds its queries and one block at a time.
    """
    chunks, groups = max(1, -(-n_queries // ANCHORS)), max(min(blocks, CELLS), -(-blocks // TURN), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, search, keys = None, None, None

        def found() -> Iterator[pa.RecordBatch]:
            if search is not None:
                r, c = np.nonzero(search.scores > NONE)
                yield pa.RecordBatch.from_arrays([pa.array(keys[0][r]), pa.array(keys[1][r]), pa.array(search.ids[r, c]), pa.array(search.scores[r, c])], ["q", "w", "id", "score"])

        for t in _runs(batches, ["c", "g", "block"]):
            here = t.column("c")[0].as_py(), t.column("g")[0].as_py()
            if here != cell:
                yield from found()
                cell, search = here, None
            if t.column("block")[0].as_py() < 0:
                lists = t.column("lo").combine_chunks()
                many = lists.value_lengths().to_numpy(zero_copy_only=False)
                of = np.repeat(np.arange(t.num_rows), many)
                w = (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)).astype(np.int32)
                at = t.column("at").to_numpy()
                keys = at[of], w
                search = Search(matrix(t.column("x"))[of], at[of], t.column("label").to_numpy()[of], lists.flatten().to_numpy(), t.column("hi").combine_chunks().flatten().to_numpy(), same, k)
            elif search is not None:
                search.visit(Tree(t))
        yield from found()

    none = F.lit(None).cast("array<long>")
    ask = queries.select(F.pmod(F.xxhash64("q"), F.lit(chunks)).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(-1).cast("long").alias("block"), F.col("q").alias("at"), F.lit(0).cast("long").alias("id"), "label", "x", "lo", "hi")
    rows = packed.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("c"), F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("g"), "block", "at", "id", "label", "x", none.alias("lo"), none.alias("hi"))
    cells = ask.unionByName(rows).repartition("c", "g").sortWithinPartitions("c", "g", "block", "at")
    local = cells.mapInArrow(tidy(run), "q long, w int, id long, score long")
    order = Window.partitionBy("q", "w").orderBy(F.col("score").desc(), "id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchor: Column, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    A score is the inner product of floor(scale * x). Anchors are rows where `anchor` holds; an anchor's positives are
    the first `positives` other rows of its label by score, then id, and each positive's negatives the first ones of
    other labels whose score is `low` to `high` hundredths of the positive's. `label` replaces the label column.

    Rows without an id or a label, or whose vector is null, empty or holds null or non-finite components take no part,
    nor do vectors whose length isn't that of the smallest id's. Ids are whole numbers. Repeated rows are rows of their
    own: another row of the anchor's id is an other row. Other columns are left out. A scaled component that could
    take a product beyond 53 bits is an error. Anchors meet all rows, in blocks; a label is never gathered.
    """
    v = F.col(vector_col)
    given = F.col(label_col) if label is None else label
    whole = rows.select(given.alias("l")).schema["l"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    kept = rows.select(F.col(id_col).cast("long").alias("id"), given.cast("long" if whole else "string").alias("label"), scaled(F.when(usable(v), v), scale).alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    kept = kept.where("id is not null and label is not null and x is not null")
    first = kept.orderBy("id", "x").select(F.size("x").alias("d")).first()
    d = first["d"] if first else 1
    same = kept.where(F.size("x") == d)
    n = same.count()
    packed = cut(pack(same.withColumn("x", within(F.col("x"), math.isqrt((1 << 53) // d))), n, d), "tree-rows")
    blocks, n_anchors = packed.agg(F.countDistinct("block"), F.count_if("anchor")).first()
    wide = F.array(F.lit(NONE + 1)), F.array(F.lit(-NONE))
    asked = packed.where("anchor").select(F.col("at").alias("q"), "id", "label", "x")
    got = best_rows(packed, asked.withColumns({"lo": wide[0], "hi": wide[1]}), True, positives, blocks, n_anchors)
    # at most `positives` to a list
    lists = cut(got.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("p")), "tree-positives")
    up = F.expr(f"transform(p, s -> ({low} * s.positive_score + pmod(-{low} * s.positive_score, 100)) div 100)")
    down = F.expr(f"transform(p, s -> ({high} * s.positive_score - pmod({high} * s.positive_score, 100)) div 100)")
    windows = asked.join(lists, "q").select("q", "label", "x", up.alias("lo"), down.alias("hi"))
    worst = best_rows(packed, windows, False, negatives, blocks, n_anchors)
    pairs = asked.select("q", F.col("id").alias("anchor_id")).join(lists, "q").select("q", "anchor_id", F.posexplode("p").alias("w", "p")).select("q", "w", "anchor_id", "p.positive_id", "p.positive_score")
    return worst.join(pairs, ["q", "w"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
