"""Vectorised work on the groups of a key, many small groups to an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import tidy
from .scratch import cut, small

#: Rows of a block that are compared at once.
BLOCK = 2048


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column whose rows are of one length, in double precision."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], tuple], schema: str, names: list[str], types: list[pa.DataType]) -> DataFrame:
    """Call fn on the rows of each key and gather the arrays that it returns (None: nothing).

    Rows are dealt by key and sorted by it, so a task holds one group and one batch at a time, never a partition.
    Groups must be bounded; what isn't is cut into blocks before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def done(t: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
            got = [x for s, e in zip(edges[:-1], edges[1:], strict=True) if (x := fn(t.slice(s, e - s))) is not None]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(zip(*got, strict=True), types, strict=True)], names)

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            new = np.zeros(t.num_rows - 1, bool)
            for k in keys:
                c = t.column(k).to_numpy()
                new |= c[1:] != c[:-1]
            starts = np.concatenate([[0], np.nonzero(new)[0] + 1])
            yield from done(t, starts)
            rest = t.slice(starts[-1])
        if rest is not None:
            yield from done(rest, np.array([0, rest.num_rows]))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), schema)


def deal_blocks(rows: DataFrame, key: list[str], block: int | Column = BLOCK) -> DataFrame:
    """Deal each key's rows to pairs (i, j), i <= j, of blocks, so that every two rows of a key meet in some pair.

    A key within `block` rows (a number, or a column of the key) is one pair; a larger one is spread over many tasks.
    """
    sizes = cut(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).select(*key, F.ceil(F.col("_n") / block).cast("int").alias("_k")), "block-sizes")
    cells = F.expr("transform(sequence(0, _k - 1), x -> struct(least(x, _b) as i, greatest(x, _b) as j))")
    return rows.join(small(sizes), key).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_k")).cast("int")).withColumn("_cell", F.explode(cells)).select(*rows.columns, "_b", "_cell.i", "_cell.j")
