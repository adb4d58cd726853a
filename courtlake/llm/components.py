"""Connected components of links between ids, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """id and component (its smallest reachable id) of every id that has a link; links may repeat, in any direction.

    A large star ties each node's larger neighbours to the smallest one, a small star ties its smaller neighbours to
    the smallest; alternated they end in one star for each component after about log(n) rounds. Minima are combined
    before the shuffle, each round is written to the shared folder, and the driver sees a count and a checksum only.
    Null ids link with nothing.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v and u is not null and v is not null").distinct()
    pairs, last = cut(pairs, "links"), None
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = cut(
            large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v")).distinct(),
            "links",
        )
        state = tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components aren't stable after {rounds} rounds")
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
