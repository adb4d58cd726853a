"""Mix sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import cut, small
from .words import WORD

WEIGHTS = (3, 1, 2)
SHARE, CAP, SEED, BUCKETS = 1.5, 2.0, 20240229, 4096


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _draw(key: Column, size: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the row alone, so reruns and retried tasks agree."""
    return (F.xxhash64(key, size, F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)


def _rank(draw: Column, rate: Column) -> Column:
    """Random odds by inclusion odds, mapped from (0, inf) to (0, 1) in the same order."""
    # odds / (1 + odds) of odds = (draw / (1 - draw)) / (rate / (1 - rate)), without a divisor of 0
    far, near = draw * (1 - rate), (1 - draw) * rate
    return far / (far + near)


def source_targets(sizes: DataFrame, source: str, size: str, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row for each source: source_size, target, copies (certain whole ones), rate (inclusion odds' probability).

    Sources are ordered by code point, null last, and take `weights` in turn. Sources that would pass `cap` times
    their size stop there and the rest is shared again by weight. Sorted by cap over weight, a source is stopped if
    its cap is within the level that those before it leave, which gives the end of that repetition in one pass.
    The windows see one row for each source.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    by_fill = Window.orderBy("_ratio", "_n")
    level = (F.col("_budget") - F.coalesce(F.sum("_cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("_w").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    return (
        sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
        .withColumn("_w", w.cast("double"))
        .withColumn("_n", F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())))
        .withColumn("_cap", F.lit(cap) * F.col("source_size"))
        .withColumn("_budget", F.lit(share) * F.sum("source_size").over(Window.partitionBy()))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_level", level)
        .withColumn("_full", F.col("_ratio") <= F.col("_level"))
        .withColumn("_end", F.first(F.when(~F.col("_full"), F.col("_level")), ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.least("_cap", F.col("_w") * F.col("_end"))).cast("double"))
        .withColumn("_times", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("copies", F.floor("_times").cast("int"))
        .withColumn("rate", F.col("_times") - F.col("copies"))
        .select(source, "source_size", "target", "copies", "rate")
    )


def _odds(size: Column, level: Column) -> Column:
    """Probability of one more copy: a source's level times the root of the document's size class, at most 1."""
    return F.least(F.lit(1.0), level * F.pow(F.lit(2.0), F.floor(F.log2(size.cast("double"))) / 2))


def source_levels(sizes: DataFrame, plan: DataFrame, source: str, size: str) -> DataFrame:
    """The plan with `level`: that at which the expected words of one more copy are what whole copies leave.

    Longer documents are likelier, so that short ones are left to fill the last places; where that would give more than 1
    they are certain. Size classes are powers of two, so a source has some thirty rows; in their order the certain ones come
    first, and the first class that isn't certain at the level which those before it leave gives the level.
    """
    k = F.floor(F.log2(F.col(size).cast("double")))
    words = sizes.where(F.col(size) > 0).groupBy(F.col(source).alias("_src"), k.alias("_k")).agg(F.sum(size).alias("_words"))
    need = plan.select(F.col(source).alias("_of"), (F.col("target") - F.col("copies") * F.col("source_size")).alias("_need"))
    rows = words.join(small(need), words["_src"].eqNullSafe(need["_of"]))
    by_class = Window.partitionBy("_src").orderBy(F.desc("_k"))
    w = F.pow(F.lit(2.0), F.col("_k") / 2)
    before = F.coalesce(F.sum("_words").over(by_class.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_level", (F.col("_need") - before) / F.sum(w * F.col("_words")).over(by_class.rowsBetween(0, Window.unboundedFollowing)))
    levels = rows.where(F.col("_level") * w < 1).groupBy("_src").agg(F.max_by("_level", "_k").alias("level"))
    return plan.join(levels, plan[source].eqNullSafe(levels["_src"]), "left").drop("_src")


def mixing_plan(sizes: DataFrame, source: str, size: str, key: str, seed: int = SEED, buckets: int = BUCKETS, **law) -> DataFrame:
    """source_targets with `level`, `cut_rank` and `cut_key`, the last row in Pareto order that gets one more copy, and the fill.

    Pareto order sampling ranks rows by (U / (1 - U)) / (p / (1 - p)), U uniform and p the inclusion probability,
    and takes the first ones. Here the fixed size is in words: rows are taken as long as they fit into the words that
    whole copies leave, and the last place goes to the row whose size fits best into the rest (the fill). No source is
    sorted whole: ranks fall into `buckets`, whose sums show the one in which the cut lies, and only that one's rows
    are put in order.
    """
    plan = cut(source_levels(sizes, cut(source_targets(sizes, source, size, **law), "mix-targets"), source, size), "mix-levels")
    drawn = (
        sizes.join(small(plan), sizes[source].eqNullSafe(plan[source])).drop(plan[source])
        .where((F.col("rate") > 0) & (F.col(size) > 0))
        .withColumn("_rank", _rank(_draw(F.col(key), F.col(size), seed), _odds(F.col(size), F.col("level"))))
        .withColumn("_bucket", F.least(F.floor(F.col("_rank") * buckets), F.lit(buckets - 1)).cast("int"))
        .withColumn("_need", F.col("target") - F.col("copies") * F.col("source_size"))
        .withColumn("_key", F.coalesce(F.col(key).cast("long"), F.lit(-1)))
    )
    sums = drawn.groupBy(source, "_bucket").agg(F.sum(size).alias("_words"), F.first("_need").alias("_need"))
    until = Window.partitionBy(source).orderBy("_bucket")
    bound = cut(
        sums.withColumn("_until", F.sum("_words").over(until.rowsBetween(Window.unboundedPreceding, 0)))
        .where((F.col("_until") >= F.col("_need")) & (F.col("_until") - F.col("_words") < F.col("_need")))
        .select(F.col(source).alias("_src"), F.col("_bucket").alias("_at"), (F.col("_until") - F.col("_words")).alias("_before"), F.col("_need").alias("_wanted")),
        "mix-bounds",
    )
    in_order = Window.partitionBy(source).orderBy("_rank", "_key", size)
    last = (
        drawn.join(small(bound), drawn[source].eqNullSafe(bound["_src"]) & (drawn["_bucket"] == bound["_at"]))
        .withColumn("_until", F.col("_before") + F.sum(size).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("_until") <= F.col("_need"))
        .groupBy(F.col(source).alias("_src")).agg(F.max(F.struct("_rank", "_key")).alias("_last"), F.max("_until").alias("_got"))
    )
    # where no row of the bound bucket is taken, all before it are
    found = cut(bound.alias("b").join(last.alias("l"), F.col("b._src").eqNullSafe(F.col("l._src")), "left").select(
        F.col("b._src").alias("_src"),
        F.coalesce(F.col("l._last._rank"), F.col("b._at") / F.lit(float(buckets))).alias("cut_rank"),
        F.coalesce(F.col("l._last._key"), F.lit(-(1 << 62))).alias("cut_key"),
        (F.col("b._wanted") - F.coalesce(F.col("l._got"), F.col("b._before"))).alias("_rest"),
    ), "mix-cuts")
    behind = drawn.join(small(found), drawn[source].eqNullSafe(found["_src"])).where((F.struct("_rank", "_key") > F.struct("cut_rank", "cut_key")) & (F.col(size) < 2 * F.col("_rest")))
    fill = behind.groupBy(F.col("_src").alias("_of")).agg(F.min_by(F.struct(F.col("_rank").alias("fill_rank"), F.col("_key").alias("fill_key")), F.struct(F.abs(F.col(size) - F.col("_rest")), "_rank", "_key")).alias("_f"))
    cuts = found.join(fill, found["_src"].eqNullSafe(fill["_of"]), "left").select("_src", "cut_rank", "cut_key", "_f.fill_rank", "_f.fill_key")
    return cut(plan.join(cuts, plan[source].eqNullSafe(cuts["_src"]), "left").drop("_src"), "mix-plan")


def copies_taken(rows: DataFrame, plan: DataFrame, source: str, size: str, key: str, seed: int = SEED) -> DataFrame:
    """Add source_size, target and `copies`; a decision about a row needs only the row and its source's plan."""
    plan = plan.withColumnRenamed(source, "_src")
    rank, number = _rank(_draw(F.col(key), F.col(size), seed), _odds(F.col(size), F.col("level"))), F.coalesce(F.col(key).cast("long"), F.lit(-1))
    within = (rank < F.col("cut_rank")) | ((rank == F.col("cut_rank")) & (number <= F.col("cut_key")))
    within = within | F.coalesce((rank == F.col("fill_rank")) & (number == F.col("fill_key")), F.lit(False))
    more = F.when((F.col("rate") > 0) & (F.col(size) > 0) & F.col("cut_rank").isNotNull() & within, 1).otherwise(0)
    return rows.join(small(plan), rows[source].eqNullSafe(plan["_src"])).withColumn("copies", F.col("copies") + more).drop("_src", "rate", "level", "cut_rank", "cut_key", "fill_rank", "fill_key")


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **law) -> DataFrame:
    """How often the mix takes each document: id, size, source_size, target, taken.

    Null text has size 0 and is taken with whole copies only (0 words). Null source is a source of its own, last in
    order. Rows that repeat id, source and size share one draw, so they are taken alike. An empty table gives an
    empty table. Other columns are left out.
    """
    sizes = cut(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_of"), word_count(text_col).alias("size")), "mix-sizes")
    plan = mixing_plan(sizes, "_of", "size", "_id", **law)
    return copies_taken(sizes, plan, "_of", "size", "_id").select(F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **law) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken, with the columns of `docs`.

    The text is read twice and never shuffled. A document without words comes as often as its source's whole copies.
    Other columns may have any name.
    """
    keys = F.col(id_col).alias("_id"), F.col(source_col).alias("_of"), word_count(text_col).alias("_size")
    plan = mixing_plan(cut(docs.select(*keys), "mix-sizes"), "_of", "_size", "_id", **law)
    chosen = copies_taken(docs.select(*keys, F.struct(*docs.columns).alias("_row")), plan.drop("source_size", "target"), "_of", "_size", "_id")
    return chosen.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
