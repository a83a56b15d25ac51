"""Mixing sources to target weights by weighted fair queueing. DataFrame operations only.

Method. Every source is a queue of its documents in shuffled order (by the MD5 of seed and id), walked up to
``repeats`` times. An entry's virtual finish time is the words of its source up to and with it, divided by the
source's target. All entries, ordered by virtual finish time, are taken until the total budget is reached.

At scale. Running totals of a hot source are not one window: documents are cut into blocks by their shuffled order,
blocks are summed (combined before the shuffle), and only sums per block are accumulated per source. The number of
blocks grows with the rows, so that a block stays at about ``block_rows`` documents. The global order is
cut in the same way: sizes are summed per slice of virtual time, and only the slice in which the budget runs out
is ordered row by row.

Defined results: null text has size 0; a null source is a source of its own, last; sources of size 0 have target 0
and nothing is taken; documents of size 0 take 0; rows with one id are told apart by their text; rows alike in all of that share
their place in the queue and are taken together. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.session import checkpointed

WEIGHTS = (1, 2, 3)
REPEATS = 3
SLICES = 4096


def words(text: str | Column) -> Column:
    """Runs of characters other than blank and U+0009 to U+000D; null has none."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    blank = "[ \\t-\\r]"
    inner = F.size(F.split(text, f"{blank}+"))
    ends = F.when(text.rlike(f"^{blank}"), 1).otherwise(0) + F.when(text.rlike(f"{blank}\\z"), 1).otherwise(0)
    return F.when(text == "", F.lit(0)).otherwise(inner - ends).cast("long")


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size) -> also weight and target: shares by weight of the total, none above ``repeats`` times its source.

    One row per source: the windows here see as many rows as there are sources. Resharing the excess until no target is above its
    limit fills the sources like vessels to one level, so limits are met in the order of limit / weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(repeats))
    ranked = per_source.withColumn("weight", weight).withColumn("_limit", limit)
    fill = Window.orderBy(F.col("_limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(onward)
    filled = ranked.withColumn("_level", level).withColumn("_n", F.row_number().over(fill))
    # sources before the first whose limit is above the level stand at their limits; it and all after it share its level
    is_open = F.col("_limit") > F.col("weight") * F.col("_level")
    final = filled.withColumn("_first", F.min(F.when(is_open, F.struct("_n", "_level"))).over(everything))
    shared = F.col("_first").isNotNull() & (F.col("_n") >= F.col("_first._n"))
    target = F.when(shared, F.col("weight") * F.col("_first._level")).otherwise(F.col("_limit"))
    return final.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block_rows: int = 20_000) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each document."""
    queue = F.md5(F.concat_ws("\x1f", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("source"), F.lit(""))))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), words("text").alias("size"), queue.alias("_place"), F.xxhash64("text").alias("_text"))
    rows = checkpointed(rows)  # narrow; the texts are read once
    n = rows.count()
    blocks = max(1, -(-n // block_rows))
    block = F.floor(F.conv(F.substring("_place", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * blocks).cast("int")
    rows = rows.withColumn("_block", block)
    # sums per block; a null source matches null-safely
    sums = rows.groupBy("source", "_block").agg(F.sum("size").alias("_sum"))
    sums = checkpointed(sums)  # sources x blocks rows at most
    aims = targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, repeats)
    ahead = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "_block", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    starts = starts.join(aims.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    b = starts.select(F.col("source").alias("_s"), F.col("_block").alias("_b"), "_ahead", "source_size", "target")
    inside = Window.partitionBy("source", "_block").orderBy("_place", "doc_id", "_text")
    placed = (
        rows.withColumn("_in", F.sum("size").over(inside))
        .join(b, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
        .drop("_s", "_b").withColumn("_end", F.col("_ahead") + F.col("_in"))
    )
    placed = checkpointed(placed.select("doc_id", "source", "size", "source_size", "target", "_place", "_text", "_end"))
    cut = budget_cut(placed, repeats)
    taken = sum((F.when(F.col("size") == 0, 0).when(before_cut(finish(k), k, cut), 1).otherwise(0) for k in range(repeats)), F.lit(0))
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * taken).cast("long").alias("taken"))


def finish(k: int) -> Column:
    """Virtual finish time in the k-th walk through the queue."""
    return F.when(F.col("target") > 0, (F.col("source_size") * F.lit(k) + F.col("_end")) / F.col("target")).otherwise(F.lit(float("inf")))


def budget_cut(placed: DataFrame, repeats: int = REPEATS) -> tuple | None:
    """(virtual time, source is null, source, place, text hash, walk) of the last entry within the budget; one row."""
    entry = placed.where(F.col("size") > 0).select(
        "size", F.col("source").isNull().alias("null_source"), F.coalesce("source", F.lit("")).alias("source"), "_place", "_text",
        F.explode(F.array(*[F.struct(finish(k).alias("v"), F.lit(k).alias("walk")) for k in range(repeats)])).alias("e"),
    ).select("size", "null_source", "source", "_place", "_text", "e.v", "e.walk")
    budget = placed.agg(F.sum("size").alias("b")).first()["b"]
    if not budget:
        return None
    # virtual times are at most repeats * source / target <= bounded, as no target is below its share; slices split the time around 1 finely
    sliced = entry.withColumn("slice", F.least(F.floor(F.col("v") * SLICES), F.lit(2 * SLICES)).cast("int"))
    per_slice = sliced.groupBy("slice").agg(F.sum("size").alias("s"))
    running = Window.orderBy("slice")
    crossing = per_slice.withColumn("upto", F.sum("s").over(running)).where(F.col("upto") >= budget).orderBy("slice").limit(1).first()
    if crossing is None:
        return None
    order = [F.col(c) for c in ("v", "null_source", "source", "_place", "_text", "walk")]
    last = (
        sliced.where(F.col("slice") == crossing["slice"])
        .withColumn("upto", F.sum("size").over(Window.orderBy(*order)) + F.lit(crossing["upto"] - crossing["s"]))
        .where(F.col("upto") <= budget).orderBy(F.col("upto").desc(), *[c.desc() for c in order]).limit(1).first()
    )
    if last is None:  # nothing of this slice fits: all before it
        return (crossing["slice"] / SLICES, False, "", "", -(2**63), -1)
    return (last["v"], last["null_source"], last["source"], last["_place"], last["_text"], last["walk"])


def before_cut(v: Column, k: int, cut: tuple | None) -> Column:
    if cut is None:
        return v < F.lit(float("inf"))
    here = F.struct(v.alias("a"), F.col("source").isNull().alias("b"), F.coalesce("source", F.lit("")).alias("c"), F.col("_place").alias("d"), F.col("_text").alias("e"), F.lit(k).alias("f"))
    there = F.struct(*[F.lit(x).cast(t).alias(n) for x, t, n in zip(cut, ("double", "boolean", "string", "string", "long", "int"), "abcdef", strict=True)])
    return here <= there
