"""Isotonic calibration: pool-adjacent-violators as a merge of sorted blocks.

Pooling any run of neighbours first and the pools afterwards gives the same steps as pooling all at once. So levels (rows summed per
distinct score, map-side) are put in score order over many tasks, each task pools its own stretch, and the pools, far fewer, are
pooled again over ``FAN`` times fewer tasks until one is left. Nothing depends on where a stretch ends: a task that is run again, or
stretches that fall otherwise, give the same steps. What the last task holds is the answer itself, usually about the cube root of the rows
(for 0/1 labels never more than a few times n^(2/3)). Applying the steps is an as-of join, so they are neither collected nor broadcast.

Defined results: rows without a score, a label or a positive weight take no part in a fit; scores that are NULL or NaN calibrate to NULL; an empty fit calibrates all to NULL.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.operators.joins import asof_join
from formbook.operators.skew import DEFAULT_RULE, SplitRule

FAN = 8
# all rows are one key of the as-of join, so it is cut into blocks long before a task would feel it
BLOCKS = replace(DEFAULT_RULE, hot_rows=250_000, block_rows=250_000, check_bytes=16 << 20)
COLUMNS = ("low", "high", "weight", "total")
POOLS = ", ".join(f"{c} double" for c in COLUMNS)
STEPS = "start double, low double, high double, weight double, value double, next_low double, next_value double"


def pool(levels: np.ndarray) -> np.ndarray:
    """Pools of ``levels``, rows (low, high, weight, total) in score order. Whole falling runs pool at once; what then falls back slowly is done with a stack."""
    while len(levels) > 1:
        mean = levels[:, 3] / levels[:, 2]
        heads = np.flatnonzero(np.concatenate(([True], mean[1:] > mean[:-1])))
        if len(heads) == len(levels):
            break
        slow = len(heads) > 0.9 * len(levels)
        ends = np.append(heads[1:], len(levels)) - 1
        levels = np.column_stack([levels[heads, 0], levels[ends, 1], np.add.reduceat(levels[:, 2], heads), np.add.reduceat(levels[:, 3], heads)])
        if slow:
            return _stacked(levels)
    return levels


def _stacked(levels: np.ndarray) -> np.ndarray:
    out: list[list[float]] = []
    for low, high, weight, total in levels.tolist():
        while out and out[-1][3] / out[-1][2] >= total / weight:
            last = out.pop()
            low, weight, total = last[0], weight + last[2], total + last[3]
        out.append([low, high, weight, total])
    return np.array(out)


def merge(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pools of two pooled stretches that follow each other: only steps at the seam can fall."""
    i, j = len(left), 0
    if not i or not len(right):
        return right if not i else left
    seam = None
    while True:
        before = left[i - 1] if i else None
        if seam is None:
            if before[3] / before[2] < right[0, 3] / right[0, 2]:
                return np.vstack([left, right])
            seam, j = right[0].copy(), 1
        elif before is not None and before[3] / before[2] >= seam[3] / seam[2]:
            seam = np.array([before[0], seam[1], before[2] + seam[2], before[3] + seam[3]])
            i -= 1
        elif j < len(right) and seam[3] / seam[2] >= right[j, 3] / right[j, 2]:
            seam = np.array([seam[0], right[j, 1], seam[2] + right[j, 2], seam[3] + right[j, 3]])
            j += 1
        else:
            return np.vstack([left[:i], seam[None, :], right[j:]])


def _pooled(batches: Iterator[pd.DataFrame]) -> np.ndarray:
    kept = np.empty((0, len(COLUMNS)))
    for batch in batches:
        kept = merge(kept, pool(batch[list(COLUMNS)].to_numpy(dtype="float64")))
    return kept


def _stretch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield pd.DataFrame(_pooled(batches), columns=list(COLUMNS))


def _last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pools = _pooled(batches)
    low, high, weight, total = pools.T
    value = total / weight
    beyond = [np.nan] * min(1, len(low))
    out = pd.DataFrame({
        "start": np.concatenate(([-np.inf], low[1:])) if len(low) else low, "low": low, "high": high, "weight": weight, "value": value,
        "next_low": np.append(low[1:], beyond), "next_value": np.append(value[1:], beyond),
    })
    out[["next_low", "next_value"]] = out[["next_low", "next_value"]].astype(object).where(out[["next_low", "next_value"]].notna(), None)
    yield out


def isotonic_steps(df: DataFrame, score: str, label: str, weight: str | None = None, fan: int = FAN) -> DataFrame:
    """Steps of the non-decreasing fit of ``label`` on ``score``: from ``low`` to ``high`` it is ``value``; the next step stands beside it."""
    s, y = F.col(score).cast("double"), F.col(label).cast("double")
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(s.alias("low"), w.alias("w"), y.alias("y")).where("low is not null and not isnan(low) and y is not null and w > 0")
    steps = rows.groupBy("low").agg(F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("y")).alias("total"))
    steps = steps.select("low", F.col("low").alias("high"), "weight", "total")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while parts > 1:
        steps = steps.repartitionByRange(parts, "low").sortWithinPartitions("low").mapInPandas(_stretch, POOLS)
        parts = -(-parts // fan)
    return steps.repartition(1).sortWithinPartitions("low").mapInPandas(_last, STEPS)


def between(score: Column, high: Column, value: Column, next_low: Column, next_value: Column) -> Column:
    """Value of a step at ``score``; in the gap to the next step the straight line, as the usual calibrators give."""
    gap = value + (next_value - value) * (score - high) / (next_low - high)
    return F.when((score <= high) | next_low.isNull(), value).otherwise(gap)


def apply_steps(df: DataFrame, steps: DataFrame, score: str, into: str, row_id: list[str], rule: SplitRule = BLOCKS) -> DataFrame:
    """``df`` with the calibrated score ``into``; scores beyond the fitted range take the first or last value. A task holds a block of rows, whatever their number."""
    known = F.when(~F.isnan(F.col(score).cast("double")), F.col(score).cast("double"))
    left = df.withColumns({"__all": F.lit(0), "__score": known})
    right = steps.withColumn("__all", F.lit(0))
    parts = ["high", "value", "next_low", "next_value"]
    joined = asof_join(left, right, ["__all"], "__score", "start", ["start"], parts, row_id, rule=rule)
    at = {c: F.col(f"asof_{c}") for c in parts}
    out = F.when(F.col("__score").isNotNull(), between(F.col("__score"), at["high"], at["value"], at["next_low"], at["next_value"]))
    return joined.withColumn(into, out).drop("__all", "__score", *[f"asof_{c}" for c in parts])
