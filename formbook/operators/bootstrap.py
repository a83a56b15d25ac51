"""Cluster bootstraps in one scan.

Rows are summed per cluster, and a Poisson(1) weight drawn from (seed, cluster, resample) replaces drawing clusters with
replacement. The draw is a function of the data, so a retried task or another cluster size gives the same interval, and nothing is
indexed or collected. Each task multiplies its clusters' sums by their weights, a tile of clusters and resamples at a time, and hands on one vector
of B sums per group: what is shuffled are the cluster sums, then tasks x groups x B numbers, never clusters x B. Resample 0 has every weight 1,
so the estimate comes out of the same scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.functions.odds import safe_div

RESAMPLES = 10_000

# cumulative Poisson(1) probabilities: weight is the number of bounds at or below u
_POISSON_ONE = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
                0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]
_PRIME = 2147483647


def hash_parts(seed: str, cluster: Column) -> tuple[Column, Column]:
    """Two independent integers below 2^31 - 1 from a cluster's identity."""
    digest = F.md5(F.concat(F.lit(seed), F.lit("|"), cluster.cast("string")))

    def part(start: int) -> Column:
        return F.conv(F.substring(digest, start, 8), 16, 10).cast("long") % _PRIME

    return part(1), part(9)


def draw(a: Column, c: Column, b: Column) -> Column:
    """Uniform number of a cluster in resample ``b``; clusters are independent for each b."""
    return ((a * b + c) % _PRIME) / float(_PRIME)


def poisson_weight(u: Column) -> Column:
    out = F.when(u < _POISSON_ONE[0], F.lit(0))
    for k, bound in enumerate(_POISSON_ONE[1:], start=1):
        out = out.when(u < bound, F.lit(k))
    return out.otherwise(F.lit(len(_POISSON_ONE)))


def uniform_draw(seed: str, key: Column) -> Column:
    """A reproducible uniform number per key."""
    return hash_parts(seed, key)[0] / float(_PRIME)


_TILE = (1024, 64)  # clusters, resamples
_ROWS = 20_000  # clusters of a task that are worked on at once
_HELD = 64 << 20  # bytes of sums a task holds before it hands them on


def _steps() -> np.ndarray:
    """For each bound the first whole number whose share of the prime reaches it, so that whole numbers are compared as ``poisson_weight`` compares shares."""
    out = []
    for bound in _POISSON_ONE:
        at = int(bound * _PRIME) - 2
        while at / float(_PRIME) < bound:
            at += 1
        out.append(at)
    return np.array(out, np.uint32)


_STEPS = _steps()


def weights(x: np.ndarray, out: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Poisson weights of the whole numbers ``x``, into ``out`` (8 bits each); ``more`` is scratch space for as many booleans."""
    np.greater_equal(x, _STEPS[0], out=out.view(bool))
    for step in _STEPS[1:4]:
        np.greater_equal(x, step, out=more)
        out += more.view(np.int8)
    # beyond three there is little: one share in fifty
    rare = np.flatnonzero(more)
    out.ravel()[rare] += np.searchsorted(_STEPS[4:], x.ravel()[rare], "right").astype(np.int8)
    return out


def _first(a: np.ndarray, c: np.ndarray, stretch: int) -> np.ndarray:
    """(a * b + c) modulo the prime for b = 1 .. stretch, a row for each b: doubled until all are there."""
    x = np.empty((stretch, len(a)), np.uint32)
    x[0] = (a + c) % _PRIME
    have = 1
    while have < stretch:
        new = x[have : 2 * have]
        np.add(x[: len(new)], (a * have % _PRIME).astype(np.uint32), out=new)
        np.minimum(new, new - np.uint32(_PRIME), out=new)
        have += len(new)
    return x


def add_weighted(total: np.ndarray, a: np.ndarray, c: np.ndarray, values: np.ndarray) -> None:
    """Adds to ``total`` (resample, sum) the values of clusters times their weights; those of resample 0 are 1.

    A tile goes from one stretch of resamples to the next by one addition modulo the prime, in 32 bits, and nothing but the tile is held.
    A sum below twice the prime is reduced as the lesser of it and its difference, which wraps to a larger number where it is below zero.
    """
    total[0] += values.sum(axis=0)
    many = len(total)
    for i in range(0, len(a), _TILE[0]):
        mine, part = slice(i, i + _TILE[0]), values[i : i + _TILE[0]]
        stretch = min(max(_TILE[0] * _TILE[1] // len(part), 1), max(many - 1, 1))
        x = _first(a[mine], c[mine], stretch)
        step = (a[mine] * stretch % _PRIME).astype(np.uint32)
        out, more, less, wide = (np.empty(x.shape, kind) for kind in (np.int8, bool, np.uint32, float))
        for j in range(1, many, stretch):
            wide[...] = weights(x, out, more)
            total[j : j + stretch] += (wide @ part)[: many - j]
            x += step
            np.subtract(x, np.uint32(_PRIME), out=less)
            np.minimum(x, less, out=x)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at least ``_ROWS`` rows (the last may be shorter), so that a group of a batch has clusters enough for a tile."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _ROWS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _places(batch: pa.RecordBatch, by: Sequence[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Each group of the batch with the places of its rows."""
    if not by:
        yield (), np.arange(batch.num_rows)
        return
    number = np.zeros(batch.num_rows, np.int64)
    columns = [batch.column(k).dictionary_encode("encode") for k in by]
    for column in columns:
        number = number * len(column.dictionary) + column.indices.to_numpy(zero_copy_only=False)
        number = np.unique(number, return_inverse=True)[1]
    order = np.argsort(number, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
        yield tuple(c[int(mine[0])].as_py() for c in columns), mine


def _sampler(by: Sequence[str], sums: Sequence[str], resamples: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per group, B + 1 weighted totals of the clusters of a task (null where no cluster has a value)."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        size = (resamples + 1) * len(sums) * 8
        kinds: list[pa.DataType] = []
        for batch in _gathered(batches):
            if not batch.num_rows:
                continue
            kinds = [batch.schema.field(k).type for k in by]
            a, c = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("__a", "__c"))
            values = np.stack([batch.column(n).fill_null(0.0).to_numpy(zero_copy_only=False).astype(float) for n in sums], axis=1)
            present = np.stack([batch.column(n).is_valid().to_numpy(zero_copy_only=False) for n in sums], axis=1)
            for key, mine in _places(batch, by):
                if key not in held:
                    if (len(held) + 1) * size > _HELD and held:
                        yield _sums(held, by, kinds, sums)
                        held = {}
                    held[key] = np.zeros((resamples + 1, len(sums))), np.zeros(len(sums), bool)
                total, seen = held[key]
                seen |= present[mine].any(axis=0)
                add_weighted(total, a[mine], c[mine], values[mine])
        if held:
            yield _sums(held, by, kinds, sums)

    return sample


def _sums(held: dict, by: Sequence[str], kinds: list[pa.DataType], sums: Sequence[str]) -> pa.RecordBatch:
    many = len(next(iter(held.values()))[0])
    columns = [pa.array([key[i] for key in held for _ in range(many)], kind) for i, kind in enumerate(kinds)]
    columns.append(pa.array(np.tile(np.arange(many, dtype=np.int32), len(held))))
    for n in range(len(sums)):
        empty = np.repeat([not seen[n] for _, seen in held.values()], many)
        columns.append(pa.array(np.concatenate([total[:, n] for total, _ in held.values()]), mask=empty))
    return pa.RecordBatch.from_arrays(columns, names=[*by, "resample", *sums])


def resample(df: DataFrame, by: Sequence[str], cluster: Sequence[str], sums: dict[str, Column], resamples: int, seed: str) -> DataFrame:
    """Weighted totals per (by, resample), resample 0 being the data as they are; ``__clusters`` counts clusters without a null.

    A resample in which every weight of a group is zero keeps its row with zero totals.
    """
    named = F.when(~sum((F.col(k).isNull().cast("int") for k in cluster), F.lit(0)).cast("boolean"), F.lit(1.0)).otherwise(F.lit(0.0))
    per = df.groupBy(*by, *cluster).agg(*[F.sum(e).cast("double").alias(n) for n, e in sums.items()]).withColumn("__clusters", named)
    a, c = hash_parts(seed, F.concat_ws("_", *[F.col(k).cast("string") for k in cluster]))
    hashed = per.select(*by, *sums, "__clusters", a.alias("__a"), c.alias("__c"))
    names = [*sums, "__clusters"]
    kinds = [f"`{k}` {hashed.schema[k].dataType.simpleString()}" for k in by]
    parts = hashed.mapInArrow(_sampler(by, names, resamples), ", ".join([*kinds, "resample int", *[f"`{n}` double" for n in names]]))
    return parts.groupBy(*by, "resample").agg(*[F.sum(n).alias(n) for n in names])


def interval(reps: DataFrame, by: Sequence[str], stat: Column, point: dict[str, Column] | None = None, level: float = 0.95) -> DataFrame:
    """Values of the data as they are, and the percentile interval over the resamples (B values per group, a fixed number)."""
    tail = (1 - level) / 2
    drawn, given = F.col("resample") > 0, F.col("resample") == 0
    return reps.withColumns({"__s": F.when(drawn, stat), **{f"__p_{n}": F.when(given, e) for n, e in (point or {}).items()}}).groupBy(*by).agg(
        *[F.max(f"__p_{n}").alias(n) for n in point or {}],
        F.coalesce(F.max(F.when(given, F.col("__clusters"))), F.lit(0.0)).cast("long").alias("n_clusters"),
        F.percentile("__s", tail).alias("lower"),
        F.percentile("__s", 1 - tail).alias("upper"),
        F.count_if(drawn & stat.isNull()).alias("n_degenerate"),
    )


def cluster_bootstrap(df: DataFrame, cluster: Sequence[str], num: Column, den: Column, resamples: int = RESAMPLES,
                      seed: str = "form", by: Sequence[str] = (), scale: float = 1.0) -> DataFrame:
    """Ratio of sums (ROI, mean) with its cluster interval."""
    reps = resample(df, by, cluster, {"__num": num, "__den": den}, resamples, seed)
    ratio = safe_div(F.col("__num"), F.col("__den")) * scale
    return interval(reps, by, ratio, {"estimate": ratio})


def ratios_bootstrap(df: DataFrame, cluster: Sequence[str], nums: dict[str, Column], den: Column, label: str, resamples: int = RESAMPLES,
                     seed: str = "form", by: Sequence[str] = ()) -> DataFrame:
    """Several ratios over one denominator on the same draws, one row per (by, ratio)."""
    reps = resample(df, by, cluster, {**nums, "__den": den}, resamples, seed)
    pairs = [F.struct(F.lit(n).alias(label), safe_div(F.col(n), F.col("__den")).alias("__ratio")) for n in nums]
    long = reps.select(*by, "resample", "__clusters", F.inline(F.array(*pairs)))
    return interval(long, [*by, label], F.col("__ratio"), {"estimate": F.col("__ratio")})


def row_bootstrap(df: DataFrame, row_id: Sequence[str], value: Column, **kw) -> DataFrame:
    """Mean of rows: every row is its own cluster."""
    seen = F.when(value.isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))
    return cluster_bootstrap(df, row_id, F.coalesce(value, F.lit(0.0)), seen, **kw)


def paired_arms(df: DataFrame, cluster: Sequence[str], value: Column, arm_a: Column, arm_b: Column, weight: Column,
                resamples: int = RESAMPLES, seed: str = "form", by: Sequence[str] = ()) -> DataFrame:
    """Difference of two arms' ratios on the same draws, with the resamples that empty an arm."""

    def part(arm: Column, x: Column) -> Column:
        return F.when(arm, x).otherwise(F.lit(0.0))

    sums = {"__na": part(arm_a, value), "__da": part(arm_a, weight), "__nb": part(arm_b, value), "__db": part(arm_b, weight)}
    reps = resample(df, by, cluster, sums, resamples, seed)
    a, b = safe_div(F.col("__na"), F.col("__da")), safe_div(F.col("__nb"), F.col("__db"))
    return interval(reps, by, a - b, {"arm_a": a, "arm_b": b, "difference": a - b})


def correlation_bootstrap(df: DataFrame, cluster: Sequence[str], x: Column, y: Column, resamples: int = RESAMPLES,
                          seed: str = "form", by: Sequence[str] = ()) -> DataFrame:
    """Pearson r from per-cluster sufficient sums."""
    rows = df.where(x.isNotNull() & y.isNotNull())
    sums = {"__n": F.lit(1.0), "__x": x, "__y": y, "__xx": x * x, "__yy": y * y, "__xy": x * y}
    reps = resample(rows, by, cluster, sums, resamples, seed)
    n, sx, sy = F.col("__n"), F.col("__x"), F.col("__y")
    vx, vy = n * F.col("__xx") - sx * sx, n * F.col("__yy") - sy * sy
    r = F.when((vx > 0) & (vy > 0), (n * F.col("__xy") - sx * sy) / F.sqrt(vx * vy))
    return interval(reps, by, r, {"r": r})


def mean_vs_reference(df: DataFrame, cluster: Sequence[str], value: Column, reference: float, **kw) -> DataFrame:
    """Arm mean minus a fixed number."""
    out = row_bootstrap(df, cluster, value, **kw)
    return out.withColumns({c: F.col(c) - reference for c in ("estimate", "lower", "upper")})
