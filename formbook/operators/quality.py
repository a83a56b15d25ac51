"""Gates: each returns a small result frame, and ``require`` turns one into a stop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class GateFailed(AssertionError):
    """A data gate did not hold."""


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def require_unique(df: DataFrame, key: Sequence[str], examples: int = 10) -> DataFrame:
    bad = duplicate_keys(df, key).limit(examples).collect()  # at most ``examples`` rows
    if bad:
        raise GateFailed(f"key {list(key)} repeats, for example {[r.asDict() for r in bad]}")
    return df


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise GateFailed(f"missing columns {missing}")
    return df


def unexpected_values(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    return df.where(F.col(column).isNull() | ~F.col(column).isin(*allowed)).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))


def sum_to_one(df: DataFrame, group: Sequence[str], prob: str, tolerance: float = 1e-9) -> DataFrame:
    """Largest distance of a group's probabilities from one, and how many are off."""
    sums = df.groupBy(*group).agg(F.sum(prob).alias("__s"))
    gap = F.abs(F.col("__s") - 1.0)
    return sums.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.coalesce(F.count_if(gap > tolerance), F.lit(0)).alias("n_off"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("max_gap"),
    )


def require_no_leak(df: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    leaks = sorted(set(df.columns) & set(forbidden))
    if leaks:
        raise GateFailed(f"post-outcome columns present: {leaks}")
    return df


def leak_counts(df: DataFrame, ts: str, start: str, numeric: Sequence[str]) -> DataFrame:
    """Rows stamped after the start, and non-finite numbers per column."""
    bad = [F.count_if(F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).alias(f"bad_{c}") for c in numeric]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(ts) > F.col(start)).alias("after_start"), *bad)


def rate_gate(df: DataFrame, by: Sequence[str], hit: Column, minimum: float) -> DataFrame:
    return (
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("rate"))
        .withColumn("passed", (F.col("rate") >= minimum).cast("int"))
    )


def two_path_gap(a: DataFrame, b: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Unmatched keys either way and the largest difference per value column."""
    left = a.select(*key, *[F.col(v).alias(f"__a_{v}") for v in values], F.lit(1).alias("__in_a"))
    right = b.select(*key, *[F.col(v).alias(f"__b_{v}") for v in values], F.lit(1).alias("__in_b"))
    both = left.join(right, list(key), "full")
    return both.agg(
        F.count_if(F.col("__in_b").isNull()).alias("only_first"),
        F.count_if(F.col("__in_a").isNull()).alias("only_second"),
        *[F.max(F.abs(F.col(f"__a_{v}") - F.col(f"__b_{v}"))).alias(f"gap_{v}") for v in values],
    )


def reconcile_counts(actual: DataFrame, expected: DataFrame, key: Sequence[str], count: str) -> DataFrame:
    got = actual.withColumnRenamed(count, "n_actual")
    want = expected.withColumnRenamed(count, "n_expected")
    n_got, n_want = F.coalesce("n_actual", F.lit(0)), F.coalesce("n_expected", F.lit(0))
    return got.join(want, list(key), "full").select(
        *key, n_got.alias("n_actual"), n_want.alias("n_expected"), (n_got == n_want).cast("int").alias("agrees")
    )


def flag_counts(df: DataFrame, by: Sequence[str], checks: dict[str, Column]) -> DataFrame:
    """How many rows violate each named predicate; a NULL predicate is a violation."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()],
    )


def placebo_flag(ci: DataFrame, lower: str = "lower", upper: str = "upper") -> DataFrame:
    """A metric that must be null is suspicious when its interval excludes zero."""
    return ci.withColumn("excludes_zero", ((F.col(lower) > 0) | (F.col(upper) < 0)).cast("int"))


def require(result: DataFrame, ok: Column, message: str) -> None:
    if result.where(~ok).limit(1).count():
        raise GateFailed(message)


def schema_surprises(df: DataFrame, expected: T.StructType) -> dict[str, list[str]]:
    have = {f.name: f.dataType for f in df.schema}
    want = {f.name: f.dataType for f in expected}
    return {
        "missing": sorted(set(want) - set(have)),
        "extra": sorted(set(have) - set(want)),
        "retyped": sorted(n for n in set(have) & set(want) if have[n] != want[n]),
    }
