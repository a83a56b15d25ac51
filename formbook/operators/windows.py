"""Prior-only time-series features per entity.

Every function takes the entity columns, a total order and value columns, and adds
columns that use earlier rows only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.operators.skew import DEFAULT_RULE, Running, SplitRule, bounded_frame, hot_keys, join_back, row_numbers, running


def cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def prior_rolling(
    df: DataFrame,
    entity: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    windows: Sequence[int],
    ddof: int = 1,
    rule: SplitRule = DEFAULT_RULE,
) -> DataFrame:
    """Mean and standard deviation over the ``w`` rows before each row."""
    spread = F.stddev_samp if ddof == 1 else F.stddev_pop

    def build(w):
        out = {}
        for size in windows:
            frame = w.rowsBetween(-size, -1)
            for v in values:
                out[f"{v}_rolling_{size}"] = F.avg(v).over(frame)
                out[f"{v}_rolling_std_{size}"] = spread(v).over(frame)
        return out

    return bounded_frame(df, entity, cols(order), build, back=max(windows), rule=rule)


def prior_expanding(
    df: DataFrame,
    entity: Sequence[str],
    order: Sequence[str],
    value: str,
    prefix: str,
    min_std: int = 2,
    rule: SplitRule = DEFAULT_RULE,
) -> DataFrame:
    """Mean, population std and count of all earlier rows, from moments that merge (see ``Running``)."""
    aggs = {"__m": Running("moments", F.col(value).cast("double")), f"{prefix}_games_prior": Running("count", F.lit(1))}
    out = running(df, entity, cols(order), aggs, prior=True, rule=rule)
    n, mean, m2 = (F.col("__m")[c] for c in ("n", "mean", "m2"))
    return out.withColumns({f"{prefix}_avg": mean, f"{prefix}_std": F.when(n >= min_std, F.sqrt(m2 / n))}).drop("__m")


def ema_reach(alpha: float, precision: float = 1e-18) -> int:
    """Rows after which an exponential weight is below double precision."""
    return math.ceil(math.log(precision) / math.log(1 - alpha))


def prior_ema(
    df: DataFrame,
    entity: Sequence[str],
    order: Sequence[str],
    value: str,
    span: int,
    name: str | None = None,
    rule: SplitRule = DEFAULT_RULE,
) -> DataFrame:
    """Recursive exponential mean of earlier rows, seeded with the first one.

    Missing values keep their position: the old mean decays across the gap and is
    re-weighted by the next value.  A frame holds the last ``ema_reach`` values that are
    present, however far apart, each with its position; older ones have a weight below
    double precision.
    """
    alpha = 2.0 / (span + 1)
    reach = ema_reach(alpha)
    name = name or f"{value}_ema{span}"
    present = F.col(value).isNotNull()
    item = F.struct(F.col(value).cast("double").alias("x"), F.col("__nth").alias("at"))

    def step(acc, item):
        kept = F.pow(F.lit(1 - alpha), item["at"] - acc["at"])
        mixed = (kept * acc["m"] + alpha * item["x"]) / (kept + alpha)
        return F.struct(F.coalesce(mixed, item["x"]).alias("m"), item["at"].alias("at"))

    def folded(items: Column) -> Column:
        start = F.struct(F.lit(None).cast("double").alias("m"), F.lit(None).cast("long").alias("at"))
        return F.aggregate(items, start, step, lambda acc: acc["m"])

    heavy = hot_keys(df, entity, rule)
    counts = {"__nth": Running("count", F.lit(1)), "__seen": Running("count", F.col(value))}
    placed = running(df, entity, cols(order), counts, prior=True, rule=rule, heavy=heavy)
    if heavy is None:
        # a value's own number is the count of values before it, so the frame ends before the row
        w = Window.partitionBy(*entity).orderBy("__seen").rangeBetween(-reach, -1)
        out = placed.withColumn(name, folded(F.collect_list(F.when(present, item)).over(w)))
    else:
        own = bounded_frame(
            placed.where(present), entity, cols(["__nth"]), lambda w: {"__ema": folded(F.collect_list(item).over(w.rowsBetween(-reach, 0)))},
            back=reach, rule=rule,
        )
        gaps = placed.where(~present).withColumn("__ema", F.lit(None).cast("double"))
        out = running(own.unionByName(gaps), entity, cols(["__nth"]), {name: Running("last", F.col("__ema"))}, prior=True, rule=rule)
    return out.select(*df.columns, name)


def rest_days(
    df: DataFrame,
    entity: Sequence[str],
    order: Sequence[str],
    date: str,
    fill: int | None = None,
    back_to_back_max: int = 1,
    rule: SplitRule = DEFAULT_RULE,
) -> DataFrame:
    """Days since the entity's previous row, and a back-to-back flag."""
    out = bounded_frame(
        df, entity, cols(order), lambda w: {"days_rest": F.datediff(F.col(date), F.lag(date).over(w))}, back=1, rule=rule
    )
    if fill is not None:
        out = out.withColumn("days_rest", F.coalesce("days_rest", F.lit(fill)))
    return out.withColumn("is_back_to_back", F.coalesce(F.col("days_rest") <= back_to_back_max, F.lit(False)).cast("int"))


def games_last_days(df: DataFrame, entity: Sequence[str], date: str, days: int = 4, name: str = "games_last_4_days") -> DataFrame:
    """Rows of the entity in the last ``days`` calendar days including today.

    Counted per (entity, day) first, so the window sees days and not rows.
    """
    day = F.to_date(F.col(date))
    daily = df.groupBy(*entity, day.alias("__day")).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*entity).orderBy(F.unix_date("__day")).rangeBetween(-(days - 1), 0)
    counted = daily.withColumn(name, F.sum("__n").over(w)).drop("__n")
    return join_back(df.withColumn("__day", day), counted, [*entity, "__day"], "left").drop("__day")


def recent_rows(df: DataFrame, entity: Sequence[str], order_desc: Sequence[Column], n: int) -> DataFrame:
    """The newest ``n`` rows per entity; Spark trims to n per key before the shuffle."""
    w = Window.partitionBy(*entity).orderBy(*order_desc)
    return df.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def prior_league(df: DataFrame, season: Sequence[str], date: str, value: str) -> DataFrame:
    """League count, mean and population std over strictly earlier dates, one row per date.

    Values are taken from the season's first daily mean before they are squared, so that values far from zero keep their spread.
    """
    x = F.col(value).cast("double")
    daily = df.groupBy(*season, F.to_date(date).alias("league_date")).agg(
        F.count(x).alias("__n"), F.avg(x).alias("__mean"), (F.var_pop(x) * F.count(x)).alias("__m2")
    )
    # one row per calendar date: the windows are bounded by the calendar
    dates = Window.partitionBy(*season).orderBy("league_date")
    whole = dates.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = dates.rowsBetween(Window.unboundedPreceding, -1)
    daily = daily.withColumn("__start", F.first("__mean", ignorenulls=True).over(whole)).withColumn("__off", F.col("__mean") - F.col("__start"))
    n, off = F.coalesce(F.sum("__n").over(w), F.lit(0)), F.col("__n") * F.col("__off")
    cum = daily.select(
        *season, "league_date", "__start", n.alias("prior_count"), F.sum(off).over(w).alias("__s"),
        F.sum(F.col("__m2") + off * F.col("__off")).over(w).alias("__q"),
    )
    many = F.nullif(F.col("prior_count"), F.lit(0))
    mean = F.try_divide(F.col("__s"), many)
    var = F.try_divide(F.col("__q"), many) - mean * mean
    return cum.select(
        *season, "league_date", "prior_count", (F.col("__start") + mean).alias("prior_mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("prior_std")
    )


def prior_league_z(df: DataFrame, season: Sequence[str], date: str, value: str, name: str) -> DataFrame:
    league = prior_league(df, season, date, value)
    z = F.try_divide(F.col(value) - F.col("prior_mean"), F.nullif(F.col("prior_std"), F.lit(0.0)))
    return join_back(df.withColumn("league_date", F.to_date(date)), league, [*season, "league_date"], "left").withColumn(name, z)


def latest_version(
    df: DataFrame, key: Sequence[str], resolved: str, requested: str, position: Sequence[str], keep: str = "last"
) -> DataFrame:
    """One row per key: newest resolved, then newest requested, then file position."""
    tie = [F.col(p).desc() if keep == "last" else F.col(p).asc() for p in position]
    w = Window.partitionBy(*key).orderBy(F.col(resolved).desc_nulls_last(), F.col(requested).desc_nulls_last(), *tie)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def version_ties(df: DataFrame, key: Sequence[str], resolved: str, requested: str) -> DataFrame:
    """Keys, rows, and keys whose newest version several rows share, so that only their position decided."""
    same = df.groupBy(*key, resolved, requested).agg(F.count(F.lit(1)).alias("__n"))
    # a missing stamp is older than any
    newest = F.struct(*[x for c in (resolved, requested) for x in (F.col(c).isNotNull(), F.col(c))])
    top = same.groupBy(*key).agg(F.max_by("__n", newest).alias("__top"), F.sum("__n").alias("__rows"))
    return top.agg(F.count(F.lit(1)).alias("n_keys"), F.sum("__rows").alias("n_rows"), F.count_if(F.col("__top") > 1).alias("n_tied"))


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def forward_min_clip(
    df: DataFrame, ladder: Sequence[str], rung: Sequence[str], prob: str, name: str, rule: SplitRule = DEFAULT_RULE
) -> DataFrame:
    """Make a price ladder non-increasing along its rungs; flags the clipped ones."""
    out = running(df, ladder, cols(rung), {name: Running("min", F.col(prob))}, rule=rule)
    return out.withColumn("was_clipped", (F.col(prob) > F.col(name)).cast("int"))


def balance_chain(
    df: DataFrame, by: Sequence[str], order: Sequence[str], remaining: str, cost: str, rule: SplitRule = DEFAULT_RULE
) -> DataFrame:
    """Compare each remaining balance with the previous one minus this row's cost."""
    return bounded_frame(
        df,
        by,
        cols(order),
        lambda w: {
            "expected_remaining": F.lag(remaining).over(w) - F.col(cost),
            "chain_ok": F.coalesce(F.abs(F.lag(remaining).over(w) - F.col(cost) - F.col(remaining)) < 1e-9, F.lit(True)).cast("int"),
        },
        back=1,
        rule=rule,
    )


def evenly_spaced(df: DataFrame, order: Sequence[str], n: int, rule: SplitRule = DEFAULT_RULE) -> DataFrame:
    """``n`` rows at evenly spaced ranks of the whole ordered table, first and last included."""
    ranked = row_numbers(df, [], cols(order), "__rn", rule)
    last = df.agg(F.count(F.lit(1)).alias("__total"))
    picks = last.select(
        F.explode(
            F.array_distinct(
                F.transform(
                    F.sequence(F.lit(0), F.lit(n - 1)),
                    lambda i: F.bround(i * (F.col("__total") - 1) / F.lit(float(n - 1))).cast("long") + 1,
                )
            )
        ).alias("__rn")
    )
    return ranked.join(F.broadcast(picks), "__rn").drop("__rn")  # n rows


def frozen_sample(df: DataFrame, key: Column, seed: str, n: int) -> DataFrame:
    """First ``n`` rows of a permutation fixed by the seed; re-running never redraws."""
    draw = F.md5(F.concat(F.lit(seed), key.cast("string")))
    return df.withColumn("draw", draw).orderBy("draw").limit(n)
