"""Bet ledgers: summaries, breakdowns, CLV reports, ticket settlement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.functions.odds import safe_div
from formbook.operators.skew import DEFAULT_RULE, Running, SplitRule, hot_keys, running, with_group_totals


def summary_columns(result: str = "result", profit: str = "profit", stake: str = "stake") -> list[Column]:
    """Counts, win rate without pushes, profit, units and ROI in percent."""
    wins, losses = F.count_if(F.col(result) == "WIN"), F.count_if(F.col(result) == "LOSS")
    decided = wins + losses
    return [
        F.count(F.lit(1)).alias("bets"),
        wins.alias("wins"),
        losses.alias("losses"),
        F.count_if(F.col(result) == "PUSH").alias("pushes"),
        F.coalesce(safe_div(wins, decided), F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.sum(profit), F.lit(0.0)).alias("profit_total"),
        F.coalesce(F.sum(stake), F.lit(0.0)).alias("units"),
        F.coalesce(safe_div(F.sum(profit), F.sum(stake)) * 100.0, F.lit(0.0)).alias("roi"),
    ]


def bet_summary(df: DataFrame, by: Sequence[str] = (), **names: str) -> DataFrame:
    return df.groupBy(*by).agg(*summary_columns(**names))


def bet_breakdown(df: DataFrame, dims: Sequence[str], **names: str) -> DataFrame:
    """One row per value of each dimension, plus the total, in a single aggregation."""
    sets = [[F.col(d)] for d in dims] + [[]]
    grouped = df.groupingSets(sets, *dims).agg(F.grouping_id().alias("__g"), *summary_columns(**names))
    ones = (1 << len(dims)) - 1
    name = F.lit("total")
    value = F.lit("all")
    for i, d in enumerate(dims):
        only = ones ^ (1 << (len(dims) - 1 - i))
        name = F.when(F.col("__g") == only, F.lit(d)).otherwise(name)
        value = F.when(F.col("__g") == only, F.coalesce(F.col(d).cast("string"), F.lit("none"))).otherwise(value)
    return grouped.select(
        name.alias("dimension"), value.alias("value"), "bets", "wins", "losses", "pushes", "win_rate", "profit_total", "units", "roi"
    )


def clv_report(df: DataFrame, dims: Sequence[str], clv: str, rule: SplitRule = DEFAULT_RULE) -> DataFrame:
    """Mean, median and positive share of closing-line value per value of each dimension."""
    pairs = F.array(
        *[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("none")).alias("value")) for d in dims],
        F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")),
    )
    # counted per value of the measure first, so rows are not multiplied by the dimensions
    small = df.where(F.col(clv).isNotNull()).groupBy(*dims, clv).agg(F.count(F.lit(1)).alias("__n"))
    long = small.select(clv, "__n", F.inline(pairs)).groupBy("dimension", "value", clv).agg(F.sum("__n").alias("__n"))
    stats = long.groupBy("dimension", "value").agg(
        F.sum("__n").alias("n_legs"),
        (F.sum(F.col(clv) * F.col("__n")) / F.sum("__n")).alias("mean_clv"),
        (F.sum(F.when(F.col(clv) > 0, F.col("__n")).otherwise(0)) / F.sum("__n")).alias("beat_rate"),
    )
    median = weighted_median(long, ["dimension", "value"], clv, "__n", "median_clv", rule)
    return stats.join(median, ["dimension", "value"])


def weighted_median(df: DataFrame, by: Sequence[str], value: str, count: str, name: str, rule: SplitRule = DEFAULT_RULE) -> DataFrame:
    """Median of values given with repeat counts."""
    counts = df.groupBy(*by, F.col(value).alias("__v")).agg(F.sum(count).alias("__n"))
    heavy = hot_keys(counts, by, rule)
    upto = running(counts, by, [F.col("__v")], {"__upto": Running("sum", F.col("__n"))}, rule=rule, heavy=heavy)
    at = (F.col("__t") - 1) / 2.0
    return (
        with_group_totals(upto, by, {"__t": F.sum("__n")}, rule, heavy)
        .groupBy(*by)
        .agg(
            F.min(F.when(F.col("__upto") > F.floor(at), F.col("__v"))).alias("__lo"),
            F.min(F.when(F.col("__upto") > F.ceil(at), F.col("__v"))).alias("__hi"),
        )
        .select(*by, ((F.col("__lo") + F.col("__hi")) / 2.0).alias(name))
    )


def distinct_denominators(df: DataFrame, by: Sequence[str], keys: dict[str, Sequence[str]]) -> DataFrame:
    """Rows and distinct keys, for rates quoted per row or per entity-night."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_distinct(*[F.col(c) for c in k]).alias(n) for n, k in keys.items()]
    )


def settle_tickets(legs: DataFrame, ticket: Sequence[str], result: str) -> DataFrame:
    """Status per ticket from its legs; an ungraded leg leaves it unsettled."""
    r = F.col(result)
    agg = legs.groupBy(*ticket).agg(
        F.count(F.lit(1)).alias("n_legs"),
        F.count(r).alias("__graded"),
        F.bool_or(r == "LOSS").alias("__loss"),
        F.bool_and(r == "WIN").alias("__win"),
        F.bool_and(r == "PUSH").alias("__push"),
    )
    status = (
        F.when(F.col("__graded") < F.col("n_legs"), F.lit("open"))
        .when(F.col("__loss"), F.lit("lost"))
        .when(F.col("__win"), F.lit("won"))
        .when(F.col("__push"), F.lit("push"))
        .otherwise(F.lit("partial"))
    )
    return agg.select(*ticket, "n_legs", status.alias("status"))


def ticket_payout(status: Column, stake: Column, potential: Column) -> Column:
    """Payout of a settled ticket; partial and open ones have none."""
    return F.when(status == "lost", F.lit(0.0)).when(status == "won", potential).when(status == "push", stake)


def recent_performance(df: DataFrame, order: Sequence[Column], sizes: Sequence[int], **names: str) -> DataFrame:
    """Summary of the newest N bets for each N, from one top-N selection."""
    top = df.orderBy(*order).limit(max(sizes))
    ranked = top.select("*", F.posexplode(F.array(*[F.lit(s) for s in sizes])).alias("__i", "window"))
    from pyspark.sql import Window

    # at most max(sizes) * len(sizes) rows reach this window
    position = F.row_number().over(Window.partitionBy("window").orderBy(*order))
    return bet_summary(ranked.withColumn("__p", position).where("__p <= window"), ["window"], **names)


def per_game_totals(df: DataFrame, game: str, profit: str, stake: str) -> DataFrame:
    return df.groupBy(game).agg(
        F.count(F.lit(1)).alias("bets"), F.sum(profit).alias("profit_total"), F.sum(stake).alias("units")
    )
