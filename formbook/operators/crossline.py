"""Cross-line pricing: what other books' lines say about a quote's own line.

Books quote different lines on one event. Each two-sided quote is turned into the mean of the count distribution that its line and fair
probability imply; the other books' mean, priced at the quote's own line, is its fair value, and the gap to the quoted price
decides a bet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.functions import distributions as ds
from formbook.functions.odds import decimal_to_american, devig_decimal, edge, grade, profit
from formbook.operators.quotes import leave_one_out
from formbook.operators.skew import DEFAULT_RULE, SplitRule, join_back


def implied_means(quotes: DataFrame, line: str, prob: str, alpha: float, rule: SplitRule = DEFAULT_RULE) -> DataFrame:
    """Adds ``implied_mean``. Inverted once per distinct line and probability (to nine places), NULL where there is none."""
    keyed = quotes.withColumns({"__prob": F.round(prob, 9), "__line": F.col(line)})
    asked = keyed.select("__line", "__prob").distinct().withColumn("__alpha", F.lit(alpha))
    means = asked.withColumn("implied_mean", ds.invert_count_mean("__line", "__prob", "__alpha")).drop("__alpha")
    return join_back(keyed, means, ["__line", "__prob"], "left", rule).drop("__line", "__prob")


def cross_line(
    quotes: DataFrame, event: Sequence[str], line: str, price_over: str, price_under: str, alpha: float, rule: SplitRule = DEFAULT_RULE
) -> DataFrame:
    """Adds fair_over, the peers' mean, their prices at the quote's own line and the gaps to its own prices.

    A row is one book's two-sided decimal quote of an event. Gaps are against the American price, as bets are decided. A quote without peers has NULLs.
    """
    rows = quotes.withColumn("fair_over", devig_decimal(F.col(price_over), F.col(price_under)))
    rows = implied_means(rows, line, "fair_over", alpha, rule)
    rows = leave_one_out(rows, event, "implied_mean", "peer_mean", rule)
    priced = rows.withColumn("__p", ds.price_count_line(F.col("peer_mean"), F.lit(alpha), F.lit(1.0), F.col(line)))
    known = F.col("peer_mean").isNotNull()
    own = {"peer_over": F.when(known, F.col("__p.p_over")), "peer_under": F.when(known, F.col("__p.p_under"))}
    gaps = {f"gap_{s}": edge(F.col(f"peer_{s}"), decimal_to_american(F.col(p))) for s, p in (("over", price_over), ("under", price_under))}
    return priced.withColumns(own).withColumns(gaps).drop("__p")


def bet_side(gap_over: Column, gap_under: Column, threshold: float) -> Column:
    """OVER needs the threshold and the larger gap, else UNDER needs the threshold; no bet without both gaps."""
    both = gap_over.isNotNull() & gap_under.isNotNull()
    return F.when(both & (gap_over >= threshold) & (gap_over > gap_under), F.lit("OVER")).when(both & (gap_under >= threshold), F.lit("UNDER"))


def flag_bets(priced: DataFrame, threshold: float) -> DataFrame:
    side = bet_side(F.col("gap_over"), F.col("gap_under"), threshold)
    gap = F.when(F.col("bet_side") == "OVER", F.col("gap_over")).otherwise(F.col("gap_under"))
    return priced.withColumn("bet_side", side).where(F.col("bet_side").isNotNull()).withColumn("gap", gap)


def closing_at_line(closing: DataFrame, event: Sequence[str], line: str, price_over: str, price_under: str) -> DataFrame:
    """Mean fair probability of all books that close at a line."""
    fair = devig_decimal(F.col(price_over), F.col(price_under))
    return closing.groupBy(*event, line).agg(F.avg(fair).alias("closing_over"), F.count(fair).alias("closing_books"))


def graded(flagged: DataFrame, closing: DataFrame, outcome: DataFrame, event: Sequence[str], line: str, rule: SplitRule = DEFAULT_RULE) -> DataFrame:
    """Flagged quotes with result, profit of one unit, and how far the closing price moved their way (NULL without an equal line)."""
    rows = join_back(join_back(flagged, closing, [*event, line], "left", rule), outcome, event, "left", rule)
    over = F.col("bet_side") == "OVER"
    moved = F.col("closing_over") - F.col("fair_over")
    odds = F.when(over, decimal_to_american(F.col("price_over"))).otherwise(decimal_to_american(F.col("price_under")))
    result = F.when(F.col("actual").isNotNull(), grade(F.col("bet_side"), F.col(line), F.col("actual")))
    return rows.withColumns({"prob_clv": F.when(over, moved).otherwise(-moved), "result": result, "bet_odds": odds}).withColumn(
        "profit", F.when(F.col("result").isNotNull(), profit(F.col("result"), F.col("bet_odds"), F.lit(1.0)))
    )


def value_report(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_flagged"), F.avg("gap").alias("mean_gap"), F.count("prob_clv").alias("n_closing"), F.avg("prob_clv").alias("mean_clv"),
        F.avg((F.col("prob_clv") > 0).cast("double")).alias("beat_rate"), F.count("result").alias("n_graded"), F.sum("profit").alias("profit"),
    )
