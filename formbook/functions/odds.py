"""Price, probability, decision and grading expressions (Column in, Column out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(num: Column, den: Column) -> Column:
    """Division where a zero denominator or a non-finite result is NULL."""
    ratio = F.try_divide(num.cast("double"), F.nullif(den.cast("double"), F.lit(0.0)))
    return F.when(~F.isnan(ratio) & (F.abs(ratio) != float("inf")), ratio)


# --- conversion ---------------------------------------------------------------


def american_to_prob(odds: Column) -> Column:
    return F.when(odds < 0, -odds / (-odds + 100.0)).when(odds >= 0, 100.0 / (odds + 100.0))


def american_to_prob_strict(odds: Column) -> Column:
    """NULL for the (-100, 100) zone that no American price can take."""
    return F.when(F.abs(odds) >= 100, american_to_prob(odds))


def american_to_decimal(odds: Column) -> Column:
    return F.when(odds < 0, 100.0 / -odds + 1.0).when(odds >= 0, odds / 100.0 + 1.0)


def decimal_to_american(price: Column) -> Column:
    """Half-even rounding; NULL at or below even money back."""
    long_shot = F.bround((price - 1.0) * 100.0)
    favourite = F.bround(F.try_divide(F.lit(-100.0), F.nullif(price - 1.0, F.lit(0.0))))
    return F.when(price >= 2.0, long_shot).when(price > 1.0, favourite).cast("long")


def decimal_to_american_truncated(price: Column) -> Column:
    """The odds-archive variant, which cuts towards zero instead of rounding."""
    long_shot = (price - 1.0) * 100.0
    favourite = F.try_divide(F.lit(-100.0), F.nullif(price - 1.0, F.lit(0.0)))
    return F.when(price >= 2.0, long_shot).when(price > 1.0, favourite).cast("long")


def profit_per_unit(odds: Column) -> Column:
    return F.when(odds <= -100, 100.0 / -odds).when(odds >= 100, odds / 100.0)


def odds_problem(raw: Column) -> Column:
    """Reason text for an unusable American price, empty string when it is fine."""
    number = F.try_cast(raw, "double") if hasattr(F, "try_cast") else raw.try_cast("double")
    return (
        F.when(raw.isNull(), F.lit(""))
        .when(number.isNull(), F.lit("not numeric"))
        .when((number > -100) & (number < 100), F.lit("between -100 and 100"))
        .when(number != F.floor(number), F.lit("not whole"))
        .otherwise(F.lit(""))
    )


# --- value --------------------------------------------------------------------


def edge(prob: Column, odds: Column) -> Column:
    return prob - american_to_prob(odds)


def true_ev(p_win: Column, p_loss: Column, odds: Column) -> Column:
    """Expected profit per unit; a push returns the stake and adds nothing."""
    return p_win * profit_per_unit(odds) - p_loss


def novig_edge(p_side: Column, p_other: Column, odds_side: Column, odds_other: Column) -> Column:
    """Edge against the de-vigged price, conditional on the bet not pushing."""
    mine, theirs = american_to_prob_strict(odds_side), american_to_prob_strict(odds_other)
    return safe_div(p_side, p_side + p_other) - safe_div(mine, mine + theirs)


def devig_american(odds_side: Column, odds_other: Column) -> Column:
    mine, theirs = american_to_prob(odds_side), american_to_prob(odds_other)
    return safe_div(mine, mine + theirs)


def devig_decimal(price_side: Column, price_other: Column) -> Column:
    mine, theirs = 1.0 / price_side, 1.0 / price_other
    fair = mine / (mine + theirs)
    return F.when((price_side > 0) & (price_other > 0), fair)


def ladder_devig(price: Column, anchor_over: Column, anchor_under: Column) -> Column:
    """Strip the anchor pair's overround from a one-sided rung."""
    return (1.0 / price) / (1.0 / anchor_over + 1.0 / anchor_under)


# --- decisions ----------------------------------------------------------------


def ev_side(ev_over: Column, ev_under: Column, threshold: Column) -> Column:
    """OVER when it clears the bar and beats UNDER, else UNDER when that clears it."""
    return F.when((ev_over >= threshold) & (ev_over > ev_under), F.lit("OVER")).when(ev_under >= threshold, F.lit("UNDER"))


def recommendation(p_over: Column, odds_over: Column, odds_under: Column, threshold: float) -> Column:
    """EV rule per available price, probability rule when there is no price at all.

    An EV of exactly zero is a value, not a missing price.
    """
    ev_over = edge(p_over, odds_over)
    ev_under = edge(1.0 - p_over, odds_under)
    over_ok = F.coalesce(ev_over >= threshold, F.lit(False))
    under_ok = F.coalesce(ev_under >= threshold, F.lit(False))
    priced = ev_over.isNotNull() | ev_under.isNotNull()
    return (
        F.when(priced & over_ok & (~under_ok | (ev_over > ev_under)), F.lit("OVER"))
        .when(priced & under_ok, F.lit("UNDER"))
        .when(priced, F.lit("NO BET"))
        .when(p_over > 0.55, F.lit("OVER"))
        .when(p_over < 0.45, F.lit("UNDER"))
        .otherwise(F.lit("NO BET"))
    )


def best_ev(ev_over: Column, ev_under: Column) -> Column:
    return F.greatest(ev_over, ev_under)


def under_only(ev_under: Column, threshold: float) -> Column:
    return F.when(ev_under >= threshold, F.lit("UNDER"))


# --- grading ------------------------------------------------------------------


def grade(side: Column, line: Column, actual: Column) -> Column:
    return (
        F.when(line.isNull() | actual.isNull() | side.isNull(), F.lit(None).cast("string"))
        .when(actual == line, F.lit("PUSH"))
        .when((side == "OVER") == (actual > line), F.lit("WIN"))
        .otherwise(F.lit("LOSS"))
    )


def profit(result: Column, odds: Column, stake: Column, fallback_odds: int = -110) -> Column:
    price = F.coalesce(odds, F.lit(fallback_odds))
    return (
        F.when(result == "WIN", stake * (american_to_decimal(price) - 1.0))
        .when(result == "LOSS", -stake)
        .when(result == "PUSH", F.lit(0.0))
    )


def line_clv(side: Column, line_at_bet: Column, closing_line: Column) -> Column:
    """Positive when the market moved towards the bettor's side."""
    move = closing_line - line_at_bet
    return F.when(side == "OVER", move).otherwise(-move)


def prob_clv(bet_fair: Column, closing_fair: Column) -> Column:
    return closing_fair - bet_fair


def price_clv(bet_price: Column, closing_price: Column) -> Column:
    """Relative improvement of the decimal price held over the closing one."""
    return safe_div(bet_price, closing_price) - 1.0


def line_profit_sign(actual: Column, line: Column) -> Column:
    return F.signum(actual - line)


# --- buckets ------------------------------------------------------------------


def confidence_bucket(confidence: Column) -> Column:
    """Distance of a probability from one half, in five-point bands."""
    # fixed values: upper bound of each band and its label
    bands = [(0.05, "50-55%"), (0.10, "55-60%"), (0.15, "60-65%"), (0.20, "65-70%"), (0.25, "70-75%")]
    out = F.when(confidence.isNull(), F.lit(None).cast("string"))
    for upper, label in bands:
        out = out.when(confidence < upper, F.lit(label))
    return out.otherwise(F.lit("75%+"))


def sharpness_weight(odds_over: Column, odds_under: Column) -> Column:
    """Training weight by overround: tight books count more, wide ones less."""
    vig = american_to_prob(odds_over) + american_to_prob(odds_under) - 1.0
    return F.when(vig < 0.05, F.lit(1.5)).when(vig > 0.10, F.lit(0.8)).otherwise(F.lit(1.0))


def is_half_line(line: Column) -> Column:
    doubled = F.rint(line * 2.0)
    return (F.abs(line * 2.0 - doubled) < 1e-9) & (F.pmod(doubled, F.lit(2.0)) == 1.0)


def nearest_half(value: Column) -> Column:
    return F.bround(value * 2.0) / 2.0


def credit_cost(markets: Column, regions: Column, rate: float = 10.0) -> Column:
    """Credits of one odds request given comma lists of markets and regions."""

    def parts(c: Column) -> Column:
        return F.size(F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")))

    return (rate * parts(markets) * parts(regions)).cast("long")
