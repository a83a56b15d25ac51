"""Row-level feature families built on windowed columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.functions.odds import american_to_prob, is_half_line, safe_div
from formbook.operators.quality import require_no_leak


def at_least_one(c: Column) -> Column:
    return F.greatest(c, F.lit(1.0))


def line_relative(df: DataFrame, line: str, stat: str, windows: Sequence[int], min_std: float = 0.01) -> DataFrame:
    """Line minus rolling mean, and the same in rolling standard deviations."""
    out = {}
    for w in windows:
        gap, std = F.col(line) - F.col(f"{stat}_rolling_{w}"), F.col(f"{stat}_rolling_std_{w}")
        out[f"line_vs_rolling_{w}"] = gap
        out[f"line_z_score_{w}"] = F.when(std > min_std, gap / std).otherwise(F.lit(0.0))
    return df.withColumns(out)


def ratio_features(df: DataFrame, ratios: dict[str, tuple[str, str]]) -> DataFrame:
    """num / max(den, 1) for each named pair."""
    return df.withColumns({n: F.col(a) / at_least_one(F.col(b)) for n, (a, b) in ratios.items()})


def volatility_features(df: DataFrame, stat: str, line: str, windows: Sequence[int]) -> DataFrame:
    out = {}
    for w in windows:
        std = F.col(f"{stat}_rolling_std_{w}")
        out[f"{stat}_cv_{w}"] = std / at_least_one(F.col(f"{stat}_rolling_{w}"))
        out[f"volatility_vs_line_{w}"] = std / at_least_one(F.col(line))
    return df.withColumns(out)


def momentum(df: DataFrame, stats: Sequence[str], short: int = 3, long: int = 10) -> DataFrame:
    return df.withColumns({f"{s}_momentum": F.col(f"{s}_rolling_{short}") - F.col(f"{s}_rolling_{long}") for s in stats})


def matchup_context(df: DataFrame, line: str, own: str, opp_shots: str, opp_goals: str, rest: str, form: str) -> DataFrame:
    return df.withColumns(
        {
            "expected_workload_diff": F.col(opp_shots) - F.col(own),
            "line_vs_opp_implied": F.col(line) - (F.col(opp_shots) - F.col(opp_goals)),
            "rest_x_performance": F.least(F.col(rest), F.lit(7)) * F.col(form),
        }
    )


def market_features(df: DataFrame, line: str, mean: str, std: str, odds_over: str, odds_under: str,
                    high: float = 28.0, low: float = 22.0) -> DataFrame:
    """How far the market sits from recent form, its vig and fair prices, and line shape flags."""
    p_over, p_under = american_to_prob(F.col(odds_over)), american_to_prob(F.col(odds_under))
    gap = F.col(line) - F.col(mean)
    return df.withColumns(
        {
            "line_vs_recent_avg": gap,
            "line_vs_recent_avg_pct": safe_div(gap, F.col(mean)),
            "line_surprise_score": gap / (F.col(std) + 1e-6),
            "impl_prob_over": p_over,
            "impl_prob_under": p_under,
            "market_vig": p_over + p_under - 1.0,
            "fair_prob_over": p_over / (p_over + p_under),
            "fair_prob_under": p_under / (p_over + p_under),
            "line_is_half": F.coalesce(is_half_line(F.col(line)), F.lit(False)).cast("int"),
            "line_is_extreme_high": F.coalesce(F.col(line) >= high, F.lit(False)).cast("int"),
            "line_is_extreme_low": F.coalesce(F.col(line) <= low, F.lit(False)).cast("int"),
        }
    )


def combined(df: DataFrame, sums: dict[str, tuple[str, str]]) -> DataFrame:
    return df.withColumns({n: F.col(a) + F.col(b) for n, (a, b) in sums.items()})


def season_relative(df: DataFrame, rolling: str, average: str, std: str, prefix: str) -> DataFrame:
    gap = F.col(rolling) - F.col(average)
    return df.withColumns({f"{prefix}_vs_season": gap, f"{prefix}_season_z": safe_div(gap, F.col(std))})


def orient_market(df: DataFrame, is_home: str, home_prob: str, total: str) -> DataFrame:
    """Home-based market state seen from the row's own team."""
    home = F.col(is_home) == 1
    own = F.when(home, F.col(home_prob)).otherwise(1.0 - F.col(home_prob))
    return df.withColumns(
        {
            "own_win_prob": own,
            "opp_win_prob": 1.0 - own,
            "favourite_strength": F.abs(own - 0.5),
            "expected_goals_for": F.col(total) * own,
            "expected_goals_against": F.col(total) * (1.0 - own),
        }
    )


def attempt_funnel(df: DataFrame, off_att: str, def_att: str, off_unb: str, def_unb: str, opp_sog: str, team_sog: str,
                   league_att: str, league_frac: str, league_sog: str, league_unb: str, share: str) -> DataFrame:
    """Attempts to unblocked to shots on goal to starter exposure, each relative to the league so far."""
    c = F.col
    attempts = safe_div(c(off_att) * c(def_att), c(league_att))
    off_frac, def_frac = safe_div(c(off_unb), c(off_att)), safe_div(c(def_unb), c(def_att))
    unblocked = safe_div(attempts * off_frac * def_frac, c(league_frac))
    conv = safe_div(c(league_sog), c(league_unb))
    opp_rel, team_rel = safe_div(safe_div(c(opp_sog), c(off_unb)), conv), safe_div(safe_div(c(team_sog), c(def_unb)), conv)

    def clip(x: Column) -> Column:
        return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.5)), F.lit(2.0)))

    return (
        df.withColumns(
            {
                "expected_attempts": attempts,
                "expected_unblocked": unblocked,
                "league_conversion": conv,
                "opp_conversion_rel": opp_rel,
                "team_conversion_rel": team_rel,
            }
        )
        .withColumn("mu_league", c("expected_unblocked") * c("league_conversion") * c(share))
        .withColumn("mu_adjusted", c("mu_league") * F.sqrt(clip(c("opp_conversion_rel")) * clip(c("team_conversion_rel"))))
    )


# fixed value: shots per sixty minutes used where no prior rate exists
OFFSET_FALLBACK_RATE = 30.0


def fixed_offset(df: DataFrame, rate: str) -> DataFrame:
    """Log rate used as a model offset, with a flagged constant where the rate is missing."""
    return df.withColumns(
        {
            "offset_fallback": F.col(rate).isNull().cast("int"),
            "offset_rate": F.coalesce(F.col(rate), F.lit(OFFSET_FALLBACK_RATE)),
            "offset_log": F.log(F.greatest(F.coalesce(F.col(rate), F.lit(OFFSET_FALLBACK_RATE)), F.lit(1e-3))),
        }
    )


def targets(df: DataFrame, actual: str, line: str) -> DataFrame:
    margin = F.col(actual) - F.col(line)
    return df.withColumns({"over_hit": (margin > 0).cast("int"), "line_margin": margin, "margin_sign": F.signum(margin)})


def select_features(df: DataFrame, ids: Sequence[str], forbidden: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Numeric columns that are neither identifiers nor known only after the game."""
    numeric = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    names = [n for n, t in df.dtypes if t in numeric and n not in ids and n not in forbidden]
    return require_no_leak(df.select(*keep, *[n for n in names if n not in keep]), forbidden)


def align_schema(df: DataFrame, names: Sequence[str], fill: float | None = None) -> DataFrame:
    """Exactly these columns in this order; absent ones become NULL or ``fill``."""
    filler = F.lit(fill).cast("double")
    return df.select(*[F.col(n) if n in df.columns else filler.alias(n) for n in names])


def one_hot(df: DataFrame, column: str, values: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumns(
        {f"{prefix}_{v}": F.coalesce(F.col(column) == v, F.lit(False)).cast("int") for v in values}
    )


def fill_missing(df: DataFrame, constants: dict[str, float], default: float | None = None, columns: Sequence[str] = ()) -> DataFrame:
    out = df.na.fill(constants) if constants else df
    rest = [c for c in columns if c not in constants]
    return out.na.fill(default, rest) if default is not None and rest else out


def shot_shares(df: DataFrame, shots_for: str, blocks_for: str, shots_against: str, blocks_against: str) -> DataFrame:
    """Attempts with and without blocks, and their share; one half of nothing counts as 0.5."""
    corsi_for = F.col(shots_for) + F.col(blocks_against)
    corsi_against = F.col(shots_against) + F.col(blocks_for)

    def share(a: Column, b: Column) -> Column:
        total = a + b
        return a / F.when(total == 0, F.lit(1)).otherwise(total)

    return df.withColumns(
        {
            "corsi_for": corsi_for,
            "corsi_against": corsi_against,
            "corsi_for_pct": share(corsi_for, corsi_against),
            "fenwick_for": F.col(shots_for),
            "fenwick_against": F.col(shots_against),
            "fenwick_for_pct": share(F.col(shots_for), F.col(shots_against)),
        }
    )
