"""Chronological splits, threshold and policy sweeps, and study verdicts.

Roles, thresholds and policies are small declared tables; a sweep expands each row into
its declared candidates and aggregates them in the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.functions.odds import edge, ev_side, grade, novig_edge, profit, safe_div, true_ev
from formbook.operators.bootstrap import cluster_bootstrap
from formbook.operators.grading import summary_columns
from formbook.operators.quality import GateFailed
from formbook.operators.skew import DEFAULT_RULE, SplitRule, join_back, row_numbers
from formbook.operators.windows import first_per_key

# --- splits ---------------------------------------------------------------------


def date_split(df: DataFrame, date: str, bounds: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Label rows by inclusive date ranges; ranges must not overlap."""
    ordered = sorted(bounds, key=lambda b: b[1])
    for (_, _, end), (_, start, _) in zip(ordered, ordered[1:]):
        if start <= end:
            raise GateFailed(f"split ranges overlap at {start}")
    out = F.lit(None).cast("string")
    for label, start, end in bounds:
        inside = F.to_date(date).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        out = F.when(inside, F.lit(label)).otherwise(out)
    return df.withColumn("split", out)


def split_report(df: DataFrame, date: str) -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(F.to_date(date)).alias("first_date"), F.max(F.to_date(date)).alias("last_date")
    )


def _label(share: Column, cuts: Sequence[tuple[str, float]]) -> Column:
    out = F.lit(cuts[-1][0])
    for label, upper in reversed(list(cuts)[:-1]):
        out = F.when(share < upper, F.lit(label)).otherwise(out)
    return out


def fraction_split(df: DataFrame, date: str, cuts: Sequence[tuple[str, float]]) -> DataFrame:
    """Chronological fractions that keep whole dates together.

    Shares come from one count per calendar date, so no row is globally ranked.
    """
    daily = df.groupBy(F.to_date(date).alias("__day")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1))
    share = F.coalesce(before, F.lit(0)) / F.sum("__n").over(Window.partitionBy())
    labels = daily.select("__day", _label(share, cuts).alias("split"))
    return join_back(df.withColumn("__day", F.to_date(date)), labels, ["__day"]).drop("__day")


def fraction_split_rows(df: DataFrame, order: Sequence[str], cuts: Sequence[tuple[str, float]], rule: SplitRule = DEFAULT_RULE) -> DataFrame:
    """Chronological fractions by exact row rank."""
    ranked = row_numbers(df, [], [F.col(o) for o in order], "__rn", rule)
    total = df.agg(F.count(F.lit(1))).scalar()
    out = F.lit(cuts[-1][0])
    for label, upper in reversed(list(cuts)[:-1]):
        out = F.when(F.col("__rn") <= F.floor(F.col("__total") * upper), F.lit(label)).otherwise(out)
    return ranked.withColumn("__total", total).withColumn("split", out).drop("__rn", "__total")


def _roles(df: DataFrame, season: str, roles: Sequence[tuple[str, object, str]]) -> DataFrame:
    """Each row once per (fold, role) of its season, from a declared table of roles."""
    by_season: dict[object, list[Column]] = {}
    for fold, value, role in roles:
        by_season.setdefault(value, []).append(F.struct(F.lit(fold).alias("fold"), F.lit(role).alias("role")))
    none = F.array().cast("array<struct<fold:string,role:string>>")
    out = none
    for value, structs in by_season.items():
        out = F.when(F.col(season) == F.lit(value), F.array(*structs)).otherwise(out)
    return df.select("*", F.inline(out))


def walk_forward(df: DataFrame, season: str, seasons: Sequence, min_train: int = 1) -> DataFrame:
    """Expanding folds: every season after the first ``min_train`` is tested on those before it."""
    roles = []
    for i, test in enumerate(seasons):
        if i >= min_train:
            roles += [(f"test_{test}", s, "train") for s in seasons[:i]] + [(f"test_{test}", test, "test")]
    return _roles(df, season, roles)


def rolling_origin(df: DataFrame, season: str, date: str, seasons: Sequence, val_days: int) -> DataFrame:
    """Like the expanding folds, with the last days of each training pool held out as ``val``."""
    folds = walk_forward(df, season, seasons)
    ends = folds.where("role = 'train'").groupBy("fold").agg(F.max(F.to_date(date)).alias("__end"))  # one row per fold
    held = (F.col("role") == "train") & (F.to_date(date) > F.date_sub("__end", val_days))
    return folds.join(F.broadcast(ends), "fold").withColumn("role", F.when(held, F.lit("val")).otherwise(F.col("role"))).drop("__end")


# --- decide and grade -------------------------------------------------------------


def decide_and_grade(df: DataFrame, threshold: Column, stake: Column | None = None) -> DataFrame:
    """Apply the EV rule and grade the chosen side; rows without a bet have NULL ``bet``.

    Expects p_over, p_under, odds_over, odds_under, line and actual.
    """
    ev_o, ev_u = edge(F.col("p_over"), F.col("odds_over")), edge(F.col("p_under"), F.col("odds_under"))
    out = df.withColumns({"ev_over": ev_o, "ev_under": ev_u}).withColumn(
        "bet", ev_side(F.col("ev_over"), F.col("ev_under"), threshold)
    )
    over = F.col("bet") == "OVER"
    out = out.withColumns(
        {
            "bet_odds": F.when(over, F.col("odds_over")).when(F.col("bet") == "UNDER", F.col("odds_under")),
            "bet_ev": F.when(over, F.col("ev_over")).when(F.col("bet") == "UNDER", F.col("ev_under")),
            "bet_result": grade(F.col("bet"), F.col("line"), F.col("actual")),
            "bet_stake": F.when(F.col("bet").isNotNull(), F.lit(1.0) if stake is None else stake),
        }
    )
    return out.withColumn("bet_profit", profit(F.col("bet_result"), F.col("bet_odds"), F.col("bet_stake")))


def fold_summary(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Graded bets per group with the share of candidate rows bet; pushes are not counted as bets."""
    counted = F.col("bet_result").isin("WIN", "LOSS")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(counted).alias("bets"),
        F.count_if(F.col("bet_result") == "PUSH").alias("pushes"),
        F.avg(F.when(counted, (F.col("bet_result") == "WIN").cast("double"))).alias("hit_rate"),
        F.coalesce(F.sum(F.when(counted, F.col("bet_profit"))), F.lit(0.0)).alias("profit_total"),
        F.coalesce(safe_div(F.sum(F.when(counted, F.col("bet_profit"))), F.count_if(counted)) * 100.0, F.lit(0.0)).alias("roi"),
        (F.count_if(counted) * 100.0 / F.count(F.lit(1))).alias("bet_rate"),
    )


def threshold_sweep(df: DataFrame, grid: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Summary per threshold from one pass over the rows."""
    spread = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in grid])))
    return fold_summary(decide_and_grade(spread, F.col("threshold")), [*by, "threshold"])


def best_threshold(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Highest ROI inside the 15-35 percent bet-rate band, else 10-40, else anywhere."""
    rate = F.col("bet_rate")
    band = F.when(rate.between(15, 35), F.lit(2)).when(rate.between(10, 40), F.lit(1)).otherwise(F.lit(0))
    best = F.max_by(F.struct("threshold", "bets", "bet_rate", "roi", band.alias("band")), F.struct(band, "roi", -F.col("threshold")))
    return sweep.groupBy(*by).agg(best.alias("__b")).select(*by, "__b.*")


def smallest_confirmed(sweep: DataFrame, lower: str, n: str, min_n: int, mean: str) -> DataFrame:
    """Smallest threshold with a positive lower bound; else the best mean; else the most bets."""
    enough = F.col(n) >= min_n
    tier = F.when(enough & (F.col(lower) > 0), F.lit(2)).when(enough, F.lit(1)).otherwise(F.lit(0))
    key = F.when(tier == 2, -F.col("threshold")).when(tier == 1, F.coalesce(F.col(mean), F.lit(-999.0))).otherwise(F.col(n).cast("double"))
    status = F.when(tier == 2, F.lit("confirmed")).when(tier == 1, F.lit("unresolved")).otherwise(F.lit("insufficient"))
    best = F.max_by(F.struct("threshold", status.alias("status"), n, mean, lower), F.struct(tier, key, -F.col("threshold")))
    return sweep.agg(best.alias("__b")).select("__b.*")


def highest_lower_bound(sweep: DataFrame, lower: str, eligible: Column, by: Sequence[str] = ()) -> DataFrame:
    """Highest interval lower bound among eligible rows; the larger threshold breaks ties."""
    best = F.max_by(F.struct("threshold", lower), F.struct(F.col(lower), F.col("threshold")))
    return sweep.where(eligible).groupBy(*by).agg(best.alias("__b")).select(*by, "__b.*")


def smallest_error(grid: DataFrame, config: str, error: str, then: str) -> DataFrame:
    """Configuration with the smallest error, the second measure and the name breaking ties."""
    best = F.min_by(F.struct(config, error, then), F.struct(error, then, config))
    return grid.agg(best.alias("__b")).select("__b.*")


ARMS = ("both", "under_only")


def arm_bets(df: DataFrame, thresholds: Sequence[float] | None = None, picked: DataFrame | None = None) -> DataFrame:
    """Every row decided and graded per arm, at each of ``thresholds`` or at the arm's ``picked`` one; the UNDER-only arm never sees an OVER price."""
    if picked is None:
        table = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(float(t)).alias("threshold")) for a in ARMS for t in thresholds])
        spread = df.select("*", F.inline(table))
    else:
        spread = df.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in ARMS]))).join(F.broadcast(picked), "arm")  # a row per arm
    return decide_and_grade(spread.withColumn("p_over", F.when(F.col("arm") == "both", F.col("p_over"))), F.col("threshold"))


def pick_arm_thresholds(sweep: DataFrame, min_bets: int, fallback: float) -> DataFrame:
    """Per arm the threshold of the best ROI among those with ``min_bets`` bets, the smaller on a tie; ``fallback`` where there is none."""
    best = F.max_by(F.when(F.col("bets") >= min_bets, F.col("threshold")), F.when(F.col("bets") >= min_bets, F.struct("roi", -F.col("threshold"))))
    return sweep.groupBy("arm").agg(F.coalesce(best, F.lit(float(fallback))).alias("threshold"))


def two_arm_report(test: DataFrame, picked: DataFrame, row_id: Sequence[str], cluster: Sequence[str], resamples: int, seed: str) -> DataFrame:
    """One look at the test rows: per arm and side bets, hit rate, ROI and share of rows bet, with row and cluster intervals of the ROI."""
    graded = arm_bets(test, picked=picked)
    sides = F.array(F.lit("ALL"), F.coalesce("bet", F.lit("NONE")))
    by = ["arm", "threshold", "side"]
    long = graded.withColumn("side", F.explode(sides)).where("side <> 'NONE'")
    decided = long.where(F.col("bet_result").isin("WIN", "LOSS"))
    n_test = graded.groupBy("arm").agg(F.count(F.lit(1)).alias("__n_test"))
    summary = fold_summary(long, by).join(F.broadcast(n_test), "arm").withColumn("bet_rate", F.col("bets") * 100.0 / F.col("__n_test"))
    out = summary.select(*by, "bets", "hit_rate", "roi", "bet_rate")
    for name, unit in (("row", row_id), ("cluster", cluster)):
        ci = cluster_bootstrap(decided, unit, F.col("bet_profit"), F.lit(1.0), resamples, seed, by, 100.0)
        ci = ci.select(*by, F.col("lower").alias(f"{name}_lower"), F.col("upper").alias(f"{name}_upper"), F.col("n_clusters").alias(f"n_{name}s"))
        out = out.join(F.broadcast(ci), by, "left")  # a row per arm and side
    return out


# --- policies -----------------------------------------------------------------------


@dataclass(frozen=True)
class Policy:
    name: str
    family: str
    min_score: float
    min_novig: float = -10.0
    line_shop: bool = False


def policy_grid() -> list[Policy]:
    # fixed values: the thresholds of each policy family
    grid = [Policy(f"old_prob_edge_{e:.2f}", "probability_edge", e) for e in (0.05, 0.10, 0.12, 0.15)]
    grid += [Policy(f"true_ev_{e:.2f}", "true_ev", e) for e in (0.00, 0.02, 0.04, 0.06)]
    grid += [Policy(f"true_ev_{e:.2f}_cond_edge_{c:.2f}", "true_ev", e, c) for e in (0.00, 0.02, 0.04) for c in (0.00, 0.02, 0.04)]
    grid += [Policy(f"line_shop_true_ev_{e:.2f}", "true_ev", e, line_shop=True) for e in (0.00, 0.02, 0.04)]
    return grid


def side_scores(df: DataFrame) -> DataFrame:
    """True EV, probability edge and no-vig edge of both sides.

    A side whose price or probability is unusable has a NULL no-vig edge and is never bet.
    """
    out = {}
    for side, p, q, mine, other in (
        ("over", "p_over", "p_under", "odds_over", "odds_under"), ("under", "p_under", "p_over", "odds_under", "odds_over")
    ):
        out[f"true_ev_{side}"] = true_ev(F.col(p), F.col(q), F.col(mine))
        out[f"prob_edge_{side}"] = edge(F.col(p), F.col(mine))
        out[f"novig_edge_{side}"] = novig_edge(F.col(p), F.col(q), F.col(mine), F.col(other))
    return df.withColumns(out)


def apply_policies(df: DataFrame, policies: Sequence[Policy], row_id: Sequence[str], cluster: Sequence[str]) -> DataFrame:
    """Chosen side per (policy, row); line-shop policies keep the best quote per cluster.

    Both sides' scores are made once per row, then the declared policies are laid over it.
    OVER wins an exact tie of score, true EV and probability edge.
    """
    scored = side_scores(df)
    plain = _lay_over(scored, [p for p in policies if not p.line_shop], df.columns)
    shops = [p for p in policies if p.line_shop]
    if not shops:
        return plain
    best_first = [F.desc(c) for c in ("true_ev", "score", "novig_edge", *row_id)]
    shopped = first_per_key(_lay_over(scored, shops, df.columns), ["policy", *cluster], best_first)
    return plain.unionByName(shopped)


def _lay_over(scored: DataFrame, policies: Sequence[Policy], keep: Sequence[str]) -> DataFrame:
    """Rows each policy bets, with the chosen side's scores and price."""
    table = F.array(
        *[
            F.struct(
                F.lit(p.name).alias("policy"), F.lit(p.family).alias("family"), F.lit(float(p.min_score)).alias("min_score"),
                F.lit(float(p.min_novig)).alias("min_novig"),
            )
            for p in policies
        ]
    )
    spread = scored.select("*", F.inline(table))

    def score(side: str) -> Column:
        return F.when(F.col("family") == "probability_edge", F.col(f"prob_edge_{side}")).otherwise(F.col(f"true_ev_{side}"))

    spread = spread.withColumns({"score_over": score("over"), "score_under": score("under")})

    def usable(side: str) -> Column:
        ok = (F.col(f"score_{side}") >= F.col("min_score")) & (F.col(f"novig_edge_{side}") >= F.col("min_novig"))
        return F.coalesce(ok, F.lit(False))

    def rank(side: str) -> Column:
        return F.struct(*[F.col(f"{m}_{side}").alias(m) for m in ("score", "true_ev", "prob_edge")])

    over = usable("over") & (~usable("under") | (rank("over") >= rank("under")))
    marked = spread.withColumn("bet", F.when(over, F.lit("OVER")).when(usable("under"), F.lit("UNDER"))).where("bet is not null")

    def chosen(measure: str) -> Column:
        return F.when(F.col("bet") == "OVER", F.col(f"{measure}_over")).otherwise(F.col(f"{measure}_under"))

    return marked.select(
        *keep, "policy", "bet", *[chosen(m).alias(m) for m in ("true_ev", "prob_edge", "novig_edge", "score")],
        chosen("odds").cast("double").alias("bet_odds"),
    )


def grade_choices(chosen: DataFrame) -> DataFrame:
    result = grade(F.col("bet"), F.col("line"), F.col("actual"))
    graded = chosen.withColumn("bet_result", result).withColumn("bet_stake", F.lit(1.0))
    return graded.withColumn("bet_profit", profit(F.col("bet_result"), F.col("bet_odds"), F.col("bet_stake")))


def policy_report(graded: DataFrame, by: Sequence[str]) -> DataFrame:
    return graded.groupBy(*by).agg(*summary_columns("bet_result", "bet_profit", "bet_stake"))


# --- verdicts ----------------------------------------------------------------------


def study_verdict(n: Column, min_n: int, lower: Column, upper: Column, degenerate_share: Column, max_degenerate: float = 0.01) -> Column:
    """INSUFFICIENT, UNSTABLE, PASS or FAIL from sample size, empty draws and the interval."""
    return (
        F.when(n < min_n, F.lit("INSUFFICIENT"))
        .when(degenerate_share > max_degenerate, F.lit("UNSTABLE"))
        .when(lower > 0, F.lit("PASS"))
        .otherwise(F.lit("FAIL"))
    )


def pooled_verdict(folds: DataFrame, estimate: str, pooled_lower: Column) -> DataFrame:
    """Positive in every fold and a pooled interval above zero."""
    return folds.agg(
        F.count(F.lit(1)).alias("n_folds"), F.min(estimate).alias("worst_fold"), F.max(pooled_lower).alias("pooled_lower")
    ).withColumn("verdict", F.when((F.col("worst_fold") > 0) & (F.col("pooled_lower") > 0), F.lit("PASS")).otherwise(F.lit("FAIL")))


def pair_table(df: DataFrame, game: Sequence[str], rank: Sequence[str], outcome: str) -> DataFrame:
    """The two outcomes of every two-row game side by side, first by ``rank``."""
    key = F.struct(*rank)
    return (
        df.groupBy(*game)
        .agg(F.count(F.lit(1)).alias("__n"), F.min_by(outcome, key).alias("first_outcome"), F.max_by(outcome, key).alias("second_outcome"))
        .where("__n = 2")
        .drop("__n")
    )
