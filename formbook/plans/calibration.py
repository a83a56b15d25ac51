"""Probabilities calibrated on one stretch of time, chosen on the next, bet on the last."""

from __future__ import annotations

from pyspark.sql import functions as F

from formbook.functions.odds import devig_american
from formbook.operators import backtest as bt
from formbook.operators import models as md
from formbook.operators import stats as st
from formbook.operators.isotonic import BLOCKS, apply_steps, isotonic_steps
from formbook.plans.frames import BET_ID, BETS, bets, prob_sql, with_sql
from formbook.plans.registry import query
from formbook.plans.resampling import CI_SQL, RESAMPLES, draws_sql
from formbook.plans.studies import decided_sql
from formbook.session import checkpointed

c = F.col
# cal-fit, cal-select and test, in order of time
FOLDS = [("train", "1995-01-01", "1999-12-31"), ("fit", "2000-01-01", "2000-06-30"), ("select", "2000-07-01", "2000-12-31"), ("test", "2001-01-01", "2001-12-31")]
FOLD_SQL = "CASE WHEN bet_date <= DATE '1999-12-31' THEN 'train' WHEN bet_date <= DATE '2000-06-30' THEN 'fit' WHEN bet_date <= DATE '2000-12-31' THEN 'select' ELSE 'test' END"
THRESHOLDS = [0.0, 0.02, 0.04, 0.06, 0.08, 0.10, 0.12, 0.15]
MIN_BETS, FALLBACK = 100, 0.08


def forecasts(spark, d):
    """Bets with a raw score, the market's fair price and the outcome, by fold."""
    b = bets(spark, d).withColumns(
        {"y": (c("actual") > c("line")).cast("double"), "raw": c("amount") / 120000.0, "market": devig_american(c("odds_over"), c("odds_under"))}
    )
    return bt.date_split(b, "bet_date", FOLDS)


FORECASTS = f"""forecasts AS (SELECT *, CAST(actual > line AS DOUBLE) AS y, amount / 120000.0 AS raw, {FOLD_SQL} AS split FROM bets)"""


def steps_sql(source: str, score: str, label: str) -> list[str]:
    """CTEs of the steps: the lower hull of (rows, hits) summed up by score, one corner after the other."""
    return [
        f"lv AS (SELECT {score} AS s, count(*) AS n, sum({label})::BIGINT AS t FROM {source} WHERE {score} IS NOT NULL AND {label} IS NOT NULL GROUP BY 1)",
        "cum AS MATERIALIZED (SELECT s, sum(n) OVER o AS x, sum(t) OVER o AS h, lead(s) OVER o AS after FROM lv WINDOW o AS (ORDER BY s))",
        """hull(x, h, high, low) AS (SELECT 0::HUGEINT, 0::HUGEINT, NULL::DOUBLE, (SELECT min(s) FROM cum)
    UNION ALL SELECT best.x, best.h, best.s, best.after FROM
      (SELECT arg_min({'x': cum.x, 'h': cum.h, 's': cum.s, 'after': cum.after}, ((cum.h - hull.h)::DOUBLE / (cum.x - hull.x)::DOUBLE, -cum.x)) AS best FROM hull JOIN cum ON cum.x > hull.x GROUP BY hull.x))""",
        """pools AS (SELECT lag(low) OVER o AS low, high, (x - lag(x) OVER o)::DOUBLE AS weight, (h - lag(h) OVER o)::DOUBLE / (x - lag(x) OVER o)::DOUBLE AS value, x FROM hull WINDOW o AS (ORDER BY x))""",
        """steps AS (SELECT CASE WHEN row_number() OVER o = 1 THEN '-infinity'::DOUBLE ELSE low END AS start, low, high, weight, value, lead(low) OVER o AS next_low, lead(value) OVER o AS next_value
    FROM pools WHERE low IS NOT NULL AND high IS NOT NULL WINDOW o AS (ORDER BY x))""",
    ]


def applied_sql(source: str, score: str, where: str) -> str:
    return f"""calibrated AS (SELECT f.*, CASE WHEN {score} <= steps.high OR steps.next_low IS NULL THEN value ELSE value + (next_value - value) * ({score} - steps.high) / (next_low - steps.high) END AS cal
    FROM (SELECT * FROM {source} WHERE {where}) f ASOF JOIN steps ON f.{score} >= steps.start)"""


def recursive(*ctes: str) -> str:
    return with_sql(*ctes).replace("WITH ", "WITH RECURSIVE ", 1)


_FIT = "fitted_on AS (SELECT * FROM forecasts WHERE split = 'fit')"
_STEPS = (BETS, FORECASTS, _FIT, *steps_sql("fitted_on", "raw", "y"))


@query("f5_isotonic_steps", recursive(*_STEPS) + "SELECT low, high, weight, value FROM steps")
def f5_steps(spark, d):
    return isotonic_steps(forecasts(spark, d).where("split = 'fit'"), "raw", "y").select("low", "high", "weight", "value")


@query(
    "f5_isotonic_brier",
    recursive(*_STEPS, applied_sql("forecasts", "raw", "split <> 'train'"))
    + """SELECT split, count(*) AS n_rows, avg((raw - y) * (raw - y)) AS brier_raw, avg((cal - y) * (cal - y)) AS brier_cal, avg(cal) AS mean_cal, avg(y) AS hit_rate FROM calibrated GROUP BY 1""",
)
def f5_brier(spark, d):
    """Raw and calibrated Brier scores on the rows fitted on and on later ones."""
    rows = forecasts(spark, d).where("split <> 'train'").select(*BET_ID, "split", "raw", "y")
    scored = apply_steps(rows, isotonic_steps(rows.where("split = 'fit'"), "raw", "y"), "raw", "cal", BET_ID)
    return scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(st.brier(c("raw"), c("y"))).alias("brier_raw"), F.avg(st.brier(c("cal"), c("y"))).alias("brier_cal"),
        F.avg("cal").alias("mean_cal"), F.avg("y").alias("hit_rate"),
    )


def calibrated(rows):
    """Rows after the training fold with Platt, isotonic, the better of the two on the select fold (``cal``), and the blend of it with the market."""
    fit = rows.where("split = 'fit'")
    platt = md.fit_platt(fit, "raw", "y")
    # the blend's fit, the choice and the reports all read these rows
    scored = checkpointed(apply_steps(md.apply_platt(rows, platt, "raw", "platt"), isotonic_steps(fit, "raw", "y"), "raw", "isotonic", BET_ID))
    errors = scored.where("split = 'select'").agg(*[F.avg(st.brier(c(k), c("y"))).alias(k) for k in ("isotonic", "platt")])
    better = errors.select(F.when(c("platt") < c("isotonic"), F.lit("platt")).otherwise(F.lit("isotonic"))).scalar()
    scored = scored.withColumn("chosen", better).withColumn("cal", F.when(c("chosen") == "platt", c("platt")).otherwise(c("isotonic")))
    blend = md.fit_blend(scored.where("split = 'fit'"), "cal", "market", "y")
    return md.probability(scored, blend, "blend")


@query("f5_calibration_selected_by_brier")
def f5(spark, d):
    """Raw, Platt, isotonic, market and fitted-blend probabilities: fitted on the first half of validation, the calibrator selected
    by Brier on the second half, Brier and AUC reported on both that and test."""
    rows = forecasts(spark, d).where("split <> 'train'").select(*BET_ID, "split", "raw", "market", "y")
    names = ["raw", "platt", "isotonic", "market", "blend"]
    scored = calibrated(rows).where("split <> 'fit'")
    long = scored.select("split", "y", "chosen", F.inline(F.array(*[F.struct(F.lit(n).alias("candidate"), c(n).cast("double").alias("p")) for n in names])))
    errors = long.groupBy("split", "candidate", "chosen").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(st.brier(c("p"), c("y"))).alias("brier"))
    out = errors.join(st.roc_auc(long, ["split", "candidate"], "p", "y", BLOCKS).drop("n_pos", "n_neg"), ["split", "candidate"])
    return out.withColumn("selected", (c("candidate") == c("chosen")).cast("int")).drop("chosen")


def two_arms(scored, resamples=RESAMPLES):
    """Thresholds picked per arm on the select fold, then one report on test; ``cal`` is the probability bet on."""
    priced = scored.withColumns({"p_over": c("cal"), "p_under": 1.0 - c("cal")})
    sweep = bt.fold_summary(bt.arm_bets(priced.where("split = 'select'"), THRESHOLDS), ["arm", "threshold"])
    picked = bt.pick_arm_thresholds(sweep, MIN_BETS, FALLBACK)
    return bt.two_arm_report(priced.where("split = 'test'"), picked, BET_ID[:4], ["game_id"], resamples, "arms")


@query("b22_calibrated_two_arm_policy")
def b22(spark, d):
    """The calibrator chosen by Brier, thresholds per arm on the select fold, test touched once, with row and cluster intervals."""
    return two_arms(calibrated(forecasts(spark, d).where("split <> 'train'")))


_ARMS = f"""offered AS (SELECT c.* EXCLUDE (p_over, p_under), arm, CASE WHEN arm = 'both' THEN cal END AS p_over, 1.0 - cal AS p_under FROM calibrated c CROSS JOIN (VALUES ('both'), ('under_only')) a(arm))"""
_DECIDED = decided_sql(THRESHOLDS).replace("FROM bets CROSS JOIN t", "FROM offered AS bets CROSS JOIN t")
_HELD = "(res IN ('WIN', 'LOSS'))"


def _ci_sql(name: str, key: str) -> list[str]:
    """Interval CTEs under names of their own."""
    drawn = draws_sql(f"per_{name}", key, "arms")
    for cte in ("hashed", "drawn", "weighted"):
        drawn = drawn.replace(f"{cte} AS (", f"{cte}_{name} AS (").replace(f"FROM {cte}", f"FROM {cte}_{name}").replace(f"{cte}.*", f"{cte}_{name}.*")
    return [
        f"per_{name} AS (SELECT arm, threshold, side, {key} AS unit, sum(pr) AS num, count(*)::DOUBLE AS den FROM sided WHERE {_HELD} GROUP BY ALL)",
        drawn.replace(f"|| {key})", "|| unit)"),
        f"reps_{name} AS (SELECT arm, side, resample, sum(w * num) / nullif(sum(w * den), 0) * 100 AS s, count(*) AS units FROM weighted_{name} GROUP BY ALL)",
        f"ci_{name} AS (SELECT arm, side, {CI_SQL}, max(units) AS units FROM reps_{name} GROUP BY ALL)",
    ]


_UNIT = "concat_ws('_', game_id, seq, entity_id, venue)"


@query(
    "b22_isotonic_two_arm_policy",
    recursive(
        *_STEPS, applied_sql("forecasts", "raw", "split IN ('select', 'test')"), _ARMS, _DECIDED,
        f"sweep AS (SELECT arm, threshold, count(*) FILTER {_HELD.replace('(res', '(WHERE res')} AS bets, coalesce(sum(pr) FILTER (WHERE res IN ('WIN', 'LOSS')) / nullif(count(*) FILTER (WHERE res IN ('WIN', 'LOSS')), 0) * 100, 0) AS roi FROM decided WHERE split = 'select' GROUP BY ALL)",
        f"picked AS (SELECT arm, coalesce(arg_max(threshold, (roi, -threshold)) FILTER (WHERE bets >= {MIN_BETS}), {FALLBACK}) AS threshold FROM sweep GROUP BY 1)",
        "held AS (SELECT decided.* FROM decided JOIN picked USING (arm, threshold) WHERE split = 'test')", "size AS (SELECT arm, count(*) AS n_test FROM held GROUP BY 1)",
        "sided AS (SELECT * EXCLUDE (side), 'ALL' AS side FROM held UNION ALL SELECT * EXCLUDE (side), bet AS side FROM held WHERE bet IS NOT NULL)",
        """summary AS (SELECT arm, threshold, side, count(*) FILTER (WHERE res IN ('WIN', 'LOSS')) AS bets, avg(CAST(res = 'WIN' AS DOUBLE)) FILTER (WHERE res IN ('WIN', 'LOSS')) AS hit_rate,
        coalesce(sum(pr) FILTER (WHERE res IN ('WIN', 'LOSS')) / nullif(count(*) FILTER (WHERE res IN ('WIN', 'LOSS')), 0) * 100, 0) AS roi FROM sided GROUP BY ALL)""",
        *_ci_sql("row", _UNIT), *_ci_sql("cluster", "game_id"),
    )
    + """SELECT s.arm, s.threshold, s.side, s.bets, hit_rate, roi, s.bets * 100.0::DOUBLE / n_test AS bet_rate, r.lower AS row_lower, r.upper AS row_upper, r.units AS n_rows,
      k.lower AS cluster_lower, k.upper AS cluster_upper, k.units AS n_clusters
    FROM summary s JOIN size USING (arm) LEFT JOIN ci_row r ON r.arm = s.arm AND r.side = s.side LEFT JOIN ci_cluster k ON k.arm = s.arm AND k.side = s.side""",
)
def b22_isotonic(spark, d):
    """The same policy with the isotonic calibrator whatever the select fold says."""
    rows = forecasts(spark, d).where("split <> 'train'")
    return two_arms(apply_steps(rows.where("split <> 'fit'"), isotonic_steps(rows.where("split = 'fit'"), "raw", "y"), "raw", "cal", BET_ID))
