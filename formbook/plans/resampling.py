"""Cluster bootstraps, paired deltas, drift, empirical residual prices; Q11."""

from __future__ import annotations

from pyspark.sql import functions as F

from formbook.functions.odds import devig_american
from formbook.operators import bootstrap as bs
from formbook.operators import quality as ql
from formbook.operators import stats as st
from formbook.plans.frames import BETS, PAIRS, bets, prob_sql, table, with_sql
from formbook.plans.quotes import pairs
from formbook.plans.registry import query

# SQL repeats every cluster B times; the operators' own default is what a study draws
RESAMPLES = 1000
_P = 2147483647


def draws_sql(source: str, key: str, seed: str = "form", b: int = RESAMPLES) -> str:
    """CTE giving the Poisson weight of every (cluster row, resample)."""
    bounds = [f"{x!r}::DOUBLE" for x in bs._POISSON_ONE]
    cases = " ".join(f"WHEN u < {x} THEN {k}" for k, x in enumerate(bounds))
    return f"""hashed AS (SELECT *, ('0x' || substr(md5('{seed}|' || {key}), 1, 8))::BIGINT % {_P} AS ha, ('0x' || substr(md5('{seed}|' || {key}), 9, 8))::BIGINT % {_P} AS hc FROM {source}),
    drawn AS (SELECT hashed.*, r.b AS resample, ((ha * r.b + hc) % {_P}) / {_P}.0::DOUBLE AS u FROM hashed, (SELECT unnest(range(1, {b + 1})) AS b) r),
    weighted AS (SELECT *, CASE {cases} ELSE {len(bounds)} END AS w FROM drawn)"""


CI_SQL = "quantile_cont(s, 0.025) AS lower, quantile_cont(s, 0.975) AS upper, count(*) FILTER (s IS NULL) AS n_degenerate"


@query(
    "a35_cluster_bootstrap_roi",
    with_sql(BETS, "per AS (SELECT flag, game_id, sum(profit) AS num, sum(stake) AS den FROM bets GROUP BY ALL)", draws_sql("per", "game_id"))
    + f""", reps AS (SELECT flag, resample, sum(w * num) / nullif(sum(w * den), 0) * 100 AS s FROM weighted GROUP BY ALL), ci AS (SELECT flag, {CI_SQL} FROM reps GROUP BY 1),
    e AS (SELECT flag, sum(num) / sum(den) * 100 AS estimate, count(*) AS n_clusters FROM per GROUP BY 1) SELECT * FROM e JOIN ci USING (flag)""",
)
def a35(spark, d):
    return bs.cluster_bootstrap(bets(spark, d), ["game_id"], F.col("profit"), F.col("stake"), RESAMPLES, by=["flag"], scale=100.0)


@query("a35_cluster_bootstrap_in_full")
def a35_full(spark, d):
    """As above, with the 10,000 resamples of a study."""
    return bs.cluster_bootstrap(bets(spark, d), ["game_id"], F.col("profit"), F.col("stake"), by=["flag"], scale=100.0)


@query(
    "a34_row_bootstrap_mean",
    """WITH per AS (SELECT o_orderkey AS k, o_totalprice AS num, 1.0::DOUBLE AS den FROM orders), """
    + draws_sql("per", "k")
    + f""", reps AS (SELECT resample, sum(w * num) / sum(w * den) AS s FROM weighted GROUP BY 1), ci AS (SELECT {CI_SQL} FROM reps), e AS (SELECT avg(num) AS estimate, count(*) AS n_clusters FROM per) SELECT * FROM e, ci""",
)
def a34(spark, d):
    return bs.row_bootstrap(table(spark, d, "orders"), ["o_orderkey"], F.col("o_totalprice"), resamples=RESAMPLES)


@query(
    "a36_paired_arm_bootstrap",
    with_sql(
        BETS,
        "per AS (SELECT entity_id, sum(profit) FILTER (side = 'OVER') AS na, sum(stake) FILTER (side = 'OVER') AS da, sum(profit) FILTER (flag = 'N') AS nb, sum(stake) FILTER (flag = 'N') AS db FROM bets GROUP BY 1)",
        draws_sql("per", "entity_id", "arms"),
    )
    + f""", reps AS (SELECT resample, sum(w * coalesce(na, 0)) / nullif(sum(w * coalesce(da, 0)), 0) - sum(w * coalesce(nb, 0)) / nullif(sum(w * coalesce(db, 0)), 0) AS s FROM weighted GROUP BY 1), ci AS (SELECT {CI_SQL} FROM reps),
    e AS (SELECT sum(na) / sum(da) AS arm_a, sum(nb) / sum(db) AS arm_b, sum(na) / sum(da) - sum(nb) / sum(db) AS difference, count(*) AS n_clusters FROM per) SELECT * FROM e, ci""",
)
def a36(spark, d):
    return bs.paired_arms(
        bets(spark, d), ["entity_id"], F.col("profit"), F.col("side") == "OVER", F.col("flag") == "N", F.col("stake"), RESAMPLES, "arms"
    )


@query(
    "a37_correlation_bootstrap",
    with_sql(
        BETS,
        "per AS (SELECT entity_id, count(*)::DOUBLE AS n, sum(line) AS x, sum(actual) AS y, sum(line * line) AS xx, sum(actual * actual) AS yy, sum(line * actual) AS xy FROM bets GROUP BY 1)",
        draws_sql("per", "entity_id", "r"),
    )
    + f""", t AS (SELECT resample, sum(w * n) AS n, sum(w * x) AS x, sum(w * y) AS y, sum(w * xx) AS xx, sum(w * yy) AS yy, sum(w * xy) AS xy FROM weighted GROUP BY 1),
    reps AS (SELECT (n * xy - x * y) / sqrt((n * xx - x * x) * (n * yy - y * y)) AS s FROM t), ci AS (SELECT {CI_SQL} FROM reps),
    e AS (SELECT corr(line, actual) AS r, count(DISTINCT entity_id) AS n_clusters FROM bets) SELECT * FROM e, ci""",
)
def a37(spark, d):
    return bs.correlation_bootstrap(bets(spark, d), ["entity_id"], F.col("line"), F.col("actual"), RESAMPLES, "r")


@query(
    "a38_arm_mean_vs_reference",
    with_sql(BETS, "per AS (SELECT entity_id, sum(actual - line) AS num, count(*)::DOUBLE AS den FROM bets GROUP BY 1)", draws_sql("per", "entity_id"))
    + f""", reps AS (SELECT resample, sum(w * num) / sum(w * den) AS s FROM weighted GROUP BY 1), ci AS (SELECT {CI_SQL} FROM reps), e AS (SELECT sum(num) / sum(den) AS estimate, count(*) AS n_clusters FROM per)
    SELECT estimate - 0.25 AS estimate, n_clusters, lower - 0.25 AS lower, upper - 0.25 AS upper, n_degenerate FROM e, ci""",
)
def a38(spark, d):
    return bs.mean_vs_reference(bets(spark, d), ["entity_id"], F.col("actual") - F.col("line"), 0.25, resamples=RESAMPLES)


_FAIR = f"{prob_sql('odds_over')} / ({prob_sql('odds_over')} + {prob_sql('odds_under')})"


@query(
    "a39_paired_score_deltas",
    with_sql(
        BETS,
        f"""s AS (SELECT flag, game_id, p_over AS p, {_FAIR} AS m, CAST(actual > line AS INTEGER) AS y FROM bets),
        long AS (SELECT flag, game_id, 'brier' AS score, (p - y) * (p - y) - (m - y) * (m - y) AS delta FROM s UNION ALL
          SELECT flag, game_id, 'log_loss', -(y * ln(p) + (1 - y) * ln(1 - p)) + (y * ln(m) + (1 - y) * ln(1 - m)) FROM s UNION ALL
          SELECT flag, game_id, 'abs_error', abs(p - y) - abs(m - y) FROM s),
        per AS (SELECT flag, score, game_id, sum(delta) AS num, count(*)::DOUBLE AS den FROM long GROUP BY ALL)""",
        draws_sql("per", "game_id", "delta"),
    )
    + f""", reps AS (SELECT flag, score, resample, sum(w * num) / nullif(sum(w * den), 0) AS s FROM weighted GROUP BY ALL), ci AS (SELECT flag, score, {CI_SQL} FROM reps GROUP BY ALL),
    e AS (SELECT flag, score, sum(num) / sum(den) AS estimate, count(*) AS n_clusters FROM per GROUP BY ALL) SELECT * FROM e JOIN ci USING (flag, score)""",
)
def a39(spark, d):
    return paired_deltas(bets(spark, d), "p_over", devig_american(F.col("odds_over"), F.col("odds_under")), ["flag"])


def paired_deltas(b, p, market, by, resamples=RESAMPLES, seed="delta"):
    """Model minus market score deltas, three scores on the same draws, clustered by game."""
    y = (F.col("actual") > F.col("line")).cast("int")
    rows = b.withColumns({"__m": market, "__y": y})
    m, q, y = F.col("__m"), F.col(p), F.col("__y")
    deltas = {
        "brier": st.brier(q, y) - st.brier(m, y), "log_loss": st.log_loss(q, y) - st.log_loss(m, y), "abs_error": F.abs(q - y) - F.abs(m - y),
    }
    return bs.ratios_bootstrap(rows, ["game_id"], deltas, F.lit(1.0), "score", resamples, seed, by)


@query(
    "a40_drift_baseline",
    with_sql(PAIRS)
    + """, j AS (SELECT a.book AS side, a.p_over AS bt, b.p_over AS cl FROM pairs a JOIN pairs b ON a.event_id = b.event_id AND a.line = b.line AND b.book = a.book + 2 WHERE a.book < 2) SELECT side, count(cl - bt) AS n, avg(cl - bt) AS mean_drift FROM j GROUP BY 1""",
)
def a40(spark, d):
    return st.drift_baseline(_passes(spark, d), "side", "bt", "cl")


def _passes(spark, d):
    p = pairs(spark, d)
    a = p.where("book < 2").select("event_id", "line", F.col("book").alias("side"), F.col("p_over").alias("bt"))
    b = p.where("book >= 2").select("event_id", "line", (F.col("book") - 2).alias("side"), F.col("p_over").alias("cl"))
    return a.join(b, ["event_id", "line", "side"])


@query(
    "a40_net_of_drift",
    with_sql(PAIRS)
    + """, j AS (SELECT a.event_id, a.line, a.book AS side, a.p_over AS bt, b.p_over AS cl FROM pairs a JOIN pairs b ON a.event_id = b.event_id AND a.line = b.line AND b.book = a.book + 2 WHERE a.book < 2)
    SELECT event_id, line, side, cl - bt - avg(cl - bt) OVER (PARTITION BY side) AS net_clv FROM j""",
)
def a40_net(spark, d):
    return st.net_of_drift(_passes(spark, d), "side", "bt", "cl").select("event_id", "line", "side", "net_clv")


@query(
    "a41_empirical_residual_price",
    """WITH r AS (SELECT CAST(round(o_totalprice / 1000) AS DOUBLE) - 250 AS resid FROM orders), n AS (SELECT count(*)::DOUBLE AS n FROM r), c AS (SELECT resid, count(*) AS k FROM r GROUP BY 1),
    a AS (SELECT c_custkey, CAST(round(c_acctbal / 100) AS DOUBLE) AS pred, 100.0::DOUBLE AS line FROM customer), x AS (SELECT DISTINCT line - pred AS x FROM a),
    s AS (SELECT x, coalesce(sum(k) FILTER (resid > x), 0) AS o, coalesce(sum(k) FILTER (resid < x), 0) AS u, coalesce(sum(k) FILTER (resid = x), 0) AS p FROM x CROSS JOIN c GROUP BY 1)
    SELECT c_custkey, o / n AS p_over, u / n AS p_under, p / n AS p_push FROM a JOIN s ON x = line - pred, n""",
)
def a41(spark, d):
    resid = table(spark, d, "orders").select((F.round(F.col("o_totalprice") / 1000) - 250).alias("resid"))
    a = table(spark, d, "customer").select("c_custkey", F.round(F.col("c_acctbal") / 100).alias("pred"), F.lit(100.0).alias("line"))
    return st.empirical_shares(a, resid, "pred", "line", "resid", ["c_custkey"]).select("c_custkey", "p_over", "p_under", "p_push")


@query(
    "q11_placebo_interval",
    with_sql(BETS, "per AS (SELECT flag, entity_id, sum(CASE WHEN game_id % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS num, count(*)::DOUBLE AS den FROM bets GROUP BY ALL)", draws_sql("per", "entity_id", "placebo"))
    + f""", reps AS (SELECT flag, resample, sum(w * num) / nullif(sum(w * den), 0) AS s FROM weighted GROUP BY ALL), ci AS (SELECT flag, {CI_SQL} FROM reps GROUP BY 1)
    SELECT flag, lower, upper, CAST(lower > 0 OR upper < 0 AS INTEGER) AS excludes_zero FROM ci""",
)
def q11(spark, d):
    sign = F.when(F.col("game_id") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    ci = bs.cluster_bootstrap(bets(spark, d), ["entity_id"], sign, F.lit(1.0), RESAMPLES, "placebo", by=["flag"])
    return ql.placebo_flag(ci).select("flag", "lower", "upper", "excludes_zero")
