"""Ledgers, reports, coverage, calibration and scores; Q: gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from formbook.functions import odds as O
from formbook.operators import grading as gr
from formbook.operators import quality as ql
from formbook.operators import quotes as qt
from formbook.operators import stats as st
from formbook.operators.joins import next_row
from formbook.plans.frames import BETS, FORM, PAIRS, SNAPSHOTS, bets, form, quotes, snapshots, table, with_sql
from formbook.plans.projections import SHOTS, rolled, rolled_sql, shots_frame
from formbook.plans.quotes import pairs
from formbook.plans.registry import query

SUMMARY_SQL = """count(*) AS bets, count(*) FILTER (result = 'WIN') AS wins, count(*) FILTER (result = 'LOSS') AS losses, count(*) FILTER (result = 'PUSH') AS pushes,
  coalesce(count(*) FILTER (result = 'WIN') / nullif(count(*) FILTER (result IN ('WIN', 'LOSS')), 0), 0.0) AS win_rate, sum(profit) AS profit_total, sum(stake) AS units, sum(profit) / sum(stake) * 100 AS roi"""


@query("a1_bet_summary", with_sql(BETS) + f"SELECT book, {SUMMARY_SQL} FROM bets GROUP BY 1")
def a1(spark, d):
    return gr.bet_summary(bets(spark, d), ["book"])


@query(
    "a2_bet_breakdown",
    with_sql(BETS)
    + f"""SELECT CASE WHEN grouping(side) = 0 THEN 'side' WHEN grouping(book) = 0 THEN 'book' WHEN grouping(flag) = 0 THEN 'flag' WHEN grouping(month) = 0 THEN 'month' ELSE 'total' END AS dimension,
      CASE WHEN grouping(side) = 0 THEN side WHEN grouping(book) = 0 THEN CAST(book AS VARCHAR) WHEN grouping(flag) = 0 THEN flag WHEN grouping(month) = 0 THEN CAST(month AS VARCHAR) ELSE 'all' END AS value, {SUMMARY_SQL}
    FROM (SELECT *, CAST(date_trunc('month', bet_date) AS DATE) AS month FROM bets) GROUP BY GROUPING SETS ((side), (book), (flag), (month), ())""",
)
def a2(spark, d):
    b = bets(spark, d).withColumn("month", F.trunc("bet_date", "MM"))
    return gr.bet_breakdown(b, ["side", "book", "flag", "month"])


@query(
    "a3_clv_report",
    with_sql(BETS)
    + """, l AS (SELECT *, CASE WHEN side = 'OVER' THEN actual - line ELSE line - actual END AS clv FROM bets),
    e AS (SELECT 'side' AS dimension, side AS value, clv FROM l UNION ALL SELECT 'flag', flag, clv FROM l UNION ALL SELECT 'total', 'all', clv FROM l)
    SELECT dimension, value, count(*) AS n_legs, avg(clv) AS mean_clv, count(*) FILTER (clv > 0) / count(*) AS beat_rate, quantile_cont(clv, 0.5) AS median_clv FROM e GROUP BY ALL""",
)
def a3(spark, d):
    b = bets(spark, d).withColumn("clv", O.line_clv(F.col("side"), F.col("line"), F.col("actual")))
    return gr.clv_report(b, ["side", "flag"], "clv").withColumn("n_legs", F.col("n_legs").cast("long"))


@query(
    "a4_distinct_denominators",
    with_sql(BETS) + "SELECT flag, count(*) AS n_rows, count(DISTINCT (entity_id, bet_date)) AS n_entity_nights, count(DISTINCT game_id) AS n_games FROM bets GROUP BY 1",
)
def a4(spark, d):
    return gr.distinct_denominators(bets(spark, d), ["flag"], {"n_entity_nights": ["entity_id", "bet_date"], "n_games": ["game_id"]})


@query(
    "a14_shot_quality",
    with_sql(SHOTS)
    + "SELECT goalie_id, "
    + ", ".join(
        f"count(*) FILTER (danger = '{k}') AS {k}_shots, CAST(count(*) FILTER (danger = '{k}' AND is_goal = 1) AS BIGINT) AS {k}_goals, "
        f"count(*) FILTER (danger = '{k}' AND is_goal = 0) / nullif(count(*) FILTER (danger = '{k}'), 0) AS {k}_save_pct"
        for k in ("high", "mid", "low")
    )
    + ", count(*) AS shots, sum(xg) AS xg_total, avg(distance) AS mean_distance, avg(angle) AS mean_angle FROM shots GROUP BY 1",
)
def a14(spark, d):
    out = []
    for k in ("high", "mid", "low"):
        here = F.col("danger") == k
        shots, goals = F.count_if(here), F.count_if(here & (F.col("is_goal") == 1))
        out += [shots.alias(f"{k}_shots"), goals.alias(f"{k}_goals"), O.safe_div(shots - goals, shots).alias(f"{k}_save_pct")]
    return shots_frame(spark, d).groupBy("goalie_id").agg(
        *out, F.count(F.lit(1)).alias("shots"), F.sum("xg").alias("xg_total"), F.avg("distance").alias("mean_distance"), F.avg("angle").alias("mean_angle")
    )


@query(
    "a15_rebounds",
    with_sql(SHOTS)
    + """, n AS (SELECT *, lead(period) OVER w AS np, lead(clock) OVER w AS nc, lead(danger) OVER w AS nd FROM shots WINDOW w AS (PARTITION BY goalie_id ORDER BY period, clock, game_id, seq, xg)),
    r AS (SELECT goalie_id, is_goal = 0 AND np IS NOT NULL AS save, is_goal = 0 AND np = period AND nc - clock > 0 AND nc - clock <= 3 AS rebound, nd = 'high' AS danger FROM n)
    SELECT goalie_id, count(*) FILTER (save) AS saves, count(*) FILTER (rebound) AS rebounds, coalesce(count(*) FILTER (rebound) / nullif(count(*) FILTER (save), 0), 0) AS rebound_rate,
      coalesce(count(*) FILTER (rebound AND danger) / nullif(count(*) FILTER (rebound), 0), 0) AS dangerous_share FROM r GROUP BY 1""",
)
def a15(spark, d):
    order = ["period", "clock", "game_id", "seq", "xg"]
    n = next_row(shots_frame(spark, d), ["goalie_id"], order, ["period", "clock", "danger"])
    gap = F.col("next_clock") - F.col("clock")
    save = (F.col("is_goal") == 0) & F.col("next_period").isNotNull()
    rebound = F.coalesce(save & (F.col("next_period") == F.col("period")) & (gap > 0) & (gap <= 3), F.lit(False))
    saves, rebounds, risky = F.count_if(save), F.count_if(rebound), F.count_if(rebound & (F.col("next_danger") == "high"))
    return n.groupBy("goalie_id").agg(
        saves.alias("saves"), rebounds.alias("rebounds"), F.coalesce(O.safe_div(rebounds, saves), F.lit(0.0)).alias("rebound_rate"),
        F.coalesce(O.safe_div(risky, rebounds), F.lit(0.0)).alias("dangerous_share"),
    )


@query("a16_prior_season_mean", with_sql(FORM) + "SELECT CAST(season + 1 AS INTEGER) AS season, team_id, avg(value) AS prior_mean FROM form GROUP BY ALL")
def a16(spark, d):
    return form(spark, d).groupBy((F.col("season") + 1).alias("season"), "team_id").agg(F.avg("value").alias("prior_mean"))


@query(
    "a17_ticket_settlement",
    with_sql(BETS)
    + """, l AS (SELECT game_id, CASE WHEN seq = 7 AND flag = 'N' THEN NULL WHEN line < 3 THEN 'PUSH' ELSE result END AS r FROM bets)
    SELECT game_id, count(*) AS n_legs, CASE WHEN count(r) < count(*) THEN 'open' WHEN bool_or(r = 'LOSS') THEN 'lost' WHEN bool_and(r = 'WIN') THEN 'won' WHEN bool_and(r = 'PUSH') THEN 'push' ELSE 'partial' END AS status FROM l GROUP BY 1""",
)
def a17(spark, d):
    r = F.when((F.col("seq") == 7) & (F.col("flag") == "N"), F.lit(None).cast("string")).when(F.col("line") < 3, F.lit("PUSH")).otherwise(F.col("result"))
    return gr.settle_tickets(bets(spark, d).withColumn("leg", r), ["game_id"], "leg")


@query(
    "a18_per_game_reconciliation",
    with_sql(BETS)
    + """, g AS (SELECT flag, game_id, count(*) AS n, sum(profit) AS p FROM bets GROUP BY ALL), t AS (SELECT flag, count(*) AS n, sum(profit) AS p FROM bets GROUP BY 1),
    s AS (SELECT flag, sum(n) AS n, sum(p) AS p FROM g GROUP BY 1) SELECT flag, CAST(s.n AS BIGINT) AS bets_by_game, t.n AS bets_total, s.p AS profit_by_game, CAST(s.n = t.n AND abs(s.p - t.p) < 1e-6 AS INTEGER) AS agrees FROM s JOIN t USING (flag)""",
)
def a18(spark, d):
    b = bets(spark, d)
    parts = b.groupBy("flag", "game_id").agg(F.count(F.lit(1)).alias("n"), F.sum("profit").alias("p")).groupBy("flag").agg(
        F.sum("n").alias("bets_by_game"), F.sum("p").alias("profit_by_game")
    )
    whole = b.groupBy("flag").agg(F.count(F.lit(1)).alias("bets_total"), F.sum("profit").alias("p"))
    same = (F.col("bets_by_game") == F.col("bets_total")) & (F.abs(F.col("profit_by_game") - F.col("p")) < 1e-6)
    return parts.join(whole, "flag").select("flag", "bets_by_game", "bets_total", "profit_by_game", same.cast("int").alias("agrees"))


@query(
    "a19_coverage_counts",
    """WITH r AS (SELECT l_suppkey % 4 AS book, l_partkey, l_shipdate, count(*) AS rungs FROM lineitem GROUP BY ALL)
    SELECT book, count(DISTINCT l_partkey) AS n_events, count(*) AS n_nights, avg(rungs) AS mean_rungs, max(rungs) AS max_rungs, quantile_cont(rungs, 0.95) AS p95_rungs FROM r GROUP BY 1""",
)
def a19(spark, d):
    from formbook.operators.skew import summarise

    r = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("book"), "l_partkey", "l_shipdate").agg(F.count(F.lit(1)).alias("rungs"))
    extra = {"n_events": F.count_distinct("l_partkey"), "n_nights": F.count(F.lit(1)), "mean_rungs": F.avg("rungs"), "max_rungs": F.max("rungs")}
    return summarise(r, ["book"], "rungs", {"p95_rungs": 0.95}, extra)


@query(
    "a20_null_rates_by_month",
    with_sql(FORM, rolled_sql((3, 10)))
    + """SELECT CAST(date_trunc('month', game_date) AS DATE) AS month, count(*) AS n_rows, avg(CAST(value_rolling_3 IS NULL AS DOUBLE)) AS null_value_rolling_3,
      avg(CAST(value_rolling_std_10 IS NULL AS DOUBLE)) AS null_value_rolling_std_10 FROM rolled GROUP BY 1""",
)
def a20(spark, d):
    r = rolled(spark, d, (3, 10))
    return st.null_rates(r, [st.month_of("game_date").alias("month")], ["value_rolling_3", "value_rolling_std_10"])


@query(
    "a21_gap_statistics",
    """WITH g AS (SELECT event_type, epoch_us(ts) / 1e6 - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id) / 1e6 AS gap FROM events)
    SELECT event_type, count(gap) AS n, max(gap) AS max_gap, count(*) FILTER (gap > 600) AS over_600, count(*) FILTER (gap > 3600) AS over_3600, quantile_cont(gap, 0.5) AS median_gap, quantile_cont(gap, 0.95) AS p95_gap FROM g GROUP BY 1""",
)
def a21(spark, d):
    from formbook.operators.skew import bounded_frame

    e = table(spark, d, "events").withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    g = bounded_frame(e, ["event_type"], [F.col("ts"), F.col("event_id")], lambda w: {"gap": F.col("sec") - F.lag("sec").over(w)}, back=1)
    return st.gap_stats(g, ["event_type"], "gap", [600, 3600])


@query(
    "a22_exclusion_funnel",
    with_sql(BETS)
    + """SELECT CASE WHEN line < 2 THEN 'line_too_low' WHEN odds < -150 THEN 'price_too_short' WHEN result = 'PUSH' THEN 'push' ELSE 'kept' END AS bucket, count(*) AS n_rows FROM bets GROUP BY 1""",
)
def a22(spark, d):
    steps = [("line_too_low", F.col("line") < 2), ("price_too_short", F.col("odds") < -150), ("push", F.col("result") == "PUSH")]
    return st.funnel(bets(spark, d), steps)


SCORED = """scored AS (SELECT d.doc_id, (n_chars % 997) / 997.0::DOUBLE AS p, quality AS y, lang FROM documents d JOIN labels l USING (doc_id)),
  entity AS (SELECT *, CAST(result = 'WIN' AS INTEGER) AS y, (entity_id * 7919 % 1009) / 1009.0::DOUBLE AS score FROM bets)"""


def scored_bets(spark, d):
    return bets(spark, d).withColumns(
        {"y": (F.col("result") == "WIN").cast("int"), "score": (F.col("entity_id") * 7919 % 1009) / F.lit(1009.0)}
    )


@query(
    "a23_reliability_quantile_bins",
    with_sql(BETS, SCORED)
    + """, e AS (SELECT list_sort(list_distinct(quantile_cont(score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM entity)
    SELECT CAST(greatest(len(list_filter(edges, lambda x: x < score)), 1) - 1 AS INTEGER) AS bin, count(*) AS n, avg(score) AS mean_pred, avg(y) AS actual_rate FROM entity, e GROUP BY 1""",
)
def a23(spark, d):
    return st.reliability_quantile(scored_bets(spark, d), "score", "y")


@query(
    "a23_reliability_fixed_bins",
    with_sql(BETS, SCORED) + "SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mean_pred, avg(y) AS actual_rate FROM scored GROUP BY 1",
)
def a23_fixed(spark, d):
    return st.reliability_fixed(scored_docs(spark, d), "p", "y")


def scored_docs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", ((F.col("n_chars") % 997) / F.lit(997.0)).alias("p"))
    return docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")


@query(
    "a24_side_calibration",
    with_sql(BETS, SCORED)
    + "SELECT book, CASE WHEN score >= 0.5 THEN 'over' ELSE 'under' END AS model_side, count(*) AS n, avg(score) AS mean_pred, avg(y) AS actual_rate, avg(score) - avg(y) AS gap FROM entity GROUP BY ALL",
)
def a24(spark, d):
    return st.side_calibration(scored_bets(spark, d), ["book"], "score", "y")


@query(
    "a26_numeric_profile",
    with_sql(BETS)
    + """SELECT flag, count(amount) AS n, avg(amount) AS mean, stddev_samp(amount) AS std, min(amount) AS low, max(amount) AS high, quantile_cont(amount, 0.05) AS p05, quantile_cont(amount, 0.25) AS p25,
      quantile_cont(amount, 0.5) AS p50, quantile_cont(amount, 0.75) AS p75, quantile_cont(amount, 0.95) AS p95 FROM bets GROUP BY 1""",
)
def a26(spark, d):
    return st.numeric_profile(bets(spark, d), ["flag"], "amount")


@query(
    "a27_line_bucket_hit_rate",
    with_sql(BETS)
    + """SELECT CAST(CASE WHEN line > 0 AND line <= 5 THEN 0 WHEN line > 5 AND line <= 10 THEN 1 WHEN line > 10 AND line <= 15 THEN 2 WHEN line > 15 AND line <= 30 THEN 3 END AS INTEGER) AS bucket,
      count(*) AS n, avg(CAST(actual > line AS DOUBLE)) AS hit_rate, avg(line) AS mean_value FROM bets WHERE line > 0 AND line <= 30 GROUP BY 1""",
)
def a27(spark, d):
    b = bets(spark, d).withColumn("over_hit", (F.col("actual") > F.col("line")).cast("int"))
    return st.bucket_summary(b, "line", "over_hit", [0, 5, 10, 15, 30])


@query(
    "a29_probability_scores",
    with_sql(BETS, SCORED)
    + """, a AS (SELECT lang, count(*) AS n, avg((p - y) * (p - y)) AS brier, avg(-(y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)))) AS log_loss,
      count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y <> 1) AS fp, count(*) FILTER (p < 0.5 AND y <> 1) AS tn, count(*) FILTER (p < 0.5 AND y = 1) AS fn FROM scored GROUP BY 1),
    b AS (SELECT *, (tp + tn) / n AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM a)
    SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM b""",
)
def a29(spark, d):
    return st.score_probabilities(scored_docs(spark, d), ["lang"], "p", "y")


@query(
    "a29_count_scores",
    with_sql(BETS)
    + """SELECT book, count(*) AS n, avg(abs(line - actual)) AS mae, avg(line - actual) AS bias, avg(2 * (CASE WHEN actual > 0 THEN actual * ln(actual / greatest(line, 1e-9)) ELSE 0 END - (actual - greatest(line, 1e-9)))) AS poisson_deviance FROM bets GROUP BY 1""",
)
def a29_counts(spark, d):
    return st.score_counts(bets(spark, d), ["book"], "line", "actual")


AUC_SQL = "(sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0))"


@query(
    "a30_auc_rows",
    with_sql(BETS, SCORED)
    + f""", r AS (SELECT book, y, rank() OVER (PARTITION BY book ORDER BY score) + (count(*) OVER (PARTITION BY book, score) - 1) / 2.0 AS rk FROM entity)
    SELECT book, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, {AUC_SQL} AS auc FROM r GROUP BY 1""",
)
def a30(spark, d):
    return st.roc_auc(scored_bets(spark, d), ["book"], "score", "y")


@query(
    "a30_auc_one_per_entity_night",
    with_sql(BETS, SCORED)
    + f""", f AS (SELECT * FROM entity QUALIFY row_number() OVER (PARTITION BY entity_id, bet_date ORDER BY game_id, seq, venue) = 1),
    r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM f)
    SELECT count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, {AUC_SQL} AS auc FROM r""",
)
def a30_night(spark, d):
    from formbook.operators.windows import cols, first_per_key

    one = first_per_key(scored_bets(spark, d), ["entity_id", "bet_date"], cols(["game_id", "seq", "venue"]))
    return st.roc_auc(one, [], "score", "y")


@query(
    "a31_linear_fit",
    with_sql(BETS)
    + "SELECT flag, count(*) AS n, corr(line, actual) AS r, regr_slope(actual, line) AS slope, regr_intercept(actual, line) AS intercept, sum(line * actual) / sum(line * line) AS slope_origin FROM bets GROUP BY 1",
)
def a31(spark, d):
    return st.linear_fit(bets(spark, d), ["flag"], "line", "actual")


@query(
    "a32_dispersion_fit",
    with_sql(BETS)
    + """, a AS (SELECT book, avg(greatest(line, 1e-3)) AS mean_mu, avg(pow(actual - greatest(line, 1e-3), 2)) AS resid_var, avg(pow(greatest(line, 1e-3), 2)) AS mean_mu2 FROM bets GROUP BY 1)
    SELECT *, CASE WHEN resid_var <= mean_mu THEN 0 ELSE greatest((resid_var - mean_mu) / mean_mu2, 1e-6) END AS alpha, CASE WHEN resid_var <= mean_mu THEN 'poisson' ELSE 'negative_binomial' END AS family FROM a""",
)
def a32(spark, d):
    return st.dispersion_fit(bets(spark, d), ["book"], "line", "actual")


# --- gates ---------------------------------------------------------------------------


@query("q1_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q1(spark, d):
    return ql.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("q2_unexpected_values", "SELECT event_type, count(*) AS n_rows FROM events WHERE event_type NOT IN ('view', 'click', 'purchase') OR event_type IS NULL GROUP BY 1")
def q2(spark, d):
    e = ql.require_columns(table(spark, d, "events"), ["event_id", "event_type"])
    return ql.unexpected_values(e, "event_type", ["view", "click", "purchase"])


@query(
    "q3_devig_sums_to_one",
    with_sql(PAIRS)
    + """, s AS (SELECT event_id, book, line, sum(p) AS s FROM (SELECT event_id, book, line, p_over AS p FROM pairs UNION ALL SELECT event_id, book, line, (1 / price_under) / (1 / price_over + 1 / price_under) FROM pairs) GROUP BY ALL)
    SELECT count(*) AS n_groups, count(*) FILTER (abs(s - 1) > 1e-9) AS n_off, round(max(abs(s - 1)), 9) AS max_gap FROM s""",
)
def q3(spark, d):
    p = pairs(spark, d)
    sides = F.explode(F.array(F.col("p_over"), O.devig_decimal(F.col("price_under"), F.col("price_over"))))
    out = ql.sum_to_one(p.select("event_id", "book", "line", sides.alias("p")), ["event_id", "book", "line"], "p")
    return out.withColumn("max_gap", F.round("max_gap", 9))


@query(
    "q4_leak_counts",
    with_sql(SNAPSHOTS) + "SELECT count(*) AS n_rows, count(*) FILTER (fetched_at > start_at) AS after_start, CAST(0 AS BIGINT) AS bad_line FROM snapshots",
)
def q4(spark, d):
    return ql.leak_counts(ql.require_no_leak(snapshots(spark, d), ["actual", "result"]), "fetched_at", "start_at", ["line"])


@query(
    "q5_both_sides_rate",
    with_sql(PAIRS)
    + """, f AS (SELECT book, count(*) AS n_rows, avg(CAST(price_over IS NOT NULL AND price_under IS NOT NULL AS DOUBLE)) AS rate FROM sided GROUP BY 1) SELECT *, CAST(rate >= 0.34 AS INTEGER) AS passed FROM f""",
)
def q5(spark, d):
    from formbook.plans.frames import QUOTE_POSITION

    wide = qt.pair_sides(quotes(spark, d), ["event_id", "book", "line"], "side", "price", QUOTE_POSITION)
    return ql.rate_gate(wide, ["book"], F.col("pair_status") == "paired", 0.34)


@query(
    "q6_two_path_equality",
    """WITH a AS (SELECT l_orderkey AS ka, sum(l_quantity) AS total, max(l_quantity) AS biggest FROM lineitem GROUP BY 1),
    i AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS t, max(l_quantity) AS m FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey AS kb, sum(t) AS total2, max(m) AS biggest2 FROM i GROUP BY 1)
    SELECT count(*) FILTER (kb IS NULL) AS only_first, count(*) FILTER (ka IS NULL) AS only_second, max(abs(total - total2)) AS gap_total, max(abs(biggest - biggest2)) AS gap_biggest FROM a FULL JOIN b ON ka = kb""",
)
def q6(spark, d):
    """Totals per order by one aggregate and by way of a per-(order, line) aggregate."""
    li = table(spark, d, "lineitem")
    a = li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total"), F.max("l_quantity").alias("biggest"))
    inner = li.groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("t"), F.max("l_quantity").alias("m"))
    b = inner.groupBy("l_orderkey").agg(F.sum("t").alias("total"), F.max("m").alias("biggest"))
    return ql.two_path_gap(a, b, ["l_orderkey"], ["total", "biggest"])


@query(
    "q7_expected_counts",
    """WITH a AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), e AS (SELECT s_nationkey AS c_nationkey, 15 * count(*) AS n FROM supplier GROUP BY 1)
    SELECT c_nationkey, coalesce(a.n, 0) AS n_actual, coalesce(e.n, 0) AS n_expected, CAST(coalesce(a.n, 0) = coalesce(e.n, 0) AS INTEGER) AS agrees FROM a FULL JOIN e USING (c_nationkey)""",
)
def q7(spark, d):
    a = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    e = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg((15 * F.count(F.lit(1))).alias("n"))
    return ql.reconcile_counts(a, e, ["c_nationkey"], "n")


@query(
    "q8_record_integrity",
    """SELECT event_type, count(*) AS n_rows, count(*) FILTER (event_id % 97 = 0 OR user_id IS NULL) AS bad_signature, count(*) FILTER (NOT value < 100) AS value_out_of_plan, count(*) FILTER (NOT (ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-30')) AS outside_window FROM events GROUP BY 1""",
)
def q8(spark, d):
    from formbook.functions.text import row_checksum

    # records as stored, with their signature; every 97th has been altered since
    stored = table(spark, d, "events").withColumn("signature", row_checksum("event_id", "user_id"))
    e = stored.withColumn("user_id", F.when(F.col("event_id") % 97 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")))
    ts = F.col("ts")
    return ql.flag_counts(
        e,
        ["event_type"],
        {
            "bad_signature": F.col("user_id").isNotNull() & (F.col("signature") == row_checksum("event_id", "user_id")),
            "value_out_of_plan": F.col("value") < 100,
            "outside_window": (ts >= F.lit("2024-01-02").cast("timestamp_ntz")) & (ts < F.lit("2024-01-30").cast("timestamp_ntz")),
        },
    )


@query(
    "q8_plan_versus_disk",
    """SELECT 'planned_not_held' AS part, count(*) AS n_ids FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
    UNION ALL SELECT 'held_not_planned', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)""",
)
def q8_sets(spark, d):
    plan, disk = table(spark, d, "customer").select(F.col("c_custkey").alias("id")), table(spark, d, "orders").select(F.col("o_custkey").alias("id"))

    def count(name, ids):
        return ids.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n_ids"))

    return count("planned_not_held", plan.subtract(disk)).unionByName(count("held_not_planned", disk.subtract(plan)))


@query(
    "q9_billing_check",
    """WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'h2h,totals' ELSE 'h2h' END AS markets, 10 + 10 * (event_id % 2) AS charged FROM events)
    SELECT markets, count(*) AS n_calls, CAST(sum(charged) AS BIGINT) AS charged, CAST(sum(CASE WHEN markets = 'h2h' THEN 10 ELSE 20 END) AS BIGINT) AS expected, count(*) FILTER (charged <> CASE WHEN markets = 'h2h' THEN 10 ELSE 20 END) AS n_wrong FROM r GROUP BY 1""",
)
def q9(spark, d):
    i = F.col("event_id")
    r = table(spark, d, "events").select(F.when(i % 3 == 0, F.lit("h2h,totals")).otherwise(F.lit("h2h")).alias("markets"), (10 + 10 * (i % 2)).alias("charged"))
    want = O.credit_cost(F.col("markets"), F.lit("us"))
    return r.groupBy("markets").agg(
        F.count(F.lit(1)).alias("n_calls"), F.sum("charged").alias("charged"), F.sum(want).alias("expected"), F.count_if(F.col("charged") != want).alias("n_wrong")
    )


@query(
    "q10_anchor_consistency",
    """SELECT event_type, count(*) AS n_rows, count(*) FILTER (event_id % 7 = 0) AS anchor_mismatch, count(*) FILTER (event_id % 11 = 0) AS pass_mismatch FROM events GROUP BY 1""",
)
def q10(spark, d):
    from formbook.functions.text import snapshot_pass

    i, ts = F.col("event_id"), F.col("ts")
    anchor = F.when(i % 7 == 0, ts + F.expr("INTERVAL '1' SECOND")).otherwise(ts)
    e = table(spark, d, "events").withColumns(
        {"anchor": anchor, "commence": ts + F.expr("INTERVAL '30' MINUTE"), "label": F.when(i % 11 == 0, F.lit("closing")).otherwise(F.lit("bettime"))}
    )
    checks = {"anchor_mismatch": F.col("anchor") == ts, "pass_mismatch": F.col("label") == snapshot_pass(ts, F.col("commence"))}
    return ql.flag_counts(e, ["event_type"], checks)
