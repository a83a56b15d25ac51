"""P: row-level feature families and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from formbook.functions import odds as O
from formbook.functions import shots as G
from formbook.operators import features as ft
from formbook.operators.quality import require_columns
from formbook.operators.quotes import drop_drifted_events
from formbook.operators.windows import prior_league, prior_rolling
from formbook.plans.frames import BETS, FORM, bets, form, prob_sql, table, with_sql
from formbook.plans.registry import query


def rolled_sql(windows=(3, 5, 10), value="value"):
    """CTE with the prior rolling columns of the form log."""
    cols = ",\n".join(
        f"avg({value}) OVER (PARTITION BY entity_id ORDER BY game_date, game_id ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS {value}_rolling_{w}, "
        f"stddev_samp({value}) OVER (PARTITION BY entity_id ORDER BY game_date, game_id ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS {value}_rolling_std_{w}"
        for w in windows
    )
    return f"rolled AS (SELECT *, {cols} FROM form)"


def rolled(spark, d, windows=(3, 5, 10)):
    return prior_rolling(form(spark, d), ["entity_id"], ["game_date", "game_id"], ["value"], windows)


LINE = "150000 + 10000 * (game_id % 21)"


def with_line(df):
    return df.withColumn("line", (150000 + 10000 * (F.col("game_id") % 21)).cast("double"))


@query(
    "p1_line_relative",
    with_sql(FORM, rolled_sql((5, 10)))
    + f"""SELECT game_id, CAST({LINE} AS DOUBLE) - value_rolling_5 AS line_vs_rolling_5,
      CASE WHEN value_rolling_std_5 > 0.01 THEN ({LINE} - value_rolling_5) / value_rolling_std_5 ELSE 0 END AS line_z_score_5,
      CAST({LINE} AS DOUBLE) - value_rolling_10 AS line_vs_rolling_10,
      CASE WHEN value_rolling_std_10 > 0.01 THEN ({LINE} - value_rolling_10) / value_rolling_std_10 ELSE 0 END AS line_z_score_10 FROM rolled""",
)
def p1(spark, d):
    out = ft.line_relative(with_line(rolled(spark, d, (5, 10))), "line", "value", (5, 10))
    return out.select("game_id", *[f"{k}_{w}" for w in (5, 10) for k in ("line_vs_rolling", "line_z_score")])


@query(
    "p2_ratio_features",
    with_sql(FORM, rolled_sql((5,)), "s AS (SELECT *, avg(shots) OVER (PARTITION BY entity_id ORDER BY game_date, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS shots_rolling_5 FROM rolled)")
    + "SELECT game_id, value_rolling_5 / greatest(shots_rolling_5, 1) AS efficiency_5 FROM s WHERE shots_rolling_5 IS NOT NULL UNION ALL SELECT game_id, NULL FROM s WHERE shots_rolling_5 IS NULL",
)
def p2(spark, d):
    r = prior_rolling(form(spark, d), ["entity_id"], ["game_date", "game_id"], ["value", "shots"], (5,))
    out = ft.ratio_features(r, {"efficiency_5": ("value_rolling_5", "shots_rolling_5")})
    return out.select("game_id", "efficiency_5")


@query(
    "p3_volatility",
    with_sql(FORM, rolled_sql((5, 10)))
    + f"""SELECT game_id, value_rolling_std_5 / greatest(value_rolling_5, 1) AS value_cv_5, value_rolling_std_5 / greatest({LINE}, 1) AS volatility_vs_line_5,
      value_rolling_std_10 / greatest(value_rolling_10, 1) AS value_cv_10, value_rolling_std_10 / greatest({LINE}, 1) AS volatility_vs_line_10 FROM rolled""",
)
def p3(spark, d):
    out = ft.volatility_features(with_line(rolled(spark, d, (5, 10))), "value", "line", (5, 10))
    return out.select("game_id", *[f"{k}_{w}" for w in (5, 10) for k in ("value_cv", "volatility_vs_line")])


@query("p4_momentum", with_sql(FORM, rolled_sql((3, 10))) + "SELECT game_id, value_rolling_3 - value_rolling_10 AS value_momentum FROM rolled")
def p4(spark, d):
    return ft.momentum(rolled(spark, d, (3, 10)), ["value"]).select("game_id", "value_momentum")


@query(
    "p5_matchup_context",
    with_sql(FORM, rolled_sql((5,)),
             "r AS (SELECT *, date_diff('day', lag(game_date) OVER (PARTITION BY entity_id ORDER BY game_date, game_id), game_date) AS rest FROM rolled)")
    + f"""SELECT game_id, shots - value_rolling_5 AS expected_workload_diff, {LINE} - (shots - season) AS line_vs_opp_implied,
      least(coalesce(rest, 7), 7) * value_rolling_5 AS rest_x_performance FROM r""",
)
def p5(spark, d):
    from formbook.operators.windows import rest_days

    r = rest_days(with_line(rolled(spark, d, (5,))), ["entity_id"], ["game_date", "game_id"], "game_date", fill=7)
    out = ft.matchup_context(r, "line", "value_rolling_5", "shots", "season", "days_rest", "value_rolling_5")
    return out.select("game_id", "expected_workload_diff", "line_vs_opp_implied", "rest_x_performance")


_PO, _PU = prob_sql("odds_over"), prob_sql("odds_under")


@query(
    "p6_market_disagreement",
    with_sql(BETS)
    + f"""SELECT game_id, seq, entity_id, venue, line - actual AS line_vs_recent_avg, (line - actual) / nullif(actual, 0) AS line_vs_recent_avg_pct,
      (line - actual) / (stake + 1e-6) AS line_surprise_score, {_PO} AS impl_prob_over, {_PU} AS impl_prob_under, {_PO} + {_PU} - 1 AS market_vig,
      {_PO} / ({_PO} + {_PU}) AS fair_prob_over, {_PU} / ({_PO} + {_PU}) AS fair_prob_under, CAST(line % 1 = 0.5 AS INTEGER) AS line_is_half,
      CAST(line >= 20 AS INTEGER) AS line_is_extreme_high, CAST(line <= 4 AS INTEGER) AS line_is_extreme_low FROM bets""",
)
def p6(spark, d):
    b = bets(spark, d)
    out = ft.market_features(b, "line", "actual", "stake", "odds_over", "odds_under", high=20, low=4)
    return out.select("game_id", "seq", "entity_id", "venue", *[c for c in out.columns if c not in b.columns])


@query("p7_combined_matchup", with_sql(FORM, rolled_sql((5,))) + "SELECT game_id, value_rolling_5 + shots AS combined FROM rolled")
def p7(spark, d):
    return ft.combined(rolled(spark, d, (5,)), {"combined": ("value_rolling_5", "shots")}).select("game_id", "combined")


@query(
    "p8_season_relative",
    with_sql(FORM, rolled_sql((5,)), """e AS (SELECT *, avg(value) OVER w AS value_avg, CASE WHEN count(value) OVER w >= 2 THEN stddev_pop(value) OVER w END AS value_std
      FROM rolled WINDOW w AS (PARTITION BY entity_id, season ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
    + "SELECT game_id, round(value_rolling_5 - value_avg, 6) + 0.0 AS form_vs_season, round((value_rolling_5 - value_avg) / nullif(value_std, 0), 6) + 0.0 AS form_season_z FROM e",
)
def p8(spark, d):
    from formbook.operators.windows import prior_expanding

    e = prior_expanding(rolled(spark, d, (5,)), ["entity_id", "season"], ["game_date", "game_id"], "value", "value")
    out = ft.season_relative(e, "value_rolling_5", "value_avg", "value_std", "form")
    # the difference of two nearly equal means is rounded so that zero is zero
    return out.select("game_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("form_vs_season", "form_season_z")])


@query(
    "p9_orient_market",
    with_sql(BETS)
    + """, o AS (SELECT *, CASE WHEN seq % 2 = 1 THEN p_over ELSE 1 - p_over END AS own FROM bets)
    SELECT game_id, seq, entity_id, venue, own AS own_win_prob, 1 - own AS opp_win_prob, abs(own - 0.5) AS favourite_strength,
      line * own AS expected_goals_for, line * (1 - own) AS expected_goals_against FROM o""",
)
def p9(spark, d):
    b = bets(spark, d).withColumn("is_home", F.col("seq") % 2)
    out = ft.orient_market(b, "is_home", "p_over", "line")
    return out.select("game_id", "seq", "entity_id", "venue", *[c for c in out.columns if c not in b.columns])


def _league(alias, value):
    """Prior league mean of a column, per season and date."""
    return f"""d_{alias} AS (SELECT season, game_date, sum({value}) AS s, count({value}) AS n FROM base GROUP BY ALL),
    {alias} AS (SELECT season, game_date, sum(s) OVER w / nullif(sum(n) OVER w, 0) AS {alias} FROM d_{alias}
      WINDOW w AS (PARTITION BY season ORDER BY game_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(
    "p10_attempt_funnel",
    with_sql(FORM, "base AS (SELECT *, value / 1000 AS off_att, shots + 20 AS def_att, value / 1500 AS off_unb, shots + 10 AS def_unb, off_unb / off_att AS frac FROM form)",
             _league("l_att", "off_att"), _league("l_frac", "frac"), _league("l_sog", "shots"), _league("l_unb", "off_unb"))
    + """, j AS (SELECT base.*, l_att, l_frac, l_sog, l_unb FROM base LEFT JOIN l_att USING (season, game_date) LEFT JOIN l_frac USING (season, game_date)
        LEFT JOIN l_sog USING (season, game_date) LEFT JOIN l_unb USING (season, game_date)),
    a AS (SELECT *, off_att * def_att / nullif(l_att, 0) AS expected_attempts, l_sog / nullif(l_unb, 0) AS league_conversion FROM j),
    b AS (SELECT *, expected_attempts * (off_unb / off_att) * (def_unb / def_att) / nullif(l_frac, 0) AS expected_unblocked,
        shots / off_unb / nullif(league_conversion, 0) AS opp_conversion_rel, shots / def_unb / nullif(league_conversion, 0) AS team_conversion_rel FROM a)
    SELECT game_id, expected_attempts, expected_unblocked, league_conversion, opp_conversion_rel, team_conversion_rel,
      expected_unblocked * league_conversion * 0.97 AS mu_league,
      expected_unblocked * league_conversion * 0.97 * CASE WHEN opp_conversion_rel IS NOT NULL AND team_conversion_rel IS NOT NULL
        THEN sqrt(least(greatest(opp_conversion_rel, 0.5), 2.0) * least(greatest(team_conversion_rel, 0.5), 2.0)) END AS mu_adjusted FROM b""",
)
def p10(spark, d):
    base = form(spark, d).withColumns(
        {"off_att": F.col("value") / 1000, "def_att": F.col("shots") + 20, "off_unb": F.col("value") / 1500, "def_unb": F.col("shots") + 10}
    ).withColumn("frac", F.col("off_unb") / F.col("off_att")).withColumn("share", F.lit(0.97))
    out = base
    for name, value in (("l_att", "off_att"), ("l_frac", "frac"), ("l_sog", "shots"), ("l_unb", "off_unb")):
        league = prior_league(base, ["season"], "game_date", value).select(
            "season", F.col("league_date").alias("game_date"), F.col("prior_mean").alias(name)
        )
        out = out.join(league, ["season", "game_date"], "left")
    out = ft.attempt_funnel(out, "off_att", "def_att", "off_unb", "def_unb", "shots", "shots", "l_att", "l_frac", "l_sog", "l_unb", "share")
    return out.select("game_id", "expected_attempts", "expected_unblocked", "league_conversion", "opp_conversion_rel",
                      "team_conversion_rel", "mu_league", "mu_adjusted")


@query(
    "p11_fixed_offset",
    with_sql(FORM, rolled_sql((5,)))
    + """SELECT game_id, CAST(value_rolling_5 IS NULL AS INTEGER) AS offset_fallback, coalesce(value_rolling_5, 30.0) AS offset_rate,
      ln(greatest(coalesce(value_rolling_5, 30.0), 1e-3)) AS offset_log FROM rolled""",
)
def p11(spark, d):
    return ft.fixed_offset(rolled(spark, d, (5,)), "value_rolling_5").select("game_id", "offset_fallback", "offset_rate", "offset_log")


@query(
    "p12_targets",
    with_sql(BETS)
    + "SELECT game_id, seq, entity_id, venue, CAST(actual > line AS INTEGER) AS over_hit, actual - line AS line_margin, CAST(sign(actual - line) AS DOUBLE) AS margin_sign FROM bets",
)
def p12(spark, d):
    return ft.targets(bets(spark, d), "actual", "line").select("game_id", "seq", "entity_id", "venue", "over_hit", "line_margin", "margin_sign")


@query("p13_select_features", with_sql(BETS) + "SELECT game_id, line, p_over, p_push, p_under, odds_over, odds_under FROM bets")
def p13(spark, d):
    ids = ["entity_id", "venue", "seq", "game_id"]
    outcomes = ["actual", "profit", "stake", "amount", "odds", "book"]
    return ft.select_features(bets(spark, d), ids, outcomes, keep=["game_id"])


@query("p14_align_schema", with_sql(BETS) + "SELECT line, CAST(0 AS DOUBLE) AS absent_feature, p_over FROM bets")
def p14(spark, d):
    return ft.align_schema(bets(spark, d), ["line", "absent_feature", "p_over"], fill=0.0)


@query(
    "p17_confidence_and_weight",
    with_sql(BETS)
    + f"""SELECT game_id, seq, entity_id, venue, CASE WHEN abs(p_over - 0.5) < 0.05 THEN '50-55%' WHEN abs(p_over - 0.5) < 0.10 THEN '55-60%'
        WHEN abs(p_over - 0.5) < 0.15 THEN '60-65%' WHEN abs(p_over - 0.5) < 0.20 THEN '65-70%' WHEN abs(p_over - 0.5) < 0.25 THEN '70-75%' ELSE '75%+' END AS bucket,
      CAST(CASE WHEN {_PO} + {_PU} - 1 < 0.05 THEN 1.5 WHEN {_PO} + {_PU} - 1 > 0.10 THEN 0.8 ELSE 1.0 END AS DOUBLE) AS weight FROM bets""",
)
def p17(spark, d):
    return bets(spark, d).select(
        "game_id", "seq", "entity_id", "venue", O.confidence_bucket(F.abs(F.col("p_over") - 0.5)).alias("bucket"),
        O.sharpness_weight(F.col("odds_over"), F.col("odds_under")).alias("weight"),
    )


# fixed values: venues whose prices are not tradable
UNRELIABLE_BOOKS = ("prizepicks", "manual", "unknown")


@query(
    "p18_unusable_quote_filter",
    """SELECT event_type, count(*) AS n_rows FROM events WHERE event_type NOT IN ('prizepicks', 'manual', 'unknown', 'error') AND NOT regexp_matches(props, '"k": 1[0-9]}') GROUP BY 1""",
)
def p18(spark, d):
    e = table(spark, d, "events").where(~F.col("event_type").isin(*UNRELIABLE_BOOKS, "error") & ~F.col("props").rlike('"k": 1[0-9]}'))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "p19_both_sides_priced",
    """SELECT l_returnflag, count(*) AS n_rows FROM lineitem WHERE nullif(l_tax, 0) IS NOT NULL AND nullif(l_discount, 0) IS NOT NULL GROUP BY 1""",
)
def p19(spark, d):
    li = table(spark, d, "lineitem").withColumns({"over": F.nullif("l_tax", F.lit(0.0)), "under": F.nullif("l_discount", F.lit(0.0))})
    return li.where(F.col("over").isNotNull() & F.col("under").isNotNull()).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "p20_drift_exclusion",
    """WITH e AS (SELECT *, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 23 HOUR AS start_at FROM events),
    bad AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM e WHERE start_at - ts < INTERVAL 10 MINUTE)
    SELECT event_id FROM e WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.user_id = e.user_id AND bad.day = CAST(e.ts AS DATE))""",
)
def p20(spark, d):
    e = table(spark, d, "events").withColumns(
        {"day": F.to_date("ts"), "start_at": F.to_date("ts").cast("timestamp_ntz") + F.expr("INTERVAL '23' HOUR")}
    )
    return drop_drifted_events(e, ["user_id", "day"], "ts", "start_at").select("event_id")


@query("p21_half_lines", with_sql(BETS) + "SELECT game_id, seq, entity_id, venue, line FROM bets WHERE line % 1 = 0.5")
def p21(spark, d):
    return bets(spark, d).where(O.is_half_line(F.col("line"))).select("game_id", "seq", "entity_id", "venue", "line")


@query(
    "p22_fill_policy",
    with_sql(FORM, rolled_sql((3, 5)))
    + "SELECT game_id, coalesce(value_rolling_3, 200000.0) AS value_rolling_3, coalesce(value_rolling_std_3, 0.0) AS value_rolling_std_3, coalesce(value_rolling_5, 0.0) AS value_rolling_5 FROM rolled",
)
def p22(spark, d):
    cols = ["value_rolling_3", "value_rolling_std_3", "value_rolling_5"]
    return ft.fill_missing(rolled(spark, d, (3, 5)), {"value_rolling_3": 200000.0}, 0.0, cols).select("game_id", *cols)


@query(
    "p23_book_one_hot",
    """SELECT event_id, CAST(event_type = 'click' AS INTEGER) AS book_click, CAST(event_type = 'view' AS INTEGER) AS book_view, CAST(event_type = 'none' AS INTEGER) AS book_none FROM events""",
)
def p23(spark, d):
    e = ft.one_hot(table(spark, d, "events"), "event_type", ["click", "view", "none"], "book")
    return e.select("event_id", "book_click", "book_view", "book_none")


def shots_frame(spark, d):
    """Shot coordinates from order lines; goalie is the part, period and clock from the line."""
    li = require_columns(table(spark, d, "lineitem"), ["l_quantity", "l_discount"])
    kinds = F.array(*[F.lit(x) for x in ("wrist", "slap", "tip", "other")])
    out = li.select(
        F.col("l_partkey").alias("goalie_id"), F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("seq"), F.col("l_suppkey").alias("venue"),
        (F.col("l_quantity") * 4 - 105).alias("x"), (F.col("l_discount") * 400 - 20).alias("y"),
        F.element_at(kinds, (F.col("l_suppkey") % 4 + 1).cast("int")).alias("shot_type"), (F.col("l_returnflag") == "R").cast("int").alias("is_goal"),
        (F.col("l_linenumber") % 3 + 1).alias("period"), F.col("l_suppkey").alias("clock"),
    )
    out = out.withColumns({"distance": G.shot_distance(F.col("x"), F.col("y")), "angle": G.shot_angle(F.col("x"), F.col("y"))})
    out = out.withColumn("danger", G.danger_class(F.col("distance"), F.col("angle")))
    return out.withColumn("xg", G.expected_goal(F.col("distance"), F.col("shot_type"), F.col("danger")))


SHOTS = """s0 AS (SELECT l_partkey AS goalie_id, l_orderkey AS game_id, l_linenumber AS seq, l_suppkey AS venue, l_quantity * 4 - 105 AS x, l_discount * 400 - 20 AS y,
    list_extract(['wrist', 'slap', 'tip', 'other'], CAST(l_suppkey % 4 + 1 AS INTEGER)) AS shot_type, CAST(l_returnflag = 'R' AS INTEGER) AS is_goal,
    l_linenumber % 3 + 1 AS period, l_suppkey AS clock FROM lineitem),
  s1 AS (SELECT *, CASE WHEN x > 0 THEN 89.0 ELSE -89.0 END AS net FROM s0),
  s2 AS (SELECT *, sqrt((x - net) * (x - net) + y * y) AS distance, CASE WHEN abs(x) > 89 THEN 90.0::DOUBLE ELSE abs(degrees(atan2(y, abs(net - x)))) END AS angle FROM s1),
  s3 AS (SELECT *, CASE WHEN distance <= 15 AND angle <= 45 THEN 'high' WHEN distance <= 30 THEN 'mid' ELSE 'low' END AS danger FROM s2),
  shots AS (SELECT *, least((CASE shot_type WHEN 'wrist' THEN 0.06 WHEN 'slap' THEN 0.04 WHEN 'tip' THEN 0.12 ELSE 0.05 END) * exp(-distance / 30)
    * (CASE danger WHEN 'high' THEN 2.5 WHEN 'mid' THEN 1.5 ELSE 0.7 END), 0.5) AS xg FROM s3)"""


@query("p24_shot_geometry", with_sql(SHOTS) + "SELECT game_id, seq, goalie_id, venue, distance, angle, danger, xg FROM shots")
def p24(spark, d):
    return shots_frame(spark, d).select("game_id", "seq", "goalie_id", "venue", "distance", "angle", "danger", "xg")


@query(
    "p25_shot_shares",
    """WITH g AS (SELECT l_orderkey AS game_id, CAST(count(*) FILTER (l_linestatus = 'O') AS BIGINT) AS sf, count(*) FILTER (l_linestatus = 'F') AS sa,
        count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'R') AS bf, count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'R') AS ba FROM lineitem GROUP BY 1)
    SELECT game_id, sf + ba AS corsi_for, sa + bf AS corsi_against, (sf + ba) / (CASE WHEN sf + ba + sa + bf = 0 THEN 1 ELSE sf + ba + sa + bf END) AS corsi_for_pct,
      sf AS fenwick_for, sa AS fenwick_against, sf / (CASE WHEN sf + sa = 0 THEN 1 ELSE sf + sa END) AS fenwick_for_pct FROM g""",
)
def p25(spark, d):
    over, blocked = F.col("l_linestatus") == "O", F.col("l_returnflag") == "R"
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("game_id")).agg(
        F.count_if(over).alias("sf"), F.count_if(~over).alias("sa"), F.count_if(over & blocked).alias("bf"), F.count_if(~over & blocked).alias("ba")
    )
    return ft.shot_shares(g, "sf", "bf", "sa", "ba").drop("sf", "sa", "bf", "ba")
