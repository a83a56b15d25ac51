"""W: prior-only window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from formbook.operators import windows as wn
from formbook.operators.grading import recent_performance
from formbook.operators.joins import both_sides
from formbook.operators.quotes import earliest_snapshot, group_context, paired
from formbook.operators.skew import EVEN
from formbook.plans.frames import BETS, FORM, PAIRS, QUOTE_POSITION, SNAPSHOTS, bets, form, quotes, snapshots, table, with_sql
from formbook.plans.projections import SHOTS, shots_frame
from formbook.plans.registry import query

ENTITY, ORDER = ["entity_id"], ["game_date", "game_id"]


def over(part, order, frame):
    return f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {frame})"


@query(
    "w1_prior_rolling",
    with_sql(FORM)
    + "SELECT game_id, entity_id, "
    + ", ".join(
        f"avg({v}) OVER {over('entity_id', 'game_date, game_id', f'{w} PRECEDING AND 1 PRECEDING')} AS {v}_rolling_{w}, "
        f"stddev_samp({v}) OVER {over('entity_id', 'game_date, game_id', f'{w} PRECEDING AND 1 PRECEDING')} AS {v}_rolling_std_{w}"
        for w in (3, 5, 10) for v in ("value", "shots")
    )
    + " FROM form",
)
def w1(spark, d):
    out = wn.prior_rolling(form(spark, d), ENTITY, ORDER, ["value", "shots"], (3, 5, 10))
    return out.select("game_id", "entity_id", *[f"{v}_rolling{s}_{w}" for w in (3, 5, 10) for v in ("value", "shots") for s in ("", "_std")])


@query(
    "w1_prior_rolling_population",
    with_sql(FORM)
    + f"SELECT game_id, stddev_pop(value) OVER {over('entity_id', 'game_date, game_id', '5 PRECEDING AND 1 PRECEDING')} AS value_rolling_std_5 FROM form",
)
def w1_pop(spark, d):
    return wn.prior_rolling(form(spark, d), ENTITY, ORDER, ["value"], (5,), ddof=0).select("game_id", "value_rolling_std_5")


@query(
    "w2_team_and_opponent_rolling",
    with_sql(FORM, """tg AS (SELECT team_id, game_date, sum(value) AS value, count(*) AS n FROM form GROUP BY ALL)""",
             f"tr AS (SELECT team_id, game_date, avg(value) OVER {over('team_id', 'game_date', '5 PRECEDING AND 1 PRECEDING')} AS r FROM tg)")
    + """SELECT f.game_id, a.r AS own_value_rolling_5, b.r AS opp_value_rolling_5 FROM form f LEFT JOIN tr a ON a.team_id = f.team_id AND a.game_date = f.game_date
    LEFT JOIN tr b ON b.team_id = (f.team_id + 1) % 30 AND b.game_date = f.game_date""",
)
def w2(spark, d):
    f = form(spark, d)
    daily = f.groupBy("team_id", "game_date").agg(F.sum("value").alias("value"))
    ratings = wn.prior_rolling(daily, ["team_id"], ["game_date"], ["value"], (5,)).drop("value")
    games = f.withColumn("opponent_id", (F.col("team_id") + 1) % 30)
    out = both_sides(games, ratings, ["game_date"], "team_id", "team_id", "opponent_id", ["value_rolling_5"])
    return out.select("game_id", "own_value_rolling_5", "opp_value_rolling_5")


@query(
    "w3_shot_quality_rolling",
    with_sql(SHOTS, """g AS (SELECT goalie_id, game_id, count(*) FILTER (danger = 'high') AS high_shots, sum(is_goal) / count(*) AS shooting_pct FROM shots GROUP BY ALL)""")
    + f"""SELECT goalie_id, game_id, avg(high_shots) OVER {over('goalie_id', 'game_id', '5 PRECEDING AND 1 PRECEDING')} AS high_shots_rolling_5,
      avg(shooting_pct) OVER {over('goalie_id', 'game_id', '5 PRECEDING AND 1 PRECEDING')} AS shooting_pct_rolling_5 FROM g""",
)
def w3(spark, d):
    g = shots_frame(spark, d).groupBy("goalie_id", "game_id").agg(
        F.count_if(F.col("danger") == "high").alias("high_shots"), (F.sum("is_goal") / F.count(F.lit(1))).alias("shooting_pct")
    )
    out = wn.prior_rolling(g, ["goalie_id"], ["game_id"], ["high_shots", "shooting_pct"], (5,))
    return out.select("goalie_id", "game_id", "high_shots_rolling_5", "shooting_pct_rolling_5")


@query(
    "w4_prior_expanding",
    with_sql(FORM)
    + """SELECT game_id, avg(value) OVER w AS value_avg, CASE WHEN count(value) OVER w >= 2 THEN stddev_pop(value) OVER w END AS value_std,
      count(*) OVER w AS value_games_prior FROM form WINDOW w AS (PARTITION BY entity_id, season ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def w4(spark, d):
    out = wn.prior_expanding(form(spark, d), ["entity_id", "season"], ORDER, "value", "value")
    return out.select("game_id", "value_avg", "value_std", "value_games_prior")


@query(
    "w5_prior_ema",
    with_sql(FORM, "n AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY game_date, game_id) AS rn FROM form)")
    + """SELECT a.game_id, sum(b.value * pow(2.0 / 3, a.rn - 1 - b.rn) * (CASE WHEN b.rn = 1 THEN 1 ELSE 1.0 / 3 END)) AS value_ema5
    FROM n a LEFT JOIN n b ON a.entity_id = b.entity_id AND b.rn < a.rn GROUP BY a.game_id""",
)
def w5(spark, d):
    return wn.prior_ema(form(spark, d), ENTITY, ORDER, "value", 5).select("game_id", "value_ema5")


@query(
    "w5_prior_ema_with_gaps",
    "WITH RECURSIVE " + FORM
    + """, src AS (SELECT game_id, entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY game_date, game_id) AS rn,
        CASE WHEN game_id % 4 <> 0 THEN value END AS x FROM form),
    e AS (SELECT game_id, entity_id, rn, x, CAST(x AS DOUBLE) AS m, CAST(1.0 AS DOUBLE) AS w FROM src WHERE rn = 1
      UNION ALL
      SELECT t.game_id, t.entity_id, t.rn, t.x,
        CASE WHEN t.x IS NULL THEN e.m WHEN e.m IS NULL THEN t.x ELSE (e.w * (1 - 1 / 3::DOUBLE) * e.m + t.x / 3::DOUBLE) / (e.w * (1 - 1 / 3::DOUBLE) + 1 / 3::DOUBLE) END,
        CASE WHEN t.x IS NULL AND e.m IS NOT NULL THEN e.w * (1 - 1 / 3::DOUBLE) ELSE 1.0 END
      FROM e JOIN src t ON t.entity_id = e.entity_id AND t.rn = e.rn + 1)
    SELECT game_id, lag(m) OVER (PARTITION BY entity_id ORDER BY rn) AS gapped_ema5 FROM e""",
)
def w5_gaps(spark, d):
    f = form(spark, d).withColumn("gapped", F.when(F.col("game_id") % 4 != 0, F.col("value")))
    return wn.prior_ema(f, ENTITY, ORDER, "gapped", 5).select("game_id", "gapped_ema5")


@query(
    "w5_prior_ema_long_gap",
    "WITH RECURSIVE " + FORM
    + """, src AS (SELECT game_id, team_id, row_number() OVER (PARTITION BY team_id ORDER BY game_date, game_id) AS rn,
        CASE WHEN season NOT BETWEEN 1993 AND 1995 THEN value END AS x FROM form),
    e AS (SELECT game_id, team_id, rn, x, CAST(x AS DOUBLE) AS m, CAST(1.0 AS DOUBLE) AS w FROM src WHERE rn = 1
      UNION ALL
      SELECT t.game_id, t.team_id, t.rn, t.x,
        CASE WHEN t.x IS NULL THEN e.m WHEN e.m IS NULL THEN t.x ELSE (e.w * (1 - 1 / 3::DOUBLE) * e.m + t.x / 3::DOUBLE) / (e.w * (1 - 1 / 3::DOUBLE) + 1 / 3::DOUBLE) END,
        CASE WHEN t.x IS NULL AND e.m IS NOT NULL THEN e.w * (1 - 1 / 3::DOUBLE) ELSE 1.0 END
      FROM e JOIN src t ON t.team_id = e.team_id AND t.rn = e.rn + 1)
    SELECT game_id, lag(m) OVER (PARTITION BY team_id ORDER BY rn) AS gapped_ema5 FROM e""",
)
def w5_long_gap(spark, d):
    """Three seasons without values: the gap is longer than the frame."""
    f = form(spark, d).withColumn("gapped", F.when(~F.col("season").between(1993, 1995), F.col("value")))
    return wn.prior_ema(f, ["team_id"], ORDER, "gapped", 5).select("game_id", "gapped_ema5")


@query(
    "w6_rest_days",
    with_sql(FORM)
    + """, r AS (SELECT game_id, date_diff('day', lag(game_date) OVER (PARTITION BY entity_id ORDER BY game_date, game_id), game_date) AS gap FROM form)
    SELECT game_id, CAST(coalesce(gap, 7) AS INTEGER) AS days_rest, CAST(coalesce(gap, 7) <= 1 AS INTEGER) AS is_back_to_back FROM r""",
)
def w6(spark, d):
    return wn.rest_days(form(spark, d), ENTITY, ORDER, "game_date", fill=7).select("game_id", "days_rest", "is_back_to_back")


@query(
    "w7_games_last_four_days",
    with_sql(FORM)
    + """SELECT game_id, count(*) OVER w AS games_last_4_days, CAST(count(*) OVER w >= 3 AS INTEGER) AS is_3_in_4 FROM form
    WINDOW w AS (PARTITION BY team_id ORDER BY game_date RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND CURRENT ROW)""",
)
def w7(spark, d):
    out = wn.games_last_days(form(spark, d), ["team_id"], "game_date")
    return out.select("game_id", "games_last_4_days", (F.col("games_last_4_days") >= 3).cast("int").alias("is_3_in_4"))


@query(
    "w8_recent_games",
    with_sql(FORM)
    + """SELECT entity_id, game_id, CAST(rn AS INTEGER) AS recency FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY game_date DESC, game_id DESC) AS rn
      FROM form WHERE game_date < DATE '2000-06-01') WHERE rn <= 10""",
)
def w8(spark, d):
    before = form(spark, d).where(F.col("game_date") < F.lit("2000-06-01").cast("date"))
    return wn.recent_rows(before, ENTITY, [F.desc("game_date"), F.desc("game_id")], 10).select("entity_id", "game_id", "recency")


_LEAGUE = """day AS (SELECT season, game_date, count(value) AS n, sum(value) AS s, sum(value * value) AS q FROM form GROUP BY ALL),
  cum AS (SELECT season, game_date, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(q) OVER w AS q FROM day
    WINDOW w AS (PARTITION BY season ORDER BY game_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  league AS (SELECT season, game_date, coalesce(n, 0) AS n, s / n AS m, sqrt(greatest(q / n - (s / n) * (s / n), 0)) AS sd FROM cum)"""


@query(
    "w9_prior_league_stats",
    with_sql(FORM, _LEAGUE)
    + "SELECT season, game_date AS league_date, CAST(n AS BIGINT) AS prior_count, m AS prior_mean, CASE WHEN n > 1 THEN sd END AS prior_std FROM league",
)
def w9(spark, d):
    out = wn.prior_league(form(spark, d), ["season"], "game_date", "value")
    # a single earlier row has no spread; both engines would show only rounding there
    return out.withColumn("prior_std", F.when(F.col("prior_count") > 1, F.col("prior_std")))


@query(
    "w9_prior_league_z",
    with_sql(FORM, _LEAGUE)
    + "SELECT game_id, CASE WHEN n >= 5 THEN (value - m) / nullif(sd, 0) END AS league_z FROM form LEFT JOIN league USING (season, game_date)",
)
def w9_z(spark, d):
    out = wn.prior_league_z(form(spark, d), ["season"], "game_date", "value", "league_z")
    return out.select("game_id", F.when(F.col("prior_count") >= 5, F.col("league_z")).alias("league_z"))


@query(
    "w10_earliest_snapshot",
    with_sql(SNAPSHOTS)
    + "SELECT id, entity_id, game_date FROM snapshots QUALIFY fetched_at = min(fetched_at) OVER (PARTITION BY entity_id, game_date)",
)
def w10(spark, d):
    return earliest_snapshot(snapshots(spark, d), ["entity_id", "game_date"], "fetched_at").select("id", "entity_id", "game_date")


def _versions(spark, d):
    return snapshots(spark, d).withColumns(
        {"resolved": F.when(F.col("id") % 5 != 0, F.date_trunc("hour", "fetched_at")), "requested": F.date_trunc("day", "fetched_at")}
    )


_VERSIONS = "v AS (SELECT *, CASE WHEN id % 5 <> 0 THEN date_trunc('hour', fetched_at) END AS resolved, date_trunc('day', fetched_at) AS requested FROM snapshots)"


@query(
    "w11_latest_version_keep_last",
    with_sql(SNAPSHOTS, _VERSIONS)
    + "SELECT entity_id, book, id, line FROM v QUALIFY row_number() OVER (PARTITION BY entity_id, book ORDER BY resolved DESC NULLS LAST, requested DESC NULLS LAST, id DESC) = 1",
)
def w11(spark, d):
    return wn.latest_version(_versions(spark, d), ["entity_id", "book"], "resolved", "requested", ["id"]).select("entity_id", "book", "id", "line")


@query(
    "w11_latest_version_keep_first",
    with_sql(SNAPSHOTS, _VERSIONS)
    + "SELECT entity_id, book, id, line FROM v QUALIFY row_number() OVER (PARTITION BY entity_id, book ORDER BY resolved DESC NULLS LAST, requested DESC NULLS LAST, id) = 1",
)
def w11_first(spark, d):
    out = wn.latest_version(_versions(spark, d), ["entity_id", "book"], "resolved", "requested", ["id"], keep="first")
    return out.select("entity_id", "book", "id", "line")


@query(
    "w11_version_ties",
    with_sql(SNAPSHOTS, _VERSIONS)
    + """, s AS (SELECT entity_id, book, count(*) AS n, rank() OVER (PARTITION BY entity_id, book ORDER BY resolved DESC NULLS LAST, requested DESC NULLS LAST) AS r FROM v GROUP BY entity_id, book, resolved, requested)
    SELECT count(*) FILTER (r = 1) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (r = 1 AND n > 1) AS n_tied FROM s""",
)
def w11_ties(spark, d):
    return wn.version_ties(_versions(spark, d), ["entity_id", "book"], "resolved", "requested")


@query("w12_last_append", with_sql(SNAPSHOTS) + "SELECT entity_id, game_date, max(id) AS id, arg_max(line, id) AS line FROM snapshots GROUP BY ALL")
def w12(spark, d):
    return snapshots(spark, d).groupBy("entity_id", "game_date").agg(F.max("id").alias("id"), F.max_by("line", "id").alias("line"))


@query(
    "w13_one_per_entity_night",
    with_sql(BETS)
    + "SELECT entity_id, bet_date, game_id, seq, venue, p_over FROM bets QUALIFY row_number() OVER (PARTITION BY entity_id, bet_date ORDER BY game_id, seq, venue) = 1",
)
def w13(spark, d):
    out = wn.first_per_key(bets(spark, d), ["entity_id", "bet_date"], wn.cols(["game_id", "seq", "venue"]))
    return out.select("entity_id", "bet_date", "game_id", "seq", "venue", "p_over")


@query(
    "w14_line_shop",
    with_sql(BETS)
    + "SELECT game_id, entity_id, seq, venue, amount FROM bets QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY p_over DESC, amount DESC, seq DESC, entity_id DESC, venue DESC) = 1",
)
def w14(spark, d):
    key = [F.desc(c) for c in ("p_over", "amount", "seq", "entity_id", "venue")]
    return wn.first_per_key(bets(spark, d), ["game_id"], key).select("game_id", "entity_id", "seq", "venue", "amount")


def pairs(spark, d):
    return paired(quotes(spark, d), ["event_id", "book", "line"], "side", "price", QUOTE_POSITION)


@query(
    "w15_group_context",
    with_sql(PAIRS)
    + """, c AS (SELECT event_id, line, count(*) AS n FROM pairs GROUP BY ALL),
    m AS (SELECT event_id, arg_max(line, (n, -line)) AS modal_line FROM c GROUP BY 1),
    s AS (SELECT event_id, count(DISTINCT book) AS n_books, max(line) - min(line) AS line_spread FROM pairs GROUP BY 1)
    SELECT event_id, book, line, n_books, line_spread, modal_line, CAST(line <> modal_line AS INTEGER) AS off_modal FROM pairs JOIN s USING (event_id) JOIN m USING (event_id)""",
)
def w15(spark, d):
    out = group_context(pairs(spark, d), ["event_id"], "line", "book")
    return out.select("event_id", "book", "line", "n_books", "line_spread", "modal_line", "off_modal")


@query(
    "w16_last_n_bets",
    with_sql(BETS)
    + """, r AS (SELECT *, row_number() OVER (ORDER BY bet_date DESC, game_id DESC, seq DESC, entity_id DESC, venue DESC) AS rn FROM bets),
    n AS (SELECT unnest([10, 20, 50]) AS win)
    SELECT CAST(win AS INTEGER) AS "window", count(*) AS bets, count(*) FILTER (result = 'WIN') AS wins, count(*) FILTER (result = 'LOSS') AS losses, count(*) FILTER (result = 'PUSH') AS pushes,
      coalesce(count(*) FILTER (result = 'WIN') / nullif(count(*) FILTER (result IN ('WIN', 'LOSS')), 0), 0.0) AS win_rate, sum(profit) AS profit_total, sum(stake) AS units, sum(profit) / sum(stake) * 100 AS roi
    FROM n JOIN r ON rn <= win GROUP BY win""",
)
def w16(spark, d):
    order = [F.desc(c) for c in ("bet_date", "game_id", "seq", "entity_id", "venue")]
    return recent_performance(bets(spark, d), order, [10, 20, 50])


@query(
    "w17_forward_min_clip",
    with_sql(PAIRS)
    + """, c AS (SELECT event_id, book, line, p_over, min(p_over) OVER (PARTITION BY event_id, book ORDER BY line) AS p_clipped FROM pairs)
    SELECT event_id, book, line, p_clipped, CAST(p_over > p_clipped AS INTEGER) AS was_clipped FROM c""",
)
def w17(spark, d):
    # one row per rung: a ladder holds no more rows than there are distinct lines
    out = wn.forward_min_clip(pairs(spark, d), ["event_id", "book"], ["line"], "p_over", "p_clipped", EVEN)
    return out.select("event_id", "book", "line", "p_clipped", "was_clipped")


@query(
    "w18_balance_chain",
    """WITH b AS (SELECT user_id, event_id, CAST(1000000 - 10 * event_id - CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS remaining, CAST(10 AS DOUBLE) AS cost FROM events),
    l AS (SELECT *, lag(remaining) OVER (ORDER BY event_id) - cost AS expected_remaining FROM b)
    SELECT event_id, expected_remaining, CAST(coalesce(abs(expected_remaining - remaining) < 1e-9, true) AS INTEGER) AS chain_ok FROM l""",
)
def w18(spark, d):
    i = F.col("event_id")
    b = table(spark, d, "events").select(
        "event_id", (1000000 - 10 * i - F.when(i % 50 == 0, 1).otherwise(0)).cast("double").alias("remaining"), F.lit(10.0).alias("cost")
    )
    return wn.balance_chain(b, [], ["event_id"], "remaining", "cost").select("event_id", "expected_remaining", "chain_ok")


@query(
    "w19_evenly_spaced_sample",
    """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM events),
    p AS (SELECT unnest(range(25)) AS i)
    SELECT DISTINCT event_id FROM r JOIN p ON rn = CAST(round_even(i * (n - 1) / 24.0, 0) AS BIGINT) + 1""",
)
def w19(spark, d):
    return wn.evenly_spaced(table(spark, d, "events"), ["ts", "event_id"], 25).select("event_id")


@query("w20_frozen_sample", "SELECT event_id, md5('pilot' || event_id) AS draw FROM events ORDER BY draw LIMIT 100")
def w20(spark, d):
    return wn.frozen_sample(table(spark, d, "events"), F.col("event_id"), "pilot", 100).select("event_id", "draw")


@query(
    "w21_games_prior",
    with_sql(FORM) + "SELECT game_id, row_number() OVER (PARTITION BY team_id, season ORDER BY game_date, game_id) - 1 AS games_prior FROM form",
)
def w21(spark, d):
    from formbook.operators.skew import Running, running

    out = running(form(spark, d), ["team_id", "season"], wn.cols(ORDER), {"games_prior": Running("count", F.lit(1))}, prior=True)
    return out.select("game_id", "games_prior")


@query(
    "o2_ranked_opportunities",
    with_sql(BETS) + "SELECT game_id, seq, entity_id, venue, p_over + 0 AS score FROM bets",
)
def o2(spark, d):
    b = bets(spark, d).withColumn("score", F.col("p_over"))
    return b.orderBy(F.desc("score"), "game_id", "seq", "entity_id", "venue").select("game_id", "seq", "entity_id", "venue", "score")


@query(
    "o1_chronological_lag",
    with_sql(FORM) + "SELECT game_id, lag(value) OVER (PARTITION BY entity_id ORDER BY game_date, game_id) AS previous_value FROM form",
)
def o1(spark, d):
    from formbook.operators.skew import bounded_frame

    out = bounded_frame(form(spark, d), ENTITY, wn.cols(ORDER), lambda w: {"previous_value": F.lag("value").over(w)}, back=1)
    return out.select("game_id", "previous_value")
