"""M: scalar expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from formbook.functions import odds as O
from formbook.functions import text as X
from formbook.plans.frames import BETS, bets, decimal_sql, prob_sql, table, with_sql
from formbook.plans.registry import query

KEYS = ["game_id", "seq", "entity_id", "venue"]
KEYS_SQL = "game_id, seq, entity_id, venue"


@query(
    "m1_implied_probability",
    with_sql(BETS)
    + f"""SELECT {KEYS_SQL}, {prob_sql('odds_over')} AS prob_over, {prob_sql('odds_under')} AS prob_under,
      CASE WHEN abs(odds_over / 2) >= 100 THEN {prob_sql('(odds_over / 2)')} END AS strict_prob FROM bets""",
)
def m1(spark, d):
    b = bets(spark, d)
    return b.select(
        *KEYS,
        O.american_to_prob(F.col("odds_over")).alias("prob_over"),
        O.american_to_prob(F.col("odds_under")).alias("prob_under"),
        O.american_to_prob_strict(F.col("odds_over") / 2).alias("strict_prob"),
    )


@query(
    "m2_price_conversion",
    with_sql(BETS)
    + f"""SELECT {KEYS_SQL}, {decimal_sql('odds')} AS price, CAST(CASE WHEN {decimal_sql('odds')} >= 2
        THEN round_even(({decimal_sql('odds')} - 1) * 100, 0) ELSE round_even(-100 / ({decimal_sql('odds')} - 1), 0) END AS BIGINT) AS american,
      CAST(CASE WHEN 1.505 + stake / 10 >= 2 THEN trunc((1.505 + stake / 10 - 1) * 100) ELSE trunc(-100 / (1.505 + stake / 10 - 1)) END AS BIGINT) AS american_cut,
      CASE WHEN odds <= -100 THEN 100.0 / -odds WHEN odds >= 100 THEN odds / 100.0 END AS profit_per_unit FROM bets""",
)
def m2(spark, d):
    b = bets(spark, d)
    price = O.american_to_decimal(F.col("odds"))
    return b.select(
        *KEYS,
        price.alias("price"),
        O.decimal_to_american(price).alias("american"),
        O.decimal_to_american_truncated(1.505 + F.col("stake") / 10).alias("american_cut"),
        O.profit_per_unit(F.col("odds")).alias("profit_per_unit"),
    )


@query(
    "m3_odds_validity",
    """WITH raw AS (
      SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'x' || event_id WHEN 2 THEN CAST(event_id % 150 AS VARCHAR)
        WHEN 3 THEN CAST(-(event_id % 300) AS VARCHAR) WHEN 4 THEN CAST(value AS VARCHAR) ELSE CAST(100 + event_id % 400 AS VARCHAR) END AS odds_text
      FROM events)
    SELECT event_id, CASE WHEN odds_text IS NULL THEN '' WHEN try_cast(odds_text AS DOUBLE) IS NULL THEN 'not numeric'
      WHEN try_cast(odds_text AS DOUBLE) > -100 AND try_cast(odds_text AS DOUBLE) < 100 THEN 'between -100 and 100'
      WHEN try_cast(odds_text AS DOUBLE) <> floor(try_cast(odds_text AS DOUBLE)) THEN 'not whole' ELSE '' END AS problem
    FROM raw""",
)
def m3(spark, d):
    e = table(spark, d, "events")
    i, kind = F.col("event_id"), F.col("event_id") % 6
    raw = (
        F.when(kind == 0, F.lit(None).cast("string"))
        .when(kind == 1, F.concat(F.lit("x"), i.cast("string")))
        .when(kind == 2, (i % 150).cast("string"))
        .when(kind == 3, (-(i % 300)).cast("string"))
        .when(kind == 4, F.col("value").cast("string"))
        .otherwise((100 + i % 400).cast("string"))
    )
    return e.withColumn("odds_text", raw).select("event_id", O.odds_problem(F.col("odds_text")).alias("problem"))


_PO, _PU = prob_sql("odds_over"), prob_sql("odds_under")


@query(
    "m4_expected_value",
    with_sql(BETS)
    + f"""SELECT {KEYS_SQL}, p_over - {_PO} AS edge_over,
      p_over * (CASE WHEN odds_over < 0 THEN 100.0 / -odds_over ELSE odds_over / 100.0 END) - p_under AS true_ev_over,
      p_over / (p_over + p_under) - {_PO} / ({_PO} + {_PU}) AS novig_edge_over FROM bets""",
)
def m4(spark, d):
    c = F.col
    return bets(spark, d).select(
        *KEYS,
        O.edge(c("p_over"), c("odds_over")).alias("edge_over"),
        O.true_ev(c("p_over"), c("p_under"), c("odds_over")).alias("true_ev_over"),
        O.novig_edge(c("p_over"), c("p_under"), c("odds_over"), c("odds_under")).alias("novig_edge_over"),
    )


@query(
    "m5_devig_pair",
    with_sql(BETS)
    + f"""SELECT {KEYS_SQL}, {_PO} / ({_PO} + {_PU}) AS fair_american,
      (1 / {decimal_sql('odds_over')}) / (1 / {decimal_sql('odds_over')} + 1 / {decimal_sql('odds_under')}) AS fair_decimal FROM bets""",
)
def m5(spark, d):
    c = F.col
    over, under = O.american_to_decimal(c("odds_over")), O.american_to_decimal(c("odds_under"))
    return bets(spark, d).select(
        *KEYS, O.devig_american(c("odds_over"), c("odds_under")).alias("fair_american"), O.devig_decimal(over, under).alias("fair_decimal")
    )


@query(
    "m5_devig_outcome_group",
    """WITH o AS (SELECT l_orderkey, l_suppkey % 3 AS grp, l_linenumber, l_partkey, l_suppkey, l_shipdate,
           CASE WHEN l_tax > 0 THEN 1 + l_tax * 20 END AS price FROM lineitem),
    t AS (SELECT l_orderkey, grp, count(*) AS n, count(price) AS priced, sum(1 / price) AS total FROM o GROUP BY ALL)
    SELECT l_orderkey, grp, l_linenumber, l_partkey, l_suppkey, CASE WHEN n = 2 AND priced = 2 THEN (1 / price) / total END AS p_devig
    FROM o JOIN t USING (l_orderkey, grp)""",
)
def m5_group(spark, d):
    from formbook.operators.quotes import devig_group

    o = table(spark, d, "lineitem").select(
        "l_orderkey", (F.col("l_suppkey") % 3).alias("grp"), "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_tax") > 0, 1 + F.col("l_tax") * 20).alias("price"),
    )
    return devig_group(o, ["l_orderkey", "grp"], "price").drop("price")


@query(
    "m6_bet_decision",
    with_sql(BETS)
    + f"""SELECT {KEYS_SQL},
      CASE WHEN p_over - {_PO} >= 0.02 AND p_over - {_PO} > p_under - {_PU} THEN 'OVER' WHEN p_under - {_PU} >= 0.02 THEN 'UNDER' END AS ev_bet,
      CASE WHEN flag = 'N' THEN (CASE WHEN p_over > 0.55 THEN 'OVER' WHEN p_over < 0.45 THEN 'UNDER' ELSE 'NO BET' END)
        WHEN p_over - {_PO} >= 0.02 AND (NOT (1 - p_over - {_PU} >= 0.02) OR p_over - {_PO} > 1 - p_over - {_PU}) THEN 'OVER'
        WHEN 1 - p_over - {_PU} >= 0.02 THEN 'UNDER' ELSE 'NO BET' END AS recommendation,
      CASE WHEN p_under - {_PU} >= 0.02 THEN 'UNDER' END AS under_only,
      greatest(p_over - {_PO}, p_under - {_PU}) AS best_ev FROM bets""",
)
def m6(spark, d):
    c = F.col
    b = bets(spark, d)
    ev_o, ev_u = O.edge(c("p_over"), c("odds_over")), O.edge(c("p_under"), c("odds_under"))
    priced = c("flag") != "N"
    return b.select(
        *KEYS,
        O.ev_side(ev_o, ev_u, F.lit(0.02)).alias("ev_bet"),
        O.recommendation(c("p_over"), F.when(priced, c("odds_over")), F.when(priced, c("odds_under")), 0.02).alias("recommendation"),
        O.under_only(ev_u, 0.02).alias("under_only"),
        O.best_ev(ev_o, ev_u).alias("best_ev"),
    )


@query(
    "m7_grade_and_profit",
    with_sql(BETS)
    + f"""SELECT {KEYS_SQL}, result, profit,
      CAST(CASE result WHEN 'WIN' THEN stake * (CASE WHEN flag = 'N' THEN 100.0 / 110 ELSE {decimal_sql('odds')} - 1 END)
        WHEN 'LOSS' THEN -stake ELSE 0 END AS DOUBLE) AS profit_fallback FROM bets""",
)
def m7(spark, d):
    c = F.col
    price = F.when(c("flag") != "N", c("odds"))
    return bets(spark, d).select(*KEYS, "result", "profit", O.profit(c("result"), price, c("stake")).alias("profit_fallback"))


@query(
    "m8_closing_line_value",
    with_sql(BETS)
    + f"""SELECT {KEYS_SQL}, CASE WHEN side = 'OVER' THEN actual - line ELSE -(actual - line) END AS line_clv,
      p_over - {_PO} / ({_PO} + {_PU}) AS prob_clv, {decimal_sql('odds')} / {decimal_sql('odds_under')} - 1 AS price_clv FROM bets""",
)
def m8(spark, d):
    c = F.col
    return bets(spark, d).select(
        *KEYS,
        O.line_clv(c("side"), c("line"), c("actual")).alias("line_clv"),
        O.prob_clv(O.devig_american(c("odds_over"), c("odds_under")), c("p_over")).alias("prob_clv"),
        O.price_clv(O.american_to_decimal(c("odds")), O.american_to_decimal(c("odds_under"))).alias("price_clv"),
    )


@query(
    "m9_normalise_timestamps",
    """SELECT event_id, CASE event_id % 6 WHEN 5 THEN NULL
        WHEN 3 THEN strftime(date_trunc('second', ts) - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ')
        ELSE strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') END AS utc_text FROM events""",
)
def m9(spark, d):
    kind = F.col("event_id") % 6
    body = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(kind == 0, F.concat(body, F.lit("Z")))
        .when(kind == 1, F.concat(body, F.lit("+00:00")))
        .when(kind == 2, F.concat(body, F.lit(".250Z")))
        .when(kind == 3, F.concat(body, F.lit("+02:00")))
        .when(kind == 4, F.concat(F.lit("  "), body))
        .otherwise(F.concat(F.lit("at "), body))
    )
    return table(spark, d, "events").select("event_id", X.utc_text(X.to_utc(text)).alias("utc_text"))


@query(
    "m10_eastern_date_and_anchor",
    """WITH e AS (SELECT event_id, ts, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS eastern_date FROM events)
    SELECT event_id, eastern_date,
      epoch_us(least(CAST(eastern_date AS TIMESTAMP) + INTERVAL 1350 MINUTE, ts - INTERVAL 30 MINUTE)) AS anchor_us FROM e""",
)
def m10(spark, d):
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select(
        "event_id", X.eastern_date(ts).alias("eastern_date"), F.unix_micros(X.bettime_anchor(ts)).alias("anchor_us")
    )


@query(
    "m11_normalise_names",
    """WITH w AS (SELECT doc_id, split_part(text, '.', 1) AS name FROM documents)
    SELECT doc_id, lower(trim(strip_accents(name))) AS plain,
      lower(trim(strip_accents(list_extract(string_split_regex(trim(name), '\\s+'), -1)))) AS last_plain FROM w""",
)
def m11(spark, d):
    name = F.element_at(F.split("text", r"\."), 1)
    return table(spark, d, "documents").select(
        "doc_id", X.plain_name(name).alias("plain"), X.plain_name(X.last_name(name)).alias("last_plain")
    )


@query(
    "m11_person_keys",
    r"""WITH c AS (SELECT c_custkey, upper(substr(c_mktsegment, 1, 1)) || '. O''Nøeał-' || lower(c_mktsegment) || CASE c_custkey % 3 WHEN 0 THEN ' Jr' WHEN 1 THEN ' III (G)' ELSE '' END AS name FROM customer),
    p AS (SELECT c_custkey, list_filter(string_split_regex(regexp_replace(lower(regexp_replace(replace(trim(split_part(name, '(', 1)), '''', ''), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g'), ' '),
           lambda x: x <> '' AND x NOT IN ('jr', 'sr', 'ii', 'iii', 'iv')) AS words FROM c)
    SELECT c_custkey, array_to_string(words, ' ') AS person, substr(array_to_string(words, ' '), 1, 1) AS initial, words[-1] AS last FROM p""",
)
def m11_keys(spark, d):
    seg = F.col("c_mktsegment")
    suffix = F.when(F.col("c_custkey") % 3 == 0, F.lit(" Jr")).when(F.col("c_custkey") % 3 == 1, F.lit(" III (G)")).otherwise(F.lit(""))
    name = F.concat(F.upper(F.substring(seg, 1, 1)), F.lit(". O'Nøeał-"), F.lower(seg), suffix)
    return table(spark, d, "customer").select(
        "c_custkey", X.person_name(name).alias("person"), X.person_initial(name).alias("initial"), X.person_last(name).alias("last")
    )


@query(
    "m12_map_codes",
    """SELECT s_suppkey, CASE s_nationkey % 4 WHEN 0 THEN 'MTL' WHEN 1 THEN 'STL' WHEN 2 THEN 'UTA' END AS team_code FROM supplier""",
)
def m12(spark, d):
    k = F.col("s_nationkey") % 4
    name = (
        F.when(k == 0, F.lit("Montréal Canadiens")).when(k == 1, F.lit("St. Louis Blues"))
        .when(k == 2, F.lit("Utah Mammoth")).otherwise(F.lit("Nobody"))
    )
    return table(spark, d, "supplier").select("s_suppkey", X.map_code(name, X.TEAM_CODES).alias("team_code"))


@query(
    "m12_canonical_books",
    """SELECT r_name, count(*) AS n_suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
)
def m12_books(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    dims = nation.join(region, nation.n_regionkey == region.r_regionkey)
    s = table(spark, d, "supplier")
    return s.join(dims, s.s_nationkey == dims.n_nationkey).groupBy("r_name").agg(F.count(F.lit(1)).alias("n_suppliers"))


@query(
    "m13_clock_and_fraction",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 60 AS DOUBLE) + CAST(event_id % 59 AS DOUBLE) / 60.0 END AS minutes,
      CAST(CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 30 END AS INTEGER) AS made, CAST(CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 30 + 2 END AS INTEGER) AS tried FROM events""",
)
def m13(spark, d):
    i = F.col("event_id")
    clock = F.when(i % 5 == 0, F.lit("n/a")).otherwise(F.concat_ws(":", (i % 60).cast("string"), (i % 59).cast("string")))
    frac = F.when(i % 4 == 0, F.lit("x/")).otherwise(F.concat_ws("/", (i % 30).cast("string"), (i % 30 + 2).cast("string")))
    made, tried = X.fraction_parts(F.col("frac"))
    return (
        table(spark, d, "events").select("event_id", clock.alias("clock"), frac.alias("frac"))
        .select("event_id", X.clock_minutes(F.col("clock")).alias("minutes"), made.alias("made"), tried.alias("tried"))
    )


@query(
    "m18_safe_divide",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / nullif(l_discount, 0) AS ratio FROM lineitem""",
)
def m18(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", O.safe_div(F.col("l_extendedprice"), F.col("l_discount")).alias("ratio")
    )


@query(
    "m19_row_checksum",
    """SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}') AS checksum FROM orders""",
)
def m19(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.row_checksum("o_orderkey", "o_custkey", "o_orderpriority").alias("checksum"))


@query(
    "m20_credit_cost",
    """WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'h2h,totals' WHEN 1 THEN 'h2h, h2h ,' ELSE 'player_total_saves' END AS markets,
        CASE WHEN event_id % 2 = 0 THEN 'us' ELSE 'us,eu' END AS regions FROM events)
    SELECT markets, regions, count(*) AS n_calls, CAST(sum(10 * (CASE WHEN markets = 'h2h,totals' THEN 2 ELSE 1 END) * (CASE WHEN regions = 'us' THEN 1 ELSE 2 END)) AS BIGINT) AS credits
    FROM r GROUP BY ALL""",
)
def m20(spark, d):
    i = F.col("event_id")
    markets = F.when(i % 3 == 0, F.lit("h2h,totals")).when(i % 3 == 1, F.lit("h2h, h2h ,")).otherwise(F.lit("player_total_saves"))
    regions = F.when(i % 2 == 0, F.lit("us")).otherwise(F.lit("us,eu"))
    r = table(spark, d, "events").select(markets.alias("markets"), regions.alias("regions"))
    return r.groupBy("markets", "regions").agg(
        F.count(F.lit(1)).alias("n_calls"), F.sum(O.credit_cost(F.col("markets"), F.col("regions"))).alias("credits")
    )


@query(
    "p16_snapshot_pass",
    """SELECT event_id, CASE WHEN ts >= CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 715 MINUTE THEN 'closing' ELSE 'bettime' END AS snapshot_pass FROM events""",
)
def p16(spark, d):
    start = F.col("ts").cast("date").cast("timestamp_ntz") + F.expr("INTERVAL '12' HOUR")
    return table(spark, d, "events").select("event_id", X.snapshot_pass(F.col("ts"), start).alias("snapshot_pass"))


@query(
    "p15_season_label",
    """SELECT event_id, CASE WHEN CAST(ts AS DATE) BETWEEN DATE '2023-08-01' AND DATE '2024-01-10' THEN '2023-24'
      WHEN CAST(ts AS DATE) BETWEEN DATE '2024-01-11' AND DATE '2024-01-20' THEN '2024-25' ELSE 'other' END AS season FROM events""",
)
def p15(spark, d):
    bounds = [("2023-24", "2023-08-01", "2024-01-10"), ("2024-25", "2024-01-11", "2024-01-20")]
    return table(spark, d, "events").select("event_id", X.season_label(F.to_date("ts"), bounds).alias("season"))


@query(
    "p15_season_dimension",
    """WITH s(season, a, b) AS (VALUES ('early', DATE '1995-01-01', DATE '1997-06-30'), ('late', DATE '1997-07-01', DATE '1999-12-31'))
    SELECT coalesce(season, 'other') AS season, count(*) AS n_rows, sum(o_totalprice) AS total
    FROM orders LEFT JOIN s ON CAST(o_orderdate AS DATE) BETWEEN a AND b GROUP BY 1""",
)
def p15_dim(spark, d):
    from formbook.operators.joins import season_of

    dim = spark.sql(
        "SELECT * FROM VALUES ('early', DATE '1995-01-01', DATE '1997-06-30'), ('late', DATE '1997-07-01', DATE '1999-12-31') AS s(season, start_date, end_date)"
    )
    rows = season_of(table(spark, d, "orders"), dim, "o_orderdate")
    return rows.groupBy("season").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("o_totalprice").alias("total"))
