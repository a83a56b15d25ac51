"""J: temporal, tolerant and contract joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from formbook.functions.text import identity_key
from formbook.operators import joins as jn
from formbook.operators.quotes import paired
from formbook.plans.frames import BETS, FORM, PAIRS, QUOTE_POSITION, SNAPSHOTS, bets, form, micros, quotes, snapshots, table, with_sql
from formbook.plans.registry import query


def pairs(spark, d):
    return paired(quotes(spark, d), ["event_id", "book", "line"], "side", "price", QUOTE_POSITION)


@query(
    "j1_enrich_many_to_one",
    """SELECT o_orderkey, c_mktsegment AS cust_c_mktsegment, c_acctbal AS cust_c_acctbal, CAST(c_custkey IS NOT NULL AS INTEGER) AS matched
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""",
)
def j1(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    return jn.enrich(table(spark, d, "orders"), c, ["o_custkey"], "cust_", check=True).select(
        "o_orderkey", "cust_c_mktsegment", "cust_c_acctbal", "matched"
    )


@query(
    "j2_negotiated_key",
    """SELECT l_returnflag, count(*) AS n_rows, count(o_orderkey) AS n_matched, sum(o_totalprice) AS total FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def j2(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("l_partkey"), "o_totalprice")
    li = table(spark, d, "lineitem")
    key = jn.choose_join_key(li, o, [["l_partkey"], ["l_orderkey"]])
    out = jn.enrich(li, o.select(*key, "o_totalprice"), key)
    return out.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("matched").cast("long")).alias("n_matched"), F.sum("o_totalprice").alias("total")
    )


@query(
    "j3_own_and_opponent_projection",
    """WITH r AS (SELECT s_nationkey AS team, avg(s_acctbal) AS rating FROM supplier GROUP BY 1)
    SELECT c_custkey, a.rating AS own_rating, b.rating AS opp_rating FROM customer LEFT JOIN r a ON a.team = c_nationkey LEFT JOIN r b ON b.team = (c_nationkey + 7) % 25""",
)
def j3(spark, d):
    r = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("team")).agg(F.avg("s_acctbal").alias("rating"))
    c = table(spark, d, "customer").withColumn("versus", (F.col("c_nationkey") + 7) % 25)
    return jn.both_sides(c, r, [], "team", "c_nationkey", "versus", ["rating"]).select("c_custkey", "own_rating", "opp_rating")


@query(
    "j4_opponent_row",
    """WITH t AS (SELECT conv_id, count(*) AS n, sum(length(text)) AS s FROM conversations GROUP BY 1)
    SELECT conv_id, turn, CASE WHEN n = 2 THEN CAST(s - length(text) AS BIGINT) END AS opp_n_chars FROM conversations JOIN t USING (conv_id)""",
)
def j4(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n_chars"))
    return jn.opponent_row(c, ["conv_id"], ["n_chars"]).select("conv_id", "turn", "opp_n_chars")


_ASKS = """asks AS (SELECT o_orderkey AS ask_id, o_custkey % 150 AS user_id, CAST('2024-01-01' AS TIMESTAMP) + to_minutes(CAST(o_orderkey * 37 % 43200 AS INTEGER)) AS asked_at FROM orders)"""


def asks(spark, d):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("ask_id"), (F.col("o_custkey") % 150).alias("user_id"),
        (start + F.make_dt_interval(mins=(F.col("o_orderkey") * 37 % 43200).cast("int"))).alias("asked_at"),
    )


@query(
    "j5_asof_join",
    with_sql(_ASKS)
    + """, e AS (SELECT user_id, ts, value, event_id FROM events)
    SELECT ask_id, e.event_id AS asof_event_id, e.value AS asof_value FROM asks ASOF LEFT JOIN e ON asks.user_id = e.user_id AND asks.asked_at >= e.ts""",
)
def j5(spark, d):
    out = jn.asof_join(asks(spark, d), table(spark, d, "events"), ["user_id"], "asked_at", "ts", ["event_id"], ["event_id", "value"], ["ask_id"])
    return out.select("ask_id", "asof_event_id", "asof_value")


@query(
    "j5_asof_join_with_fallback",
    with_sql(_ASKS)
    + """, e AS (SELECT user_id, lower(event_type) AS book, ts, value, event_id FROM events), l AS (SELECT user_id, book, max_by(event_id, ts) AS event_id FROM e GROUP BY ALL),
    a AS (SELECT ask_id, user_id, CASE ask_id % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'nobody' END AS book, asked_at FROM asks)
    SELECT ask_id, coalesce(e.event_id, l.event_id) AS asof_event_id FROM a ASOF LEFT JOIN e ON a.user_id = e.user_id AND a.book = e.book AND a.asked_at >= e.ts LEFT JOIN l ON l.user_id = a.user_id AND l.book = a.book""",
)
def j5_fallback(spark, d):
    i = F.col("ask_id") % 3
    a = asks(spark, d).withColumn("book", F.lower(F.when(i == 0, F.lit("CLICK")).when(i == 1, F.lit("View")).otherwise(F.lit("nobody"))))
    e = table(spark, d, "events").withColumn("book", F.lower("event_type"))
    out = jn.asof_join(a, e, ["user_id", "book"], "asked_at", "ts", ["event_id"], ["event_id"], ["ask_id"], fallback=True)
    return out.select("ask_id", "asof_event_id")


_CLOSING = """st AS (SELECT entity_id, game_date, book, arg_min(start_at, (fetched_at, id)) FILTER (start_at IS NOT NULL) AS scheduled_start FROM snapshots GROUP BY ALL),
  cl AS (SELECT s.*, scheduled_start, coalesce(fetched_at <= scheduled_start, false) AS ok FROM snapshots s JOIN st USING (entity_id, game_date, book)),
  closing AS (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY entity_id, game_date, book ORDER BY ok DESC, fetched_at DESC, id DESC) = 1)"""


def closing(spark, d):
    return jn.closing_snapshot(
        snapshots(spark, d), ["entity_id", "game_date", "book"], "fetched_at", "id", "start_at", ["line", "odds_over", "odds_under"]
    )


@query(
    "j6_closing_snapshot",
    with_sql(SNAPSHOTS, _CLOSING)
    + """SELECT entity_id, game_date, book, id AS closing_id, line AS closing_line, odds_over AS closing_odds_over, epoch_us(fetched_at) AS closing_us, CAST(ok AS INTEGER) AS had_pregame FROM closing""",
)
def j6(spark, d):
    return closing(spark, d).select(
        "entity_id", "game_date", "book", "closing_id", "closing_line", "closing_odds_over", micros(F.col("closing_ts")).alias("closing_us"), "had_pregame"
    )


@query(
    "j7_latest_pregame_snapshot",
    with_sql(SNAPSHOTS)
    + """, s AS (SELECT *, coalesce(start_at, CAST(game_date AS TIMESTAMP)) AS st FROM snapshots), f AS (SELECT entity_id, game_date, arg_max(st, (fetched_at, st, book)) AS cs, arg_max(book, (fetched_at, st, book)) AS cb FROM s GROUP BY ALL),
    j AS (SELECT s.id, s.fetched_at, s.entity_id, s.game_date, cs, cb FROM s JOIN f USING (entity_id, game_date)),
    m AS (SELECT entity_id, game_date, max(fetched_at) FILTER (fetched_at <= cs) AS last FROM j GROUP BY ALL)
    SELECT id, epoch_us(cs) AS start_us, cb AS canonical_book, CAST(coalesce(fetched_at = last, false) AS INTEGER) AS is_latest_pregame FROM j JOIN m USING (entity_id, game_date)""",
)
def j7(spark, d):
    s = snapshots(spark, d).withColumn("start_at", F.coalesce("start_at", F.col("game_date").cast("timestamp_ntz")))
    out = jn.latest_pregame(s, ["entity_id", "game_date"], "fetched_at", "start_at", ["book"])
    return out.select("id", micros(F.col("canonical_start")).alias("start_us"), "canonical_book", "is_latest_pregame")


@query(
    "j8_asof_anchor",
    with_sql(SNAPSHOTS)
    + """, a AS (SELECT *, CAST(game_date AS TIMESTAMP) + INTERVAL 18 HOUR AS anchor FROM snapshots), h AS (SELECT entity_id, game_date, max(fetched_at) FILTER (fetched_at <= anchor) AS asof_ts, count(*) FILTER (fetched_at > anchor) AS n_after FROM a GROUP BY ALL)
    SELECT id, line, n_after AS n_after_anchor FROM a JOIN h USING (entity_id, game_date) WHERE fetched_at = asof_ts""",
)
def j8(spark, d):
    a = snapshots(spark, d).withColumn("anchor", F.col("game_date").cast("timestamp_ntz") + F.expr("INTERVAL '18' HOUR"))
    return jn.asof_anchor(a, ["entity_id", "game_date"], "fetched_at", "anchor").select("id", "line", "n_after_anchor")


@query(
    "j9_tolerant_date_join",
    """WITH f AS (SELECT l_partkey AS entity, CAST(l_shipdate AS DATE) AS day, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL),
    a AS (SELECT o_orderkey, o_custkey AS entity, CAST(o_orderdate AS DATE) AS day FROM orders), t(r, off) AS (VALUES (0, 0), (1, -1), (2, 1)),
    m AS (SELECT o_orderkey, arg_min(off, r) AS day_offset, arg_min(price, r) AS matched_price FROM a CROSS JOIN t JOIN f ON f.entity = a.entity AND f.day = a.day + off GROUP BY 1)
    SELECT o_orderkey, day_offset, matched_price FROM a LEFT JOIN m USING (o_orderkey)""",
)
def j9(spark, d):
    facts = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("entity"), F.to_date("l_shipdate").alias("day")).agg(F.max("l_extendedprice").alias("price"))
    a = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("day"))
    return jn.tolerant_date_join(a, facts, ["entity"], "day", ["price"], ["o_orderkey"]).select("o_orderkey", "day_offset", "matched_price")


# quoted names against a roster: home and away are nations, the roster has one row per (day, nation)
_ENTITY = """ask AS (SELECT o_orderkey AS ask_id, CAST(o_orderdate AS DATE) AS day, CAST(o_custkey % 25 AS INTEGER) AS home, CAST((o_custkey + 1) % 25 AS INTEGER) AS away,
    'J. Éclair' || (o_custkey % 5) AS name FROM orders),
  roster AS (SELECT day, team, min(versus) AS versus, min(pid) AS pid, min(pname) AS pname FROM (
      SELECT CAST(l_shipdate AS DATE) AS day, CAST(l_suppkey % 25 AS INTEGER) AS team, CAST((l_suppkey + 24 + 2 * (l_suppkey % 2)) % 25 AS INTEGER) AS versus, l_partkey AS pid, 'Jean eclair' || (l_partkey % 5) AS pname FROM lineitem) GROUP BY ALL)"""


def entity_frames(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("ask_id"), F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") % 25).cast("int").alias("home"),
        ((F.col("o_custkey") + 1) % 25).cast("int").alias("away"), F.concat(F.lit("J. Éclair"), (F.col("o_custkey") % 5).cast("string")).alias("name"),
    )
    li = table(spark, d, "lineitem").select(
        F.to_date("l_shipdate").alias("day"), (F.col("l_suppkey") % 25).cast("int").alias("team"),
        ((F.col("l_suppkey") + 24 + 2 * (F.col("l_suppkey") % 2)) % 25).cast("int").alias("versus"), F.col("l_partkey").alias("pid"),
        F.concat(F.lit("Jean eclair"), (F.col("l_partkey") % 5).cast("string")).alias("pname"),
    )
    roster = li.groupBy("day", "team").agg(F.min("versus").alias("versus"), F.min("pid").alias("pid"), F.min("pname").alias("pname"))
    return o, roster


@query(
    "j10_entity_resolution",
    with_sql(_ENTITY)
    + """, t(r, side, off) AS (VALUES (0, 0, 0), (1, 0, -1), (2, 0, 1), (3, 1, 0), (4, 1, -1), (5, 1, 1)),
    c AS (SELECT ask_id, r, pid, pname, versus = (CASE WHEN side = 0 THEN away ELSE home END) AS vs_ok,
        'eclair' || right(name, 1) = 'eclair' || right(pname, 1) AS name_ok
      FROM ask CROSS JOIN t LEFT JOIN roster ro ON ro.day = ask.day + off AND ro.team = (CASE WHEN side = 0 THEN home ELSE away END)),
    g AS (SELECT ask_id, arg_min(pid, r) FILTER (vs_ok AND name_ok) AS matched_id, arg_min(pname, r) FILTER (vs_ok AND name_ok) AS matched_name, max(CAST(vs_ok AND name_ok AS INT)) AS hit, max(CAST(vs_ok AS INT)) AS vs, count(pid) AS n FROM c GROUP BY 1)
    SELECT ask_id, CASE WHEN hit = 1 THEN 'matched' WHEN vs = 1 THEN 'name_mismatch' WHEN n > 0 THEN 'opponent_mismatch' ELSE 'no_game' END AS match_status, matched_id, matched_name FROM g""",
)
def j10(spark, d):
    ask, roster = entity_frames(spark, d)
    return jn.match_entities(ask, roster, ["ask_id"], "day", "home", "away", "name", "team", "versus", "pname", "pid")


@query(
    "j11_name_attribution",
    """WITH roster AS (SELECT c_nationkey % 5 AS season, c_mktsegment || ' ' || c_custkey % 40 AS pname, CAST(c_custkey % 7 AS VARCHAR) AS team FROM customer WHERE c_custkey % 3 = 0),
    ask AS (SELECT c_custkey, c_nationkey % 5 AS season, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE substr(c_mktsegment, 1, 1) || '.' END || ' ' || c_custkey % 45 AS name FROM customer),
    f AS (SELECT season, lower(pname) AS k, count(DISTINCT team) AS n, min(team) AS t FROM roster GROUP BY ALL),
    s AS (SELECT season, lower(substr(pname, 1, 1)) AS i, split_part(pname, ' ', 2) AS l, count(DISTINCT team) AS n, min(team) AS t FROM roster GROUP BY ALL),
    j AS (SELECT a.c_custkey, coalesce(f.n, s.n, 0) AS n, coalesce(f.t, s.t) AS t FROM ask a LEFT JOIN f ON f.season = a.season AND f.k = lower(replace(a.name, '.', '')) LEFT JOIN s ON s.season = a.season AND s.i = lower(substr(a.name, 1, 1)) AND s.l = split_part(a.name, ' ', 2))
    SELECT c_custkey, CASE WHEN n = 0 THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS attribution, CASE WHEN n = 1 THEN t END AS attributed_team FROM j""",
)
def j11(spark, d):
    c = table(spark, d, "customer").withColumn("season", F.col("c_nationkey") % 5)
    k = F.col("c_custkey")
    roster = c.where(k % 3 == 0).select("season", F.concat_ws(" ", "c_mktsegment", (k % 40).cast("string")).alias("pname"), (k % 7).cast("string").alias("team"))
    first = F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise(F.concat(F.substring("c_mktsegment", 1, 1), F.lit(".")))
    ask = c.select("c_custkey", "season", F.concat_ws(" ", first, (k % 45).cast("string")).alias("name"))
    return jn.attribute_names(ask, roster, ["season"], "name", "pname", "team").select("c_custkey", "attribution", "attributed_team")


@query(
    "j12_event_to_game",
    """WITH g AS (SELECT CAST(l_shipdate AS DATE) AS day, least(l_suppkey % 10, l_partkey % 10) AS a, greatest(l_suppkey % 10, l_partkey % 10) AS b, count(DISTINCT l_orderkey) AS n, min(l_orderkey) AS g FROM lineitem GROUP BY ALL),
    e AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, least(o_custkey % 10, (o_custkey + 3) % 10) AS a, greatest(o_custkey % 10, (o_custkey + 3) % 10) AS b FROM orders)
    SELECT o_orderkey AS event_id, CASE WHEN n IS NULL THEN 'unmatched' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS map_status, CASE WHEN n = 1 THEN g END AS game_id_matched FROM e LEFT JOIN g USING (day, a, b)""",
)
def j12(spark, d):
    games = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("game_id"), F.to_date("l_shipdate").alias("day"), (F.col("l_suppkey") % 10).cast("string").alias("home"), (F.col("l_partkey") % 10).cast("string").alias("away")
    )
    ev = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.to_date("o_orderdate").alias("day"), ((F.col("o_custkey") + 3) % 10).cast("string").alias("home"), (F.col("o_custkey") % 10).cast("string").alias("away")
    )
    return jn.map_events_to_games(ev, games, "day", "home", "away", "game_id", "event_id")


@query(
    "j13_replacement_candidates",
    """WITH e AS (SELECT o_orderkey, o_custkey % 40 AS p, CAST(o_orderdate AS DATE) AS day FROM orders)
    SELECT a.o_orderkey, count(b.o_orderkey) AS n_candidates, min(abs(CAST(date_diff('day', a.day, b.day) AS INTEGER))) AS nearest_gap_days
    FROM e a LEFT JOIN (SELECT * FROM e WHERE o_orderkey % 2 = 0) b ON a.p = b.p AND abs(date_diff('day', a.day, b.day)) <= 30 GROUP BY 1""",
)
def j13(spark, d):
    e = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("p"), F.to_date("o_orderdate").alias("day"))
    held = e.where(F.col("o_orderkey") % 2 == 0)
    return jn.replacement_candidates(e, held, ["p"], "day", "o_orderkey")


_MANIFEST = """m AS (SELECT user_id AS scope, ts AS resolved, CASE WHEN event_id % 9 <> 0 THEN ts + to_minutes(CAST(30 + event_id % 600 AS INTEGER)) END AS next_at, date_trunc('hour', ts) AS requested FROM events WHERE event_type = 'click'),
  r AS (SELECT event_id, user_id AS scope, CASE WHEN event_id % 2 = 0 THEN date_trunc('hour', ts) ELSE ts END AS requested FROM events WHERE event_type <> 'error')"""


def coverage_frames(spark, d):
    e = table(spark, d, "events")
    m = e.where("event_type = 'click'").select(
        F.col("user_id").alias("scope"), F.col("ts").alias("resolved"),
        F.when(F.col("event_id") % 9 != 0, F.col("ts") + F.make_dt_interval(mins=(30 + F.col("event_id") % 600).cast("int"))).alias("next_at"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("requested"),
    )
    r = e.where("event_type <> 'error'").select(
        "event_id", F.col("user_id").alias("scope"),
        F.when(F.col("event_id") % 2 == 0, F.date_trunc("hour", "ts").cast("timestamp_ntz")).otherwise(F.col("ts")).alias("requested"),
    )
    return m, r


@query(
    "j14_interval_coverage",
    with_sql(_MANIFEST)
    + """SELECT event_id, CAST(EXISTS (SELECT 1 FROM m WHERE m.scope = r.scope AND ((m.resolved <= r.requested AND (m.next_at IS NULL OR r.requested < m.next_at)) OR m.requested = r.requested)) AS INTEGER) AS is_covered FROM r""",
)
def j14(spark, d):
    m, r = coverage_frames(spark, d)
    out = jn.covered_requests(r, m, ["scope"], "requested", "resolved", "next_at", "requested", ["event_id"])
    return out.select("event_id", "is_covered")


@query(
    "j15_uncovered_anchors",
    """WITH a AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 20 HOUR AS anchor FROM events),
    k AS (SELECT user_id || '|' || day AS ev, anchor FROM a), s AS (SELECT user_id || '|' || CAST(ts AS DATE) AS ev, ts FROM events),
    g AS (SELECT ev, min(abs(epoch_us(ts) - epoch_us(anchor)) / 1e6) AS min_gap_seconds FROM k JOIN s USING (ev) GROUP BY 1)
    SELECT ev, min_gap_seconds, CAST(min_gap_seconds > 7200 AS INTEGER) AS needs_purchase FROM g""",
)
def j15(spark, d):
    day = F.to_date("ts")
    s = table(spark, d, "events").select(F.concat_ws("|", F.col("user_id").cast("string"), day.cast("string")).alias("ev"), "ts", day.alias("day"))
    a = s.select("ev", (F.col("day").cast("timestamp_ntz") + F.expr("INTERVAL '20' HOUR")).alias("anchor")).distinct()
    return jn.anchor_gaps(a, s, "ev", "anchor", "ts", 7200).select("ev", "min_gap_seconds", "needs_purchase")


@query(
    "j16_semi_and_anti",
    """SELECT 'with_orders' AS part, count(*) AS n FROM customer SEMI JOIN orders ON c_custkey = o_custkey
    UNION ALL SELECT 'without_big_orders', count(*) FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 450000) ON c_custkey = o_custkey
    UNION ALL SELECT 'in_both_priorities', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')""",
)
def j16(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders")

    def count(name, rows):
        return rows.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))

    keys = o.select(F.col("o_custkey").alias("c_custkey"))
    big = o.where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    urgent, low = (o.where(F.col("o_orderpriority") == p).select("o_custkey") for p in ("1-URGENT", "5-LOW"))
    return (
        count("with_orders", c.join(keys, "c_custkey", "left_semi"))
        .unionByName(count("without_big_orders", c.join(big, "c_custkey", "left_anti")))
        .unionByName(count("in_both_priorities", urgent.intersect(low)))
    )


@query(
    "j18_exact_line_closing",
    with_sql(PAIRS)
    + """, c AS (SELECT event_id, line, avg(p_over) AS closing_p, count(*) AS closing_books FROM pairs WHERE book >= 2 GROUP BY ALL)
    SELECT b.event_id, b.book, b.line, closing_p, closing_books, closing_p - b.p_over AS prob_clv, o.price_over AS same_book_close, b.price_over / o.price_over - 1 AS price_clv
    FROM pairs b LEFT JOIN c USING (event_id, line) LEFT JOIN pairs o ON o.event_id = b.event_id AND o.line = b.line AND o.book = b.book + 2 WHERE b.book < 2""",
)
def j18(spark, d):
    p = pairs(spark, d)
    bet = p.where("book < 2").select("event_id", "book", "line", "p_over", "price_over")
    close = p.where("book >= 2")
    means = close.groupBy("event_id", "line").agg(F.avg("p_over").alias("closing_p"), F.count(F.lit(1)).alias("closing_books"))
    same = close.select("event_id", "line", (F.col("book") - 2).alias("book"), F.col("price_over").alias("same_book_close"))
    out = bet.join(means, ["event_id", "line"], "left").join(same, ["event_id", "line", "book"], "left")
    return out.select(
        "event_id", "book", "line", "closing_p", "closing_books", (F.col("closing_p") - F.col("p_over")).alias("prob_clv"), "same_book_close",
        (F.col("price_over") / F.col("same_book_close") - 1.0).alias("price_clv"),
    )


@query(
    "j19_any_line_closing_funnel",
    with_sql(PAIRS)
    + """, c AS (SELECT event_id, arg_min(line, book) AS closing_line FROM (SELECT event_id, book, min(line) AS line FROM pairs WHERE book >= 2 GROUP BY ALL) GROUP BY 1)
    SELECT CASE WHEN closing_line IS NULL THEN 'no_closing' WHEN closing_line = line THEN 'line_identical' ELSE 'line_moved' END AS outcome, count(*) AS n_rows FROM (SELECT * FROM pairs WHERE book < 2) LEFT JOIN c USING (event_id) GROUP BY 1""",
)
def j19(spark, d):
    p = pairs(spark, d)
    close = p.where("book >= 2").groupBy("event_id").agg(F.min_by("line", F.struct("book", "line")).alias("closing_line"))
    status = (
        F.when(F.col("closing_line").isNull(), F.lit("no_closing")).when(F.col("closing_line") == F.col("line"), F.lit("line_identical")).otherwise(F.lit("line_moved"))
    )
    return p.where("book < 2").join(close, "event_id", "left").groupBy(status.alias("outcome")).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "j20_identity_key_join",
    """WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'gid:' || c_nationkey ELSE 'name:' || lower(trim(c_mktsegment)) END AS k, c_acctbal FROM customer)
    SELECT k AS identity, count(*) AS n_rows, sum(c_acctbal) AS total FROM a GROUP BY 1""",
)
def j20(spark, d):
    c = table(spark, d, "customer")
    key = identity_key(F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")), F.concat(F.lit(" "), "c_mktsegment"))
    return c.groupBy(key.alias("identity")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("c_acctbal").alias("total"))


@query(
    "j21_prior_season_baseline",
    with_sql(FORM)
    + """, h AS (SELECT season + 1 AS season, CASE WHEN team_id = 3 THEN 4 ELSE team_id END AS fr, avg(value) AS m FROM form GROUP BY ALL)
    SELECT game_id, m AS prior_season_mean FROM form LEFT JOIN h ON h.season = form.season AND h.fr = (CASE WHEN form.team_id = 3 THEN 4 ELSE form.team_id END)""",
)
def j21(spark, d):
    f = form(spark, d).withColumn("team", F.col("team_id").cast("string"))
    return jn.shifted_season_join(f, f, "team", "season", "value", "prior_season_mean", {"3": "4"}).select("game_id", "prior_season_mean")


@query(
    "j22_source_reconciliation",
    """WITH a AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1)
    SELECT CAST(year(o_orderdate) AS INTEGER) AS season, count(*) AS n_rows, count(v) AS n_matched, avg(CAST(abs(o_totalprice - v) <= 50000 AS DOUBLE)) AS within_rate, avg(abs(o_totalprice - v)) AS mean_gap
    FROM orders LEFT JOIN a ON k = o_orderkey GROUP BY 1""",
)
def j22(spark, d):
    a = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("v"))
    gap = F.abs(F.col("o_totalprice") - F.col("v"))
    j = table(spark, d, "orders").join(a, "o_orderkey", "left")
    return j.groupBy(F.year("o_orderdate").alias("season")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("v").alias("n_matched"), F.avg((gap <= 50000).cast("double")).alias("within_rate"), F.avg(gap).alias("mean_gap")
    )


@query(
    "j23_key_coverage",
    """WITH k AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS season, o_orderkey FROM orders), r AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
    SELECT season, count(*) AS n_keys, count(l_orderkey) AS n_matched, avg(CAST(l_orderkey IS NOT NULL AS DOUBLE)) AS match_rate FROM k LEFT JOIN r ON o_orderkey = l_orderkey GROUP BY 1""",
)
def j23(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("season"))
    r = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return jn.key_coverage(o, r, ["o_orderkey"], ["season"])


@query(
    "j24_supplement_union",
    """WITH a AS (SELECT o_orderkey AS id, o_orderdate AS day, o_totalprice AS v FROM orders WHERE o_orderdate < DATE '1998-01-01'), b AS (SELECT o_orderkey AS id, o_orderdate AS day FROM orders)
    SELECT id, v FROM a UNION ALL SELECT id, NULL FROM b WHERE day > (SELECT max(day) FROM a)""",
)
def j24(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("v"))
    early = o.where(F.col("at") < F.lit("1998-01-01").cast("date"))
    return jn.supplement(early, o.drop("v"), "at").select("id", "v")


@query(
    "j25_threshold_candidates",
    with_sql(BETS)
    + """, t AS (SELECT unnest([0.0, 0.05, 0.1]) AS threshold) SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) AS n_rows, count(*) FILTER (abs(p_over - 0.5) >= threshold) AS n_over FROM bets CROSS JOIN t GROUP BY 1""",
)
def j25(spark, d):
    grid = F.explode(F.array(*[F.lit(t) for t in (0.0, 0.05, 0.1)]))
    b = bets(spark, d).select(F.abs(F.col("p_over") - 0.5).alias("gap"), grid.alias("threshold"))
    return b.groupBy("threshold").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("gap") >= F.col("threshold")).alias("n_over"))
