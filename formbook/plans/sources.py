"""S: nested documents, archives, scans and keyed writes.

Documents are rendered as JSON from the driver's tables, row by row, then parsed and
flattened exactly as landed files are.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from formbook.operators.quality import schema_surprises
from formbook.plans.frames import BETS, SNAPSHOTS, bets, snapshots, table, with_sql
from formbook.plans.registry import query
from formbook.sources import documents as dc
from formbook.sources import tables as tb

c, lit, st = F.col, F.lit, F.struct


def box_documents(spark, d):
    """One box score per order line: two goalies a side, two skater lists."""
    li = table(spark, d, "lineitem")

    def goalie(pid, starter, saves, extra):
        shots = saves + extra
        return st(
            pid.alias("playerId"), st(F.concat(lit("G"), pid.cast("string")).alias("default")).alias("name"), starter.alias("starter"),
            saves.cast("int").alias("saves"), shots.cast("int").alias("shotsAgainst"), (shots - saves).cast("int").alias("goalsAgainst"),
            lit("59:30").alias("toi"), F.concat_ws("/", saves.cast("int").cast("string"), shots.cast("int").cast("string")).alias("evenStrengthShotsAgainst"),
            F.when(saves % 3 == 0, lit("bad")).otherwise(lit("1/2")).alias("powerPlayShotsAgainst"),
        )

    def skater(pid, sog):
        return st(pid.alias("playerId"), sog.cast("int").alias("sog"))

    q = c("l_quantity").cast("int")
    home = st(
        F.array(goalie(c("l_partkey"), lit(True), q, lit(2)), goalie(c("l_partkey") + 1, lit(False), q % 5, lit(1))).alias("goalies"),
        F.array(skater(c("l_suppkey"), q % 7)).alias("forwards"), F.array(skater(c("l_suppkey") + 1, q % 3)).alias("defense"),
    )
    away = st(F.array(goalie(c("l_suppkey"), lit(True), q % 30, lit(3))).alias("goalies"), F.array(skater(c("l_partkey"), q % 4)).alias("forwards"))
    doc = st(
        c("l_orderkey").alias("id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("gameDate"), F.year("l_shipdate").alias("season"),
        st(c("l_returnflag").alias("abbrev"), c("l_linenumber").alias("score"), (q + 2).alias("sog")).alias("homeTeam"),
        st(c("l_linestatus").alias("abbrev"), (c("l_linenumber") % 3).alias("score"), (q % 30 + 3).alias("sog")).alias("awayTeam"),
        st(home.alias("homeTeam"), away.alias("awayTeam")).alias("playerByGameStats"),
    )
    return dc.parse_json(li.select(F.to_json(doc).alias("doc")), "doc", dc.BOX_SCORE)


@query(
    "s1_boxscore_starters",
    """SELECT l_orderkey AS game_id, CAST(l_shipdate AS DATE) AS game_date, l_returnflag AS team_abbrev, l_linestatus AS opponent_team, 1::INTEGER AS is_home, l_partkey AS goalie_id, CAST(l_quantity AS INTEGER) AS saves,
      CAST(l_quantity + 2 AS INTEGER) AS shots_against, l_linenumber AS team_goals, CAST(CAST(l_quantity AS INTEGER) % 30 + 3 AS INTEGER) AS opp_shots FROM lineitem
    UNION ALL SELECT l_orderkey, CAST(l_shipdate AS DATE), l_linestatus, l_returnflag, 0, l_suppkey, CAST(l_quantity AS INTEGER) % 30, CAST(l_quantity AS INTEGER) % 30 + 3, l_linenumber % 3, CAST(l_quantity + 2 AS INTEGER) FROM lineitem""",
)
def s1(spark, d):
    return dc.goalie_games(box_documents(spark, d)).select(
        "game_id", "game_date", "team_abbrev", "opponent_team", "is_home", "goalie_id", "saves", "shots_against", "team_goals", "opp_shots"
    )


@query(
    "s2_boxscore_all_goalies",
    """WITH g AS (SELECT l_orderkey, l_returnflag AS t, l_partkey AS g, 1 AS s, CAST(l_quantity AS INTEGER) AS v, CAST(l_quantity AS INTEGER) + 2 AS a FROM lineitem
      UNION ALL SELECT l_orderkey, l_returnflag, l_partkey + 1, 0, CAST(l_quantity AS INTEGER) % 5, CAST(l_quantity AS INTEGER) % 5 + 1 FROM lineitem
      UNION ALL SELECT l_orderkey, l_linestatus, l_suppkey, 1, CAST(l_quantity AS INTEGER) % 30, CAST(l_quantity AS INTEGER) % 30 + 3 FROM lineitem)
    SELECT t AS team_abbrev, CAST(s AS INTEGER) AS is_starter, count(*) AS n_rows, CAST(sum(v) AS BIGINT) AS even_saves, CAST(sum(a) AS BIGINT) AS even_shots,
      CAST(sum(CASE WHEN v % 3 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS pp_saves FROM g GROUP BY ALL""",
)
def s2(spark, d):
    g = dc.goalie_performance(box_documents(spark, d))
    return g.groupBy("team_abbrev", "is_starter").agg(
        F.count(lit(1)).alias("n_rows"), F.sum("even_strength_saves").alias("even_saves"), F.sum("even_strength_shots_against").alias("even_shots"), F.sum("power_play_saves").alias("pp_saves")
    )


@query(
    "s3_team_game_sides",
    """WITH s AS (SELECT l_returnflag AS team, l_linenumber AS gf, l_linenumber % 3 AS ga FROM lineitem UNION ALL SELECT l_linestatus, l_linenumber % 3, l_linenumber FROM lineitem)
    SELECT team AS team_abbrev, count(*) AS games, CAST(sum(gf) AS BIGINT) AS goals_for, CAST(sum(ga) AS BIGINT) AS goals_against FROM s GROUP BY 1""",
)
def s3(spark, d):
    t = dc.team_game_sides(box_documents(spark, d))
    return t.groupBy("team_abbrev").agg(F.count(lit(1)).alias("games"), F.sum("team_goals").alias("goals_for"), F.sum("opp_goals").alias("goals_against"))


@query(
    "s6_skater_shots",
    """WITH p AS (SELECT l_suppkey AS p, CAST(l_quantity AS INTEGER) % 7 AS s FROM lineitem UNION ALL SELECT l_suppkey + 1, CAST(l_quantity AS INTEGER) % 3 FROM lineitem UNION ALL SELECT l_partkey, CAST(l_quantity AS INTEGER) % 4 FROM lineitem)
    SELECT p AS player_id, count(*) AS games, CAST(sum(s) AS BIGINT) AS sog FROM p GROUP BY 1""",
)
def s6(spark, d):
    return dc.skater_shots(box_documents(spark, d)).groupBy("player_id").agg(F.count(lit(1)).alias("games"), F.sum("sog").alias("sog"))


def play_documents(spark, d):
    """One play list per event: three plays of which two or three are shots, two roster spots."""
    e = table(spark, d, "events")
    i = c("event_id")

    def play(n, kind):
        return st(
            (i * 10 + n).alias("eventId"), kind.alias("typeDescKey"), lit("10:15").alias("timeInPeriod"), st(lit(n % 3 + 1).alias("number")).alias("periodDescriptor"),
            st(c("user_id").alias("shootingPlayerId"), (c("user_id") % 5).alias("goalieInNetId"), lit("wrist").alias("shotType"), c("value").alias("xCoord"), (c("value") / 2).alias("yCoord")).alias("details"),
        )

    def spot(team, player):
        return st(team.alias("teamId"), player.alias("playerId"), st(lit("P").alias("default")).alias("firstName"), st(player.cast("string").alias("default")).alias("lastName"))

    doc = st(
        i.alias("id"), lit(2024).alias("season"), st(lit(1).alias("id"), lit("AAA").alias("abbrev")).alias("homeTeam"), st(lit(2).alias("id"), lit("BBB").alias("abbrev")).alias("awayTeam"),
        F.array(play(0, lit("faceoff")), play(1, F.when(i % 4 == 0, lit("goal")).otherwise(lit("shot-on-goal"))), play(2, F.when(i % 3 == 0, lit("hit")).otherwise(lit("missed-shot")))).alias("plays"),
        F.array(spot(lit(1), c("user_id")), spot(i % 3 + 1, c("user_id") + 1000)).alias("rosterSpots"),
    )
    return dc.parse_json(e.select(F.to_json(doc).alias("doc")), "doc", dc.PLAY_BY_PLAY)


@query(
    "s4_shot_events",
    """SELECT event_id AS game_id, CAST(1 AS INTEGER) AS play_index, CASE WHEN event_id % 4 = 0 THEN 'goal' ELSE 'shot-on-goal' END AS play_type, user_id % 5 AS goalie_id, value AS x, value / 2 AS y, CAST(event_id % 4 = 0 AS INTEGER) AS is_goal FROM events
    UNION ALL SELECT event_id, 2, 'missed-shot', user_id % 5, value, value / 2, 0 FROM events WHERE event_id % 3 <> 0""",
)
def s4(spark, d):
    return dc.shot_events(play_documents(spark, d)).select("game_id", "play_index", "play_type", "goalie_id", "x", "y", "is_goal")


@query(
    "s5_rosters",
    """WITH r AS (SELECT 1 AS t, user_id AS p FROM events UNION ALL SELECT event_id % 3 + 1, user_id + 1000 FROM events)
    SELECT DISTINCT 2024::INTEGER AS season, CASE t WHEN 1 THEN 'AAA' ELSE 'BBB' END AS team_abbrev, p AS player_id, 'P ' || p AS player_name FROM r WHERE t <= 2""",
)
def s5(spark, d):
    return dc.rosters(play_documents(spark, d))


@query(
    "s7_schedule_two_rows_per_game",
    """WITH s AS (SELECT o_orderkey, o_orderkey // 3 AS game, 'T' || o_custkey % 30 AS h, 'T' || (o_custkey + 7) % 30 AS a FROM orders),
    r AS (SELECT game, h AS team, a AS opp, 1 AS home, o_orderkey FROM s UNION ALL SELECT game, a, h, 0, o_orderkey FROM s)
    SELECT game AS game_id, team AS team_abbrev, arg_min(opp, o_orderkey) AS opponent_team, CAST(arg_min(home, o_orderkey) AS INTEGER) AS is_home FROM r GROUP BY ALL""",
)
def s7(spark, d):
    o = table(spark, d, "orders")

    def team(shift):
        return st(F.concat(lit("T"), ((c("o_custkey") + shift) % 30).cast("string")).alias("abbrev"))

    game = st(
        F.floor(c("o_orderkey") / 3).alias("id"), lit(2024).alias("season"), lit(2).alias("gameType"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("gameDate"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'19:00:00'Z'").alias("startTimeUTC"), team(0).alias("homeTeam"), team(7).alias("awayTeam"),
    )
    docs = dc.parse_json(o.select("o_orderkey", F.to_json(st(F.array(game).alias("games"))).alias("doc")), "doc", dc.SCHEDULE, ["o_orderkey"])
    return dc.schedule_rows(docs, ["o_orderkey"]).select("game_id", "team_abbrev", "opponent_team", "is_home")


def _event_struct():
    """One odds event per order line: two books, two markets, two outcomes."""
    def outcome(name, price):
        return st(lit(name).alias("name"), F.concat(lit("G"), c("l_partkey").cast("string")).alias("description"), (F.floor(c("l_quantity") / 10) + 0.5).alias("point"), price.alias("price"))

    def market(key, shift):
        return st(lit(key).alias("key"), F.array(outcome("Over", 1.5 + shift + c("l_tax")), outcome("Under", F.when(c("l_discount") > 0, 1.6 + shift + c("l_discount")))).alias("outcomes"))

    def book(shift):
        return st(
            F.concat(lit("book"), ((c("l_suppkey") + shift) % 4).cast("string")).alias("key"), F.array(market("player_total_saves", 0.1 * shift), market("h2h", 0.2)).alias("markets")
        )

    return st(
        c("l_partkey").cast("string").alias("id"), F.date_format("l_shipdate", "yyyy-MM-dd'T'23:00:00'Z'").alias("commence_time"), c("l_returnflag").alias("home_team"), c("l_linestatus").alias("away_team"),
        F.array(book(0), book(1)).alias("bookmakers"),
    )


_LINES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def envelopes(spark, d, bulk=False):
    data = F.array(_event_struct()) if bulk else _event_struct()
    doc = st(F.date_format("l_shipdate", "yyyy-MM-dd'T'22:30:00'Z'").alias("timestamp"), data.alias("data"))
    # of bulk envelopes only prices are asked for
    schema = dc.BULK_PRICES if bulk else dc.ODDS_ENVELOPE
    keep = _LINES if not bulk else ["l_orderkey", "l_linenumber"]
    needed = sorted({*_LINES, "l_shipdate", "l_returnflag", "l_linestatus", "l_quantity", "l_tax", "l_discount"})
    # landed envelopes are many files; the table that stands in for them is one
    rows = table(spark, d, "lineitem").select(*needed).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dc.parse_json(rows.select(*keep, F.to_json(doc).alias("doc")), "doc", schema, keep)


_OUTCOMES = """books AS (SELECT lineitem.*, unnest([0, 1]) AS sh FROM lineitem),
  outs AS (SELECT *, 'book' || (l_suppkey + sh) % 4 AS book, floor(l_quantity / 10) + 0.5 AS line, 1.5 + 0.1 * sh + l_tax AS po, CASE WHEN l_discount > 0 THEN 1.6 + 0.1 * sh + l_discount END AS pu FROM books)"""


@query(
    "s8_flatten_quote_envelopes",
    with_sql(_OUTCOMES)
    + """SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS event_id, book, 'G' || l_partkey AS player_name_raw, 'Over' AS side, line, po AS price_decimal, epoch_us(l_shipdate) + 81000000000 AS resolved_us FROM outs
    UNION ALL SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR), book, 'G' || l_partkey, 'Under', line, pu, epoch_us(l_shipdate) + 81000000000 FROM outs""",
)
def s8(spark, d):
    q = dc.flatten_quotes(envelopes(spark, d), ["player_total_saves"], ["l_orderkey", "l_linenumber"])
    return q.select("l_orderkey", "l_linenumber", "event_id", "book", "player_name_raw", "side", "line", "price_decimal", F.unix_micros("resolved_ts").alias("resolved_us"))


@query(
    "s9_flatten_bulk_markets",
    with_sql(_OUTCOMES)
    + """SELECT book, 'Over' AS outcome_label, count(*) AS n_rows, count(pu) AS n_devigged, sum((1 / po) / (1 / po + 1 / pu)) AS total_prob FROM outs GROUP BY 1
    UNION ALL SELECT book, 'Under', count(*), count(pu), sum((1 / pu) / (1 / po + 1 / pu)) FROM outs GROUP BY 1""",
)
def s9(spark, d):
    m = dc.flatten_bulk_markets(envelopes(spark, d, bulk=True), ["player_total_saves"], columns=["book", "outcome_label", "implied_prob_devig"])
    return m.groupBy("book", "outcome_label").agg(
        F.count(lit(1)).alias("n_rows"), F.count("implied_prob_devig").alias("n_devigged"), F.sum("implied_prob_devig").alias("total_prob")
    )


def http_records(spark, d):
    body = F.to_json(st(F.date_format("l_shipdate", "yyyy-MM-dd'T'22:30:00'Z'").alias("timestamp"), _event_struct().alias("data")))
    status = F.when(c("l_linenumber") == 7, lit(404)).when(c("l_linenumber") == 6, lit(422)).otherwise(lit(200))
    record = st(
        status.alias("status_code"), F.date_format("l_shipdate", "yyyy-MM-dd'T'22:31:00'Z'").alias("fetched_at"), c("l_returnflag").alias("pass_name"),
        c("l_partkey").cast("string").alias("event_id"), body.alias("raw_body"),
    )
    return dc.parse_json(table(spark, d, "lineitem").select(F.to_json(record).alias("doc")), "doc", dc.HTTP_RECORD)


@query(
    "s10_http_record_bodies",
    with_sql(_OUTCOMES)
    + "SELECT l_returnflag AS pass_name, book, CAST(2 * count(*) AS BIGINT) AS n_quotes, sum(po) + coalesce(sum(pu), 0) AS total_price FROM outs WHERE l_linenumber < 6 GROUP BY ALL",
)
def s10(spark, d):
    bodies = dc.http_bodies(http_records(spark, d), dc.ODDS_ENVELOPE, ["pass_name"])
    q = dc.flatten_quotes(bodies, ["player_total_saves"], ["pass_name"])
    return q.groupBy("pass_name", "book").agg(F.count(lit(1)).alias("n_quotes"), F.sum("price_decimal").alias("total_price"))


@query(
    "s10_http_failures",
    "SELECT l_returnflag AS pass_name, CAST(CASE l_linenumber WHEN 7 THEN 404 ELSE 422 END AS INTEGER) AS status_code, count(*) AS n_records FROM lineitem WHERE l_linenumber >= 6 GROUP BY ALL",
)
def s10_failures(spark, d):
    return dc.http_failures(http_records(spark, d), ["pass_name"])


@query(
    "s10_event_props",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""",
)
def s10_props(spark, d):
    return dc.parse_json(table(spark, d, "events"), "props", "k int", ["event_id"])


@query(
    "s11_indexed_payload",
    """SELECT c_custkey, 'L' || c_custkey AS line_id, CAST(c_custkey % 40 AS DOUBLE) + 0.5 AS line, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'Ann ' || c_nationkey END AS player_name, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'H' || c_custkey % 10 END AS home FROM customer""",
)
def s11(spark, d):
    k = c("c_custkey")
    pid = F.concat(lit("P"), k.cast("string"))
    aid = F.when(k % 6 == 0, lit("missing")).otherwise(lit("A1"))
    doc = st(
        F.array(st(pid.alias("id"), lit("Ann").alias("first_name"), c("c_nationkey").cast("string").alias("last_name"))).alias("players"),
        F.array(st(lit("A1").alias("id"), pid.alias("player_id"), k.alias("match_id"))).alias("appearances"),
        F.array(st(k.alias("id"), F.concat(lit("H"), (k % 10).cast("string")).alias("home"), lit("A").alias("away"))).alias("games"),
        F.array(st(F.concat(lit("L"), k.cast("string")).alias("id"), aid.alias("appearance_id"), lit("saves").alias("stat"), ((k % 40) + 0.5).cast("double").alias("stat_value"))).alias("over_under_lines"),
    )
    docs = dc.parse_json(table(spark, d, "customer").select("c_custkey", F.to_json(doc).alias("doc")), "doc", dc.INDEXED_PAYLOAD, ["c_custkey"])
    return dc.flatten_indexed_payload(docs, ["c_custkey"]).select("c_custkey", "line_id", "line", "player_name", "home")


@query(
    "s12_archive_manifest",
    """SELECT CASE event_id % 4 WHEN 0 THEN 'events' WHEN 1 THEN 'odds' WHEN 2 THEN 'bulk' ELSE 'unparsable' END AS kind, CASE WHEN event_id % 4 = 1 THEN md5(CAST(user_id AS VARCHAR)) END AS event_id,
      CASE event_id % 4 WHEN 1 THEN 'player_total_saves' WHEN 2 THEN 'h2h,totals' ELSE '' END AS markets, CASE event_id % 4 WHEN 1 THEN 'eu,us' WHEN 2 THEN 'us' ELSE '' END AS regions, count(*) AS n_files,
      max(CASE WHEN event_id % 4 < 3 THEN epoch_us(date_trunc('second', ts)) END) AS newest_us FROM events GROUP BY ALL""",
)
def s12(spark, d):
    i = c("event_id")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH_mm_ss'Z'")
    name = (
        F.when(i % 4 == 0, F.concat(lit("events_date="), at, lit(".json")))
        .when(i % 4 == 1, F.concat(lit("odds_"), F.md5(c("user_id").cast("string")), lit("_date="), at, lit("_markets=player_total_saves_regions=us,eu.json")))
        .when(i % 4 == 2, F.concat(lit("bulk_date="), at, lit("_markets=totals,h2h_regions=us.json")))
        .otherwise(F.concat(lit("notes_"), at, lit(".txt")))
    )
    m = dc.parse_archive_names(table(spark, d, "events").select(name.alias("file_name")), "file_name")
    return m.groupBy("kind", "event_id", "markets", "regions").agg(F.count(lit(1)).alias("n_files"), F.max(F.unix_micros("requested_ts")).alias("newest_us"))


@query(
    "s12_page_hosts",
    "SELECT regexp_extract(url, '^https?://([^/]+)/', 1) AS host, count(*) AS n_pages FROM pages GROUP BY 1",
)
def s12_pages(spark, d):
    return table(spark, d, "pages").groupBy(F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("host")).agg(F.count(lit(1)).alias("n_pages"))


@query(
    "s13_event_dimension_last_wins",
    "SELECT CAST(user_id AS VARCHAR) AS event_id, arg_max(event_type, event_id) AS home_team, CAST(arg_max(value, event_id) AS VARCHAR) AS away_team FROM events GROUP BY user_id",
)
def s13(spark, d):
    e = table(spark, d, "events")
    item = st(c("user_id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("commence_time"), c("event_type").alias("home_team"), c("value").cast("string").alias("away_team"))
    docs = dc.parse_json(e.select("event_id", F.to_json(st(F.array(item).alias("data"))).alias("doc")), "doc", dc.EVENTS_LIST, ["event_id"])
    return dc.event_dimension(docs.withColumnRenamed("event_id", "file_no"), ["file_no"]).select("event_id", "home_team", "away_team")


@query(
    "s14_team_game_csv",
    """SELECT 'T' || l_suppkey % 30 AS team, CAST(year(l_shipdate) AS INTEGER) AS season, l_orderkey AS "gameId", CAST(l_shipdate AS DATE) AS "gameDate", l_extendedprice AS "xGoalsFor" FROM lineitem WHERE year(l_shipdate) >= 1997""",
)
def s14(spark, d):
    li = table(spark, d, "lineitem")
    text = F.concat_ws(
        ",", F.concat(lit("T"), (c("l_suppkey") % 30).cast("string")), F.year("l_shipdate").cast("string"), c("l_orderkey").cast("string"), lit("OPP"),
        F.date_format("l_shipdate", "yyyyMMdd"), lit("all"), lit("3600"), c("l_extendedprice").cast("string"),
    )
    return tb.parse_game_csv(li.select(text.alias("line")), "line", tb.TEAM_GAMES, ["team", "season", "gameId", "gameDate", "xGoalsFor"], 1997)


@query(
    "s15_melt_home_away",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1::INTEGER AS is_home, l_quantity AS line, l_tax AS price FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 0, l_extendedprice, l_discount FROM lineitem""",
)
def s15(spark, d):
    return dc.melt_home_away(table(spark, d, "lineitem"), _LINES, {"line": ("l_quantity", "l_extendedprice"), "price": ("l_tax", "l_discount")})


@query(
    "s16_tracker_scan",
    with_sql(BETS) + "SELECT game_id, seq, entity_id, venue, line FROM bets WHERE bet_date >= DATE '2000-01-01' AND result <> 'PUSH' AND CASE WHEN flag = 'N' THEN NULL ELSE result END IS NULL",
)
def s16(spark, d):
    b = bets(spark, d).where("result <> 'PUSH'").withColumn("settled", F.when(c("flag") != "N", c("result")))
    rows = tb.filter_bets(b, "bet_date", "settled", F.lit("2000-01-01").cast("date"), pending_only=True)
    return rows.select("game_id", "seq", "entity_id", "venue", "line")


_AUDIT = "md5(concat(" + ", ".join(f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')" for x in ("o_custkey", "o_orderdate", "o_orderkey")) + "))"


@query(
    "s17_audited_scan",
    f"""WITH o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderkey FROM orders WHERE o_orderstatus = 'F'), h AS (SELECT *, {_AUDIT} AS h FROM o)
    SELECT count(*) AS n_rows, min(o_orderdate) AS min_date, max(o_orderdate) AS max_date,
      sum(('0x' || substr(h, 1, 16))::UBIGINT::HUGEINT)::VARCHAR || '-' || sum(('0x' || substr(h, 17, 16))::UBIGINT::HUGEINT)::VARCHAR AS content_hash,
      md5('o_custkey:bigint,o_orderdate:date,o_orderkey:bigint') AS schema_hash FROM h""",
)
def s17(spark, d):
    o = table(spark, d, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))
    return tb.audited_scan(o, ["o_orderkey", "o_custkey", "o_orderdate"], c("o_orderstatus") == "F", "o_orderdate")[1]


@query("s18_round_trip_sinks", "SELECT 'parquet' AS format, count(*) AS n_rows, sum(o_totalprice) AS total FROM orders UNION ALL SELECT 'csv', count(*), sum(o_totalprice) FROM orders UNION ALL SELECT 'json', count(*), sum(o_totalprice) FROM orders")
def s18(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    out = None
    for fmt in ("parquet", "csv", "json"):
        path = tb.work_folder(spark, f"sink-{fmt}")
        tb.write_table(o, path, fmt, ["o_orderstatus"])
        reader = spark.read.schema("o_orderkey bigint, o_totalprice double, o_orderstatus string")
        back = reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)
        one = back.agg(lit(fmt).alias("format"), F.count(lit(1)).alias("n_rows"), F.sum("o_totalprice").alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "s19_append_snapshots",
    with_sql(SNAPSHOTS)
    + "SELECT id, strftime(date_trunc('second', fetched_at), '%Y-%m-%dT%H:%M:%SZ') AS fetched_at_utc, odds_over, odds_under FROM snapshots",
)
def s19(spark, d):
    s = snapshots(spark, d).withColumn("fetched_text", F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ssXXX".replace("XXX", "'+00:00'")))
    path = tb.work_folder(spark, "snapshots")
    early, late = s.where("id % 2 = 0"), s.where("id % 2 = 1").withColumnsRenamed({"odds_over": "line_over", "odds_under": "line_under"})
    keep = ["id", "fetched_at_utc", "odds_over", "odds_under"]
    for part in (early, late):
        tb.snapshot_rows(part, "fetched_text").select(*keep).write.mode("append").parquet(path)
    return spark.read.parquet(path)


_SIX = ["game_id", "entity_id", "book", "line", "odds_over", "odds_under"]


@query(
    "s20_insert_if_absent",
    with_sql(BETS)
    + """, k AS (SELECT game_id, entity_id, CASE WHEN book = 3 THEN NULL ELSE book END AS book, line, odds_over, odds_under, flag, seq, venue, bet_date FROM bets),
    t AS (SELECT * FROM k WHERE flag = 'R'), b AS (SELECT * FROM k WHERE flag <> 'R')
    SELECT game_id, entity_id, book, line, odds_over, odds_under, arg_min(flag, (seq, venue, bet_date, flag)) AS flag FROM b
    WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.game_id = b.game_id AND t.entity_id = b.entity_id AND t.book IS NOT DISTINCT FROM b.book AND t.line = b.line AND t.odds_over = b.odds_over AND t.odds_under = b.odds_under)
    GROUP BY game_id, entity_id, book, line, odds_over, odds_under""",
)
def s20(spark, d):
    b = bets(spark, d).withColumn("book", F.when(c("book") != 3, c("book"))).select(*_SIX, "flag", "seq", "venue", "bet_date")
    return tb.insert_new(b.where("flag = 'R'"), b.where("flag <> 'R'"), _SIX, ["seq", "venue", "bet_date", "flag"]).select(*_SIX, "flag")


@query(
    "s21_upsert_only_null",
    """WITH t AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS v FROM orders), p AS (SELECT o_orderkey AS k, -1.0::DOUBLE AS v FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT t.k, coalesce(t.v, p.v) AS filled, CASE WHEN p.k IS NOT NULL THEN p.v ELSE t.v END AS replaced FROM t LEFT JOIN p ON t.k = p.k""",
)
def s21(spark, d):
    o = table(spark, d, "orders")
    t = o.select(c("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day"), F.when(c("o_orderkey") % 2 == 0, c("o_totalprice")).alias("v"))
    p = o.where("o_orderpriority = '1-URGENT'").select(c("o_orderkey").alias("k"), lit(-1.0).alias("v"))
    both = t.select("k", c("v").alias("filled"), c("v").alias("replaced"))
    patch = p.select("k", c("v").alias("filled"), c("v").alias("replaced"))
    return tb.upsert(tb.upsert(both, patch, ["k"], ["filled"], only_null=True), patch, ["k"], ["replaced"])


@query(
    "s21_partition_rewrite",
    """SELECT o_orderkey AS k, CAST(year(o_orderdate) AS INTEGER) AS season, CASE WHEN year(o_orderdate) = 1998 AND o_orderstatus = 'F' THEN 0 ELSE o_totalprice END AS v FROM orders""",
)
def s21_partitions(spark, d):
    rows = table(spark, d, "orders").select(c("o_orderkey").alias("k"), c("o_totalprice").alias("v"), "o_orderstatus", F.year("o_orderdate").alias("season"))
    live = tb.work_folder(spark, "live")
    tb.write_table(rows.drop("o_orderstatus"), live, partition_by=["season"])
    patch = rows.where("season = 1998 and o_orderstatus = 'F'").select("k", "season", lit(0.0).alias("v"))
    tb.upsert_partitions(spark, live, patch, ["k"], ["v"], "season")
    return spark.read.parquet(live).select("k", "season", "v")


@query(
    "s22_ticket_derivation",
    """WITH t AS (SELECT event_id, value - 1 AS stake, CASE WHEN event_id % 3 = 0 THEN 2.5 END AS m, CASE WHEN event_id % 3 = 1 THEN value * 3 END AS p, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'edge' END AS reason FROM events)
    SELECT event_id, coalesce(m, p / nullif(stake, 0))::DOUBLE AS payout_multiplier, coalesce(p, stake * m)::DOUBLE AS potential_payout,
      CASE WHEN reason IS NULL OR trim(reason) = '' THEN 'missing reason' WHEN stake <= 0 THEN 'bad stake' ELSE '' END AS problem FROM t""",
)
def s22(spark, d):
    i = c("event_id")
    t = table(spark, d, "events").select(
        "event_id", (c("value") - 1).alias("stake"), F.when(i % 3 == 0, lit(2.5)).alias("m"), F.when(i % 3 == 1, c("value") * 3).alias("p"),
        F.when(i % 5 == 1, lit(" ")).when(i % 5 != 0, lit("edge")).alias("reason"),
    )
    return tb.build_tickets(t, "stake", "m", "p", "reason").select("event_id", "payout_multiplier", "potential_payout", "problem")


@query(
    "s23_compact_legs",
    """WITH r AS (SELECT event_id, event_id % 5 AS k FROM events)
    SELECT event_id, CAST(1 AS INTEGER) AS leg_number, 'OVER' AS side, CAST(event_id % 40 AS DOUBLE) + 0.5 AS line_at_bet, CAST(CASE WHEN k = 1 THEN -115 END AS INTEGER) AS odds_at_bet, CASE WHEN k = 1 THEN 'bookx' END AS book, '' AS problem FROM r
    UNION ALL SELECT event_id, 2, CASE k WHEN 2 THEN 'MAYBE' ELSE 'UNDER' END, CASE WHEN k = 3 THEN NULL ELSE 20 END, CASE WHEN k = 4 THEN -110 END, CASE WHEN k = 4 THEN 'b' END, CASE k WHEN 2 THEN 'bad side' WHEN 3 THEN 'bad line' WHEN 4 THEN 'bad field count' ELSE '' END FROM r""",
)
def s23(spark, d):
    i = c("event_id")
    first = F.concat(lit("Smith:BOS:over:"), (i % 40).cast("string"), lit(".5"), F.when(i % 5 == 1, lit(":-115:bookx")).otherwise(lit("")))
    second = (
        F.when(i % 5 == 2, lit("Jones:NYR:maybe:20")).when(i % 5 == 3, lit("Jones:NYR:under:abc")).when(i % 5 == 4, lit("Jones:NYR:under:20:-110:b:extra")).otherwise(lit("Jones:nyr:under:20"))
    )
    legs = table(spark, d, "events").select("event_id", F.concat_ws("; ", first, second).alias("legs"))
    return dc.explode_legs(legs, "legs", ["event_id"]).select("event_id", "leg_number", "side", "line_at_bet", "odds_at_bet", "book", "problem")


@query("s_schema_gate", "SELECT count(*) AS n_rows FROM orders")
def s_schema(spark, d):
    """A scan that stops when the file's schema is not the expected one."""
    from pyspark.sql import types as T

    o = table(spark, d, "orders")
    expected = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType())])
    found = schema_surprises(o.select("o_orderkey", "o_totalprice"), expected)
    if any(found.values()):
        raise ValueError(f"schema changed: {found}")
    return o.agg(F.count(lit(1)).alias("n_rows"))
