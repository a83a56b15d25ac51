"""The driver's tables seen as domain tables, once as frames and once as SQL.

orders    -> form log: entity o_custkey, order (o_orderdate, o_orderkey), value o_totalprice
lineitem  -> quotes (event, book, line, side, price) and the bet ledger
events    -> line snapshots: entity user_id, book event_type, line value
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formbook.functions.odds import grade, profit


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def form(spark: SparkSession, folder: str) -> DataFrame:
    """Entity results in time order; team is the customer key modulo 30."""
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("game_id"),
        F.col("o_custkey").alias("entity_id"),
        (F.col("o_custkey") % 30).cast("int").alias("team_id"),
        F.to_date("o_orderdate").alias("game_date"),
        F.year("o_orderdate").alias("season"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderstatus").alias("status"),
        (F.col("o_totalprice") % 40).alias("shots"),
        (F.col("o_orderkey") % 2).cast("int").alias("is_home"),
    )


FORM = """form AS (
  SELECT o_orderkey AS game_id, o_custkey AS entity_id, CAST(o_custkey % 30 AS INTEGER) AS team_id,
         CAST(o_orderdate AS DATE) AS game_date, CAST(year(o_orderdate) AS INTEGER) AS season, o_totalprice AS value,
         o_orderstatus AS status, o_totalprice % 40 AS shots, CAST(o_orderkey % 2 AS INTEGER) AS is_home
  FROM orders)"""


def quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Long quotes, one row per side."""
    li = table(spark, folder, "lineitem")
    return li.select(
        F.col("l_partkey").alias("event_id"),
        (F.col("l_suppkey") % 4).alias("book"),
        F.floor(F.col("l_quantity") / 10).cast("double").alias("line"),
        F.when(F.col("l_linestatus") == "O", F.lit("Over")).otherwise(F.lit("Under")).alias("side"),
        (1.5 + 10 * F.col("l_tax")).alias("price"),
        F.to_date("l_shipdate").alias("quote_date"),
        F.col("l_orderkey").alias("src"),
        F.col("l_linenumber").alias("seq"),
        F.col("l_suppkey").alias("venue"),
        F.col("l_extendedprice").alias("amount"),
    )


QUOTES = """quotes AS (
  SELECT l_partkey AS event_id, l_suppkey % 4 AS book, CAST(floor(l_quantity / 10) AS DOUBLE) AS line,
         CASE WHEN l_linestatus = 'O' THEN 'Over' ELSE 'Under' END AS side, 1.5 + 10 * l_tax AS price,
         CAST(l_shipdate AS DATE) AS quote_date, l_orderkey AS src, l_linenumber AS seq, l_suppkey AS venue,
         l_extendedprice AS amount
  FROM lineitem)"""

QUOTE_POSITION = ["src", "seq", "venue", "price"]

PAIRS = QUOTES + """,
sided AS (
  SELECT event_id, book, line,
         arg_min(price, (src, seq, venue, price)) FILTER (side = 'Over') AS price_over,
         arg_min(price, (src, seq, venue, price)) FILTER (side = 'Under') AS price_under,
         min(price) FILTER (side = 'Over') AS lo_o, max(price) FILTER (side = 'Over') AS hi_o,
         min(price) FILTER (side = 'Under') AS lo_u, max(price) FILTER (side = 'Under') AS hi_u
  FROM quotes GROUP BY event_id, book, line),
pairs AS (
  SELECT event_id, book, line, price_over, price_under,
         (1 / price_over) / (1 / price_over + 1 / price_under) AS p_over,
         1 / price_over + 1 / price_under - 1 AS overround
  FROM sided WHERE price_over IS NOT NULL AND price_under IS NOT NULL)"""


def bets(spark: SparkSession, folder: str) -> DataFrame:
    """Priced candidates with outcomes, and one graded bet per row on the row's own side."""
    li = table(spark, folder, "lineitem")
    tick = F.round(F.col("l_tax") * 100).cast("int")
    whole = F.col("l_linenumber") % 2 != 0
    base = li.select(
        F.col("l_orderkey").alias("game_id"),
        F.col("l_partkey").alias("entity_id"),
        (F.col("l_suppkey") % 4).cast("int").alias("book"),
        F.col("l_suppkey").alias("venue"),
        F.col("l_linenumber").alias("seq"),
        F.to_date("l_shipdate").alias("bet_date"),
        F.col("l_returnflag").alias("flag"),
        (F.floor(F.col("l_quantity") / 2) + F.when(whole, F.lit(0.0)).otherwise(F.lit(0.5))).alias("line"),
        F.floor(F.col("l_extendedprice") / 4000).cast("double").alias("actual"),
        (0.35 + 3 * F.col("l_discount")).alias("p_over"),
        F.when(whole, F.lit(0.02)).otherwise(F.lit(0.0)).alias("p_push"),
        F.when(tick < 4, 100 + 10 * tick).otherwise(-(100 + 10 * tick)).alias("odds_over"),
        (-(105 + 5 * F.col("l_linenumber"))).alias("odds_under"),
        F.when(F.col("l_linestatus") == "O", F.lit("OVER")).otherwise(F.lit("UNDER")).alias("side"),
        (1.0 + F.col("l_linenumber")).alias("stake"),
        F.col("l_extendedprice").alias("amount"),
    )
    out = base.withColumn("p_under", 1.0 - F.col("p_over") - F.col("p_push")).withColumn(
        "odds", F.when(F.col("side") == "OVER", F.col("odds_over")).otherwise(F.col("odds_under"))
    )
    out = out.withColumn("result", grade(F.col("side"), F.col("line"), F.col("actual")))
    return out.withColumn("profit", profit(F.col("result"), F.col("odds"), F.col("stake")))


BET_ID = ["game_id", "seq", "entity_id", "venue", "bet_date"]

BETS = """base_bets AS (
  SELECT l_orderkey AS game_id, l_partkey AS entity_id, CAST(l_suppkey % 4 AS INTEGER) AS book, l_suppkey AS venue,
         l_linenumber AS seq, CAST(l_shipdate AS DATE) AS bet_date, l_returnflag AS flag,
         CAST(floor(l_quantity / 2) + CASE WHEN l_linenumber % 2 <> 0 THEN 0.0 ELSE 0.5 END AS DOUBLE) AS line,
         CAST(floor(l_extendedprice / 4000) AS DOUBLE) AS actual, 0.35 + 3 * l_discount AS p_over,
         CAST(CASE WHEN l_linenumber % 2 <> 0 THEN 0.02 ELSE 0.0 END AS DOUBLE) AS p_push,
         CAST(CASE WHEN round(l_tax * 100) < 4 THEN 100 + 10 * round(l_tax * 100) ELSE -(100 + 10 * round(l_tax * 100)) END AS INTEGER) AS odds_over,
         -(105 + 5 * l_linenumber) AS odds_under,
         CASE WHEN l_linestatus = 'O' THEN 'OVER' ELSE 'UNDER' END AS side,
         CAST(1 + l_linenumber AS DOUBLE) AS stake, l_extendedprice AS amount
  FROM lineitem),
priced_bets AS (
  SELECT *, 1.0 - p_over - p_push AS p_under, CASE WHEN side = 'OVER' THEN odds_over ELSE odds_under END AS odds FROM base_bets),
graded_bets AS (
  SELECT *, CASE WHEN actual = line THEN 'PUSH' WHEN (side = 'OVER') = (actual > line) THEN 'WIN' ELSE 'LOSS' END AS result FROM priced_bets),
bets AS (
  SELECT *, CAST(CASE result WHEN 'WIN' THEN stake * (CASE WHEN odds < 0 THEN 100.0 / -odds + 1 ELSE odds / 100.0 + 1 END - 1)
                 WHEN 'LOSS' THEN -stake ELSE 0 END AS DOUBLE) AS profit
  FROM graded_bets)"""


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Append-only line log; a third of the rows carry no start, the others the day's 22:00."""
    e = table(spark, folder, "events")
    day = F.to_date("ts")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("fetched_at"),
        day.alias("game_date"),
        F.col("user_id").alias("entity_id"),
        F.col("event_type").alias("book"),
        F.col("value").alias("line"),
        F.when(F.col("event_id") % 3 != 0, F.col("ts").cast("date").cast("timestamp_ntz") + F.expr("INTERVAL '12' HOUR")).alias("start_at"),
        (-(105 + F.col("event_id") % 20)).cast("int").alias("odds_over"),
        (-(105 + F.col("event_id") % 15)).cast("int").alias("odds_under"),
    )


SNAPSHOTS = """snapshots AS (
  SELECT event_id AS id, ts AS fetched_at, CAST(ts AS DATE) AS game_date, user_id AS entity_id, event_type AS book, value AS line,
         CASE WHEN event_id % 3 <> 0 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR END AS start_at,
         CAST(-(105 + event_id % 20) AS INTEGER) AS odds_over, CAST(-(105 + event_id % 15) AS INTEGER) AS odds_under
  FROM events)"""


def micros(ts: Column) -> Column:
    """Epoch microseconds of a time zone free time stamp."""
    return F.unix_micros(ts.cast("timestamp"))


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def prob_sql(odds: str) -> str:
    """American price to implied probability, as SQL."""
    return f"(CASE WHEN {odds} < 0 THEN -{odds} / (-{odds} + 100.0) ELSE 100.0 / ({odds} + 100.0) END)".replace("--", "- -")


def decimal_sql(odds: str) -> str:
    return f"(CASE WHEN {odds} < 0 THEN 100.0 / -({odds}) + 1 ELSE {odds} / 100.0 + 1 END)"
