"""T: the snapshot log as streaming jobs, run to the end of what has landed."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from formbook.functions.odds import grade
from formbook.plans.frames import SNAPSHOTS, table, with_sql
from formbook.plans.registry import query
from formbook.sources.tables import work_folder
from formbook.streaming import logs as lg
from formbook.streaming import snapshots as sn

c = F.col


LANDINGS = 3


def landed(spark, d, folder=None):
    """The events file, or what has landed of it in ``folder``, as a stream of snapshots with event-time stamps."""
    schema = table(spark, d, "events").schema
    e = sn.landing_stream(spark, folder, schema) if folder else sn.landing_stream(spark, d, schema, glob="events.parquet")
    day = F.to_date("ts")
    return e.select(
        c("event_id").alias("id"), c("ts").cast("timestamp").alias("fetched_at"), day.alias("game_date"), c("user_id").alias("entity_id"), c("event_type").alias("book"),
        c("value").alias("line"), (day.cast("timestamp") + F.expr("INTERVAL '12' HOUR")).alias("start_at"),
    )


def in_landings(spark, d, work, *sinks, again=False, rows=None):
    """The events land in three parts, the newest first, each run to its end; ``again`` lands each part with the next one, too."""
    e = table(spark, d, "events")
    at = F.unix_micros(c("ts").cast("timestamp"))
    first, last = e.agg(F.min(at), F.max(at)).first()
    part = F.coalesce(F.floor((F.lit(last) - at) * LANDINGS / F.lit((last or 0) - (first or 0) + 1)), F.lit(0))
    for k in range(LANDINGS):
        e.where(part.between(k - 1 if again else k, k)).write.mode("append").parquet(f"{work}/landing")
        for n, sink in enumerate(sinks):
            stream = landed(spark, d, f"{work}/landing")
            sn.run_to_end(rows(stream) if rows else stream, f"{work}/run{n}", sink)


# when a row lands, in SQL: the newest third of the time first
ARRIVED = f"""arrived AS (SELECT *, floor((max(epoch_us(fetched_at)) OVER () - epoch_us(fetched_at)) * {LANDINGS} / (max(epoch_us(fetched_at)) OVER () - min(epoch_us(fetched_at)) OVER () + 1)) AS k FROM snapshots)"""


def table_rows(spark, d):
    """No rows, with the columns of ``landed``."""
    return spark.createDataFrame([], landed(spark, d).schema)


def by_day(rows):
    return rows.select("id", "fetched_at", "entity_id", "book", "line", F.to_date("fetched_at").alias("day"))


@query("t1_ingest_without_repeats", with_sql(SNAPSHOTS) + "SELECT id, epoch_us(fetched_at) AS fetched_us, entity_id, book, line FROM snapshots")
def t1(spark, d):
    """Every row but those of the last part lands again with the next part; repeats are dropped, late rows stay."""
    work = work_folder(spark, "t1")
    key = ["day", "id", "fetched_at", "line"]
    log = lg.KeyedLog(f"{work}/log", "day", lg.keep_first(key, ["entity_id", "book"]), fan=2)
    in_landings(spark, d, work, log.sink(), again=True, rows=by_day)
    return log.read(spark, by_day(table_rows(spark, d)).schema).select("id", F.unix_micros("fetched_at").alias("fetched_us"), "entity_id", "book", "line")


@query(
    "t2_firewall",
    with_sql(SNAPSHOTS)
    + """SELECT CASE WHEN fetched_at <= CAST(game_date AS TIMESTAMP) + INTERVAL 12 HOUR THEN 'pregame' ELSE 'late' END AS route, count(*) AS n_rows, sum(line) AS total FROM snapshots GROUP BY 1""",
)
def t2(spark, d):
    work = work_folder(spark, "t2")
    in_landings(spark, d, work, sn.firewall(work, "fetched_at", "start_at"))
    parts = [spark.read.parquet(f"{work}/{r}").withColumn("route", F.lit(r)) for r in ("pregame", "late")]
    return parts[0].unionByName(parts[1]).groupBy("route").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("line").alias("total"))


@query(
    "t3_current_and_closing_line",
    with_sql(SNAPSHOTS)
    + """, s AS (SELECT *, CAST(game_date AS TIMESTAMP) + INTERVAL 12 HOUR AS st FROM snapshots)
    SELECT game_date, entity_id, book, arg_max(line, (fetched_at, id)) AS current_line, arg_max(line, (fetched_at, id)) FILTER (fetched_at <= st) AS closing_line, count(*) AS n_snapshots FROM s GROUP BY ALL""",
)
def t3(spark, d):
    key = ["game_date", "entity_id", "book"]
    work = work_folder(spark, "t3")
    parts = sn.line_parts(key, "fetched_at", "id", "start_at", "line")
    log = lg.KeyedLog(f"{work}/log", "game_date", sn.fold_lines(key), fan=2)
    in_landings(spark, d, work, log.sink(parts))
    return sn.line_columns(log.read(spark, parts(table_rows(spark, d)).schema), key).select(*key, "current_line", "closing_line", "n_snapshots")


_T4_KEY = ["game_date", "entity_id", "book"]


@query(
    "t4_insert_if_absent_sink",
    with_sql(SNAPSHOTS, ARRIVED) + "SELECT game_date, entity_id, book, arg_min(id, (k, id)) AS id, arg_min(line, (k, id)) AS line FROM arrived GROUP BY ALL",
)
def t4(spark, d):
    """Three landings; the first row of a key to arrive stays."""
    work = work_folder(spark, "t4")
    log = lg.KeyedLog(f"{work}/table", "game_date", lg.keep_first(_T4_KEY, ["id"]), fan=2)
    in_landings(spark, d, work, log.sink(), rows=lambda s: s.select(*_T4_KEY, "id", "line"))
    return log.read(spark, table_rows(spark, d).select(*_T4_KEY, "id", "line").schema)


@query(
    "t4_upsert_sink",
    with_sql(SNAPSHOTS, ARRIVED)
    + """SELECT game_date, entity_id, book, arg_max(id, (k, id)) AS id, arg_max(line, (k, id)) AS line, arg_max(line, (k, id)) FILTER (id % 3 = 0) AS third_line FROM arrived GROUP BY ALL""",
)
def t4_upsert(spark, d):
    """Three landings; each column of a key has its newest value that is not null, ``third_line`` comes with every third row only."""
    work = work_folder(spark, "t4u")
    columns = [*_T4_KEY, "id", "line", F.when(c("id") % 3 == 0, c("line")).alias("third_line")]
    log = lg.KeyedLog(f"{work}/table", "game_date", lg.keep_last(_T4_KEY, ["id"]), fan=2)
    in_landings(spark, d, work, log.sink(), rows=lambda s: s.select(*columns))
    return log.read(spark, table_rows(spark, d).select(*columns).schema)


LEGS = """legs AS (SELECT l_orderkey AS ticket_id, l_linenumber, l_suppkey, l_partkey AS entity_id, CASE WHEN l_linestatus = 'O' THEN 'OVER' ELSE 'UNDER' END AS side, floor(l_quantity) AS line FROM lineitem)"""


def legs(spark, d):
    return table(spark, d, "lineitem").select(
        c("l_orderkey").alias("ticket_id"), "l_linenumber", "l_suppkey", c("l_partkey").alias("entity_id"),
        F.when(c("l_linestatus") == "O", F.lit("OVER")).otherwise(F.lit("UNDER")).alias("side"), F.floor("l_quantity").alias("line"),
    )


def graded_columns(rows):
    """Result of a leg, and how far the closing line moved in its favour."""
    moved = F.when(c("side") == "OVER", c("closing") - c("line")).otherwise(c("line") - c("closing"))
    return {"result": grade(c("side"), c("line"), c("actual")), "clv": moved}


LEG_FACTS = T.StructType([T.StructField("entity_id", T.LongType()), T.StructField("actual", T.LongType()), T.StructField("closing", T.LongType())])
LEG_ID = ["ticket_id", "l_linenumber", "l_suppkey", "entity_id"]


def resettled(spark, d, facts):
    """Runs the settlement over three landings of ``facts`` (of a stream of events)."""
    work = work_folder(spark, "t5")
    job = sn.Resettlement(work, legs(spark, d), ["entity_id"], LEG_ID, ["ticket_id"], LEG_FACTS, graded_columns)
    in_landings(spark, d, work, job.write, rows=facts)
    return job


@query(
    "t5_resettle_on_results",
    f"""WITH {LEGS},
    r AS (SELECT event_id AS entity_id, floor(value) AS actual FROM events WHERE event_type <> 'error'),
    g AS (SELECT ticket_id, actual, CASE WHEN actual IS NULL THEN NULL WHEN actual = line THEN 'PUSH' WHEN (side = 'OVER') = (actual > line) THEN 'WIN' ELSE 'LOSS' END AS res FROM legs LEFT JOIN r USING (entity_id))
    SELECT ticket_id, count(*) AS n_legs, CASE WHEN count(res) < count(*) THEN 'open' WHEN bool_or(res = 'LOSS') THEN 'lost' WHEN bool_and(res = 'WIN') THEN 'won' WHEN bool_and(res = 'PUSH') THEN 'push' ELSE 'partial' END AS status
    FROM g GROUP BY 1 HAVING count(actual) > 0""",
)
def t5(spark, d):
    """Results arrive in three landings; tickets with a leg among them are graded and settled again."""
    job = resettled(spark, d, lambda s: s.where("book <> 'error'").select(c("id").alias("entity_id"), F.floor("line").alias("actual"), F.lit(None).cast("long").alias("closing")))
    return job.read(spark, "tickets", T.StructType([T.StructField("ticket_id", T.LongType()), T.StructField("n_legs", T.LongType()), T.StructField("status", T.StringType())]))


# closing lines come with every third event, results with the others; both are corrected when an entity is seen again
@query(
    "t5_closing_back_fill",
    with_sql(SNAPSHOTS, ARRIVED, LEGS)
    + """, f AS (SELECT entity_id, arg_max(floor(line), (k, floor(line))) FILTER (id % 3 <> 0) AS actual, arg_max(floor(line), (k, floor(line))) FILTER (id % 3 = 0) AS closing FROM arrived GROUP BY 1)
    SELECT ticket_id, l_linenumber, l_suppkey, entity_id, CAST(actual AS BIGINT) AS actual, CAST(closing AS BIGINT) AS closing,
      CASE WHEN actual IS NULL THEN NULL WHEN actual = legs.line THEN 'PUSH' WHEN (side = 'OVER') = (actual > legs.line) THEN 'WIN' ELSE 'LOSS' END AS result,
      CAST(CASE WHEN side = 'OVER' THEN closing - legs.line ELSE legs.line - closing END AS BIGINT) AS clv
    FROM legs JOIN (SELECT DISTINCT ticket_id FROM legs JOIN f USING (entity_id)) USING (ticket_id) LEFT JOIN f USING (entity_id)""",
)
def t5_back_fill(spark, d):
    """Results and closing lines arrive in any order; a leg with a result gets its closing line when that lands."""
    third = c("id") % 3 == 0
    job = resettled(spark, d, lambda s: s.select("entity_id", F.when(~third, F.floor("line")).alias("actual"), F.when(third, F.floor("line")).alias("closing")))
    kinds = {"actual": T.LongType(), "closing": T.LongType(), "result": T.StringType(), "clv": T.LongType()}
    schema = T.StructType([*legs(spark, d).select(*LEG_ID).schema.fields, *[T.StructField(n, k) for n, k in kinds.items()]])
    return job.read(spark, "legs", schema)
