"""Readers on real files, keyed writes, and streaming sinks with replays."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from formbook.operators.quality import GateFailed
from formbook.session import checkpointed
from formbook.sources import documents as dc
from formbook.sources import tables as tb
from formbook.streaming import logs as lg
from formbook.streaming import snapshots as sn


def write(folder, name, doc):
    (folder / name).write_text(doc if isinstance(doc, str) else json.dumps(doc, indent=1))


def goalie(pid, starter, saves=20, **kw):
    return {"playerId": pid, "name": {"default": f"G{pid}"}, "starter": starter, "saves": saves, "shotsAgainst": saves + 2, **kw}


def test_boxscores_from_files(spark, tmp_path):
    box = {
        "id": 7, "gameDate": "2024-01-02", "season": 20232024, "homeTeam": {"abbrev": "BOS", "score": 3, "sog": 30}, "awayTeam": {"abbrev": "NYR", "score": 2, "sog": 25},
        "playerByGameStats": {
            "homeTeam": {"goalies": [goalie(1, True, evenStrengthShotsAgainst="15/16"), goalie(2, False, evenStrengthShotsAgainst="??")], "forwards": [{"playerId": 5, "sog": 3}]},
            "awayTeam": {"goalies": [goalie(3, 1)], "defense": [{"playerId": 6, "sog": 1}]},
        },
    }
    write(tmp_path, "a.json", box)
    docs = dc.read_json(spark, str(tmp_path), dc.BOX_SCORE)
    starters = {r["goalie_id"]: (r["team_abbrev"], r["opponent_team"], r["is_home"], r["opp_shots"]) for r in dc.goalie_games(docs).collect()}
    assert starters == {1: ("BOS", "NYR", 1, 25), 3: ("NYR", "BOS", 0, 30)}  # JSON true and 1 both start
    every = {r["goalie_id"]: (r["even_strength_saves"], r["even_strength_shots_against"]) for r in dc.goalie_performance(docs).collect()}
    assert every == {1: (15, 16), 2: (0, 0), 3: (0, 0)}
    assert {(r["player_id"], r["sog"]) for r in dc.skater_shots(docs).collect()} == {(5, 3), (6, 1)}


def test_archive_scan(spark, tmp_path):
    eid = "0" * 31 + "a"
    head = {"timestamp": "2025-12-08T00:05:37Z", "previous_timestamp": None, "next_timestamp": "2025-12-08T00:10:37Z", "data": {}}
    write(tmp_path, f"odds_{eid}_date=2025-12-08T00_10_00Z_markets=totals,h2h_regions=us.json", head)
    write(tmp_path, "events_date=2025-12-08T12_00_00Z.json", {"timestamp": "2025-12-08T11:55:00Z", "data": []})
    write(tmp_path, "notes.json", {"a": 1})
    rows = {r["kind"]: r for r in dc.scan_archive(spark, str(tmp_path)).collect()}
    assert set(rows) == {"odds", "events", "unparsable"}
    odds = rows["odds"]
    assert (odds["event_id"], odds["markets"], odds["regions"]) == (eid, "h2h,totals", "us")
    assert odds["requested_ts"] == dt.datetime(2025, 12, 8, 0, 10) and odds["next_ts"] == dt.datetime(2025, 12, 8, 0, 10, 37)
    assert rows["events"]["next_ts"] is None


def test_archive_scan_marks_what_it_cannot_read(spark, tmp_path):
    name = "events_date=2025-12-{:02d}T12_00_00Z.json"
    head = {"timestamp": "2025-12-08T11:55:00Z", "previous_timestamp": "2025-12-08T11:50:00Z", "data": []}
    write(tmp_path, name.format(1), head)
    write(tmp_path, name.format(2), '{"timestamp": "2025-12-08T11:55:00Z", "data": [')
    write(tmp_path, name.format(3), {"data": []})
    write(tmp_path, name.format(4), "")
    write(tmp_path, "events_date=soon.json", head)
    write(tmp_path, "other.json", "no json at all")
    rows = {r["file_name"]: r for r in dc.scan_archive(spark, str(tmp_path)).collect()}
    got = {n: r["status"] for n, r in rows.items()}
    assert got == {name.format(1): "ok", name.format(2): "broken", name.format(3): "no time stamp", "events_date=soon.json": "bad name", "other.json": "broken"}
    assert rows[name.format(1)]["previous_ts"] == dt.datetime(2025, 12, 8, 11, 50) and rows[name.format(1)]["next_ts"] is None
    # a broken file's stamps are not trusted to be there, its name is still read
    assert rows[name.format(2)]["requested_ts"] == dt.datetime(2025, 12, 2, 12)


def test_odds_envelope_and_bulk(spark, tmp_path):
    def event(n):
        outcomes = [{"name": "Over", "description": "G", "point": 25.5, "price": 1.9}, {"name": "Under", "description": "G", "point": 25.5, "price": 1.9}]
        return {"id": n, "commence_time": "2024-01-01T00:00:00Z", "home_team": "A", "away_team": "B",
                "bookmakers": [{"key": "x", "markets": [{"key": "player_total_saves", "outcomes": outcomes}, {"key": "h2h", "outcomes": outcomes[:1]}]}]}

    one, bulk = tmp_path / "one", tmp_path / "bulk"
    one.mkdir(), bulk.mkdir()
    write(one, "a.json", {"timestamp": "2023-12-31T23:00:00Z", "data": event("e1")})
    write(bulk, "b.json", {"timestamp": "2023-12-31T23:00:00Z", "data": [event("e1"), event("e2")]})
    q = dc.flatten_quotes(dc.read_json(spark, str(one), dc.ODDS_ENVELOPE), ["player_total_saves"])
    assert [(r["side"], r["outcome_index"]) for r in q.orderBy("outcome_index").collect()] == [("Over", 0), ("Under", 1)]
    m = dc.flatten_bulk_markets(dc.read_json(spark, str(bulk), dc.BULK_ENVELOPE), ["player_total_saves", "h2h"])
    got = {(r["market"], r["implied_prob_devig"]) for r in m.collect()}
    assert got == {("player_total_saves", 0.5), ("h2h", None)} and m.count() == 6


def test_bulk_prices_need_no_other_fields(spark):
    def group(key, *prices):
        return {"key": key, "outcomes": [{"name": n, "description": "G", "point": 25.5, **({} if p is None else {"price": p})} for n, p in zip("OUX", prices)]}

    groups = [("a", (2.0, 4.0)), ("b", (2.0, None)), ("c", (2.0, 0.0)), ("d", (2.0, -3.0)), ("e", (2.0, 2.0, 2.0)), ("f", (2.0,)), ("g", ("NaN", 2.0)), ("h", ())]
    event = {"id": "e1", "home_team": "A", "bookmakers": [{"key": k, "markets": [group("m", *p), group("other", 2.0, 2.0)]} for k, p in groups]}
    texts = [json.dumps({"timestamp": "2024-01-01T00:00:00Z", "data": [event, {"id": "e2", "bookmakers": []}, None]}), "{broken", None, "{}", '{"data":[]}']
    docs = spark.createDataFrame([(t,) for t in texts], "doc string")
    wanted = ["book", "outcome_label", "implied_prob_devig"]
    whole = dc.flatten_bulk_markets(dc.parse_json(docs, "doc", dc.BULK_ENVELOPE), ["m"])
    lean = dc.flatten_bulk_markets(dc.parse_json(docs, "doc", dc.BULK_PRICES), ["m"], columns=wanted)
    assert lean.columns == wanted and len(whole.columns) == len(dc.BULK_COLUMNS)
    got = sorted(map(str, map(tuple, lean.collect())))
    assert got == sorted(map(str, map(tuple, whole.select(*wanted).collect())))
    clean = {("a", "O"): 0.5 / 0.75, ("a", "U"): 0.25 / 0.75, ("g", "O"): float("nan"), ("g", "U"): float("nan")}
    expected = [(k, n, clean.get((k, n))) for k, p in groups for n, _ in zip("OUX", p)]
    assert got == sorted(map(str, expected))
    # no function that is evaluated outside generated code, once per outcome
    assert "lambda" not in whole._jdf.queryExecution().optimizedPlan().toString()


def test_schedule_first_document_wins(spark):
    docs = [(1, '{"games":[{"id":1,"season":1,"gameType":2,"gameDate":"2024-01-01","homeTeam":{"abbrev":"A"},"awayTeam":{"abbrev":"B"}}]}'),
            (2, '{"games":[{"id":1,"season":1,"gameType":2,"gameDate":"2024-02-02","homeTeam":{"abbrev":"A"},"awayTeam":{"abbrev":"B"}}]}')]
    parsed = dc.parse_json(spark.createDataFrame(docs, "n int, doc string"), "doc", dc.SCHEDULE, ["n"])
    rows = dc.schedule_rows(parsed, ["n"]).collect()
    assert {(r["team_abbrev"], r["is_home"], r["game_date"]) for r in rows} == {("A", 1, dt.date(2024, 1, 1)), ("B", 0, dt.date(2024, 1, 1))}


def test_csv_reader_prunes_and_checks(spark, tmp_path):
    head = "team,season,gameId,opposingTeam,gameDate,situation,iceTime,xGoalsFor,shotAttemptsFor,unblockedShotAttemptsFor,xGoalsAgainst,shotAttemptsAgainst,unblockedShotAttemptsAgainst,playoffGame"
    row = "BOS,{s},{g},NYR,20240102,all,3600,2.5,50,40,2.0,45,35,0"
    write(tmp_path, "t.csv", "\n".join([head, row.format(s=2022, g=1), row.format(s=2023, g=2)]))
    cols, key = ["team", "season", "gameId", "gameDate", "situation"], ["gameId", "team", "situation"]
    out = tb.read_game_csv(spark, str(tmp_path / "t.csv"), tb.TEAM_GAMES, cols, key, 2023).collect()
    assert [(r["gameId"], r["gameDate"]) for r in out] == [(2, dt.date(2024, 1, 2))]
    write(tmp_path, "u.csv", "\n".join([head, row.format(s=2023, g=2), row.format(s=2023, g=2)]))
    with pytest.raises(GateFailed):
        tb.read_game_csv(spark, str(tmp_path / "u.csv"), tb.TEAM_GAMES, cols, key, 2023)


def test_insert_matches_null_key_parts(spark):
    target = spark.createDataFrame([(1, None)], "a int, b int")
    batch = spark.createDataFrame([(1, None, 1), (1, 2, 2), (1, 2, 3)], "a int, b int, n int")
    assert [(r["b"], r["n"]) for r in tb.insert_new(target, batch, ["a", "b"], ["n"]).collect()] == [(2, 2)]


def test_upsert_modes(spark):
    target = spark.createDataFrame([(1, 5.0), (2, None), (3, 7.0)], "k int, v double")
    patch = spark.createDataFrame([(1, 9.0), (2, 9.0)], "k int, v double")
    rows = lambda df: {r["k"]: r["v"] for r in df.collect()}
    assert rows(tb.upsert(target, patch, ["k"], ["v"])) == {1: 9.0, 2: 9.0, 3: 7.0}
    assert rows(tb.upsert(target, patch, ["k"], ["v"], only_null=True)) == {1: 5.0, 2: 9.0, 3: 7.0}


def test_partition_rewrite_leaves_other_partitions_alone(spark, tmp_path):
    live = str(tmp_path / "live")
    tb.write_table(spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, p string, v double"), live, partition_by=["p"])
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "live" / "p=b").glob("*.parquet")}
    tb.upsert_partitions(spark, live, spark.createDataFrame([(1, "a", 9.0)], "k int, p string, v double"), ["k"], ["v"], "p")
    assert {(r["k"], r["v"]) for r in spark.read.parquet(live).collect()} == {(1, 9.0), (2, 2.0)}
    assert {f.name: f.stat().st_mtime_ns for f in (tmp_path / "live" / "p=b").glob("*.parquet")} == before


def test_content_hash_ignores_row_order(spark):
    df = spark.range(50).select("id", F.lit("2024-01-01").alias("d"))
    a, b = tb.content_audit(df, "d").first(), tb.content_audit(df.orderBy(F.desc("id")), "d").first()
    assert a == b and tb.content_audit(df.where("id > 0"), "d").first()["content_hash"] != a["content_hash"]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, k int")
    assert tb.nan_to_null(df).where("x is null").count() == 1


def test_checkpoint_cuts_lineage(spark):
    df = checkpointed(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.count() == 10 and "Scan ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()


LOG = "id long, at timestamp, start timestamp, k string, line double"


def land(spark, folder, rows):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(folder)


def t(h, m=0):
    return dt.datetime(2024, 1, 1, h, m)


def lines_log(path, fan=8):
    return lg.KeyedLog(path, "day", sn.fold_lines(["day", "k"]), fan)


def test_lines_follow_a_moved_start_and_late_rows(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), spark.createDataFrame([], LOG).schema
    parts = sn.line_parts(["day", "k"], "at", "id", "start", "line")
    log = lines_log(str(tmp_path / "lines"))
    kinds = parts(spark.createDataFrame([], LOG).withColumn("day", F.to_date("start"))).schema

    def go(rows):
        land(spark, folder, rows)
        sn.run_to_end(sn.landing_stream(spark, folder, schema).withColumn("day", F.to_date("start")), str(tmp_path / "work"), log.sink(parts))
        return {r["k"]: (r["current_line"], r["closing_line"], r["n_snapshots"]) for r in sn.line_columns(log.read(spark, kinds), ["day", "k"]).collect()}

    assert go([(1, t(9), t(12), "a", 24.5), (2, t(11), t(12), "a", 25.5)]) == {"a": (25.5, 25.5, 2)}
    assert go([(3, t(13), t(14), "a", 26.5), (4, t(15), t(14), "a", 27.5)]) == {"a": (27.5, 26.5, 4)}
    assert go([(5, t(8), t(14), "a", 20.5), (6, t(8), t(14), "b", 21.5)]) == {"a": (27.5, 26.5, 5), "b": (21.5, 21.5, 1)}


def test_repeats_are_dropped_and_the_firewall_splits(spark, tmp_path):
    folder, work = str(tmp_path / "in"), str(tmp_path / "work")
    schema = spark.createDataFrame([], LOG).schema
    land(spark, folder, [(1, t(9), t(12), "a", 24.5), (2, t(13), t(12), "a", 25.0)])
    sn.run_to_end(sn.landing_stream(spark, folder, schema), work, sn.firewall(work, "at", "start"))
    assert [r["id"] for r in spark.read.parquet(f"{work}/pregame").collect()] == [1]
    assert [r["id"] for r in spark.read.parquet(f"{work}/late").collect()] == [2]


KV = "p int, k string, id long, x double, y double"


def by_hand(batches, fold):
    out = {}
    for rows in batches:
        for r in sorted(rows, key=lambda r: r[2]):
            key = r[:2]
            if fold == "first":
                out.setdefault(key, r)
            else:
                old = out.get(key, key + (None,) * 3)
                out[key] = tuple(o if n is None else n for n, o in zip(r, old))
    return out


@pytest.mark.parametrize("kind", ["first", "last"])
def test_keyed_log_over_many_batches(spark, tmp_path, kind):
    rng = np.random.default_rng(4)
    fold = lg.keep_first(["p", "k"], ["id"]) if kind == "first" else lg.keep_last(["p", "k"], ["id"])
    log, schema = lg.KeyedLog(str(tmp_path / "log"), "p", fold, fan=2), spark.createDataFrame([], KV).schema
    batches, written = [], []
    for b in range(6):
        rows = [(int(rng.integers(0, 3)), str(rng.integers(0, 4)), b * 100 + i, None if rng.random() < 0.4 else float(i), float(b)) for i in range(6)] if b != 3 else []
        batches.append(rows)
        frame = spark.createDataFrame(rows, KV)
        log.append(frame, b)
        if b in (1, 4):
            log.append(frame, b)  # a replay
        assert {tuple(r)[:2]: tuple(r) for r in log.read(spark, schema).collect()} == by_hand(batches, kind)
        parts = log.manifest(spark)
        assert all(sum(x[0] == p and x[2] == g for x in parts) < 2 for p, _, g in parts)  # generations are merged
        written.append(len(parts))
    assert max(written) <= 3 * 3
    some = log.read(spark, schema, [1])
    assert {tuple(r)[:2] for r in some.collect()} == {k for k in by_hand(batches, kind) if k[0] == 1}
    # a batch before is still readable, and what it replaced is not lost
    assert log.manifest(spark, 0)


def test_a_batch_touches_its_own_partitions_only(spark, tmp_path):
    log = lg.KeyedLog(str(tmp_path / "log"), "p", lg.keep_last(["p", "k"], ["id"]), fan=2)
    for b, p in enumerate((1, 2, 1, 2, 1)):
        log.append(spark.createDataFrame([(p, "a", b, float(b), None)], KV), b)
        folders = {f.name for f in (tmp_path / "log" / "data" / f"version={b:012d}").glob("generation=*/p=*")}
        assert folders == {f"p={p}"}
    assert {r["p"]: r["id"] for r in log.read(spark, spark.createDataFrame([], KV).schema).collect()} == {1: 4, 2: 3}


def test_queries_of_the_log_see_late_rows(spark, data, monkeypatch):
    from formbook.plans import streams

    batches = []
    run = sn.run_to_end

    def counted(stream, work, sink, mode="append"):
        run(stream, work, lambda batch, n: (batches.append((work, n)), sink(batch, n))[1], mode)

    monkeypatch.setattr(sn, "run_to_end", counted)
    n = spark.read.parquet(f"{data}/events.parquet").count()
    assert streams.t1(spark, data).count() == n
    assert streams.t3(spark, data).agg(F.sum("n_snapshots")).first()[0] == n
    assert len(set(batches)) == 6


def test_late_closing_lines_and_corrected_results(spark, tmp_path):
    from formbook.plans import streams

    legs = spark.createDataFrame([(1, 1, 0, 7, "OVER", 20), (1, 2, 0, 8, "UNDER", 20), (2, 1, 0, 9, "OVER", 20)], "ticket_id long, l_linenumber int, l_suppkey long, entity_id long, side string, line long")
    job = sn.Resettlement(str(tmp_path), legs, ["entity_id"], streams.LEG_ID, ["ticket_id"], streams.LEG_FACTS, streams.graded_columns)
    facts = [
        [(7, 25, None)], [(8, 10, None), (7, None, 22), (50, 1, 1)], [(7, 15, None), (8, None, 21)], [], [(9, None, 18)],
    ]
    seen = []
    for n, rows in enumerate(facts):
        frame = spark.createDataFrame(rows, streams.LEG_FACTS)
        job.write(frame, n)
        if n == 2:
            job.write(frame, n)  # a replay
        tickets = job.read(spark, "tickets", spark.createDataFrame([], "ticket_id long, n_legs long, status string").schema)
        held = job.read(spark, "legs", spark.createDataFrame([], "entity_id long, result string, closing long, clv long, ticket_id long, l_linenumber int, l_suppkey long").schema)
        seen.append(({r["ticket_id"]: r["status"] for r in tickets.collect()}, {r["entity_id"]: (r["result"], r["closing"], r["clv"]) for r in held.collect()}))
    assert seen[0] == ({1: "open"}, {7: ("WIN", None, None), 8: (None, None, None)})
    assert seen[1] == ({1: "won"}, {7: ("WIN", 22, 2), 8: ("WIN", None, None)})
    assert seen[2] == ({1: "lost"}, {7: ("LOSS", 22, 2), 8: ("WIN", 21, -1)})  # corrected, and back-filled
    assert seen[3] == seen[2]
    assert seen[4] == ({1: "lost", 2: "open"}, {**seen[2][1], 9: (None, 18, -2)})


def test_time_stamps_are_read_once_per_envelope(spark):
    doc = """{"timestamp": "%s", "data": {"id": "e", "bookmakers": [{"key": "b", "markets": [{"key": "m", "outcomes": [{"name": "Over", "price": 1.5}, {"name": "Under", "price": 2.5}]}]}]}}"""
    texts = spark.createDataFrame([(1, doc % "2024-01-01T22:30:00Z"), (2, doc % "2024-13-01"), (3, "{}"), (4, None), (5, "no document")], "k long, doc string")
    q = dc.flatten_quotes(dc.parse_json(texts, "doc", dc.ODDS_ENVELOPE, ["k"]), ["m"], ["k"])
    rows = q.select("k", "side", F.unix_micros("resolved_ts").alias("us")).orderBy("k", "side")
    assert [tuple(r) for r in rows.collect()] == [(1, "Over", 1704148200000000), (1, "Under", 1704148200000000), (2, "Over", None), (2, "Under", None)]
    plan = q.select("side", "resolved_ts")._jdf.queryExecution().optimizedPlan().toString()
    # in the plan's text, what runs earlier stands further down
    assert plan.index("RLIKE") > plan.index("explode")


def test_partitions_of_a_batch_are_listed_without_reading_its_files(spark, tmp_path):
    log = lg.KeyedLog(str(tmp_path), "p", lg.newest_row(["p", "id"]))
    rows = spark.createDataFrame([("a b", 1, 1), ("x=y/z", 2, 1), (None, 3, 1)], "p string, id long, v long")
    assert log._write(rows, 0, 0) == ["p=__HIVE_DEFAULT_PARTITION__", "p=a%20b", "p=x%253Dy%252Fz"]
    assert log._write(rows.where("id > 3"), 1, 0) == []
    sc = spark.sparkContext
    sc.setJobGroup("list-parts", "")
    try:
        log._write(rows, 2, 0)
        assert len(sc.statusTracker().getJobIdsForGroup("list-parts")) == 1  # the write
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
