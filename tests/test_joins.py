"""Entity resolution, tolerant and interval joins on hand-written frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from formbook.operators import joins as jn
from formbook.operators.quality import GateFailed
from formbook.operators.skew import SplitRule

D = dt.date


def test_enrich_keeps_rows_and_refuses_collisions(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    right = spark.createDataFrame([(1, 10)], "k int, w int")
    out = jn.enrich(left, right, ["k"], "r_", check=True)
    assert out.count() == 4 and out.agg(F.sum("matched")).first()[0] == 2
    with pytest.raises(GateFailed):
        jn.enrich(left, right.withColumnRenamed("w", "v"), ["k"])
    with pytest.raises(GateFailed):
        jn.enrich(left, right.union(right), ["k"], check=True)


def test_opponent_row_needs_exactly_two(spark):
    df = spark.createDataFrame([(1, "h", 3), (1, "a", 5), (2, "h", 1), (3, "h", None), (3, "a", 4)], "game int, side string, v int")
    got = {(r["game"], r["side"]): r["opp_v"] for r in jn.opponent_row(df, ["game"], ["v"]).collect()}
    assert got == {(1, "h"): 5, (1, "a"): 3, (2, "h"): None, (3, "h"): 4, (3, "a"): None}


def test_tolerant_join_prefers_same_day_then_day_before(spark):
    left = spark.createDataFrame([(1, "x", D(2024, 1, 10)), (2, "y", D(2024, 1, 10)), (3, "z", D(2024, 1, 10))], "id int, e string, d date")
    right = spark.createDataFrame(
        [("x", D(2024, 1, 10), 1), ("x", D(2024, 1, 9), 2), ("y", D(2024, 1, 11), 3), ("y", D(2024, 1, 9), 4), ("z", D(2024, 1, 13), 5)], "e string, d date, v int"
    )
    got = {r["id"]: (r["day_offset"], r["matched_v"]) for r in jn.tolerant_date_join(left, right, ["e"], "d", ["v"], ["id"]).collect()}
    assert got == {1: (0, 1), 2: (-1, 4), 3: (None, None)}


def _match(spark, asks, roster):
    a = spark.createDataFrame(asks, "id int, day date, home string, away string, name string")
    r = spark.createDataFrame(roster, "day date, team string, versus string, pid int, pname string")
    out = jn.match_entities(a, r, ["id"], "day", "home", "away", "name", "team", "versus", "pname", "pid")
    return {x["id"]: (x["match_status"], x["matched_id"]) for x in out.collect()}


def test_entity_resolution_order_and_reasons(spark):
    day = D(2024, 1, 10)
    roster = [
        (day, "BOS", "NYR", 1, "L. Söderblom"), (day, "NYR", "BOS", 2, "I. Smith"), (D(2024, 1, 9), "MTL", "TOR", 3, "J. Roy"), (day, "VAN", "CGY", 4, "T. Demko"),
    ]
    asks = [
        (1, day, "BOS", "NYR", "Linus Soderblom"),  # home team, accent-free last name
        (2, day, "BOS", "NYR", "Igor Smith"),  # away team
        (3, day, "MTL", "TOR", "Jean Roy"),  # the day before
        (4, day, "BOS", "NYR", "Somebody Else"),
        (5, day, "VAN", "SEA", "T. Demko"),  # wrong opponent
        (6, day, "DAL", "STL", "Nobody"),
    ]
    assert _match(spark, asks, roster) == {
        1: ("matched", 1), 2: ("matched", 2), 3: ("matched", 3), 4: ("name_mismatch", None), 5: ("opponent_mismatch", None), 6: ("no_game", None),
    }


def test_name_attribution_statuses(spark):
    roster = spark.createDataFrame([(1, "Jon Doe", "A"), (1, "Jim Doe", "B"), (1, "Al Roe", "C")], "s int, pname string, team string")
    asks = spark.createDataFrame([(1, "Jon Doe"), (1, "J. Doe"), (1, "A. Roe"), (1, "Zed")], "s int, name string")
    got = {r["name"]: (r["attribution"], r["attributed_team"]) for r in jn.attribute_names(asks, roster, ["s"], "name", "pname", "team").collect()}
    assert got == {"Jon Doe": ("resolved", "A"), "J. Doe": ("ambiguous", None), "A. Roe": ("resolved", "C"), "Zed": ("unresolved", None)}


def test_closing_snapshot_cases(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [
        ("a", 1, t(10), None, 1.0), ("a", 2, t(11), t(12), 2.0), ("a", 3, t(13), t(12), 3.0),  # last before the first recorded start
        ("b", 4, t(10), None, 4.0), ("b", 5, t(11), None, 5.0),  # no start: last of all
        ("c", 6, t(14), t(12), 6.0), ("c", 7, t(15), t(12), 7.0),  # all after the start: last of all
    ]
    df = spark.createDataFrame(rows, "k string, id int, at timestamp, start timestamp, line double")
    got = {r["k"]: (r["closing_id"], r["had_pregame"]) for r in jn.closing_snapshot(df, ["k"], "at", "id", "start", ["line"]).collect()}
    assert got == {"a": (2, 1), "b": (5, 0), "c": (7, 0)}


@pytest.mark.parametrize("rule", [SplitRule(), SplitRule(hot_rows=2, block_rows=2, check_bytes=0)])
def test_interval_coverage_edges(spark, rule):
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    manifest = spark.createDataFrame(
        [("k", t(1), t(9), t(1)), ("k", t(3), t(4), t(3)), ("o", t(5), None, t(5)), ("x", None, None, t(7))],
        "scope string, resolved timestamp, nxt timestamp, requested timestamp",
    )
    asks = [(1, "k", t(1)), (2, "k", t(8)), (3, "k", t(9)), (4, "k", t(0)), (5, "o", t(23)), (6, "o", t(4)), (7, "x", t(7)), (8, "x", t(8)), (9, "none", t(1))]
    requests = spark.createDataFrame(asks, "id int, scope string, requested timestamp").withColumn("requested", F.col("requested").cast("timestamp_ntz"))
    manifest = manifest.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("resolved", "nxt", "requested")})
    out = jn.covered_requests(requests, manifest, ["scope"], "requested", "resolved", "nxt", "requested", ["id"], rule)
    # 2 lies in the long interval although a newer, shorter one has ended; 7 is an exact repeat
    assert {r["id"] for r in out.where("is_covered = 1").collect()} == {1, 2, 5, 7}


def test_replacement_candidates_against_brute_force(spark):
    import random

    rng = random.Random(2)
    asks = [(i, rng.randrange(3), D(2024, 1, 1) + dt.timedelta(days=rng.randrange(200))) for i in range(80)]
    events = [(rng.randrange(3), D(2024, 1, 1) + dt.timedelta(days=rng.randrange(200))) for _ in range(60)]
    out = jn.replacement_candidates(
        spark.createDataFrame(asks, "id int, p int, d date"), spark.createDataFrame(events, "p int, d date"), ["p"], "d", "id", 30
    )
    got = {r["id"]: (r["n_candidates"], r["nearest_gap_days"]) for r in out.collect()}
    for i, p, d in asks:
        gaps = [abs((e - d).days) for q, e in events if q == p and abs((e - d).days) <= 30]
        assert got[i] == (len(gaps), min(gaps, default=None))


def test_supplement_takes_only_later_rows(spark):
    a = spark.createDataFrame([(D(2024, 1, 1), 1), (D(2024, 1, 5), 2)], "d date, v int")
    b = spark.createDataFrame([(D(2024, 1, 5), 3), (D(2024, 1, 6), 4)], "d date, v int")
    assert sorted(r["v"] for r in jn.supplement(a, b, "d").collect()) == [1, 2, 4]


def test_choose_join_key_takes_first_unique(spark):
    left = spark.createDataFrame([(1, 2)], "a int, b int")
    right = spark.createDataFrame([(1, 2, 5), (1, 3, 6)], "a int, b int, v int")
    assert jn.choose_join_key(left, right, [["a"], ["a", "b"]]) == ["a", "b"]


def test_map_events_flags_ambiguity(spark):
    games = spark.createDataFrame([(1, D(2024, 1, 1), "A", "B"), (2, D(2024, 1, 1), "C", "D"), (3, D(2024, 1, 1), "D", "C")], "gid int, d date, h string, a string")
    events = spark.createDataFrame([(10, D(2024, 1, 1), "B", "A"), (11, D(2024, 1, 1), "C", "D"), (12, D(2024, 1, 2), "A", "B")], "eid int, d date, h string, a string")
    got = {r["eid"]: (r["map_status"], r["game_id_matched"]) for r in jn.map_events_to_games(events, games, "d", "h", "a", "gid", "eid").collect()}
    assert got == {10: ("matched", 1), 11: ("ambiguous", None), 12: ("unmatched", None)}


def test_enrich_stops_on_a_repeated_right_key(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    right = spark.createDataFrame([(1, 10), (None, 20), (None, 30)], "k int, w int")
    rows = {r["v"]: (r["w"], r["matched"]) for r in jn.enrich(left, right, ["k"]).collect()}
    assert rows == {"a": (10, 1), "b": (None, 0), "c": (None, 0)}
    again = right.union(spark.createDataFrame([(1, 11)], "k int, w int"))
    with pytest.raises(Exception, match="repeated key"):
        jn.enrich(left, again, ["k"]).collect()
    # a plan that uses nothing of the right side may drop the join; rows are never multiplied
    assert jn.enrich(left, again, ["k"]).select("v").count() == 3


def test_tolerant_date_ties_do_not_depend_on_input_order(spark):
    left = spark.createDataFrame([(1, "a", "2024-01-02")], "id int, who string, day string")
    rows = [("a", "2024-01-02", 2.0), ("a", "2024-01-02", 1.0), ("a", "2024-01-03", 0.5)]
    got = set()
    for some in (rows, rows[::-1]):
        right = spark.createDataFrame(some, "who string, day string, x double").coalesce(1)
        got |= {(r["day_offset"], r["matched_x"]) for r in jn.tolerant_date_join(left, right, ["who"], "day", ["x"], ["id"]).collect()}
    assert got == {(0, 1.0)}
