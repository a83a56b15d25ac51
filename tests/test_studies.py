"""Studies composed from operators, against plain Python on the given tables; audits and version ties."""

import math
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from formbook.functions import distributions as ds
from formbook.operators import crossline as cl
from formbook.operators import windows as wn
from formbook.plans import load, studies
from formbook.sources import tables as tb

ALPHA = 0.03


def over_line(mean, line):
    """P(count > line) of a negative binomial."""
    mean *= 1 - 1e-6  # the thinning of the priced count is cut there
    r = 1 / ALPHA
    below = sum(math.exp(math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) + r * math.log(r / (r + mean)) + k * math.log(mean / (r + mean))) for k in range(int(math.floor(line)) + 1))
    return 1 - below


def mean_behind(line, prob):
    lo, hi = 1e-6, 400.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if over_line(mid / (1 - 1e-6), line) < prob else (lo, mid)
    return (lo + hi) / 2


def american(price):
    return round((price - 1) * 100) if price >= 2 else -round(100 / (price - 1))


def implied(odds):
    return -odds / (100 - odds) if odds < 0 else 100 / (odds + 100)


def test_cross_line_value_by_hand(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{data}/lineitem.parquet')")
    rows = con.execute(
        """SELECT l_partkey // 4 AS event, l_suppkey % 4 AS book, floor(l_quantity / 25) + 20.5 AS line, CASE WHEN l_returnflag = 'R' THEN 'closing' ELSE 'bettime' END AS pass, 1.5 + 10 * l_tax, 1.6 + 5 * l_discount FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY event, book, pass ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1"""
    ).fetchall()
    sizes = con.execute(f"SELECT p_partkey // 4, max(p_size) % 15 + 14 FROM read_parquet('{data}/part.parquet') GROUP BY 1").fetchall()
    actual = dict(sizes)
    fair = {r: (1 / r[4]) / (1 / r[4] + 1 / r[5]) for r in rows}
    early = [r for r in rows if r[3] == "bettime"]
    close = defaultdict(list)
    for r in rows:
        if r[3] == "closing":
            close[r[0], r[2]].append(fair[r])
    means = {r: mean_behind(r[2], round(fair[r], 9)) for r in early}
    events = defaultdict(list)
    for r in early:
        events[r[0]].append(r)
    want = defaultdict(lambda: [0, 0.0, 0, 0.0, 0, 0, 0.0])
    for r in early:
        peers = [means[x] for x in events[r[0]] if x is not r]
        if not peers:
            continue
        p = over_line(sum(peers) / len(peers), r[2])
        go, gu = p - implied(american(r[4])), 1 - p - implied(american(r[5]))
        side = "OVER" if go >= 0.03 and go > gu else "UNDER" if gu >= 0.03 else None
        if side is None:
            continue
        w = want[side]
        w[0] += 1
        w[1] += go if side == "OVER" else gu
        if close[r[0], r[2]]:
            move = sum(close[r[0], r[2]]) / len(close[r[0], r[2]]) - fair[r]
            move = move if side == "OVER" else -move
            w[2] += 1
            w[3] += move
            w[4] += move > 0
        if r[0] in actual:
            odds = american(r[4] if side == "OVER" else r[5])
            w[5] += 1
            w[6] += (100 / -odds if odds < 0 else odds / 100) if (side == "OVER") == (actual[r[0]] > r[2]) else -1
    got = {r["bet_side"]: r for r in load()[0]["b9_cross_line_value"](spark, data).collect()}
    assert set(got) == set(want) and sum(w[0] for w in want.values()) > 50
    for side, (n, gap, closing, clv, beat, graded, profit) in want.items():
        r = got[side]
        assert (r["n_flagged"], r["n_closing"], r["n_graded"]) == (n, closing, graded)
        assert (r["mean_gap"], r["mean_clv"], r["beat_rate"], r["profit"]) == pytest.approx((gap / n, clv / closing, beat / closing, profit), abs=1e-6)


def test_cross_line_needs_peers(spark):
    quotes = spark.createDataFrame([(1, 0, 20.5, 1.9, 1.9), (2, 0, 20.5, 1.9, 1.9), (2, 1, 23.5, 1.9, 1.9), (3, 0, 20.5, None, 1.9)], "event int, book int, line double, po double, pu double")
    rows = {(r["event"], r["book"]): r for r in cl.cross_line(quotes, ["event"], "line", "po", "pu", ALPHA).collect()}
    assert rows[1, 0]["peer_mean"] is None and rows[1, 0]["gap_over"] is None and rows[3, 0]["implied_mean"] is None
    assert rows[2, 0]["peer_over"] > 0.6 and rows[2, 1]["peer_over"] < 0.4  # the other book's line is higher, or lower
    assert [(r["event"], r["book"], r["bet_side"]) for r in cl.flag_bets(cl.cross_line(quotes, ["event"], "line", "po", "pu", ALPHA), 0.03).orderBy("event", "book").collect()] == [(2, 0, "OVER"), (2, 1, "UNDER")]


def test_means_far_above_the_line_are_found(spark):
    rows = spark.createDataFrame([(0.5, 0.9999, 1.5), (0.5, 0.99, 3.0), (20.5, 0.5, 0.03)], "line double, prob double, alpha double")
    out = rows.withColumn("m", ds.invert_count_mean("line", "prob", "alpha")).withColumn("back", ds.price_count_line(F.col("m") / (1 - 1e-6), F.col("alpha"), F.lit(1.0), F.col("line"))["p_over"])
    for r in out.collect():
        assert r["m"] is not None and r["back"] == pytest.approx(r["prob"], abs=1e-9)


def test_convergence_counts_every_quote(spark, data):
    r = studies.b10(spark, data).first()
    assert r["n_total"] == r["n_few_books"] + r["n_no_closing"] + r["n_line_changed"] + r["n_primary"]


def test_version_ties(spark):
    rows = [("a", None, 1), ("a", 5, None), ("a", 5, None), ("b", 1, 1), ("b", None, 9), ("c", None, 2), ("c", None, 2), ("c", None, 1)]
    df = spark.createDataFrame(rows, "k string, resolved int, requested int")
    assert tuple(wn.version_ties(df, ["k"], "resolved", "requested").first()) == (3, 8, 2)


def test_audit_sees_swaps_repeats_and_renames(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "", "~")], "id int, p string, q string").withColumn("d", F.lit("2024-01-01"))

    def hashes(df):
        r = tb.content_audit(df, "d").first()
        return r["content_hash"], r["schema_hash"]

    content, schema = hashes(base)
    assert hashes(base.orderBy(F.desc("id")).repartition(3)) == (content, schema)
    swapped = base.select("id", F.col("q").alias("p"), F.col("p").alias("q"), "d")
    assert hashes(swapped)[0] != content and hashes(swapped)[1] == schema
    assert hashes(base.unionByName(base.where("id = 1")))[0] != content
    renamed = base.withColumnRenamed("q", "r")
    assert hashes(renamed)[1] != schema
    assert hashes(base.withColumn("id", F.col("id").cast("long")))[1] != schema
    assert hashes(base.withColumn("q", F.when(F.col("id") == 2, "-").otherwise(F.col("q"))))[0] != content  # a null is no text


def test_altered_records_are_counted(spark, data):
    rows = load()[0]["q8_record_integrity"](spark, data).collect()
    events = spark.read.parquet(f"{data}/events.parquet")
    assert sum(r["bad_signature"] for r in rows) == events.where("event_id % 97 = 0").count() > 0
