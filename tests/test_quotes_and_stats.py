"""Quote algebra, scores, bootstraps and policies on small frames."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from formbook.operators import backtest as bt
from formbook.operators import bootstrap as bs
from formbook.operators import grading as gr
from formbook.operators import quality as ql
from formbook.operators import quotes as qt
from formbook.operators import stats as st

QUOTE = "e int, b string, l double, side string, price double, pos int"


def test_pairing_policies(spark):
    rows = [
        (1, "x", 25.5, "Over", 1.9, 1), (1, "x", 25.5, "Under", 1.9, 2), (1, "x", 25.5, "Over", 2.0, 3),  # conflicting repeat
        (2, "x", 25.5, "Over", 1.8, 4),  # one-sided
        (3, "x", 25.5, "Over", 1.8, 5), (3, "x", 25.5, "Over", 1.8, 6), (3, "x", 25.5, "Under", 2.0, 7),  # exact repeat
    ]
    df = spark.createDataFrame(rows, QUOTE)
    args = (["e", "b", "l"], "side", "price", ["pos"])
    first = {r["e"]: (r["pair_status"], r["price_over"]) for r in qt.pair_sides(df, *args).collect()}
    strict = {r["e"]: r["pair_status"] for r in qt.pair_sides(df, *args, policy="strict").collect()}
    assert first == {1: ("paired", 1.9), 2: ("one_sided", 1.8), 3: ("paired", 1.8)}
    assert strict == {1: "conflict", 2: "one_sided", 3: "paired"}
    pairs = qt.paired(df, *args)
    assert pairs.where("e = 3").first()["p_over"] == pytest.approx((1 / 1.8) / (1 / 1.8 + 1 / 2.0))


def test_modal_line_ties_take_the_lowest(spark):
    df = spark.createDataFrame([(1, 25.5), (1, 24.5), (1, 25.5), (1, 24.5), (1, 30.5)], "e int, l double")
    assert qt.modal_line(df, ["e"], "l").first()["modal_line"] == 24.5
    assert {r["l"] for r in qt.all_modal_lines(df, ["e"], "l").collect()} == {24.5, 25.5}


def test_devig_group_needs_exactly_two_prices(spark):
    df = spark.createDataFrame([(1, 1.9), (1, 1.9), (2, 1.9), (3, 1.9), (3, 2.0), (3, 2.1), (4, 1.9), (4, None)], "g int, p double")
    got = {r["g"]: r["p_devig"] for r in qt.devig_group(df, ["g"], "p").collect()}
    assert got[1] == 0.5 and got[2] is None and got[3] is None and got[4] is None


def test_funnel_partitions_the_rows(spark):
    df = spark.range(100)
    steps = [("small", F.col("id") < 10), ("even", F.col("id") % 2 == 0), ("unknown", F.lit(None).cast("boolean"))]
    got = {r["bucket"]: r["n_rows"] for r in st.funnel(df, steps).collect()}
    assert got == {"small": 10, "even": 45, "kept": 45}


def test_auc_ties_count_half(spark):
    df = spark.createDataFrame([(0.2, 0), (0.5, 1), (0.5, 0), (0.9, 1)], "s double, y int")
    assert st.roc_auc(df, [], "s", "y").first()["auc"] == pytest.approx((1 + 0.5 + 1 + 1) / 4)


def test_reliability_bins_hold_every_row(spark):
    df = spark.createDataFrame([(0.1 if i % 3 else i / 100, i % 2) for i in range(99)], "p double, y int")
    rows = st.reliability_quantile(df, "p", "y").collect()
    assert sum(r["n"] for r in rows) == 99 and len(rows) < 10


def test_settlement(spark):
    legs = [(1, "WIN"), (1, "LOSS"), (2, "WIN"), (2, "WIN"), (3, "PUSH"), (4, "WIN"), (4, "PUSH"), (5, "LOSS"), (5, None)]
    got = {r["t"]: r["status"] for r in gr.settle_tickets(spark.createDataFrame(legs, "t int, r string"), ["t"], "r").collect()}
    assert got == {1: "lost", 2: "won", 3: "push", 4: "partial", 5: "open"}


def test_empty_ledger_summary_is_zero(spark):
    df = spark.createDataFrame([], "result string, profit double, stake double")
    row = gr.bet_summary(df).first()
    assert (row["bets"], row["win_rate"], row["roi"], row["units"]) == (0, 0.0, 0.0, 0.0)


@pytest.fixture(scope="module")
def ledger(spark):
    rng = random.Random(4)
    rows = [(i % 40, rng.choice(["a", "b"]), rng.gauss(0.1, 1.0), 1.0) for i in range(800)]
    return spark.createDataFrame(rows, "g int, arm string, profit double, stake double")


def test_bootstrap_is_reproducible_and_order_free(ledger):
    a = bs.cluster_bootstrap(ledger, ["g"], F.col("profit"), F.col("stake"), 100).first()
    b = bs.cluster_bootstrap(ledger.orderBy(F.rand(9)), ["g"], F.col("profit"), F.col("stake"), 100).first()
    assert a["lower"] == pytest.approx(b["lower"]) and a["upper"] == pytest.approx(b["upper"])
    assert a["lower"] < a["estimate"] < a["upper"]


def test_bootstrap_width_is_close_to_theory(ledger):
    import numpy as np

    per = [r[0] for r in ledger.groupBy("g").agg(F.avg("profit")).select("avg(profit)").collect()]
    se = np.std(per, ddof=1) / np.sqrt(len(per))
    row = bs.cluster_bootstrap(ledger, ["g"], F.col("profit"), F.col("stake"), 400).first()
    assert (row["upper"] - row["lower"]) == pytest.approx(2 * 1.96 * se, rel=0.25)


def test_weights_have_poisson_moments(spark):
    a, c = bs.hash_parts("s", F.col("id"))
    w = bs.poisson_weight(bs.draw(a, c, F.lit(7)))
    row = spark.range(20000).select(w.alias("w")).agg(F.avg("w"), F.var_samp("w")).first()
    assert row[0] == pytest.approx(1.0, abs=0.03) and row[1] == pytest.approx(1.0, abs=0.05)


def test_empty_arm_is_counted(ledger):
    row = bs.paired_arms(ledger, ["g"], F.col("profit"), F.col("arm") == "none", F.lit(True), F.col("stake"), 20).first()
    assert row["n_degenerate"] == 20 and row["lower"] is None


def test_twenty_policies(spark):
    grid = bt.policy_grid()
    assert len(grid) == 20 and len({p.name for p in grid}) == 20 and sum(p.line_shop for p in grid) == 3


def test_policy_tie_goes_over_and_bad_prices_never_bet(spark):
    rows = [(1, 0.5, 0.5, 110, 110, 25.5, 30.0), (2, 0.5, 0.5, 50, 110, 25.5, 30.0)]
    df = spark.createDataFrame(rows, "id int, p_over double, p_under double, odds_over int, odds_under int, line double, actual double")
    out = bt.apply_policies(df, [bt.Policy("any", "true_ev", 0.0)], ["id"], ["id"])
    assert [(r["id"], r["bet"]) for r in out.collect()] == [(1, "OVER")]
    graded = bt.grade_choices(out).first()
    assert graded["bet_result"] == "WIN" and graded["bet_profit"] == pytest.approx(1.1)


def test_threshold_band_falls_back(spark):
    sweep = spark.createDataFrame([(0.0, 10, 90.0, 5.0), (0.1, 4, 38.0, 1.0), (0.2, 3, 20.0, -2.0)], "threshold double, bets long, bet_rate double, roi double")
    assert bt.best_threshold(sweep).first()["threshold"] == 0.2
    assert bt.best_threshold(sweep.where("threshold < 0.2")).first()["threshold"] == 0.1
    assert bt.best_threshold(sweep.where("threshold = 0")).first()["band"] == 0


def test_overlapping_split_is_refused(spark):
    with pytest.raises(ql.GateFailed):
        bt.date_split(spark.range(1), "id", [("a", "2024-01-01", "2024-06-01"), ("b", "2024-06-01", "2024-07-01")])


def test_fraction_split_is_disjoint_and_ordered(spark, hot):
    df = spark.range(100).select("id", F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    cuts = [("train", 0.6), ("val", 0.8), ("test", 1.0)]
    for out in (bt.fraction_split(df, "d", cuts), bt.fraction_split_rows(df, ["d"], cuts, hot)):
        got = {r["split"]: (r["n"], r["lo"]) for r in out.groupBy("split").agg(F.count("id").alias("n"), F.min("id").alias("lo")).collect()}
        assert got == {"train": (60, 0), "val": (20, 60), "test": (20, 80)}


def test_empirical_shares_against_brute_force(spark, hot):
    rng = random.Random(8)
    resid = [float(rng.randrange(-5, 6)) for _ in range(70)]
    asks = [(i, float(rng.randrange(20, 30)), 25.0) for i in range(30)]
    out = st.empirical_shares(
        spark.createDataFrame(asks, "id int, pred double, line double"), spark.createDataFrame([(r,) for r in resid], "r double"), "pred", "line", "r", ["id"], hot
    )
    got = {r["id"]: (r["p_over"], r["p_under"], r["p_push"]) for r in out.collect()}
    for i, pred, line in asks:
        totals = [pred + r for r in resid]
        want = tuple(sum(f(t) for t in totals) / len(totals) for f in (lambda t: t > line, lambda t: t < line, lambda t: t == line))
        assert got[i] == pytest.approx(want)


def test_gates(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0)], "k int, v double")
    with pytest.raises(ql.GateFailed):
        ql.require_unique(df, ["k"])
    with pytest.raises(ql.GateFailed):
        ql.require_no_leak(df, ["v"])
    with pytest.raises(ql.GateFailed):
        ql.require_columns(df, ["absent"])
    gap = ql.two_path_gap(df.where("k = 2"), df.where("k = 2").withColumn("v", F.col("v") + 1), ["k"], ["v"]).first()
    assert gap["gap_v"] == 1.0 and gap["only_first"] == 0


def test_resamples_in_tasks_match_column_weights(spark):
    rows = [(i % 3 if i % 3 else None, f"c{i % 41}" if i % 41 else None, float(i), None if i % 5 == 0 else float(i % 7)) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, c string, x double, y double").repartition(5)
    reps = bs.resample(df, ["g"], ["c"], {"sx": F.col("x"), "sy": F.col("y")}, 300, "seed").toPandas().set_index(["g", "resample"]).sort_index()
    a, c = bs.hash_parts("seed", F.concat_ws("_", F.col("c")))
    per = df.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(300)))).withColumn("w", F.when(F.col("b") == 0, 1).otherwise(bs.poisson_weight(bs.draw(a, c, F.col("b")))))
    want = per.groupBy("g", "b").agg(F.sum(F.col("w") * F.col("x")).alias("sx"), F.sum(F.col("w") * F.col("y")).alias("sy")).toPandas().set_index(["g", "b"]).sort_index()
    np.testing.assert_allclose(reps[["sx", "sy"]], want[["sx", "sy"]], rtol=1e-12)
    assert len(reps) == 3 * 301


def test_bootstrap_ships_vectors_not_clusters(spark):
    df = spark.range(20_000).select(F.col("id").alias("c"), (F.col("id") % 10).cast("double").alias("v"))
    reps = bs.resample(df, [], ["c"], {"s": F.col("v")}, 50, "x")
    plan = reps._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Generate" not in plan
    assert reps.count() == 51
    empty = bs.cluster_bootstrap(df.limit(0), ["c"], F.col("v"), F.lit(1.0), 20).first()
    assert empty["n_clusters"] == 0 and empty["estimate"] is None and empty["lower"] is None
