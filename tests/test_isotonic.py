"""Isotonic steps against the max-min formula, whatever the stretches are."""

import random

import numpy as np
import pytest

from formbook.operators import isotonic as iso
from formbook.operators.skew import SplitRule


def brute(levels):
    """Value at each level: the largest over starts of the least mean over ends."""
    low, _, weight, total = np.array(levels).T
    w, s = np.concatenate(([0], np.cumsum(weight))), np.concatenate(([0], np.cumsum(total)))
    n = len(low)
    return [max(min((s[k + 1] - s[j]) / (w[k + 1] - w[j]) for k in range(i, n)) for j in range(i + 1)) for i in range(n)]


def spread(steps, levels):
    return [next(t / w for low, high, w, t in steps if low <= row[0] <= high) for row in levels]


@pytest.mark.parametrize("seed", range(12))
def test_pools_and_their_merges_match_the_formula(seed):
    rng = random.Random(seed)
    levels = [[float(i), float(i), float(rng.randrange(1, 4)), 0.0] for i in range(rng.randrange(1, 40))]
    for row in levels:
        row[3] = float(rng.randrange(0, int(row[2]) + 1))
    want = brute(levels)
    whole = iso.pool(np.array(levels))
    assert spread(whole.tolist(), levels) == pytest.approx(want)
    cut = rng.randrange(0, len(levels) + 1)
    empty = np.empty((0, 4))
    halves = [iso.pool(np.array(part)) if part else empty for part in (levels[:cut], levels[cut:])]
    assert np.array_equal(iso.merge(*halves), whole)
    assert np.array_equal(iso._stacked(np.array(levels)), whole)


def test_slow_fall_back_is_pooled_to_the_end():
    levels = np.array([[float(i), float(i), 1.0, float(i)] for i in range(300)] + [[300.0, 300.0, 1.0, -1e6]])
    assert len(iso.pool(levels)) == 1


@pytest.mark.parametrize("fan", [2, 8])
def test_steps_over_many_tasks_match_the_formula(spark, fan):
    rng = random.Random(5)
    rows = [(round(rng.random(), 2), float(rng.random() < 0.4), rng.choice([0.5, 1.0, 2.0])) for _ in range(800)]
    rows += [(0.5, 1.0, 1.0)] * 400 + [(None, 1.0, 1.0), (0.3, None, 1.0), (float("nan"), 0.0, 1.0), (0.2, 1.0, 0.0), (0.2, 1.0, None)]
    df = spark.createDataFrame(rows, "p double, y double, w double")
    levels = {}
    for p, y, w in rows[:1200]:
        row = levels.setdefault(p, [p, p, 0.0, 0.0])
        row[2] += w
        row[3] += w * y
    levels = [levels[p] for p in sorted(levels)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        steps = iso.isotonic_steps(df, "p", "y", "w", fan).orderBy("low").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    got = [(r["low"], r["high"], r["weight"], r["value"] * r["weight"]) for r in steps]
    assert spread(got, levels) == pytest.approx(brute(levels))
    assert steps[0]["start"] == float("-inf") and steps[-1]["next_low"] is None and steps[-1]["next_value"] is None
    assert [r["next_low"] for r in steps[:-1]] == [r["low"] for r in steps[1:]]


def test_scores_take_steps_lines_between_them_and_ends(spark, hot):
    df = spark.createDataFrame([(0.1, 0.0), (0.2, 1.0), (0.3, 0.0), (0.4, 1.0)], "p double, y double")
    steps = iso.isotonic_steps(df, "p", "y")
    asks = [0.0, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.9, None, float("nan")]
    want = [0.0, 0.0, 0.25, 0.5, 0.5, 0.5, 0.75, 1.0, 1.0, None, None]
    # a clashing column name of the caller stays
    rows = spark.createDataFrame([(i, p, "x") for i, p in enumerate(asks * 20)], "id int, p double, value string")
    for rule in (iso.DEFAULT_RULE, hot):
        got = {r["id"]: r for r in iso.apply_steps(rows, steps, "p", "cal", ["id"], rule).collect()}
        assert len(got) == 220 and {r["value"] for r in got.values()} == {"x"}
        for i in got:
            expected = want[i % len(want)]
            assert got[i]["cal"] is None if expected is None else got[i]["cal"] == pytest.approx(expected)


def test_empty_fit_gives_no_steps_and_no_values(spark):
    df = spark.createDataFrame([], "p double, y double")
    steps = iso.isotonic_steps(df, "p", "y")
    assert steps.count() == 0
    row = iso.apply_steps(spark.createDataFrame([(1, 0.4)], "id int, p double"), steps, "p", "cal", ["id"]).first()
    assert row["cal"] is None


def test_rows_in_blocks_get_the_values_of_rows_in_one(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice([None, float("nan"), rng.randrange(40) / 40]), float(rng.random() < 0.5)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, s double, y double")
    steps = iso.isotonic_steps(df, "s", "y")
    found = [
        {r["id"]: r["cal"] for r in iso.apply_steps(df, steps, "s", "cal", ["id"], rule=rule).collect()}
        for rule in (SplitRule(hot_rows=40, block_rows=50, check_bytes=0), SplitRule())
    ]
    assert found[0] == found[1] and len(found[0]) == 600
    # the default cuts far below what a task can hold
    assert iso.BLOCKS.block_rows <= 500_000 and iso.BLOCKS.check_bytes < SplitRule().check_bytes
