"""Models against closed forms and brute force on small frames."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from formbook.operators import models as md
from formbook.plans.learning import f2_embeddings


def test_poisson_offset_is_added_with_coefficient_one(spark):
    rng = random.Random(1)
    rows = [(float(i % 2), math.log(1 + i % 4), float(rng.randrange(0, 9))) for i in range(200)]
    df = spark.createDataFrame(rows, "x double, base double, y double")
    model = md.fit_poisson(df, ["x"], "y", "base")
    mu = {(r["x"], r["base"]): r["mu"] for r in model.transform(df).select("x", "base", "mu").distinct().collect()}
    # with one binary feature each level's rate is its own sum of counts over its sum of bases
    for level in (0.0, 1.0):
        rate = sum(y for x, _, y in rows if x == level) / sum(math.exp(b) for x, b, _ in rows if x == level)
        for (x, b), got in mu.items():
            if x == level:
                assert got == pytest.approx(rate * math.exp(b), rel=1e-3)


def test_platt_matches_newton_steps(spark):
    rng = random.Random(2)
    rows = [(p, float(rng.random() < 0.3 + 0.4 * p)) for p in (rng.uniform(0.05, 0.95) for _ in range(400))]
    df = spark.createDataFrame(rows, "p double, y double")
    got = md.apply_platt(df, md.fit_platt(df, "p", "y"), "p", "cal").select("p", "cal").collect()
    x = np.array([[1.0, math.log(p / (1 - p))] for p, _ in rows])
    y = np.array([v for _, v in rows])
    w = np.zeros(2)
    for _ in range(30):
        q = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x, x.T @ (y - q))
    for r in got[:50]:
        assert r["cal"] == pytest.approx(1 / (1 + math.exp(-(w[0] + w[1] * math.log(r["p"] / (1 - r["p"]))))), abs=1e-3)


def test_blend_matches_newton_steps_with_a_ridge(spark):
    rng = random.Random(4)
    rows = [(rng.uniform(0.1, 0.9), rng.uniform(0.3, 0.7)) for _ in range(300)]
    rows = [(a, b, float(rng.random() < 0.7 * a + 0.3 * b)) for a, b in rows]
    df = spark.createDataFrame([*rows, (None, 0.5, 1.0), (0.5, 0.5, None)], "a double, b double, y double")
    fitted = md.fit_blend(df, "a", "b", "y").stages[-1]
    x = np.array([[1.0, a, b] for a, b, _ in rows])
    y = np.array([v for *_, v in rows])
    w, ridge = np.zeros(3), np.diag([0.0, 1.0, 1.0])
    for _ in range(30):
        q = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge, x.T @ (y - q) - ridge @ w)
    assert [fitted.intercept, *fitted.coefficients] == pytest.approx(list(w), abs=2e-3)


def test_huber_line_shrugs_off_outliers(spark):
    rng = random.Random(3)
    rows = [(float(i), 3.0 + 2.0 * i + rng.gauss(0, 0.1) + (500.0 if i % 10 == 0 else 0.0)) for i in range(100)]
    df = spark.createDataFrame(rows, "x double, y double")
    scored = md.fit_huber(df, ["x"], "y").transform(df)
    for r in scored.select("x", "fitted").collect():
        assert r["fitted"] == pytest.approx(3.0 + 2.0 * r["x"], abs=1.5)


def test_classifier_learns_and_keeps_missing_rows(spark):
    df = spark.createDataFrame([(None if i % 7 == 0 else float(i % 10), float(i % 10 > 4)) for i in range(400)], "x double, y double")
    data, names = md.with_indicators(df, ["x"])
    assert names == ["x", "x_missing"]
    scored = md.probability(data, md.fit_classifier(data, names, "y", trees=3, depth=2), "p")
    assert scored.count() == 400 and scored.where("p is null").count() == 0
    row = scored.where("x is not null").agg(F.avg(F.when(F.col("y") == 1, F.col("p"))), F.avg(F.when(F.col("y") == 0, F.col("p")))).first()
    assert row[0] > 0.6 > 0.4 > row[1]


def test_winsorised_target_uses_exact_percentiles(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    row = md.sample_weights(df, "v", 0.05, 0.95, "w").agg(F.min("w"), F.max("w")).first()
    assert tuple(row) == (5.0, 95.0)


def test_random_configs_are_seeded():
    grid = {"depth": (2, 3, 4), "trees": (5, 10)}
    assert md.random_configs(grid, 5, 7) == md.random_configs(grid, 5, 7)


def test_random_configs_differ_and_come_from_the_grid():
    grid = {"depth": (2, 3, 4), "trees": (5, 10)}
    every = md.random_configs(grid, 99, 1)
    assert len(every) == 6 and len({tuple(c.items()) for c in every}) == 6
    assert all(c["depth"] in grid["depth"] and c["trees"] in grid["trees"] for c in every)


def search_frame(spark):
    rng = random.Random(8)
    rows = [(x, float(rng.random() < (0.85 if x > 0.5 else 0.15)), "train" if i % 3 else "val") for i, x in enumerate(rng.random() for _ in range(600))]
    rows += [(None, 1.0, "train"), (0.5, None, "train"), (0.9, 0.0, "test")]
    return md.with_indicators(spark.createDataFrame(rows, "x double, y double, split string"), ["x"])


def test_halving_keeps_the_better_configurations(spark):
    data, names = search_frame(spark)
    # a node that needs 10,000 rows never splits, so these two can't learn
    configs = [{"maxDepth": 2, "minInstancesPerNode": 10_000}, {"maxDepth": 2}, {"maxDepth": 3, "minInstancesPerNode": 10_000}, {"maxDepth": 1}]
    score = lambda val: val.agg((-F.avg((F.col("p_over") - F.col("y")) ** 2)).alias("rank"), F.count(F.lit(1)).alias("n"))
    found = md.successive_halving(data, names, "y", configs, [md.Rung(2, 0.5), md.Rung(4, 0.5)], score)
    first, second = ([r for r in found if r["rung"] == k] for k in (0, 1))
    assert [r["config"] for r in first] == [0, 1, 2, 3] and [r["kept"] for r in first] == [0, 1, 0, 1]
    assert [r["config"] for r in second] == [1, 3] and sum(r["kept"] for r in second) == 1
    assert {r["n"] for r in found} == {200} and all(1 <= r["grown"] <= r["trees"] for r in found)
    assert max(r["rank"] for r in second) > -0.2


def test_families_score_the_same_validation_rows(spark):
    data, names = search_frame(spark)
    scored = md.fit_families(data, names, "y", {"boosted": [{"maxDepth": 2}], "forest": [{"maxDepth": 2}], "logistic": [{"regParam": 0.01}]}, 3)
    got = scored.groupBy("family", "config").agg(F.count("p_over").alias("n"), F.avg((F.col("p_over") - F.col("y")) ** 2).alias("e")).collect()
    assert sorted(r["family"] for r in got) == ["boosted", "forest", "logistic"]
    assert {r["n"] for r in got} == {200} and all(r["e"] < 0.22 for r in got)


def test_models_score_in_a_session_that_observed_a_query(spark, tmp_path):
    seen = Observation()
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 5}
    data, names = search_frame(spark)
    scored = md.fit_families(data, names, "y", {"forest": [{"maxDepth": 2}], "logistic": [{"regParam": 0.01}]}, 2)
    assert scored.where("p_over is null").count() == 0
    rows = spark.createDataFrame([(0.1 + 0.8 * (i % 9) / 9, 0.5, float(i % 9 > 4)) for i in range(90)], "p double, market double, y double")
    assert md.apply_platt(rows, md.fit_platt(rows, "p", "y"), "p", "cal").where("cal is null").count() == 0
    assert md.probability(rows, md.fit_blend(rows, "p", "market", "y"), "blend").where("blend is null").count() == 0
    vectors = [(i, i // 2 % 2, [float(i // 2 % 2), 1.0, float(i % 5)]) for i in range(40)]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert f2_embeddings(spark, str(tmp_path)).where("p > 0.5").count() > 0


def test_rows_of_a_fit_are_dealt_over_bounded_tasks(spark, monkeypatch):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("v")).coalesce(1)
    assert md.dealt(df, df.columns, ["v"]).rdd.getNumPartitions() == 1
    monkeypatch.setattr(md, "ROWS", 100)
    out = md.dealt(df, df.columns, ["v"])
    sizes = out.groupBy(F.spark_partition_id()).count().collect()
    assert out.rdd.getNumPartitions() == 10 and max(r["count"] for r in sizes) < 200 and sum(r["count"] for r in sizes) == 1000
    assert out.rdd.glom().collect() == md.dealt(df, df.columns, ["v"]).rdd.glom().collect()
