"""Trees grown on counts against ``pyspark.ml``'s trees on the rows."""

import datetime
import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from formbook.operators import boosting as bo
from formbook.operators import models as md
from formbook.plans import learning, load

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def ready(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        a, b = float(rng.randrange(40)), float(rng.randrange(5))
        p = 1 / (1 + np.exp(-0.1 * (a - 20) - (b - 2) * (0.4 if a > 10 else -0.4)))
        rows.append((a, b, None if rng.random() < 0.02 else 1.0 * (i % 2), float(rng.random() < p), rng.choice([0.8, 1.0, 1.5]), i % 4 == 0))
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, w double, v boolean")
    stages = md._prepare(NAMES)
    filled = stages[0].fit(df).transform(df)
    return stages[1].transform(filled).repartition(3, "a").cache()


def estimator(**more):
    return GBTClassifier(featuresCol="__features", labelCol="y", weightCol="w", seed=1, **{"maxIter": 6, "maxDepth": 4, "stepSize": 0.1, **more})


def counted(ready, val=None):
    return bo.counted(ready, md.filled(NAMES), "y", "w", val)


def probabilities(model, ready):
    return np.array([r[0] for r in model.transform(ready.orderBy(*NAMES, "y", "w", "v")).select(vector_to_array("probability")[1]).collect()])


@pytest.mark.parametrize("more", [
    {}, {"maxDepth": 1}, {"maxDepth": 0, "maxIter": 2}, {"maxDepth": 5, "minInstancesPerNode": 40, "minInfoGain": 0.002}, {"maxIter": 40, "maxDepth": 2, "validationIndicatorCol": "v", "validationTol": 5e-3},
])
def test_trees_on_counts_are_those_on_rows(ready, more):
    val = more.get("validationIndicatorCol")
    want, got = estimator(**more).fit(ready), bo.fit(estimator(**more), counted(ready, val))
    assert got.getNumTrees == want.getNumTrees and (not val or got.getNumTrees < 40)
    assert probabilities(got, ready) == pytest.approx(probabilities(want, ready), abs=1e-12)
    assert list(got.featureImportances.toArray()) == pytest.approx(list(want.featureImportances.toArray()), abs=1e-9)


def test_cells_of_several_tasks_grow_the_same_trees(ready, monkeypatch):
    one = bo.fit(estimator(maxIter=2, maxDepth=2), counted(ready))
    monkeypatch.setattr(bo, "CELLS", 500)
    cells = counted(ready)
    assert cells.parts > 1 and cells.frame.rdd.getNumPartitions() == cells.parts
    assert probabilities(bo.fit(estimator(maxIter=2, maxDepth=2), cells), ready) == pytest.approx(probabilities(one, ready), abs=1e-12)


def test_a_fit_sums_over_as_many_tasks_as_there_are(ready, monkeypatch):
    # a session may deal rows over more partitions than were asked for
    monkeypatch.setattr(bo, "slots", lambda spark: 2)
    plain, one = type(ready).repartition, bo.fit(estimator(maxIter=2, maxDepth=2), counted(ready))
    monkeypatch.setattr(type(ready), "repartition", lambda df, n, *by: plain(df, max(n, 7), *by))
    for size, parts in ((bo.CELLS, 1), (500, 2)):
        monkeypatch.setattr(bo, "CELLS", size)
        cells = counted(ready)
        assert cells.parts == cells.frame.rdd.getNumPartitions() == parts
        assert probabilities(bo.fit(estimator(maxIter=2, maxDepth=2), cells), ready) == pytest.approx(probabilities(one, ready), abs=1e-12)


def test_cells_count_every_row(ready):
    cells = counted(ready, "v")
    told = cells.frame.groupBy("val").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("w")).alias("w"), F.sum(F.col("n") * F.col("y")).alias("y")).collect()
    want = ready.groupBy("v").agg(F.count(F.lit(1)), F.sum("w"), F.sum("y")).collect()
    assert [tuple(r) for r in sorted(told)] == [pytest.approx(tuple(r)) for r in sorted(want)]
    assert cells.frame.count() < 3000


def test_features_of_many_values_get_even_bins(spark, monkeypatch):
    rng = random.Random(6)
    df = spark.createDataFrame([(rng.gauss(0, 1), float(i % 2)) for i in range(4000)], "x double, y double").repartition(4)
    cells = bo.counted(df, ["x"], "y")
    assert len(cells.cuts[0]) == 31
    sizes = [r["n"] for r in cells.frame.groupBy("k0").agg(F.sum("n").alias("n")).collect()]
    assert len(sizes) == 32 and min(sizes) > 100 and max(sizes) < 150


def test_draws_of_a_cell_are_those_of_its_rows(ready):
    recipe = {"subsamplingRate": 0.5, "featureSubsetStrategy": "0.8", "maxIter": 30}
    cells = counted(ready)
    whole = probabilities(bo.fit(estimator(maxIter=30), cells), ready)
    first, again = (probabilities(bo.fit(estimator(**recipe), cells), ready) for _ in range(2))
    assert list(first) == list(again) and 0.0 < np.abs(first - whole).mean() < 0.05
    rows = [r["rows"] for r in bo.grown(cells, bo.planned(estimator(**recipe), 3, 32))]
    assert len(set(rows)) > 10 and 1400 < min(rows) and max(rows) < 1600


def test_more_features_than_one_long_holds(spark):
    rng = random.Random(7)
    names = [f"x{i}" for i in range(15)]
    df = spark.createDataFrame([(*[float(rng.randrange(50)) for _ in names], 0.0) for _ in range(500)], ", ".join(f"{n} double" for n in names) + ", y double")
    df = df.withColumn("y", (F.col("x14") + F.col("x3") > 49).cast("double"))
    cells = bo.counted(df, names, "y")
    assert "k1" in cells.frame.columns
    ready = md._prepare(names)[1].setInputCols(names).transform(df)
    model = GBTClassifier(featuresCol="__features", labelCol="y", maxIter=10, maxDepth=3, seed=1)
    scored = bo.fit(model, cells).transform(ready)
    assert scored.where("prediction = y").count() > 430
    assert [i for i, v in enumerate(bo.fit(model, cells).featureImportances.toArray()) if v > 0.2] == [3, 14]


@pytest.mark.parametrize("row", [(1.0, None, 1.0), (1.0, 2.0, 1.0), (1.0, 1.0, None), (1.0, 1.0, -1.0)])
def test_null_labels_and_weights_stop_a_fit(spark, row):
    df = spark.createDataFrame([(0.0, 0.0, 1.0), (2.0, 1.0, 1.0), row], "x double, y double, w double")
    with pytest.raises(Exception, match="must be 0"):
        bo.counted(df, ["x"], "y", "w")


def test_ablation_fits_the_whole_recipe_for_every_family(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    day = datetime.datetime(1995, 1, 1)
    rows = [(i, i % 60, "F", round(rng.uniform(1000, 90000), 2), day + datetime.timedelta(days=i)) for i in range(2500)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    models, plain = [], md.fit_classifier

    def fitted(*args, **more):
        models.append(plain(*args, **more).stages[-1])
        return plain(*args, **{**more, "trees": 2})

    monkeypatch.setattr(md, "fit_classifier", fitted)
    out = {r["family"]: r for r in learning.b17(spark, str(tmp_path)).collect()}
    assert sorted(out) == ["all", "long", "short"] and len({r["n"] for r in out.values()}) == 1
    assert [m.getNumTrees for m in models] == [400, 400, 400] and [m.numFeatures for m in models] == [4, 6, 10]
    assert all(m.treeWeights == [1.0] + [0.05] * 399 for m in models)


def searched(spark, trees, needed=None):
    rng = random.Random(8)
    rows = [(x, float(rng.random() < x * x), "train" if i % 3 else "val", i) for i, x in enumerate(rng.random() for _ in range(3000))]
    data, names = md.with_indicators(spark.createDataFrame(rows, "x double, y double, split string, other int"), ["x"])
    score = lambda val: val.agg((-F.avg((F.col("p_over") - F.col("y")) ** 2)).alias("rank"), F.count(F.lit(1)).alias("n"))
    return md.successive_halving(data, names, "y", [{"maxDepth": 2}], [md.Rung(trees, 1.0)], score, needed=needed)


def test_a_search_passes_over_its_rows_as_often_whatever_its_trees(spark):
    context, jobs, grown = spark.sparkContext, {}, {}
    for trees in (1, 6):
        context.setJobGroup(f"search of {trees}", "")
        try:
            grown[trees] = searched(spark, trees)[0]["grown"]
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        jobs[trees] = len(context.statusTracker().getJobIdsForGroup(f"search of {trees}"))
    assert grown[1] == 1 and grown[6] > 2
    assert jobs[1] == jobs[6] > 0


def test_a_search_scores_alike_on_the_columns_it_needs(spark):
    assert searched(spark, 3, ["y"]) == searched(spark, 3)


def test_search_by_rung_against_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(10)
    start = datetime.datetime(1995, 1, 1)
    rows = []
    for i in range(2000):
        quantity = float(rng.randrange(1, 51))
        price = round(quantity * rng.uniform(500, 3500), 2)
        rows.append((i, i % 50, i % 13, i % 7 + 1, quantity, price, rng.randrange(11) / 100, rng.randrange(9) / 100, "R", rng.choice("OF"), start + datetime.timedelta(days=i)))
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = con.execute(load()[1]["f3_search_by_rung"]).fetchall()
    assert [tuple(r) for r in learning.f3_rungs(spark, str(tmp_path)).collect()] == [pytest.approx(r) for r in want]
