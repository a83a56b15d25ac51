"""Model training and scoring on ``pyspark.ml``; only parameters and metrics reach the driver."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.functions.odds import confidence_bucket, recommendation
from formbook.operators import boosting
from formbook.operators.skew import DEFAULT_RULE, SplitRule, exact_percentiles
from formbook.sources.tables import work_folder


def with_indicators(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Missing indicators beside the features, as trees here have no missing branch."""
    flags = {f"{c}_missing": F.col(c).isNull().cast("double") for c in features}
    return df.withColumns(flags), [*features, *flags]


def filled(features: Sequence[str]) -> list[str]:
    return [f"__f_{c}" for c in features]


def _prepare(features: Sequence[str]) -> list:
    return [
        Imputer(strategy="mean", inputCols=list(features), outputCols=filled(features)),
        VectorAssembler(inputCols=filled(features), outputCol="__features"),
    ]


def detached(model, spark):
    """``model`` as saved and loaded, without its training summary.

    A summary holds the session, and a session in which any query was observed (``DataFrame.observe``) can't be sent to tasks; a logistic or forest
    model that keeps its summary then can't score. Written to the folder that executors share; a model is small.
    """
    place = work_folder(spark, "model")
    model.save(place)
    return type(model).load(place)


def fit_classifier(train: DataFrame, features: Sequence[str], label: str, weight: str | None = None, trees: int = 20, depth: int = 4,
                   step: float = 0.1, seed: int = 42, counted: bool = False, **recipe):
    """Boosted trees after mean imputation; ``recipe`` holds further parameters of ``GBTClassifier``.

    ``counted`` grows the same trees on counts of alike rows, in one job for all of them (many trees, many rows).
    """
    model = GBTClassifier(featuresCol="__features", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=step, seed=seed, **recipe)
    if weight:
        model = model.setWeightCol(weight)
    if not counted:
        return Pipeline(stages=[*_prepare(features), model]).fit(train)
    prepared = Pipeline(stages=_prepare(features)).fit(train)
    cells = boosting.counted(prepared.transform(train), filled(features), label, weight)
    return PipelineModel([*prepared.stages, boosting.fit(model, cells)])


def fit_rate(train: DataFrame, features: Sequence[str], label: str, trees: int = 20, depth: int = 4, seed: int = 42):
    model = GBTRegressor(featuresCol="__features", labelCol=label, maxIter=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[*_prepare(features), model]).fit(train)


def fit_poisson(train: DataFrame, features: Sequence[str], label: str, offset: str | None = None):
    """Log-link Poisson model; ``offset`` is a log-scale base added with coefficient one."""
    model = GeneralizedLinearRegression(
        featuresCol="__features", labelCol=label, family="poisson", link="log", predictionCol="mu", maxIter=25, regParam=1e-6
    )
    if offset:
        model = model.setOffsetCol(offset)
    return Pipeline(stages=[*_prepare(features), model]).fit(train)


def fit_huber(train: DataFrame, features: Sequence[str], label: str):
    model = LinearRegression(
        featuresCol="__features", labelCol=label, loss="huber", epsilon=1.35, regParam=0.0, solver="l-bfgs", predictionCol="fitted"
    )
    return Pipeline(stages=[*_prepare(features), model]).fit(train)


def probability(df: DataFrame, model, name: str = "p_over") -> DataFrame:
    drop = ["__features", "rawPrediction", "probability", "prediction"]
    scored = model.transform(df)
    temp = [c for c in scored.columns if c.startswith("__f_")]
    return scored.withColumn(name, vector_to_array("probability")[1]).drop(*drop, *temp)


def fit_platt(calibration: DataFrame, p: str, label: str):
    """Logistic fit on the log odds of a raw probability."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    data = calibration.withColumn("__logit", F.log(q / (1.0 - q)))
    stages = [VectorAssembler(inputCols=["__logit"], outputCol="__features"),
              LogisticRegression(featuresCol="__features", labelCol=label, maxIter=50)]
    return detached(Pipeline(stages=stages).fit(data), data.sparkSession)


def apply_platt(df: DataFrame, model, p: str, name: str) -> DataFrame:
    q = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    return probability(df.withColumn("__logit", F.log(q / (1.0 - q))), model, name).drop("__logit")


def fit_blend(calibration: DataFrame, model_p: str, market_p: str, label: str, strength: float = 1.0):
    """Logistic fit on the calibrated model's and the market's probability, with a ridge of ``1 / strength`` on the sum of losses."""
    data = calibration.where(F.col(model_p).isNotNull() & F.col(market_p).isNotNull() & F.col(label).isNotNull())
    rows = max(data.count(), 1)
    stages = [VectorAssembler(inputCols=[model_p, market_p], outputCol="__features"),
              LogisticRegression(featuresCol="__features", labelCol=label, maxIter=100, regParam=1.0 / (strength * rows), standardization=False)]
    return detached(Pipeline(stages=stages).fit(data), data.sparkSession)


def random_configs(grid: dict[str, Sequence], n: int, seed: int) -> list[dict]:
    """``n`` different seeded draws of the declared grid (all of it, if it has fewer)."""
    rng = random.Random(seed)
    size = math.prod(len(v) for v in grid.values())
    out = []
    for at in rng.sample(range(size), min(n, size)):
        config = {}
        for k, values in grid.items():
            at, i = divmod(at, len(values))
            config[k] = list(values)[i]
        out.append(config)
    return out


@dataclass(frozen=True)
class Rung:
    """One round of a search: how many trees its fits may grow, and what share of its configurations goes on."""

    trees: int
    keep: float


def boosted(config: dict, trees: int, label: str, weight: str | None, seed: int) -> GBTClassifier:
    """Boosted trees of one configuration that stop once rows marked ``__val`` no longer gain."""
    model = GBTClassifier(featuresCol="__features", labelCol=label, maxIter=trees, seed=seed, validationIndicatorCol="__val", validationTol=1e-4, **config)
    return model.setWeightCol(weight) if weight else model


ROWS = 100_000  # of a task of a fit


def dealt(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``columns`` of ``df`` in partitions of about ``ROWS`` rows where one of its own holds more (a file's row groups may be few and large).

    Rows are dealt and ordered by a hash of their values ``by``, so that reruns sample alike.
    """
    sizes = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    told = sizes.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    if (told["most"] or 0) <= ROWS:
        return df.select(*columns)
    parts = max(-(-told["rows"] // ROWS), df.sparkSession.sparkContext.defaultParallelism)
    keyed = df.select(*columns, F.xxhash64(*by).alias("__h"))
    return keyed.repartition(parts, "__h").sortWithinPartitions("__h").drop("__h")


def successive_halving(
    data: DataFrame, features: Sequence[str], label: str, configs: Sequence[dict], rungs: Sequence[Rung], score: Callable[[DataFrame], DataFrame],
    weight: str | None = None, val: str = "split = 'val'", train: str = "split = 'train'", parallelism: int = 2, seed: int = 42,
    needed: Sequence[str] | None = None,
) -> list[dict]:
    """Search over ``configs``: each rung fits those left with more trees and keeps the best by ``score`` on validation rows.

    Features are imputed (from training rows) and assembled once, in a frame that all fits share; fits of a rung run side by side, as each leaves executors
    idle between trees. ``score`` takes scored validation rows (``p_over``) and gives one row, whose column ``rank`` is better when larger (a null is worst);
    ``needed`` names the columns it reads, if not all.
    Test rows are never read. Returns one dict per (rung, configuration): its place in ``configs``, trees grown, whether it was kept, and the columns of ``score``.
    """
    prepared = Pipeline(stages=_prepare(features)).fit(data.where(train))
    ready = prepared.transform(data.where(f"({train}) OR ({val})")).withColumn("__val", F.expr(val))
    # fits read counts of alike rows; only validation rows keep what ``score`` may ask for
    cells = boosting.counted(ready.where(F.col(label).isNotNull()), filled(features), label, weight, "__val")
    held_out = dealt(ready.where("__val"), data.columns, [*(data.columns if needed is None else needed), "__features"]).persist(StorageLevel.DISK_ONLY)

    def fitted(job: tuple[int, Rung]) -> dict:
        i, rung = job
        model = boosting.fit(boosted(configs[i], rung.trees, label, weight, seed), cells)
        scored = model.transform(held_out).withColumn("p_over", vector_to_array("probability")[1])
        # every pass of ``score`` reads probabilities, not trees
        scored = scored.drop("__features", "rawPrediction", "probability", "prediction").persist(StorageLevel.DISK_ONLY)
        try:
            return {"config": i, "trees": rung.trees, "grown": model.getNumTrees, **score(scored).first().asDict()}
        finally:
            scored.unpersist()

    out, left = [], list(range(len(configs)))
    try:
        with ThreadPool(parallelism) as pool:
            for number, rung in enumerate(rungs):
                results = pool.map(inheritable_thread_target(data.sparkSession)(fitted), [(i, rung) for i in left], chunksize=1)
                order = sorted(results, key=lambda r: (r["rank"] is None, -(r["rank"] or 0.0), r["config"]))
                left = sorted(r["config"] for r in order[: max(1, math.ceil(rung.keep * len(order)))])
                out += [{"rung": number, **r, "kept": int(r["config"] in left)} for r in sorted(results, key=lambda r: r["config"])]
    finally:
        held_out.unpersist()
    return out


def fit_families(data: DataFrame, features: Sequence[str], label: str, families: dict[str, Sequence[dict]], trees: int, weight: str | None = None,
                 val: str = "split = 'val'", train: str = "split = 'train'", parallelism: int = 3, seed: int = 42) -> DataFrame:
    """Validation rows scored by every configuration of every family (boosted, forest, logistic), stacked, with the columns family, config and ``p_over``.

    Features are assembled once; rows are passed over once per model, side by side in one array.
    """
    prepared = Pipeline(stages=_prepare(features)).fit(data.where(train))
    known = prepared.transform(data.where(train).where(F.col(label).isNotNull())).persist(StorageLevel.MEMORY_AND_DISK)
    makers = {
        "boosted": lambda config: GBTClassifier(featuresCol="__features", labelCol=label, maxIter=trees, seed=seed, **config),
        "forest": lambda config: RandomForestClassifier(featuresCol="__features", labelCol=label, numTrees=trees, seed=seed, **config),
        "logistic": lambda config: LogisticRegression(featuresCol="__features", labelCol=label, maxIter=50, **config),
    }
    jobs = [(family, i, makers[family](config)) for family, configs in families.items() for i, config in enumerate(configs)]

    def fitted(job: tuple) -> tuple:
        family, i, model = job
        return family, i, detached((model.setWeightCol(weight) if weight else model).fit(known), data.sparkSession)

    try:
        with ThreadPool(parallelism) as pool:
            models = pool.map(inheritable_thread_target(data.sparkSession)(fitted), jobs, chunksize=1)
    finally:
        known.unpersist()
    scored, cells = prepared.transform(data.where(val)), []
    for family, i, model in models:
        name = f"__p_{family}_{i}"
        scored = model.transform(scored).withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        cells.append(F.struct(F.lit(family).alias("family"), F.lit(i).alias("config"), F.col(name).alias("p_over")))
    kept = [c for c in data.columns if c not in ("family", "config", "p_over")]
    return scored.select(*kept, F.inline(F.array(*cells)))


def sample_weights(df: DataFrame, value: str, low: float, high: float, name: str) -> DataFrame:
    """Value clipped at its own exact percentiles (winsorised target)."""
    lo, hi = (exact_percentiles(df, [], value, {"at": p}).scalar() for p in (low, high))
    return df.withColumns({"__lo": lo, "__hi": hi}).withColumn(
        name, F.least(F.greatest(F.col(value), F.col("__lo")), F.col("__hi"))
    ).drop("__lo", "__hi")


def score_batch(df: DataFrame, model, odds_over: str, odds_under: str, threshold: float) -> DataFrame:
    """Probabilities, confidence band and recommendation for a batch of rows."""
    scored = probability(df, model, "p_over")
    return scored.withColumns(
        {
            "p_under": 1.0 - F.col("p_over"),
            "confidence": F.abs(F.col("p_over") - 0.5),
            "confidence_bucket": confidence_bucket(F.abs(F.col("p_over") - 0.5)),
            "recommendation": recommendation(F.col("p_over"), F.col(odds_over), F.col(odds_under), threshold),
        }
    )


def importances(spark, model, features: Sequence[str]) -> DataFrame:
    """Feature importances of the last stage (one small row per feature)."""
    values = [float(x) for x in model.stages[-1].featureImportances.toArray()]
    return spark.createDataFrame(list(zip(features, values)), "feature string, importance double")
