"""Models trained on the domain tables; metrics and scored rows out."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from formbook.functions.odds import sharpness_weight
from formbook.operators import backtest as bt
from formbook.operators import models as md
from formbook.operators import stats as st
from formbook.operators.windows import prior_expanding, prior_rolling
from formbook.plans.frames import BETS, bets, form, prob_sql, table, with_sql
from formbook.plans.registry import query
from formbook.session import checkpointed

c = F.col
SHORT, LONG = ["value_rolling_3", "value_rolling_std_3"], ["value_rolling_10", "value_rolling_std_10", "shots_rolling_10"]


def training_frame(spark, d):
    """Prior form per entity with the label 'next value above the season mean so far'."""
    f = prior_rolling(form(spark, d), ["entity_id"], ["game_date", "game_id"], ["value", "shots"], (3, 10))
    f = prior_expanding(f, ["team_id", "season"], ["game_date", "game_id"], "value", "team")
    f = f.where("team_avg is not null").withColumns({"label": (c("value") > c("team_avg")).cast("double"), "count_label": F.floor(c("value") / 20000).cast("double")})
    return bt.date_split(f, "game_date", [("train", "1995-01-01", "1999-12-31"), ("val", "2000-01-01", "2000-12-31"), ("test", "2001-01-01", "2001-12-31")])


def market_frame(spark, d):
    b = bets(spark, d).withColumns(
        {"y": (c("actual") > c("line")).cast("double"), "weight": sharpness_weight(c("odds_over"), c("odds_under")), "market": c("p_over")}
    )
    return bt.date_split(b, "bet_date", [("train", "1995-01-01", "1999-12-31"), ("val", "2000-01-01", "2000-12-31"), ("test", "2001-01-01", "2001-12-31")])


FAMILIES = {
    "boosted": [{"maxDepth": 2, "stepSize": 0.1}, {"maxDepth": 4, "stepSize": 0.1}], "forest": [{"maxDepth": 4}, {"maxDepth": 8}],
    "logistic": [{"regParam": 0.01}, {"regParam": 0.1}],
}
TREES = 20


@query("f2_classifier_grid_selected_on_val")
def f2(spark, d):
    """Three families over a small declared grid, fitted on train, scored on val; the smallest Brier is kept."""
    data, names = md.with_indicators(training_frame(spark, d), [*SHORT, *LONG])
    scored = md.fit_families(data, names, "label", FAMILIES, TREES)
    scores = st.score_probabilities(scored, ["family", "config"], "p_over", "label").select("family", "config", "n", "brier", "log_loss")
    best = scores.agg(F.min_by(F.struct("family", "config"), F.struct("brier", "family", "config"))).scalar()
    return scores.withColumn("selected", (F.struct("family", "config") == best).cast("int"))


@query("f2_rate_model_scores")
def f2_rate(spark, d):
    data, names = md.with_indicators(training_frame(spark, d), [*SHORT, *LONG])
    model = md.fit_rate(data.where("split = 'train'"), names, "shots", trees=5, depth=3)
    scored = model.transform(data.where("split <> 'train'"))
    return st.score_counts(scored.withColumn("mu", c("prediction")), ["split"], "mu", "shots")


@query("f2_embedding_classifier")
def f2_embeddings(spark, d):
    """Label of the embedding rows from their vectors, by logistic regression."""
    from pyspark.ml.classification import LogisticRegression

    e = table(spark, d, "embeddings").withColumn("features", array_to_vector(c("embedding").cast("array<double>")))
    e = e.withColumns({"label": (c("label") % 2).cast("double"), "fold": c("vec_id") % 2})
    model = md.detached(LogisticRegression(maxIter=10, regParam=0.1).fit(e.where("fold = 0")), spark)
    scored = model.transform(e.where("fold = 1")).withColumn("p", vector_to_array("probability")[1])
    return scored.select("vec_id", c("label").cast("int").alias("label"), "p")


# fixed values: the grid, the thresholds swept and the two configurations always tried
SEARCH = {
    "maxDepth": (3, 4, 5, 6), "stepSize": (0.01, 0.02, 0.05, 0.1), "minInstancesPerNode": (10, 15, 20, 30), "minInfoGain": (0.0, 0.001, 0.005),
    "subsamplingRate": (0.7, 0.8), "featureSubsetStrategy": ("0.7", "0.8"),
}
ALWAYS = [
    {"maxDepth": 4, "stepSize": 0.02, "minInstancesPerNode": 15, "minInfoGain": 0.001, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"},
    {"maxDepth": 4, "stepSize": 0.02, "minInstancesPerNode": 15, "minInfoGain": 0.0, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"},
]
SWEPT = [0.08, 0.10, 0.12, 0.15]
N_CONFIGS = 7
RUNGS = [md.Rung(2, 1 / 3), md.Rung(6, 1 / 3), md.Rung(18, 1.0)]


def searched(spark, d):
    """Every (rung, configuration) of the search with its best threshold on val."""
    data, names = md.with_indicators(market_frame(spark, d), ["line", "market", "p_push", "stake"])

    def score(val):
        swept = bt.threshold_sweep(val.withColumn("p_under", 1.0 - c("p_over")), SWEPT)
        best = bt.best_threshold(swept).select("threshold", "bets", "bet_rate", "roi", "band")
        sized = best.withColumns({"brier": val.agg(F.avg(st.brier(c("p_over"), c("y")))).scalar(), "n_val": val.agg(F.count("y")).scalar()})
        # a band nearer the wanted bet rate first, then ROI
        return sized.withColumn("rank", c("band") * 1000.0 + c("roi"))

    configs = [*ALWAYS, *md.random_configs(SEARCH, N_CONFIGS, seed=42)]
    return md.successive_halving(data, names, "y", configs, RUNGS, score, "weight", needed=["y", "line", "actual", "odds_over", "odds_under"])


@query("f3_random_search_by_threshold")
def f3(spark, d):
    """The declared grid's seeded draws and two fixed configurations, halved over rungs of more trees; each with its best threshold on val."""
    kind = "rung int, config int, trees int, grown int, threshold double, bets long, bet_rate double, roi double, band int, brier double, n_val long, rank double, kept int"
    rows = searched(spark, d)  # a row per rung and configuration
    names = [k.split()[0] for k in kind.split(", ")]
    return spark.createDataFrame([tuple(r[k] for k in names) for r in rows], kind).drop("rank")


_SIZES = [N_CONFIGS + len(ALWAYS)]
for _rung in RUNGS[:-1]:
    _SIZES.append(-(-_SIZES[-1] // round(1 / _rung.keep)))


@query(
    "f3_search_by_rung",
    with_sql(BETS, f"val AS (SELECT CAST(actual > line AS DOUBLE) AS y FROM bets WHERE bet_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31')", "b AS (SELECT count(*) AS n_val, avg(y) * (1 - avg(y)) AS base_brier FROM val)",
             "r(rung, trees, n_configs) AS (VALUES " + ", ".join(f"({i}, {r.trees}, {n})" for i, (r, n) in enumerate(zip(RUNGS, _SIZES))) + ")")
    + "SELECT rung, trees, CAST(n_configs AS BIGINT) AS n_configs, n_val, base_brier, 1 AS beats_base FROM r, b ORDER BY rung",
)
def f3_rungs(spark, d):
    """Per rung: how many configurations ran, and whether the best one's Brier is below that of always telling validation's own rate."""
    found = f3(spark, d)
    rungs = found.groupBy("rung", "trees").agg(F.count(F.lit(1)).alias("n_configs"), F.min("n_val").alias("n_val"), F.min("brier").alias("__best"))
    rate = market_frame(spark, d).where("split = 'val'").agg(F.avg("y").alias("m")).select((c("m") * (1 - c("m"))).alias("b"))
    out = rungs.withColumn("base_brier", rate.scalar())
    return out.withColumn("beats_base", (c("__best") < c("base_brier")).cast("int")).drop("__best").orderBy("rung")


@query("f4_poisson_with_offset")
def f4(spark, d):
    """Counts with a per-row log base: the fitted intercept moves the base, not the slope of it."""
    data = training_frame(spark, d).withColumn("base", F.log(F.greatest(c("team_avg") / 20000, F.lit(1e-3))))
    model = md.fit_poisson(data.where("split = 'train'"), ["value_rolling_3"], "count_label", "base")
    scored = model.transform(data.where("split <> 'train'"))
    return st.score_counts(scored, ["split"], "mu", "count_label")


@query("f6_huber_line")
def f6(spark, d):
    data = table(spark, d, "lineitem").select(c("l_orderkey").alias("game_id"), "l_linenumber", "l_quantity", c("l_extendedprice").alias("y"))
    model = md.fit_huber(data, ["l_quantity"], "y")
    return st.score_counts(model.transform(data), ["l_linenumber"], "fitted", "y").select("l_linenumber", "n", "mae", "bias")


@query("f7_batch_scoring")
def f7(spark, d):
    """Probabilities, confidence band and recommendation for every held-out row."""
    data = market_frame(spark, d)
    names = ["line", "market", "stake"]
    model = md.fit_classifier(data.where("split = 'train'"), names, "y", "weight", trees=3, depth=3)
    test = data.where("split = 'test'").drop("p_over", "p_under")
    scored = md.score_batch(test, model, "odds_over", "odds_under", 0.12)
    return scored.groupBy("confidence_bucket", "recommendation").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("p_over").alias("mean_p_over"))


_PO, _PU = prob_sql("odds_over"), prob_sql("odds_under")


@query(
    "f8_sample_weights_and_winsor",
    with_sql(BETS)
    + f""", q AS (SELECT quantile_cont(amount, 0.01) AS lo, quantile_cont(amount, 0.99) AS hi FROM bets)
    SELECT game_id, seq, entity_id, venue, CAST(CASE WHEN {_PO} + {_PU} - 1 < 0.05 THEN 1.5 WHEN {_PO} + {_PU} - 1 > 0.10 THEN 0.8 ELSE 1.0 END AS DOUBLE) AS weight,
      least(greatest(amount, lo), hi) AS winsorised, greatest(stake * 10, 25.0) AS exposure FROM bets, q""",
)
def f8(spark, d):
    b = bets(spark, d).withColumns({"weight": sharpness_weight(c("odds_over"), c("odds_under")), "exposure": F.greatest(c("stake") * 10, F.lit(25.0))})
    return md.sample_weights(b, "amount", 0.01, 0.99, "winsorised").select("game_id", "seq", "entity_id", "venue", "weight", "winsorised", "exposure")


@query(
    "f9_group_aggregates",
    with_sql(BETS)
    + """, n AS (SELECT entity_id, line, count(*) AS n FROM bets GROUP BY ALL), m AS (SELECT entity_id, arg_max(line, (n, -line)) AS modal_line FROM n GROUP BY 1)
    SELECT entity_id, stddev_pop(actual) AS spread, array_to_string(list_sort(list(DISTINCT CAST(book AS VARCHAR))), ',') AS books, modal_line FROM bets JOIN m USING (entity_id) GROUP BY entity_id, modal_line""",
)
def f9(spark, d):
    from formbook.operators.quotes import modal_line

    b = bets(spark, d)
    g = b.groupBy("entity_id").agg(
        F.stddev_pop("actual").alias("spread"), F.array_join(F.array_sort(F.collect_set(c("book").cast("string"))), ",").alias("books")
    )
    return g.join(modal_line(b, ["entity_id"], "line").drop("n_at_modal"), "entity_id")


@query("o3_top_features")
def o3(spark, d):
    data, names = md.with_indicators(training_frame(spark, d), [*SHORT, *LONG])
    model = md.fit_classifier(data.where("split = 'train'"), names, "label", trees=5, depth=3)
    return md.importances(spark, model, names).orderBy(F.desc("importance"), "feature").limit(5)


# the study's base recipe, for every family
ABLATION = {"trees": 400, "depth": 3, "step": 0.05, "minInstancesPerNode": 10, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}


@query("b17_ablation_by_family")
def b17(spark, d):
    """The same model with and without each feature family, scored on the same rows."""
    # windows are worked out once; each family's imputation, fit and scores read what they need of them
    data = checkpointed(training_frame(spark, d).select(*SHORT, *LONG, "label", "split"))
    families = {"short": SHORT, "long": LONG, "all": [*SHORT, *LONG]}
    out = None
    for family, names in families.items():
        rows, cols = md.with_indicators(data, names)
        model = md.fit_classifier(rows.where("split = 'train'"), cols, "label", counted=True, **ABLATION)
        scored = md.probability(rows.where("split = 'test'"), model).select(F.lit(family).alias("family"), "p_over", "label")
        out = scored if out is None else out.unionByName(scored)
    return st.score_probabilities(out, ["family"], "p_over", "label").select("family", "n", "brier", "log_loss", "accuracy")
