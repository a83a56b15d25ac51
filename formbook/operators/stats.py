"""Scores, calibration tables, correlations and dispersion fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.functions.odds import safe_div
from formbook.operators.skew import DEFAULT_RULE, Running, SplitRule, exact_percentiles, join_back, running, summarise


def beside(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Two summaries of the same groups side by side; without groups each is a single row."""
    if by:
        return a.join(b, list(by))
    return a.withColumn("__one", F.lit(1)).join(b.withColumn("__one", F.lit(1)), "__one").drop("__one")


def _with_percentiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], extra: dict[str, Column]) -> DataFrame:
    if by:
        return summarise(df, by, value, probs, extra)
    return beside(df.agg(*[e.alias(n) for n, e in extra.items()]), exact_percentiles(df, by, value, probs), by)


def clipped(p: Column, eps: float = 1e-15) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def brier(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


def log_loss(p: Column, y: Column) -> Column:
    q = clipped(p)
    return -(y * F.log(q) + (1.0 - y) * F.log(1.0 - q))


def poisson_deviance(mu: Column, y: Column) -> Column:
    safe = F.greatest(mu, F.lit(1e-9))
    entropy = F.when(y > 0, y * F.log(y / safe)).otherwise(F.lit(0.0))
    return 2.0 * (entropy - (y - safe))


def score_probabilities(df: DataFrame, by: Sequence[str], p: str, y: str, cut: float = 0.5) -> DataFrame:
    """Brier, log loss, accuracy and the confusion counts with precision, recall and F1."""
    yes, hit = F.col(p) >= cut, F.col(y) == 1
    tp, fp = F.count_if(yes & hit), F.count_if(yes & ~hit)
    tn, fn = F.count_if(~yes & ~hit), F.count_if(~yes & hit)
    agg = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(brier(F.col(p), F.col(y))).alias("brier"),
        F.avg(log_loss(F.col(p), F.col(y))).alias("log_loss"),
        tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn"),
    )
    precision = F.coalesce(safe_div(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    recall = F.coalesce(safe_div(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return agg.withColumns(
        {
            "accuracy": (F.col("tp") + F.col("tn")) / F.col("n"),
            "precision": precision,
            "recall": recall,
            "f1": F.coalesce(safe_div(2.0 * precision * recall, precision + recall), F.lit(0.0)),
        }
    )


def score_counts(df: DataFrame, by: Sequence[str], mu: str, y: str) -> DataFrame:
    """Mean absolute error, signed bias and Poisson deviance of a count forecast."""
    m, a = F.col(mu), F.col(y)
    return df.where(m.isNotNull() & a.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(m - a)).alias("mae"),
        F.avg(m - a).alias("bias"),
        F.avg(poisson_deviance(m, a)).alias("poisson_deviance"),
    )


def roc_auc(df: DataFrame, by: Sequence[str], score: str, y: str, rule: SplitRule = DEFAULT_RULE) -> DataFrame:
    """Tie-averaged rank AUC from counts per distinct score and one running sum."""
    counts = (
        df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
        .groupBy(*by, score)
        .agg(F.sum(F.col(y).cast("long")).alias("__pos"), F.sum(1 - F.col(y).cast("long")).alias("__neg"))
    )
    below = running(counts, by, [F.col(score)], {"__below": Running("sum", F.col("__neg"))}, prior=True, rule=rule)
    wins = F.col("__pos") * (F.coalesce("__below", F.lit(0)) + F.col("__neg") / 2.0)
    return below.groupBy(*by).agg(
        F.sum("__pos").alias("n_pos"),
        F.sum("__neg").alias("n_neg"),
        safe_div(F.sum(wins), F.sum("__pos").cast("double") * F.sum("__neg")).alias("auc"),
    )


def quantile_edges(df: DataFrame, value: str, bins: int) -> DataFrame:
    """One row holding the distinct bin edges of ``bins`` equal-count bins."""
    probs = {f"q{i}": i / bins for i in range(bins + 1)}
    row = exact_percentiles(df, [], value, probs)
    return row.select(F.array_sort(F.array_distinct(F.array(*[F.col(n) for n in probs]))).alias("edges"))


def reliability_quantile(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Predicted against observed per quantile bin; repeated edges merge bins."""
    edges = quantile_edges(df, p, bins).scalar()
    left_of = F.size(F.filter("edges", lambda e: e < F.col(p)))
    return (
        df.where(F.col(p).isNotNull())
        .withColumn("edges", edges)
        .withColumn("bin", F.greatest(left_of, F.lit(1)) - 1)
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"), F.avg(F.col(y).cast("double")).alias("actual_rate"))
    )


def reliability_fixed(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    slot = F.least(F.floor(F.col(p) * bins).cast("int"), F.lit(bins - 1))
    return (
        df.where(F.col(p).isNotNull())
        .groupBy(slot.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"), F.avg(F.col(y).cast("double")).alias("actual_rate"))
    )


def side_calibration(df: DataFrame, by: Sequence[str], p: str, y: str) -> DataFrame:
    side = F.when(F.col(p) >= 0.5, F.lit("over")).otherwise(F.lit("under"))
    return (
        df.where(F.col(p).isNotNull())
        .groupBy(*by, side.alias("model_side"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"), F.avg(F.col(y).cast("double")).alias("actual_rate"))
        .withColumn("gap", F.col("mean_pred") - F.col("actual_rate"))
    )


def tail_calibration(df: DataFrame, cdf: dict[int, Column], y: str, keep: Column | None = None) -> DataFrame:
    """Mean forecast P(count <= k) against the share at or below k, one row per k."""
    rows = df if keep is None else df.where(keep)
    points = F.array(
        *[F.struct(F.lit(k).alias("k"), c.alias("p"), (F.col(y) <= k).cast("double").alias("hit")) for k, c in cdf.items()]
    )
    return rows.select(F.inline(points)).groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("predicted"), F.avg("hit").alias("observed")
    )


def numeric_profile(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    stats = {"n": F.count(value), "mean": F.avg(value), "std": F.stddev_samp(value), "low": F.min(value), "high": F.max(value)}
    return _with_percentiles(df, by, value, {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}, stats)


def bucket_summary(df: DataFrame, value: str, y: str, edges: Sequence[float]) -> DataFrame:
    """Hit rate per right-closed value bucket; values outside the edges are left out."""
    slot = F.when(F.lit(False), F.lit(0))
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        slot = slot.when((F.col(value) > lo) & (F.col(value) <= hi), F.lit(i))
    return (
        df.withColumn("bucket", slot)
        .where("bucket is not null")
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("hit_rate"), F.avg(value).alias("mean_value"))
    )


def smoothed_histogram(df: DataFrame, value: str, low: float, high: float, width: float, laplace: float) -> DataFrame:
    """Weight and midpoint of every bin of a fixed grid, empty bins smoothed up."""
    n_bins = round((high - low) / width)
    slot = F.least(F.floor((F.col(value) - low) / width), F.lit(n_bins - 1)).cast("int")
    counts = df.where(F.col(value).between(low, high)).groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    full = grid.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    return full.withColumn("__t", total).select(
        "bin",
        "n",
        ((F.col("n") + laplace) / (F.col("__t") + laplace * n_bins)).alias("weight"),
        (F.lit(low) + (F.col("bin") + 0.5) * width).alias("midpoint"),
    )


def linear_fit(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson correlation, least-squares line, and the slope through the origin."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.corr(x, y).alias("r"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        safe_div(F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) * F.col(x))).alias("slope_origin"),
    )


def dispersion_fit(df: DataFrame, by: Sequence[str], mu: str, y: str) -> DataFrame:
    """Moment fit of Var = mean + alpha * mean^2 on residuals; Poisson when not over-dispersed."""
    m = F.greatest(F.col(mu), F.lit(1e-3))
    agg = df.groupBy(*by).agg(
        F.avg(m).alias("mean_mu"), F.avg((F.col(y) - m) * (F.col(y) - m)).alias("resid_var"), F.avg(m * m).alias("mean_mu2")
    )
    alpha = F.greatest((F.col("resid_var") - F.col("mean_mu")) / F.col("mean_mu2"), F.lit(1e-6))
    poisson = F.col("resid_var") <= F.col("mean_mu")
    return agg.withColumn("alpha", F.when(poisson, F.lit(0.0)).otherwise(alpha)).withColumn(
        "family", F.when(poisson, F.lit("poisson")).otherwise(F.lit("negative_binomial"))
    )


def interval_coverage(df: DataFrame, by: Sequence[str], cdf_at: Column, cdf_before: Column, draw: Column, bins: int = 10) -> DataFrame:
    """Central 50 and 80 percent coverage and the randomised PIT histogram.

    The central interval from the q to the 1-q quantile holds y exactly when
    F(y) >= q and F(y - 1) < 1 - q, so two distribution values per row suffice.
    """
    scored = df.select(
        *by,
        ((cdf_at >= 0.25) & (cdf_before < 0.75)).cast("double").alias("__in50"),
        ((cdf_at >= 0.10) & (cdf_before < 0.90)).cast("double").alias("__in80"),
        F.least(F.floor((cdf_before + draw * (cdf_at - cdf_before)) * bins), F.lit(bins - 1)).alias("__pit"),
    )
    hist = [F.avg((F.col("__pit") == i).cast("double")).alias(f"pit_{i}") for i in range(bins)]
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("__in50").alias("cov50"), F.avg("__in80").alias("cov80"), *hist
    )


def null_rates(df: DataFrame, by: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.avg(F.col(c).isNull().cast("double")).alias(f"null_{c}") for c in columns]
    )


def gap_stats(df: DataFrame, by: Sequence[str], gap: str, limits: Sequence[float]) -> DataFrame:
    counts = {"n": F.count(gap), "max_gap": F.max(gap)} | {f"over_{x:g}": F.count_if(F.col(gap) > x) for x in limits}
    return _with_percentiles(df, by, gap, {"median_gap": 0.5, "p95_gap": 0.95}, counts)


def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]], kept: str = "kept") -> DataFrame:
    """Each row in the first bucket whose predicate holds; the buckets add up to all rows."""
    bucket = F.lit(None).cast("string")
    for name, hit in reversed(list(steps)):
        bucket = F.when(F.coalesce(hit, F.lit(False)), F.lit(name)).otherwise(bucket)
    return df.groupBy(F.coalesce(bucket, F.lit(kept)).alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows"))


def empirical_shares(df: DataFrame, residuals: DataFrame, pred: str, line: str, resid: str, row_id: Sequence[str],
                     rule: SplitRule = DEFAULT_RULE) -> DataFrame:
    """Share of ``pred + residual`` above, below and at the line, for every residual.

    The residual sample is ranked once; a row's shares are the counts left of
    ``line - pred``, found in one merged pass over both sorted sets.
    """
    counts = residuals.where(F.col(resid).isNotNull()).groupBy(F.col(resid).cast("double").alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    asks = df.select((F.col(line) - F.col(pred)).alias("__x")).distinct()
    merged = counts.unionByName(asks.withColumn("__n", F.lit(0).cast("long"))).groupBy("__x").agg(F.sum("__n").alias("__n"))
    swept = running(merged, [], [F.col("__x")], {"__upto": Running("sum", F.col("__n"))}, rule=rule)
    total = counts.agg(F.sum("__n")).scalar()
    at = asks.join(swept, "__x").withColumn("__total", total).select(
        "__x",
        (1.0 - F.col("__upto") / F.col("__total")).alias("p_over"),
        ((F.col("__upto") - F.col("__n")) / F.col("__total")).alias("p_under"),
        (F.col("__n") / F.col("__total")).alias("p_push"),
    )
    return join_back(df.withColumn("__x", F.col(line) - F.col(pred)), at, ["__x"], rule=rule).drop("__x")


def drift_baseline(df: DataFrame, side: str, bettime: str, closing: str) -> DataFrame:
    """Mean move from bet time to close per side, over all quotes."""
    move = F.col(closing) - F.col(bettime)
    return df.groupBy(side).agg(F.count(move).alias("n"), F.avg(move).alias("mean_drift"))


def net_of_drift(df: DataFrame, side: str, bettime: str, closing: str) -> DataFrame:
    base = drift_baseline(df, side, bettime, closing).select(side, "mean_drift")
    return join_back(df, base, [side]).withColumn(
        "net_clv", F.col(closing) - F.col(bettime) - F.col("mean_drift")
    )


def month_of(ts: str) -> Column:
    return F.trunc(F.to_date(ts), "MM")
