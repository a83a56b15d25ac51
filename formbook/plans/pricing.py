"""Distributions and the prices made from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from formbook.functions import distributions as ds
from formbook.functions import odds as O
from formbook.operators import bootstrap as bs
from formbook.operators import stats as st
from formbook.operators.joins import enrich
from formbook.operators.skew import join_back
from formbook.operators.windows import forward_min_clip
from formbook.plans.frames import BETS, PAIRS, bets, table, with_sql
from formbook.plans.quotes import pairs
from formbook.plans.registry import query

# every part is a player-night: mean shots, dispersion and save rate from its attributes
NIGHTS = """nights AS (SELECT p_partkey AS entity_id, 22 + p_size / 4.0::DOUBLE AS mu, CASE p_partkey % 3 WHEN 0 THEN 0.0 ELSE 0.02 * (p_partkey % 3) END::DOUBLE AS alpha,
    0.88 + (p_partkey % 7) / 100.0::DOUBLE AS q, CAST(24 + p_partkey % 9 AS DOUBLE) + CASE WHEN p_partkey % 2 = 0 THEN 0.5 ELSE 0 END::DOUBLE AS line,
    CAST(15 + (p_partkey * 31) % 25 AS DOUBLE) AS actual FROM part)"""


def nights(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("entity_id"), (22 + F.col("p_size") / 4.0).alias("mu"),
        F.when(k % 3 == 0, F.lit(0.0)).otherwise(0.02 * (k % 3)).alias("alpha"), (0.88 + (k % 7) / 100.0).alias("q"),
        ((24 + k % 9).cast("double") + F.when(k % 2 == 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("line"), (15 + (k * 31) % 25).cast("double").alias("actual"),
    )


def mass_sql(mean: str, alpha: str, k: str) -> str:
    """Poisson or negative binomial mass by log gamma."""
    return f"""(CASE WHEN {alpha} > 0 THEN exp(lgamma({k} + 1 / {alpha}) - lgamma(1 / {alpha}) - lgamma({k} + 1) - (1 / {alpha}) * ln(1 + {alpha} * {mean}) + {k} * (ln({alpha} * {mean}) - ln(1 + {alpha} * {mean})))
      ELSE exp({k} * ln({mean}) - {mean} - lgamma({k} + 1)) END)"""


_K = "k AS (SELECT unnest(range(0, 71))::DOUBLE AS k)"


def safe_mass(mean, alpha, k):
    # both branches are evaluated, so the unused one must stay finite
    return mass_sql(mean, "ALPHA", k).replace("ALPHA > 0", f"{alpha} > 0").replace("ALPHA", f"(CASE WHEN {alpha} > 0 THEN {alpha} ELSE 1.0 END)")


@query(
    "m14_count_line_price",
    with_sql(NIGHTS, _K, f"m AS (SELECT entity_id, line, k, {safe_mass('(mu * q)', 'alpha', 'k')} AS mass FROM nights CROSS JOIN k WHERE k <= line)")
    + """SELECT entity_id, 1 - sum(mass) AS p_over, coalesce(sum(mass) FILTER (k < line), 0) AS p_under, coalesce(sum(mass) FILTER (k = line), 0) AS p_push FROM m GROUP BY 1""",
)
def m14(spark, d):
    p = ds.price_count_line(F.col("mu"), F.col("alpha"), F.col("q"), F.col("line"))
    return nights(spark, d).withColumn("p", p).select("entity_id", "p.p_over", "p.p_under", "p.p_push")


@query(
    "m14_count_line_price_wide",
    with_sql(NIGHTS, "w AS (SELECT entity_id, mu * (1 + entity_id % 30) AS mu, alpha, q, floor(mu * (1 + entity_id % 30) * q) + (entity_id % 3) * 5 + CASE WHEN entity_id % 2 = 0 THEN 0.5 ELSE 0 END::DOUBLE AS line FROM nights)",
             "kw AS (SELECT unnest(range(0, 1200))::DOUBLE AS k)",
             f"m AS (SELECT entity_id, line, k, {safe_mass('(mu * q)', 'alpha', 'k')} AS mass FROM w JOIN kw ON k <= line)")
    + """SELECT entity_id, 1 - sum(mass) AS p_over, coalesce(sum(mass) FILTER (k < line), 0) AS p_under, coalesce(sum(mass) FILTER (k = line), 0) AS p_push FROM m GROUP BY 1""",
)
def m14_wide(spark, d):
    """Means up to a thousand, lines beside them."""
    k = F.col("entity_id")
    n = nights(spark, d).withColumn("mu", F.col("mu") * (1 + k % 30))
    near = F.floor(F.col("mu") * F.col("q")) + (k % 3) * 5 + F.when(k % 2 == 0, F.lit(0.5)).otherwise(F.lit(0.0))
    p = ds.price_count_line(F.col("mu"), F.col("alpha"), F.col("q"), near.cast("double"))
    return n.withColumn("p", p).select("entity_id", "p.p_over", "p.p_under", "p.p_push")


@query(
    "m14_count_line_price_capped",
    with_sql(
        NIGHTS, _K, "cfg AS (SELECT DISTINCT mu, alpha, q FROM nights)",
        f"shots AS (SELECT mu, alpha, q, k AS n, {safe_mass('mu', 'alpha', 'k')} AS mass FROM cfg CROSS JOIN k)",
        "saves AS (SELECT mu, alpha, q, k AS s, sum(mass * exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(q) + (n - k) * ln(1 - q))) AS mass FROM shots JOIN k ON k <= n GROUP BY ALL)",
    )
    + """SELECT entity_id, coalesce(sum(mass) FILTER (s > line), 0) AS p_over, coalesce(sum(mass) FILTER (s < line), 0) AS p_under, coalesce(sum(mass) FILTER (s = line), 0) AS p_push, sum(mass) AS pmf_total
    FROM nights JOIN saves USING (mu, alpha, q) GROUP BY 1""",
)
def m14_capped(spark, d):
    p = ds.price_count_line_capped("mu", "alpha", "q", "line")
    return nights(spark, d).withColumn("p", p).select("entity_id", "p.*")


@query(
    "a28_smoothed_histogram",
    with_sql(BETS)
    + """, c AS (SELECT CAST(least(floor(actual / 3), 9) AS INTEGER) AS bin, count(*) AS n FROM bets WHERE actual BETWEEN 0 AND 30 GROUP BY 1), g AS (SELECT unnest(range(0, 10))::INTEGER AS bin),
    f AS (SELECT bin, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (bin))
    SELECT bin, n, (n + 0.5) / (sum(n) OVER () + 0.5 * 10) AS weight, 0 + (bin + 0.5) * 3 AS midpoint FROM f""".replace("0 + (bin + 0.5) * 3", "CAST((bin + 0.5) * 3 AS DOUBLE)"),
)
def a28(spark, d):
    return st.smoothed_histogram(bets(spark, d), "actual", 0.0, 30.0, 3.0, 0.5).withColumn("n", F.col("n").cast("long"))


def toi_bins(spark, d):
    """Exposure weights from the size of the parts' own price classes."""
    t = table(spark, d, "part").select((F.col("p_partkey") % 60).cast("double").alias("toi"))
    return st.smoothed_histogram(t, "toi", 0.0, 60.0, 15.0, 1.0).select("weight", "midpoint")


_BINS = """tc AS (SELECT CAST(least(floor((p_partkey % 60) / 15), 3) AS INTEGER) AS bin, count(*) AS n FROM part GROUP BY 1),
  bins AS (SELECT (n + 1.0) / (sum(n) OVER () + 4.0) AS weight, (bin + 0.5) * 15 AS midpoint FROM tc)"""


@query(
    "m15_mixture_price",
    with_sql(NIGHTS, _K, _BINS, f"m AS (SELECT entity_id, line, k, weight * {safe_mass('(mu * midpoint / 60 * q)', 'alpha', 'k')} AS mass FROM nights CROSS JOIN bins CROSS JOIN k WHERE k <= line)")
    + f""", e AS (SELECT entity_id, line, alpha, q, sum(weight * mu * midpoint / 60) AS mean_shots FROM nights CROSS JOIN bins GROUP BY ALL),
    o AS (SELECT entity_id, mean_shots, 1 - sum({safe_mass('(mean_shots * q)', 'alpha', 'k')}) AS p_over_single FROM e CROSS JOIN k WHERE k <= line GROUP BY ALL),
    p AS (SELECT entity_id, coalesce(sum(mass) FILTER (k < line), 0) AS p_under, coalesce(sum(mass) FILTER (k = line), 0) AS p_push FROM m GROUP BY 1)
    SELECT entity_id, 1 - p_under - p_push AS p_over, p_under, p_push, mean_shots, p_over_single FROM p JOIN o USING (entity_id)""",
)
def m15(spark, d):
    return mixture_price(nights(spark, d), toi_bins(spark, d)).select("entity_id", "p_over", "p_under", "p_push", "mean_shots", "p_over_single")


def mixture_price(rows, bins, key="entity_id"):
    """Weighted price over exposure bins, beside a single distribution with the same mean shots."""
    grid = bins.agg(F.collect_list(F.struct("weight", "midpoint"))).scalar()  # the declared exposure bins
    spread = rows.withColumn("__grid", grid).select("*", F.inline("__grid")).drop("__grid")
    mean = F.col("mu") * F.col("midpoint") / 60.0
    p = ds.price_count_line(mean, F.col("alpha"), F.col("q"), F.col("line"))
    priced = spread.withColumns({"p": p, "mean": mean})
    out = priced.groupBy(key).agg(
        F.sum(F.col("weight") * F.col("p.p_over")).alias("p_over"), F.sum(F.col("weight") * F.col("p.p_under")).alias("p_under"),
        F.sum(F.col("weight") * F.col("p.p_push")).alias("p_push"), F.sum(F.col("weight") * F.col("mean")).alias("mean_shots"),
        *[F.max(c).alias(f"__{c}") for c in ("alpha", "q", "line")],
    )
    single = ds.price_count_line(F.col("mean_shots"), F.col("__alpha"), F.col("__q"), F.col("__line"))
    return out.withColumn("p_over_single", single["p_over"]).drop("__alpha", "__q", "__line")


@query(
    "m16_normal_ladder_baseline",
    with_sql(NIGHTS, "kk AS (SELECT unnest(range(0, 80))::DOUBLE AS k)", "z AS (SELECT entity_id, (line + 0.5 - mu * q) / 6.3454 AS z FROM nights)",
             "s AS (SELECT entity_id, z, sum(exp((2 * k + 1) * ln(abs(z)) + k * ln(2.0) + lgamma(k + 1) - lgamma(2 * k + 2))) AS t FROM z CROSS JOIN kk WHERE z <> 0 GROUP BY ALL)")
    + "SELECT entity_id, 1 - (0.5 + 0.3989422804014327 * exp(-z * z / 2) * t * sign(z)) AS p_over FROM s UNION ALL SELECT entity_id, 0.5 FROM z WHERE z = 0",
)
def m16(spark, d):
    n = nights(spark, d)
    return n.select("entity_id", ds.ladder_baseline(F.col("line"), F.col("mu") * F.col("q"), F.lit(6.3454)).alias("p_over"))


@query(
    "m17_ladder_devig",
    with_sql(PAIRS)
    + """, a AS (SELECT event_id, book, arg_min(price_over, line) AS anchor_over, arg_min(price_under, line) AS anchor_under FROM pairs GROUP BY ALL),
    l AS (SELECT event_id, book, line, (1 / price_over) / (1 / anchor_over + 1 / anchor_under) AS p_rung FROM pairs JOIN a USING (event_id, book))
    SELECT event_id, book, line, p_rung, min(p_rung) OVER (PARTITION BY event_id, book ORDER BY line) AS p_clipped FROM l""",
)
def m17(spark, d):
    p = pairs(spark, d)
    anchors = p.groupBy("event_id", "book").agg(F.min_by("price_over", "line").alias("anchor_over"), F.min_by("price_under", "line").alias("anchor_under"))
    rungs = enrich(p, anchors, ["event_id", "book"]).withColumn(
        "p_rung", O.ladder_devig(F.col("price_over"), F.col("anchor_over"), F.col("anchor_under"))
    )
    return forward_min_clip(rungs, ["event_id", "book"], ["line"], "p_rung", "p_clipped").select("event_id", "book", "line", "p_rung", "p_clipped")


@query(
    "j17_prediction_lookup_price",
    with_sql(BETS, NIGHTS, _K, f"ev AS (SELECT DISTINCT bets.entity_id, bets.line, mu, alpha, q FROM bets LEFT JOIN nights ON nights.entity_id = bets.entity_id AND nights.entity_id % 20 <> 0)",
             f"m AS (SELECT entity_id, line, sum(CASE WHEN k < line THEN {safe_mass('(mu * q)', 'alpha', 'k')} END) AS under, sum(CASE WHEN k = line THEN {safe_mass('(mu * q)', 'alpha', 'k')} END) AS push FROM ev CROSS JOIN k WHERE mu IS NOT NULL AND k <= line GROUP BY ALL)")
    + """SELECT game_id, seq, bets.entity_id, venue, 1 - coalesce(under, 0) - coalesce(push, 0) AS p_over_model, CAST(1 AS INTEGER) AS matched FROM bets JOIN m USING (entity_id, line) WHERE bets.entity_id % 20 <> 0
    UNION ALL SELECT game_id, seq, entity_id, venue, NULL, 0 FROM bets WHERE entity_id % 20 = 0""",
)
def j17(spark, d):
    preds = nights(spark, d).where(F.col("entity_id") % 20 != 0).select("entity_id", "mu", "alpha", "q")
    b = bets(spark, d).select("game_id", "seq", "entity_id", "venue", "line")
    # one price per distinct (entity, line): quotes repeat a line across books and passes
    asked = enrich(b.select("entity_id", "line").distinct(), preds, ["entity_id"])
    p = ds.price_count_line(F.col("mu"), F.col("alpha"), F.col("q"), F.col("line"))
    priced = asked.select("entity_id", "line", "matched", p["p_over"].alias("p_over_model"))
    return b.join(priced, ["entity_id", "line"]).select("game_id", "seq", "entity_id", "venue", "p_over_model", "matched")


@query(
    "b18_line_sensitivity",
    with_sql(NIGHTS, _K, "g AS (SELECT nights.*, mu * q AS mean, unnest([20.5, 25.0, 30.5])::DOUBLE AS grid_line FROM nights)", f"m AS (SELECT entity_id, grid_line, k, {safe_mass('mean', 'alpha', 'k')} AS mass FROM g CROSS JOIN k WHERE k <= grid_line)")
    + "SELECT entity_id, grid_line, 1 - sum(mass) AS p_over FROM m GROUP BY ALL",
)
def b18(spark, d):
    grid = F.explode(F.array(*[F.lit(x) for x in (20.5, 25.0, 30.5)]))
    g = nights(spark, d).withColumn("grid_line", grid)
    p = ds.price_count_line(F.col("mu"), F.col("alpha"), F.col("q"), F.col("grid_line"))
    return g.select("entity_id", "grid_line", p["p_over"].alias("p_over"))


def cdf_at(line):
    """P(count <= floor(line)) from the line price at floor(line)."""
    p = ds.price_count_line(F.col("mu"), F.col("alpha"), F.col("q"), F.floor(line).cast("double"))
    return 1.0 - p["p_over"]


_CDFS = f"""c AS (SELECT entity_id, actual, sum(CASE WHEN k <= actual THEN {safe_mass('(mu * q)', 'alpha', 'k')} END) AS f1, coalesce(sum(CASE WHEN k <= actual - 1 THEN {safe_mass('(mu * q)', 'alpha', 'k')} END), 0) AS f0 FROM nights CROSS JOIN k GROUP BY ALL)"""


@query(
    "a33_pit_and_coverage",
    with_sql(NIGHTS, _K, _CDFS)
    + """, u AS (SELECT *, (('0x' || substr(md5('pit|' || entity_id), 1, 8))::BIGINT % 2147483647) / 2147483647.0::DOUBLE AS draw FROM c), p AS (SELECT *, least(floor((f0 + draw * (f1 - f0)) * 10), 9) AS b FROM u)
    SELECT count(*) AS n, avg(CAST(f1 >= 0.25 AND f0 < 0.75 AS DOUBLE)) AS cov50, avg(CAST(f1 >= 0.10 AND f0 < 0.90 AS DOUBLE)) AS cov80, """
    + ", ".join(f"avg(CAST(b = {i} AS DOUBLE)) AS pit_{i}" for i in range(10))
    + " FROM p",
)
def a33(spark, d):
    n = nights(spark, d)
    return st.interval_coverage(n, [], cdf_at(F.col("actual")), cdf_at(F.col("actual") - 1.0), bs.uniform_draw("pit", F.col("entity_id")))


@query(
    "a25_lower_tail_calibration",
    with_sql(NIGHTS, _K, f"t AS (SELECT entity_id, actual, x, sum(CASE WHEN k <= x THEN {safe_mass('(mu * q)', 'alpha', 'k')} END) AS p FROM nights CROSS JOIN k CROSS JOIN (SELECT unnest([15, 20, 25]) AS x) WHERE line < 30 GROUP BY ALL)")
    + "SELECT CAST(x AS INTEGER) AS k, count(*) AS n, avg(p) AS predicted, avg(CAST(actual <= x AS DOUBLE)) AS observed FROM t GROUP BY 1",
)
def a25(spark, d):
    n = nights(spark, d)
    return st.tail_calibration(n, {k: cdf_at(F.lit(float(k))) for k in (15, 20, 25)}, "actual", F.col("line") < 30)


@query("f1_implied_count_mean")
def f1(spark, d):
    """Mean behind each pair's line and fair probability, inverted once per distinct pair."""
    p = pairs(spark, d).withColumns({"at": F.col("line") + 20.5, "alpha": F.lit(0.03), "prob": F.round("p_over", 6)})
    means = p.select("at", "prob", "alpha").distinct().withColumn("implied_mean", ds.invert_count_mean("at", "prob", "alpha"))
    return join_back(p, means, ["at", "prob", "alpha"]).select("event_id", "book", "line", "prob", "implied_mean")


@query(
    "f1_count_mean_round_trip",
    with_sql(PAIRS) + "SELECT event_id, book, line, round(p_over, 6) AS back FROM pairs",
)
def f1_back(spark, d):
    """Pricing at the implied mean gives the probability back."""
    p = f1(spark, d)
    one = ds.price_count_line(F.col("implied_mean") / (1 - 1e-6), F.lit(0.03), F.lit(1.0), F.col("line") + 20.5)
    return p.select("event_id", "book", "line", F.round(one["p_over"], 6).alias("back"))


@query(
    "f1_normal_mean_round_trip",
    with_sql(PAIRS) + "SELECT event_id, book, line, round(p_over, 6) AS back FROM pairs",
)
def f1_normal(spark, d):
    p = pairs(spark, d).withColumn("prob", F.round("p_over", 6))
    means = p.select("line", "prob").distinct().withColumn("mean", ds.invert_normal_mean(F.col("line"), F.col("prob"), 6.3454))
    out = p.join(means, ["line", "prob"])
    return out.select("event_id", "book", "line", F.round(ds.normal_cdf((F.col("mean") - F.col("line")) / 6.3454), 6).alias("back"))


@query(
    "f10_dispersion_grid",
    with_sql(NIGHTS, _K, "g AS (SELECT entity_id, mu * q AS mean, line, actual, unnest([0.0, 0.02, 0.05, 0.1])::DOUBLE AS alpha FROM nights)",
             f"m AS (SELECT entity_id, alpha, line, actual, 1 - sum({safe_mass('mean', 'alpha', 'k')}) AS p FROM g CROSS JOIN k WHERE k <= line GROUP BY ALL)")
    + ", s AS (SELECT alpha, avg(pow(p - CAST(actual > line AS INTEGER), 2)) AS brier, count(*) AS n FROM m GROUP BY 1) SELECT alpha, brier, n, CAST(brier = min(brier) OVER () AS INTEGER) AS locked FROM s",
)
def f10(spark, d):
    from pyspark.sql import Window

    g = nights(spark, d).withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in (0.0, 0.02, 0.05, 0.1)])))
    p = ds.price_count_line(F.col("mu"), F.col("alpha"), F.col("q"), F.col("line"))["p_over"]
    s = g.select("alpha", st.brier(p, (F.col("actual") > F.col("line")).cast("int")).alias("b")).groupBy("alpha").agg(F.avg("b").alias("brier"), F.count(F.lit(1)).alias("n"))
    # one row per declared grid value reaches this window
    return s.withColumn("locked", (F.col("brier") == F.min("brier").over(Window.partitionBy())).cast("int"))
