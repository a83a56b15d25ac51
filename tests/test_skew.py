"""Split plans must give exactly what the plain plans give, with one key holding a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from formbook.operators import joins as jn
from formbook.operators import quotes as qt
from formbook.operators import skew
from formbook.operators import stats as st
from formbook.operators import windows as wn
from formbook.operators.skew import Running, SplitRule


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 600
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 12, n))
    day = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 40, n), unit="D")
    value = np.where(rng.random(n) < 0.1, np.nan, rng.normal(100, 15, n).round(2))
    return pd.DataFrame({"key": key, "day": day.date, "id": np.arange(n), "value": value})


@pytest.fixture(scope="module")
def df(spark, frame, tmp_path_factory):
    rows = [(int(k), d, int(i), None if np.isnan(v) else float(v)) for k, d, i, v in frame.itertuples(index=False)]
    path = str(tmp_path_factory.mktemp("skew") / "rows")
    spark.createDataFrame(rows, "key int, day date, id long, value double").write.parquet(path)
    return spark.read.parquet(path)


def rows_of(df, order="id"):
    return [tuple(r) for r in df.orderBy(order).collect()]


def same(a, b, order="id"):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    left, right = rows_of(a.select(*cols), order), rows_of(b.select(*cols), order)
    assert len(left) == len(right)
    for x, y in zip(left, right):
        for a_, b_ in zip(x, y):
            assert a_ == (pytest.approx(b_, rel=1e-9, abs=1e-9) if isinstance(a_, float) and isinstance(b_, float) else b_)


def test_hot_keys_finds_the_heavy_key_and_is_bounded(df, hot):
    keys = skew.hot_keys(df, ["key"], hot).collect()
    assert 0 in {r["key"] for r in keys}
    assert all(r['__rows'] >= hot.hot_rows for r in keys)


def test_small_plans_skip_the_count(df):
    assert skew.hot_keys(df, ["key"], SplitRule(hot_rows=1)) is None


def test_heavy_key_is_cut_into_blocks(df, hot):
    _, heavy = skew.split_hot(df, ["key"], [F.col("day"), F.col("id")], hot)
    sizes = heavy.where("key = 0").groupBy("__block").count().collect()
    assert len(sizes) >= 4
    assert max(r["count"] for r in sizes) < heavy.where("key = 0").count() / 2


@pytest.mark.parametrize("prior", [False, True])
def test_running_matches_plain_windows(df, hot, prior):
    aggs = {
        "s": Running("sum", F.col("value")), "n": Running("count", F.col("value")), "lo": Running("min", F.col("value")),
        "hi": Running("max", F.col("value")), "last": Running("last", F.col("value")),
    }
    order = [F.col("day"), F.col("id")]
    same(skew.running(df, ["key"], order, aggs, prior, hot), skew.running(df, ["key"], order, aggs, prior))


def test_running_over_the_whole_table(df, hot):
    aggs = {"s": Running("sum", F.col("value")), "n": Running("count", F.lit(1))}
    order = [F.col("day"), F.col("id")]
    same(skew.running(df, [], order, aggs, rule=hot), skew.running(df, [], order, aggs))


@pytest.mark.parametrize("rule_name", ["plain", "hot"])
def test_prior_rolling_against_pandas(frame, df, hot, rule_name):
    rule = hot if rule_name == "hot" else skew.DEFAULT_RULE
    out = wn.prior_rolling(df, ["key"], ["day", "id"], ["value"], (3, 10), rule=rule)
    got = out.select("id", "value_rolling_3", "value_rolling_std_10").toPandas().set_index("id").sort_index()
    ordered = frame.sort_values(["key", "day", "id"])
    g = ordered.groupby("key")["value"]
    mean3 = g.transform(lambda s: s.shift(1).rolling(3, min_periods=1).mean())
    std10 = g.transform(lambda s: s.shift(1).rolling(10, min_periods=1).std())
    want = pd.DataFrame({"id": ordered["id"], "m": mean3, "s": std10}).set_index("id").sort_index()
    np.testing.assert_allclose(got["value_rolling_3"].astype(float), want["m"], rtol=1e-9)
    np.testing.assert_allclose(got["value_rolling_std_10"].astype(float), want["s"], rtol=1e-7, atol=1e-7)


def test_prior_features_do_not_see_the_row_itself(df, hot):
    changed = df.withColumn("value", F.when(F.col("id") == 300, F.lit(1e6)).otherwise(F.col("value")))
    a = wn.prior_rolling(df, ["key"], ["day", "id"], ["value"], (5,), rule=hot)
    b = wn.prior_rolling(changed, ["key"], ["day", "id"], ["value"], (5,), rule=hot)
    row = df.where("id = 300").first()
    earlier = (F.col("key") != row["key"]) | (F.col("day") < row["day"]) | ((F.col("day") == row["day"]) & (F.col("id") <= 300))
    same(a.where(earlier).drop("value"), b.where(earlier).drop("value"))


def test_prior_expanding_hot_equals_plain(df, hot):
    a = wn.prior_expanding(df, ["key"], ["day", "id"], "value", "v", rule=hot)
    b = wn.prior_expanding(df, ["key"], ["day", "id"], "value", "v")
    x = a.select("id", "v_avg", "v_games_prior", F.round("v_std", 6).alias("v_std"))
    same(x, b.select("id", "v_avg", "v_games_prior", F.round("v_std", 6).alias("v_std")))


@pytest.mark.parametrize("rule_name", ["plain", "hot"])
def test_prior_ema_against_pandas(frame, df, hot, rule_name):
    rule = hot if rule_name == "hot" else skew.DEFAULT_RULE
    out = wn.prior_ema(df, ["key"], ["day", "id"], "value", 5, rule=rule)
    got = out.select("id", "value_ema5").toPandas().set_index("id").sort_index()["value_ema5"].astype(float)
    ordered = frame.sort_values(["key", "day", "id"])
    ema = ordered.groupby("key")["value"].transform(lambda s: s.ewm(span=5, adjust=False).mean().shift(1))
    want = pd.Series(ema.to_numpy(), index=ordered["id"]).sort_index()
    np.testing.assert_allclose(got, want, rtol=1e-9)


@pytest.mark.parametrize("rule_name", ["plain", "hot"])
def test_prior_ema_across_a_gap_longer_than_its_frame(spark, hot, rule_name):
    rule = hot if rule_name == "hot" else skew.DEFAULT_RULE
    values = [None] * 2 + [float(i * 37 % 11) for i in range(60)] + [None] * 300 + [5.0, 8.0] + [None] * 3
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "key string, id int, value double")
    got = wn.prior_ema(df, ["key"], ["id"], "value", 5, rule=rule).toPandas().set_index("id").sort_index()["value_ema5"].astype(float)
    want = pd.Series(values, dtype=float).ewm(span=5, adjust=False).mean().shift(1)
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_rest_days_and_lag_hot_equals_plain(df, hot):
    same(wn.rest_days(df, ["key"], ["day", "id"], "day", fill=7, rule=hot), wn.rest_days(df, ["key"], ["day", "id"], "day", fill=7))
    same(jn.next_row(df, ["key"], ["day", "id"], ["value"], rule=hot), jn.next_row(df, ["key"], ["day", "id"], ["value"]))


def test_exact_percentiles_against_numpy(frame, df):
    got = {r["key"]: (r["p10"], r["p50"]) for r in skew.exact_percentiles(df, ["key"], "value", {"p10": 0.1, "p50": 0.5}).collect()}
    for key, g in frame.groupby("key"):
        assert got[key] == pytest.approx(tuple(np.nanpercentile(g["value"], [10, 50])))
    assert skew.exact_percentiles(df, [], "value", {"p": 0.37}).first()["p"] == pytest.approx(np.nanpercentile(frame["value"], 37))
    assert skew.exact_percentiles(df.limit(0), [], "value", {"p": 0.37}).collect() == [(None,)]
    assert skew.exact_percentiles(df.limit(0), ["key"], "value", {"p": 0.37}).collect() == []


def test_exact_percentiles_of_awkward_values(spark):
    rng = np.random.default_rng(8)
    groups = {
        "tiny": rng.normal(0, 1e-12, 400), "huge": rng.normal(0, 1e200, 400), "close": 1e9 + rng.random(4000) * 1e-3, "mixed": np.concatenate([rng.normal(0, 1, 99), [1e308, -1e308, 0.0, -0.0]]),
        "one": np.array([3.25]), "same": np.full(50, -7.5), "two": np.array([1.0, 2.0]),
    }
    df = spark.createDataFrame([(k, float(v)) for k, g in groups.items() for v in g] + [(None, 1.0), ("one", None)], "k string, v double")
    probs = {"a": 0.0, "b": 0.025, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r["k"]: [r[n] for n in probs] for r in skew.exact_percentiles(df, ["k"], "v", probs).collect()}
    assert set(got) == set(groups)
    for k, g in groups.items():
        np.testing.assert_allclose(got[k], np.percentile(g, [100 * p for p in probs.values()]), rtol=1e-12, atol=0 if k == "tiny" else 1e-12)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_back_slices_heavy_and_null_keys(spark, df, hot, how):
    rows = df.withColumn("key", F.when(F.col("id") % 5 != 0, F.col("key")))
    facts = df.groupBy("key").agg(F.sum("value").alias("total")).where("key <> 3")
    facts = facts if how in ("inner", "left") else facts.select("key")
    same(skew.join_back(rows, facts, ["key"], how, hot), rows.join(facts, "key", how))


def test_asof_against_pandas(spark, hot):
    rng = np.random.default_rng(5)
    left = pd.DataFrame({"k": np.where(rng.random(300) < 0.5, 0, rng.integers(1, 6, 300)), "t": rng.integers(0, 1000, 300), "ask": np.arange(300)})
    right = pd.DataFrame({"k": np.where(rng.random(400) < 0.5, 0, rng.integers(1, 6, 400)), "t": rng.permutation(1000)[:400], "v": np.arange(400)})
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("t"), on="t", by="k").set_index("ask").sort_index()["v"]
    for rule in (hot, skew.DEFAULT_RULE):
        out = jn.asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", "t", ["v"], ["v"], ["ask"], rule=rule)
        got = out.select("ask", "asof_v").toPandas().set_index("ask").sort_index()["asof_v"]
        np.testing.assert_array_equal(got.astype(float), want.astype(float))


def test_ladder_clip_is_monotone_on_a_heavy_ladder(df, hot):
    out = wn.forward_min_clip(df.where("value is not null"), ["key"], ["id"], "value", "clipped", hot)
    rows = out.where("key = 0").orderBy("id").select("clipped").collect()
    values = [r[0] for r in rows]
    assert values == sorted(values, reverse=True)


def test_auc_is_the_same_with_split_scores(df, hot):
    scored = df.where("value is not null").withColumns({"y": (F.col("id") % 3 == 0).cast("int"), "s": F.round("value")})
    assert st.roc_auc(scored, [], "s", "y", hot).first()["auc"] == pytest.approx(st.roc_auc(scored, [], "s", "y").first()["auc"])


def test_evenly_spaced_keeps_first_and_last(df, hot):
    ids = {r["id"] for r in wn.evenly_spaced(df, ["id"], 7, hot).collect()}
    assert len(ids) == 7 and {0, 599} <= ids


def test_leave_one_out_and_group_context_against_pandas(frame, df):
    got = qt.leave_one_out(df, ["key"], "value", "peer").select("id", "peer").toPandas().set_index("id").sort_index()["peer"].astype(float)
    g = frame.groupby("key")["value"]
    own = frame["value"].notna().astype(int)
    want = (g.transform("sum") - frame["value"].fillna(0)) / (g.transform("count") - own)
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_group_totals_take_either_plan(df, hot):
    rows = df.withColumn("key", F.when(F.col("id") % 7 != 0, F.col("key")))
    totals = {"s": F.sum("value"), "n": F.count(F.lit(1)), "newest": F.max_by("value", F.struct("day", "id"))}
    same(skew.with_group_totals(rows, ["key"], totals, hot), skew.with_group_totals(rows, ["key"], totals))


def test_summaries_against_pandas(frame, df):
    out = skew.summarise(df, ["key"], "value", {"p50": 0.5}, {"n": F.count(F.lit(1)), "mean": F.avg("value")}).toPandas().set_index("key").sort_index()
    g = frame.groupby("key")["value"]
    np.testing.assert_allclose(out["p50"], g.median(), rtol=1e-12)
    np.testing.assert_allclose(out["mean"], g.mean(), rtol=1e-12)
    assert out["n"].tolist() == g.size().tolist()


@pytest.mark.parametrize("rule_name", ["plain", "hot"])
def test_spread_of_values_far_from_zero(frame, df, hot, rule_name):
    rule = hot if rule_name == "hot" else skew.DEFAULT_RULE
    far = df.withColumn("value", F.col("value") / 1e4 + 1e9)
    out = wn.prior_expanding(far, ["key"], ["day", "id"], "value", "v", rule=rule)
    got = out.select("id", "v_avg", "v_std").toPandas().set_index("id").sort_index().astype(float)
    ordered = frame.assign(value=frame["value"] / 1e4).sort_values(["key", "day", "id"])
    prior = ordered.groupby("key")["value"].transform(lambda s: s.shift(1).expanding(2).std(ddof=0))
    np.testing.assert_allclose(got["v_std"], pd.Series(prior.to_numpy(), ordered["id"]).sort_index(), rtol=1e-3)
    daily = wn.prior_league(far, [], "day", "value").toPandas().sort_values("league_date")
    days = [frame[frame["day"] < d]["value"].dropna() / 1e4 for d in daily["league_date"]]
    np.testing.assert_allclose(daily["prior_std"].astype(float), [d.std(ddof=0) if len(d) else 0.0 for d in days], rtol=1e-3)


def test_any_number_of_heavy_keys(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(30_000).select((F.col("id") % 1500).alias("key"), "id").write.parquet(path)
    df = spark.read.parquet(path)
    rule = SplitRule(hot_rows=20, block_rows=4000, check_bytes=0)
    assert skew.hot_keys(df, ["key"], rule).count() == 1500
    assert skew.row_numbers(df, ["key"], [F.col("id")], rule=rule).where("rn <> id DIV 1500 + 1").count() == 0


def test_rows_made_by_explode_are_seen(df):
    many = df.select("key", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("n"))
    assert not skew.small_enough(many, 256 << 20) and skew.small_enough(df, 256 << 20)
