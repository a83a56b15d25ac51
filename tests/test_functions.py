"""Golden scalars and the traps of each expression."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from formbook.functions import distributions as ds
from formbook.functions import odds as O
from formbook.functions import shots as G
from formbook.functions import text as X


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("odds,prob", [(-110, 110 / 210), (105, 100 / 205), (-150, 0.6), (200, 1 / 3)])
def test_american_to_prob(spark, odds, prob):
    assert one(spark, O.american_to_prob(F.lit(odds))) == pytest.approx(prob)


def test_strict_prob_rejects_the_dead_zone(spark):
    assert one(spark, O.american_to_prob_strict(F.lit(50))) is None
    assert one(spark, O.american_to_prob(F.lit(None).cast("int"))) is None


@pytest.mark.parametrize("price,american", [(1.91, -110), (2.05, 105), (3.0, 200), (1.87, -115), (1.0, None)])
def test_decimal_to_american(spark, price, american):
    assert one(spark, O.decimal_to_american(F.lit(price))) == american


def test_truncating_converter_differs(spark):
    assert one(spark, O.decimal_to_american_truncated(F.lit(1.87))) == -114


@pytest.mark.parametrize("raw,problem", [("-110", ""), (None, ""), ("-50", "between -100 and 100"), ("text", "not numeric"), ("110.5", "not whole")])
def test_odds_problem(spark, raw, problem):
    assert one(spark, O.odds_problem(F.lit(raw).cast("string"))) == problem


def test_zero_ev_is_a_value_not_a_missing_price(spark):
    # fair coin at even money: EV exactly zero on both sides
    assert one(spark, O.recommendation(F.lit(0.5), F.lit(100), F.lit(100), 0.0)) == "UNDER"
    assert one(spark, O.best_ev(F.lit(0.0), F.lit(-0.2))) == 0.0


def test_probability_fallback_without_prices(spark):
    none = F.lit(None).cast("int")
    assert [one(spark, O.recommendation(F.lit(p), none, none, 0.12)) for p in (0.6, 0.5, 0.4)] == ["OVER", "NO BET", "UNDER"]


@pytest.mark.parametrize("side,line,actual,result", [("OVER", 25.5, 26.0, "WIN"), ("UNDER", 25.5, 26.0, "LOSS"), ("UNDER", 26.0, 26.0, "PUSH"), ("OVER", None, 3.0, None)])
def test_grade(spark, side, line, actual, result):
    assert one(spark, O.grade(F.lit(side), F.lit(line).cast("double"), F.lit(actual))) == result


def test_profit_with_fallback_price(spark):
    assert one(spark, O.profit(F.lit("WIN"), F.lit(None).cast("int"), F.lit(1.0))) == pytest.approx(100 / 110)
    assert one(spark, O.profit(F.lit("WIN"), F.lit(-150), F.lit(2.5))) == pytest.approx(2.5 * 100 / 150)
    assert one(spark, O.profit(F.lit("PUSH"), F.lit(-150), F.lit(2.5))) == 0.0


def test_half_even_rounding_to_half(spark):
    assert one(spark, O.nearest_half(F.lit(25.25))) == 25.0
    assert one(spark, O.nearest_half(F.lit(24.3))) == 24.5


def test_half_lines_survive_float_noise(spark):
    assert one(spark, O.is_half_line(F.lit(0.1 + 0.2 + 24.2))) is True
    assert one(spark, O.is_half_line(F.lit(25.0))) is False


def test_devig_sums_to_one(spark):
    a, b = one(spark, O.devig_american(F.lit(-115), F.lit(-105))), one(spark, O.devig_american(F.lit(-105), F.lit(-115)))
    assert a + b == pytest.approx(1.0)
    assert one(spark, O.devig_decimal(F.lit(0.0), F.lit(1.9))) is None


def test_safe_div(spark):
    assert one(spark, O.safe_div(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, O.safe_div(F.lit(float("inf")), F.lit(2.0))) is None


@pytest.mark.parametrize(
    "text,out",
    [("2025-12-04T22:30:00Z", "2025-12-04T22:30:00Z"), ("2025-12-04T22:30:00.123+00:00", "2025-12-04T22:30:00Z"),
     ("2025-12-04T17:30:00-05:00", "2025-12-04T22:30:00Z"), ("2025-12-04T22:30:00", "2025-12-04T22:30:00Z"), ("soon", None), ("2025", None), ("", None)],
)
def test_utc_text(spark, text, out):
    assert one(spark, X.utc_text(X.to_utc(F.lit(text)))) == out


def test_late_utc_game_keeps_its_eastern_date(spark):
    ts = F.lit("2025-01-11T02:00:00Z").cast("timestamp")
    assert one(spark, X.eastern_date(ts)) == dt.date(2025, 1, 10)
    anchor = one(spark, F.date_format(X.bettime_anchor(ts), "yyyy-MM-dd HH:mm"))
    assert anchor == "2025-01-10 22:30"
    matinee = F.lit("2025-01-10T18:00:00Z").cast("timestamp")
    assert one(spark, F.date_format(X.bettime_anchor(matinee), "yyyy-MM-dd HH:mm")) == "2025-01-10 17:30"


def test_names(spark):
    assert one(spark, X.plain_name(F.lit(" Söderblom "))) == "soderblom"
    assert one(spark, X.person_name(F.lit("J.T. O'Neil Jr. (G)"))) == "j t oneil"
    assert one(spark, X.last_name(F.lit("Cher"))) == "Cher"
    assert one(spark, X.plain_name(F.lit(None).cast("string"))) == ""
    assert one(spark, X.strip_accents(F.lit("étienne"))) == "etienne"


def test_clock_and_fraction(spark):
    assert one(spark, X.clock_minutes(F.lit("59:30"))) == 59.5
    assert one(spark, X.clock_minutes(F.lit("n/a"))) is None
    made, tried = X.fraction_parts(F.lit("12/x"))
    assert (one(spark, made), one(spark, tried)) == (0, 0)


def test_canonical_list_ignores_order(spark):
    assert one(spark, X.canonical_list(F.lit("totals, h2h,"))) == "h2h,totals"


def test_credit_cost_counts_distinct_markets(spark):
    assert one(spark, O.credit_cost(F.lit("h2h, h2h ,"), F.lit("us,eu"))) == 20


def test_season_bounds_are_inclusive(spark):
    day = F.lit("2024-07-31").cast("date")
    assert one(spark, X.season_label(day, X.SEASON_BOUNDS)) == "2023-24"
    assert one(spark, X.season_label(F.lit("2022-01-01").cast("date"), X.SEASON_BOUNDS)) == "other"


@pytest.mark.parametrize("x", [-6.0, -2.5, -0.4, 0.0, 0.3, 1.96, 5.5])
def test_normal_cdf(spark, x):
    assert one(spark, ds.normal_cdf(F.lit(x))) == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), abs=1e-15)


@pytest.mark.parametrize("p", [0.0001, 0.01, 0.3, 0.5, 0.97, 0.9999])
def test_normal_quantile_inverts(spark, p):
    z = one(spark, ds.normal_quantile(F.lit(p)))
    assert 0.5 * math.erfc(-z / math.sqrt(2)) == pytest.approx(p, abs=1e-14)


def _nb(k, mean, alpha):
    r = 1 / alpha
    return math.exp(math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) + r * math.log(r / (r + mean)) + k * math.log(mean / (r + mean)))


def test_count_price_against_closed_form(spark):
    df = spark.createDataFrame([(30.0, 0.03, 0.9, 26.0), (28.0, 0.0, 0.9, 24.5)], "mu double, a double, q double, line double")
    a, b = (r["p"] for r in df.select(ds.price_count_line("mu", "a", "q", "line").alias("p")).collect())
    assert a["p_under"] == pytest.approx(sum(_nb(k, 27.0, 0.03) for k in range(26)))
    assert a["p_push"] == pytest.approx(_nb(26, 27.0, 0.03))
    assert b["p_push"] == 0.0
    assert b["p_under"] == pytest.approx(sum(math.exp(-25.2 + k * math.log(25.2) - math.lgamma(k + 1)) for k in range(25)))


def test_count_price_has_no_cap_on_mean_or_line(spark):
    cases = [(100.0, 0.0, 90.5), (100.0, 0.0, 110.0), (1000.0, 0.0, 990.5), (1000.0, 0.02, 900.0), (30.0, 0.0, 200.5)]
    df = spark.createDataFrame([(i, 2 * m, a, at) for i, (m, a, at) in enumerate(cases)], "i int, mu double, a double, line double").coalesce(1)
    got = {r["i"]: r["p"] for r in df.select("i", ds.price_count_line("mu", "a", F.lit(0.5), "line").alias("p")).collect()}
    for i, (m, a, at) in enumerate(cases):
        mass = (lambda k: _nb(k, m, a)) if a else (lambda k: math.exp(-m + k * math.log(m) - math.lgamma(k + 1)))
        assert got[i]["p_under"] == pytest.approx(sum(mass(k) for k in range(math.ceil(at))), abs=1e-9)
        assert got[i]["p_push"] == pytest.approx(mass(int(at)) if at == int(at) else 0.0, abs=1e-9)
        assert got[i]["p_over"] + got[i]["p_under"] + got[i]["p_push"] == pytest.approx(1.0)
    assert got[0]["p_over"] == pytest.approx(0.82861, abs=1e-4)


def test_cut_mass_is_gated(spark):
    df = spark.createDataFrame([(30.0, 0.03, 0.9, 26.5), (90.0, 0.0, 0.9, 80.5), (None, 0.0, 0.9, 1.5)], "mu double, a double, q double, line double").coalesce(1)
    wide = df.select(ds.enough_mass(ds.price_count_line_capped("mu", "a", "q", "line", 200)["pmf_total"]).alias("t")).collect()
    assert [r["t"] is None or r["t"] >= 0.999 for r in wide] == [True] * 3 and wide[1]["t"] > 0.999
    with pytest.raises(Exception, match="cut to a mass"):
        df.select(ds.enough_mass(ds.price_count_line_capped("mu", "a", "q", "line")["pmf_total"]).alias("t")).collect()


def test_capped_form_drops_tail_mass_only(spark):
    df = spark.createDataFrame([(30.0, 0.03, 0.9, 26.5)], "mu double, a double, q double, line double")
    full = df.select(ds.price_count_line("mu", "a", "q", "line").alias("p")).first()["p"]
    cut = df.select(ds.price_count_line_capped("mu", "a", "q", "line").alias("p")).first()["p"]
    assert cut["p_under"] == pytest.approx(full["p_under"], abs=1e-5)
    assert cut["pmf_total"] <= 1.0 and cut["pmf_total"] > 0.999


def test_missing_inputs_price_to_null(spark):
    df = spark.createDataFrame([(None, 0.0, 0.9, 25.5), (30.0, 0.0, 0.9, 25.5)], "mu double, a double, q double, line double")
    got = [r["x"] for r in df.select(ds.price_count_line("mu", "a", "q", "line")["p_over"].alias("x")).collect()]
    assert got[0] is None and 0 < got[1] < 1


def test_implied_mean_prices_back(spark):
    df = spark.createDataFrame([(24.5, 0.47, 0.03), (30.5, 0.2, 0.0), (None, 0.5, 0.0)], "line double, p double, a double")
    rows = df.select("line", "p", "a", ds.invert_count_mean("line", "p", "a").alias("m")).collect()
    assert rows[2]["m"] is None
    back = spark.createDataFrame([tuple(r) for r in rows[:2]], "line double, p double, a double, m double")
    for r in back.select("p", ds.price_count_line("m", "a", F.lit(1.0), "line")["p_over"].alias("b")).collect():
        assert r["b"] == pytest.approx(r["p"], abs=1e-4)


def test_shot_geometry(spark):
    x, y = F.lit(80.0), F.lit(0.0)
    d, a = G.shot_distance(x, y), G.shot_angle(x, y)
    assert one(spark, d) == 9.0 and one(spark, a) == 0.0
    assert one(spark, G.danger_class(d, a)) == "high"
    assert one(spark, G.shot_angle(F.lit(95.0), F.lit(3.0))) == 90.0
    assert one(spark, G.expected_goal(F.lit(1.0), F.lit("tip"), F.lit("high"))) == pytest.approx(0.12 * math.exp(-1 / 30) * 2.5)
