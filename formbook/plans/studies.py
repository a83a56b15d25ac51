"""B, O4: splits, sweeps and studies composed from the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from formbook.functions import odds as O
from formbook.functions.odds import devig_decimal
from formbook.operators import backtest as bt
from formbook.operators import bootstrap as bs
from formbook.operators import crossline as cl
from formbook.operators import joins as jn
from formbook.operators import quotes as qt
from formbook.operators import stats as st
from formbook.operators import windows as wn
from formbook.operators.windows import forward_min_clip
from formbook.plans.frames import BET_ID, BETS, FORM, PAIRS, QUOTE_POSITION, QUOTES, SNAPSHOTS, bets, decimal_sql, form, prob_sql, quotes, snapshots, table, with_sql
from formbook.plans.joins import _CLOSING, closing
from formbook.plans.pricing import mixture_price, nights, toi_bins
from formbook.plans.quotes import pairs
from formbook.plans.registry import query
from formbook.plans.resampling import CI_SQL, RESAMPLES, draws_sql

SEASONS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]
BOUNDS = [("train", "1995-01-01", "1999-12-31"), ("val", "2000-01-01", "2000-12-31"), ("test", "2001-01-01", "2001-12-31")]
SPLIT_SQL = "CASE WHEN {d} <= DATE '1999-12-31' THEN 'train' WHEN {d} <= DATE '2000-12-31' THEN 'val' ELSE 'test' END"
CUTS = [("train", 0.6), ("val", 0.8), ("test", 1.0)]
PO, PU = prob_sql("odds_over"), prob_sql("odds_under")


@query(
    "b1_date_split",
    with_sql(FORM) + f"SELECT {SPLIT_SQL.format(d='game_date')} AS split, count(*) AS n_rows, min(game_date) AS first_date, max(game_date) AS last_date FROM form GROUP BY 1",
)
def b1(spark, d):
    return bt.split_report(bt.date_split(form(spark, d), "game_date", BOUNDS), "game_date")


@query(
    "b2_fraction_split_by_date",
    with_sql(FORM)
    + """, t AS (SELECT game_date, count(*) AS n FROM form GROUP BY 1), s AS (SELECT game_date, (sum(n) OVER (ORDER BY game_date) - n) / sum(n) OVER () AS share FROM t)
    SELECT CASE WHEN share < 0.6 THEN 'train' WHEN share < 0.8 THEN 'val' ELSE 'test' END AS split, count(*) AS n_rows, min(game_date) AS first_date, max(game_date) AS last_date FROM form JOIN s USING (game_date) GROUP BY 1""",
)
def b2(spark, d):
    return bt.split_report(bt.fraction_split(form(spark, d), "game_date", CUTS), "game_date")


@query(
    "b2_fraction_split_by_row",
    with_sql(FORM)
    + """, r AS (SELECT *, row_number() OVER (ORDER BY game_date, game_id) AS rn, count(*) OVER () AS n FROM form)
    SELECT game_id, CASE WHEN rn <= floor(n * 0.6) THEN 'train' WHEN rn <= floor(n * 0.8) THEN 'val' ELSE 'test' END AS split FROM r""",
)
def b2_rows(spark, d):
    return bt.fraction_split_rows(form(spark, d), ["game_date", "game_id"], CUTS).select("game_id", "split")


@query(
    "b3_walk_forward_folds",
    with_sql(FORM)
    + """, t AS (SELECT unnest([1996, 1997, 1998, 1999, 2000, 2001]) AS t) SELECT 'test_' || t AS fold, CASE WHEN season = t THEN 'test' ELSE 'train' END AS role, count(*) AS n_rows, sum(value) AS total FROM form JOIN t ON season <= t GROUP BY ALL""",
)
def b3(spark, d):
    f = bt.walk_forward(form(spark, d), "season", SEASONS)
    return f.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("total"))


@query(
    "b4_rolling_origin",
    with_sql(FORM)
    + """, t AS (SELECT unnest([1996, 1997, 1998, 1999, 2000, 2001]) AS t), e AS (SELECT t, max(game_date) AS last FROM form JOIN t ON season < t GROUP BY 1)
    SELECT 'test_' || t AS fold, CASE WHEN season = t THEN 'test' WHEN game_date > last - 60 THEN 'val' ELSE 'train' END AS role, count(*) AS n_rows, max(game_date) AS last_date FROM form JOIN e ON season <= t GROUP BY ALL""",
)
def b4(spark, d):
    f = bt.rolling_origin(form(spark, d), "season", "game_date", SEASONS, 60)
    return f.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n_rows"), F.max("game_date").alias("last_date"))


GRID = [0.0, 0.02, 0.04, 0.06, 0.08, 0.10, 0.12]


def decided_sql(grid=GRID):
    return f"""t AS (SELECT unnest({grid})::DOUBLE AS threshold),
  ev AS (SELECT bets.*, threshold, p_over - {PO} AS ev_o, p_under - {PU} AS ev_u FROM bets CROSS JOIN t),
  ch AS (SELECT *, CASE WHEN ev_o >= threshold AND ev_o > ev_u THEN 'OVER' WHEN ev_u >= threshold THEN 'UNDER' END AS bet FROM ev),
  gd AS (SELECT *, CASE WHEN bet IS NULL THEN NULL WHEN actual = line THEN 'PUSH' WHEN (bet = 'OVER') = (actual > line) THEN 'WIN' ELSE 'LOSS' END AS res, CASE bet WHEN 'OVER' THEN odds_over ELSE odds_under END AS bo FROM ch),
  decided AS (SELECT *, CAST(CASE res WHEN 'WIN' THEN {decimal_sql('bo')} - 1 WHEN 'LOSS' THEN -1 WHEN 'PUSH' THEN 0 END AS DOUBLE) AS pr FROM gd)"""


FOLD_SQL = """count(*) AS n_rows, count(*) FILTER (res IN ('WIN', 'LOSS')) AS bets, count(*) FILTER (res = 'PUSH') AS pushes, avg(CAST(res = 'WIN' AS DOUBLE)) FILTER (res IN ('WIN', 'LOSS')) AS hit_rate,
  coalesce(sum(pr) FILTER (res IN ('WIN', 'LOSS')), 0) AS profit_total, coalesce(sum(pr) FILTER (res IN ('WIN', 'LOSS')) / nullif(count(*) FILTER (res IN ('WIN', 'LOSS')), 0) * 100, 0) AS roi, count(*) FILTER (res IN ('WIN', 'LOSS')) * 100.0::DOUBLE / count(*) AS bet_rate"""


@query("b5_threshold_sweep", with_sql(BETS, decided_sql()) + f"SELECT threshold, {FOLD_SQL} FROM decided GROUP BY 1")
def b5(spark, d):
    return bt.threshold_sweep(bets(spark, d), GRID)


@query(
    "b5_threshold_selection",
    with_sql(BETS, decided_sql(), f"s AS (SELECT book, threshold, {FOLD_SQL} FROM decided GROUP BY ALL)",
             "k AS (SELECT *, CAST(CASE WHEN bet_rate BETWEEN 15 AND 35 THEN 2 WHEN bet_rate BETWEEN 10 AND 40 THEN 1 ELSE 0 END AS INTEGER) AS band FROM s)")
    + "SELECT book, threshold, bets, bet_rate, roi, band FROM k QUALIFY row_number() OVER (PARTITION BY book ORDER BY band DESC, roi DESC, threshold) = 1",
)
def b5_best(spark, d):
    return bt.best_threshold(bt.threshold_sweep(bets(spark, d), GRID, ["book"]), ["book"])


def policies_sql():
    rows = ", ".join(f"('{p.name}', '{p.family}', {p.min_score}::DOUBLE, {p.min_novig}::DOUBLE, {str(p.line_shop).lower()})" for p in bt.policy_grid())
    ids = ", ".join(BET_ID)
    return f"""pol(policy, family, min_score, min_novig, shop) AS (VALUES {rows}),
  sides AS (SELECT bets.*, 'OVER' AS bet, 1 AS rk, p_over * (CASE WHEN odds_over <= -100 THEN 100.0 / -odds_over ELSE odds_over / 100.0 END) - p_under AS true_ev, p_over - {PO} AS prob_edge, p_over / (p_over + p_under) - {PO} / ({PO} + {PU}) AS novig, odds_over AS bo FROM bets
    UNION ALL SELECT bets.*, 'UNDER', 0, p_under * (CASE WHEN odds_under <= -100 THEN 100.0 / -odds_under ELSE odds_under / 100.0 END) - p_over, p_under - {PU}, p_under / (p_under + p_over) - {PU} / ({PU} + {PO}), odds_under FROM bets),
  cand AS (SELECT *, CASE WHEN family = 'probability_edge' THEN prob_edge ELSE true_ev END AS score FROM sides CROSS JOIN pol),
  pick AS (SELECT * FROM cand WHERE score >= min_score AND novig >= min_novig QUALIFY row_number() OVER (PARTITION BY policy, {ids} ORDER BY score DESC, true_ev DESC, prob_edge DESC, rk DESC) = 1),
  shopped AS (SELECT * FROM pick WHERE NOT shop UNION ALL SELECT * FROM (SELECT * FROM pick WHERE shop QUALIFY row_number() OVER (PARTITION BY policy, game_id ORDER BY true_ev DESC, score DESC, novig DESC, {', '.join(c + ' DESC' for c in BET_ID)}) = 1)),
  pg AS (SELECT *, CASE WHEN actual = line THEN 'PUSH' WHEN (bet = 'OVER') = (actual > line) THEN 'WIN' ELSE 'LOSS' END AS res FROM shopped),
  graded AS (SELECT *, CAST(CASE res WHEN 'WIN' THEN {decimal_sql('bo')} - 1 WHEN 'LOSS' THEN -1 ELSE 0 END AS DOUBLE) AS pr FROM pg)"""


POLICY_SUMMARY = """count(*) AS bets, count(*) FILTER (res = 'WIN') AS wins, count(*) FILTER (res = 'LOSS') AS losses, count(*) FILTER (res = 'PUSH') AS pushes, coalesce(count(*) FILTER (res = 'WIN') / nullif(count(*) FILTER (res IN ('WIN', 'LOSS')), 0), 0.0) AS win_rate,
  sum(pr) AS profit_total, CAST(count(*) AS DOUBLE) AS units, sum(pr) / count(*) * 100 AS roi"""


def policy_choices(spark, d):
    return bt.grade_choices(bt.apply_policies(bets(spark, d), bt.policy_grid(), BET_ID, ["game_id"]))


@query("b6_policy_grid", with_sql(BETS, policies_sql()) + f"SELECT policy, {SPLIT_SQL.format(d='bet_date')} AS split, {POLICY_SUMMARY} FROM graded GROUP BY ALL")
def b6(spark, d):
    g = bt.date_split(policy_choices(spark, d), "bet_date", BOUNDS)
    return bt.policy_report(g, ["policy", "split"])


@query(
    "b6_policy_selected_on_val",
    with_sql(BETS, policies_sql(), f"s AS (SELECT policy, {SPLIT_SQL.format(d='bet_date')} AS split, {POLICY_SUMMARY} FROM graded GROUP BY ALL)",
             "w AS (SELECT policy FROM s WHERE split = 'val' AND bets >= 100 ORDER BY roi DESC, policy LIMIT 1)")
    + "SELECT policy, split, bets, roi FROM s JOIN w USING (policy)",
)
def b6_selected(spark, d):
    """The policy with the best validation ROI, reported on every split."""
    r = b6(spark, d)
    val = r.where("split = 'val' and bets >= 100")
    win = val.orderBy(F.desc("roi"), "policy").limit(1).select("policy")  # one row
    return r.join(F.broadcast(win), "policy").select("policy", "split", "bets", "roi")


@query(
    "b7_fold_evaluation",
    with_sql(BETS, decided_sql([0.02]), f"f AS (SELECT *, {SPLIT_SQL.format(d='bet_date')} AS split FROM decided)",
             "per AS (SELECT split, game_id, sum(pr) AS num, count(*)::DOUBLE AS den FROM f WHERE res IN ('WIN', 'LOSS') GROUP BY ALL)", draws_sql("per", "game_id", "fold"))
    + f""", reps AS (SELECT split, resample, sum(w * num) / nullif(sum(w * den), 0) * 100 AS s FROM weighted GROUP BY ALL), ci AS (SELECT split, {CI_SQL} FROM reps GROUP BY 1),
    s AS (SELECT split, {FOLD_SQL} FROM f GROUP BY 1) SELECT split, n_rows, bets, pushes, hit_rate, profit_total, roi, bet_rate, lower, upper FROM s JOIN ci USING (split)""",
)
def b7(spark, d):
    g = bt.date_split(bt.decide_and_grade(bets(spark, d), F.lit(0.02)), "bet_date", BOUNDS)
    decided = g.where(F.col("bet_result").isin("WIN", "LOSS"))
    ci = bs.cluster_bootstrap(decided, ["game_id"], F.col("bet_profit"), F.lit(1.0), RESAMPLES, "fold", ["split"], 100.0)
    return bt.fold_summary(g, ["split"]).join(ci.select("split", "lower", "upper"), "split")


@query(
    "b8_season_multibook_frame",
    with_sql(QUOTES, """first AS (SELECT * FROM quotes QUALIFY quote_date = min(quote_date) OVER (PARTITION BY event_id, book, line, side)),
    s AS (SELECT event_id, book, line, arg_min(price, (src, seq, venue, price)) FILTER (side = 'Over') AS price_over, arg_min(price, (src, seq, venue, price)) FILTER (side = 'Under') AS price_under, min(quote_date) AS day FROM first GROUP BY ALL),
    p AS (SELECT *, (1 / price_over) / (1 / price_over + 1 / price_under) AS p_over FROM s WHERE price_over IS NOT NULL AND price_under IS NOT NULL),
    f AS (SELECT o_custkey AS event_id, CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS value FROM orders GROUP BY ALL), t(r, off) AS (VALUES (0, 0), (1, -1), (2, 1)),
    m AS (SELECT p.event_id, book, line, arg_min(value, r) AS matched_value FROM p CROSS JOIN t JOIN f ON f.event_id = p.event_id AND f.day = p.day + off GROUP BY ALL)""")
    + """SELECT p.event_id, p.book, p.line, p_over, matched_value, CAST(p_size % 5 > p.line AS INTEGER) AS over_hit, p_size % 5 - p.line AS line_margin FROM p LEFT JOIN m ON m.event_id = p.event_id AND m.book = p.book AND m.line = p.line JOIN part ON p_partkey = p.event_id""",
)
def b8(spark, d):
    """First quotes per side, paired, matched to outcomes and labelled: one row per (event, book, line)."""
    from formbook.operators.features import targets

    key = ["event_id", "book", "line"]
    first = qt.earliest_snapshot(quotes(spark, d), [*key, "side"], "quote_date")
    days = first.groupBy(*key).agg(F.min("quote_date").alias("day"))
    p = qt.paired(first, key, "side", "price", QUOTE_POSITION).join(days, key)
    facts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("event_id"), F.to_date("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("value"))
    dated = jn.tolerant_date_join(p, facts, ["event_id"], "day", ["value"], key)
    outcome = table(spark, d, "part").select(F.col("p_partkey").alias("event_id"), (F.col("p_size") % 5).alias("actual"))
    out = targets(dated.join(outcome, "event_id"), "actual", "line")
    return out.select(*key, "p_over", "matched_value", "over_hit", "line_margin")


@query(
    "b9_cross_line_pricing",
    with_sql(PAIRS)
    + """, loo AS (SELECT *, sum(line) OVER w AS s, count(line) OVER w AS c FROM pairs WINDOW w AS (PARTITION BY event_id)),
    gap AS (SELECT *, (s - line) / (c - 1) - line AS line_gap FROM loo WHERE c > 1),
    flag AS (SELECT *, CASE WHEN line_gap >= 1 THEN 'OVER' WHEN line_gap <= -1 THEN 'UNDER' END AS flagged FROM gap),
    cl AS (SELECT event_id, line, avg(p_over) AS closing_p FROM pairs GROUP BY ALL),
    j AS (SELECT flagged, CASE WHEN flagged = 'OVER' THEN closing_p - p_over ELSE p_over - closing_p END AS clv, CAST(p_size % 5 AS DOUBLE) AS actual, line FROM flag JOIN cl USING (event_id, line) JOIN part ON p_partkey = event_id WHERE flagged IS NOT NULL)
    SELECT flagged, count(*) AS n_flagged, avg(clv) AS mean_clv, avg(CAST((flagged = 'OVER') = (actual > line) AS DOUBLE)) FILTER (actual <> line) AS hit_rate FROM j GROUP BY 1""",
)
def b9(spark, d):
    """A quote whose line sits a full unit from the other quotes' mean line, and what became of it."""
    p = pairs(spark, d)
    gap = F.col("peer_line") - F.col("line")
    flagged = F.when(gap >= 1, F.lit("OVER")).when(gap <= -1, F.lit("UNDER"))
    rows = qt.leave_one_out(p, ["event_id"], "line", "peer_line").withColumn("flagged", flagged).where("flagged is not null")
    close = p.groupBy("event_id", "line").agg(F.avg("p_over").alias("closing_p"))
    outcome = table(spark, d, "part").select(F.col("p_partkey").alias("event_id"), (F.col("p_size") % 5).cast("double").alias("actual"))
    j = rows.join(close, ["event_id", "line"]).join(outcome, "event_id")
    move = F.col("closing_p") - F.col("p_over")
    won = (F.col("flagged") == "OVER") == (F.col("actual") > F.col("line"))
    return j.groupBy("flagged").agg(
        F.count(F.lit(1)).alias("n_flagged"), F.avg(F.when(F.col("flagged") == "OVER", move).otherwise(-move)).alias("mean_clv"),
        F.avg(F.when(F.col("actual") != F.col("line"), won.cast("double"))).alias("hit_rate"),
    )


_PANEL_KEY = ["event_id", "book", "pass"]


def two_passes(spark, d):
    """All quotes of four books in a betting-time and a closing pass, and the newest of each event, book and pass."""
    quoted = table(spark, d, "lineitem").select(
        F.floor(F.col("l_partkey") / 4).alias("event_id"), (F.col("l_suppkey") % 4).cast("int").alias("book"), F.floor(F.col("l_quantity") / 25).cast("double").alias("line"),
        F.when(F.col("l_returnflag") == "R", F.lit("closing")).otherwise(F.lit("bettime")).alias("pass"), F.col("l_shipdate").alias("seen"), F.lit(None).cast("timestamp").alias("requested"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (1.5 + 10 * F.col("l_tax")).alias("price_over"), (1.6 + 5 * F.col("l_discount")).alias("price_under"),
    )
    return quoted, wn.latest_version(quoted, _PANEL_KEY, "seen", "requested", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


@query("b9_cross_line_value")
def b9_value(spark, d):
    """Quotes worth a bet by what the other books' lines imply at the quote's own line, with their outcome and closing-line value, by side."""
    _, newest = two_passes(spark, d)
    rows = newest.withColumn("line", F.col("line") + 20.5)
    early, late = rows.where("pass = 'bettime'"), rows.where("pass = 'closing'")
    outcome = table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 4).alias("event_id")).agg((F.max("p_size") % 15 + 14).cast("double").alias("actual"))
    flagged = cl.flag_bets(cl.cross_line(early, ["event_id"], "line", "price_over", "price_under", alpha=0.03), 0.03)
    graded = cl.graded(flagged, cl.closing_at_line(late, ["event_id"], "line", "price_over", "price_under"), outcome, ["event_id"], "line")
    return cl.value_report(graded, ["bet_side"])


PANEL = """quotes_seen AS (
  SELECT l_partkey // 4 AS event_id, CAST(l_suppkey % 4 AS INTEGER) AS book, floor(l_quantity / 25) AS line, CASE WHEN l_returnflag = 'R' THEN 'closing' ELSE 'bettime' END AS pass,
    l_shipdate AS seen, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, (1 / (1.6 + 5 * l_discount)) / (1 / (1.5 + 10 * l_tax) + 1 / (1.6 + 5 * l_discount)) AS p_under
  FROM lineitem),
panel AS (SELECT * FROM quotes_seen QUALIFY row_number() OVER (PARTITION BY event_id, book, pass ORDER BY seen DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1),
ties AS (SELECT count(*) AS n_tied FROM (SELECT count(*) AS n, rank() OVER (PARTITION BY event_id, book, pass ORDER BY seen DESC) AS r FROM quotes_seen GROUP BY event_id, book, pass, seen) WHERE r = 1 AND n > 1),
peers AS (SELECT event_id, line, median(p_under) AS consensus, count(DISTINCT book) AS n_books FROM panel WHERE pass = 'bettime' AND book <> 0 GROUP BY ALL),
universe AS (
  SELECT b.event_id, coalesce(n_books, 0) >= 2 AS gated, c.line AS closing_line, b.line = c.line AS same, b.p_under - consensus AS deviation, c.p_under - b.p_under AS reversion
  FROM panel b LEFT JOIN peers p ON p.event_id = b.event_id AND p.line = b.line LEFT JOIN panel c ON c.event_id = b.event_id AND c.book = 0 AND c.pass = 'closing' WHERE b.pass = 'bettime' AND b.book = 0),
prime AS (SELECT event_id, deviation AS x, reversion AS y FROM universe WHERE gated AND same)"""


@query(
    "b10_convergence_study",
    with_sql(PANEL, "per AS (SELECT event_id, count(*)::DOUBLE AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(y * y) AS yy, sum(x * y) AS xy FROM prime GROUP BY 1)", draws_sql("per", "event_id", "converge"))
    + f""", t AS (SELECT resample, sum(w * n) AS n, sum(w * x) AS x, sum(w * y) AS y, sum(w * xx) AS xx, sum(w * yy) AS yy, sum(w * xy) AS xy FROM weighted GROUP BY 1),
    reps AS (SELECT CASE WHEN n * xx - x * x > 0 AND n * yy - y * y > 0 THEN (n * xy - x * y) / sqrt((n * xx - x * x) * (n * yy - y * y)) END AS s FROM t), ci AS (SELECT {CI_SQL} FROM reps),
    f AS (SELECT count(*) AS n_total, count(*) FILTER (NOT gated) AS n_few_books, count(*) FILTER (gated AND closing_line IS NULL) AS n_no_closing, count(*) FILTER (gated AND NOT same) AS n_line_changed FROM universe),
    e AS (SELECT count(*) AS n_primary, corr(x, y) AS r, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM prime)
    SELECT f.*, e.*, n_tied, lower, upper, CASE WHEN n_degenerate / {RESAMPLES}.0 > 0.01 THEN 'UNSTABLE' WHEN upper < 0 THEN 'PASS' ELSE 'CLOSED' END AS verdict FROM f, e, ties, ci""",
)
def b10(spark, d):
    """Does a lone book's deviation from the median of at least two others, at its own line, revert by the closing pass?

    One quote per event, book and pass: the newest version, with ties counted. The book's closing quote is looked up at any line; what is left out is counted by reason, in order.
    """
    quoted, newest = two_passes(spark, d)
    panel = newest.select(*_PANEL_KEY, "line", devig_decimal(F.col("price_under"), F.col("price_over")).alias("p_under"))
    early, late = panel.where("pass = 'bettime'"), panel.where("pass = 'closing' AND book = 0")
    peers = qt.devig_consensus(early.where("book <> 0"), ["event_id", "line"], "p_under", "book")
    close = late.select("event_id", F.col("line").alias("closing_line"), F.col("p_under").alias("closing_under"))
    seen = early.where("book = 0").join(peers, ["event_id", "line"], "left").join(close, "event_id", "left")
    gated = F.coalesce(F.col("n_books") >= 2, F.lit(False))
    why = F.when(~gated, "few_books").when(F.col("closing_line").isNull(), "no_closing").when(F.col("closing_line") != F.col("line"), "line_changed").otherwise("primary")
    universe = seen.select(
        "event_id", why.alias("why"), (F.col("p_under") - F.col("median_p_over")).alias("deviation"), (F.col("closing_under") - F.col("p_under")).alias("reversion")
    )
    funnel = universe.agg(
        F.count(F.lit(1)).alias("n_total"), *[F.count_if(F.col("why") == w).alias(f"n_{w}") for w in ("few_books", "no_closing", "line_changed")]
    )
    primary = universe.where("why = 'primary'")
    fit = st.linear_fit(primary, [], "deviation", "reversion").select(F.col("n").alias("n_primary"), "r", "slope", "intercept")
    ci = bs.correlation_bootstrap(primary, ["event_id"], F.col("deviation"), F.col("reversion"), RESAMPLES, "converge")
    verdict = F.when(F.col("n_degenerate") / RESAMPLES > 0.01, F.lit("UNSTABLE")).when(F.col("upper") < 0, F.lit("PASS")).otherwise(F.lit("CLOSED"))
    ties = wn.version_ties(quoted, _PANEL_KEY, "seen", "requested").select("n_tied")
    out = funnel
    for facts in (fit, ties, ci.select("lower", "upper", verdict.alias("verdict"))):
        out = st.beside(out, facts, [])
    return out


@query("b11_cross_market_translation")
def b11(spark, d):
    """Player totals per book to team totals, a robust line from them, priced by its own residuals."""
    from formbook.operators.models import fit_huber

    team = qt.two_level_median(quotes(spark, d), ["event_id", "book"], ["event_id"], "line", "team_total")
    target = quotes(spark, d).groupBy("event_id").agg(F.sum("line").alias("actual"), F.avg("line").alias("mean_line"))
    rows = team.join(target, "event_id").withColumn("half", F.pmod("event_id", F.lit(2)))
    model = fit_huber(rows.where("half = 0"), ["team_total"], "actual")
    scored = model.transform(rows).drop("__features", "__f_team_total")
    resid = scored.where("half = 0").select((F.col("actual") - F.col("fitted")).alias("resid"))
    asked = scored.where("half = 1").withColumn("market_line", F.round("fitted") + 0.5)
    return st.empirical_shares(asked, resid, "fitted", "market_line", "resid", ["event_id"]).select(
        "event_id", "team_total", "fitted", "market_line", "p_over", "p_under", "p_push"
    )


@query(
    "b12_alternate_ladder_study",
    with_sql(PAIRS)
    + """, a AS (SELECT event_id, book, arg_min(price_over, line) AS ao, arg_min(price_under, line) AS au, arg_min(line, line) AS al, count(*) AS rungs FROM pairs GROUP BY ALL),
    r AS (SELECT event_id, book, line, rungs, least(min((1 / price_over) / (1 / ao + 1 / au)) OVER (PARTITION BY event_id, book ORDER BY line), 1.0) AS p_ladder, 0.5 AS p_base FROM pairs JOIN a USING (event_id, book)),
    o AS (SELECT r.*, CAST(p_size % 5 AS DOUBLE) AS actual FROM r JOIN part ON p_partkey = event_id),
    b AS (SELECT CASE WHEN rungs < 2 THEN 'single_rung' WHEN actual = line THEN 'push' ELSE 'priced' END AS bucket, CASE WHEN rungs >= 2 AND actual <> line THEN pow(p_ladder - CAST(actual > line AS INTEGER), 2) - pow(p_base - CAST(actual > line AS INTEGER), 2) END AS delta FROM o)
    SELECT bucket, count(*) AS n_rows, avg(delta) AS brier_delta FROM b GROUP BY 1""",
)
def b12(spark, d):
    """Ladder prices against a flat baseline, with every rung accounted for in one bucket."""
    p = pairs(spark, d)
    anchors = p.groupBy("event_id", "book").agg(
        F.min_by("price_over", "line").alias("ao"), F.min_by("price_under", "line").alias("au"), F.count(F.lit(1)).alias("rungs")
    )
    r = p.join(anchors, ["event_id", "book"]).withColumn("raw", O.ladder_devig(F.col("price_over"), F.col("ao"), F.col("au")))
    r = forward_min_clip(r, ["event_id", "book"], ["line"], "raw", "p_ladder").withColumn("p_ladder", F.least("p_ladder", F.lit(1.0)))
    outcome = table(spark, d, "part").select(F.col("p_partkey").alias("event_id"), (F.col("p_size") % 5).cast("double").alias("actual"))
    o = r.join(outcome, "event_id")
    hit = (F.col("actual") > F.col("line")).cast("int")
    bucket = F.when(F.col("rungs") < 2, F.lit("single_rung")).when(F.col("actual") == F.col("line"), F.lit("push")).otherwise(F.lit("priced"))
    delta = st.brier(F.col("p_ladder"), hit) - st.brier(F.lit(0.5), hit)
    return o.withColumn("bucket", bucket).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(F.when(F.col("bucket") == "priced", delta)).alias("brier_delta")
    )


_ARMS = [
    BETS,
    "per AS (SELECT book, game_id, sum(profit) FILTER (p_over > 0.5) AS na, sum(stake) FILTER (p_over > 0.5) AS da, sum(profit) AS nb, sum(stake) AS db FROM bets GROUP BY ALL)",
    draws_sql("per", "game_id", "arms"),
]


@query(
    "b13_selection_versus_blind",
    with_sql(*_ARMS)
    + f""", reps AS (SELECT book, resample, sum(w * coalesce(na, 0)) / nullif(sum(w * coalesce(da, 0)), 0) - sum(w * nb) / nullif(sum(w * db), 0) AS s FROM weighted GROUP BY ALL), ci AS (SELECT book, {CI_SQL} FROM reps GROUP BY 1),
    n AS (SELECT book, count(*) FILTER (p_over > 0.5) AS n FROM bets GROUP BY 1)
    SELECT book, lower, upper, CASE WHEN n < 100 THEN 'INSUFFICIENT' WHEN n_degenerate / {RESAMPLES}.0 > 0.01 THEN 'UNSTABLE' WHEN lower > 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ci JOIN n USING (book)""",
)
def b13(spark, d):
    b = bets(spark, d)
    picked = F.col("p_over") > 0.5
    ci = bs.paired_arms(b, ["game_id"], F.col("profit"), picked, F.lit(True), F.col("stake"), RESAMPLES, "arms", ["book"])
    n = b.groupBy("book").agg(F.count_if(picked).alias("n_picked"))
    verdict = bt.study_verdict(F.col("n_picked"), 100, F.col("lower"), F.col("upper"), F.col("n_degenerate") / RESAMPLES)
    return ci.join(n, "book").select("book", "lower", "upper", verdict.alias("verdict"))


@query(
    "b14_pooled_verdict",
    with_sql(BETS, "per AS (SELECT game_id, sum(profit) AS num, sum(stake) AS den FROM bets GROUP BY 1)", draws_sql("per", "game_id", "pool"))
    + f""", reps AS (SELECT resample, sum(w * num) / sum(w * den) AS s FROM weighted GROUP BY 1), ci AS (SELECT {CI_SQL} FROM reps), f AS (SELECT year(bet_date) AS y, sum(profit) / sum(stake) AS roi FROM bets GROUP BY 1)
    SELECT count(*) AS n_folds, min(roi) AS worst_fold, max(lower) AS pooled_lower, CASE WHEN min(roi) > 0 AND max(lower) > 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM f, ci""",
)
def b14(spark, d):
    b = bets(spark, d).withColumn("season", F.year("bet_date"))
    folds = b.groupBy("season").agg((F.sum("profit") / F.sum("stake")).alias("roi"))
    pooled = bs.cluster_bootstrap(b, ["game_id"], F.col("profit"), F.col("stake"), RESAMPLES, "pool").select("lower")
    return bt.pooled_verdict(folds.withColumn("lower", pooled.scalar()), "roi", F.col("lower"))


@query(
    "b15_agree_arms",
    with_sql(BETS)
    + f""", c AS (SELECT entity_id, round(avg(p_over), 9) AS consensus FROM bets GROUP BY 1), a AS (SELECT CASE WHEN (side = 'OVER') = (consensus >= 0.5) THEN 'agree' ELSE 'disagree' END AS arm, profit, stake, result FROM bets JOIN c USING (entity_id))
    SELECT arm, count(*) AS n_bets, sum(profit) / sum(stake) AS roi, avg(CAST(result = 'WIN' AS DOUBLE)) FILTER (result <> 'PUSH') AS hit_rate FROM a GROUP BY 1""",
)
def b15(spark, d):
    b = bets(spark, d)
    # rounded, so that a mean of exactly one half does not depend on the order of summing
    consensus = b.groupBy("entity_id").agg(F.round(F.avg("p_over"), 9).alias("consensus"))
    arm = F.when((F.col("side") == "OVER") == (F.col("consensus") >= 0.5), F.lit("agree")).otherwise(F.lit("disagree"))
    won = F.when(F.col("result") != "PUSH", (F.col("result") == "WIN").cast("double"))
    return b.join(consensus, "entity_id").groupBy(arm.alias("arm")).agg(
        F.count(F.lit(1)).alias("n_bets"), (F.sum("profit") / F.sum("stake")).alias("roi"), F.avg(won).alias("hit_rate")
    )


@query(
    "b16_shadow_clv",
    with_sql(SNAPSHOTS, _CLOSING)
    + f""", s AS (SELECT s.*, CASE WHEN s.id % 2 = 0 THEN 'OVER' ELSE 'UNDER' END AS side, c.line AS cl, c.odds_over AS co, c.odds_under AS cu FROM snapshots s JOIN closing c USING (entity_id, game_date, book)),
    v AS (SELECT book, side, CASE WHEN side = 'OVER' THEN cl - line ELSE line - cl END AS clv,
        CASE WHEN side = 'OVER' THEN {prob_sql('co')} / ({prob_sql('co')} + {prob_sql('cu')}) - {prob_sql('odds_over')} / ({PO} + {PU}) ELSE {prob_sql('cu')} / ({prob_sql('cu')} + {prob_sql('co')}) - {prob_sql('odds_under')} / ({PU} + {PO}) END AS pclv FROM s)
    SELECT book, side, count(*) AS n_legs, avg(clv) AS mean_line_clv, avg(pclv) AS mean_prob_clv FROM v GROUP BY ALL""",
)
def b16(spark, d):
    """Every snapshot as if bet at that moment, against its own closing snapshot."""
    c = F.col
    s = snapshots(spark, d).withColumn("side", F.when(c("id") % 2 == 0, F.lit("OVER")).otherwise(F.lit("UNDER")))
    j = s.join(closing(spark, d), ["entity_id", "game_date", "book"])
    over = c("side") == "OVER"

    def fair(a, b):
        return F.when(over, O.devig_american(c(a), c(b))).otherwise(O.devig_american(c(b), c(a)))

    return j.groupBy("book", "side").agg(
        F.count(F.lit(1)).alias("n_legs"), F.avg(O.line_clv(c("side"), c("line"), c("closing_line"))).alias("mean_line_clv"),
        F.avg(O.prob_clv(fair("odds_over", "odds_under"), fair("closing_odds_over", "closing_odds_under"))).alias("mean_prob_clv"),
    )


@query(
    "b19_same_game_pairs",
    """WITH g AS (SELECT l_orderkey, count(*) AS n, arg_min(l_quantity, (l_linenumber, l_partkey, l_suppkey, l_shipdate)) AS a, arg_max(l_quantity, (l_linenumber, l_partkey, l_suppkey, l_shipdate)) AS b FROM lineitem GROUP BY 1)
    SELECT count(*) AS n_games, corr(a, b) AS r, count(*) FILTER (a > 25 AND b > 25) AS both_over, count(*) FILTER (a > 25 AND b <= 25) AS first_only, count(*) FILTER (a <= 25 AND b > 25) AS second_only, count(*) FILTER (a <= 25 AND b <= 25) AS neither FROM g WHERE n = 2""",
)
def b19(spark, d):
    p = bt.pair_table(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], "l_quantity")
    a, b = F.col("first_outcome") > 25, F.col("second_outcome") > 25
    return p.agg(
        F.count(F.lit(1)).alias("n_games"), F.corr("first_outcome", "second_outcome").alias("r"), F.count_if(a & b).alias("both_over"),
        F.count_if(a & ~b).alias("first_only"), F.count_if(~a & b).alias("second_only"), F.count_if(~a & ~b).alias("neither"),
    )


_VARIANTS = """vs AS (SELECT year(bet_date) AS origin, flag AS pass, game_id, CAST(actual > line AS INTEGER) AS y, p_over AS p_control, unnest([{'variant': 'shrunk', 'p': 0.5 + (p_over - 0.5) / 2}, {'variant': 'stretched', 'p': 0.5 + (p_over - 0.5) * 1.5}]) AS v FROM bets),
  sc AS (SELECT origin, pass, game_id, v.variant AS variant, pow(v.p - y, 2) AS b, pow(v.p - y, 2) - pow(p_control - y, 2) AS delta FROM vs)"""


@query(
    "b20_variant_versus_control",
    with_sql(BETS, _VARIANTS, "per AS (SELECT origin, pass, variant, game_id, sum(delta) AS num, count(*)::DOUBLE AS den FROM sc GROUP BY ALL)", draws_sql("per", "game_id", "variants"))
    + f""", reps AS (SELECT origin, pass, variant, resample, sum(w * num) / nullif(sum(w * den), 0) AS s FROM weighted GROUP BY ALL), ci AS (SELECT origin, pass, variant, quantile_cont(s, 0.025) AS lower, quantile_cont(s, 0.975) AS upper FROM reps GROUP BY ALL),
    m AS (SELECT origin, pass, variant, count(*) AS n, avg(b) AS brier, avg(delta) AS delta_control FROM sc GROUP BY ALL)
    SELECT CAST(origin AS INTEGER) AS origin, pass, variant, n, brier, delta_control, lower, upper, CASE WHEN upper < 0 THEN 'better' WHEN lower > 0 THEN 'worse' ELSE 'same' END AS verdict FROM m JOIN ci USING (origin, pass, variant)""",
)
def b20(spark, d):
    """All variants, origins and passes scored against the control in one long table."""
    b = bets(spark, d).withColumns({"origin": F.year("bet_date"), "y": (F.col("actual") > F.col("line")).cast("int")})
    off = F.col("p_over") - 0.5
    variants = F.array(
        F.struct(F.lit("shrunk").alias("variant"), (0.5 + off / 2).alias("p")), F.struct(F.lit("stretched").alias("variant"), (0.5 + off * 1.5).alias("p"))
    )
    long = b.select("origin", F.col("flag").alias("pass"), "game_id", "y", F.col("p_over").alias("p_control"), F.inline(variants))
    long = long.withColumns({"b": st.brier(F.col("p"), F.col("y"))}).withColumn("delta", F.col("b") - st.brier(F.col("p_control"), F.col("y")))
    by = ["origin", "pass", "variant"]
    m = long.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("b").alias("brier"))
    ci = bs.cluster_bootstrap(long, ["game_id"], F.col("delta"), F.lit(1.0), RESAMPLES, "variants", by)
    verdict = F.when(F.col("upper") < 0, F.lit("better")).when(F.col("lower") > 0, F.lit("worse")).otherwise(F.lit("same"))
    return m.join(ci, by).select(*by, "n", "brier", F.col("estimate").alias("delta_control"), "lower", "upper", verdict.alias("verdict"))


@query("b21_exposure_mixture_study")
def b21(spark, d):
    """Early-exit classifier and rate model feeding a mixture price, against the single distribution."""
    from formbook.functions.distributions import price_count_line
    from formbook.operators.models import apply_platt, fit_classifier, fit_platt, fit_rate, probability

    n = nights(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), "p_size", "p_retailprice"), "entity_id")
    n = n.withColumns({"early": (F.col("p_size") < 12).cast("int"), "fold": F.pmod("entity_id", F.lit(3)), "x1": F.col("p_retailprice"), "x2": F.col("mu")})
    early = fit_classifier(n.where("fold = 0"), ["x1", "x2"], "early", trees=5, depth=3)
    raw = probability(n.where("fold > 0"), early, "p_raw")
    scored = apply_platt(raw.where("fold = 2"), fit_platt(raw.where("fold = 1"), "p_raw", "early"), "p_raw", "p_early")
    rate = fit_rate(n.where("fold = 0"), ["x1", "x2"], "actual", trees=5, depth=3)
    rated = rate.transform(scored).withColumn("mu", F.greatest(F.col("prediction"), F.lit(1e-3))).select(
        "entity_id", "mu", "alpha", "q", "line", "actual", "p_early"
    )
    single = price_count_line(F.col("mu"), F.col("alpha"), F.col("q"), F.col("line"))["p_over"]
    mixture = mixture_price(rated, toi_bins(spark, d)).select("entity_id", F.col("p_over").alias("p_mix"))
    both = rated.withColumn("p_single", single).join(mixture, "entity_id")
    blended = F.col("p_early") * F.col("p_mix") + (1 - F.col("p_early")) * F.col("p_single")
    y = (F.col("actual") > F.col("line")).cast("int")
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.avg(st.brier(F.col("p_single"), y)).alias("brier_single"), F.avg(st.brier(F.col("p_mix"), y)).alias("brier_mixture"),
        F.avg(st.brier(blended, y)).alias("brier_blended"),
    )


@query(
    "o4_smallest_confirmed_threshold",
    with_sql(BETS, decided_sql(), "sw AS (SELECT threshold, count(*) FILTER (res IN ('WIN', 'LOSS')) AS n, avg(pr) FILTER (res IN ('WIN', 'LOSS')) - 0.03 AS lower, avg(pr) FILTER (res IN ('WIN', 'LOSS')) AS mean FROM decided GROUP BY 1)",
             "t2 AS (SELECT *, CASE WHEN n >= 100 AND lower > 0 THEN 2 WHEN n >= 100 THEN 1 ELSE 0 END AS tier FROM sw)")
    + """SELECT threshold, CASE tier WHEN 2 THEN 'confirmed' WHEN 1 THEN 'unresolved' ELSE 'insufficient' END AS status, n, mean, lower FROM t2
    ORDER BY tier DESC, CASE tier WHEN 2 THEN -threshold WHEN 1 THEN coalesce(mean, -999) ELSE n END DESC, threshold LIMIT 1""",
)
def o4(spark, d):
    spread = bets(spark, d).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in GRID])))
    g = bt.decide_and_grade(spread, F.col("threshold"))
    paid = F.when(F.col("bet_result").isin("WIN", "LOSS"), F.col("bet_profit"))
    sweep = g.groupBy("threshold").agg(F.count(paid).alias("n"), F.avg(paid).alias("mean")).withColumn("lower", F.col("mean") - 0.03)
    return bt.smallest_confirmed(sweep, "lower", "n", 100, "mean")


@query(
    "o4_highest_lower_bound",
    with_sql(BETS, decided_sql(), "sw AS (SELECT bet, threshold, count(*) AS n, avg(pr) - 2 * stddev_samp(pr) / sqrt(count(*)) AS lower FROM decided WHERE bet IS NOT NULL GROUP BY ALL)")
    + "SELECT bet, threshold, lower FROM sw WHERE n >= 100 QUALIFY row_number() OVER (PARTITION BY bet ORDER BY lower DESC, threshold DESC) = 1",
)
def o4_lower(spark, d):
    spread = bets(spark, d).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in GRID])))
    g = bt.decide_and_grade(spread, F.col("threshold")).where("bet is not null")
    n = F.count(F.lit(1))
    sweep = g.groupBy("bet", "threshold").agg(n.alias("n"), (F.avg("bet_profit") - 2 * F.stddev_samp("bet_profit") / F.sqrt(n)).alias("lower"))
    return bt.highest_lower_bound(sweep, "lower", F.col("n") >= 100, ["bet"])


@query(
    "o4_smallest_error_config",
    with_sql(BETS) + """, s AS (SELECT venue AS config, avg(abs(line - actual)) AS mae, avg(pow(line - actual, 2)) AS mse FROM bets GROUP BY 1) SELECT config, mae, mse FROM s ORDER BY mae, mse, config LIMIT 1""",
)
def o4_error(spark, d):
    e = F.col("line") - F.col("actual")
    s = bets(spark, d).groupBy(F.col("venue").alias("config")).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"))
    return bt.smallest_error(s, "config", "mae", "mse")
