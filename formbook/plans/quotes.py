"""U and A5-A13: quote pairing, duplicates, consensus and leave-one-out prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from formbook.operators import quotes as qt
from formbook.operators.skew import EVEN
from formbook.plans.frames import PAIRS, QUOTE_POSITION, QUOTES, quotes, table, with_sql
from formbook.plans.registry import query

KEY = ["event_id", "book", "line"]


def pairs(spark, d):
    return qt.paired(quotes(spark, d), KEY, "side", "price", QUOTE_POSITION)


@query(
    "u1_union_sources",
    """SELECT origin, count(*) AS n_rows, sum(price) AS total, count(book) AS n_book FROM (
      SELECT 'line' AS origin, l_extendedprice AS price, l_suppkey AS book FROM lineitem UNION ALL SELECT 'order', o_totalprice, NULL FROM orders) GROUP BY 1""",
)
def u1(spark, d):
    a = table(spark, d, "lineitem").select(F.lit("line").alias("origin"), F.col("l_extendedprice").alias("price"), F.col("l_suppkey").alias("book"))
    b = table(spark, d, "orders").select(F.lit("order").alias("origin"), F.col("o_totalprice").alias("price"))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.groupBy("origin").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("price").alias("total"), F.count("book").alias("n_book"))


@query("u2_exact_duplicate_drop", with_sql(QUOTES) + "SELECT DISTINCT event_id, book, line, side, price FROM quotes")
def u2(spark, d):
    q = quotes(spark, d).select("event_id", "book", "line", "side", "price")
    return qt.drop_exact_duplicates(q, ["event_id", "book", "line", "side", "price"])


@query(
    "u3_duplicate_census",
    with_sql(QUOTES)
    + """, g AS (SELECT count(*) AS n, min(price) AS lo, max(price) AS hi FROM quotes GROUP BY event_id, book, line, side)
    SELECT count(*) AS n_groups, count(*) FILTER (n > 1 AND lo = hi) AS exact_duplicate_groups, count(*) FILTER (n > 1 AND lo <> hi) AS conflicting_groups,
      CAST(coalesce(sum(n - 1) FILTER (n > 1), 0) AS BIGINT) AS surplus_rows FROM g""",
)
def u3(spark, d):
    return qt.duplicate_census(quotes(spark, d), [*KEY, "side"], "price")


@query(
    "u4_exclude_conflicts",
    with_sql(QUOTES)
    + """, bad AS (SELECT event_id, book, line, side FROM quotes GROUP BY ALL HAVING min(price) <> max(price))
    SELECT event_id, book, line, side, price, src, seq, venue FROM quotes q ANTI JOIN bad USING (event_id, book, line, side)""",
)
def u4(spark, d):
    return qt.exclude_conflicts(quotes(spark, d), [*KEY, "side"], "price").select(*KEY, "side", "price", "src", "seq", "venue")


@query(
    "u5_id_sets",
    """WITH a AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_tax = 0.08)
    SELECT 'both' AS part, count(*) AS n_ids FROM (SELECT id FROM a INTERSECT SELECT id FROM b)
    UNION ALL SELECT 'first_only', count(*) FROM (SELECT id FROM a EXCEPT SELECT id FROM b)
    UNION ALL SELECT 'second_only', count(*) FROM (SELECT id FROM b EXCEPT SELECT id FROM a)""",
)
def u5(spark, d):
    li = table(spark, d, "lineitem")
    a = li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id")).distinct()
    b = li.where("l_tax = 0.08").select(F.col("l_partkey").alias("id")).distinct()

    def count(name, ids):
        return ids.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n_ids"))

    return count("both", a.intersect(b)).unionByName(count("first_only", a.exceptAll(b))).unionByName(count("second_only", b.exceptAll(a)))


@query("u6_two_sided_pairs", with_sql(PAIRS) + "SELECT event_id, book, line, price_over, price_under, p_over, overround FROM pairs")
def u6(spark, d):
    return pairs(spark, d).select(*KEY, "price_over", "price_under", "p_over", "overround")


@query(
    "u6_strict_pair_status",
    with_sql(PAIRS)
    + """SELECT event_id, CASE WHEN coalesce(lo_o <> hi_o, false) OR coalesce(lo_u <> hi_u, false) THEN 'conflict' WHEN price_over IS NOT NULL AND price_under IS NOT NULL THEN 'paired' ELSE 'one_sided' END AS pair_status,
      count(*) AS n_keys FROM sided GROUP BY ALL""",
)
def u6_strict(spark, d):
    wide = qt.pair_sides(quotes(spark, d), KEY, "side", "price", QUOTE_POSITION, policy="strict")
    return wide.groupBy("event_id", "pair_status").agg(F.count(F.lit(1)).alias("n_keys"))


@query(
    "a5_consensus_probability",
    with_sql(PAIRS)
    + """SELECT event_id, line, avg(1 / price_over) AS mean_prob_over, avg(1 / price_under) AS mean_prob_under, count(DISTINCT book) AS num_books,
      1 / avg(1 / price_over) AS consensus_over, 1 / avg(1 / price_under) AS consensus_under FROM pairs GROUP BY ALL""",
)
def a5(spark, d):
    return qt.consensus_prob(pairs(spark, d), ["event_id", "line"], "book")


@query(
    "a6_consensus_line",
    with_sql(QUOTES)
    + """, b AS (SELECT event_id, count(DISTINCT book) AS num_books FROM quotes GROUP BY 1),
    g AS (SELECT event_id, seq, avg(line) AS m, avg(price) FILTER (side = 'Over') AS mean_over, avg(price) FILTER (side = 'Under') AS mean_under, count(DISTINCT book) AS quoting_books FROM quotes GROUP BY ALL)
    SELECT event_id, seq, mean_over, mean_under, quoting_books, round_even(m * 2, 0) / 2 AS betting_line, num_books FROM g JOIN b USING (event_id) WHERE mean_over IS NOT NULL AND mean_under IS NOT NULL""",
)
def a6(spark, d):
    return qt.consensus_line(quotes(spark, d), ["event_id", "seq"], ["event_id"], "line", "side", "price", "book")


@query(
    "a7_devigged_consensus",
    with_sql(PAIRS)
    + "SELECT event_id, line, avg(p_over) AS mean_p_over, count(DISTINCT book) AS n_books, quantile_cont(p_over, 0.5) AS median_p_over FROM pairs GROUP BY ALL",
)
def a7(spark, d):
    return qt.devig_consensus(pairs(spark, d), ["event_id", "line"], "p_over", "book")


@query(
    "a8_book_median_line",
    with_sql(PAIRS)
    + "SELECT event_id, array_to_string(list_sort(list(DISTINCT CAST(book AS VARCHAR))), ',') AS books, quantile_cont(line, 0.5) AS median_line FROM pairs GROUP BY 1",
)
def a8(spark, d):
    return qt.book_median_line(pairs(spark, d), ["event_id"], "line", "book")


@query(
    "a8_deviation_census",
    with_sql(PAIRS)
    + """, m AS (SELECT event_id, quantile_cont(line, 0.5) AS c FROM pairs WHERE book <> 0 GROUP BY 1), j AS (SELECT book, line - c AS dev FROM pairs JOIN m USING (event_id))
    SELECT book, count(*) AS n_rows, avg(CAST(dev = 0 AS DOUBLE)) AS exact_rate, avg(CAST(abs(dev) <= 0.5 AS DOUBLE)) AS within_half_rate,
      avg(dev) FILTER (dev <> 0) AS mean_signed_deviation, count(*) FILTER (dev > 0) AS n_above, count(*) FILTER (dev < 0) AS n_below FROM j GROUP BY book""",
)
def a8_census(spark, d):
    from formbook.operators.skew import exact_percentiles

    p = pairs(spark, d)
    sharp = exact_percentiles(p.where("book <> 0"), ["event_id"], "line", {"consensus": 0.5})
    return qt.deviation_census(p.join(sharp, "event_id"), ["book"], "line", "consensus")


@query(
    "a9_modal_line_lowest_tie",
    with_sql(QUOTES)
    + """, c AS (SELECT event_id, line, count(*) AS n FROM quotes GROUP BY ALL)
    SELECT event_id, arg_max(line, (n, -line)) AS modal_line, max(n) AS n_at_modal FROM c GROUP BY 1""",
)
def a9(spark, d):
    return qt.modal_line(quotes(spark, d), ["event_id"], "line")


@query(
    "a9_all_modal_lines",
    with_sql(QUOTES)
    + ", c AS (SELECT event_id, line, count(*) AS n_at_line FROM quotes GROUP BY ALL) SELECT * FROM c QUALIFY n_at_line = max(n_at_line) OVER (PARTITION BY event_id)",
)
def a9_all(spark, d):
    return qt.all_modal_lines(quotes(spark, d), ["event_id"], "line")


@query(
    "a10_dispersion",
    with_sql(PAIRS)
    + """, c AS (SELECT event_id, line, count(*) AS n FROM pairs GROUP BY ALL), m AS (SELECT event_id, arg_max(line, (n, -line)) AS modal_line FROM c GROUP BY 1),
    w AS (SELECT event_id, count(DISTINCT book) AS n_books, stddev_pop(line) AS line_dispersion FROM pairs GROUP BY 1),
    a AS (SELECT event_id, stddev_pop(p_over) AS prob_dispersion, quantile_cont(overround, 0.5) AS overround_median FROM pairs JOIN m USING (event_id) WHERE line = modal_line GROUP BY 1)
    SELECT event_id, n_books, round(line_dispersion, 9) AS line_dispersion, modal_line, round(prob_dispersion, 9) AS prob_dispersion, overround_median FROM w JOIN m USING (event_id) JOIN a USING (event_id)""",
)
def a10(spark, d):
    out = qt.dispersion(pairs(spark, d), ["event_id"], "line", "p_over", "overround", "book")
    # equal prices have no spread; rounding keeps that an exact zero
    return out.withColumns({c: F.round(c, 9) for c in ("line_dispersion", "prob_dispersion")})


def market_rows(spark, d):
    """Head-to-head and totals outcomes per order, from its lines."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("event_id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.lit("h2h")).otherwise(F.lit("totals")).alias("market"),
        F.when(F.col("l_linestatus") == "O", F.lit("Over")).otherwise(F.lit("TeamA")).alias("label"),
        F.lit("TeamA").alias("home"), (0.3 + 4 * F.col("l_discount")).alias("prob"), (F.col("l_quantity") / 10).alias("point"),
    )


@query(
    "a11_market_state",
    """WITH r AS (SELECT l_orderkey AS event_id, l_linenumber % 2 = 0 AS h2h, l_linestatus AS s, 0.3 + 4 * l_discount AS prob, l_quantity / 10 AS point FROM lineitem),
    a AS (SELECT event_id, avg(prob) AS home_prob_mean, round(stddev_pop(prob), 9) AS home_prob_std, count(prob) AS home_prob_n FROM r WHERE h2h AND s = 'F' GROUP BY 1),
    b AS (SELECT event_id, round(stddev_pop(point), 9) AS total_std, count(point) AS total_n, quantile_cont(point, 0.5) AS total_median FROM r WHERE NOT h2h AND s = 'O' GROUP BY 1)
    SELECT event_id, home_prob_mean, home_prob_std, home_prob_n, total_std, total_n, total_median FROM a FULL JOIN b USING (event_id)""",
)
def a11(spark, d):
    out = qt.market_state(market_rows(spark, d), ["event_id"], "market", "label", "home", "prob", "point")
    return out.withColumns({c: F.round(c, 9) for c in ("home_prob_std", "total_std")})


@query(
    "a12_leave_one_out",
    with_sql(PAIRS)
    + """, s AS (SELECT *, CASE WHEN book <> 3 THEN p_over END AS x FROM pairs), t AS (SELECT event_id, line, sum(x) AS s, count(x) AS c FROM s GROUP BY ALL)
    SELECT event_id, line, book, CASE WHEN c - (x IS NOT NULL)::INT > 0 THEN (s - coalesce(x, 0)) / (c - (x IS NOT NULL)::INT) END AS peer_mean FROM s JOIN t USING (event_id, line)""",
)
def a12(spark, d):
    p = pairs(spark, d).withColumn("x", F.when(F.col("book") != 3, F.col("p_over")))
    return qt.leave_one_out(p, ["event_id", "line"], "x", "peer_mean", EVEN).select("event_id", "line", "book", "peer_mean")


@query(
    "a13_two_level_median",
    with_sql(QUOTES)
    + ", s AS (SELECT event_id, book, sum(line) AS t FROM quotes GROUP BY ALL) SELECT event_id, quantile_cont(t, 0.5) AS team_total FROM s GROUP BY 1",
)
def a13(spark, d):
    return qt.two_level_median(quotes(spark, d), ["event_id", "book"], ["event_id"], "line", "team_total")


@query(
    "flagship_consensus_bet_ledger",
    with_sql(PAIRS)
    + """, loo AS (SELECT *, sum(p_over) OVER w AS s, count(p_over) OVER w AS c FROM pairs WINDOW w AS (PARTITION BY event_id, line)),
    priced AS (SELECT event_id, book, line, price_over, price_under, (s - p_over) / (c - 1) AS fair_over FROM loo WHERE c > 1),
    bet AS (SELECT *, round(fair_over * price_over - 1, 9) AS ev_over, round((1 - fair_over) * price_under - 1, 9) AS ev_under FROM priced),
    chosen AS (SELECT *, CASE WHEN ev_over >= 0 AND ev_over > ev_under THEN 'OVER' WHEN ev_under >= 0 THEN 'UNDER' END AS bet FROM bet),
    p AS (SELECT p_partkey AS event_id, CAST(p_size % 5 AS DOUBLE) AS actual FROM part),
    g AS (SELECT *, CASE WHEN actual = line THEN 'PUSH' WHEN (bet = 'OVER') = (actual > line) THEN 'WIN' ELSE 'LOSS' END AS result FROM chosen JOIN p USING (event_id) WHERE bet IS NOT NULL),
    l AS (SELECT *, CAST(CASE result WHEN 'WIN' THEN (CASE WHEN bet = 'OVER' THEN price_over ELSE price_under END) - 1 WHEN 'LOSS' THEN -1 ELSE 0 END AS DOUBLE) AS profit FROM g)
    SELECT CASE WHEN grouping(bet) = 0 THEN 'bet' WHEN grouping(book) = 0 THEN 'book' ELSE 'total' END AS dimension,
      CASE WHEN grouping(bet) = 0 THEN bet WHEN grouping(book) = 0 THEN CAST(book AS VARCHAR) ELSE 'all' END AS value,
      count(*) AS bets, count(*) FILTER (result = 'WIN') AS wins, count(*) FILTER (result = 'LOSS') AS losses, count(*) FILTER (result = 'PUSH') AS pushes,
      count(*) FILTER (result = 'WIN') / count(*) FILTER (result IN ('WIN', 'LOSS')) AS win_rate, sum(profit) AS profit_total, CAST(count(*) AS DOUBLE) AS units, sum(profit) / count(*) * 100 AS roi
    FROM l GROUP BY GROUPING SETS ((bet), (book), ())""",
)
def flagship(spark, d):
    """Every book's pair priced at the other books' mean fair probability, bet, graded and broken down."""
    from formbook.functions.odds import grade
    from formbook.operators.grading import bet_breakdown

    # pairs are unique per (event, book, line), so a group holds at most one row per book
    p = qt.leave_one_out(pairs(spark, d), ["event_id", "line"], "p_over", "fair_over", EVEN).where("fair_over is not null")
    # rounded, so that a fair price is worth exactly zero whatever the order of summing
    ev_o, ev_u = F.round(F.col("fair_over") * F.col("price_over") - 1, 9), F.round((1 - F.col("fair_over")) * F.col("price_under") - 1, 9)
    p = p.withColumn("bet", F.when((ev_o >= 0) & (ev_o > ev_u), F.lit("OVER")).when(ev_u >= 0, F.lit("UNDER"))).where("bet is not null")
    outcomes = table(spark, d, "part").select(F.col("p_partkey").alias("event_id"), (F.col("p_size") % 5).cast("double").alias("actual"))
    held = F.when(F.col("bet") == "OVER", F.col("price_over")).otherwise(F.col("price_under"))
    ledger = p.join(outcomes, "event_id").withColumn("result", grade(F.col("bet"), F.col("line"), F.col("actual")))
    ledger = ledger.withColumns(
        {
            "profit": F.when(F.col("result") == "WIN", held - 1.0).when(F.col("result") == "LOSS", F.lit(-1.0)).otherwise(F.lit(0.0)),
            "stake": F.lit(1.0),
        }
    )
    return bet_breakdown(ledger, ["bet", "book"])
