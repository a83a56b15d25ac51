"""Quote algebra: pairing, duplicates, conflicts, consensus, modal lines, leave-one-out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.functions.odds import devig_decimal, nearest_half
from formbook.operators.skew import DEFAULT_RULE, SplitRule, exact_percentiles, join_back, summarise, with_group_totals


def earliest_snapshot(df: DataFrame, event: Sequence[str], ts: str, rule: SplitRule = DEFAULT_RULE) -> DataFrame:
    """Rows taken at each event's first snapshot time."""
    return with_group_totals(df, event, {"__first": F.min(ts)}, rule).where(F.col(ts) == F.col("__first")).drop("__first")


def drop_exact_duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.dropDuplicates(list(key))


def duplicate_census(df: DataFrame, key: Sequence[str], price: str) -> DataFrame:
    """How many key groups repeat with one price and how many disagree."""
    groups = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("__n"), F.min(price).alias("__lo"), F.max(price).alias("__hi")
    )
    repeated, differs = F.col("__n") > 1, F.col("__lo") != F.col("__hi")
    return groups.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.count_if(repeated & ~differs).alias("exact_duplicate_groups"),
        F.count_if(repeated & differs).alias("conflicting_groups"),
        F.coalesce(F.sum(F.when(repeated, F.col("__n") - 1)), F.lit(0)).alias("surplus_rows"),
    )


def exclude_conflicts(df: DataFrame, key: Sequence[str], price: str, rule: SplitRule = DEFAULT_RULE) -> DataFrame:
    """Drop every key that carries more than one price."""
    bad = df.groupBy(*key).agg(F.min(price).alias("__lo"), F.max(price).alias("__hi")).where("__lo <> __hi").select(*key)
    return join_back(df, bad, key, "left_anti", rule)


def pair_sides(
    df: DataFrame,
    key: Sequence[str],
    side: str,
    price: str,
    position: Sequence[str],
    labels: tuple[str, str] = ("Over", "Under"),
    policy: str = "first",
) -> DataFrame:
    """Long to wide: one row per key with both sides' prices and a pairing status.

    ``policy='first'`` keeps the earliest row of a side; ``'strict'`` voids a side whose
    rows disagree.  One aggregate with per-side minima, so nothing is collected per key.
    """
    over, under = (F.col(side) == label for label in labels)
    at = F.struct(*position)

    def price_of(is_side: Column) -> Column:
        return F.min_by(price, F.when(is_side & F.col(price).isNotNull(), at))

    def conflict(is_side: Column) -> Column:
        values = F.when(is_side, F.col(price))
        return F.coalesce(F.min(values) != F.max(values), F.lit(False))

    wide = df.groupBy(*key).agg(
        price_of(over).alias("price_over"),
        price_of(under).alias("price_under"),
        (conflict(over) | conflict(under)).cast("int").alias("has_conflict"),
    )
    if policy == "strict":
        for c in ("price_over", "price_under"):
            wide = wide.withColumn(c, F.when(F.col("has_conflict") == 0, F.col(c)))
    both = F.col("price_over").isNotNull() & F.col("price_under").isNotNull()
    status = (
        F.when((F.col("has_conflict") == 1) & F.lit(policy == "strict"), F.lit("conflict"))
        .when(both, F.lit("paired"))
        .otherwise(F.lit("one_sided"))
    )
    return wide.withColumn("pair_status", status)


def paired(df: DataFrame, *args, **kwargs) -> DataFrame:
    """Only complete pairs, de-vigged."""
    wide = pair_sides(df, *args, **kwargs).where("pair_status = 'paired'").drop("pair_status")
    return wide.withColumn("p_over", devig_decimal(F.col("price_over"), F.col("price_under"))).withColumn(
        "overround", 1.0 / F.col("price_over") + 1.0 / F.col("price_under") - 1.0
    )


def devig_group(df: DataFrame, group: Sequence[str], price: str, rule: SplitRule = DEFAULT_RULE) -> DataFrame:
    """Fair probability within a group of exactly two priced outcomes, NULL otherwise."""
    raw = F.when(F.col(price) > 0, 1.0 / F.col(price))
    totals = {"__n": F.count(F.lit(1)), "__priced": F.count(raw), "__t": F.sum(raw)}
    clean = (F.col("__n") == 2) & (F.col("__priced") == 2)
    return with_group_totals(df, group, totals, rule).withColumn("p_devig", F.when(clean, raw / F.col("__t"))).drop("__n", "__priced", "__t")


def consensus_prob(df: DataFrame, key: Sequence[str], book: str) -> DataFrame:
    """Average implied probabilities across books, then back to a price."""
    out = df.groupBy(*key).agg(
        F.avg(1.0 / F.col("price_over")).alias("mean_prob_over"),
        F.avg(1.0 / F.col("price_under")).alias("mean_prob_under"),
        F.count_distinct(book).alias("num_books"),
    )
    return out.withColumn("consensus_over", 1.0 / F.col("mean_prob_over")).withColumn(
        "consensus_under", 1.0 / F.col("mean_prob_under")
    )


def consensus_line(df: DataFrame, entity: Sequence[str], all_books: Sequence[str], line: str, side: str, price: str, book: str,
                   labels: tuple[str, str] = ("Over", "Under")) -> DataFrame:
    """Mean line to the nearest half and mean decimal price per side.

    ``num_books`` counts every book of the event, ``quoting_books`` those that priced the
    entity.
    """
    books = df.groupBy(*all_books).agg(F.count_distinct(book).alias("num_books"))
    out = df.groupBy(*entity).agg(
        F.avg(line).alias("__line"),
        F.avg(F.when(F.col(side) == labels[0], F.col(price))).alias("mean_over"),
        F.avg(F.when(F.col(side) == labels[1], F.col(price))).alias("mean_under"),
        F.count_distinct(book).alias("quoting_books"),
    )
    priced = out.where(F.col("mean_over").isNotNull() & F.col("mean_under").isNotNull())
    return join_back(priced.withColumn("betting_line", nearest_half(F.col("__line"))).drop("__line"), books, all_books)


def devig_consensus(df: DataFrame, key: Sequence[str], prob: str, book: str) -> DataFrame:
    """Mean and median fair probability with the number of books."""
    extra = {"mean_p_over": F.avg(prob), "n_books": F.count_distinct(book)}
    return summarise(df, key, prob, {"median_p_over": 0.5}, extra)


def book_median_line(df: DataFrame, key: Sequence[str], line: str, book: str) -> DataFrame:
    """Median line over books with the sorted list of those books (a set of book names)."""
    books = F.array_join(F.array_sort(F.collect_set(F.col(book).cast("string"))), ",")
    return summarise(df, key, line, {"median_line": 0.5}, {"books": books})


def deviation_census(df: DataFrame, by: Sequence[str], line: str, consensus: str) -> DataFrame:
    """How far a venue's lines sit from the consensus, by rate, sign and mean."""
    dev = F.col(line) - F.col(consensus)
    off = dev != 0
    return df.where(F.col(consensus).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg((dev == 0).cast("double")).alias("exact_rate"),
        F.avg((F.abs(dev) <= 0.5).cast("double")).alias("within_half_rate"),
        F.avg(F.when(off, dev)).alias("mean_signed_deviation"),
        F.count_if(dev > 0).alias("n_above"),
        F.count_if(dev < 0).alias("n_below"),
    )


def modal_line(df: DataFrame, key: Sequence[str], line: str) -> DataFrame:
    """The most quoted line; the lowest one when several tie."""
    counts = df.groupBy(*key, line).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*key).agg(
        F.max_by(line, F.struct(F.col("__n"), -F.col(line))).alias("modal_line"), F.max("__n").alias("n_at_modal")
    )


def all_modal_lines(df: DataFrame, key: Sequence[str], line: str) -> DataFrame:
    """Every line that reaches the highest quote count."""
    counts = df.groupBy(*key, line).agg(F.count(F.lit(1)).alias("n_at_line"))
    return with_group_totals(counts, key, {"__top": F.max("n_at_line")}).where("n_at_line = __top").drop("__top")


def dispersion(df: DataFrame, key: Sequence[str], line: str, prob: str, overround: str, book: str, rule: SplitRule = DEFAULT_RULE) -> DataFrame:
    """Spread of lines over all books, and price spread at the modal line."""
    whole = df.groupBy(*key).agg(F.count_distinct(book).alias("n_books"), F.stddev_pop(line).alias("line_dispersion"))
    modal = modal_line(df, key, line).drop("n_at_modal")
    at = join_back(df, modal, key, rule=rule).where(F.col(line) == F.col("modal_line"))
    spread = summarise(at, key, overround, {"overround_median": 0.5}, {"prob_dispersion": F.stddev_pop(prob)})
    return whole.join(modal, list(key), "left").join(spread, list(key), "left")


def leave_one_out(df: DataFrame, group: Sequence[str], value: str, name: str, rule: SplitRule = DEFAULT_RULE) -> DataFrame:
    """Mean of the other rows of the group, NULL when there is none."""
    totals = {"__s": F.sum(value), "__c": F.count(value)}
    others = F.col("__c") - F.when(F.col(value).isNotNull(), 1).otherwise(0)
    rest = F.col("__s") - F.coalesce(F.col(value), F.lit(0.0))
    return with_group_totals(df, group, totals, rule).withColumn(name, F.when(others > 0, rest / others)).drop("__s", "__c")


def two_level_median(df: DataFrame, inner: Sequence[str], outer: Sequence[str], value: str, name: str) -> DataFrame:
    """Sum per inner key, then the median of those sums per outer key."""
    sums = df.groupBy(*inner).agg(F.sum(value).alias("__sum"))
    return exact_percentiles(sums, outer, "__sum", {name: 0.5})


def group_context(df: DataFrame, key: Sequence[str], line: str, book: str, rule: SplitRule = DEFAULT_RULE) -> DataFrame:
    """Books, line spread and modal flag of its group on every quote."""
    stats = df.groupBy(*key).agg(
        F.count_distinct(book).alias("n_books"), (F.max(line) - F.min(line)).alias("line_spread")
    )
    facts = stats.join(modal_line(df, key, line).drop("n_at_modal"), list(key))
    return join_back(df, facts, key, rule=rule).withColumn("off_modal", (F.col(line) != F.col("modal_line")).cast("int"))


def market_state(df: DataFrame, event: Sequence[str], market: str, label: str, home: str, prob: str, point: str) -> DataFrame:
    """Home win probability and total points consensus per event."""
    h2h = df.where((F.col(market) == "h2h") & (F.col(label) == F.col(home)))
    totals = df.where((F.col(market) == "totals") & (F.col(label) == "Over"))
    a = h2h.groupBy(*event).agg(
        F.avg(prob).alias("home_prob_mean"), F.stddev_pop(prob).alias("home_prob_std"), F.count(prob).alias("home_prob_n")
    )
    b = summarise(totals, event, point, {"total_median": 0.5}, {"total_std": F.stddev_pop(point), "total_n": F.count(point)})
    return a.join(b, list(event), "full")


def drop_drifted_events(df: DataFrame, event: Sequence[str], requested: str, commence: str, minutes: int = 10) -> DataFrame:
    """Drop every event with a snapshot closer to the start than the limit."""
    late = df.where(F.col(commence) - F.col(requested) < F.expr(f"INTERVAL '{minutes}' MINUTE")).select(*event).distinct()
    return join_back(df, late, event, "left_anti")
