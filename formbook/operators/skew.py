"""Ordered window work that survives one key holding a large share of all rows.

A plain ``Window.partitionBy(key)`` puts a whole key in one task.  The helpers
here use that plan for ordinary keys and a split plan for the few heavy ones:

* heavy keys are found by one map-side combined count over the key columns only.
  All keys of ``hot_rows`` rows or more are heavy, so there are at most (rows / hot_rows)
  of them, a list that is small enough to broadcast, and every other key fits a task;
* rows of heavy keys are range-partitioned on (key, order), which cuts a key into
  blocks of about equal size, and checkpointed so that a block id is data rather
  than something a retried task could derive differently;
* running aggregates combine a per-block window with a carry of block totals;
  bounded frames re-cut the rows by exact position and copy the frame's edge rows
  into the neighbouring chunk.

The count is skipped when the plan's estimated size shows that no key can be large; a plan that
multiplies rows (explode), which the estimate does not see, is always counted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from formbook.session import checkpointed

NULL_SLICES = 1000  # tasks that rows without a key are spread over
HOT_ROWS = 5_000_000
SMALL_PLAN_BYTES = 256 << 20


@dataclass(frozen=True)
class SplitRule:
    """When a key counts as heavy, and how many rows one block of it should hold."""

    hot_rows: int = HOT_ROWS
    block_rows: int = HOT_ROWS
    check_bytes: int = SMALL_PLAN_BYTES


DEFAULT_RULE = SplitRule()
# for callers whose keys are small by construction (say, one row per book): no count is run
EVEN = SplitRule(check_bytes=1 << 62)
DETECT = object()  # look for heavy keys; pass the result of ``hot_keys`` to share one look


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate for the optimised plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_enough(df: DataFrame, limit: int) -> bool:
    """Whether the estimate says so; it knows nothing of rows made by Generate or Expand."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if limit < EVEN.check_bytes and any(node in plan.toString() for node in ("Generate ", "Expand ")):
        return False
    return plan_bytes(df) <= limit


def hot_keys(df: DataFrame, by: Sequence[str], rule: SplitRule = DEFAULT_RULE) -> DataFrame | None:
    """The heavy keys with their row counts, or None; at most (rows / hot_rows) keys."""
    if small_enough(df, rule.check_bytes):
        return None
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__rows"))
    heavy = counts.where(F.col("__rows") >= rule.hot_rows)
    rows = heavy.collect()  # one row per hot_rows rows at most
    return df.sparkSession.createDataFrame(rows, heavy.schema) if rows else None


def join_back(
    rows: DataFrame, per_key: DataFrame, on: Sequence[str], how: str = "inner", rule: SplitRule = DEFAULT_RULE, heavy=DETECT
) -> DataFrame:
    """Join one-row-per-key facts to rows whose keys may be heavy.

    Adaptive skew joins only split a side that comes straight from a shuffle, which a side
    made by an aggregate does not.  Here a heavy key's rows are cut into slices by a hash of
    the row, and only that key's single fact is repeated once per slice.  Rows with a NULL
    key match nothing, so they are spread as well.
    """
    keys = hot_keys(rows, on, rule) if heavy is DETECT else heavy
    if keys is None:
        return rows.join(per_key, list(on), how)
    cut = F.ceil(F.col("__rows") / rule.block_rows).cast("int")
    marks = F.broadcast(keys.select(*on, cut.alias("__slices")))  # one row per heavy key
    slices = F.coalesce("__slices", F.lit(1))
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in on])
    salt = F.pmod(F.xxhash64(*rows.columns), F.when(no_key, F.lit(NULL_SLICES)).otherwise(slices)).cast("int")
    left = rows.join(marks, list(on), "left").withColumn("__salt", salt).drop("__slices")
    right = per_key.join(marks, list(on), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), slices - 1))).drop("__slices")
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def with_group_totals(
    df: DataFrame, by: Sequence[str], totals: dict[str, Column], rule: SplitRule = DEFAULT_RULE, heavy=DETECT
) -> DataFrame:
    """Add per-key aggregates to every row.

    Ordinary keys take one shuffle and a window; where a key is heavy the aggregate is
    combined before its shuffle and joined back in slices.  Rows with a NULL key keep NULLs.
    """
    keys = hot_keys(df, by, rule) if heavy is DETECT else heavy
    if keys is None:
        whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in by])
        w = Window.partitionBy(*by)
        return df.withColumns({n: F.when(whole, agg.over(w)) for n, agg in totals.items()})
    facts = df.groupBy(*by).agg(*[agg.alias(n) for n, agg in totals.items()])
    return join_back(df, facts, by, "left", rule, keys)


def _on_keys(left: DataFrame, right: DataFrame, by: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in by])


def _blocks(rows: DataFrame, by: Sequence[str], order: Sequence[Column], total: int, rule: SplitRule) -> DataFrame:
    parts = max(2, -(-total // rule.block_rows))
    ranged = rows.repartitionByRange(parts, *[F.col(k) for k in by], *order)
    return checkpointed(ranged.withColumn("__block", F.spark_partition_id()))


def split_hot(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], rule: SplitRule = DEFAULT_RULE, heavy=DETECT
) -> tuple[DataFrame | None, DataFrame | None]:
    """(ordinary rows, heavy rows with a ``__block`` column); either may be None."""
    if not by:
        if small_enough(df, rule.check_bytes):
            return df, None
        return None, _blocks(df, [], order, df.count(), rule)
    keys = hot_keys(df, by, rule) if heavy is DETECT else heavy
    if keys is None:
        return df, None
    total = sum(r["__rows"] for r in keys.collect())
    marks = F.broadcast(keys.drop("__rows"))
    heavy = df.join(marks, _on_keys(df, marks, by), "left_semi")
    rest = df.join(marks, _on_keys(df, marks, by), "left_anti")
    return rest, _blocks(heavy, by, order, total, rule)


def _moments(value: Column, window: WindowSpec | None = None) -> Column:
    parts = {"n": F.count(value), "mean": F.avg(value), "m2": F.var_pop(value)}
    n, mean, m2 = (c if window is None else c.over(window) for c in parts.values())
    return F.struct(n.alias("n"), mean.alias("mean"), (m2 * n).alias("m2"))


def merged_moments(a: Column, b: Column) -> Column:
    """Moments of two sets of rows from the moments of each."""
    many = a["n"] + b["n"]
    gap = a["mean"] - b["mean"]
    both = F.struct(
        many.alias("n"), (b["mean"] + gap * a["n"] / many).alias("mean"), (a["m2"] + b["m2"] + gap * gap * a["n"] * b["n"] / many).alias("m2")
    )
    return F.when(F.coalesce(b["n"], F.lit(0)) == 0, a).when(F.coalesce(a["n"], F.lit(0)) == 0, b).otherwise(both)


@dataclass(frozen=True)
class Running:
    """One running aggregate: kind in sum, count, min, max, last (last non-null), moments.

    ``moments`` is a struct (n, mean, m2) with m2 the sum of squared deviations from the mean. Two of
    them merge without a difference of large sums, so values far from zero keep their spread.
    """

    kind: str
    expr: Column

    def total(self, order: Sequence[Column]) -> Column:
        if self.kind == "moments":
            return _moments(self.expr)
        if self.kind == "last":
            seen = F.when(self.expr.isNotNull(), F.struct(*order))
            return F.max_by(self.expr, seen)
        return getattr(F, self.kind)(self.expr)

    def over(self, window: WindowSpec, expr: Column | None = None) -> Column:
        value = self.expr if expr is None else expr
        if self.kind == "moments":
            return _moments(value, window)
        if self.kind == "last":
            return F.last(value, ignorenulls=True).over(window)
        return getattr(F, self.kind)(value).over(window)

    def carry(self, name: str, window: WindowSpec) -> Column:
        if self.kind == "moments":
            # block means are taken from the key's first, so that no large sums are subtracted
            n, m2, start = F.col(name)["n"], F.col(name)["m2"], F.col(name)["start"]
            off = F.col(name)["mean"] - start
            many = F.sum(n).over(window)
            mean = F.try_divide(F.sum(n * off).over(window), F.nullif(many, F.lit(0)).cast("double"))
            spread = F.sum(m2).over(window) + F.greatest(F.sum(n * off * off).over(window) - many * mean * mean, F.lit(0.0))
            return F.struct(many.alias("n"), (F.max(start).over(window) + mean).alias("mean"), spread.alias("m2"))
        kind = "sum" if self.kind == "count" else self.kind
        return Running(kind, F.col(name)).over(window)

    def combine(self, local: Column, carry: Column) -> Column:
        if self.kind == "moments":
            return merged_moments(local, carry)
        if self.kind == "last":
            return F.coalesce(local, carry)
        if self.kind == "min":
            return F.least(local, carry)
        if self.kind == "max":
            return F.greatest(local, carry)
        if self.kind == "count":
            return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
        return F.coalesce(local + carry, local, carry)


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    aggs: dict[str, Running],
    prior: bool = False,
    rule: SplitRule = DEFAULT_RULE,
    heavy=DETECT,
) -> DataFrame:
    """Add running aggregates from the start of each key up to this row.

    ``prior=True`` leaves the row itself out.  ``order`` must be a total order of
    ascending columns.
    """
    last_row = -1 if prior else 0

    def local(keys: list[str]) -> dict[str, Column]:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, last_row)
        return {name: a.over(w) for name, a in aggs.items()}

    plain, split = split_hot(df, by, order, rule, heavy)
    if split is None:
        return plain.withColumns(local(list(by)))

    keys = [*by, "__block"]
    totals = split.groupBy(*keys).agg(*[a.total(order).alias(f"__t_{n}") for n, a in aggs.items()])
    before = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for n, a in aggs.items():
        if a.kind == "moments":
            start = F.first(F.col(f"__t_{n}")["mean"], ignorenulls=True).over(every)
            totals = totals.withColumn(f"__t_{n}", F.col(f"__t_{n}").withField("start", start))
    carries = totals.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        *[a.carry(f"__t_{n}", before).alias(f"__c_{n}") for n, a in aggs.items()],
    )
    inside = split.withColumns({f"__l_{n}": c for n, c in local(keys).items()})
    same = reduce(lambda a, b: a & b, [inside[k].eqNullSafe(carries[f"__k_{k}"]) for k in keys])
    # one carry per (heavy key, block): at most blocks + heavy keys
    joined = inside.join(F.broadcast(carries), same, "left")
    done = joined.select(
        *df.columns,
        *[a.combine(F.col(f"__l_{n}"), F.col(f"__c_{n}")).alias(n) for n, a in aggs.items()],
    )
    return done if plain is None else plain.withColumns(local(list(by))).unionByName(done)


def bounded_frame(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    build: Callable[[WindowSpec], dict[str, Column]],
    back: int = 0,
    ahead: int = 0,
    rule: SplitRule = DEFAULT_RULE,
) -> DataFrame:
    """Add columns whose window reaches at most ``back`` rows before and ``ahead`` after.

    ``build`` receives the ordered, unframed window and returns the columns.
    """

    def plain_plan(rows: DataFrame) -> DataFrame:
        return rows.withColumns(build(Window.partitionBy(*by).orderBy(*order)))

    plain, heavy = split_hot(df, by, order, rule)
    if heavy is None:
        return plain_plan(plain)

    size = max(rule.block_rows, 4 * (back + ahead + 1))
    numbered = _number_blocks(heavy, by, order)
    chunk = F.floor(F.col("__pos") / size).cast("long")
    offset = F.col("__pos") % size
    copies = F.array_compact(
        F.array(
            F.lit(0),
            F.when(offset >= size - back, F.lit(1)) if back else F.lit(None).cast("int"),
            F.when(offset < ahead, F.lit(-1)) if ahead else F.lit(None).cast("int"),
        )
    )
    spread = numbered.select("*", F.explode(copies).alias("__copy")).withColumn("__chunk", chunk + F.col("__copy"))
    framed = spread.withColumns(build(Window.partitionBy(*by, "__chunk").orderBy("__pos")))
    done = framed.where(F.col("__copy") == 0).drop("__block", "__pos", "__copy", "__chunk")
    return done if plain is None else plain_plan(plain).unionByName(done)


def _number_blocks(heavy: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """0-based position of each heavy row within its key, from block sizes and in-block order."""
    keys = [*by, "__block"]
    before = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        heavy.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    inside = heavy.withColumn("__in", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = reduce(lambda a, b: a & b, [inside[k].eqNullSafe(starts[f"__k_{k}"]) for k in keys])
    return (
        inside.join(F.broadcast(starts), same, "inner")
        .withColumn("__pos", F.col("__start") + F.col("__in") - 1)
        .drop("__in", "__start", *[f"__k_{k}" for k in keys])
    )


def row_numbers(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rn", rule: SplitRule = DEFAULT_RULE
) -> DataFrame:
    """Exact 1-based row number per key (or over the whole table when ``by`` is empty)."""
    return running(df, by, order, {name: Running("count", F.lit(1))}, rule=rule)


def _slot(value: Column) -> Column:
    """A whole number that never falls as the value rises: 4,096 slots for each factor e of magnitude."""
    scaled = F.signum(value) * F.log1p(F.abs(value) * float(1 << 20)) * 4096
    return F.when(F.isnan(value), F.lit((1 << 63) - 1)).otherwise(F.floor(scaled))


def exact_percentiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated percentiles per key, by narrowing: one way for keys of any size.

    Rows are counted per distinct value, values per slot. Sums over a key's slots (a bounded number) tell the slot in which each wanted rank
    lies, and only values of those slots are put in order. No task holds a key's rows or values. Rows with a NULL key are left out.
    """
    keys = list(by) or ["__all"]
    rows = df if by else df.withColumn("__all", F.lit(0))
    counts = (
        rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (value, *by)]))
        .groupBy(*keys, F.col(value).cast("double").alias("__v"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__slot", _slot(F.col("__v")))
    )
    slots = counts.groupBy(*keys, "__slot").agg(F.sum("__n").alias("__m"))
    key = Window.partitionBy(*keys)
    upto = F.sum("__m").over(key.orderBy("__slot"))
    slots = slots.select(*keys, "__slot", (upto - F.col("__m")).alias("__below"), upto.alias("__upto"), F.sum("__m").over(key).alias("__total"))
    at = {name: F.lit(float(p)) * (F.col("__total") - 1) for name, p in probs.items()}
    ranks = F.array(*[c for x in at.values() for c in (F.floor(x), F.ceil(x))])
    wanted = slots.where(F.exists(ranks, lambda r: (r >= F.col("__below")) & (r < F.col("__upto")))).drop("__upto")
    inside = counts.join(wanted, [*keys, "__slot"])
    last = F.col("__below") + F.sum("__n").over(Window.partitionBy(*keys, "__slot").orderBy("__v"))
    inside = inside.select(*keys, "__v", "__total", (last - F.col("__n")).alias("__from"), last.alias("__to"))
    parts: list[Column] = []
    final: list[Column] = []
    for name, x in at.items():
        for end, rank in (("lo", F.floor(x)), ("hi", F.ceil(x))):
            parts.append(F.max(F.when((rank >= F.col("__from")) & (rank < F.col("__to")), F.col("__v"))).alias(f"__{end}_{name}"))
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        final.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (x - F.floor(x))).alias(name))
    if not by:
        return inside.agg(*parts, F.max("__total").alias("__total")).select(*final)
    return inside.groupBy(*keys, "__total").agg(*parts).select(*keys, *final)


def summarise(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], extra: dict[str, Column]) -> DataFrame:
    """Exact percentiles of a value beside other aggregates of the same groups; rows with a NULL key are left out."""
    rows = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by]))
    others = rows.groupBy(*by).agg(*[e.alias(n) for n, e in extra.items()])
    return others.join(exact_percentiles(df, by, value, probs), list(by), "left")
