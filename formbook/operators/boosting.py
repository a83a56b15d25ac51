"""Boosted trees of ``GBTClassifier`` grown on counts of alike rows.

Trees see a row only through the bin of each feature (``maxBins`` at most), its label and its weight. Rows alike in all of these are one cell with a count, so
a fit reads cells, not rows, and gives what it would give on the rows: counts, draws (a cell of n rows has a binomial number of them drawn) and sums are the rows' own.
Where rows hardly meet in a cell there are as many cells as rows, and they are spread over tasks.

A fit is one job. Up to ``CELLS`` cells are one task's, which needs nobody; more are spread over tasks that work in step (a barrier stage) and sum what a level
needs, nodes x bins numbers, through the driver. A step of a barrier takes Spark a second, so tasks are large. The arrays of a task take 27 bytes a cell, 8 more with
weights, 1 or 2 more per feature and 2 more per joint histogram, and while they are put together up to twice that.
"""

from __future__ import annotations

import base64
import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, TaskContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.util import Identifiable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formbook.session import checkpointed

CELLS = 12_000_000  # of a task of a fit
BLOCK = 65_536  # cells that one step of numpy takes
TOGETHER = 500_000  # rows that Python counts before Spark does
VALUES = 1_000  # of a feature, up to which each one is weighed to place its splits
JOINT = 1_024  # bins that one histogram may have
EPSILON = 2.0**-52


@dataclass(frozen=True)
class Cells:
    """Counted rows: codes of the features in long columns ``k0``, ``k1``, ..., label ``y``, weight ``w``, validation mark ``val``, count ``n``."""

    frame: DataFrame
    parts: int
    cuts: list[np.ndarray]
    weighted: bool


# --- rows to cells ----------------------------------------------------------------


def checked(values: pa.Array, kind: str, fine: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """``values``, unless one is null or not fine; the same rows stop a fit as in pyspark.ml."""
    if values.null_count or not fine(values.to_numpy(zero_copy_only=False)).all():
        raise ValueError(f"{kind}, not null")
    return values


def valid_weights(values: pa.Array) -> pa.Array:
    return checked(values, "weights must be 0 or more", lambda v: v >= 0)


def valid_labels(values: pa.Array) -> pa.Array:
    return checked(values, "labels must be 0 or 1", lambda v: (v == 0) | (v == 1))


def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weight per value of each feature column (the last column is the weight); a feature of more than ``VALUES`` values gives one row without value."""
    seen: list[dict | None] = []
    for b in batches:
        seen, w = seen or [{} for _ in range(b.num_columns - 1)], valid_weights(b.column(b.num_columns - 1))
        for i, at in enumerate(seen):
            if at is None:
                continue
            sums = pa.table({"v": b.column(i), "w": w}).group_by("v").aggregate([("w", "sum")])
            if sums.num_rows <= VALUES:
                for v, of_v in zip(sums["v"].to_pylist(), sums["w_sum"].to_pylist()):
                    at[v] = at.get(v, 0.0) + of_v
            if sums.num_rows > VALUES or len(at) > VALUES:
                seen[i] = None
    rows = [(i, v, w) for i, at in enumerate(seen) for v, w in ([(None, 0.0)] if at is None else at.items())]
    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.float64(), pa.float64()))], ["feature", "value", "weight"])


def strides(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Splits between values of about equal weight, as pyspark.ml places them; all there are, if ``bins`` holds them."""
    order = np.argsort(values)
    values, weights = values[order], weights[order]
    middles = (values[:-1] + values[1:]) / 2.0
    if len(middles) < bins:
        return middles
    stride = weights.sum() / bins
    out, target, count = [], stride, weights[0]
    for i in range(1, len(values)):
        before, count = count, count + weights[i]
        if abs(before - target) < abs(count - target):
            out.append(middles[i - 1])
            target += stride
    return np.array(out)


def splits(df: DataFrame, columns: Sequence[str], weight: str, bins: int) -> list[np.ndarray]:
    """Split points per column, from all rows: exact for columns of up to ``VALUES`` values, else quantiles to a thousandth of the rows."""
    told = df.select(*columns, weight).mapInArrow(weighed, "feature int, value double, weight double")
    found = told.groupBy("feature", "value").agg(F.sum("weight").alias("weight"))
    many = F.max(F.col("value").isNull()) | (F.count(F.lit(1)) > VALUES)
    rows = found.groupBy("feature").agg(F.when(~many, F.collect_list(F.struct("value", "weight"))).alias("rows"))
    few = {r["feature"]: r["rows"] for r in rows.collect()}
    if not few:
        raise ValueError("no rows to fit")
    wide = [i for i in range(len(columns)) if few[i] is None]
    cuts = [np.array([]) if few[i] is None else strides(*np.array(few[i], dtype=float).T, bins) for i in range(len(columns))]
    if wide:
        at = df.approxQuantile([columns[i] for i in wide], [k / bins for k in range(1, bins)], 0.001)
        for i, q in zip(wide, at):
            cuts[i] = np.unique(q)
    return cuts


def layout(cuts: Sequence[np.ndarray]) -> list[tuple[int, int]]:
    """Place of each feature's code: its long column and its shift."""
    out, column, used = [], 0, 0
    for c in cuts:
        bits = len(c).bit_length()
        if used + bits > 62:
            column, used = column + 1, 0
        out.append((column, used))
        used += bits
    return out


def coded(columns: Sequence[str], cuts: Sequence[np.ndarray]) -> Callable:
    places = layout(cuts)
    keys = [f"k{j}" for j in range(places[-1][0] + 1)]

    def gathered(held: list[pa.Table]) -> list[pa.RecordBatch]:
        by = [*keys, "y", "w", "val"]
        return pa.concat_tables(held).group_by(by).aggregate([([], "count_all")]).rename_columns([*by, "n"]).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            packed = {k: np.zeros(b.num_rows, np.int64) for k in keys}
            for name, c, (column, shift) in zip(columns, cuts, places):
                if len(c):
                    # a value at a split goes left of it
                    packed[keys[column]] |= np.searchsorted(c, b.column(name).to_numpy(zero_copy_only=False), side="left").astype(np.int64) << shift
            held.append(pa.table({**packed, "y": valid_labels(b.column("y")), "w": valid_weights(b.column("w")), "val": b.column("val")}))
            rows += b.num_rows
            if rows >= TOGETHER:
                yield from gathered(held)
                held, rows = [], 0
        if held:
            yield from gathered(held)

    return run


def slots(spark: SparkSession) -> int:
    """Tasks that can run at once; one where executors come and go, as Spark allows no barrier stage there."""
    sc = spark.sparkContext
    if sc.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 1
    inner = sc._jsc.sc()
    return max(inner.maxNumConcurrentTasks(inner.resourceProfileManager().defaultResourceProfile()), 1)


def counted(df: DataFrame, columns: Sequence[str], label: str, weight: str | None = None, val: str | None = None, bins: int = 32) -> Cells:
    """Rows of ``df`` counted per cell of ``columns`` (filled doubles); labels are 0 or 1, rows marked ``val`` only stop a fit."""
    y, w = F.col(label).cast("double"), F.col(weight).cast("double") if weight else F.lit(1.0)
    marks = F.coalesce(F.col(val), F.lit(False)) if val else F.lit(False)
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns], y.alias("y"), w.alias("w"), marks.alias("val"))
    cuts = splits(rows.where("NOT val"), columns, "w", bins)
    keys = [f"k{j}" for j in range(layout(cuts)[-1][0] + 1)]
    by = [*keys, "y", "w", "val"]
    schema = ", ".join(f"{k} long" for k in keys) + ", y double, w double, val boolean, n long"
    found = checkpointed(rows.mapInArrow(coded(columns, cuts), schema).groupBy(*by).agg(F.sum("n").alias("n")))
    parts = min(max(-(-found.count() // CELLS), 1), slots(df.sparkSession))
    # dealt and ordered by value, so that reruns draw alike; never in more tasks than run at once, whatever a session makes of the number asked for
    frame = found.repartition(parts, *by) if parts > 1 else found
    frame = checkpointed(frame.coalesce(parts).sortWithinPartitions(*by))
    return Cells(frame, frame.rdd.getNumPartitions(), cuts, weight is not None)


# --- cells to trees ---------------------------------------------------------------


@dataclass(frozen=True)
class Plan:
    """What a task needs of an estimator's parameters."""

    trees: int
    depth: int
    step: float
    least: int
    gain: float
    rate: float
    subset: int
    seed: int
    tol: float | None


def subset_size(strategy: str, n: int) -> int:
    """Features tried at a node, of ``n``, by pyspark.ml's names."""
    named = {"auto": n, "all": n, "sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(n))), "onethird": math.ceil(n / 3.0)}
    if strategy.lower() in named:
        return named[strategy.lower()]
    return min(int(strategy), n) if strategy.isdigit() else math.ceil(float(strategy) * n)


def planned(model: GBTClassifier, features: int, bins: int) -> Plan:
    get = model.getOrDefault
    if get("minWeightFractionPerNode"):
        raise ValueError("a least share of weight per node is not supported")
    if get("maxBins") < bins:
        raise ValueError(f"cells were counted in {bins} bins, maxBins allows {get('maxBins')}")
    tol = get("validationTol") if model.isSet("validationIndicatorCol") else None
    return Plan(get("maxIter"), get("maxDepth"), get("stepSize"), get("minInstancesPerNode"), get("minInfoGain"), get("subsamplingRate"),
                subset_size(get("featureSubsetStrategy"), features), get("seed") & (2**63 - 1), tol)


def summing(parts: int) -> Callable[[np.ndarray], np.ndarray]:
    """Sum over the tasks of a fit, taken in their order, so that each task holds the same digits."""
    if parts == 1:
        return lambda a: a
    context = BarrierTaskContext.get()

    def run(a: np.ndarray) -> np.ndarray:
        told = context.allGather(base64.b64encode(a.astype(np.float64).tobytes()).decode("ascii"))
        return np.sum([np.frombuffer(base64.b64decode(t)).reshape(a.shape) for t in told], axis=0)

    return run


def joined(sizes: Sequence[int]) -> list[list[int]]:
    """Features whose bins are counted in one histogram, larger ones first."""
    groups: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if sizes[i] < 2:
            continue
        for g in groups:
            if math.prod(sizes[j] for j in g) * sizes[i] <= JOINT:
                g.append(i)
                break
        else:
            groups.append([i])
    return groups or [[0]]


class Grower:
    """The cells of one task and the steps of a fit on them."""

    def __init__(self, batches: Iterator[pa.RecordBatch], cuts: Sequence[np.ndarray], weighted: bool, plan: Plan, part: int, total: Callable[[np.ndarray], np.ndarray]):
        self.plan, self.part, self.total, self.weighted = plan, part, total, weighted
        self.sizes = [len(c) + 1 for c in cuts]
        self.groups = joined(self.sizes)
        places, kind = layout(cuts), np.uint8 if max(self.sizes) <= 256 else np.uint16
        pieces: list[tuple] = []
        for b in batches:
            long = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names}
            codes = [((long[f"k{column}"] >> shift) & ((1 << len(c).bit_length()) - 1)).astype(kind) for c, (column, shift) in zip(cuts, places)]
            pieces.append((*codes, *(self.together(codes, g) for g in self.groups), long["y"].astype(np.int8) * 2 - 1, long["val"].astype(bool), long["n"], long["w"]))
        kinds = [*[kind] * len(cuts), *[np.uint16] * len(self.groups), np.int8, bool, np.int64, np.float64]
        arrays = [np.concatenate([np.zeros(0, k), *(p[i] for p in pieces)]).astype(k) for i, k in enumerate(kinds)]
        del pieces
        self.codes, self.joint = arrays[: len(cuts)], arrays[len(cuts) : -4]
        self.y, self.val, n, self.w = arrays[-4:]
        self.held = np.flatnonzero(self.val)
        self.held_w = n[self.held] * self.w[self.held]
        n[self.held] = 0
        self.n = n if len(n) and n.max() >= 2**31 else n.astype(np.int32)
        if not weighted:
            self.w = None
        self.f = np.zeros(len(self.y))

    def together(self, codes: Sequence[np.ndarray], group: Sequence[int]) -> np.ndarray:
        out = np.zeros(len(codes[0]), np.uint16)
        for i in group:
            out = out * np.uint16(self.sizes[i]) + codes[i]
        return out

    def blocks(self) -> Iterator[slice]:
        return (slice(a, a + BLOCK) for a in range(0, len(self.y), BLOCK))

    def sums(self, node: np.ndarray, nodes: int, drawn: np.ndarray, r: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Per feature rows, weight and weighted residuals by (node, bin), and the weighted squares by node; cells with ``node == nodes`` are done."""
        shapes = [(nodes + 1, math.prod(self.sizes[i] for i in g)) for g in self.groups]
        kinds = 3 if self.weighted else 2
        held = [np.zeros((kinds, s[0] * s[1])) for s in shapes]
        squares = np.zeros(nodes + 1)
        for at in self.blocks():
            d = drawn[at].astype(np.float64)
            dw = d * self.w[at] if self.weighted else d
            dr, base = dw * r[at], node[at].astype(np.intp)
            squares += np.bincount(base, dr * r[at], nodes + 1)
            for out, code, (_, size) in zip(held, self.joint, shapes):
                key = base * size + code[at]
                for row, v in zip(out, (d, dw, dr) if self.weighted else (d, dr)):
                    row += np.bincount(key, v, len(row))
        flat: list[np.ndarray] = [squares[:nodes]]
        order = []
        for g, out, shape in zip(self.groups, held, shapes):
            cube = out.reshape(kinds, shape[0], *[self.sizes[i] for i in g])[:, :nodes]
            for j, i in enumerate(g):
                others = tuple(2 + k for k in range(len(g)) if k != j)
                order.append(i)
                flat.append(cube.sum(axis=others).ravel())
        told = self.total(np.concatenate(flat))
        squares, at, found = told[:nodes], nodes, [None] * len(self.sizes)
        for i in order:
            size = kinds * nodes * self.sizes[i]
            h = told[at : at + size].reshape(kinds, nodes, self.sizes[i])
            found[i] = h if self.weighted else h[[0, 0, 1]]
            at += size
        return found, squares

    def best(self, hists: Sequence, j: int, all_of: np.ndarray, rng: np.random.Generator) -> tuple | None:
        """Feature, place and gain of the best split of node ``j``, with rows, weight and residuals left of it."""
        plan, count, sizes = self.plan, len(self.sizes), self.sizes
        tried = range(count) if plan.subset >= count else sorted(rng.choice(count, plan.subset, replace=False))
        out = None
        for i in tried:
            if sizes[i] < 2:
                continue
            left = hists[i][:, j].cumsum(axis=1)[:, :-1]
            c, w, s = left
            right = all_of[:, None] - left
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (s * s / w + right[2] ** 2 / right[1] - all_of[2] ** 2 / all_of[1]) / all_of[1]
            fine = (c >= plan.least) & (right[0] >= plan.least) & (w > 0) & (right[1] > 0) & (gain >= plan.gain) & (gain > 0)
            gain = np.where(fine, gain, -1.0)
            k = int(gain.argmax())
            if gain[k] > 0 and (out is None or gain[k] > out[2]):
                out = (int(i), k, float(gain[k]), left[:, k])
        return out

    def tree(self, number: int) -> dict:
        """One tree on the residuals so far; predictions move by its share."""
        plan = self.plan
        share = 1.0 if number == 0 else plan.step
        draws, rng = np.random.default_rng([2, plan.seed, number, self.part]), np.random.default_rng([1, plan.seed, number])
        r, drawn = np.empty(len(self.y)), self.n if plan.rate >= 1.0 else np.empty_like(self.n)
        with np.errstate(over="ignore"):
            for at in self.blocks():
                y = self.y[at].astype(np.float64)
                r[at] = y if number == 0 else 4.0 * y / (1.0 + np.exp(2.0 * y * self.f[at]))
                if plan.rate < 1.0:
                    drawn[at] = draws.binomial(self.n[at], plan.rate)
        node = np.zeros(len(r), np.uint8 if plan.depth < 8 else np.uint32)
        root: dict = {}
        active = [root]
        for level in range(max(plan.depth, 1)):
            nodes = len(active)
            hists, squares = self.sums(node, nodes, drawn, r)
            split_at, after, done = [], [], np.zeros(nodes + 1)
            for j, at in enumerate(active):
                # any feature's bins add up to the node
                all_of = hists[self.groups[0][0]][:, j].sum(axis=1)
                rows, w, s = all_of
                mean = s / w if w > 0 else 0.0
                impurity = squares[j] / w - mean * mean if w > 0 else 0.0
                at.update(p=mean, impurity=max(impurity, 0.0), stats=[w, s, squares[j]], rows=int(rows))
                found = self.best(hists, j, all_of, rng) if level < plan.depth and impurity >= EPSILON else None
                if found is None:
                    done[j] = mean
                    continue
                i, k, gain, left = found
                right = all_of - left
                at.update(feature=i, at=k, gain=gain, left={}, right={})
                if level + 1 == plan.depth:
                    for side, (c, sw, ss) in (("left", left), ("right", right)):
                        # squares are not summed below the last split
                        at[side].update(p=ss / sw, impurity=math.nan, stats=[sw, ss, math.nan], rows=int(c))
                split_at.append((j, i, k, len(after)))
                after += [at["left"], at["right"]]
            if done.any():
                for at in self.blocks():
                    self.f[at] += (share * done)[node[at]]
            if not split_at:
                break
            last = level + 1 == plan.depth
            means = share * np.array([*[a["p"] for a in after], 0.0]) if last else None
            for at in self.blocks():
                to = np.full(len(node[at]), len(after), node.dtype)
                for j, i, k, first in split_at:
                    np.copyto(to, (self.codes[i][at] > k) + node.dtype.type(first), where=node[at] == j)
                if last:
                    self.f[at] += means[to]
                node[at] = to
            active = after
        return root

    def error(self) -> float:
        """Mean loss of the validation rows."""
        e = 2.0 * np.logaddexp(0.0, -2.0 * self.y[self.held] * self.f[self.held])
        top, weight = self.total(np.array([(e * self.held_w).sum(), self.held_w.sum()]))
        return float(top / weight) if weight > 0 else math.nan

    def grow(self) -> list[dict]:
        """All trees; with validation rows only up to the best error, as soon as it no longer gains."""
        out, best, kept = [], math.nan, 1
        for number in range(self.plan.trees):
            out.append(self.tree(number))
            if self.plan.tol is None:
                continue
            now = self.error()
            if number == 0:
                best = now
            elif best - now < self.plan.tol * max(now, 0.01):
                break
            elif now < best:
                best, kept = now, number + 1
        return out if self.plan.tol is None else out[:kept]


def grown(cells: Cells, plan: Plan) -> list[dict]:
    parts, cuts, weighted = cells.parts, cells.cuts, cells.weighted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        trees = Grower(batches, cuts, weighted, plan, part, summing(parts)).grow()
        if part == 0:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(t) for t in trees])], ["tree"])

    return [json.loads(r["tree"]) for r in cells.frame.mapInArrow(run, "tree string", barrier=parts > 1).collect()]


def fit(model: GBTClassifier, cells: Cells) -> GBTClassificationModel:
    """``model`` fitted on counted rows."""
    plan = planned(model, len(cells.cuts), max(len(c) for c in cells.cuts) + 1)
    trees = grown(cells, plan)
    spark = cells.frame.sparkSession
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    ml, calculator = jvm.org.apache.spark.ml, jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator

    def node(t: dict):
        stats = gateway.new_array(jvm.double, 3)
        for i, v in enumerate(t["stats"]):
            stats[i] = float(v)
        about = calculator(stats, int(t["rows"]))
        if "feature" not in t:
            return ml.tree.LeafNode(float(t["p"]), float(t["impurity"]), about)
        split = ml.tree.ContinuousSplit(t["feature"], float(cells.cuts[t["feature"]][t["at"]]))
        return ml.tree.InternalNode(float(t["p"]), float(t["impurity"]), float(t["gain"]), node(t["left"]), node(t["right"]), split, about)

    tree = ml.regression.DecisionTreeRegressionModel
    made, shares = gateway.new_array(tree, len(trees)), gateway.new_array(jvm.double, len(trees))
    for i, t in enumerate(trees):
        made[i] = tree(Identifiable._randomUID.__func__(GBTClassificationModel), node(t), len(cells.cuts))
        shares[i] = 1.0 if i == 0 else plan.step
    out = GBTClassificationModel(ml.classification.GBTClassificationModel(model.uid, made, shares, len(cells.cuts), 2))
    return model._copyValues(out)
