"""Hard negatives by exact inner products in a residue number system.

Method. Vectors become integers, floor(scale * x). A block of scores is one matrix product per prime: both sides are taken modulo the prime, as numbers around
zero, and multiplied in single precision, STEP dimensions at once, which no rounding can touch (STEP * ((p - 1) / 2) ** 2 < 2 ** 24); sums are reduced modulo the prime. As many primes are
used as the largest score that the two sides' lengths allow needs, and Chinese remaindering, in mixed radix, gives the signed scores. Windows then select: an anchor's
best rows of its own label are its positives; of the rows of other labels, those with a score between ``low`` and ``high`` hundredths of a positive's score are its negatives, best first.

At scale. Anchors and rows are cut into blocks by a hash, of about ``block`` each, and each two blocks meet once in one task, which holds a tile of scores; nothing is broadcast. First tiles
of one label only (positives), then tiles of anchors and all rows. A tile returns at most ``positives`` rows per anchor, or ``negatives`` per anchor and positive, and a window ranks what is left.
A label with a third of all rows is more blocks, not larger ones.

Defined results: rows with a null id or label, a null vector, or a null or non-finite component take no part; rows that share an id are one row, the least by
label, then vector; vectors meet vectors of their own length, empty ones with a score of 0; ties go to the smaller id; scores beyond 64 bits count as the
nearest number of 64 bits; a positive with a score below 0 has no negatives, one of 0 has those of 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.session import checkpointed

STEP = 64  # dimensions of one product
TILE = 4_000_000  # scores held at once
LONG = 2.0**31  # vectors longer than this are multiplied in whole numbers of any size
_LEAST, _MOST = -(2**63), 2**63 - 1


def primes(below: int, many: int) -> list[int]:
    """The largest odd primes up to ``below``."""
    found = [n for n in range(below, 2, -1) if all(n % d for d in range(2, int(n**0.5) + 1))]
    return found[:many]


PRIMES = primes(2 * int((2**24 / STEP) ** 0.5), 8)


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """``x`` modulo p, as numbers from -(p - 1) / 2 to (p - 1) / 2."""
    r = np.fmod(x, p)
    half = (p - 1) // 2
    return (r - p * (r > half) + p * (r < -half)).astype(np.float32)


def needed(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Primes enough for every score of the two sides: a score is at most the product of the two lengths."""
    most = float(np.sqrt((a * a).sum(1).max(initial=0)) * np.sqrt((b * b).sum(1).max(initial=0))) * (1 + 1e-9) + 1
    modulus, taken = 1, []
    for p in PRIMES:
        if modulus > 2 * most:
            break
        taken.append(p)
        modulus *= p
    return taken


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of rows of ``a`` and ``b``, whole numbers held as doubles, exactly as 64-bit numbers."""
    if not a.shape[1] or not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    taken = needed(a, b)
    digits: list[np.ndarray] = []
    for p in taken:
        ra, rb = residues(a, p), residues(b, p)
        left = np.zeros((len(a), len(b)), np.float32)
        for at in range(0, a.shape[1], STEP):
            part = ra[:, at : at + STEP] @ rb[:, at : at + STEP].T
            # both are whole and below 2 ** 24
            left += part - p * np.round(part * np.float32(1 / p))
        r = left.astype(np.int64) % p
        # mixed radix: what the digits so far say is taken off, the rest divided by the primes so far
        for q, digit in zip(taken, digits):
            r = (r - digit) * pow(q, -1, p) % p
        digits.append(np.where(r > (p - 1) // 2, r - p, r))
    total = np.zeros((len(a), len(b)), np.int64)
    for p, digit in zip(reversed(taken), reversed(digits)):
        total = total * np.int64(p) + digit
    return total


def long_vectors(x: np.ndarray) -> np.ndarray:
    return np.abs(x).max(axis=1, initial=0) * max(1, x.shape[1]) ** 0.5 > LONG


def all_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As ``scores``; long vectors in whole numbers of any size, cut to 64 bits."""
    far_a, far_b = long_vectors(a), long_vectors(b)
    if not far_a.any() and not far_b.any():
        return scores(a, b)
    out = np.zeros((len(a), len(b)), np.int64)
    out[np.ix_(~far_a, ~far_b)] = scores(a[~far_a], b[~far_b])
    for rows, columns in ((far_a, np.ones(len(b), bool)), (~far_a, far_b)):
        x, y = ([[int(v) for v in row] for row in side] for side in (a[rows], b[columns]))
        out[np.ix_(rows, columns)] = [[min(max(sum(p * q for p, q in zip(u, v)), _LEAST), _MOST) for v in y] for u in x] or np.zeros((0, int(columns.sum())))
    return out


def best(held: np.ndarray, count: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, value) of the ``count`` largest of each row, ties to the first column; ``_LEAST`` marks what does not count. ``held`` is used up."""
    rows = np.arange(len(held))
    for _ in range(min(count, held.shape[1])):
        at = held.argmax(axis=1)
        value = held[rows, at]
        some = value > _LEAST
        if not some.any():
            return
        yield rows[some], at[some], value[some]
        held[rows, at] = _LEAST


def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(rows, -1) if len(values) else np.zeros((rows, 0))


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _rows(found: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Table:
    columns = [np.concatenate([np.zeros(0, np.int64), *[f[i] for f in found]]) for i in range(len(names))]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})


def _near(count: int):
    """The best rows of an anchor's own label within two blocks."""

    def tile(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if anchors.num_rows and rows.num_rows:
            rows = rows.sort_by("id")
            a, b = matrix(anchors.column("v"), anchors.num_rows), matrix(rows.column("v"), rows.num_rows)
            own, ids = _numbers(anchors, "id"), _numbers(rows, "id")
            step = max(1, TILE // len(b))
            for at in range(0, len(a), step):
                held = np.maximum(all_scores(a[at : at + step], b), _LEAST + 1)
                held[own[at : at + step, None] == ids[None, :]] = _LEAST
                found += [(own[at + i], ids[j], value) for i, j, value in best(held, count)]
        return _rows(found, ["anchor_id", "positive_id", "positive_score"])

    return tile


def _hard(count: int):
    """The best rows of other labels within two blocks, for each positive within its bounds."""

    def tile(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if anchors.num_rows and rows.num_rows:
            rows = rows.sort_by("id")
            a, b = matrix(anchors.column("v"), anchors.num_rows), matrix(rows.column("v"), rows.num_rows)
            own, ids = _numbers(anchors, "id"), _numbers(rows, "id")
            label, labels = _numbers(anchors, "label"), _numbers(rows, "label")
            bounds = anchors.column("bounds").to_pylist()
            step = max(1, TILE // len(b))
            for at in range(0, len(a), step):
                all_ = np.maximum(all_scores(a[at : at + step], b), _LEAST + 1)
                all_[label[at : at + step, None] == labels[None, :]] = _LEAST
                mine = bounds[at : at + step]
                for nth in range(max(len(x) for x in mine)):
                    who = np.array([i for i, x in enumerate(mine) if len(x) > nth])
                    lo, hi, positive, scored = (np.array([mine[i][nth][n] for i in who]) for n in ("lo", "hi", "positive_id", "positive_score"))
                    part = all_[who]
                    held = np.where((part <= hi[:, None]) & (part >= lo[:, None]), part, _LEAST)
                    found += [(own[at + who[i]], positive[i], scored[i], ids[j], value) for i, j, value in best(held, count)]
        return _rows(found, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return tile


def usable(vector: Column) -> Column:
    fine = F.forall(vector.cast("array<double>"), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def prepared(vectors: DataFrame, is_anchor: Column, scale: float, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, v, width, anchor), one row per id."""
    most = float(np.finfo(np.float64).max)

    def whole(x: Column) -> Column:
        y = F.greatest(F.least(x * float(scale), F.lit(most)), F.lit(-most))
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)  # beyond it every double is whole

    v = F.transform(F.col(vector).cast("array<double>"), whole)
    rows = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & usable(F.col(vector)))
    rows = rows.select(F.col(key).cast("long").alias("id"), F.struct(F.col(label).cast("long").alias("label"), v.alias("v"), is_anchor.alias("anchor")).alias("r"))
    once = rows.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.*")
    return once.withColumn("width", F.size("v")).withColumn("anchor", F.coalesce("anchor", F.lit(False)))


def _met(anchors: DataFrame, rows: DataFrame, by: list[str], block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with blocks ``_a`` and ``_r``, each anchor once per block of rows and each row once per block of anchors of its key."""
    sizes = rows.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias("_rs"))
    asked = anchors.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias("_as"))
    cuts = checkpointed(sizes.join(asked, by))

    def cut(side: DataFrame, mine: str, other: str, own: str, all_: str) -> DataFrame:
        marked = side.join(cuts, by)
        return marked.withColumn(own, F.pmod(F.xxhash64("id", F.lit(mine)), F.col(mine)).cast("int")).withColumn(all_, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_rs", "_as")

    # columns of its own: both sides come from one table
    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])
    return cut(anchors, "_as", "_rs", "_a", "_r"), cut(rows, "_rs", "_as", "_r", "_a")


def _tiles(anchors: DataFrame, rows: DataFrame, by: list[str], block: int, work, schema: str) -> DataFrame:
    a, r = _met(anchors, rows, by, block)
    keys = [*by, "_a", "_r"]
    return a.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(work, schema)


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256, block: int = 16384,
    key: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = checkpointed(prepared(vectors, is_anchor, scale, key, vector, label))
    anchors = rows.where("anchor").drop("anchor")
    rows = rows.drop("anchor")
    near = _tiles(anchors, rows, ["width", "label"], block, _near(positives), "anchor_id long, positive_id long, positive_score long")
    first = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    chosen = near.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= positives)
    # low * p <= 100 * n <= high * p, in whole numbers of any size
    p = F.col("positive_score").cast("decimal(19,0)")
    bounds = F.struct((F.ceil(p * low / 100)).cast("long").alias("lo"), F.floor(p * high / 100).cast("long").alias("hi"), "positive_id", "positive_score")
    wanted = chosen.where("positive_score >= 0").groupBy("anchor_id").agg(F.collect_list(bounds).alias("bounds")).withColumnRenamed("anchor_id", "_id")
    asked = checkpointed(anchors.join(wanted, F.col("id") == F.col("_id")).drop("_id"))
    hard = _tiles(asked, rows, ["width"], block, _hard(negatives), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    best_first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = hard.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
