"""Exact top-k by inner product with pivot-table elimination.

Method. Vectors become integers, floor(scale * x). For a block of candidates the distances to many pivots are tabled once; with a query's
distances to the same pivots, max over pivots of |d(q, p) - d(x, p)| bounds d(q, x) from below, hence the inner product from
above: (|q|^2 + |x|^2 - bound^2) / 2. Candidates are scored in the order of their bounds until the next bound is below the k-th best
score. All scores are exact integers; a bound only decides what need not be scored.

At scale. Queries and candidates are both cut into blocks by a hash of the id, of at most about ``query_block`` and ``row_block`` rows, and
every pair of blocks is one group: memory per task is fixed, nothing is broadcast but the pivots (a fixed number), and each group
returns at most k rows per query, which are then ranked per query.

Defined results: vectors that are null, or hold a null or a value that is not finite, take no part, neither do null ids; vectors of another length than the most common
one (ties: the longer) take no part; ties go to the smaller id; a query's own row is no candidate, nor is another row with its id; repeated
rows of an id that is a candidate count once each; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.session import checkpointed

FIRST = 256  # candidates scored at first
TOGETHER = 32  # queries whose bounds are computed in one step


def whole(vector: Column, scale: float) -> Column:
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))


def usable(vector: Column) -> Column:
    fine = F.forall(vector.cast("array<double>"), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def exact_type(q: np.ndarray, x: np.ndarray) -> type:
    """The narrowest type in which inner products of these integers are exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[-1], 1)
    return np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(float), b.astype(float)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0))


def search(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, pivots: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its place, and the ids and scores of the k best of this block (fewer, if there are fewer)."""
    kind = exact_type(queries, rows)
    x, qs = np.ascontiguousarray(rows.astype(kind)), queries.astype(kind)
    table = np.ascontiguousarray(distances(pivots, rows), np.float32)
    to_pivots = distances(queries, pivots).astype(np.float32)
    norms, own = (rows.astype(float) ** 2).sum(1), (queries.astype(float) ** 2).sum(1)
    # distances are rounded to single precision; what that can move is taken off the gap
    slack = np.float32(4e-7) * (table.max(initial=0) + to_pivots.max(initial=0)) + np.float32(1e-3)
    for at in range(0, len(queries), TOGETHER):
        part = slice(at, at + TOGETHER)
        gap = np.zeros((len(to_pivots[part]), len(rows)), np.float32)
        for p in range(len(pivots)):
            np.maximum(gap, np.abs(table[p][None, :] - to_pivots[part, p][:, None]), out=gap)
        np.maximum(gap - slack, 0, out=gap)
        bounds = (own[part, None] + norms[None, :] - gap.astype(float) ** 2) / 2 + 1e-6 * (1 + own[part, None] + norms[None, :])
        for j, bound in enumerate(bounds):
            i = at + j
            bound[row_ids == query_ids[i]] = -np.inf
            yield i, *best_of(bound, x, qs[i], row_ids, k)


def best_of(bound: np.ndarray, x: np.ndarray, q: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores candidates in the order of their bounds, in growing steps, until no bound left reaches the k-th best score."""
    ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    left = np.flatnonzero(bound > -np.inf)
    step = max(FIRST, k)
    while len(left):
        if len(left) > step:
            order = np.argpartition(-bound[left], step - 1)
            now, left = left[order[:step]], left[order[step:]]
        else:
            now, left = left, left[:0]
        found = (x[now] @ q) if len(now) < len(x) // 2 else (x @ q)[now]
        found = found.astype(np.int64)
        if len(scores) >= k:
            worth = found >= scores[k - 1]
            now, found = now[worth], found[worth]
        ids, scores = np.concatenate([ids, row_ids[now]]), np.concatenate([scores, found])
        order = np.lexsort((ids, -scores))[:k]
        ids, scores = ids[order], scores[order]
        if len(scores) >= k:
            left = left[bound[left] >= scores[k - 1]]
        step *= 8
    return ids, scores


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64, pivots: int = 16, query_block: int = 2048, row_block: int = 16384, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of every query."""
    good = vectors.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), whole(F.col(vector), scale).alias("v"), is_query.alias("q"))
    good = checkpointed(good)
    common = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("d").desc()).first()
    width = common["d"] if common else 1
    good = good.where(F.size("v") == width)
    n = common["n"] if common else 0
    n_queries = good.where("q").count()
    row_blocks, query_blocks = max(1, -(-n // row_block)), max(1, -(-n_queries // query_block))
    # distinct vectors spread by hash: a fixed number of rows
    chosen = [r["v"] for r in good.select("v").dropDuplicates().orderBy(F.xxhash64("v"), "v").limit(pivots).collect()]
    table = np.array(chosen or [[0] * width], np.int64)
    mine = F.pmod(F.xxhash64("id", F.lit("row")), F.lit(row_blocks)).cast("int")
    asked = F.pmod(F.xxhash64("id", F.lit("query")), F.lit(query_blocks)).cast("int")
    candidates = good.select("id", "v", mine.alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
    queries = good.where("q").select("id", "v", asked.alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"))

    def block(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if q.empty or x.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        # a query row written twice is one query
        q = q.drop_duplicates("id")
        found = list(search(np.stack(q["v"].to_numpy()).astype(np.int64), q["id"].to_numpy(np.int64), np.stack(x["v"].to_numpy()).astype(np.int64), x["id"].to_numpy(np.int64), table, k))
        ids = q["id"].to_numpy(np.int64)
        return pd.DataFrame({"query_id": np.repeat([ids[i] for i, _, _ in found], [len(a) for _, a, _ in found]), "vec_id": np.concatenate([a for _, a, _ in found]), "score": np.concatenate([s for _, _, s in found])})

    parts = queries.groupBy("qb", "rb").cogroup(candidates.groupBy("qb", "rb")).applyInPandas(block, "query_id long, vec_id long, score long")
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
