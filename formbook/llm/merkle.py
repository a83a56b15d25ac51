"""Merkle manifest of a dataset by time-forward processing.

Method. Every row is a leaf, every group a tree over its leaves in the order of their key, and the subroots of the groups are the leaves of one more tree. A node's
label is (level, place); a parent's label is greater than its children's. Nodes are processed in the order of their labels: a node takes its children's
digests from a priority queue, in which they wait under its label, and sends its own digest to its parent. Then the sweep is reversed: each node, from
the root down, takes the rest of the proof above it and sends it, with its own step put in front, to its children, so that a leaf receives its whole proof.

At scale. The external part of the queue is Spark's sorted exchange: messages to nodes of one subtree of ``HEIGHT`` levels are rows that a shuffle brings, in the order of their
labels, into one task, which runs the queue for that subtree in memory (at most FAN ** HEIGHT messages) and sends one message to the next subtree above, in the next round. Rounds are the
logarithm of the leaves to the base of FAN ** HEIGHT. A group with a third of all rows is as many subtrees as any rows. Texts are read once and never shuffled: what travels are
a key, a place and a digest of 32 bytes; proofs go down with their subtrees and are put in front of the leaves in the last step only.

Digests are lower-case hex SHA-256 of inputs written one after the other, digests as hex text. While more than one node of a tree remains, every FAN of them in a row (the last run: fewer, even
one) become one. A proof is a list of steps, from leaf to root: the digests of the run before and after the node, in order.

Defined results: a null key, group or field is a value of its own and comes first; rows that share a key are ordered by their digests; rows alike in every field are leaves
of their own, which of them stands first is of no effect; empty and very long texts are values like others; an empty table gives no rows; other columns stay out unless kept.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.session import checkpointed

FAN = 8
HEIGHT = 4
EMIT = 1000  # proofs handed back to Spark at once
STEPS = "array<struct<before:string,after:string>>"


def digest_of(fields: Sequence[Column]) -> Column:
    """H of values: ``-`` for a null, else the length in bytes, a colon and the value."""
    said = []
    for field in fields:
        value = field.cast("string")
        said.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*said), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and a proof lead to."""
    return F.aggregate(proof, leaf, lambda at, step: F.sha2(F.concat(step["before"], at, step["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """H of all digests of a proof, from leaf to root and left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def _group_key(column: Column) -> Column:
    """Null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("1"), column.cast("string")), F.lit("0"))


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (with ``_group``) and, per group, the row's place ``_at`` and the number of rows ``_n``.

    Rows are sorted in ranges; a row's place is its place in its range and the rows of its group in the ranges before. Rows alike in all of ``order`` are
    cut by where they were read, so they are no single range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["_group", *order, "_tie"]
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_tie")
    at = F.monotonically_increasing_id()
    ranged = checkpointed(ranged.withColumn("_part", F.shiftright(at, 33)).withColumn("_row", at.bitwiseAND((1 << 33) - 1)))
    runs = ranged.groupBy("_part", "_group").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    group = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_rows").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("_part").alias("_p"), F.col("_group").alias("_g"), (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(group).alias("_n"))
    joined = ranged.join(runs, (F.col("_part") == F.col("_p")) & (F.col("_group") == F.col("_g")))
    return joined.withColumn("_at", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_p", "_g", "_shift")


def subtrees(rows: DataFrame, height: int) -> DataFrame:
    """Rows of a subtree in one partition one after the other, in the order of their places."""
    block = F.floor(F.col("_at") / FAN**height).cast("long")
    cut = rows.withColumn("_block", F.when(F.col("_at") >= 0, block).otherwise(-1 - F.col("_at")))
    return cut.repartition("_group", "_block").sortWithinPartitions("_group", "_block", "_at")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold one subtree each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        groups, blocks = batch.column("_group"), batch.column("_block")
        code = groups.dictionary_encode().indices.to_numpy()
        block = blocks.to_numpy()
        cuts = np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1])) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        if held and not (held[-1].column("_group")[0].equals(groups[0]) and held[-1].column("_block")[0].equals(blocks[0])):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def sweep(digests: list[str], nodes: int, first: int, height: int = HEIGHT) -> list[list[str]]:
    """The levels of one subtree, each the digests of its nodes, from ``digests`` up to ``height`` levels or the root of the tree.

    ``nodes`` is the number of nodes of the whole tree on the lowest level and ``first`` the place of the subtree's first. The queue holds (level, place of the parent, place, digest).
    """
    left = [nodes]
    while len(left) <= height and left[-1] > 1:
        left.append(-(-left[-1] // FAN))
    top = len(left) - 1
    levels: list[list[str]] = [[] for _ in left]
    levels[0] = digests
    if not top:
        return levels
    queue = [(1, (first + i) // FAN, first + i, d) for i, d in enumerate(digests)]  # in order, so a heap
    while queue:
        level, label = queue[0][:2]
        run = []
        while queue and queue[0][0] == level and queue[0][1] == label:
            run.append(heapq.heappop(queue)[3])
        digest = hashlib.sha256("".join(run).encode()).hexdigest()
        levels[level].append(digest)
        if level < top:
            heapq.heappush(queue, (level + 1, label // FAN, label, digest))
    return levels


def _up(height: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The digest that each subtree sends on."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for tree in _whole(batches):
            n, first, block = tree.column("_n")[0].as_py(), tree.column("_at")[0].as_py(), tree.column("_block")[0].as_py()
            levels = sweep([d.hex() for d in tree.column("_digest").to_pylist()], n, first, height)
            for _ in levels[1:]:
                n = -(-n // FAN)
            out.append((tree.column("_group")[0].as_py(), block, n, bytes.fromhex(levels[-1][0])))
            if len(out) >= EMIT:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    return send


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    g, a, n, d = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(d, pa.binary())], names=["_group", "_at", "_n", "_digest"])


def _down(names: list[str], height: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Delivers proofs within subtrees: the first row of a subtree is the message from above, the others are its nodes. Their columns ``names`` are kept."""

    def deliver(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree in _whole(batches):
            above, subroot = tree.column("_steps")[0].as_py(), tree.column("_subroot")[0].as_py()
            tree = tree.slice(1)
            if not tree.num_rows:
                continue
            first = tree.column("_at")[0].as_py()
            levels = sweep([d.hex() for d in tree.column("_digest").to_pylist()], tree.column("_n")[0].as_py(), first, height)
            # reversed sweep: the rest of the proof, node by node, from the top level to the lowest; a run's digests are joined once
            rest = [[(s["before"], s["after"]) for s in above]]
            low = first // FAN ** (len(levels) - 1)
            for level in range(len(levels) - 2, -1, -1):
                nodes, start = levels[level], first // FAN**level
                runs: dict[int, str] = {}
                for i in range(0, len(nodes), FAN):
                    runs[(start + i) // FAN] = "".join(nodes[i : i + FAN])
                sent = []
                for i in range(len(nodes)):
                    parent, at = divmod(start + i, FAN)
                    run = runs[parent]
                    sent.append([(run[: 64 * at], run[64 * (at + 1) :]), *rest[parent - low]])
                rest, low = sent, start
            if len(levels) == 1:
                rest = rest * tree.num_rows
            for at in range(0, tree.num_rows, EMIT):
                part, mine = tree.slice(at, EMIT), rest[at : at + EMIT]
                flat = [step for steps in mine for step in steps]
                pairs = pa.StructArray.from_arrays([pa.array([b for b, _ in flat], pa.string()), pa.array([a for _, a in flat], pa.string())], names=["before", "after"])
                ends = np.concatenate([[0], np.cumsum([len(steps) for steps in mine])]).astype(np.int32)
                proofs = pa.ListArray.from_arrays(pa.array(ends), pairs)
                columns = [pa.concat_arrays(part.column(n).chunks) for n in names]
                told = pa.array([subroot] * part.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, proofs, told], names=[*names, "_steps", "_subroot"])

    return deliver


def climbed(rows: DataFrame, height: int) -> list[DataFrame]:
    """Rounds of the sweep: rows of (_group, _at, _n, _digest) per round, first ``rows``, last one row per group."""
    rounds = [rows]
    while True:
        now = rounds[-1].select("_group", "_at", "_n", "_digest")
        most = now.agg(F.max("_n")).first()[0]
        if most is None or most <= 1:
            return rounds
        rounds.append(checkpointed(subtrees(now, height).mapInArrow(_up(height), "_group string, _at long, _n long, _digest binary")))


def delivered(rounds: list[DataFrame], proofs: DataFrame, keep: Sequence[str], height: int) -> DataFrame:
    """The reversed sweep: ``proofs`` has (_group, _steps, _subroot), the proof of each group's root and the root. Returns columns ``keep`` of the first round, ``_steps`` and ``_subroot``."""
    if len(rounds) == 1:
        # every group is one node
        return rounds[0].join(proofs, "_group").select(*keep, "_steps", "_subroot")
    above = proofs.select("_group", F.lit(0).cast("long").alias("_block"), "_steps", "_subroot")
    for turn in range(len(rounds) - 2, -1, -1):
        rows = rounds[turn]
        names = list(keep) if turn == 0 else ["_group", "_at"]
        # the message to a subtree stands before its nodes: its place is -1 - block
        others = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c not in ("_group", "_at")]
        message = above.select("_group", (-1 - F.col("_block")).alias("_at"), "_steps", "_subroot", *others)
        waiting = rows.withColumn("_steps", F.lit(None).cast(STEPS)).withColumn("_subroot", F.lit(None).cast("string"))
        kinds = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
        told = subtrees(waiting.unionByName(message), height).mapInArrow(_down(names, height), f"{kinds}, _steps {STEPS}, _subroot string")
        if turn:
            above = checkpointed(told).select("_group", F.col("_at").alias("_block"), "_steps", "_subroot")
    return told


def manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", group: str = "lang", keep: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """One row per row of ``docs``: its key, leaf, subroot, root and proof (list of steps, see above), and columns ``keep`` computed from it, which must be small."""
    keep = keep or {}
    taken = {f"_k{i}": c for i, c in enumerate(keep.values())}
    digest = F.unhex(digest_of([F.col(c) for c in fields]))
    narrow = docs.select(F.col(key).alias("_key"), _group_key(F.col(group)).alias("_group"), digest.alias("_digest"), *[c.alias(n) for n, c in taken.items()])
    leaves = checkpointed(placed(checkpointed(narrow), ["_key", "_digest"]))
    rounds = climbed(leaves, height)
    forest = checkpointed(placed(rounds[-1].select(F.col("_group").alias("_name"), F.lit("").alias("_group"), "_digest"), ["_name"]))
    upper = climbed(forest, height)
    root = upper[-1].agg(F.max("_digest")).first()[0]
    start = upper[-1].select("_group", F.array().cast(STEPS).alias("_steps"), F.lit(None).cast("string").alias("_subroot"))
    proofs = checkpointed(delivered(upper, start, ["_name", "_digest"], height).select(F.col("_name").alias("_group"), "_steps", F.lower(F.hex("_digest")).alias("_subroot")))
    told = delivered(rounds, proofs, ["_key", "_digest", *taken], height)
    return told.select(
        F.col("_key").alias(key), F.lower(F.hex("_digest")).alias("leaf"), F.col("_subroot").alias("subroot"), F.lit(root.hex() if root is not None else None).cast("string").alias("root"),
        F.col("_steps").alias("proof"), *[F.col(n).alias(c) for n, c in zip(taken, keep, strict=True)],
    )
