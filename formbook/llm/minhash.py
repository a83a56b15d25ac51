"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

Method. A text is the bag of its runs of five words (lower-cased ASCII, cut at white space; texts of one to four words are one run). A run weighs
its count times an inverse document frequency. Consistent weighted sampling draws from each bag, for each of K hash functions, one
(run, level), such that two bags draw the same with a probability equal to their weighted Jaccard similarity. Draws are cut into bands; texts that
share a band are candidates, and a candidate counts after its weighted Jaccard similarity has been computed. Connected texts are one class.

Document frequencies cover the whole corpus, each distinct text once, so copies alike to the byte leave the weights as they are.
idf = 4 + ln(1 / s) / ln(1000), where s is the share of texts that hold the run, 1 / 1000 at least: 4 for a run in every text, 4.33 in a tenth, 4.67 in a hundredth, 5 in a thousandth or fewer.
None weighs less than 0.8 of another, so two texts of plain Jaccard similarity 5 / 6 (over counts) have a weighted one of 0.8 at least, however many texts hold what they share;
a steeper idf parts more of the edited copies in large groups, since a group's own runs are frequent by its size.
Up to a thousand texts every run has a weight by its own frequency. There are at most 1000 x (runs per text) runs above that share, at any size of the corpus, so the table that is handed to tasks is bounded.
They are found exactly. First pass, with D distinct texts in N rows and a share c: each group of rows names the runs that more than c / 2 x D / N of it hold. A run in more than
c of the texts was named with counts of more than c / 2 x D in sum, since the groups that did not name it hold less than c / 2 x D;
so at most 2 / c x N / D x (runs per text) candidates are left. Second pass: these are counted over all distinct texts; what is shuffled are the candidates that a text holds.

Candidates are not all pairs. In each of a few turns every bucket that still holds several classes names one of its texts, and its texts of other classes are
compared with that one, if weights and draws allow a similarity that high; this joins what belongs together. Buckets that still hold several classes
are then compared throughout, in blocks of bounded size, and give away only links that join classes. No bucket is capped.
Texts alike to the byte are one from the start (MD5), so thousands of copies cost one comparison.

Defined results: null texts and texts without a word are classes of their own; rows with one id and text are alike; ties go to the smallest id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.llm.common import mix, prefix_hashes, span_hashes, steps, utf8
from formbook.llm.components import components
from formbook.session import checkpointed, passing_shuffles

WORDS = 5
ROWS, BANDS = 4, 14
SIMILARITY = 0.8
ROUNDS = 2
TOGETHER = 1024  # texts of a block of a bucket
COMMON = 0.001
LEAST = 4  # the weight of a run in every text; one in a thousandth of them or fewer has one more
GROUP = 4000  # documents that name common runs together
MOST = 1 << 23  # runs that a group holds, in rows beyond which it ends
_K = ROWS * BANDS
_KEEP = np.uint64((1 << 48) - 1)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_DRAWS = np.random.default_rng(20)
_ODD = _DRAWS.integers(1, 2**31, (_K, 2), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_R = -np.log(_DRAWS.random(2048) * _DRAWS.random(2048)).astype(np.float32)
_C = np.log(-np.log(_DRAWS.random(2048) * _DRAWS.random(2048))).astype(np.float32)
_INV_R = (1 / _R).astype(np.float32)


@dataclass(frozen=True)
class Frequencies:
    """Distinct texts of the corpus, and the runs in more than ``COMMON`` of them with their inverse document frequencies (the others have the greatest)."""

    texts: int
    runs: np.ndarray
    idf: np.ndarray

    def of(self, runs: np.ndarray) -> np.ndarray:
        out = np.full(len(runs), idf(0.0))
        if len(self.runs):
            at = np.minimum(np.searchsorted(self.runs, runs), len(self.runs) - 1)
            hit = self.runs[at] == runs
            out[hit] = self.idf[at[hit]]
        return out


def idf(share: float) -> float:
    return LEAST + math.log(max(share, COMMON)) / math.log(COMMON)


def bags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, run, count) of every run of every row, sorted by row and run. Runs are 48-bit hashes."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none.astype(np.uint64), none
    space = _SPACE[data]
    fresh = np.empty(len(data), bool)
    fresh[0] = True
    fresh[1:] = space[:-1]
    fresh[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(fresh & ~space)
    if not len(start):
        return none, none.astype(np.uint64), none
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = space[1:]
    last[(offsets[1:] - 1)[offsets[1:] > offsets[:-1]]] = True
    end = np.flatnonzero(last & ~space) + 1
    word = span_hashes(prefix_hashes(_LOWER[data]), start, end)
    row = np.searchsorted(offsets, start, "right") - 1
    count = np.bincount(row, minlength=len(offsets) - 1)
    # runs of five within a row
    run = np.zeros(max(0, len(word) - WORDS + 1), np.uint64)
    for j in range(WORDS):
        run = (run + word[j : j + len(run)]) * np.uint64(0xD6E8FEB86659FD93)
    whole = row[: len(run)] == row[WORDS - 1 :] if len(run) else np.zeros(0, bool)
    rows, runs = row[: len(run)][whole], mix(run[whole])
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        mine = np.flatnonzero(np.isin(row, short))
        nth = np.arange(len(word)) - (np.cumsum(count) - count)[row]
        sums = np.zeros(len(count), np.uint64)
        np.add.at(sums, row[mine], mix(word[mine] + nth[mine].astype(np.uint64)))
        rows, runs = np.concatenate([rows, short]), np.concatenate([runs, mix(sums[short])])
    key = np.sort((rows.astype(np.uint64) << np.uint64(48)) | (runs & _KEEP))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else none
    counts = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(48)).astype(np.int64), key & _KEEP, counts


def _batches(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with their bytes, small enough to work on at once."""
    for batch in batches:
        data, offsets = utf8(batch.column(at))
        for a, b in steps(offsets):
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def frequencies(docs: DataFrame, text: str = "text") -> Frequencies:
    """Two passes over all texts, see above."""
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    facts = texts.groupBy(F.md5("t").alias("node")).agg(F.count("*").alias("n")).agg(F.count("*").alias("texts"), F.sum("n").alias("rows")).first()
    total = facts["texts"]
    share = COMMON / 2 * total / (facts["rows"] or 1)

    def name(parts: list[np.ndarray], rows: int) -> pa.RecordBatch:
        runs, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
        often = n > share * rows
        return pa.RecordBatch.from_arrays([pa.array(runs[often].astype(np.int64)), pa.array(n[often].astype(np.int64))], names=["run", "n"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[np.ndarray], int]] = []  # the last group waits, so that a short rest can join it
        parts, rows = [], 0
        for part, data, offsets in _batches(batches):
            parts.append(bags(data, offsets)[1])
            rows += part.num_rows
            if rows >= GROUP or sum(map(len, parts)) >= MOST:
                if held:
                    yield name(*held.pop())
                held, parts, rows = [(parts, rows)], [], 0
        before = held.pop() if held else ([], 0)
        yield name(before[0] + parts, before[1] + rows)

    # tasks of less than a group would name runs that are rare in the whole
    grouped = texts.coalesce(max(1, (facts["rows"] or 0) // GROUP))
    candidates = grouped.mapInArrow(named, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")).where(F.col("n") > COMMON / 2 * total)
    names = np.sort(candidates.select("run").toArrow().column(0).to_numpy()).astype(np.uint64)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in _batches(batches, 1):
            row, runs, _ = bags(data, offsets)
            at = np.minimum(np.searchsorted(names, runs), len(names) - 1)
            hit = names[at] == runs
            row, at = row[hit], at[hit].astype(np.int32)
            some = np.unique(row)
            cuts = np.searchsorted(row, np.append(some, part.num_rows))
            lists = [at[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), pa.array(lists, pa.binary())], names=["node", "held"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(names), np.int64)
        for batch in batches:
            sums += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=len(names))
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names[seen].astype(np.int64)), pa.array(sums[seen])], names=["run", "n"])

    if not len(names):
        return Frequencies(total, names, np.zeros(0))
    once = texts.select(F.md5("t").alias("node"), "t").mapInArrow(held, "node string, held binary").distinct().select("held")
    counts = once.mapInArrow(counted, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")).where(F.col("n") > COMMON * total)
    rows = counts.toArrow().sort_by("run")
    return Frequencies(total, rows.column("run").to_numpy().astype(np.uint64), np.array([idf(n / total) for n in rows.column("n").to_pylist()]))


def draws(row: np.ndarray, run: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """K draws per row (0 where a row has no run), 32 bits each."""
    out = np.zeros((rows, _K), np.uint32)
    if not len(row):
        return out
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    who = row[first]
    base = (run ^ (run >> np.uint64(24))).astype(np.uint32)
    log_w = np.log(weight).astype(np.float32)
    for k in range(_K):
        z = base * _ODD[k, 0]
        z ^= z >> np.uint32(15)
        z *= _ODD[k, 1]
        z ^= z >> np.uint32(13)
        i = z & np.uint32(2047)
        r = _R[i]
        beta = (z >> np.uint32(22)).astype(np.float32) * np.float32(2**-10)
        level = np.floor(log_w * _INV_R[i] + beta)
        # ln a = ln c - r (level - beta) - r; the smallest a is drawn
        a = _C[(z >> np.uint32(11)) & np.uint32(2047)] - r * (level - beta + np.float32(1))
        a += np.float32(128)
        np.maximum(a, np.float32(0), out=a)
        seal = z ^ (level.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
        key = (a.view(np.uint32).astype(np.uint64) << np.uint64(32)) | seal
        out[who, k] = np.minimum.reduceat(key, first).astype(np.uint32)
    return out


def band_keys(drawn: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band; the band is part of it."""
    parts = drawn.reshape(len(drawn), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.view(np.int64)


def similarities(left: pa.Array, right: pa.Array, known: Frequencies) -> np.ndarray:
    """Weighted Jaccard similarity of two columns of texts, row by row."""
    sides = []
    for column in (left, right):
        row, run, count = bags(*utf8(column))
        sides.append(((row.astype(np.uint64) << np.uint64(48)) | run, row, count * known.of(run)))
    (a, ra, wa), (b, rb, wb) = sides
    n = len(left)
    total = np.bincount(ra, wa, n) + np.bincount(rb, wb, n)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    shared = np.bincount(ra[i], np.minimum(wa[i], wb[j]), n)
    return np.where(total > 0, shared / np.where(total > shared, total - shared, 1), 0.0)


def sketches(docs: DataFrame, known: Frequencies, text: str = "text") -> DataFrame:
    """(node, weight, bands, drawn, body) for each row with a word; node is the text's MD5 and body the compressed text."""
    from zstandard import ZstdCompressor

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = ZstdCompressor(level=1)
        for part, data, offsets in _batches(batches, 1):
            row, run, count = bags(data, offsets)
            weight = count * known.of(run)
            drawn = draws(row, run, weight, part.num_rows)
            keep = np.flatnonzero(np.bincount(row, minlength=part.num_rows) > 0)
            total = np.bincount(row, weight, part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(keep)),
                    pa.array(total[keep]),
                    pa.FixedSizeListArray.from_arrays(pa.array(band_keys(drawn[keep]).ravel(), pa.int64()), BANDS).cast(pa.list_(pa.int64())),
                    pa.FixedSizeListArray.from_arrays(pa.array(drawn[keep].view(np.int32).ravel(), pa.int32()), _K).cast(pa.list_(pa.int32())),
                    pa.array([packer.compress(data[offsets[i] : offsets[i + 1]].tobytes()) for i in keep], pa.binary()),
                ],
                names=["node", "weight", "bands", "drawn", "body"],
            )

    rows = docs.where(F.col(text).isNotNull()).select(F.md5(text).alias("node"), F.col(text).alias("t"))
    return rows.mapInArrow(sketch, "node string, weight double, bands array<long>, drawn array<int>, body binary")


def verified(pairs: DataFrame, bodies: DataFrame, known: Frequencies, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose texts are similar enough."""
    from zstandard import ZstdDecompressor

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = ZstdDecompressor()
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                left, right = (pa.array([opener.decompress(x).decode("utf-8", "replace") for x in batch.column(c).to_pylist()], pa.large_string()) for c in (2, 3))
                good = similarities(left, right, known) >= similarity - 1e-9
                yield batch.select([0, 1]).filter(pa.array(good))

    both = pairs.join(bodies.select(F.col("node").alias("a"), F.col("body").alias("x")), "a").join(bodies.select(F.col("node").alias("b"), F.col("body").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a string, b string")


def _alike(similarity: float) -> Column:
    """What two texts x and y must have in common to be compared: weights of which the lesser is large enough, and draws.

    min(W) / max(W) bounds the similarity. Equal draws are binomial with the similarity as their share; fewer than 3.6 standard deviations
    below the mean are as rare as a missed band.
    """
    equal = F.aggregate(F.zip_with("x_drawn", "y_drawn", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)
    least = int(_K * similarity - 3.6 * math.sqrt(_K * similarity * (1 - similarity)))
    return (F.least("x_weight", "y_weight") >= F.lit(similarity - 1e-9) * F.greatest("x_weight", "y_weight")) & (equal >= least)


def classes(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(node, component) of texts that have a near-duplicate; node is the MD5 of a text."""
    known = frequencies(docs, text)
    found = checkpointed(sketches(docs, known, text))
    banded = found.select("node", "bands").dropDuplicates(["node"]).select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    buckets = checkpointed(banded.join(shared, "band"))
    # one row per distinct text that shares a bucket
    bodies = checkpointed(found.join(buckets.select("node").distinct(), "node").dropDuplicates(["node"]).select("node", "weight", "drawn", "body"))
    links = tried = placed = None
    for turn in range(rounds):
        # every text of a bucket meets one of them, another in each turn
        mixed = _mixed(buckets, placed).join(bodies.select("node", "weight", "drawn"), "node")
        columns = ("node", "component", "weight", "drawn")
        leader = mixed.groupBy("band").agg(F.min_by(F.struct(*columns), F.xxhash64("node", F.lit(turn))).alias("l"))
        x = mixed.select(F.col("band").alias("x_band"), *[F.col(c).alias(f"x_{c}") for c in columns])
        y = leader.select(F.col("band").alias("y_band"), *[F.col(f"l.{c}").alias(f"y_{c}") for c in columns])
        near = x.join(y, (F.col("x_band") == F.col("y_band")) & (F.col("x_component") != F.col("y_component")) & _alike(similarity))
        pairs = near.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = checkpointed(pairs)
        tried = pairs if tried is None else tried.unionByName(pairs)
        more = checkpointed(verified(pairs, bodies, known, similarity))
        links = more if links is None else links.unionByName(more)
        # a few rounds are enough to tell most of what is joined; what they do not tell is compared once more
        placed = checkpointed(components(links, "a", "b", 2, settle=False))
    rest = _mixed(buckets, placed)
    more = checkpointed(linked_in_buckets(rest.select("band", "node", "component"), bodies, known, similarity))
    return components(more if links is None else links.unionByName(more), "a", "b")


def linked_in_buckets(rows: DataFrame, bodies: DataFrame, known: Frequencies, similarity: float) -> DataFrame:
    """Links (a, b) that join classes within buckets; ``rows`` has (band, node, component).

    A bucket is cut into blocks of about ``TOGETHER`` texts and each two blocks are compared as one group of rows, so a large bucket is many bounded groups. A group's
    similarities come from one product of sparse counts, each count c written as c columns, for which the product is the
    sum of lesser counts. Only links that join classes leave a group: fewer than it has texts.
    """
    from zstandard import ZstdDecompressor

    sizes = rows.groupBy("band").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("n"))
    mine = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    cut = rows.join(sizes, "band").withColumn("i", mine).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    groups = cut.select(F.xxhash64("band", F.least("i", "j"), F.greatest("i", "j")).alias("group"), "node", "component")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = ZstdDecompressor()
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if held[0].column(0)[0].equals(batch.column(0)[batch.num_rows - 1]):
                continue  # a group goes on
            whole = pa.Table.from_batches(held).combine_chunks()
            last = int(np.searchsorted(whole.column(0).to_numpy(), whole.column(0)[-1].as_py(), "left"))
            yield from settle(whole.slice(0, last), opener)
            held = whole.slice(last).to_batches()
        if held:
            yield from settle(pa.Table.from_batches(held), opener)

    def settle(whole: pa.Table, opener) -> Iterator[pa.RecordBatch]:
        key = whole.column("group").to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = whole.slice(a, b - a)
            nodes, classes_ = part.column("node").to_pylist(), part.column("component").to_pylist()
            if b - a < 2 or len(set(classes_)) < 2:
                continue
            texts = pa.array([opener.decompress(x).decode("utf-8", "replace") for x in part.column("body").to_pylist()], pa.large_string())
            found = joining(within(texts, known) >= similarity - 1e-9, classes_)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([min(nodes[i], nodes[j]) for i, j in found]), pa.array([max(nodes[i], nodes[j]) for i, j in found])], names=["a", "b"])

    ready = groups.join(bodies.select("node", "body"), "node").select("group", "node", "component", "body")
    return ready.repartition("group").sortWithinPartitions("group", "node").mapInArrow(check, "a string, b string").distinct()


def within(texts: pa.Array, known: Frequencies, columns: int = 2048) -> np.ndarray:
    """Weighted Jaccard similarities of all texts with one another."""
    row, run, count = bags(*utf8(texts))
    weight = known.of(run)
    total = np.bincount(row, count * weight, len(texts))
    level = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    row, run, weight = (np.repeat(x, count) for x in (row, run, weight))
    _, column, seen = np.unique(run * np.uint64(0x9E3779B97F4A7C15) + level.astype(np.uint64), return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    row, weight = row[shared], weight[shared]
    column = np.unique(column[shared], return_inverse=True)[1]
    common = np.zeros((len(texts), len(texts)))
    order = np.argsort(column, kind="stable")
    row, weight, column = row[order], weight[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, (at, at + columns))
        counts = np.zeros((len(texts), columns))
        counts[row[a:b], column[a:b] - at] = np.sqrt(weight[a:b])
        common += counts @ counts.T
    either = total[:, None] + total[None, :] - common
    return np.where(either > 0, common / np.where(either > 0, either, 1), 0.0)


def joining(similar: np.ndarray, classes_: list[str]) -> list[tuple[int, int]]:
    """Pairs of the matrix that join classes, one for each that could be left out no more."""
    names = {c: i for i, c in enumerate(dict.fromkeys(classes_))}
    of = [names[c] for c in classes_]
    parent = list(range(len(names)))

    def top(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out = []
    for i, j in np.argwhere(np.triu(similar, 1)).tolist():
        a, b = top(of[i]), top(of[j])
        if a != b:
            parent[b] = a
            out.append((i, j))
    return out


def _mixed(buckets: DataFrame, placed: DataFrame | None) -> DataFrame:
    """The rows of buckets that hold more than one class, with their class."""
    if placed is None:
        grouped = buckets.withColumn("component", F.col("node"))
    else:
        grouped = buckets.join(placed, "node", "left").withColumn("component", F.coalesce("component", "node"))
    facts = grouped.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    several = facts.where(F.col("lo") != F.col("hi")).select("band")
    return checkpointed(grouped.join(several, "band"))


def _bare(text: str) -> Column:
    return F.col(text).isNull() | ~F.col(text).rlike("[^ \\t-\\r]")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: key, class_id (the least key of its class) and class_size (rows of the class).

    Rows of one text are one row until the end, when they meet what is told of their text in a join of two plain shuffles, which adaptive execution may split.
    """
    # texts without a word stay apart
    alone = F.concat(F.lit("-"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    with passing_shuffles(docs.sparkSession):
        rows = checkpointed(docs.select(F.col(key).alias("_key"), F.when(_bare(text), alone).otherwise(F.md5(text)).alias("_node")))
        texts = rows.groupBy("_node").agg(F.min("_key").alias("_least"), F.count("*").alias("_rows"))
        found = classes(docs, similarity, text)
        placed = checkpointed(texts.join(found, F.col("_node") == F.col("node"), "left").select("_node", F.coalesce("component", "_node").alias("_class"), "_least", "_rows"))
        facts = checkpointed(placed.groupBy(F.col("_class").alias("_c")).agg(F.min("_least").alias("class_id"), F.sum("_rows").alias("class_size")))
        told = checkpointed(placed.join(facts, F.col("_class") == F.col("_c")).select(F.col("_node").alias("_t"), "class_id", "class_size"))
    return rows.join(told, F.col("_node") == F.col("_t")).select(F.col("_key").alias(key), "class_id", "class_size")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows of a class beyond the first (least key, a null before others). Texts without a word all stay; rows alike in key and text are one.

    What stays is known by (text, key), so copies of one text are spread by their keys.
    """
    node = _free("_node", docs)
    worded = docs.where(~_bare(text)).withColumn(node, F.md5(text))
    texts = worded.groupBy(F.col(node).alias("_n")).agg(F.min(F.struct(F.col(key).alias("k"))).alias("_least"))
    with passing_shuffles(docs.sparkSession):
        found = classes(docs, similarity, text)
        placed = texts.join(found, F.col("_n") == F.col("node"), "left").select(F.coalesce("component", "_n").alias("_class"), F.struct(F.col("_least.k").alias("k"), F.col("_n").alias("n")).alias("_first"))
        first = checkpointed(placed.groupBy("_class").agg(F.min("_first").alias("_first")).select(F.col("_first.k").alias("_k"), F.col("_first.n").alias("_n")))
    stays = worded.join(first, (F.col(node) == F.col("_n")) & F.col(key).eqNullSafe(F.col("_k")), "left_semi").dropDuplicates([key, node])
    return docs.where(_bare(text)).unionByName(stays.select(*docs.columns))


def _free(name: str, docs: DataFrame) -> str:
    while name in docs.columns:
        name += "_"
    return name
