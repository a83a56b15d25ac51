"""Removal of byte strings that stand earlier in the corpus, to the byte.

Contract. A byte goes if some string of ``LENGTH`` bytes that covers it also starts earlier: in a document with a smaller id, or earlier in the same
one. All strings of the input count, also those that overlap.

Method. Prefix polynomial hashes give the hash of any part of a text in one step, so corpus positions are sorted by hashes of extensions of
decreasing length, each sort settling what the one before left open, as a binary search for the common extension does:

1. In every string of 100 bytes one inner anchor is chosen by content: the leftmost of its least hashed runs of ``ANCHOR`` bytes. Equal strings have
   equal anchors at equal places, and neighbouring strings share one, so positions form runs, about 35 positions each. Runs are sorted by (anchor,
   hash of the whole run). Of runs alike as a whole all but the earliest are copies throughout.
2. Under an anchor with several kinds of run, the earliest of each kind is cut into blocks of 8 positions, aligned to the anchor. All strings of a block share its core of
   93 bytes, so blocks are sorted by the hash of the core, and told apart by the up to 14 bytes around it. A core of one kind is done.
3. Where one core has several kinds, the strings of the first of each kind are sorted one by one.

Collisions: whole runs agree in the anchor's hash and in two hashes of the run, of different polynomials; blocks agree in two hashes of the core and, to the byte, in
what is around it.

At scale. Sorting is Spark's external merge sort within hash partitions. A run that a task has met before is told apart in that task (the copy needs no sort), so a passage
that a third of all documents hold sends one row per batch, not per document, to its anchor's partition. The sorted rows are read as a
stream of which one row is remembered, so no group is ever held. Texts travel compressed.

Defined results: null and empty texts have 0 bytes; texts under 100 bytes lose nothing; documents are ordered by id, null first; rows with one
id and one text are one document and lose the same bytes, rows with one id and different texts are ordered by 15 bits of the texts' hash; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.llm.common import mix, powers, prefix_hashes, span_hashes, steps, utf8
from formbook.session import checkpointed

LENGTH = 100
ANCHOR = 32
BLOCK = 8
CORE = LENGTH - BLOCK + 1
STRETCH = 1 << 18
_SPREAD = LENGTH - ANCHOR + 1  # anchors in a string
_PLACE = np.uint64((1 << 24) - 1)
_NAMES = ["part", "kind", "rest", "doc", "spot"]
_ROWS = "part long, kind long, rest long, doc long, spot long"
_GOLD = np.uint64(0x9E3779B97F4A7C15)

# A spot packs 15 bits of the text's hash, the start (32 bits), the anchor's distance from it (8), the positions (7) and whether it is a known copy (1).


def spot(text: np.ndarray, start: np.ndarray, ahead: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (text << 48) | (start.astype(np.int64) << 16) | (ahead.astype(np.int64) << 8) | (size.astype(np.int64) << 1)


def start_of(spots: np.ndarray) -> np.ndarray:
    return (spots >> 16) & 0xFFFFFFFF


def ahead_of(spots: np.ndarray) -> np.ndarray:
    return (spots >> 8) & 0xFF


def size_of(spots: np.ndarray) -> np.ndarray:
    return (spots >> 1) & 0x7F


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def runs(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first position, distance to the anchor, positions, anchor hash, hash of the run) of the runs of texts that stand one after the other.

    ``starts`` has where texts begin, and the end. No string crosses from one text to the next.
    """
    n = len(data) - LENGTH + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sums = prefix_hashes(data)
    at = np.arange(len(data) - ANCHOR + 1)
    grams = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * powers(len(data))[1][: len(at)])
    least = sliding_least((grams & ~_PLACE) | at.astype(np.uint64), _SPREAD)[:n]
    anchor = (least & _PLACE).astype(np.int64)
    # strings that reach into the next text are none
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:n]
    good = at[:n] + LENGTH <= starts[1:][row]
    head = np.ones(n, bool)
    head[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (good[1:] != good[:-1])
    first = np.flatnonzero(head)
    size = np.diff(np.append(first, n))
    keep = good[first]
    first, size = first[keep], size[keep]
    end = first + size + LENGTH - 1
    ahead = anchor[first] - first
    shape = (ahead * 128 + size).astype(np.uint64) * _GOLD
    both = span_hashes(sums, first, end) + shape + span_hashes(prefix_hashes(data, 1), first, end, 1) * np.uint64(0xD6E8FEB86659FD93)
    return first, ahead, size, grams[anchor[first]], mix(both)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place of the first byte in it, where texts begin, bytes): rows of ordinary length together, so that array steps are long; a long row in
    stretches that overlap, so that no string is lost. A run cut by a stretch's edge has the same anchor; its strings still meet their like."""
    for a, b in steps(offsets, 2 * STRETCH):
        if offsets[b] - offsets[a] <= 2 * STRETCH:
            yield a, 0, offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
        else:
            for at in range(int(offsets[a]), int(offsets[b]) - LENGTH + 1, STRETCH):
                part = data[at : min(int(offsets[b]), at + STRETCH + LENGTH - 1)]
                yield a, at - int(offsets[a]), np.array([0, len(part)]), part


def _batch(part: np.ndarray, kind: np.ndarray, rest: np.ndarray, doc: np.ndarray, spots: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in (part, kind, rest, doc, spots)], names=_NAMES)


def _settled(part: np.ndarray, kind: np.ndarray, rest: np.ndarray, doc: np.ndarray, spots: np.ndarray) -> pa.RecordBatch:
    """The rows, with those that are later than a like row among them marked as copies and scattered over partitions."""
    order = np.lexsort((spots, doc, rest, kind, part))
    p, k, r, d, s = (x[order] for x in (part, kind, rest, doc, spots))
    same = np.zeros(len(p), bool)
    same[1:] = (p[1:] == p[:-1]) & (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(p))))
    copy = same & ((d != d[head]) | (s != s[head]))
    p = np.where(copy, mix(p.view(np.uint64) + s.view(np.uint64) * _GOLD + d.view(np.uint64)), p.view(np.uint64))
    return _batch(p, np.where(copy, 0, k), np.where(copy, 0, r), d, s | copy)


def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of runs from rows (doc, text hash, text)."""
    for batch in batches:
        docs, texts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for row, at, starts, data in _pieces(*utf8(batch.column(2))):
            first, ahead, size, part, kind = runs(data, starts)
            if len(first):
                owner = np.searchsorted(starts, first, "right") - 1
                yield _settled(part.view(np.int64), kind.view(np.int64), np.zeros(len(first), np.int64), docs[row + owner], spot(texts[row + owner], first - starts[owner] + at, ahead, size))


def blocks(data: np.ndarray, begin: np.ndarray, doc: np.ndarray, spots: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of the blocks of runs; ``begin`` has where each run's text begins in ``data``."""
    text, high = spots >> 48, ahead_of(spots)
    low = high - size_of(spots) + 1
    n = high // BLOCK - low // BLOCK + 1
    who = np.repeat(np.arange(len(spots)), n)
    j = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low // BLOCK, n)
    anchor = (begin + start_of(spots) + high)[who]
    top, bottom = np.minimum(high[who], j * BLOCK + BLOCK - 1), np.maximum(low[who], j * BLOCK)
    core = anchor - j * BLOCK
    left, right = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64)
    for t in range(BLOCK - 1):
        # bytes that belong to a string of the block; others read as 0, as which strings there are is part of the kind
        known = t < top - j * BLOCK
        left |= np.where(known, data[np.where(known, core - 1 - t, 0)], 0).astype(np.int64) << (8 * t)
        known = t < BLOCK - 1 - (bottom - j * BLOCK)
        right |= np.where(known, data[np.where(known, core + CORE + t, 0)], 0).astype(np.int64) << (8 * t)
    two = span_hashes(prefix_hashes(data), core, core + CORE) + span_hashes(prefix_hashes(data, 1), core, core + CORE, 1) * np.uint64(0xD6E8FEB86659FD93)
    part = mix(two + j.astype(np.uint64) * _GOLD)
    kind = left | ((top - j * BLOCK) << 56) | ((bottom - j * BLOCK) << 59)
    return part.view(np.int64), kind, right, doc[who], spot(text[who], anchor - top - begin[who], top - j * BLOCK, top - bottom + 1)


def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks from rows (doc, body, spots)."""
    from zstandard import ZstdDecompressor

    opener = ZstdDecompressor()
    for whole in batches:
        for at in range(0, whole.num_rows, 32):
            batch = whole.slice(at, 32)
            bodies = [opener.decompress(x) for x in batch.column(1).to_pylist()]
            data = np.frombuffer(b"".join(bodies), np.uint8)
            lists = batch.column(2).to_pylist()
            many = [len(x) for x in lists]
            begin = np.repeat(np.cumsum([0, *map(len, bodies)])[:-1], many)
            doc = np.repeat(batch.column(0).to_numpy(), many)
            if len(doc):
                yield _settled(*blocks(data, begin, doc, np.concatenate([np.array(x, np.int64) for x in lists])))


def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the strings of blocks, each under the hash of what it consists of; copies pass."""
    for batch in batches:
        part, kind, rest, doc, spots = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        known = (spots & 1) == 1
        if known.any():
            p = mix(part[known].view(np.uint64) + spots[known].view(np.uint64) * _GOLD + doc[known].view(np.uint64))
            zero = np.zeros(known.sum(), np.int64)
            yield _batch(p, zero, zero, doc[known], spots[known])
        part, kind, rest, doc, spots = (x[~known] for x in (part, kind, rest, doc, spots))
        size, top = size_of(spots), ahead_of(spots)
        who = np.repeat(np.arange(len(spots)), size)
        if not len(who):
            continue
        nth = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size)
        offset = top[who] - nth  # bytes left of the core
        left = (kind[who] & ((1 << 56) - 1)) & ((np.int64(1) << (8 * offset)) - 1)
        right = rest[who] & ((np.int64(1) << (8 * (BLOCK - 1 - offset))) - 1)
        yield _settled(mix(part[who].view(np.uint64) + mix((left | (offset << 56)).view(np.uint64))).view(np.int64), left, right, doc[who], spot(spots[who] >> 48, start_of(spots)[who] + nth, offset, np.ones(len(who), np.int64)))


def told_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by all columns: copies (marked), and the first of each kind of a part that has several.

    From batch to batch one row is remembered, the first of the current kind, and one more, the first of the part as long as only one kind was seen there.
    """
    head = None
    waiting = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        part, kind, rest, doc, spots = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        copied = (spots & 1) == 1
        same_part = np.zeros(n, bool)
        same_part[1:] = part[1:] == part[:-1]
        same_part[0] = head is not None and part[0] == head[0]
        same = np.zeros(n, bool)
        same[1:] = same_part[1:] & (kind[1:] == kind[:-1]) & (rest[1:] == rest[:-1])
        same[0] = same_part[0] and (kind[0], rest[0]) == head[1:3]
        at = np.maximum.accumulate(np.where(same, -1, np.arange(n)))
        place, known = np.maximum(at, 0), at >= 0
        later = (doc != np.where(known, doc[place], head[3] if head else 0)) | (spots != np.where(known, spots[place], head[4] if head else 0))
        copy = (same & later) | copied
        fresh = ~same & ~copied
        further = fresh & same_part
        group = np.cumsum(~same_part)  # 0: goes on from the batch before
        several = np.bincount(group[further], minlength=group[-1] + 1) > 0
        opens = fresh & ~same_part
        if waiting is not None and group[0] == 0 and several[0]:
            yield waiting
            waiting = None
        out = copy | further | (opens & several[group])
        if out.any():
            yield _batch(part[out], kind[out], rest[out], doc[out], spots[out] | copy[out])
        if group[-1] > 0:
            last = np.flatnonzero(opens & (group == group[-1]))
            waiting = _batch(*(x[last[:1]] for x in (part, kind, rest, doc, spots))) if len(last) and not several[-1] else None
        if at[-1] >= 0:
            head = tuple(x[at[-1]] for x in (part, kind, rest, doc, spots))


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions(*_NAMES).mapInArrow(told_apart, _ROWS)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc (null as the least), 15 bits of the text's hash, text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(t).bitwiseAND(F.lit(0x7FFF)).alias("text"), t.alias("t"))


def _bodies(docs: DataFrame, key: str, text: str) -> DataFrame:
    from zstandard import ZstdCompressor

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = ZstdCompressor(level=3)
        for b in batches:
            data, offsets = utf8(b.column(2))
            bodies = [packer.compress(data[x:y].tobytes()) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bodies, pa.binary())], names=["doc", "text", "body"])

    return _keyed(docs, key, text).mapInArrow(packed, "doc long, text long, body binary")


def _text_of(spots: Column) -> Column:
    return F.shiftrightunsigned(spots, 48).cast("long")


def _per_document(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc", _text_of(F.col("spot")).alias("text")).agg(F.collect_list("spot").alias("spots"))


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, spot): positions of strings that also start earlier."""
    found = checkpointed(_sorted(_keyed(docs, key, text).mapInArrow(anchored, _ROWS)).select("doc", "spot"))
    known = F.col("spot").bitwiseAND(F.lit(1)) == 1
    bodies = _bodies(docs, key, text)
    doubtful = _per_document(found.where(~known)).join(bodies, ["doc", "text"]).dropDuplicates(["doc", "text"]).select("doc", "body", "spots")
    fine = _sorted(_sorted(doubtful.mapInArrow(blocked, _ROWS)).mapInArrow(strings, _ROWS)).where(known).select("doc", "spot")
    return found.where(known).unionByName(fine)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, n_bytes, n_removed, spans (removed runs as start and end), kept (the bytes that stay)."""
    from zstandard import ZstdDecompressor

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = ZstdDecompressor()
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                out: list[list] = [[], [], [], []]
                for body, spots in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    data = opener.decompress(body)
                    spans = covered(np.array(spots or [], np.int64))
                    edges = [0, *(x for span in spans for x in span), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    for to, x in zip(out, (len(data), len(data) - len(kept), [{"start": a, "end": b} for a, b in spans], kept), strict=True):
                        to.append(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=["key", "n_bytes", "n_removed", "spans", "kept"])

    gone = _per_document(removals(docs, key, text))
    rows = _bodies(docs, key, text).join(gone, ["doc", "text"], "left").select("doc", "body", "spots")
    out = rows.mapInArrow(cut, "key long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumn("key", F.nullif("key", F.lit(-(2**63)))).withColumnRenamed("key", key)


def covered(spots: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the strings at ``spots`` cover."""
    if not len(spots):
        return []
    a = start_of(spots)
    order = np.argsort(a, kind="stable")
    a, b = a[order], (a + size_of(spots) + LENGTH - 1)[order]
    reach = np.maximum.accumulate(b)
    fresh = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]]))
    ends = np.append(fresh[1:] - 1, len(a) - 1)
    return [(int(a[i]), int(reach[j])) for i, j in zip(fresh, ends, strict=True)]
