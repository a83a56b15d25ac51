"""Benchmark passages in texts, up to a few edits or changed words, whole or in long stretches.

Method. A test item with an error budget of k edits is split into k + 1 pieces: if the item stands in a text with at most k edits, one of
its pieces stands there unchanged (pigeonhole). All pieces are found in one pass of an Aho-Corasick automaton; each hit
fixes where the item would lie, give or take k characters, and Myers' bit-parallel distance decides whether it
stands there. Texts and items are compared in lower case with single blanks.

The budget is ``rate`` of an item's length. Items shorter than ``least`` characters are matched only as they are.

Changed words. An item that is over this budget still stands in a text with at most ``word_budget`` words replaced, deleted or inserted (a fifth of its
words; three at least from twelve words on), and so does a stretch of it: ``STRETCH`` of its words, eight at least, with a fifth of them changed, or
``STRETCH`` of its characters, 36 at least, as they are. Words are runs of letters, digits and underscores, so punctuation counts nothing here.
W words with e changes keep a run of at least (W - e) / (e + 1) words, which is more than two for all these budgets (pigeonhole again): all runs of three words are looked up, and Myers'
distance over words decides. The distance that is told is that of the characters, for a stretch those of the stretch. Items and stretches found only by
characters as they are need one run of three whole words, too.

At scale. Items are worked off in blocks of at most ``block_chars`` characters, so a task holds one bounded
automaton and one batch of texts, however long the benchmark is; texts are never shuffled.

Defined results: null and empty texts match nothing; null and empty items match nothing; items alike are reported each; repeated rows are treated alike; other
columns pass through; an empty benchmark finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import compress, count
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE = 0.06
LEAST = 40
CHANGED = 0.2  # words of an item or stretch that may differ
STRETCH = 0.45  # of an item that is a leak by itself
STRETCH_WORDS, STRETCH_CHARS = 8, 36
RUN = 3  # words looked up together
_WORD = re.compile(r"\w+")
HITS = "array<struct<item_id:bigint,distance:int,start:int,end:int>>"


@dataclass(frozen=True)
class Block:
    items: tuple[tuple[int, str], ...]  # (item id, folded text)
    rate: float = RATE
    least: int = LEAST


def folded(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str, rate: float, least: int) -> int:
    return int(len(item) * rate) if len(item) >= least else 0


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces with their places, as equal as can be."""
    n = k + 1
    cuts = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


@lru_cache(maxsize=2)
def _automaton(block: Block):
    import ahocorasick

    where: dict[str, list[tuple[int, int]]] = {}
    for n, (_, text) in enumerate(block.items):
        for at, piece in pieces(text, budget(text, block.rate, block.least)):
            where.setdefault(piece, []).append((n, at))
    out = ahocorasick.Automaton()
    for piece, places in where.items():
        out.add_word(piece, tuple((n, at + len(piece) - 1) for n, at in places))
    out.add_word("\0", ())
    out.make_automaton()
    return out


@lru_cache(maxsize=4096)
def _masks(item: Sequence[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | (1 << i)
    return out


def closest(item: Sequence[str], text: Sequence[str]) -> tuple[int, int]:
    """(least edit distance of ``item`` to any part of ``text``, where the first such part ends), by Myers' bit vectors; of characters or of words."""
    m = len(item)
    masks = _masks(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | minus
        d = ((((eq & plus) + plus) ^ plus) | x) & full
        up = minus | (full & ~(d | plus))
        down = plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        plus = ((down << 1) & full) | (full & ~(d | up))
        minus = up & d
        if score < best:
            best, end = score, j + 1
    return best, end


def find(block: Block, text: str | None) -> list[tuple[int, int, int, int]]:
    """(item id, distance, start, end) of the closest place of each item that stands in the text; places are in the folded text and the start is the end less the item's length."""
    return _find(block, folded(text))


def _find(block: Block, text: str) -> list[tuple[int, int, int, int]]:
    if not text:
        return []
    lines: dict[int, set[int]] = {}
    for end, places in _automaton(block).iter(text):
        for n, offset in places:
            lines.setdefault(n, set()).add(end - offset)
    out = []
    for n in sorted(lines):
        name, item = block.items[n]
        k, m = budget(item, block.rate, block.least), len(item)
        best = None
        upto = -1
        starts = sorted(lines[n])
        exact = next((s for s in starts if s >= 0 and text.startswith(item, s)), None)
        if exact is not None:
            best = (0, exact, exact + m)
        elif k:
            i = 0
            while i < len(starts):
                # places that overlap are looked at together
                first = last = starts[i]
                while i + 1 < len(starts) and starts[i + 1] - last <= k:
                    i += 1
                    last = starts[i]
                i += 1
                a = max(0, first - k, upto - m - 2 * k)
                part = text[a : last + m + k]
                distance, end = closest(item, part)
                upto = a + len(part)
                if distance <= k and (best is None or distance < best[0]):
                    best = (distance, max(0, a + end - m), a + end)
        if best:
            out.append((name, *best))
    return out


def word_budget(words: int) -> int:
    """Words of an item that may be changed; under six words none, since no run of three need be left."""
    return max(3 if words >= 12 else 0, int(words * CHANGED)) if words >= 6 else 0


def stretch(words: int) -> int:
    """Words of the shortest stretch of an item that is a leak by itself."""
    return max(STRETCH_WORDS, -int(-words * STRETCH // 1))


@lru_cache(maxsize=2)
def _runs(block: Block):
    """The words of each item, where they stand in it, and where each run of words stands in which item."""
    words = [tuple(_WORD.findall(text)) for _, text in block.items]
    spans = [[m.span() for m in _WORD.finditer(text)] for _, text in block.items]
    where: dict[tuple[str, ...], list[tuple[int, int]]] = {}
    for n, w in enumerate(words):
        for at in range(len(w) - RUN + 1):
            where.setdefault(w[at : at + RUN], []).append((n, at))
    return words, spans, where


def find_changed(block: Block, text: str | None, known: frozenset[int] | set[int] = frozenset()) -> list[tuple[int, int, int, int]]:
    """Like ``find``, for items of which some words are changed or only a long stretch stands in the text. Items with an id in ``known`` are left out."""
    return _find_changed(block, folded(text), known)


def _find_changed(block: Block, text: str, known: frozenset[int] | set[int]) -> list[tuple[int, int, int, int]]:
    items, places, where = _runs(block)
    words = _WORD.findall(text)
    anchors: dict[int, list[tuple[int, int]]] = {}
    for i in compress(count(), map(where.__contains__, zip(*(words[k:] for k in range(RUN)), strict=False))):
        for n, at in where[tuple(words[i : i + RUN])]:
            if block.items[n][0] not in known:
                anchors.setdefault(n, []).append((i, at))
    out = []
    spans: list[tuple[int, int]] = []
    for n in sorted(anchors):
        name, item = block.items[n]
        best = _whole(items[n], words, anchors[n]) or _part(items[n], words, anchors[n])
        close = [] if best else [x for x in anchors[n] if _long(items[n], places[n], words, *x, len(item))]
        if not (best or close):
            continue
        spans = spans or [m.span() for m in _WORD.finditer(text)]
        if best:
            (a, b), (i, j) = best
            piece = item if b - a == len(items[n]) else item[places[n][a][0] : places[n][b - 1][1]]
            low = spans[i][0]
            distance, end = closest(piece, text[low : spans[j - 1][1] + 1])
            out.append((name, distance, max(0, low + end - len(piece)), low + end))
        else:
            same = max((_same(item, text, places[n][at][0], spans[i][0]) for i, at in close), key=lambda x: x[1] - x[0])
            if same[1] - same[0] >= _least_chars(len(item)):
                out.append((name, 0, *same))
    return out


def _whole(item: tuple[str, ...], words: list[str], anchors: list[tuple[int, int]]) -> tuple[tuple[int, int], tuple[int, int]] | None:
    """(words of the item, words of the text to look in) where the item has the fewest changed words."""
    return _least(item, 0, len(item), word_budget(len(item)), words, anchors)


def _part(item: tuple[str, ...], words: list[str], anchors: list[tuple[int, int]]) -> tuple[tuple[int, int], tuple[int, int]] | None:
    """The same of the first stretch that stands in the text."""
    size = stretch(len(item))
    k = int(size * CHANGED)
    anchors = [(i, at) for i, at in anchors if _held(item, words[max(0, i - at - k) : max(0, i - at + len(item) + k)]) >= size - k]
    for a in range(len(item) - size + 1):
        found = _least(item, a, a + size, k, words, [p for p in anchors if a <= p[1] <= a + size - RUN])
        if found is not None:
            return found
    return None


def _least(item: tuple[str, ...], a: int, b: int, k: int, words: list[str], anchors: list[tuple[int, int]]) -> tuple[tuple[int, int], tuple[int, int]] | None:
    best = None
    looked: set[tuple[int, int]] = set()
    for place in sorted({i - at + a for i, at in anchors}):
        low, high = max(0, place - k), min(len(words), place + b - a + k)
        if (low, high) in looked:
            continue
        looked.add((low, high))
        near = words[low:high]
        if _held(item[a:b], near) < b - a - k:
            continue
        distance, _ = closest(item[a:b], near)
        if distance <= k and (best is None or distance < best[0]):
            best = (distance, (a, b), (low, high))
    return best[1:] if best else None


def _held(item: tuple[str, ...], words: list[str]) -> int:
    return sum(map(set(words).__contains__, item))


def _least_chars(n: int) -> float:
    return max(STRETCH_CHARS, STRETCH * n)


def _long(item: tuple[str, ...], places: list[tuple[int, int]], words: list[str], i: int, at: int, n: int) -> bool:
    """Whether the words alike around an anchor and one more on each side are long enough."""
    a, b = at, at + RUN - 1
    while a > 0 and a - at + i >= 0 and item[a] == words[a - at + i]:
        a -= 1
    while b < len(item) - 1 and b - at + i < len(words) and item[b] == words[b - at + i]:
        b += 1
    return (n if b == len(item) - 1 else places[b][1]) - (0 if a == 0 else places[a][0]) >= _least_chars(n)


def _same(item: str, text: str, q: int, p: int) -> tuple[int, int]:
    """(start, end) of the stretch of characters that is alike around the places q of the item and p of the text."""
    right = len(commonprefix([item[q:], text[p : p + len(item) - q]]))
    left = len(commonprefix([item[:q][::-1], text[max(0, p - q) : p][::-1]]))
    return p - left, p + right


def leaks(block: Block, text: str | None) -> list[tuple[int, int, int, int]]:
    """What ``find`` finds, and what ``find_changed`` finds of the other items."""
    text = folded(text)
    found = _find(block, text)
    return found + _find_changed(block, text, {f[0] for f in found})


def blocks(benchmark: DataFrame, rate: float = RATE, least: int = LEAST, block_chars: int = 4_000_000, key: str = "item_id", text: str = "text") -> list[DataFrame]:
    """Parts of the benchmark of about ``block_chars`` characters, cut by a hash of the id."""
    rows = benchmark.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    total = rows.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    n = max(1, -(-total // block_chars))
    return [rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i) for i in range(n)]


def read_block(rows: DataFrame, rate: float = RATE, least: int = LEAST) -> Block:
    items = sorted((r["id"], folded(r["t"])) for r in rows.distinct().collect())
    return Block(tuple((i, t) for i, t in items if t), rate, least)


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", into: str = "hits", rate: float = RATE, least: int = LEAST) -> DataFrame:
    """Adds ``into``: the items that stand in the text, with distance and place, as they are, changed or in part. Rows stay where they are."""
    found: list[Column] = []
    for part in blocks(benchmark, rate, least):
        block = read_block(part, rate, least)
        if block.items:
            found.append(_scan(block)(F.col(text)))
    return docs.withColumn(into, F.concat(*found) if found else F.array().cast(HITS))


def _scan(block: Block):
    @F.pandas_udf(HITS)
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"item_id": i, "distance": d, "start": a, "end": b} for i, d, a, b in leaks(block, t if isinstance(t, str) else None)] for t in texts], dtype=object)

    return scan
