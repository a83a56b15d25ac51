"""Language by cross-parsing entropy.

Method. For each language one suffix automaton stands for a bounded piece of labelled text. A text is parsed
greedily: the longest match that the automaton knows is a phrase, then the next one starts. Phrases times
log2(size of the largest training piece) per symbol estimate the cross entropy; the language with the least wins. A phrase costs
the same in every language, so a language with little text does not win by having cheap phrases.
Texts are read in blocks of ``BLOCK`` symbols, at whose ends a phrase ends too, so that many blocks, of any texts,
advance through the automaton together in array operations. No block is left out.

Symbols are lower-cased letters; each run of anything else after a letter is one blank.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the language with more
training documents, then by name; with nothing to learn from every text is ``und``. Repeated rows are treated alike.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNDECIDED = "und"
BLOCK = 1024
LANES = 4096


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...] = ()
    pieces: tuple[str, ...] = ()


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        if not 0xD800 <= code < 0xE000 and (c := chr(code)).isalpha():
            low = c.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, 0 for a run of anything else; and the text of each symbol."""
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    codes = _letters()[np.minimum(np.frombuffer(raw, np.uint32), 0x10FFFF)]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    keep = codes != 0
    if len(keep):
        keep[1:] |= (codes[:-1] != 0) & (owner[1:] == owner[:-1])
    return codes[keep], owner[keep]


def automaton(piece: np.ndarray, letters: int) -> np.ndarray:
    """Transitions of the suffix automaton of ``piece``: row per state, column per symbol, 0 where there is none (the start is entered by no symbol)."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in piece.tolist():
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    out = np.zeros((len(step), letters), np.int32)
    for state, to in enumerate(step):
        out[state, list(to)] = list(to.values())
    return out


@lru_cache(maxsize=2)
def _tables(model: Model) -> tuple[np.ndarray, list[np.ndarray], float]:
    """Symbol numbers of letters (the last number is for letters never seen), an automaton per language, and the bits of a phrase."""
    pieces = [symbols([p])[0] for p in model.pieces]
    seen = np.unique(np.concatenate([*pieces, np.zeros(1, np.uint32)]))
    number = np.full(0x110000, len(seen), np.uint16)
    number[seen] = np.arange(len(seen))
    tables = [automaton(number[p], len(seen) + 1).ravel() for p in pieces]
    return number, tables, float(np.log2(max(2, *[len(p) for p in pieces])))


def phrases(table: np.ndarray, width: int, grid: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Greedy phrases of each column of ``grid``; columns stand longest first, ``size`` has their lengths."""
    found = np.zeros(grid.shape[1], np.int32)
    state = np.zeros(grid.shape[1], np.int32)
    active = np.searchsorted(-size, -np.arange(1, grid.shape[0] + 1), "right")
    for t in range(grid.shape[0]):
        n = active[t]
        if not n:
            break
        c = grid[t, :n]
        to = table[state[:n] * width + c]
        stuck = np.flatnonzero(to == 0)
        if len(stuck):
            # a phrase ends before this symbol; one that nobody knows is a phrase of its own
            found[stuck] += state[stuck] != 0
            again = table[c[stuck]]
            found[stuck] += again == 0
            to[stuck] = again
        state[:n] = to
    return found + (state != 0)


def entropies(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bits a symbol for each text and language, and whether the text has a letter."""
    number, tables, factor = _tables(model)
    codes, owner = symbols(texts)
    total = np.bincount(owner, minlength=len(texts))
    has = np.bincount(owner[codes != 0], minlength=len(texts)) > 0
    out = np.zeros((len(texts), len(tables)))
    if not len(codes):
        return out, has
    code = number[codes].astype(np.int32)
    begin = np.concatenate([[0], np.cumsum(total)])[:-1]
    pieces = -(-total // BLOCK)
    who = np.repeat(np.arange(len(texts)), pieces)
    nth = np.arange(len(who)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = begin[who] + nth * BLOCK
    size = np.minimum(BLOCK, total[who] - nth * BLOCK)
    order = np.argsort(-size, kind="stable")
    width = len(tables[0]) and int(number.max()) + 1
    for at in range(0, len(order), LANES):
        lanes = order[at : at + LANES]
        longest = int(size[lanes[0]])
        where = start[lanes][None, :] + np.arange(longest)[:, None]
        grid = code[np.minimum(where, len(code) - 1)]
        for k, flat in enumerate(tables):
            np.add.at(out[:, k], who[lanes], phrases(flat, width, grid, size[lanes]))
    return out * factor / np.maximum(total, 1)[:, None], has


def predict(model: Model, texts: pd.Series) -> pd.DataFrame:
    values = ["" if t is None or t != t else t for t in texts]
    if not model.languages or not values:
        return pd.DataFrame({"lang": [UNDECIDED] * len(values), "score": np.zeros(len(values))})
    bits, has = entropies(model, values)
    best = bits.argmin(1)
    rest = np.where(np.arange(bits.shape[1]) == best[:, None], np.inf, bits).min(1) if bits.shape[1] > 1 else np.full(len(bits), np.inf)
    low = bits[np.arange(len(bits)), best]
    score = np.where(np.isfinite(rest) & (rest > 0), 1 - low / np.where(np.isfinite(rest) & (rest > 0), rest, 1), 1.0)
    names = np.array([*model.languages, UNDECIDED], object)
    return pd.DataFrame({"lang": names[np.where(has, best, len(model.languages))], "score": np.where(has, np.clip(score, 0, 1), 0.0)})


def learn(docs: DataFrame, usable: Column, per_language: int = 120, chars: int = 250) -> Model:
    """Pieces of ``chars`` characters from the middle of at most ``per_language`` usable documents of each language.

    The documents are chosen by a hash of their id, so what is learned from is bounded by
    languages x per_language x chars whatever the size of the corpus. Only rows with a language and a text take part.
    """
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    from_middle = F.substring(F.col("text"), F.greatest(F.lit(1), F.floor(F.length("text") / 2).cast("int") - F.lit(chars // 2)), F.lit(chars))
    # bounded parts of texts travel, not the texts
    picked = rows.select("lang", "doc_id", from_middle.alias("piece")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
    sizes = {r["lang"]: r["c"] for r in rows.groupBy("lang").agg(F.count("*").alias("c")).collect()}
    pieces: dict[str, list[str]] = {}
    for r in picked.orderBy("lang", "n").select("lang", "piece").collect():
        pieces.setdefault(r["lang"], []).append(r["piece"])
    names = sorted(pieces, key=lambda x: (-sizes.get(x, 0), x))
    return Model(tuple(names), tuple(" ".join(pieces[x]) for x in names))


def language(model: Model, text: str = "text") -> Column:
    """Struct column (lang, score)."""

    @F.pandas_udf("lang string, score double")
    def told(texts: pd.Series) -> pd.DataFrame:
        return predict(model, texts)

    return told(F.col(text))
