"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Method. Text is folded (case, accents, homoglyphs, digits and signs written for letters inside a word),
every run of other characters becomes one blank, and one automaton finds lexicon entries: whole words and
word beginnings, each with a weight, and exception phrases. A word counts with its heaviest entry, unless an
exception phrase covers it. The sum of weights is normalised by the number of words; a logistic curve
over (heaviest word, normalised sum, number of hits) gives the score.

The lexicon is learned from a bounded sample of labelled rows: weight = lower confidence limit of the log-odds
of an entry in toxic against clean texts. Two thirds of the sample give the entries, the rest the curve.

Defined results: null and empty texts have no hits and get the curve's value for none; repeated rows are scored alike; other columns pass
through untouched; with no labels at all the lexicon is empty and the score is 0.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.llm.common import labelled_sample

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһкмтвнԛԝαβεηικνορτυχγ", "aeopcyxijsdhkmtbhqwabenikvoptuxy", strict=True))
# Digits and signs written for letters. i, l, 1, ! and | fold to one letter.
LOOKS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}
SIGNS = "@$!|"
# Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "scum line", "sore loser rule", "pond scum")
PREFIXES = (4, 5, 6, 7)

_SIGN_INSIDE = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W_])")


class _Fold(dict):
    """Code point to folded text, filled on use."""

    def __missing__(self, code: int) -> str:
        letters = unicodedata.normalize("NFKD", chr(code)).lower()
        # signs are letters only inside a word, which fold() sees to
        out = "".join(HOMOGLYPHS.get(c, c if c in SIGNS else LOOKS.get(c, c)) for c in letters if not unicodedata.combining(c))
        out = "".join(c if c.isalnum() else " " for c in out)
        if len(self) < 100_000:
            self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """Folded words, one blank between, before and after."""
    text = text or ""
    if any(s in text for s in SIGNS):
        text = _SIGN_INSIDE.sub(lambda m: LOOKS[m.group()], text)
    return " " + " ".join(text.translate(_FOLD).split()) + " "


def entries(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in PREFIXES if len(w) > k)
    return out


@dataclass(frozen=True)
class Lexicon:
    weights: tuple[tuple[str, float], ...] = ()
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, ...] = field(default=())  # bias, then one factor per feature

    def features(self, text: str | None) -> tuple[float, float, float]:
        folded = fold(text)
        words: dict[int, float] = {}
        quiet: list[tuple[int, int]] = []
        for end, (weight, size) in _automaton(self).iter(folded):
            start = end - size + 1
            if weight is None:
                quiet.append((start, end))
            elif weight > words.get(start, 0.0):
                words[start] = weight
        if quiet:
            words = {s: w for s, w in words.items() if not any(a <= s < b for a, b in quiet)}
        n = folded.count(" ") - 1
        total = sum(words.values())
        return max(words.values(), default=0.0), 100 * total / (n + 50), math.log1p(len(words))

    def score(self, texts: pd.Series) -> np.ndarray:
        if not self.curve:
            return np.zeros(len(texts))
        x = np.array([(1.0, *self.features(t)) for t in texts], float).reshape(-1, 4)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.curve), -30, 30)))


@lru_cache(maxsize=4)
def _automaton(lexicon: Lexicon):
    import ahocorasick

    out = ahocorasick.Automaton()
    for entry, weight in lexicon.weights:
        out.add_word(entry, (weight, len(entry)))
    for phrase in lexicon.exceptions:
        out.add_word(fold(phrase), (None, len(fold(phrase))))
    out.add_word("\0", (0.0, 1))
    out.make_automaton()
    return out


def _count(batches: Iterator[pa.RecordBatch], wanted: set[str] | None = None) -> Iterator[pa.RecordBatch]:
    """Texts per entry, summed per batch."""
    for batch in batches:
        found: Counter = Counter()
        for text in batch.column(0).to_pylist():
            seen = entries(fold(text))
            found.update(seen if wanted is None else seen & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["entry", "n"])


def learn(docs: DataFrame, labels: DataFrame, usable: Column, limit: int = 24_000, most_entries: int = 4_000, least: float = 1.0) -> Lexicon:
    """Lexicon and curve from at most ``limit`` labelled rows for which ``usable`` holds.

    Counts per entry are summed by Spark; what reaches the driver is at most the entries of the toxic texts of
    the sample that stand in 0.5 % of them (three at least), and one row of features per calibration text.
    """
    sample = labelled_sample(docs, labels, "toxic", usable, limit).withColumn("part", F.pmod(F.xxhash64(F.col("doc_id"), F.lit("part")), F.lit(3))).cache()
    sizes = {(r["rest"], r["label"]): r["n"] for r in sample.groupBy((F.col("part") == 0).alias("rest"), "label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get((False, 1), 0), sizes.get((False, 0), 0)
    if not toxic or not clean:
        sample.unpersist()
        return Lexicon()

    def counts(label: int, least_n: int, wanted: set[str] | None = None) -> dict[str, int]:
        rows = sample.where((F.col("part") != 0) & (F.col("label") == label)).select("text")
        found = rows.mapInArrow(lambda batches: _count(batches, wanted), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))
        return {r["entry"]: r["n"] for r in found.where(F.col("n") >= least_n).collect()}

    in_toxic = counts(1, max(3, math.ceil(0.005 * toxic)))
    in_clean = counts(0, 1, set(in_toxic))
    weights = {}
    for entry, t in in_toxic.items():
        c = in_clean.get(entry, 0)
        odds = math.log((t + 0.5) / (toxic - t + 0.5)) - math.log((c + 0.5) / (clean - c + 0.5))
        weights[entry] = odds - 2 * math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
    kept = sorted((e for e, w in weights.items() if w >= least), key=lambda e: (-weights[e], e))[:most_entries]
    lexicon = Lexicon(tuple((e, round(weights[e], 6)) for e in sorted(kept)))

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = pd.DataFrame([lexicon.features(t) for t in frame["text"]], columns=["a", "b", "c"], dtype=float)
            yield out.assign(y=frame["label"].to_numpy())

    seen = sample.where(F.col("part") == 0).select("text", "label").mapInPandas(look, "a double, b double, c double, y int").toPandas().sort_values(["a", "b", "c", "y"])
    sample.unpersist()
    return Lexicon(lexicon.weights, lexicon.exceptions, fit_curve(seen[["a", "b", "c"]].to_numpy(float), seen["y"].to_numpy(float)))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps, each halved until the loss falls (whole steps may run away on nearly separable rows)."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))

    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float(np.logaddexp(0, z).sum() - y @ z + at @ penalty @ at / 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + penalty, x.T @ (y - p) - penalty @ b)
        now = loss(b)
        while np.abs(step).max() >= 1e-9 and loss(b + step) > now:
            step = step / 2
        if np.abs(step).max() < 1e-9:
            break
        b = b + step
    return tuple(float(v) for v in b)


def toxicity_score(lexicon: Lexicon, text: str | Column = "text") -> Column:
    """Score column, 0 to 1."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(lexicon.score(texts))

    return scored(F.col(text) if isinstance(text, str) else text)
