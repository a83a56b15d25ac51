"""Quality by a sparse rule ensemble.

Method. Each text is described by a few shares and counts, all Spark column expressions. A random forest is grown on a
bounded labelled sample; every path from a root to a node is a rule, a conjunction of comparisons. A logistic model with
an L1 penalty weighs the rules, most of which get no weight. The rest is compiled back into one column expression, so
scoring the corpus is a projection, without Python and without a shuffle.

Defined results: null is scored as the empty text, whose counts and shares are 0; repeated rows are scored alike; other columns pass through;
where the sample has only one label, or none, the score is that label's share (0.5 without labels).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.llm.common import labelled_sample
from formbook.session import checkpointed

Rule = tuple[tuple[str, bool, float], ...]  # (statistic, at most?, bound)

_CLASSES = {
    "digits": "[0-9]+", "capitals": "[A-ZÀ-ÖØ-Þ]+", "signs": "[%$&*#@~^_=+<>{}\\[\\]\\\\]+", "bangs": "[!?]+", "bars": "[|/]+", "stops": "[.;:]+", "commas": "[,]+", "lines": "[\\n\\r]+",
}
STATISTICS = ("words", "word_length", "distinct", *_CLASSES, "first_repeats", "twins")


def with_statistics(df: DataFrame, text: str = "text", prefix: str = "_q_") -> DataFrame:
    """Adds the statistics as columns ``prefix + name``."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(t) + F.lit(1.0)
    words = F.split(F.lower(F.trim(t)), "\\s+")
    df = df.withColumn(f"{prefix}w", words)
    size = F.when(F.length(F.trim(t)) == 0, 0).otherwise(F.size(f"{prefix}w")).cast("double")
    shares = {f"{prefix}{k}": (F.length(t) - F.length(F.regexp_replace(t, v, ""))) / n for k, v in _CLASSES.items()}
    w = F.col(f"{prefix}w")
    half = F.slice(w, 1, F.greatest(F.lit(1), F.floor(F.size(w) / 2).cast("int")))
    out = df.withColumns(
        {
            f"{prefix}words": size,
            f"{prefix}word_length": F.length(t) / (size + 1.0),
            f"{prefix}distinct": F.when(size == 0, 0.0).otherwise(F.size(F.array_distinct(w)) / (size + F.lit(1e-9))),
            **shares,
            f"{prefix}first_repeats": F.when(size == 0, 0.0).otherwise(F.size(F.array_distinct(half)) / (F.size(half) + F.lit(1e-9))),
            # words written twice in a row
            f"{prefix}twins": (F.length(t) - F.length(F.regexp_replace(t, "(?i)\\b(\\S{1,40}) (?=\\1\\b)", ""))) / n,
        }
    )
    return out.drop(f"{prefix}w")


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[tuple[Rule, float], ...] = ()
    prefix: str = "_q_"

    def score(self) -> Column:
        """The score over statistics columns."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule, self.prefix), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(rule: Rule, prefix: str) -> Column:
    out = None
    for name, at_most, bound in rule:
        c = F.col(prefix + name)
        one = c <= F.lit(bound) if at_most else c > F.lit(bound)
        out = one if out is None else out & one
    return out


def paths(description: str, names: tuple[str, ...]) -> list[Rule]:
    """Every path to an inner or last node of a forest, from its printed form; comparisons of one statistic are merged."""
    found: dict[Rule, None] = {}
    trail: list[tuple[str, bool, float]] = []
    for line in description.splitlines():
        depth = len(line) - len(line.lstrip())
        if "Tree " in line:
            trail, base = [], depth + 2
        elif m := re.search(r"(?:If|Else) \(feature (\d+) (<=|>) ([-0-9.eE]+)\)", line):
            trail = [*trail[: depth - base], (names[int(m[1])], m[2] == "<=", float(m[3]))]
            merged: dict[tuple[str, bool], float] = {}
            for name, at_most, bound in trail:
                old = merged.get((name, at_most))
                merged[name, at_most] = bound if old is None else (min if at_most else max)(old, bound)
            found[tuple(sorted((n, a, b) for (n, a), b in merged.items()))] = None
    return list(found)


def learn(docs: DataFrame, labels: DataFrame, usable: Column, limit: int = 8_000, trees: int = 10, depth: int = 4, penalty: float = 0.0005) -> RuleModel:
    """Rules and weights from at most ``limit`` labelled rows for which ``usable`` holds (chosen by a hash of the id)."""
    sample = with_statistics(labelled_sample(docs, labels, "quality", usable, limit))
    columns = [f"_q_{s}" for s in STATISTICS]
    # bounded, narrow rows: brought together once, read by every round of fitting; dealt and ordered by value, so that every run draws the same trees
    narrow = sample.select(F.col("label").cast("double").alias("label"), *columns)
    frame = checkpointed(narrow.repartition(8, *columns).sortWithinPartitions(*columns, "label"))
    share = frame.agg(F.avg("label").alias("p")).first()["p"]
    if share is None or share in (0.0, 1.0):
        return RuleModel({None: 0.0, 0.0: -30.0, 1.0: 30.0}[share])
    ready = VectorAssembler(inputCols=columns, outputCol="features").transform(frame).select("label", "features", *columns)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, seed=7, featureSubsetStrategy="0.6").fit(ready)
    rules = paths(forest.toDebugString, STATISTICS)
    if not rules:
        import math

        return RuleModel(math.log(share / (1 - share)))
    marked = frame.select("label", array_to_vector(F.array(*[F.when(holds(r, "_q_"), 1.0).otherwise(0.0) for r in rules])).alias("features")).cache()
    fitted = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(marked)
    marked.unpersist()
    # sums of gradients differ in their last digits with the order of the tasks; six digits are the same on every run
    kept = tuple((r, round(float(w), 6)) for r, w in zip(rules, fitted.coefficients.toArray(), strict=True) if abs(w) > 1e-5)
    return RuleModel(round(float(fitted.intercept), 6), kept)
