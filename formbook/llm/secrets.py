"""Secrets in text: fixed patterns, and a battery of randomness tests. DataFrame operations only.

Method. Three patterns give the base spans. Other spans are tokens that look like keys: runs of at least 20
characters of an encoding's alphabet with a letter and a digit. The encoding is inferred (hex, base 32, one-case or mixed
alphanumerics, base 64). A token must look random in it: a chi-squared test of uniformity (Wilson-Hilferty) and the lag-one serial
correlation must not reject. A runs test over character classes measures how unlike text a token is; these p values are held to a
false-discovery rate (Benjamini-Hochberg) over all tokens of the corpus, apart for each class of lengths. That needs
counts per (length class, p-value bin), which is a small table at any size; bins round against discovery.

Positions are found without a pattern engine that reports them: a text is split at the matches, and lengths of gaps and matches are summed up. Long texts with
many matches are summed in blocks, so the work grows with the text.

Defined results: null is the empty text, without spans; spans of the method that overlap a base span are dropped; repeated rows are treated alike;
other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.llm.common import free_names

# The patterns, in the order of kinds.
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
TOKEN = "[A-Za-z0-9+/_-]{20,}={0,2}"
RATE = 0.01
REJECT_Z = 3.29  # two-sided one in a thousand
LENGTHS = (24, 32, 48)
BINS = 400  # of a twentieth of a decade

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"


SPAN = "struct<start:int,kind:int,end:int>"
BLOCK = 256  # items a scan goes over at a time, so that its arrays are not copied whole at each item


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, worked out once: an expression named in a lambda's body is worked out again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _scan(items: Column, item: str, zero: Column, value: Callable[[Column], Column], combine: Callable[[Column, Column], Column]) -> Column:
    """Array of (item, before), ``before`` being ``combine`` (associative) over ``value`` of all earlier items. ``item`` is the type of an item.

    Scanned in blocks, then by blocks: the work grows with the items, not with their square.
    """
    return _let(items, lambda held: _scan_held(held, item, zero, value, combine))


def _scan_held(items: Column, item: str, zero: Column, value: Callable[[Column], Column], combine: Callable[[Column, Column], Column]) -> Column:
    part = f"array<struct<item:{item},before:int>>"
    heads = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    local = F.transform(
        F.transform(heads, lambda at: F.slice(items, at, F.lit(BLOCK))),
        lambda block: F.aggregate(
            block, F.struct(zero.alias("at"), F.array().cast(part).alias("found")),
            lambda acc, x: F.struct(combine(acc["at"], value(x)).alias("at"), F.concat(acc["found"], F.array(F.struct(x.alias("item"), acc["at"].alias("before")))).alias("found")),
        ),
    )
    return F.aggregate(
        local, F.struct(zero.alias("at"), F.array().cast(f"array<{part}>").alias("found")),
        lambda acc, one: F.struct(
            combine(acc["at"], one["at"]).alias("at"),
            F.concat(acc["found"], F.array(F.transform(one["found"], lambda x: F.struct(x["item"].alias("item"), combine(acc["at"], x["before"]).alias("before"))))).alias("found"),
        ),
        lambda acc: F.flatten(acc["found"]),
    )


def _places(text: Column, pattern: str) -> Column:
    """Array of (found, start, end) of the matches, in code points and in order: a match starts where the texts between matches and the matches before it end."""
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("found")))
    # the text after the last match has no match beside it
    pieces = F.filter(pieces, lambda x: x["found"].isNotNull())
    scanned = _scan(pieces, "struct<gap:int,found:string>", F.lit(0), lambda x: x["gap"] + F.length(x["found"]), lambda a, b: a + b)

    def place(x: Column) -> Column:
        start = x["before"] + x["item"]["gap"]
        return F.struct(x["item"]["found"].alias("found"), start.alias("start"), (start + F.length(x["item"]["found"])).alias("end"))

    return F.transform(scanned, place)


def _as_spans(places: Column, kind: int) -> Column:
    """Array of (start, kind, end)."""
    return F.transform(places, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Spans of the three patterns by start, then kind."""
    assigned = F.filter(_places(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["found"], ASSIGN, 2)) >= 8)
    return F.array_sort(F.concat(_as_spans(assigned, 0), _as_spans(_places(text, ACCESS), 1), _as_spans(_places(text, HEX), 2)))


def _key_like(token: Column) -> Column:
    return token.rlike("[0-9]") & token.rlike("[A-Za-z]")


def tokens(text: Column) -> Column:
    """Runs with a letter and a digit that an encoding could have made."""
    return F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), _key_like)


def clear_of(spans: Column, others: Column) -> Column:
    """Those of ``spans`` (kind 3, by start) that overlap none of ``others``: the others before them have ended, the next one starts after them."""
    far = 2**31 - 1
    merged = F.array_sort(F.concat(others, spans))
    is_other = lambda x: x["kind"] < 3
    ended = _scan(merged, SPAN, F.lit(0), lambda x: F.when(is_other(x), x["end"]).otherwise(0), lambda a, b: F.greatest(a, b))
    fits = F.transform(F.filter(ended, lambda x: is_other(x["item"]) | (x["before"] <= x["item"]["start"])), lambda x: x["item"])
    ahead = _scan(F.reverse(fits), SPAN, F.lit(far), lambda x: F.when(is_other(x), x["start"]).otherwise(far), lambda a, b: F.least(a, b))
    free = F.filter(ahead, lambda x: ~is_other(x["item"]) & (x["before"] >= x["item"]["end"]))
    return F.reverse(F.transform(free, lambda x: x["item"]))


def tail(z: Column) -> Column:
    """Upper tail of the normal distribution (a rational approximation, good to 1e-7)."""
    a = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) * F.lit(1 / math.sqrt(2 * math.pi)) * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def alphabet_size(token: Column) -> Column:
    return (
        F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16.0).when(token.rlike("^[A-Z2-7]+=*$"), 32.0).when(token.rlike("^([a-z0-9]+|[A-Z0-9]+)$"), 36.0)
        .when(token.rlike("^[A-Za-z0-9]+$"), 62.0).otherwise(64.0)
    )


def verdicts(found: Column) -> Column:
    """For each token a struct (bin, length class): the bin of its p value, -1 where it does not look random in its encoding."""

    def judged(token: Column) -> Column:
        return _let(F.rtrim(token, F.lit("=")), lambda body: _let(F.split(body, ""), lambda letters: verdict(token, body, letters)))

    def lag_one(letters: Column, n: Column) -> Column:
        """Lag-one correlation of places in the alphabet."""
        place = F.transform(letters, lambda c: F.call_function("locate", c, F.lit(_ALPHABET)).cast("double"))

        def about(place: Column, mean: Column) -> Column:
            var = F.aggregate(place, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
            lagged = F.zip_with(F.slice(place, 1, F.size(place) - 1), F.slice(place, 2, F.size(place) - 1), lambda x, y: (x - mean) * (y - mean))
            return F.aggregate(lagged, F.lit(0.0), lambda a, x: a + x) / F.greatest(var, F.lit(1e-9)) * F.sqrt(n)

        return _let(place, lambda p: _let(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / n, lambda mean: about(p, mean)))

    def verdict(token: Column, body: Column, letters: Column) -> Column:
        n = F.length(body).cast("double")
        size = alphabet_size(token)
        # chi-squared against uniform use of the alphabet
        squares = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.length(F.replace(body, c, F.lit(""))), F.lit(2.0)))
        df = size - 1
        spread = F.lit(2.0) / (df * 9)
        uniform = (F.pow(F.greatest(size / n * squares - n, F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
        serial = lag_one(letters, n)
        # runs of character classes; words joined to numbers change class at most about once in five characters
        classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
        changes = (F.length(classes) - 1).cast("double")
        unlike = (changes - 0.5 - 0.2 * (n - 1)) / F.sqrt(0.16 * (n - 1))
        p = F.greatest(tail(unlike), F.lit(1e-20))
        random = (F.abs(serial) <= REJECT_Z) & (uniform <= REJECT_Z)
        length_class = sum((F.when(n >= b, 1).otherwise(0) for b in LENGTHS), F.lit(0))
        return F.struct(F.when(random, F.least(F.floor(-F.log10(p) * 20), F.lit(BINS)).cast("int")).otherwise(-1).alias("bin"), length_class.cast("int").alias("length"))

    return F.transform(found, judged)


def discoveries(docs: DataFrame, text: str = "text", rate: float = RATE) -> dict[int, int]:
    """Least bin that counts as a discovery, for each length class; from all tokens of all texts."""
    each = docs.select(F.explode(verdicts(tokens(F.coalesce(F.col(text), F.lit(""))))).alias("v")).select("v.*")
    counts = each.groupBy("length", "bin").agg(F.count("*").alias("n"))
    by_class = Window.partitionBy("length")
    upto = by_class.orderBy(F.col("bin").desc())
    # a bin's p values are at most 10^(-bin/20); the rest of the battery made -1 of those that don't look random
    ranked = counts.withColumn("m", F.sum("n").over(by_class)).withColumn("k", F.sum("n").over(upto)).where(F.col("bin") >= 0)
    passing = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / 20) * F.col("m") / F.col("k") <= rate)
    return {r["length"]: r["b"] for r in passing.groupBy("length").agg(F.min("bin").alias("b")).collect()}


def with_spans(docs: DataFrame, least_bin: dict[int, int], text: str = "text", into: str = "spans") -> DataFrame:
    """Adds ``into`` (base spans) and ``into_random`` (spans of the battery that overlap none of them), each an array of (start, kind, end)."""
    t = F.coalesce(F.col(text), F.lit(""))
    bound = F.lit(BINS + 1)
    held, judged = free_names(docs, "tokens", "verdicts")
    out = docs.withColumn(into, base_spans(t)).withColumn(held, F.filter(_places(t, TOKEN), lambda x: _key_like(x["found"])))
    out = out.withColumn(judged, verdicts(F.transform(held, lambda x: x["found"])))

    def counts(v: Column) -> Column:
        least = bound
        for length, b in least_bin.items():
            least = F.when(v["length"] == length, F.lit(b)).otherwise(least)
        return v["bin"] >= least

    random = F.filter(F.zip_with(held, judged, lambda x, v: F.when(counts(v), x)), lambda x: x.isNotNull())
    return out.withColumn(f"{into}_random", clear_of(_as_spans(random, 3), F.col(into))).drop(held, judged)


def written(spans: Column) -> Column:
    """``kind:start:end`` joined by commas, by start, then kind."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by a mark; spans that overlap become one."""
    kinds = F.array(*[F.lit(k) for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["upto"]
        gap = F.substring(text, acc["upto"] + 1, s["start"] - acc["upto"])
        grown = F.concat(acc["out"], gap, F.lit("["), F.element_at(kinds, s["kind"] + 1), F.lit("]"))
        return F.struct(F.greatest(acc["upto"], s["end"]).alias("upto"), F.when(fresh, grown).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("upto"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["upto"] + 1, F.length(text))))
