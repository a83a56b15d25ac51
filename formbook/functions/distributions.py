"""Count and normal distributions, the prices made from them, and their inversions.

A negative binomial thinned by a save rate ``q`` is again negative binomial with mean
``mu * q`` and the same dispersion, which gives the save distribution without a
shots-by-saves matrix.  Sums over a mass function run as Arrow batches: one numpy
recurrence step per support point prices a whole batch, where a fold expression would be
interpreted per row and point.  The normal distribution is a plain expression.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE_PRICE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("p_over", "p_under", "p_push")])


def _mass_at_line(mean, a, at):
    """(mass below, mass at) a line per row, summed up to each row's own line in log space.

    A mass below double precision counts as zero but its logarithm is carried on, so large means
    lose nothing; rows leave the loop once it has passed their line.
    """
    import numpy as np

    safe = np.where(a > 0, a, 1.0)
    log_mass = np.where(a > 0, -np.log1p(safe * mean) / safe, -mean)
    under, push = np.where(at > 0, np.exp(log_mass), 0.0), np.where(at == 0, np.exp(log_mass), 0.0)
    live = np.argsort(-at, kind="stable")
    log_step = np.log(mean) - np.log1p(a * mean)
    for k in range(1, int(at.max(initial=0.0)) + 1):
        live = live[: np.searchsorted(-at[live], -k, "right")]
        log_mass[live] += log_step[live] + np.log1p(a[live] * (k - 1)) - np.log(k)
        mass = np.exp(log_mass[live])
        here = at[live] == k
        under[live] += np.where(here, 0.0, mass)
        push[live] += np.where(here, mass, 0.0)
    return under, push


@F.pandas_udf(LINE_PRICE)
def price_count_line(mu, alpha, q, line):
    """P(over), P(under), P(push) of a thinned count at a line; Poisson where alpha is zero.

    The sum runs to each row's line, whatever its size; the rest of the mass is over, so the three sum to one.
    """
    import numpy as np
    import pandas as pd

    mean = np.maximum(mu.to_numpy(dtype=float), 1e-6) * np.clip(q.to_numpy(dtype=float), 1e-6, 1 - 1e-6)
    a = alpha.to_numpy(dtype=float)
    at = line.to_numpy(dtype=float)
    known = np.isfinite(mean) & np.isfinite(a) & np.isfinite(at)
    mean, a, at = np.where(known, mean, 1.0), np.where(known, a, 0.0), np.where(known, at, 0.0)
    under, push = _mass_at_line(mean, a, at)
    over = np.maximum(1.0 - under - push, 0.0)
    out = pd.DataFrame({"p_over": over, "p_under": under, "p_push": push})
    return out.where(pd.Series(known), None).astype("float64")


def _poly(coefficients: list[float], x: Column) -> Column:
    """Polynomial with the highest power first."""
    return reduce(lambda acc, c: acc * x + c, coefficients[1:], F.lit(coefficients[0]))


# fixed values: rational approximations of the error function by range (Cody 1969)
_ERF_NUM = [1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3]
_ERF_DEN = [1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3]
_ERFC_NUM = [2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2,
             8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3]
_ERFC_DEN = [1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
             3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3]
_TAIL_NUM = [1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1,
             1.60837851487422766e-2, 6.58749161529837803e-4]
_TAIL_DEN = [1.0, 2.56852019228982242e0, 1.87295284992346047e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3]


def _erfc(x: Column) -> Column:
    """Complementary error function of a non-negative argument."""
    small = 1.0 - x * _poly(_ERF_NUM, x * x) / _poly(_ERF_DEN, x * x)
    middle = F.exp(-x * x) * _poly(_ERFC_NUM, x) / _poly(_ERFC_DEN, x)
    inv = 1.0 / (F.greatest(x, F.lit(1.0)) * F.greatest(x, F.lit(1.0)))
    tail = F.exp(-x * x) / F.greatest(x, F.lit(1.0)) * (0.5641895835477563 - inv * _poly(_TAIL_NUM, inv) / _poly(_TAIL_DEN, inv))
    return F.when(x <= 0.46875, small).when(x <= 4.0, middle).otherwise(tail)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function to double precision."""
    half = 0.5 * _erfc(F.abs(x) * 0.7071067811865476)
    return F.when(x > 0, 1.0 - half).otherwise(half)


def _named(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``; keeps expression trees small."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


# fixed values: rational approximations of the normal quantile, centre and tail (Acklam)
_Q_NUM = [-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239e0]
_Q_DEN = [-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0]
_QT_NUM = [-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838e0, -2.549732539343734e0, 4.374664141464968e0, 2.938163982698783e0]
_QT_DEN = [7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996e0, 3.754408661907416e0, 1.0]


def normal_quantile(p: Column) -> Column:
    """Inverse of ``normal_cdf``: a rational start and one third-order correction."""
    tail = F.sqrt(-2.0 * F.log(F.least(p, 1.0 - p)))
    far = _named(tail, lambda t: _poly(_QT_NUM, t) / _poly(_QT_DEN, t))
    centre = _named(p - 0.5, lambda r: r * _poly(_Q_NUM, r * r) / _poly(_Q_DEN, r * r))
    start = F.when(F.abs(p - 0.5) <= 0.47575, centre).when(p < 0.5, far).otherwise(-far)

    def correct(z: Column) -> Column:
        step = (normal_cdf(z) - p) * 2.5066282746310002 * F.exp(z * z / 2.0)
        return _named(step, lambda u: z - u / (1.0 + z * u / 2.0))

    return _named(start, correct)


def ladder_baseline(line: Column, mean: Column, sigma: Column) -> Column:
    """P(count > line) under a normal with half-point continuity correction."""
    return 1.0 - normal_cdf((line + 0.5 - mean) / sigma)


CAPPED_SCHEMA = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("p_over", "p_under", "p_push", "pmf_total")]
)


def price_count_line_capped(mu, alpha, q, line, support: int = 70) -> Column:
    """The shots-by-saves form with the shot count cut at ``support``: tail mass is dropped.

    Kept for parity with prices made that way.  ``pmf_total`` tells how much mass is left;
    ``enough_mass`` is the gate on it.  One matrix per distinct distribution of a batch.
    """

    @F.pandas_udf(CAPPED_SCHEMA)
    def price(mu, alpha, q, line):
        import numpy as np
        import pandas as pd

        n = np.arange(support + 1, dtype=float)
        log_fact = np.concatenate([[0.0], np.cumsum(np.log(n[1:]))])
        lower = n[:, None] >= n[None, :]
        gap = np.where(lower, n[:, None] - n[None, :], 0.0)
        log_choose = log_fact[:, None] - log_fact[None, :] - log_fact[gap.astype(int)]
        given = np.column_stack([x.to_numpy(dtype=float) for x in (mu, alpha, q)])
        at = line.to_numpy(dtype=float)
        out = np.full((len(mu), 4), np.nan)
        known = np.flatnonzero(np.isfinite(given).all(axis=1) & np.isfinite(at))
        kinds, kind = np.unique(given[known], axis=0, return_inverse=True)
        order = np.argsort(kind.ravel(), kind="stable")
        edges = np.searchsorted(kind.ravel()[order], np.arange(len(kinds) + 1))
        for i, (m, a, rate) in enumerate(kinds):
            m, rate = max(m, 1e-6), min(max(rate, 1e-6), 1 - 1e-6)
            zero = np.log1p(a * m) / -a if a > 0 else -m
            k = n[1:]
            steps = np.log(m / k * (1 + a * (k - 1)) / (1 + a * m))
            shots = np.exp(zero + np.concatenate([[0.0], np.cumsum(steps)]))
            thin = np.where(lower, np.exp(log_choose + n[None, :] * np.log(rate) + gap * np.log1p(-rate)), 0.0)
            saves = shots @ thin
            rows = known[order[edges[i] : edges[i + 1]]]
            over, push = n[None, :] > at[rows, None], n[None, :] == at[rows, None]
            out[rows] = np.column_stack([over @ saves, (~over & ~push) @ saves, push @ saves, np.full(len(rows), saves.sum())])
        return pd.DataFrame(out, columns=CAPPED_SCHEMA.names)

    return price(mu, alpha, q, line)


def enough_mass(total: Column, least: float = 0.999) -> Column:
    """The mass a cut distribution kept; a row that lost more than ``1 - least`` stops the query."""
    lost = F.raise_error(F.concat(F.lit("count distribution cut to a mass of "), total.cast("string"))).cast("double")
    return F.when(total.isNull() | (total >= least), total).otherwise(lost)


@F.pandas_udf(T.DoubleType())
def invert_count_mean(line, prob, alpha):
    """Mean of a count whose P(count > line) equals ``prob``; vectorised bisection."""
    import numpy as np
    import pandas as pd

    at = np.floor(line.to_numpy(dtype=float))
    p = np.clip(prob.to_numpy(dtype=float), 1e-4, 1 - 1e-4)
    a = alpha.to_numpy(dtype=float)
    good = np.isfinite(at) & np.isfinite(p) & (at >= 0)
    at = np.where(good, at, 0.0)

    def over(mean):
        under, push = _mass_at_line(mean, a, at)
        return 1.0 - under - push

    lo, hi = np.full(len(p), 1e-6), np.full(len(p), 1e-6) + np.maximum(8.0 * (at + 1.0), 40.0)
    reached = over(hi) >= p
    for _ in range(40):
        if reached[good].all():
            break
        # the bracket grows until it holds the mean
        lo, hi = np.where(reached, lo, hi), np.where(reached, hi, 4 * hi)
        reached = over(hi) >= p
    for _ in range(80):
        mid = (lo + hi) / 2
        below = over(mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return pd.Series(np.where(good & reached, (lo + hi) / 2, np.nan)).replace({np.nan: None}).astype("float64")


def invert_normal_mean(line: Column, prob: Column, sigma: float) -> Column:
    """Mean of a normal whose P(x > line) equals ``prob``."""
    return line + sigma * normal_quantile(F.least(F.greatest(prob, F.lit(1e-4)), F.lit(1 - 1e-4)))
