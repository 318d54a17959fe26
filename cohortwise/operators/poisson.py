"""Exact Poisson confidence limits of a count, for any count, in native expressions.

The lower limit of k cases is the mean at which k or more have probability alpha / 2, the upper one that at which
k or fewer have.  Both are roots of the distribution function F(k; mean), whose derivative is minus the
probability of k, so Newton's method needs only F / probability, which is 1 + k/m + k(k-1)/m^2 + ... .
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA = 0.05
STEPS = 12


def _log_probability(k: Column, mean: Column) -> Column:
    """ln of e^-m m^k / k!, with k! as a sum of logarithms."""
    log_factorial = F.aggregate(
        F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0),
        lambda total, i: total + F.ln(i.cast("double")))
    return k.cast("double") * F.ln(mean) - mean - log_factorial


def _relative_distribution(k: Column, mean: Column) -> Column:
    """F(k; m) divided by the probability of k."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(state: Column, i: Column) -> Column:
        term = state["term"] * i.cast("double") / mean
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    down = F.when(k > 0, F.sequence(k, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(down, start, add, lambda state: state["total"])


def _root(k: Column, target: float, start: Column) -> Column:
    """The mean m with F(k; m) = target, by Newton's steps on ln F, which is concave in m."""
    def step(mean: Column, _: Column) -> Column:
        relative = _relative_distribution(k, mean)
        log_f = _log_probability(k, mean) + F.ln(relative)
        return F.greatest(mean + (log_f - F.lit(target).cast("double")) * relative, mean / 10)

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)


def poisson_limits(counts: DataFrame, count: str = "Deaths", alpha: float = ALPHA) -> DataFrame:
    """``counts`` with L and U: lower and upper limit as multiples of the count.

    A count of 0 has neither (there is nothing to multiply); a null or negative one has nulls.  The work is
    proportional to the count, so ask for distinct counts, and take normal limits for large ones.
    """
    z = NormalDist().inv_cdf(1 - alpha / 2)
    k = F.col(count).cast("int")
    target = math.log(alpha / 2)

    def cube(n: Column, sign: int) -> Column:
        """Wilson and Hilferty's approximation, near enough for Newton's method."""
        x = n.cast("double")
        return F.greatest(x * F.pow(1 - 1 / (9 * x) + sign * z / (3 * F.sqrt(x)), F.lit(3.0)), x / 100)

    # P(k or more) = alpha / 2 is F(k - 1) = 1 - alpha / 2.
    lower = _root(k - 1, math.log1p(-alpha / 2), cube(k, -1))
    upper = _root(k, target, cube(k + 1, 1))
    known = k > 0
    return counts.withColumns({
        "L": F.when(known, lower / k.cast("double")), "U": F.when(known, upper / k.cast("double"))})

