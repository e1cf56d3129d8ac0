"""Exact binomial and hypergeometric statistics as columns, summed in logarithms inside the JVM.

Work per row is in proportion to the counts, which are those of an evaluation table. Null
counts give null; a rate over no items has no interval.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BISECTIONS = 60


def _sum_terms(first_log: Column, steps: Column, ratio) -> Column:
    """Sum of exp(term) for `steps` + 1 terms, each the one before plus log(ratio(i)), i from 1."""
    zero = F.struct(first_log.alias("log"), F.exp(first_log).alias("sum"))

    def step(s, i):
        log = s["log"] + F.log(ratio(i))
        return F.struct(log.alias("log"), (s["sum"] + F.exp(log)).alias("sum"))

    return F.aggregate(F.when(steps >= 1, F.sequence(F.lit(1).cast("long"), steps.cast("long"))).otherwise(F.array().cast("array<bigint>")), zero, step)["sum"]


def binomial_cdf(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) of n draws at p, for 0 <= k < n and 0 < p < 1."""
    odds = p / (1 - p)
    return F.least(F.lit(1.0), _sum_terms(n * F.log(1 - p), k, lambda i: odds * (n - i + 1) / i))


def mcnemar(b: Column, c: Column) -> Column:
    """Two-sided exact p-value of two discordant counts; 1 if there are none."""
    n = (b + c).cast("double")
    tail = _sum_terms(-n * F.log(F.lit(2.0)), F.least(b, c), lambda i: (n - i + 1) / i)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided exact p-value of a 2 x 2 table: all tables of its margins that are no likelier."""
    row, column, n = a + b, a + c, a + b + c + d
    low, high = F.greatest(F.lit(0).cast("long"), row + column - n), F.least(row, column)
    # from the own table up to the last one, then from it down to the first; likelihoods are ratios to the own one
    up, steps = high - a, high - low
    start = F.struct(*[F.lit(x).alias(name) for name, x in (("log", 0.0), ("top", 0.0), ("all", 1.0), ("rare", 1.0))])

    def step(s, i):
        rising = i <= up
        x = F.when(rising, a + i).otherwise(a - (i - up) + 1)  # a step up is from x - 1 to x, one down from x to x - 1
        ratio = F.log((column - x + 1) * (row - x + 1) / (x * (n - column - row + x)).cast("double"))
        before = F.when(i == up + 1, 0.0).otherwise(s["log"])
        return add(s, F.when(rising, before + ratio).otherwise(before - ratio))

    def add(s, log):
        # sums are kept in units of the likeliest table so far
        top = F.greatest(s["top"], log)
        old, one = F.exp(s["top"] - top), F.exp(log - top)
        return F.struct(log.alias("log"), top.alias("top"), (s["all"] * old + one).alias("all"), (s["rare"] * old + F.when(log <= 1e-9, one).otherwise(0.0)).alias("rare"))

    places = F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    p = F.aggregate(places, start, step, lambda s: F.least(F.lit(1.0), s["rare"] / s["all"]))
    return F.when(n == 0, 1.0).otherwise(p)


def clopper_pearson(k: Column, n: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    """Low and high end of the exact interval of k of n, by bisection on the distribution."""
    k, n = k.cast("double"), n.cast("double")

    def solve(above) -> Column:
        zero = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))

        def step(s, _):
            middle = (s["low"] + s["high"]) / 2
            up = above(middle)
            return F.struct(F.when(up, s["low"]).otherwise(middle).alias("low"), F.when(up, middle).otherwise(s["high"]).alias("high"))

        end = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), zero, step)
        return (end["low"] + end["high"]) / 2

    low = F.when(k == 0, 0.0).otherwise(solve(lambda p: 1 - binomial_cdf(k - 1, n, p) >= alpha / 2))
    high = F.when(k == n, 1.0).otherwise(solve(lambda p: binomial_cdf(k, n, p) <= alpha / 2))
    return F.when(n > 0, low), F.when(n > 0, high)
