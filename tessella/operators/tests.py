"""Rank tests and control of the false discovery rate."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators.ranking import global_rank
from tessella.scratch import materialize


def average_ranks(rows: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """``rank`` from 1, ties averaged, and ``ties``, how many rows share the value."""
    w = Window.partitionBy(*by)
    tied = rows.withColumn("_v", value)
    ties = F.count("*").over(Window.partitionBy(*by, "_v"))
    return tied.withColumn("ties", ties).withColumn("rank", F.rank().over(w.orderBy("_v")) + (F.col("ties") - 1) / 2.0).drop("_v")


def rank_sum(rows: DataFrame, value: Column, in_first: Column, by: list[str]) -> DataFrame:
    """Per group: n1, n2, u (of the first sample), the tie-corrected sd and z without continuity correction, and whether values tie."""
    ranked = average_ranks(rows.where(value.isNotNull()).withColumn("_first", in_first), value, by)
    n1, n2 = F.count_if("_first"), F.count_if(~F.col("_first"))
    # each of the t rows of a tie adds t**2 - 1 to the tie term, t**3 - t in all
    out = ranked.groupBy(*by).agg(n1.alias("n1"), n2.alias("n2"), F.sum(F.when(F.col("_first"), F.col("rank"))).alias("r1"), F.sum((F.col("ties") * F.col("ties") - 1).cast("double")).alias("t"))
    n = F.col("n1") + F.col("n2")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.try_divide(F.col("t"), (n * (n - 1)).cast("double"))))
    return out.where("n1 > 0 and n2 > 0").select(*by, "n1", "n2", u.alias("u"), sd.alias("sd"), F.try_divide(u - F.col("n1") * F.col("n2") / 2.0, sd).alias("z"), (F.col("t") > 0).alias("tied"))


def signed_rank(rows: DataFrame, difference: Column, by: list[str]) -> DataFrame:
    """Per group: n (differences that aren't 0), w (the sum of positive ranks), z, and whether any tie or are 0; fewer than two are left out."""
    kept = rows.withColumn("_d", difference).where(F.col("_d").isNotNull()).withColumn("_zero", F.col("_d") == 0)
    ranked = average_ranks(kept, F.abs("_d"), [*by, "_zero"])
    own = lambda x: F.sum(F.when(~F.col("_zero"), x))
    out = ranked.groupBy(*by).agg(
        F.count_if(~F.col("_zero")).alias("n"), own(F.when(F.col("_d") > 0, F.col("rank")).otherwise(0.0)).alias("w"),
        own((F.col("ties") * F.col("ties") - 1).cast("double")).alias("t"), F.max("_zero").alias("zeros"),
    )
    n = F.col("n")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("t") / 48.0)
    return out.where("n >= 2").select(*by, "n", "w", F.try_divide(F.col("w") - n * (n + 1) / 4.0, sd).alias("z"), ((F.col("t") > 0) | F.col("zeros")).alias("tied"))


# Coefficients of Hart's rational approximation (1968, no. 5666) to the tail of the normal distribution.
HART_ABOVE = [0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
HART_BELOW = [0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
HART_FAR, HART_FRACTION, HART_ROOT = 7.07106781186547, 0.65, 2.506628274631


def normal_tail(z: Column) -> Column:
    """The share of a standard normal distribution above z, to about 12 digits (8 beyond 6); built-in functions only."""
    x = F.abs(z)

    def polynomial(coefficients: list[float]) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + c
        return out

    fraction = x + HART_FRACTION
    for k in (4, 3, 2, 1):
        fraction = x + F.lit(float(k)) / fraction
    e = F.exp(-x * x / 2)
    tail = F.when(x < HART_FAR, e * polynomial(HART_ABOVE) / polynomial(HART_BELOW)).otherwise(e / fraction / HART_ROOT)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def normal_p(z: Column, alternative: str = "two-sided") -> Column:
    """The p-value of a standard normal z."""
    return {"two-sided": 2 * normal_tail(F.abs(z)), "greater": normal_tail(z), "less": normal_tail(-z)}[alternative]


@lru_cache(maxsize=512)
def _u_tail(n1: int, n2: int) -> np.ndarray:
    """The probability of each U or more without ties: a Gaussian binomial coefficient, a factor of it at a time, in whole numbers."""
    few, many = sorted((n1, n2))
    ways = np.zeros(few * many + 1, object)
    ways[0] = 1
    for i in range(1, few + 1):
        if many + i < len(ways):  # times 1 - x**(many + i)
            ways[many + i :] = ways[many + i :] - ways[: -(many + i)]
        for j in range(i):  # over 1 - x**i
            ways[j::i] = np.cumsum(ways[j::i])
    return (np.cumsum(ways[::-1])[::-1] / math.comb(n1 + n2, n1)).astype(float)


@lru_cache(maxsize=64)
def _w_tail(n: int) -> np.ndarray:
    """The probability of each sum of positive ranks or more, without ties."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for rank in range(1, n + 1):
        ways[rank:] = ways[rank:] + ways[:-rank]
    return np.cumsum(ways[::-1])[::-1] / 2.0**n


def _tails(tail, *sizes: str) -> Callable[..., Column]:
    """A column function of the statistic and the sizes: the exact tail, NULL where the statistic is."""

    @F.pandas_udf("double")
    def look_up(frame: pd.DataFrame) -> pd.Series:
        out = pd.Series(np.nan, frame.index)
        for key, part in frame.dropna().groupby(list(sizes)):
            at = tail(*map(int, key))
            out[part.index] = np.r_[at, 0.0][np.clip(np.ceil(part["stat"].to_numpy()).astype(np.int64), 0, len(at))]
        return out

    return lambda stat: look_up(F.struct(stat.alias("stat"), *sizes))


def rank_sum_p(tested: DataFrame, alternative: str = "two-sided", exact_up_to: int = 8) -> DataFrame:
    """``p`` of ``rank_sum``'s groups: whether the first sample is greater, less, or either.

    Exact where nothing ties and a sample has ``exact_up_to`` rows or fewer, whatever the other has; else normal
    with continuity correction.  NULL where all values tie.
    """
    mu = F.col("n1") * F.col("n2") / 2.0
    stat = {"greater": F.col("u"), "less": 2 * mu - F.col("u"), "two-sided": F.greatest(F.col("u"), 2 * mu - F.col("u"))}[alternative]
    sides = 2 if alternative == "two-sided" else 1
    exact = ~F.col("tied") & (F.least("n1", "n2") <= exact_up_to)
    normal = normal_tail(F.try_divide(stat - mu - 0.5, F.col("sd")))
    p = sides * F.when(exact, _tails(_u_tail, "n1", "n2")(F.when(exact, stat))).otherwise(normal)
    return tested.withColumn("p", F.when(p > 1, 1.0).otherwise(p))  # least would take 1 for NULL


def signed_rank_p(tested: DataFrame, alternative: str = "two-sided", exact_up_to: int = 50) -> DataFrame:
    """``p`` of ``signed_rank``'s groups: whether differences lie above 0, below, or either.

    Exact up to ``exact_up_to`` differences of which none tie or are 0, else normal without continuity correction.
    """
    exact = ~F.col("tied") & (F.col("n") <= exact_up_to)
    top = F.col("n") * (F.col("n") + 1) / 2
    tail = _tails(_w_tail, "n")
    above, below = tail(F.when(exact, F.col("w"))), tail(F.when(exact, top - F.col("w")))
    p = {"greater": above, "less": below, "two-sided": F.least(2 * F.least(above, below), F.lit(1.0))}[alternative]
    return tested.withColumn("p", F.when(exact, p).otherwise(normal_p(F.col("z"), alternative)))


def _step_up(rows: DataFrame, level: Column, scope: list[str], name: str) -> DataFrame:
    """Benjamini-Hochberg: ``name`` counts the rejections of each scope at a level; ``_rank`` is the p-value's place."""
    w = Window.partitionBy(*scope)
    ranked = rows.withColumn("_rank", F.row_number().over(w.orderBy("p")))
    last = F.max(F.when(F.col("p") <= level * F.col("_rank") / F.col("m"), F.col("_rank"))).over(w)
    return ranked.withColumn(name, F.coalesce(last, F.lit(0)))


#: Ranks of a block in which adjusted p-values are found.
RANKS_PER_BLOCK = 100_000


def _pooled(tests: DataFrame, q: float) -> DataFrame:
    """``reject`` and ``p_adj`` with all tests in one scope: places come from ranges of p, the counts of both stages are two numbers."""
    first = q / (1 + q)
    ranked = global_rank(tests, ["p"], "_rank")
    m = ranked.count()
    rejections = lambda level: ranked.where(F.col("p") <= F.lit(level) * F.col("_rank") / F.lit(m)).agg(F.max("_rank")).first()[0] or 0
    r1 = rejections(first) if m else 0
    r2 = r1 if r1 in (0, m) else rejections(first * m / (m - r1))
    # the least of p * m / rank from a test's rank on: within its block, and of the blocks behind
    scaled = ranked.withColumn("_v", F.col("p") * m / F.col("_rank")).withColumn("_block", F.floor((F.col("_rank") - 1) / RANKS_PER_BLOCK))
    behind = Window.orderBy(F.col("_block").desc())  # a row for each block
    least = scaled.groupBy("_block").agg(F.min("_v").alias("_m")).withColumn("_behind", F.min("_m").over(behind.rowsBetween(Window.unboundedPreceding, -1))).drop("_m")
    own = F.min("_v").over(Window.partitionBy("_block").orderBy(F.col("_rank").desc()))
    adjusted = scaled.withColumn("_own", own).join(F.broadcast(least), "_block").withColumn("p_adj", _adjusted(F.least("_own", "_behind"), F.lit(float(m)), F.lit(float(r1)), q))
    return adjusted.withColumn("reject", F.col("_rank") <= r2).drop("_rank", "_v", "_block", "_own", "_behind")


def _adjusted(step_up: Column, m: Column, r1: Column, q: float) -> Column:
    """A step-up p-value as the second stage adjusts it: at most q where the test is rejected."""
    share = F.when((r1 > 0) & (r1 < m), (m - r1) / m).otherwise(1.0)
    return F.least(F.least(step_up, F.lit(1.0)) * share * (1 + q), F.lit(1.0))


def fdr_two_stage(rows: DataFrame, q: float = 0.01, scope: tuple[str, ...] = ()) -> DataFrame:
    """``reject`` and the adjusted p-value ``p_adj`` by the two-stage step-up procedure of Benjamini, Krieger and Yekutieli (2006).

    P-values (column ``p``) are pooled over each scope, or over all rows.  A NULL or NaN p-value is no
    test, has no p_adj and isn't rejected.  The first stage runs at q / (1 + q); the second at that times m / (m - r1).
    """
    rows = materialize(rows, "tests")  # a row for each test, each of them dear, and read several times
    first = q / (1 + q)
    valid = F.col("p").isNotNull() & ~F.isnan("p")
    tests = rows.where(valid)
    if scope:
        tests = tests.withColumn("m", F.count("*").over(Window.partitionBy(*scope)))
        one = _step_up(tests, F.lit(first), list(scope), "r1")
        second = F.when(F.col("r1") < F.col("m"), F.lit(first) * F.col("m") / (F.col("m") - F.col("r1"))).otherwise(F.lit(1.0))
        two = _step_up(one, second, list(scope), "r2")
        reject = (F.col("r1") > 0) & ((F.col("r1") == F.col("m")) | (F.col("_rank") <= F.col("r2")))
        step_up = F.min(F.col("p") * F.col("m") / F.col("_rank")).over(Window.partitionBy(*scope).orderBy(F.col("_rank").desc()))
        done = two.withColumn("reject", reject).withColumn("p_adj", _adjusted(step_up, F.col("m"), F.col("r1"), q)).drop("m", "_rank", "r1", "r2")
    else:
        done = _pooled(tests, q)
    return done.unionByName(rows.where(~valid | F.col("p").isNull()).withColumn("reject", F.lit(False)).withColumn("p_adj", F.lit(None).cast("double")))
