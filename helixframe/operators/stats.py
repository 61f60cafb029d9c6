"""Count comparisons: Fisher's exact test, Audic-Claverie, fold change."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


@F.pandas_udf(T.DoubleType())
def log_factorial(n: pd.Series) -> pd.Series:
    """Natural logarithm of n!; each value is computed once a batch."""
    values, place = np.unique(n.to_numpy(), return_inverse=True)
    return pd.Series(np.array([math.lgamma(v + 1) for v in values])[place])


def fisher(a: int, b: int, c: int, d: int, two_sided: bool = True) -> float:
    """Probability of the table [a b; c d] or a more extreme one with the same margins."""
    row, col, n = a + b, a + c, a + b + c + d
    whole = _log_choose(n, col)
    log_p = lambda x: _log_choose(row, x) + _log_choose(n - row, col - x) - whole
    lo, hi = max(0, col - (n - row)), min(row, col)
    own = log_p(a)
    if two_sided:
        return min(1.0, sum(math.exp(p) for x in range(lo, hi + 1) if (p := log_p(x)) <= own + 1e-9))
    side = range(lo, a + 1) if a * (c + d) <= c * (a + b) else range(a, hi + 1)
    return min(1.0, sum(math.exp(log_p(x)) for x in side))


def audic_claverie(x: int, y: int, n1: int, n2: int) -> float:
    """Probability of y counts in a sample of n2 given x in one of n1."""
    r = n2 / n1
    return math.exp(y * math.log(r) + math.lgamma(x + y + 1) - math.lgamma(x + 1) - math.lgamma(y + 1) - (x + y + 1) * math.log1p(r))


def compare_counts(df: DataFrame) -> DataFrame:
    """Adds ``fold`` (log2 of the ratio of rates, one half added), ``p`` (two-sided Fisher) and ``p_bonferroni`` to ``k, n1, n2``."""
    total = df.agg(F.sum("n1").alias("t1"), F.sum("n2").alias("t2"), F.count(F.lit(1)).alias("tests"))

    @F.pandas_udf("double")
    def p(n1: pd.Series, n2: pd.Series, t1: pd.Series, t2: pd.Series) -> pd.Series:
        memo: dict[tuple, float] = {}
        out = []
        for key in zip(n1.tolist(), n2.tolist(), t1.tolist(), t2.tolist(), strict=True):
            if key not in memo:
                a, b, s, t = key
                memo[key] = fisher(a, b, s - a, t - b)
            out.append(memo[key])
        return pd.Series(out)

    rows = df.crossJoin(F.broadcast(total)).withColumn("p", p("n1", "n2", "t1", "t2"))
    fold = F.log2((F.col("n2") + 0.5) / (F.col("t2") + 0.5)) - F.log2((F.col("n1") + 0.5) / (F.col("t1") + 0.5))
    return rows.select("k", "n1", "n2", fold.alias("fold"), "p", F.least(F.lit(1.0), F.col("p") * F.col("tests")).alias("p_bonferroni"))
