"""Rates, intervals and estimators."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the normal quantile of a 95 % interval.
Z = 1.96


def wilson(hits: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Ends of Wilson's interval, cut to [0, 1]; (0, 0) without trials."""
    m = F.nullif(n, F.lit(0))
    p, d = hits / m, 1 + z * z / m
    mid = (p + z * z / (2 * m)) / d
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / d
    cut = lambda x: F.when(n > 0, F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return cut(mid - half), cut(mid + half)


def ratios(df: DataFrame, keys: Sequence[str], over: str, under: str) -> DataFrame:
    """`keys`, ratio = sum(over) / sum(under), null where the sum below is 0; rows with a null on either side are left out."""
    return df.filter(F.col(over).isNotNull() & F.col(under).isNotNull()).groupBy(*keys).agg(F.try_divide(F.sum(over), F.sum(under)).alias("ratio"), F.count(F.lit(1)).alias("n"))


def slope(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """`keys`, n, slope of y on x by least squares: null under 3 points, 0 if all x are the same."""
    both = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
    s = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("_s"))
    return s.select(*keys, "n", F.when(F.col("n") >= 3, F.coalesce("_s", F.lit(0.0))).alias("slope"))


def estimator_error(predicted: Column, real: Column) -> tuple[Column, Column]:
    """The error of a forecast over the real value, and over the forecast."""
    return F.try_divide(predicted - real, real), F.try_divide(real - predicted, predicted)


def poisson_times(units: np.ndarray, replicas: int) -> np.ndarray:
    """How often each unit (a 64-bit hash) counts in replicas 1, 2, ...: Poisson(1) numbers that depend on unit and replica alone."""
    with np.errstate(over="ignore"):
        z = units[:, None] + np.arange(1, replicas + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    edges = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(edges, (z >> np.uint64(11)) / 2.0**53, side="right")


def bootstrap_ratio(df: DataFrame, stratum: str, unit: str, over: str, under: str, weights: DataFrame, weight: str, replicas: int = 1000, seed: int = 1) -> DataFrame:
    """total, low, high: sum over strata of weight * ratio, and its 95 % interval over resamples of units within their stratum.

    In every replica a unit counts a Poisson(1) number of times, drawn by hash of (unit, replica), which is what drawing with
    replacement amounts to for many units, and needs neither a collected stratum nor a second pass. A task adds up whole arrays of replicas, a sum per
    (stratum, replica) is all that it hands on; no row is repeated.
    """
    given = df.filter(F.col(over).isNotNull() & F.col(under).isNotNull())
    hashed = given.select(F.col(stratum).alias("k"), F.xxhash64(F.lit(seed), F.col(unit)).alias("u"), F.col(over).cast("double").alias("o"), F.col(under).cast("double").alias("d"))
    kind = dict(df.dtypes)[stratum]

    def sums(parts):
        held: dict = {}
        for pdf in parts:
            for name, group in pdf.groupby("k", dropna=False):
                own = held.setdefault(None if pd.isna(name) else name, np.zeros((2, replicas + 1)))
                values = group[["o", "d"]].to_numpy(float)
                own[:, 0] += values.sum(0)
                units = group["u"].to_numpy(np.int64).view(np.uint64)
                for i in range(0, len(units), 256):
                    own[:, 1:] += values[i : i + 256].T @ poisson_times(units[i : i + 256], replicas)
        for name, own in held.items():
            yield pd.DataFrame({"k": [name] * (replicas + 1), "replica": np.arange(replicas + 1), "o": own[0], "d": own[1]})

    drawn = hashed.mapInPandas(sums, f"k {kind}, replica int, o double, d double")
    per = drawn.groupBy(F.col("k").alias(stratum), "replica").agg((F.sum("o") / F.nullif(F.sum("d"), F.lit(0.0))).alias("_r"))
    totals = per.join(weights, stratum).groupBy("replica").agg(F.sum(F.col("_r") * F.col(weight)).alias("t"))
    ends = F.expr(f"percentile(CASE WHEN replica > 0 THEN t END, array({(int(0.025 * replicas)) / (replicas - 1)}, {(int(0.975 * replicas) - 1) / (replicas - 1)}))")
    return totals.agg(F.max(F.when(F.col("replica") == 0, F.col("t"))).alias("total"), ends.alias("_e")).select("total", F.col("_e")[0].alias("low"), F.col("_e")[1].alias("high"))


def series_verdict(within: Column) -> Column:
    """Over a group's runs: `pasa` if all are within the limit, `no pasa` if none is, else `no concluye`."""
    return F.when(F.bool_and(within), "pasa").when(~F.bool_or(within), "no pasa").otherwise("no concluye")
