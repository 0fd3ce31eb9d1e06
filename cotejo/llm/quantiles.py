"""Percentiles with a bound on the relative error, from sketches that can be added up.

A value x falls into bucket ceil(ln|x| / ln g), g = (1 + alpha) / (1 - alpha), kept apart by sign. The
middle 2 g^i / (g + 1) of bucket i is within alpha * |x| of each x in it, so the value given for a
percentile is within alpha of the nearest-rank one. A sketch is a table of bucket counts: sketches of
files, days or partitions are combined by adding the counts of equal buckets, which loses nothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.sources import cut

ALPHA = 0.01


def growth(alpha: float) -> float:
    """Ratio of a bucket's ends."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must be in (0, 1)")
    return (1 + alpha) / (1 - alpha)


def bucket(x: Column, alpha: float = ALPHA) -> Column:
    """Bucket of a value, without its sign; 0 for zero."""
    return F.when(x == 0, 0).otherwise(F.ceil(F.log(F.abs(x)) / math.log(growth(alpha)))).cast("int")


def measured(df: DataFrame, value: str) -> DataFrame:
    """The rows that have a finite number."""
    x = F.col(value).cast("double")
    return df.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def sketch(df: DataFrame, keys: Sequence[str], value: str, alpha: float = ALPHA) -> DataFrame:
    """Counts by `keys`, sign TINYINT and bucket INT: n BIGINT.

    Null, NaN and infinite values are no measurements and leave no trace; negative ones count on their side. A null
    key is a group of its own. An empty table gives an empty sketch. Map tasks add up buckets before
    the shuffle, and a group has at most about 2 * 1420 / ln(g) of them whatever its rows, so a
    group that holds a third of all rows costs no more than another.
    """
    x = F.col(value).cast("double")
    return measured(df, value).groupBy(*keys, F.signum(x).cast("tinyint").alias("sign"), bucket(x, alpha).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One sketch of all the rows behind several, which must have the same alpha."""
    columns = [*keys, "sign", "bucket", "n"]
    whole = sketches[0].select(*columns)
    for s in sketches[1:]:
        whole = whole.unionAll(s.select(*columns))
    return whole.groupBy(*keys, "sign", "bucket").agg(F.sum("n").alias("n"))


def rank(percent: Column, n: Column) -> Column:
    """Nearest rank of a percentile among n values."""
    return F.greatest(F.lit(1), F.ceil(percent * n / 100 - F.lit(1e-9)))


def located(sk: DataFrame, keys: Sequence[str], percents: Column) -> DataFrame:
    """The bucket of each percentile: the sketch's columns, percent, rank and rows. percents: an array column."""
    group = Window.partitionBy(*keys)
    upto = group.orderBy("sign", F.col("sign") * F.col("bucket")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = sk.select("*", F.sum("n").over(upto).alias("_to"), F.sum("n").over(group).alias("rows"))
    each = counted.select("*", F.explode(percents).alias("percent")).withColumn("rank", rank(F.col("percent"), F.col("rows")))
    return each.filter((F.col("_to") >= F.col("rank")) & (F.col("_to") - F.col("n") < F.col("rank")))


def percentiles(sk: DataFrame, keys: Sequence[str], percents: Sequence[float], alpha: float = ALPHA) -> DataFrame:
    """`keys`, percent DOUBLE, rows BIGINT, value DOUBLE: within alpha * |true value| of the true one."""
    g = growth(alpha)
    at = located(sk, keys, F.array(*[F.lit(float(p)) for p in percents]))
    value = F.col("sign") * F.pow(F.lit(g), F.col("bucket")) * (2 / (g + 1))
    return at.select(*keys, "percent", "rows", F.when(F.col("sign") == 0, 0.0).otherwise(value).alias("value"))


def compared(sk: DataFrame, keys: Sequence[str], limits: DataFrame, on: Sequence[str], limit: str, percent: str, alpha: float = ALPHA) -> DataFrame:
    """What a sketch says of a percentile and a limit: `keys`, limit, percent, rank BIGINT, above BOOLEAN.

    limits has a limit and a percent for each value of its columns `on`, which are among the keys. above is null where the limit lies inside the percentile's bucket, which
    is where the sketch cannot tell. A group without values has no row, a null limit or percent is no limit.
    """
    g = math.log(growth(alpha))
    given = limits.select(*on, F.col(limit).alias("_limit"), F.col(percent).alias("_percent")).distinct().filter("_limit IS NOT NULL AND _percent IS NOT NULL")
    at = located(sk.join(given, list(on)), [*keys, "_limit", "_percent"], F.array(F.col("_percent").cast("double")))
    outer, inner = F.exp(F.col("bucket") * g), F.exp((F.col("bucket") - 1) * g)
    low = F.when(F.col("sign") > 0, inner).when(F.col("sign") < 0, -outer).otherwise(0.0)
    high = F.when(F.col("sign") > 0, outer).when(F.col("sign") < 0, -inner).otherwise(0.0)
    slack = F.abs(F.col("_limit")) * 1e-9
    told = F.when(low - slack > F.col("_limit"), True).when(high + slack < F.col("_limit"), False)
    return at.select(*keys, F.col("_limit").alias(limit), F.col("_percent").alias(percent), "rank", told.alias("above"))


def above(df: DataFrame, keys: Sequence[str], value: str, limits: DataFrame, on: Sequence[str], limit: str, percent: str, alpha: float = ALPHA) -> DataFrame:
    """The groups whose percentile lies above a limit: `keys` (see compared for limits).

    The sketch decides. Only groups whose limit it cannot tell from the percentile are gone through a second time, and there the number of values up to the limit
    decides, so the answer is that of the nearest-rank percentile. `df` is read twice; write it first if it is dear. A group without values, or with a null limit, is not above.
    """
    seen = cut(compared(sketch(df, keys, value, alpha), keys, limits, on, limit, percent, alpha), "compared")
    narrow = seen.filter("above IS NULL").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(limit).alias("_limit"), F.col(percent).alias("_percent"), F.col("rank").alias("_rank"))
    # A value of a group in doubt is looked up among few groups; null keys are groups too.
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    counts = measured(df, value).join(narrow, same).groupBy(*keys, "_limit", "_percent", "_rank").agg(F.count_if(F.col(value) <= F.col("_limit")).alias("_up_to"))
    return seen.filter("above").select(*keys).unionAll(counts.filter("_up_to < _rank").select(*keys))
