"""Exact order statistics of groups of any size.

Values are counted in coarse buckets first, which says in which bucket a rank falls; only the rows of those buckets are ordered. So no
task sorts a whole group, unless most of its values are all but the same.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _coarse(x: Column) -> Column:
    """A bucket number that never falls as x rises: about 90 buckets to a factor of e."""
    b = F.floor(F.log1p(F.abs(x)) * 90).cast("int")
    return F.when(x < 0, -b - 1).otherwise(b)


def nth(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """`keys`, n, and for each name the value of that rank (from 1, a function of the group's n), null where the group has no such rank.

    Null and NaN are no values. Equal values are counted together, so repeated ones cost nothing. Groups without values have no row.
    """
    keys = list(keys)
    x = F.col(value).cast("double")
    v = df.filter(x.isNotNull() & ~F.isnan(x)).groupBy(*keys, x.alias("_x")).agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", _coarse(F.col("_x")))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = v.groupBy(*keys, "_b").agg(F.sum("_c").alias("_s")).withColumn("_n", F.sum("_s").over(whole)).withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("_n")).cast("bigint").alias("rank")) for name, rank in ranks.items()])
    at = per.select("*", F.inline(wanted)).filter((F.col("rank") > F.col("_before")) & (F.col("rank") <= F.col("_before") + F.col("_s")))
    on = [F.col(f"v.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys] + [F.col("v._b") == F.col("a._b")]
    near = v.alias("v").join(at.alias("a"), on).select(*[F.col(f"v.{k}") for k in keys], F.col("v._x"), F.col("v._c"), F.col("a._n"), F.col("a.name"), F.col("a.rank"), F.col("a._before"))
    upto = Window.partitionBy(*keys, "name").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = near.withColumn("_to", F.col("_before") + F.sum("_c").over(upto)).filter((F.col("_to") >= F.col("rank")) & (F.col("_to") - F.col("_c") < F.col("rank")))
    picks = [F.max(F.when(F.col("name") == name, F.col("_x"))).alias(name) for name in ranks]
    found = placed.groupBy(*keys).agg(*picks)
    sizes = per.groupBy(*keys).agg(F.max("_n").alias("n"))
    on = [F.col(f"s.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    return sizes.alias("s").join(found.alias("f"), on or F.lit(True), "left").select(*[F.col(f"s.{k}") for k in keys], "s.n", *[F.col(f"f.{name}") for name in ranks])


def quartiles(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """`keys`, n, q1, q2, q3 by the exclusive method (positions i (n + 1) / 4, between neighbours by share); null below 2 values."""
    low = lambda i: lambda n: F.least(F.greatest(F.floor(i * (n + 1) / 4), F.lit(1)), n - 1)
    high = lambda i: lambda n: F.least(F.greatest(F.floor(i * (n + 1) / 4), F.lit(1)), n - 1) + 1
    got = nth(df, keys, value, {f"{side}{i}": f(i) for i in (1, 2, 3) for side, f in (("l", low), ("h", high))})
    out = []
    for i in (1, 2, 3):
        share = i * (F.col("n") + 1) / 4 - low(i)(F.col("n"))
        out.append(F.when(F.col("n") > 1, F.col(f"l{i}") + share * (F.col(f"h{i}") - F.col(f"l{i}"))).alias(f"q{i}"))
    return got.select(*keys, "n", *out)


#: Ranks: the value at index int(.9 n) of the sorted values counted from 0, and the upper of the two middle ones.
P90: Callable[[Column], Column] = lambda n: F.least(F.floor(n * 9 / 10) + 1, n)
UPPER_MEDIAN: Callable[[Column], Column] = lambda n: F.floor(n / 2) + 1
LOWER_MEDIAN: Callable[[Column], Column] = lambda n: F.ceil(n / 2)


def median_of(got: DataFrame) -> Column:
    """The mean of the two middle values, from columns lo (LOWER_MEDIAN) and up (UPPER_MEDIAN)."""
    return (F.col("lo") + F.col("up")) / 2
