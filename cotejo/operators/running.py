"""Numbers, totals and gaps along one long order, without one long task.

Rows are dealt into ranges of the order, as many as the session has shuffle partitions, of about the same number of rows whatever the data's own
groups (a day, a band) hold. The ranges' totals are few and are summed up first, then each range goes on from its start. The
ranges are written once, since a second sampling of their bounds need not give the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.sources import cut


def in_ranges(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """`df` with _range INT, which never falls along the order, and _id BIGINT, which rises with every row of it. Nulls come first; rows that tie are in any, but one, order."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return cut(placed.withColumn("_range", F.shiftright("_id", 33).cast("int")), "ranges")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """`df` with `name` BIGINT: the row's place in its group, from 1."""
    r = in_ranges(df, [*keys, *order])
    per = r.groupBy("_range", *keys).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select(F.col("_range").alias("_of"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + 1 - F.col("_first")).alias("_shift"))
    on = [F.col("_range") == F.col("_of")] + [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return r.join(starts, on).select(*df.columns, (F.col("_id") + F.col("_shift")).alias(name))


def running_totals(df: DataFrame, order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """`df` with, for each name, the total of the column over this row and all before it in `order`."""
    v = in_ranges(df.withColumns({f"_v_{n}": value for n, value in values.items()}), order)
    per = v.groupBy("_range").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = per.select(F.col("_range").alias("_of"), *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_f_{n}") for n in values])
    within = Window.partitionBy("_range").orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = v.join(starts, F.col("_range") == F.col("_of"))
    return joined.select(*df.columns, *[(F.col(f"_f_{n}") + F.sum(f"_v_{n}").over(within)).alias(n) for n in values])


def gaps(df: DataFrame, at: str, order: Sequence[str]) -> DataFrame:
    """`df` with gap, the seconds since the row before in `order`, null for the first."""
    v = in_ranges(df, order)
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    last = v.groupBy("_range").agg(F.max_by(seconds, "_id").alias("_last"))
    before = last.select(F.col("_range").alias("_of"), F.lag("_last").over(Window.orderBy("_range")).alias("_prev"))  # a row per range
    first = F.row_number().over(Window.partitionBy("_range").orderBy("_id")) == 1
    earlier = F.when(first, F.col("_prev")).otherwise(F.lag(seconds).over(Window.partitionBy("_range").orderBy("_id")))
    return v.join(before, F.col("_range") == F.col("_of")).withColumn("gap", seconds - earlier).select(*df.columns, "gap")


def stop_point(totals: DataFrame, order: str, tried: str, spent: str, least: int = 20, share: float = 0.05) -> DataFrame:
    """The first row after which so many have been tried and more than `share` of them are spent; no row if there is none."""
    over = (F.col(tried) >= least) & (F.col(spent) / F.col(tried) > share)
    return totals.filter(over).orderBy(order).limit(1)


def until_target(totals: DataFrame, accepted: str, this: Column, target: int) -> DataFrame:
    """The rows up to the one with which the accepted ones (`this` of the row included in the total `accepted`) reach the target."""
    return totals.filter(F.col(accepted) - this < target)
