"""Differences between two copies of one dataset.

EXCEPT ALL in both directions is one signed count per distinct row, so it costs one shuffle and
cannot be upset by repeated rows; what is left over on either side (the residue) is joined by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ONLY_LEFT, ONLY_RIGHT, REPEATED = "only_left", "only_right", "repeated_key"


def latest(df: DataFrame, keys: Sequence[str], by: str, fields: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest `by`.

    A null `by` loses against any other. Of rows that tie on `by`, the one with the greatest
    `fields` (compared from left to right, null smallest) stays, so the result is the same in every run. Null is
    a key like any other. An aggregation, not a window: each map task keeps one row per key, so
    a key that holds a third of all rows never meets in one task.
    """
    best = F.max(F.struct(F.col(by), *[F.col(f) for f in fields])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_best")[f].alias(f) for f in fields])


def residue(left: DataFrame, right: DataFrame, cols: Sequence[str], keys: Sequence[str] | None = None) -> DataFrame:
    """EXCEPT ALL in both directions: rows of `cols` with `_n` surplus copies, positive where
    `left` has more of them and negative where `right` has.

    With `keys`, rows are laid out by key once and the counting needs no further shuffle; give
    them only where a key has few rows.
    """
    both = left.select(*cols, F.lit(1).alias("_n")).unionAll(right.select(*cols, F.lit(-1).alias("_n")))
    if keys:
        both = both.repartition(*keys)
    return both.groupBy(*cols).agg(F.sum("_n").alias("_n")).filter(F.col("_n") != 0)


def diff(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str], unique_keys: bool = False) -> DataFrame:
    """Differences of two copies, field by field.

    Result: `keys`, field STRING, left_value STRING, right_value STRING, n_left BIGINT,
    n_right BIGINT (rows left over for the key). field is the name of a field that differs,
    `only_left` or `only_right` for a key that one copy lacks, or `repeated_key` where a copy
    has several left-over rows for the key, for which no pairing is defined. Null equals null
    and differs from any value, in keys as in fields. Columns other than keys and fields are not
    looked at, whatever their names. Equal copies, also two empty ones, give no row.

    `unique_keys` says that neither copy repeats a key, which saves a shuffle.
    """
    cols = [*keys, *fields]
    left, right = left.select(*cols), right.select(*cols)
    rest = residue(left, right, cols, keys if unique_keys else None)
    # The full join of the two residues by key: both have the same layout, so one grouping puts them side by side.
    here, there = F.col("_n") > 0, F.col("_n") < 0
    row = F.struct(*[F.col(f) for f in fields])
    joined = rest.groupBy(*keys).agg(
        F.sum(F.when(here, F.col("_n")).otherwise(0)).alias("n_left"), F.sum(F.when(there, -F.col("_n")).otherwise(0)).alias("n_right"),
        F.max(F.when(here, row)).alias("_l"), F.max(F.when(there, row)).alias("_r"),
    )
    n_left, n_right = F.col("n_left"), F.col("n_right")

    def report(name: str, lv: Column, rv: Column) -> Column:
        return F.struct(F.lit(name).alias("field"), lv.cast("string").alias("left_value"), rv.cast("string").alias("right_value"))

    nothing = F.lit(None)
    per_field = [
        F.when(~F.col("_l")[f].eqNullSafe(F.col("_r")[f]), report(f, F.col("_l")[f], F.col("_r")[f])) for f in fields
    ]
    found = (
        F.when(n_right == 0, F.array(report(ONLY_LEFT, nothing, nothing)))
        .when(n_left == 0, F.array(report(ONLY_RIGHT, nothing, nothing)))
        .when((n_left > 1) | (n_right > 1), F.array(report(REPEATED, nothing, nothing)))
        .otherwise(F.array_compact(F.array(*per_field)))
    )
    return joined.select(*keys, "n_left", "n_right", F.explode(found).alias("_d")).select(
        *keys, "_d.field", "_d.left_value", "_d.right_value", "n_left", "n_right"
    )
