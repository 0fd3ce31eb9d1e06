"""Aggregation by keys of which a few hold most rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How the partial results of one key are merged.
MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Heavy:
    """Keys that may hold at least `share` of `rows`: a superset, of at most `capacity` keys."""

    keys: tuple
    rows: int


def heavy_keys(df: DataFrame, key: str, share: float, capacity: int = 4096) -> Heavy:
    """heavy_keys_of for one column."""
    return heavy_keys_of(df, [key], share, capacity)[0]


def heavy_keys_of(df: DataFrame, keys: Sequence[str], share: float, capacity: int = 4096) -> list[Heavy]:
    """Candidates for heavy keys of each column, from frequent-items sketches over the whole columns, all in one pass.

    The sketch follows at most `capacity` keys and never counts a key too high by more than
    rows/(0.75*capacity), nor too low; whatever reaches `share` of the rows is therefore among
    its first 1/share + 1 keys if capacity is well above 1/share, which is enforced. Null is no
    key but counts as a row. An empty table has no heavy keys.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    if capacity < 16 / share:
        raise ValueError("capacity must be at least 16/share")
    most = min(int(1 / share) * 2 + 2, capacity)
    plain = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    *tops, rows = plain.agg(*[F.expr(f"approx_top_k(k{i}, {most}, {capacity})").alias(f"top{i}") for i in range(len(keys))], F.count(F.lit(1)).alias("n")).first()
    slack = rows / (0.75 * capacity)
    return [Heavy(tuple(x["item"] for x in top or [] if x["item"] is not None and x["count"] + slack >= share * rows), rows) for top in tops]


def _among(key: Column, heavy: Heavy) -> Column:
    return F.coalesce(key.isin(list(heavy.keys)), F.lit(False)) if heavy.keys else F.lit(False)


def _salt(salted: Column, salts: int) -> Column:
    return F.when(salted, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).otherwise(F.lit(0))


def salted_aggregate(
    df: DataFrame, keys: Sequence[str], aggs: Sequence[tuple[str, str, str | None]], heavy: Heavy | None = None, salts: int = 64
) -> DataFrame:
    """Aggregates per key in two stages: per (key, salt), then per key.

    `aggs` holds (name, function, column), function one of count, sum, min, max; count with the
    column None counts rows. Rows whose first key is heavy are dealt out over `salts` partial
    groups in turn, all other rows have salt 0; without `heavy` every row is salted. Each row is
    counted exactly once, the salt depends on a row's place in its input split alone and so is the
    same when a task is run again. Null keys form a group. An empty table gives no rows.
    """
    if unknown := {f for _, f, _ in aggs} - MERGE.keys():
        raise ValueError(f"no merge for {sorted(unknown)}")
    salt = _salt(F.lit(True) if heavy is None else _among(F.col(keys[0]), heavy), salts)
    plain = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], salt.alias("_salt"), *[(F.lit(1) if c is None else F.col(c)).alias(f"_v{i}") for i, (_, _, c) in enumerate(aggs)])
    ks = [f"_k{i}" for i in range(len(keys))]
    partial = plain.groupBy(*ks, "_salt").agg(*[getattr(F, f)(f"_v{i}").alias(f"_a{i}") for i, (_, f, _) in enumerate(aggs)])
    merged = partial.groupBy(*ks).agg(*[MERGE[f](f"_a{i}").alias(f"_a{i}") for i, (_, f, _) in enumerate(aggs)])
    return merged.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *[F.col(f"_a{i}").alias(n) for i, (n, _, _) in enumerate(aggs)])


def salted_distinct(df: DataFrame, keys: Sequence[str], columns: Sequence[str], salts: int = 64) -> DataFrame:
    """`keys`, and for each column the number of its different values, null left out: an aggregate whose partial results can't be added up.

    A key's values are told apart first, each value of a key where its hash lies, so a heavy key is spread by what it holds; then they are counted by (key, part of the
    hash), and these counts are few. Null keys form a group. A key all of whose values are null has 0. An empty table gives no rows.
    """
    ks = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    each = df.select(*ks, F.inline(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("string").alias("_v")) for i, c in enumerate(columns)]))).distinct()
    parts = each.groupBy(*names, F.pmod(F.xxhash64("_c", "_v"), F.lit(salts)).alias("_salt")).agg(*[F.count_if((F.col("_c") == i) & F.col("_v").isNotNull()).alias(f"_a{i}") for i in range(len(columns))])
    merged = parts.groupBy(*names).agg(*[F.sum(f"_a{i}").alias(f"_a{i}") for i in range(len(columns))])
    return merged.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], *[F.col(f"_a{i}").alias(c) for i, c in enumerate(columns)])


def salted_join(big: DataFrame, small: DataFrame, key: str, heavy: Heavy, salts: int = 64, how: str = "inner") -> DataFrame:
    """`big` joined with `small` on `key`: columns of big, then the others of small. how: inner or left.

    A heavy key's rows of big are dealt out over `salts` tasks in turn, its rows of small are there in each of them; all other keys are joined as they are. Give as small the side that
    has few rows for the heavy keys. Null keys join nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    rest = [c for c in small.columns if c != key]
    spread = F.when(_among(F.col(key), heavy), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = small.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_r{i}") for i, c in enumerate(rest)], F.explode(spread).alias("_part"))
    left = big.select(*[F.col(c).alias(f"_l{i}") for i, c in enumerate(big.columns)], F.col(key).alias("_own"), _salt(_among(F.col(key), heavy), salts).alias("_salt"))
    joined = left.join(right, (F.col("_own") == F.col("_key")) & (F.col("_salt") == F.col("_part")), how)
    return joined.select(*[F.col(f"_l{i}").alias(c) for i, c in enumerate(big.columns)], *[F.col(f"_r{i}").alias(c) for i, c in enumerate(rest)])


def shares_at_least(df: DataFrame, keys: Sequence[str], share: float, salts: int = 64) -> DataFrame:
    """The values of each column that at least `share` of all rows hold: field STRING, value STRING, n BIGINT, exact.

    Two passes for any number of columns: the sketches, then the counts, a row of which is counted once for each column. Null is no
    key, but rows with a null key count as rows.
    """
    found = heavy_keys_of(df, keys, share, max(4096, int(16 / share) + 1))
    pairs = [F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias("value"), _among(F.col(k), h).alias("_heavy")) for k, h in zip(keys, found, strict=True)]
    each = df.select(F.inline(F.array(*pairs))).filter("value IS NOT NULL")
    partial = each.groupBy("field", "value", _salt(F.col("_heavy"), salts).alias("_salt")).agg(F.count(F.lit(1)).alias("n"))
    counts = partial.groupBy("field", "value").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= F.lit(share) * F.lit(float(found[0].rows)))
