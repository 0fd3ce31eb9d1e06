"""Quotas, drawn samples, work orders and greedy choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.operators import running


def by_digest(key: Column, seed: str) -> Column:
    """A place in an order that looks random and is the same in every engine."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, place: str = "place", salts: int = 32) -> DataFrame:
    """`df` with `place`: the first n rows of each group in `order`.

    Two steps for any n: a group's rows are dealt out over `salts` parts by a hash of the row, each part keeps its first n, and only these, at most salts * n, meet.
    So a group that holds a third of all rows is ordered in many tasks. Null is a key like any other; equal rows in order and content stay apart.
    """
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts)).cast("int")
    inner = Window.partitionBy(*keys, "_part").orderBy(*order)
    kept = df.withColumn("_part", part).withColumn(place, F.row_number().over(inner)).filter(F.col(place) <= n).drop("_part", place)
    return kept.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(place) <= n)


def first_drawn(df: DataFrame, keys: Sequence[str], draw: str, n: str, size: str, tie: Sequence[str] = (), together: int = 20_000) -> DataFrame:
    """The first rows of each group in the order of `draw`, as many as its column `n` says.

    draw is a BIGINT that falls evenly over its range, such as a hash; n and size (the group's rows) are the same in all rows of a group. A large group is
    cut into buckets of about `together` rows along the draw. How many a bucket has says whether it is taken whole or not at all; only the
    one in which n falls is ordered. So no task orders a large group, whatever n.
    """
    keys = list(keys)
    bits = F.least(F.greatest(F.ceil(F.log2(F.greatest(F.col(size), F.lit(1)) / together)), F.lit(0)), F.lit(24)).cast("int")
    d = df.withColumn("_bits", bits).withColumn("_bucket", F.when(F.col("_bits") == 0, F.lit(0).cast("bigint")).otherwise(F.expr(f"shiftright(`{draw}`, 64 - _bits)"))).drop("_bits")
    counts = d.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_c"), F.max(n).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = counts.withColumn("_from", F.sum("_c").over(upto) - F.col("_c")).filter(F.col("_from") < F.col("_n"))
    state = state.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), "_from", (F.col("_from") + F.col("_c") <= F.col("_n")).alias("_whole"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_bucket") == F.col("_b")]
    placed = d.join(state, on).drop(*[f"_k{i}" for i in range(len(keys))], "_b")
    edge = placed.filter("NOT _whole").withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(draw, *tie)))
    return placed.filter("_whole").select(*df.columns).unionAll(edge.filter(F.col("_from") + F.col("_r") <= F.col(n)).select(*df.columns))


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """`df` with place: n rows of each stratum, or all of a smaller one, in drawn order."""
    return top_n(df, [stratum], [by_digest(F.col(key), seed), F.col(key)], n)


def first_per_cell(df: DataFrame, cell: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    return top_n(df, cell, order, n)


def largest_remainder(sizes: DataFrame, order: Column, n: str, places: int) -> DataFrame:
    """`sizes` (a few rows) with quota INT: places in proportion to n, those left over to the largest remainders, ties by `order`."""
    exact = F.lit(places) * F.col(n) / F.sum(n).over(Window.partitionBy())
    s = sizes.withColumn("_e", exact).withColumn("_f", F.floor("_e"))
    left = F.lit(places) - F.sum("_f").over(Window.partitionBy())
    turn = F.row_number().over(Window.orderBy(F.round(F.col("_e") - F.col("_f"), 9).desc(), order))
    return s.withColumn("quota", (F.col("_f") + (turn <= left).cast("int")).cast("int")).drop("_e", "_f")


def work_order(units: DataFrame, extractors: Sequence[str], band: str, key: Sequence[str]) -> DataFrame:
    """Each document for each extractor, in rounds: the first of every band for all extractors, then the second, and so on. Columns of units, extractor, round."""
    rounds = running.numbered(units, [band], key, "round")
    return rounds.withColumn("extractor", F.explode(F.array(*[F.lit(e) for e in extractors])))


def pending(units: DataFrame, done: DataFrame, extractors: Sequence[str], key: str) -> DataFrame:
    """extractor, `key` of the units that no journal has: the work matrix less what is done, each pair once."""
    matrix = units.select(key).distinct().withColumn("extractor", F.explode(F.array(*[F.lit(e) for e in extractors])))
    return matrix.join(done.select("extractor", key).distinct(), ["extractor", key], "left_anti").select("extractor", key)


def frontier(df: DataFrame, agrees: str, key: str, weight: str, sums: dict[str, Column], size: int) -> DataFrame:
    """k and the sums over the k lightest that agree and the size - k lightest that don't; a k that either side cannot fill has no row."""
    light = top_n(df, [agrees], [weight, key], size, "_place")
    ks = light.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(size))))
    took = ks.filter(F.when(F.col(agrees), F.col("_place") <= F.col("k")).otherwise(F.col("_place") <= size - F.col("k")))
    return took.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in sums.items()]).filter(F.col("n") == size)


def greedy(df: DataFrame, key: str, weight: str, band: str, plan: Sequence[tuple[str, int]], phenomena: Sequence[str]) -> DataFrame:
    """`key`, band, reason, place: bands in the plan's order, each with its number of places; a place goes to the first phenomenon (a boolean column) not yet
    covered that the band has a record of, else to the band's own; the lightest record wins, then the smallest key.

    Only the lightest records of each (band, phenomenon) can ever be chosen, as many as there are places in all, so only these meet in one task.
    """
    size = sum(n for _, n in plan)
    named = dict(plan)
    own = df.filter(F.col(band).isin(*named)).select(key, F.col(weight).alias("_w"), F.col(band).alias("_b"), *phenomena)
    kinds = F.array(F.lit(""), *[F.when(F.col(p), F.lit(p)) for p in phenomena])
    each = own.select("*", F.explode(F.array_compact(kinds)).alias("_k"))
    light = top_n(each, ["_b", "_k"], ["_w", key], size, "_r")
    few = light.select(key, "_w", "_b", *phenomena).distinct()
    kind = dict(df.dtypes)[key]

    def choose(parts):
        import pandas as pd

        got = list(parts)
        pdf = pd.concat(got, ignore_index=True) if got else pd.DataFrame(columns=[key, "_w", "_b", *phenomena])
        pdf = pdf.sort_values(["_w", key], kind="stable")
        for p in phenomena:
            pdf[p] = pdf[p].map(lambda v: v is True or v == 1).astype(bool)
        open_, taken, out = list(phenomena), set(), []
        for name, places in plan:
            inside = pdf[pdf["_b"] == name]
            for _ in range(places):
                free = inside[~inside[key].isin(taken)]
                reason = next((p for p in open_ if free[p].any()), None)
                pool = free if reason is None else free[free[reason]]
                if pool.empty:
                    continue
                if reason is not None:
                    open_.remove(reason)
                taken.add(pool.iloc[0][key])
                out.append((pool.iloc[0][key], name, f"fenómeno · {reason}" if reason else f"reparto · banda {name}", len(out) + 1))
        yield pd.DataFrame(out, columns=[key, "band", "reason", "place"])

    return few.coalesce(1).mapInPandas(choose, f"`{key}` {kind}, band string, reason string, place int")
