"""A sample whose shares follow given proportions, by the cube method.

Every record starts with an inclusion probability: its category's target divided by the records there.
Flight: the probabilities of a few records at a time are moved along a direction that leaves all
balancing totals as they are, until one of them is 0 or 1; each task does so for its own records and
leaves no more unresolved ones than there are categories. These go up to fewer tasks, level
by level, until one task has the last of them, at most one a category; there the variables are given up one after another (landing).
Records of one category have the same balancing row. Many of them with one probability fly at once: of a batch's n records, in an order drawn at random, the first
floor(n p) are chosen, the next one keeps what is left of n p, and the others are out; that keeps every record's expectation p.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.sources import cut

#: Unresolved records of so many tasks meet in one task of the next level.
FAN = 64
_EPS = 1e-9


def move(pi: np.ndarray, direction: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One step of the flight: along or against `direction` as far as [0, 1] allows, with the
    probabilities that keep the expectation."""
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(direction > 0, (1 - pi) / direction, np.where(direction < 0, -pi / direction, np.inf)).min()
        down = np.where(direction > 0, pi / direction, np.where(direction < 0, (pi - 1) / direction, np.inf)).min()
    pi = pi + up * direction if rng.random() * (up + down) < down else pi - down * direction
    return np.where(pi < _EPS, 0.0, np.where(pi > 1 - _EPS, 1.0, pi))


def flight(pi: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight over a few records: rows has a balancing row per record. Ends with at most as many
    unresolved records as the rank of the rows."""
    pi = pi.astype(float).copy()
    while True:
        open_ = np.flatnonzero((pi > 0) & (pi < 1))[: rows.shape[1] + 1]
        if not len(open_):
            return pi
        _, s, v = np.linalg.svd(rows[open_].T, full_matrices=True)
        if (s > 1e-10).sum() >= len(open_):
            return pi
        pi[open_] = move(pi[open_], v[-1], rng)


#: Records whose balancing rows are looked at together in the landing.
BLOCK = 64


def _one_hot(codes: np.ndarray) -> np.ndarray:
    return np.hstack([(c[:, None] == np.unique(c)[None, :]).astype(float) for c in codes.T])


def _pairs(pi: np.ndarray, groups: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flights of two records of one group at a time, until each group has at most one open record. Its total stays."""
    out = pi.copy()
    open_ = np.flatnonzero((pi > 0) & (pi < 1))
    held: dict[int, tuple[int, float]] = {}  # a group's open record and its probability
    for i, g, b, draw in zip(open_.tolist(), groups[open_].tolist(), pi[open_].tolist(), rng.random(len(open_)).tolist(), strict=True):
        if g not in held:
            held[g] = (i, b)
            continue
        j, a = held.pop(g)
        out[j], out[i] = a, b = _pair(a, b, draw)
        if 0 < b < 1:
            held[g] = (i, b)
        elif 0 < a < 1:
            held[g] = (j, a)
    return out


def _pair(a: float, b: float, draw: float) -> tuple[float, float]:
    up, down = min(1 - a, b), min(a, 1 - b)
    a, b = (a + up, b - up) if draw * (up + down) < down else (a - down, b + down)
    end = lambda x: 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x
    return end(a), end(b)


def land(pi: np.ndarray, attributes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Resolves the last open records, given the codes of their attributes (a column each).

    First all attributes' totals are kept, by flights over blocks of neighbours in the attributes' order, over and over while that resolves any; then one attribute after
    the other is kept alone, then the number in all; what is left at last is drawn by its probability. Blocks are of one size whatever the number of records.
    """
    pi = pi.copy()
    while True:
        open_ = np.flatnonzero((pi > 0) & (pi < 1))
        if not len(open_):
            return pi
        open_ = open_[np.lexsort(attributes[open_].T[::-1])]
        for i in range(0, len(open_), BLOCK):
            at = open_[i : i + BLOCK]
            pi[at] = flight(pi[at], _one_hot(attributes[at]), rng)
        if ((pi > 0) & (pi < 1)).sum() == len(open_):
            break
    for codes in [*attributes.T, np.zeros(len(pi), dtype=int)]:
        pi = _pairs(pi, codes, rng)
    open_ = (pi > 0) & (pi < 1)
    return np.where(open_, (rng.random(len(pi)) < pi).astype(float), pi)


def batch_flight(pi: np.ndarray, cells: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight within each category of a batch; leaves at most one open record of each."""
    out = np.where(pi >= 1 - _EPS, 1.0, np.where(pi <= _EPS, 0.0, pi))
    open_ = rng.permutation(np.flatnonzero((out > 0) & (out < 1)))
    open_ = open_[np.argsort(cells[open_], kind="stable")]
    if not len(open_):
        return out
    p, first = out[open_], np.flatnonzero(np.r_[True, np.diff(cells[open_]) != 0])
    size = np.diff(np.r_[first, len(open_)])
    even = np.maximum.reduceat(p, first) - np.minimum.reduceat(p, first) < 1e-12
    total = size * p[first]
    whole = np.floor(total + _EPS)
    rest = np.where(total - whole > _EPS, total - whole, 0.0)
    place = np.arange(len(open_)) - np.repeat(first, size)
    moved = np.where(place < np.repeat(whole, size), 1.0, np.where(place == np.repeat(whole, size), np.repeat(rest, size), 0.0))
    out[open_] = np.where(np.repeat(even, size), moved, p)
    if not even.all():  # open records of earlier levels
        out = _pairs(out, cells, rng)
    return out


def _flights(df: DataFrame, cell: str, by: Sequence[str], seed: int, level: int, last: bool) -> DataFrame:
    """Flight in every task of `df` (columns: the record's, `cell` BIGINT, pi DOUBLE). Gives back the records that are chosen (pi 1) or open,
    with the task's number in _task. A task keeps one open record of each category, whatever its number of rows."""

    def run(parts):
        task = TaskContext.get().partitionId()
        rng = np.random.default_rng([seed, level, task])
        held = None  # the open record of each category so far
        for pdf in parts:
            fresh = batch_flight(pdf["pi"].to_numpy(float), pdf[cell].to_numpy(), rng)
            both = pdf.assign(pi=fresh)[fresh > 0]
            if held is not None and len(held):
                both = pd.concat([held, both], ignore_index=True)
                both["pi"] = _pairs(both["pi"].to_numpy(float), both[cell].to_numpy(), rng)
            pi = both["pi"].to_numpy(float)
            if (pi == 1).any():
                yield both[pi == 1].assign(_task=task)
            held = both[(pi > 0) & (pi < 1)]
        if held is not None and len(held):
            rest = held.reset_index(drop=True)
            if last:
                codes = np.stack([pd.factorize(rest[b], use_na_sentinel=False)[0] for b in by], axis=1) if by else np.zeros((len(rest), 0), dtype=int)
                rest["pi"] = land(rest["pi"].to_numpy(float), codes, rng)
            rest = rest.assign(_task=task)
            yield rest[rest["pi"] > 0]

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInPandas(run, f"{schema}, _task int")


def cube_sample(df: DataFrame, cell: str, pi: str, by: Sequence[str], seed: int = 11) -> DataFrame:
    """The chosen rows of `df`, without `pi`.

    `cell` BIGINT numbers the categories, `pi` is the inclusion probability, the same within a
    category; `by` are the attributes that make up a category, which the landing balances on. The number drawn from
    a category differs from its target by less than 1. Rows with a null category or probability
    are never drawn. Each level is written to the shared folder before the next, so a random
    draw is never made twice. An empty table gives no rows.
    """
    names = [c for c in df.columns if c != pi]
    inner = [f"c{i}" for i in range(len(names))]  # whatever the columns are called, they don't clash with pi and _task
    cell, by = inner[names.index(cell)], [inner[names.index(b)] for b in by]
    open_ = df.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, inner, strict=True)], F.col(pi).cast("double").alias("pi"))
    open_ = open_.filter(F.col(cell).isNotNull() & F.col("pi").isNotNull() & ~F.isnan("pi"))
    columns, chosen, level, last = open_.columns, [], 0, False
    while True:
        done = cut(_flights(open_, cell, by, seed, level, last), "flight")
        chosen.append(done.filter(F.col("pi") == 1).select(*columns))
        if last:
            break
        tasks = (done.agg(F.max("_task")).first()[0] or 0) + 1
        groups = -(-tasks // FAN)
        left = done.filter(F.col("pi") < 1).select(*columns, "_task")
        last = groups == 1
        open_ = (left.coalesce(1) if last else left.repartition(groups, F.floor(F.col("_task") / FAN))).drop("_task")
        level += 1
    out = chosen[0]
    for c in chosen[1:]:
        out = out.unionAll(c)
    return out.select(*[F.col(c).alias(n) for n, c in zip(names, inner, strict=True)])


def quota_sample(records: DataFrame, by: Sequence[str], quotas: DataFrame, share: str, least: str, size: float, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """A sample by quotas, and the report on it.

    quotas has a row per category: the columns `by`, a share and a least number. A category's target is the larger
    of least and share * size (the largest, if it is listed twice), or all its records if there are fewer. The sample has the columns of `records`. The report has a row per
    category: `by`, available BIGINT, wanted DOUBLE (before the limit), drawn BIGINT, short BOOLEAN (fewer records than wanted), off DOUBLE
    (drawn less wanted). Records of no category (nulls too) are not drawn; a category without records is short
    unless it wants nothing. Quotas are joined, never collected: there may be as many as a task can hold one record of each (some hundred thousand a GB), which is
    what the last level of the cube needs.
    """
    wanted = F.greatest(F.coalesce(F.col(least).cast("double"), F.lit(0.0)), F.coalesce(F.col(share).cast("double"), F.lit(0.0)) * F.lit(float(size)))
    on = [F.col(f"q.{b}") == F.col(f"r.{b}") for b in by]
    targets = quotas.select(*by, wanted.alias("_wanted")).groupBy(*by).agg(F.max("_wanted").alias("_wanted"))
    counts = records.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    cells = targets.alias("q").join(counts.alias("r"), on, "left").select(*[F.col(f"q.{b}") for b in by], "_wanted", F.coalesce("_n", F.lit(0)).alias("_available"))
    pi = F.when(F.col("_available") > 0, F.least(F.lit(1.0), F.col("_wanted") / F.col("_available"))).otherwise(0.0)
    cells = cut(cells.withColumn("_pi", pi).withColumn("_cell", F.monotonically_increasing_id()), "quotas")
    numbered = cells.filter("_pi > 0").select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_cell").alias("_cube_cell"), F.col("_pi").alias("_cube_pi"))
    joined = records.join(numbered, [F.col(f"`{b}`") == F.col(f"_by{i}") for i, b in enumerate(by)]).drop(*[f"_by{i}" for i in range(len(by))])
    drawn = cube_sample(joined, "_cube_cell", "_cube_pi", by, seed)
    sample = drawn.drop("_cube_cell")
    got = drawn.withColumnRenamed("_cube_cell", "_cell").groupBy("_cell").agg(F.count(F.lit(1)).alias("_got"))
    drawn_n = F.coalesce("_got", F.lit(0)).cast("bigint")
    report = cells.join(got, "_cell", "left").select(
        *by, F.col("_available").alias("available"), F.col("_wanted").alias("wanted"), drawn_n.alias("drawn"),
        (F.col("_available") < F.col("_wanted")).alias("short"), (drawn_n - F.col("_wanted")).alias("off"),
    )
    return sample, report
