import os
import random
import re

import pytest
from pyspark.sql import functions as F

from cotejo.functions import teds
from cotejo.operators import grid, scoring
from cotejo.plans import campaign
from cotejo.sources import tables
from tests.oracle import ROOT

CELL = "struct<cell_idx:int,row:int,col:int,rowspan:int,colspan:int,text:string,is_header:boolean>"
TABLE = f"struct<n_rows:int,n_cols:int,cells:array<{CELL}>>"
has_tables = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


def some_table(rng):
    n, m = rng.randint(0, 3), rng.randint(1, 3)
    cells = [(i, rng.randint(-1, 3), rng.randint(0, 3), rng.randint(0, 2), rng.randint(1, 3), rng.choice(["a", "b", "", None]), False) for i in range(rng.randint(0, 4))]
    return n, m, cells


def by_hand(a, b):
    grids = []
    for n, m, cells in (a, b):
        at = {}
        for _, row, col, high, wide, text, _ in cells:
            for r in range(max(row, 0), min(row + high, n)):
                for c in range(max(col, 0), min(col + wide, m)):
                    at[r, c] = ((r, c) == (row, col), text)
        grids.append(at)
    out = {(None, None, "DIMENSION")} if a[:2] != b[:2] else set()
    for p in {*grids[0], *grids[1]}:
        x, y = (g.get(p, (None, None)) for g in grids)
        if x[0] != y[0]:
            out.add((*p, "ESTADO"))
        elif x[0] and x[1] != y[1]:
            out.add((*p, "TEXTO"))
    return out


def test_compare_tables_by_hand(spark):
    rng = random.Random(5)
    pairs = [(i, some_table(rng), some_table(rng)) for i in range(400)] + [(400, (2, 2, []), None)]
    d = spark.createDataFrame(pairs, f"t int, a {TABLE}, b {TABLE}").repartition(3)
    got = {}
    for r in grid.compare_tables(d, "a", "b", ["t"], ["text"]).collect():
        assert (r.r, r.c, r.kind) not in got.setdefault(r.t, set())
        got[r.t].add((r.r, r.c, r.kind))
    assert got == {i: found for i, a, b in pairs[:-1] if (found := by_hand(a, b))}


def test_paired_by_place(spark):
    d = spark.createDataFrame([(1, ["a", "b"], ["c", "d"]), (2, ["a"], ["c", "d"]), (3, ["a"], None), (4, [], [])], "doc int, g array<string>, p array<string>")
    assert sorted(tuple(r) for r in scoring.paired(d, "g", "p").collect()) == [(1, 0, "a", "c"), (1, 1, "b", "d")]


@has_tables
def test_documents_are_the_campaign(spark):
    """The pairs in rows of their own hold the cells of the campaign's long tables."""
    c = campaign.Campaign(spark, ROOT)
    ok = c.counts.filter("same").select("extractor", "doc")
    p = campaign._paired(spark, ROOT)
    names = ["cell_idx", "row", "col", "rowspan", "colspan", "text", "is_header"]
    long = p.select(*scoring.TABLE, F.inline("pred.cells"))
    want = c.pred_cells.join(ok, ["extractor", "doc"], "left_semi").select(*scoring.TABLE, *names)
    assert long.exceptAll(want).count() == 0 == want.exceptAll(long).count()
    sizes = p.select(*scoring.TABLE, "evaluable", "gold.n_rows", F.size("gold.cells").alias("n"))
    true = ok.join(c.gold_tables, "doc").join(c.pairs, scoring.TABLE).select(*scoring.TABLE, "evaluable", "n_rows", (F.col("n_rows") * 4 - F.col("has_span").cast("int")).alias("n"))
    assert sizes.exceptAll(true).count() == 0 == true.exceptAll(sizes).count()


def shuffles(df):
    return len(re.findall(r"\bExchange ", df._jdf.queryExecution().executedPlan().toString()))


@has_tables
def test_grid_comparison_shuffles_lines_only(spark):
    tables.clear(spark)
    got = campaign.grid_comparison_panel(spark, ROOT)
    assert tables.clear(spark) == 0 and shuffles(got) == 1


def test_alike_pairs_score_as_trees(spark):
    """Built-ins and trees give the same score, and tables of one shape that differ little never get to the trees."""
    rng, rows = random.Random(3), []
    for i in range(300):
        n, cells = rng.randint(1, 4), []
        for r in range(n):
            cells += [(len(cells), r, c, 1, 1, rng.choice(["a", "año", "", None, "12345"]), r < i % 3) for c in range(rng.randint(0, 3))]
        other = [(*c[:5], rng.choice([c[5], c[5], "bb", "12x45"]), c[6] and i % 7 > 0) for c in cells][: None if i % 5 else -1]
        rows.append(("e", i, 0, (n, 3, cells), (n + (i % 11 == 0), 3, other)))
    d = spark.createDataFrame([*rows, ("e", 300, 0, (1, 1, []), None)], f"extractor string, doc int, table_idx int, a {TABLE}, b {TABLE}")
    names = ["cell_idx", "row", "col", "rowspan", "colspan", "text", "is_header"]
    plain = lambda t: {"n_rows": t[0], "cells": [dict(zip(names, c, strict=True)) for c in t[2]]}
    got = {r.doc: (r.teds, r.teds_s) for r in scoring.teds_pairs(d, "a", "b").collect()}
    assert got.pop(300) == (None, None)
    for _, i, _, a, b in rows:
        assert got[i] == pytest.approx(teds.teds(plain(b), plain(a)), abs=1e-12), (i, a, b)
    assert d.filter(teds.alike_score(F.col("a"), F.col("b")).isNotNull()).count() > 50


@has_tables
def test_teds_scores_shuffle_lines_and_means_only(spark):
    tables.clear(spark)
    got = campaign.teds_scores(spark, ROOT)
    assert tables.clear(spark) == 0 and shuffles(got) == 3  # lines, documents' means, totals
