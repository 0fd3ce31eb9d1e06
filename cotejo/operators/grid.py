"""Cells as rectangles on their table's grid.

A rectangle is only ever expanded inside its table, and no table of over AREA positions is.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from cotejo.functions.layout import FORMATS, WITH_SPANS

#: Positions of the largest table whose grid is looked at.
AREA = 1_000_000
# Codes of findings that make a table unusable, and of those that only inform.
FATAL = (
    "AREA_EXCESIVA", "PAGE_SPAN_INVALIDO", "DIMENSION_INCOHERENTE", "POSICION_NEGATIVA", "SPAN_MENOR_QUE_UNO",
    "SPAN_FUERA_DE_RANGO", "SOLAPE", "EXPRESSES_SPANS_IMPOSIBLE", "HUECO_INTERIOR", "COLUMNA_VACIA",
)
INFORMATIVE = ("SOURCE_FORMAT_DESCONOCIDO", "FILA_VACIA", "HUECO_COLA")


def span(first: Column, after: Column) -> Column:
    """first, first + 1, ... up to but not including `after`; empty if there is none."""
    return F.when(after > first, F.sequence(first, after - 1)).otherwise(F.array().cast("array<int>"))


def area(tables: DataFrame) -> Column:
    """Positions of a table's grid; a product that no two numbers of rows and columns can overflow."""
    return F.col("n_rows").cast("decimal(19,0)") * F.col("n_cols").cast("decimal(19,0)")


def _whole_numbers(tables: DataFrame) -> DataFrame:
    return tables.withColumns({n: F.col(n).cast("int") for n in ("n_rows", "n_cols")})


def expandable(tables: DataFrame) -> DataFrame:
    """The tables whose grid can be gone through, their numbers of rows and columns as INT."""
    return _whole_numbers(tables.filter((F.col("n_rows") > 0) & (F.col("n_cols") > 0) & (area(tables) <= AREA)))


def positions(cells: DataFrame, tables: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`keys`, cell_idx, r, c: each position that a cell covers, cut to the table's grid. Tables beyond AREA have none."""
    fit = expandable(tables).select(*keys, "n_rows", "n_cols")
    inside = cells.join(fit, list(keys))
    end = lambda at, by, n: F.least(F.col(at).cast("bigint") + F.col(by), F.col(n).cast("bigint")).cast("int")
    rows = span(F.greatest(F.col("row"), F.lit(0)), end("row", "rowspan", "n_rows"))
    cols = span(F.greatest(F.col("col"), F.lit(0)), end("col", "colspan", "n_cols"))
    return inside.select(*keys, "cell_idx", F.explode(rows).alias("r"), cols.alias("_c")).select(*keys, "cell_idx", "r", F.explode("_c").alias("c"))


def cell_at(covered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`keys`, r, c, cell_idx: the first cell, in order, on each covered position."""
    return covered.groupBy(*keys, "r", "c").agg(F.min("cell_idx").alias("cell_idx"))


def overlaps(covered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`keys`, r, c, cell_idx, first_idx: each cell after the first on a position."""
    place = Window.partitionBy(*keys, "r", "c").orderBy("cell_idx")
    return covered.withColumn("first_idx", F.first("cell_idx").over(place)).withColumn("_n", F.row_number().over(place)).filter("_n > 1").drop("_n")


def holes(covered: DataFrame, tables: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`keys`, r, c of the positions that no cell covers."""
    fit = expandable(tables)
    rows = fit.select(*keys, "n_cols", F.explode(span(F.lit(0), F.col("n_rows"))).alias("r"))
    taken = covered.groupBy(*keys, "r").agg(F.collect_set("c").alias("_taken"))
    empty = F.array().cast("array<int>")
    left = F.array_except(span(F.lit(0), F.col("n_cols")), F.coalesce("_taken", empty))
    return rows.join(taken, [*keys, "r"], "left").select(*keys, "r", F.explode(left).alias("c"))


def header_prefix(cells: DataFrame, tables: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`keys`, header_rows: length of the longest run of first rows that have cells and only header cells."""
    per_row = cells.groupBy(*keys, "row").agg(F.bool_and("is_header").alias("_all"))
    upto = Window.partitionBy(*keys).orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = per_row.withColumn("_ok", F.min("_all").over(upto)).withColumn("_dense", F.row_number().over(Window.partitionBy(*keys).orderBy("row")) == F.col("row") + 1)
    n = run.filter("_ok AND _dense").groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("header_rows"))
    return tables.select(*keys).join(n, list(keys), "left").withColumn("header_rows", F.coalesce("header_rows", F.lit(0)))


def findings(tables: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`keys`, code, place: what is wrong with each table, a row per finding.

    tables: n_rows, n_cols, first_page, last_page, expresses_spans, source_format; cells: cell_idx, row, col, rowspan, colspan, without nulls.
    A table beyond AREA has that finding only. A cell that is off the grid is left aside; with such a cell a table is not looked through for holes.
    place: the cell, row or column number, or row,col.
    """
    keys = list(keys)
    too_large = area(tables) > AREA
    huge = tables.filter(too_large).select(*keys, F.lit("AREA_EXCESIVA").alias("code"), F.lit("").alias("place"))
    fit = _whole_numbers(tables.filter(~too_large))
    of_table = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cells"), F.bool_or((F.col("rowspan") > 1) | (F.col("colspan") > 1)).alias("_spans"))
    whole = fit.join(of_table, keys, "left").withColumn("_cells", F.coalesce("_cells", F.lit(0))).withColumn("_spans", F.coalesce("_spans", F.lit(False)))
    n, m = F.col("n_rows"), F.col("n_cols")
    codes = F.array_compact(F.array(
        F.when(~F.col("source_format").isin(*FORMATS), "SOURCE_FORMAT_DESCONOCIDO"),
        F.when((F.col("first_page") < 1) | (F.col("last_page") < F.col("first_page")), "PAGE_SPAN_INVALIDO"),
        F.when((n < 0) | (m < 0) | ((F.col("_cells") > 0) & ((n < 1) | (m < 1))), "DIMENSION_INCOHERENTE"),
        F.when(F.col("_spans") & ~F.col("expresses_spans"), "EXPRESSES_SPANS_IMPOSIBLE"),
        F.when(F.col("expresses_spans") & F.col("source_format").isin(*[f for f in FORMATS if f not in WITH_SPANS]), "EXPRESSES_SPANS_IMPOSIBLE"),
    ))
    head = whole.select(*keys, F.explode(codes).alias("code"), F.lit("").alias("place"))

    judged = cells.join(fit.select(*keys, "n_rows", "n_cols"), keys).withColumn(
        "code",
        F.when((F.col("row") < 0) | (F.col("col") < 0), "POSICION_NEGATIVA").when((F.col("rowspan") < 1) | (F.col("colspan") < 1), "SPAN_MENOR_QUE_UNO")
        .when((F.col("row").cast("bigint") + F.col("rowspan") > n) | (F.col("col").cast("bigint") + F.col("colspan") > m), "SPAN_FUERA_DE_RANGO"),
    )
    bad = judged.filter("code IS NOT NULL")
    off = bad.select(*keys, "code", F.col("cell_idx").cast("string").alias("place"))
    good = judged.filter("code IS NULL").select(*keys, "cell_idx", "row", "col", "rowspan", "colspan")
    covered = positions(good, fit, keys)
    over = overlaps(covered, keys).select(*keys, F.lit("SOLAPE").alias("code"), F.concat_ws(",", "r", "c").alias("place"))

    sound = fit.join(bad.select(*keys).distinct(), keys, "left_anti").filter((n > 0) & (m > 0))
    rows = sound.select(*keys, "n_cols", F.explode(span(F.lit(0), n)).alias("r"))
    taken = covered.groupBy(*keys, "r").agg(F.collect_set("c").alias("_taken"))
    right = good.groupBy(*keys, F.col("row").alias("r")).agg(F.max("col").alias("_right"))
    lines = rows.join(taken, [*keys, "r"], "left").join(right, [*keys, "r"], "left")
    every = span(F.lit(0), F.col("n_cols"))
    free = F.array_except(every, F.col("_taken"))
    inner = F.exists(free, lambda c: c < F.coalesce(F.col("_right"), F.lit(-1)))
    tail = F.exists(free, lambda c: c >= F.coalesce(F.col("_right"), F.lit(-1)))
    of_row = F.when(F.col("_taken").isNull(), F.array(F.lit("FILA_VACIA"))).otherwise(F.array_compact(F.array(F.when(inner, "HUECO_INTERIOR"), F.when(tail, "HUECO_COLA"))))
    gaps = lines.select(*keys, F.explode(of_row).alias("code"), F.col("r").cast("string").alias("place"))
    used = covered.groupBy(*keys).agg(F.collect_set("c").alias("_used"))
    blank = sound.join(used, keys, "left").select(*keys, F.explode(F.array_except(span(F.lit(0), m), F.coalesce("_used", F.array().cast("array<int>")))).alias("_c"))
    columns = blank.select(*keys, F.lit("COLUMNA_VACIA").alias("code"), F.col("_c").cast("string").alias("place"))
    out = huge
    for part in (head, off, over, gaps, columns):
        out = out.unionAll(part)
    return out


def derived_truth(tables: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`keys`, kept, fatal: whether a table may serve as truth, and the fatal codes that keep it from that, sorted."""
    fatal = found.filter(F.col("code").isin(*FATAL)).groupBy(*keys).agg(F.array_sort(F.collect_set("code")).alias("fatal"))
    return tables.select(*keys).join(fatal, list(keys), "left").select(*keys, F.col("fatal").isNull().alias("kept"), F.coalesce("fatal", F.array().cast("array<string>")).alias("fatal"))


def finding_census(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """code, tables (that have it), lines."""
    per = found.groupBy("code", *keys).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("code").agg(F.count(F.lit(1)).alias("tables"), F.sum("n").alias("lines"))


def compare_sizes(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`keys`, r, c (both null), kind DIMENSION: the tables that both sides have, of other numbers of rows or columns. Both have keys, n_rows and n_cols."""
    a, b = ([F.col(n).alias(f"_{side}{n}") for n in ("n_rows", "n_cols")] for side in "lr")
    both = left.select(*keys, *a).join(right.select(*keys, *b), list(keys))
    other = both.filter(~(F.col("_ln_rows").eqNullSafe(F.col("_rn_rows")) & F.col("_ln_cols").eqNullSafe(F.col("_rn_cols"))))
    return other.select(*keys, F.lit(None).cast("int").alias("r"), F.lit(None).cast("int").alias("c"), F.lit("DIMENSION").alias("kind"))


def compare_grids(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """`keys`, r, c, kind: positions on which two grids differ.

    Both have keys, r, c, is_anchor and `fields`. kind: ESTADO if one has a hole or an anchor where the other does not, TEXTO if two anchors differ in a field.
    """
    on = [*keys, "r", "c"]
    state = lambda a: F.when(a.isNull(), "hole").when(a, "anchor").otherwise("covered")
    a = left.select(*on, F.col("is_anchor").alias("_la"), *[F.col(f).alias(f"_l{f}") for f in fields])
    b = right.select(*on, F.col("is_anchor").alias("_ra"), *[F.col(f).alias(f"_r{f}") for f in fields])
    text = F.lit(False)
    for f in fields:
        text = text | ~F.col(f"_l{f}").eqNullSafe(F.col(f"_r{f}"))
    kind = F.when(state(F.col("_la")) != state(F.col("_ra")), "ESTADO").when(F.col("_la") & text, "TEXTO")
    return a.join(b, on, "full_outer").select(*on, kind.alias("kind")).filter("kind IS NOT NULL")


def _covered(tables: pa.StructArray) -> tuple[np.ndarray, ...]:
    """Of a column of tables: number of the table, r, c, whether it is the cell's anchor, and number among all cells, of each position that a cell covers, as positions() has them."""
    cells = tables.field("cells")
    number = np.repeat(np.arange(len(tables)), pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False))
    cells = cells.flatten()
    of = lambda a, name: pc.fill_null(a.field(name), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    n, m = of(tables, "n_rows"), of(tables, "n_cols")
    fit = (n > 0) & (m > 0) & (n <= AREA // np.maximum(m, 1))
    row, col = of(cells, "row"), of(cells, "col")
    top, left = np.maximum(row, 0), np.maximum(col, 0)
    high = np.maximum(np.minimum(row + of(cells, "rowspan"), n[number]) - top, 0)
    wide = np.maximum(np.minimum(col + of(cells, "colspan"), m[number]) - left, 0)
    times = high * wide * fit[number]
    cell = np.repeat(np.arange(len(number)), times)
    step = np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
    r, c = top[cell] + step // np.maximum(wide, 1)[cell], left[cell] + step % np.maximum(wide, 1)[cell]
    return number[cell], r, c, (row[cell] == r) & (col[cell] == c), cell


def differences(left: pa.StructArray, right: pa.StructArray, fields: Sequence[str]) -> pa.ListArray:
    """Of two columns of tables, none null: for each pair the r, c and kind (see compare_grids) of the positions on which they differ. Where cells overlap, the last one is on the position."""
    sides = [_covered(t) for t in (left, right)]
    high, wide = (1 + max(int(s[k].max(initial=0)) for s in sides) for k in (1, 2))
    known = []
    for number, r, c, anchor, cell in sides:
        key = (number * high + r) * wide + c
        if not (key[1:] > key[:-1]).all():
            order = np.lexsort((cell, key))
            last = order[np.append(key[order][1:] != key[order][:-1], True)]
            key, anchor, cell = key[last], anchor[last], cell[last]
        known.append((key, anchor, cell))
    (a, anchor_a, cell_a), (b, anchor_b, cell_b) = known
    at = np.searchsorted(b, a)
    met = at < len(b)
    met[met] = b[at[met]] == a[met]
    i, j = np.flatnonzero(met), at[met]
    alone = np.ones(len(b), dtype=bool)
    alone[j] = False
    state = anchor_a[i] != anchor_b[j]
    i_text, j_text = (x[~state & anchor_a[i]] for x in (i, j))
    other = np.zeros(len(i_text), dtype=bool)
    for f in fields:
        x, y = (t.field("cells").flatten().field(f).take(pa.array(cell[k])) for t, cell, k in ((left, cell_a, i_text), (right, cell_b, j_text)))
        unlike = pc.if_else(pc.and_(x.is_valid(), y.is_valid()), pc.fill_null(pc.not_equal(x, y), False), pc.xor(x.is_valid(), y.is_valid()))
        other |= unlike.to_numpy(zero_copy_only=False)
    text = a[i_text[other]]
    keys = np.concatenate([a[~met], b[alone], a[i[state]], text])
    kinds = np.repeat([0, 1], [len(keys) - len(text), len(text)])
    order = np.argsort(keys)
    keys, kinds = keys[order], kinds[order]
    ends = np.searchsorted(keys, np.arange(len(left) + 1) * high * wide)
    found = [pa.array(keys // wide % high, pa.int32()), pa.array(keys % wide, pa.int32()), pa.array(["ESTADO", "TEXTO"]).take(pa.array(kinds))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(found, ["r", "c", "kind"]))


def compare_tables(pairs: DataFrame, left: str, right: str, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """`keys`, r, c, kind: a DIMENSION row, with r and c null, for each pair of tables of other numbers of rows or columns, and the positions on which their grids differ.

    `left` and `right` are structs of n_rows, n_cols and cells. What compare_sizes and compare_grids find by joins of tables and of positions is found in the pair's own row
    here, so no position is shuffled; alike tables are not gone through.
    """
    keys, alike = list(keys), F.col(left) == F.col(right)
    other = pairs.filter(F.col(left).isNotNull() & F.col(right).isNotNull() & ~alike).select(*keys, left, right)

    # Not a UDF: rows that wait for a UDF's result are kept beside it, on disk where memory is short.
    def unlike(batches):
        for batch in batches:
            x, y = batch.column(left), batch.column(right)
            found = differences(x, y, fields)
            sizes = [pc.struct_field(t, n).fill_null(-1).to_numpy(zero_copy_only=False) for t in (x, y) for n in ("n_rows", "n_cols")]
            sized = np.flatnonzero((sizes[0] != sizes[2]) | (sizes[1] != sizes[3]))
            at = pa.array(np.concatenate([np.repeat(np.arange(len(x)), found.value_lengths().to_numpy()), sized]))
            where = [pa.concat_arrays([found.flatten().field(n), pa.nulls(len(sized), pa.int32())]) for n in ("r", "c")]
            kind = pa.concat_arrays([found.flatten().field("kind"), pa.array(["DIMENSION"] * len(sized), pa.string())])
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in keys], *where, kind], names=[*keys, "r", "c", "kind"])

    place = StructType([StructField("r", IntegerType()), StructField("c", IntegerType()), StructField("kind", StringType())])
    return other.mapInArrow(unlike, StructType([*other.select(*keys).schema.fields, *place.fields]))
