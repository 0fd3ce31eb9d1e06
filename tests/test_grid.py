import random

from cotejo.operators import grid as G

T = "t int, n_rows int, n_cols int, first_page int, last_page int, expresses_spans boolean, source_format string"
C = "t int, cell_idx int, row int, col int, rowspan int, colspan int"


def slow(table, cells):
    """The findings of one table, cell by cell."""
    t, n, m, p1, p2, ex, fmt = table
    if n * m > G.AREA:
        return [("AREA_EXCESIVA", "")]
    out = []
    if fmt not in ("html", "markdown", "dataframe", "tei", "text"):
        out.append(("SOURCE_FORMAT_DESCONOCIDO", ""))
    if p1 < 1 or p2 < p1:
        out.append(("PAGE_SPAN_INVALIDO", ""))
    if n < 0 or m < 0 or (cells and (n < 1 or m < 1)):
        out.append(("DIMENSION_INCOHERENTE", ""))
    if any(c[4] > 1 or c[5] > 1 for c in cells) and not ex:
        out.append(("EXPRESSES_SPANS_IMPOSIBLE", ""))
    if ex and fmt in ("markdown", "dataframe", "text"):
        out.append(("EXPRESSES_SPANS_IMPOSIBLE", ""))
    taken, right, bad = {}, {}, 0
    for _, i, r, c, rs, cs in sorted(cells, key=lambda x: x[1]):
        code = "POSICION_NEGATIVA" if r < 0 or c < 0 else "SPAN_MENOR_QUE_UNO" if rs < 1 or cs < 1 else "SPAN_FUERA_DE_RANGO" if r + rs > n or c + cs > m else None
        if code:
            out.append((code, str(i)))
            bad += 1
            continue
        right[r] = max(right.get(r, -1), c)
        for y in range(r, r + rs):
            for x in range(c, c + cs):
                if (y, x) in taken:
                    out.append(("SOLAPE", f"{y},{x}"))
                taken.setdefault((y, x), i)
    if not bad and n > 0 and m > 0:
        for y in range(n):
            free = [x for x in range(m) if (y, x) not in taken]
            if len(free) == m:
                out.append(("FILA_VACIA", str(y)))
            else:
                out += [(k, str(y)) for k, f in (("HUECO_INTERIOR", lambda x: x < right.get(y, -1)), ("HUECO_COLA", lambda x: x >= right.get(y, -1))) if any(map(f, free))]
        out += [("COLUMNA_VACIA", str(x)) for x in range(m) if not any((y, x) in taken for y in range(n))]
    return out


def test_findings_against_cell_by_cell(spark):
    rng, tables, cells = random.Random(5), [], []
    for t in range(150):
        n, m = rng.randint(0, 4), rng.randint(0, 4)
        tables.append((t, n, m, rng.randint(0, 2), rng.randint(0, 3), rng.random() < 0.5, rng.choice(["html", "text", "tei", "pdf"])))
        at = [(r, c) for r in range(n) for c in range(m) if rng.random() < 0.85]
        for i, (r, c) in enumerate(at):
            cells.append((t, i, r - (rng.random() < 0.02), c, 1 + (rng.random() < 0.1) - (rng.random() < 0.02), 1 + (rng.random() < 0.1)))
    tables += [(900, 2000, 1000, 1, 1, True, "html"), (901, -1, 3, 1, 1, True, "html"), (902, 2_000_000_000, 2_000_000_000, 1, 1, True, "html"), (903, 1, 1, 1, 1, True, "html")]
    cells += [(900, 0, 0, 0, 1, 1), (902, 0, 0, 0, 2_000_000_000, 1), (903, 0, 0, 0, 2_000_000_000, 2_000_000_000)]
    want = sorted((t[0], *f) for t in tables for f in slow(t, [c for c in cells if c[0] == t[0]]))
    td, cd = spark.createDataFrame(tables, T), spark.createDataFrame(cells, C)
    found = G.findings(td, cd, ["t"])
    assert sorted(tuple(r) for r in found.collect()) == want
    truth = {r.t: r for r in G.derived_truth(td, found, ["t"]).collect()}
    for t in tables:
        fatal = sorted({c for x, c, _ in want if x == t[0] and c in G.FATAL})
        assert (truth[t[0]].kept, truth[t[0]].fatal) == (not fatal, fatal)
    census = {r.code: (r.tables, r.lines) for r in G.finding_census(found, ["t"]).collect()}
    assert sum(v[1] for v in census.values()) == len(want)
    assert G.findings(td.limit(0), cd.limit(0), ["t"]).collect() == []


def test_positions_holes_first_cell(spark):
    td = spark.createDataFrame([(1, 2, 3)], "t int, n_rows int, n_cols int")
    cd = spark.createDataFrame([(1, 0, 0, 0, 2, 2), (1, 1, 0, 1, 1, 9), (1, 2, -1, 0, 1, 1)], C)
    p = G.positions(cd, td, ["t"])
    assert sorted(tuple(r)[2:] for r in p.filter("cell_idx = 1").collect()) == [(0, 1), (0, 2)] and p.filter("cell_idx = 2").count() == 0
    assert {(r.r, r.c): r.cell_idx for r in G.cell_at(p, ["t"]).collect()}[(0, 1)] == 0
    assert [tuple(r) for r in G.overlaps(p, ["t"]).select("r", "c", "cell_idx", "first_idx").collect()] == [(0, 1, 1, 0)]
    assert [(r.r, r.c) for r in G.holes(p, td, ["t"]).collect()] == [(1, 2)]


def test_header_prefix_stops_at_a_gap(spark):
    td = spark.createDataFrame([(1,), (2,), (3,)], "t int")
    cd = spark.createDataFrame([(1, 0, True), (1, 1, True), (1, 2, False), (1, 3, True), (2, 1, True), (3, 0, True), (3, 0, False)], "t int, row int, is_header boolean")
    assert {r.t: r.header_rows for r in G.header_prefix(cd, td, ["t"]).collect()} == {1: 2, 2: 0, 3: 0}


def test_compare_grids(spark):
    s = "t int, r int, c int, is_anchor boolean, text string"
    a = spark.createDataFrame([(1, 0, 0, True, "x"), (1, 0, 1, False, "x"), (1, 1, 0, True, "y"), (1, 1, 1, True, None)], s)
    b = spark.createDataFrame([(1, 0, 0, True, "x"), (1, 0, 1, True, "x"), (1, 1, 0, True, "z"), (1, 1, 1, True, None), (1, 2, 0, True, "n")], s)
    assert {(r.r, r.c): r.kind for r in G.compare_grids(a, b, ["t"], ["text"]).collect()} == {(0, 1): "ESTADO", (1, 0): "TEXTO", (2, 0): "ESTADO"}
