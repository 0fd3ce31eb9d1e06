"""From markup to cells on a grid.

Every source format is first read into row groups, lists of rows of `Cell`; `lay_out`
places their cells on one grid. A table is a plain dict that fits `TABLE_TYPE`.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.functions.text import clean_cell

# The HTML standard's limits for spans.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
# Elements that set their text apart by a space.
BLOCKS = frozenset("p div br li ul ol dt dd h1 h2 h3 h4 h5 h6 pre".split())
# Source formats, and those that can say that a cell spans several positions.
FORMATS = ("html", "markdown", "dataframe", "tei", "text")
WITH_SPANS = ("html", "tei")

TABLE_TYPE = (
    "struct<cells:array<struct<row:int,col:int,rowspan:int,colspan:int,text:string,is_header:boolean>>,"
    "n_rows:int,n_cols:int,caption:string,expresses_spans:boolean,source_format:string>"
)


@dataclass
class Cell:
    text: str = ""
    header: bool = False
    rowspan: int = 1
    colspan: int = 1


@dataclass
class Group:
    """Rows that belong together; `ended` says that the markup ends the group before the table's end."""

    rows: list[list[Cell]] = field(default_factory=list)
    head: bool = False
    ended: bool = False


class _Skyline:
    """What hangs down into the rows below: stretches of columns, in order and apart, each with the first row that is free under it (None: not before the group ends)."""

    def __init__(self) -> None:
        self.stretches: list[tuple[int, int, int | None]] = []

    def free(self, col: int, row: int) -> int:
        """The first column from `col` on that is free in `row`."""
        for first, after, until in self.stretches:
            if first <= col < after and (until is None or until > row):
                col = after
        return col

    def cover(self, first: int, after: int, until: int | None) -> None:
        """Puts a cell on its columns. Where it lies over another the last one counts, but one without end stays."""
        kept, gaps = [], [(first, after)]
        for s in self.stretches:
            a, b, end = s
            if b <= first or a >= after:
                kept.append(s)
            elif end is None:
                kept.append(s)
                gaps = [g for x, y in gaps for g in ((x, min(y, a)), (max(x, b), y)) if g[0] < g[1]]
            else:
                kept += [(x, y, end) for x, y in ((a, first), (after, b)) if x < y]
        self.stretches = sorted([*kept, *((x, y, until) for x, y in gaps)], key=lambda s: s[0])

    def end_group(self, row: int) -> None:
        self.stretches = [(a, b, row if end is None else end) for a, b, end in self.stretches]

    def lowest(self) -> int:
        return max((end for _, _, end in self.stretches if end is not None), default=0)


def lay_out(groups: Sequence[Group], source_format: str, caption: str | None = None) -> dict:
    """Places cells as a browser does.

    A cell goes to the first column at or after the last cell's end whose position is free;
    only that column is looked at, so later ones may overlap. A rowspan of 0 reaches to the end of its group; what hangs out of a group
    that has ended pushes the next one down, at the end of the table it doesn't. n_rows counts rows seen, n_cols is the reach of the cells.
    """
    cells: list[dict] = []
    sky, row = _Skyline(), 0
    for group in groups:
        endless = []
        for line in group.rows:
            col = 0
            for c in line:
                col = sky.free(col, row)
                wide, tall = min(max(c.colspan, 1), MOST_COLUMNS), min(max(c.rowspan, 1), MOST_ROWS)
                cells.append({"row": row, "col": col, "rowspan": tall, "colspan": wide, "text": c.text, "is_header": c.header})
                if c.rowspan == 0:
                    endless.append(cells[-1])
                sky.cover(col, col + wide, None if c.rowspan == 0 else row + tall)
                col += wide
            row += 1
        for c in endless:
            c["rowspan"] = row - c["row"]
        sky.end_group(row)
        if group.ended:
            row = max(row, sky.lowest())
    return {
        "cells": cells, "n_rows": row, "n_cols": max((c["col"] + c["colspan"] for c in cells), default=0),
        "caption": caption or None, "expresses_spans": source_format in WITH_SPANS, "source_format": source_format,
    }


def span_value(raw: str | None) -> int:
    """A span attribute: its digits 0-9, anything else 1."""
    raw = (raw or "").strip()
    return int(raw) if re.fullmatch(r"[0-9]+", raw) else 1


@dataclass
class _Node:
    """An element of a table that is still open."""

    depth: int
    holds: object
    pieces: list[str] | None = None


class _HtmlTables(HTMLParser):
    """Keeps the elements of tables that are open, the innermost last.

    How deep an element lies in its table says which others its tag ends: a row ends the cell and row before it, a row group those and the group. So end tags that
    are left out, as HTML allows, need no rules of their own. A table in a cell is a table of its own, and nothing in it ends what is around it.
    """

    DEPTH = {"table": 0, "caption": 1, "thead": 1, "tbody": 1, "tfoot": 1, "tr": 2, "td": 3, "th": 3}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[list[Group], list[str]]] = []
        self.path: list[_Node] = []

    def end(self, depth: int) -> None:
        while self.path and self.path[-1].depth >= max(depth, 1):
            node = self.path.pop()
            if isinstance(node.holds, Cell):
                node.holds.text = clean_cell("".join(node.pieces))
            elif isinstance(node.holds, Group):
                node.holds.ended = True

    def current(self, depth: int):
        """The open element of that depth in the innermost table."""
        for node in reversed(self.path):
            if node.depth == depth:
                return node.holds
            if node.depth == 0:
                return None

    def group(self) -> Group:
        groups, _ = self.current(0)
        own = self.current(1)
        if isinstance(own, Group):
            return own
        if not groups or groups[-1].ended:
            groups.append(Group())
        return groups[-1]

    def handle_starttag(self, tag, attrs):
        depth = self.DEPTH.get(tag)
        if tag == "table":
            self.found.append(([], []))
            self.path.append(_Node(0, self.found[-1]))
        elif not self.path:
            return
        elif depth is None:
            self.space(tag)
        else:
            self.end(depth)
            groups, caption = self.current(0)
            if tag == "caption":
                self.path.append(_Node(1, None, caption))
            elif depth == 1:
                if groups:
                    groups[-1].ended = True
                groups.append(Group(head=tag == "thead"))
                self.path.append(_Node(1, groups[-1]))
            elif depth == 2:
                self.group().rows.append([])
                self.path.append(_Node(2, None))
            else:
                group, given = self.group(), {}
                if not group.rows:
                    group.rows.append([])
                for name, value in attrs:
                    given.setdefault(name, value)
                group.rows[-1].append(Cell("", tag == "th" or group.head, span_value(given.get("rowspan")), span_value(given.get("colspan"))))
                self.path.append(_Node(3, group.rows[-1][-1], []))

    def handle_endtag(self, tag):
        depth = self.DEPTH.get(tag)
        if not self.path:
            return
        if tag == "table":
            self.close_table()
        elif depth is None:
            self.space(tag)
        else:
            self.end(depth)
            groups = self.current(0)[0]
            if depth == 1 and tag != "caption" and groups:  # also rows that stood in the table without a group
                groups[-1].ended = True

    def close_table(self) -> None:
        while self.path[-1].depth:
            node = self.path.pop()
            if isinstance(node.holds, Cell):
                node.holds.text = clean_cell("".join(node.pieces))
        self.path.pop()

    def space(self, tag: str) -> None:
        if tag in BLOCKS and self.path[-1].depth == 3:
            self.path[-1].pieces.append(" ")

    def handle_data(self, data):
        if self.path and self.path[-1].pieces is not None:
            self.path[-1].pieces.append(data)


def tables_from_html(text: str) -> list[dict]:
    """All tables, in order of opening; those left open end with the text."""
    reader = _HtmlTables()
    reader.feed(text)
    reader.close()
    while reader.path:
        reader.close_table()
    return [lay_out(groups, "html", clean_cell("".join(caption))) for groups, caption in reader.found]


class _Inline:
    """Takes the marks off one cell of Markdown, from left to right.

    Escaped punctuation and code stand as they are, a link or image is its label, a line break is a blank. Runs of * and _ are set aside until the end, where those that
    pair up go: one can open if a word does not run into it and it does not stand before a blank, and close the other way round.
    """

    BREAK = re.compile(r"<br[ ]*/?>", re.I)

    def __init__(self, raw: str):
        self.raw = raw
        self.out: list[str] = []
        self.runs: list[dict] = []

    def text(self) -> str:
        at, raw = 0, self.raw
        while at < len(raw):
            c = raw[at]
            if c == "\\" and raw[at + 1 : at + 2] in tuple(string.punctuation):
                self.out.append(raw[at + 1])
                at += 2
            elif c == "`":
                at = self.code(at)
            elif c == "<" and (m := self.BREAK.match(raw, at)):
                self.out.append(" ")
                at = m.end()
            elif c in "![" and (end := self.link(at)):
                at = end
            elif c in "*_":
                at = self.run(at)
            else:
                self.out.append(c)
                at += 1
        self.pair()
        return "".join(self.out)

    def code(self, at: int) -> int:
        ticks = len(self.raw[at:]) - len(self.raw[at:].lstrip("`"))
        end = re.compile(rf"(?<!`)`{{{ticks}}}(?!`)").search(self.raw, at + ticks)
        self.out.append(self.raw[at + ticks : end.start()] if end else "`" * ticks)
        return end.end() if end else at + ticks

    def link(self, at: int) -> int:
        first = at + (self.raw[at] == "!")
        close = self.raw.find("]", first)
        if self.raw[first : first + 1] != "[" or close < 0 or self.raw[close + 1 : close + 2] != "(" or (end := self.raw.find(")", close)) < 0:
            return 0
        self.out.append(_Inline(self.raw[first + 1 : close]).text())
        return end + 1

    def run(self, at: int) -> int:
        c, end = self.raw[at], at
        while self.raw[end : end + 1] == c:
            end += 1
        before, after = self.raw[at - 1 : at] if at else "", self.raw[end : end + 1]
        self.runs.append({"at": len(self.out), "c": c, "n": end - at, "opens": not before.isalnum() and after.strip() != "", "closes": not after.isalnum() and before.strip() != ""})
        self.out.append(self.raw[at:end])
        return end

    def pair(self) -> None:
        open_: list[dict] = []
        for r in self.runs:
            while r["closes"] and r["n"] and (mate := next((o for o in reversed(open_) if o["c"] == r["c"]), None)):
                taken = 2 if min(mate["n"], r["n"]) > 1 else 1
                mate["n"] -= taken
                r["n"] -= taken
                del open_[open_.index(mate) + (mate["n"] > 0) :]
            if r["opens"] and r["n"]:
                open_.append(r)
        for r in self.runs:
            self.out[r["at"]] = r["c"] * r["n"]


def markdown_cell(raw: str) -> str:
    return clean_cell(_Inline(raw).text())


def _columns(line: str) -> list[str]:
    """The columns of a line with pipes; one pipe at either end is its frame."""
    line = line.strip()
    return line.removeprefix("|").removesuffix("|").split("|")


def _ruling(line: str) -> bool:
    """Whether the line under a header: dashes in every column, with colons for the alignment."""
    return all(set(c.strip().removeprefix(":").removesuffix(":")) == {"-"} for c in _columns(line))


def _runs(lines: Iterable, fits) -> Iterable[list]:
    """Runs of two or more consecutive lines for which `fits` gives something."""
    run: list = []
    for line in [*lines, None]:
        got = fits(line) if line is not None else None
        if got:
            run.append(got)
        else:
            if len(run) > 1:
                yield run
            run = []


def _rows(rows: list[list[str]], source_format: str, header: bool) -> dict:
    return lay_out([Group([[Cell(t, header and i == 0) for t in r] for i, r in enumerate(rows)])], source_format)


def tables_from_markdown(text: str) -> list[dict]:
    """Pipe tables whose second line is one of dashes; short rows leave holes."""
    runs = _runs(text.splitlines(), lambda s: s if "|" in s else None)
    return [_rows([[markdown_cell(t) for t in _columns(s)] for s in (run[0], *run[2:])], "markdown", True) for run in runs if _ruling(run[1])]


def tables_from_text(text: str) -> list[dict]:
    """Lines of columns set apart by a tab or two blanks; only runs in which all have as many columns."""
    split = lambda s: [t for t in re.split(r"\t|[ ]{2,}", s.strip()) if t]
    runs = _runs(text.splitlines(), lambda s: p if len(p := split(s)) > 1 else None)
    return [_rows([[clean_cell(t) for t in r] for r in run], "text", False) for run in runs if len({len(r) for r in run}) == 1]


def tables_from_tei(text: str) -> list[dict]:
    """Tables of a TEI document. Blank text has none; text that is no XML, or has a document type, is an error."""
    if not text.strip():
        return []
    if "<!DOCTYPE" in text:
        raise ValueError("a document type is not read")
    root = ElementTree.fromstring(text)
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2] if isinstance(e.tag, str) else e.tag
    out = []
    for t in root.iter("table"):
        group = Group()
        for r in t.findall("row"):
            marked = [(c, "label" in (r.get("role"), c.get("role"))) for c in r.findall("cell")]
            group.rows.append([Cell(clean_cell("".join(c.itertext())), label, span_value(c.get("rows")), span_value(c.get("cols"))) for c, label in marked])
        head = t.find("head")
        out.append(lay_out([group], "tei", clean_cell("".join(head.itertext())) if head is not None else None))
    return out


def table_from_frame(frame) -> dict:
    """A data frame; its labels are a header row unless they are just 0, 1, 2 and so on. None and NaN are empty cells."""
    if not (hasattr(frame, "columns") and hasattr(frame, "itertuples")):
        raise TypeError(f"{type(frame).__name__} is no data frame")
    text = lambda v: "" if v is None or v != v else clean_cell(str(v))
    labels = list(frame.columns)
    numbered = bool(labels) and all(type(x) is int and x == i for i, x in enumerate(labels))
    rows = [[text(v) for v in r] for r in frame.itertuples(index=False)]
    return _rows(rows if numbered else [[text(x) for x in labels], *rows], "dataframe", not numbered)


def to_html(table: dict) -> str:
    """A table as plain HTML: every cell a td, the header rows in a thead."""
    from cotejo.functions.teds import header_rows

    rows: list[list[dict]] = [[] for _ in range(table["n_rows"])]
    for c in table["cells"]:
        rows[c["row"]].append(c)
    attr = lambda c, n: f' {n}="{c[n]}"' if c[n] != 1 else ""
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    lines = ["<tr>" + "".join(f"<td{attr(c, 'colspan')}{attr(c, 'rowspan')}>{escape(c['text'])}</td>" for c in sorted(r, key=lambda c: c["col"])) + "</tr>" for r in rows]
    h = header_rows(rows)
    parts = [f"<{tag}>{''.join(part)}</{tag}>" for tag, part in (("thead", lines[:h]), ("tbody", lines[h:])) if part]
    return f"<html><body><table>{''.join(parts)}</table></body></html>"


READERS = {"html": tables_from_html, "markdown": tables_from_markdown, "text": tables_from_text, "tei": tables_from_tei}


def tables_of(df: DataFrame, text: str, source_format: str, keep: list[str]) -> DataFrame:
    """`keep`, table_idx INT and the columns of TABLE_TYPE: a row per table of each text, also of tables without cells.

    Null has no tables. One vectorised pass, no shuffle.
    """
    read = READERS[source_format]

    @F.pandas_udf(f"array<{TABLE_TYPE}>")
    def parse(values: pd.Series) -> pd.Series:
        return pd.Series([[] if v is None else read(v) for v in values])

    return df.select(*keep, F.posexplode(parse(text)).alias("table_idx", "_t")).select(*keep, "table_idx", "_t.*")


def cells_of(tables: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, cell_idx INT and the cell's columns, a row per cell; from columns as of tables_of."""
    return tables.select(*keep, F.posexplode("cells").alias("cell_idx", "_c")).select(*keep, "cell_idx", "_c.*")
