"""Text as cells and documents are compared by."""

from __future__ import annotations

import difflib
import re
import unicodedata as ud
from collections.abc import Callable, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Latin presentation forms and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
_LIGATURE_TABLE = str.maketrans(LIGATURES)


@lru_cache(maxsize=4096)
def _kept(c: str) -> str:
    kind = ud.category(c)
    return "" if kind == "Cf" else " " if kind in ("Cc", "Zs", "Zl", "Zp") else c


def clean_cell(text: str) -> str:
    """Composed, seven ligatures spelt out, format characters gone, every kind of space one blank.

    Case, accents, quotes, dashes and compatibility characters stay as they are. Cleaning again changes nothing.
    """
    text = ud.normalize("NFC", text)
    if not (text.isascii() and text.isprintable()):
        text = "".join(map(_kept, ud.normalize("NFC", text.translate(_LIGATURE_TABLE))))
        text = ud.normalize("NFC", text)
    return " ".join(text.split())


@F.pandas_udf(StringType())
def clean_cell_column(values: pd.Series) -> pd.Series:
    return values.map(clean_cell, na_action="ignore")


def without_boilerplate(text: str, starts: Sequence[str]) -> str:
    """The text without the lines that begin so, in whatever case: what a page of the source repeats, as its profile says."""
    low = tuple(s.lower() for s in starts)
    return "\n".join(s for s in text.splitlines() if not s.strip().lower().startswith(low)) if low else text


def coherence(pdf: str, xml: str, starts: Sequence[str] = (), most: int | None = None) -> float:
    """Ratcliff-Obershelp ratio of the words of two texts, of the whole texts unless `most` words of each are asked for; 0 if a side has none."""
    words = lambda t: re.findall(r"\w+", ud.normalize("NFKC", t).lower())[:most]
    a, b = words(xml), words(without_boilerplate(pdf, starts))
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else 0.0


def coherence_column(starts: Sequence[str] = (), most: int | None = None) -> Callable:
    """A column function of two texts; null where either is null."""

    @F.pandas_udf(DoubleType())
    def ratio(pdf: pd.Series, xml: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else coherence(a, b, starts, most) for a, b in zip(pdf, xml, strict=True)], dtype="Float64")

    return ratio


def doc_key(entity: Column, external_id: Column) -> Column:
    """entity/external_id with % and / escaped, so that no two pairs have the same key."""
    escaped = lambda c: F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))
    return F.concat(escaped(entity), F.lit("/"), escaped(external_id))


def plain_text(markup: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(markup, "<[^>]+>", " "), r"\s+", " "))


def features(markup: Column) -> dict[str, Column]:
    """Tables, images, cells that really span (more than 1), and the widest span."""
    spans = F.filter(F.transform(F.regexp_extract_all(F.lower(markup), F.lit(r'(?:row|col)span\s*=\s*"?([0-9]{1,6})'), F.lit(1)), lambda x: x.cast("int")), lambda x: x > 1)
    return {
        "n_tables": F.regexp_count(F.lower(markup), F.lit("<table")), "n_images": F.regexp_count(F.lower(markup), F.lit("<img")),
        "n_spans": F.size(spans), "max_span": F.coalesce(F.array_max(spans), F.lit(1)),
    }


def stratum(tables: Column, images: Column, spans: Column) -> Column:
    return F.when(tables == 0, F.when(images > 0, "anexo-png").otherwise("sin-tabla")).when(spans > 0, "celdas-combinadas").otherwise("tabla-simple")


def html_int(raw: Column) -> Column:
    """A span attribute: its digits 0-9, anything else 1; more than nine digits count as 999999999."""
    digits = F.trim(raw)
    return F.when(digits.rlike("^[0-9]+$"), F.when(F.length(digits) > 9, 999999999).otherwise(F.try_to_number(digits, F.lit("999999999")).cast("int"))).otherwise(1)


def page_count(first: Column, last: Column) -> Column:
    """Pages from the first and last page written; null on bad or reversed numbers."""
    a, b = first.try_cast("int"), last.try_cast("int")
    return F.when((a >= 1) & (b >= a), b - a + 1)


def code_points(text: Column) -> Column:
    """U+XXXX of each character, set apart by blanks."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c: F.concat(F.lit("U+"), F.regexp_replace(F.hex(F.encode(c, "UTF-32")), "^0{1,4}", ""))), " ")


def local_number(x: Column, decimals: int = 4) -> Column:
    """1.234,5678; n/a for null."""
    return F.coalesce(F.translate(F.format_number(x, decimals), ",.", ".,"), F.lit("n/a"))


def signed_percent(x: Column, decimals: int = 2) -> Column:
    """A share as +1,23 % or -1,23 %; n/a for null, and no sign if nothing is left after rounding."""
    p = F.round(x * 100, decimals)
    return F.when(x.isNull(), "n/a").otherwise(F.concat(F.when(p > 0, "+").when(p < 0, "-").otherwise(""), local_number(F.abs(p), decimals), F.lit(" %")))


def shared_ends(a: Column, b: Column) -> tuple[Column, Column]:
    """How many characters two texts share at their beginning, and how many of the rest at their end; null where either is null."""
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    run = lambda x, y: F.array_position(F.concat(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), F.array(F.lit(False))), False).cast("int") - 1
    first = run(chars(a), chars(b))
    rest = lambda c: F.reverse(F.slice(chars(c), first + 1, F.greatest(F.length(c) - first, F.lit(0))))
    return first, run(rest(a), rest(b))


def context(text: Column, word: str, margin: int = 45) -> Column:
    """The text around the first place of a word, `margin` characters to either side; null where the text has not got it."""
    at = F.instr(text, word)
    return F.when(at > 0, F.substring(text, F.greatest(at - margin, F.lit(1)), F.lit(len(word) + margin) + F.least(at - 1, F.lit(margin))))


#: Short names of the months.
MONTHS = ("ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic")


def short_date(d: Column) -> Column:
    names = F.array(*[F.lit(m) for m in MONTHS])
    return F.concat_ws(" ", F.dayofmonth(d).cast("string"), F.element_at(names, F.month(d)), F.year(d).cast("string"))
