"""One form for texts that look the same but are made of different characters.

`canonical` is that form: compatibility normalisation, full case folding, look-alike letters of other scripts, spaces of any width as one
blank, nothing invisible. What a reader can tell apart and folding takes away (capitals, raised figures, ß) is kept beside it as *marks*, so
texts look the same exactly if form and marks agree. Both are worked out in one go, once per distinct value of a batch.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Callable, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Ranges of the Unicode property Default_Ignorable_Code_Point.
IGNORABLE = (
    r"­͏؜ᅟ-ᅠ឴-឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ"
    r"︀-️﻿ﾠ￰-￸\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
)
# Letters of other scripts, and marks, that are drawn like the character below them. They hold beside, and before, a loaded table (see confusables).
LOOK_ALIKES = {
    "АВЕЅІЈКМНОРСТУХԌԚԜаеѕіјорсухһԁԛԝѵӏ": "ABESIJKMHOPCTYXGQWaesijopcyxhdqwvl",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϳ": "ABEZHIKMNOPTYXoj",
    "օսոհցզՕՍ": "ounhgqOU",
    "‐‑‧∙⋅ʼ": "--···’",
}

_IGNORED = re.compile(f"[{IGNORABLE}]")
_SPACES = re.compile(r"[\s⠀]+")
_TABLE = {ord(a): b for xs, ys in LOOK_ALIKES.items() for a, b in zip(xs, ys, strict=True)}
#: Kinds of compatibility character that a reader tells from the plain one.
_SEEN = ("<super>", "<sub>", "<fraction>", "<circle>")


@lru_cache(maxsize=65536)
def _plain(c: str) -> str:
    """Compatibility form of a character, unless it looks different."""
    return c if c == "ſ" or ud.decomposition(c).startswith(_SEEN) else ud.normalize("NFKC", c)


def looks(text: str | None, table: dict[int, str] = _TABLE) -> str | None:
    """The text as a reader sees it; equal for texts that look the same. Null stays null."""
    if text is None:
        return None
    if not text.isascii():
        text = "".join(map(_plain, ud.normalize("NFC", _IGNORED.sub("", text))))
        text = ud.normalize("NFC", ud.normalize("NFD", text).translate(table))
    return _SPACES.sub(" ", text).strip()


def _folded(seen: str, table: dict[int, str]) -> str:
    if seen.isascii():
        return seen.lower()
    for _ in range(8):  # folding, composition and look-alikes can each make work for the others
        nxt = looks(ud.normalize("NFKC", ud.normalize("NFKC", seen).casefold()), table)
        if nxt == seen:
            break
        seen = nxt
    return seen


def canonical(text: str | None, table: dict[int, str] = _TABLE) -> str | None:
    """The consistent form: NFKC, full case folding, look-alikes, plain single spaces, nothing
    invisible. Applying it again changes nothing. Null stays null."""
    return None if text is None else _folded(looks(text, table), table)


class _Marks(dict):
    """For str.translate: characters that folding changes stay, all others are a dot."""

    def __missing__(self, o: int) -> int:
        c = chr(o)
        self[o] = o if ud.normalize("NFKC", ud.normalize("NFKC", c).casefold()) != c else 46
        return self[o]


_MARKS = _Marks()


def form_and_marks(text: str | None, table: dict[int, str] = _TABLE) -> tuple[str, str] | None:
    """The canonical form, and what a reader still sees that it does not have. Null stays null."""
    if text is None:
        return None
    seen = looks(text, table)
    return _folded(seen, table), seen.translate(_MARKS)


_loaded: dict[str, dict[int, str]] = {}


def confusables(spark: SparkSession) -> dict[int, str]:
    """Letters of all scripts that are drawn like another: the Unicode confusables data that the session's JVM has in its ICU, and LOOK_ALIKES.

    Letters of one skeleton and case stand for each other: they become the plain Latin letter among them, else the first of them. What is plain
    Latin already stays, so l, I and 1 remain apart, as do m and rn. About ten thousand letters in one call.
    """
    if "table" not in _loaded:
        letters = [c for c in map(chr, range(65, 0x20000)) if ud.category(c)[0] == "L" and not "㐀" <= c <= "鿿" and not "가" <= c <= "힣" and (c.isascii() or ud.normalize("NFKD", c) == c)]
        skeletons = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(letters)).split("\n")
        case = lambda c: ud.category(c) if ud.category(c) in ("Lu", "Ll") else ""
        stands: dict[tuple, str] = {}
        plain: dict[str, str] = {}
        for c, s in zip(letters, skeletons, strict=True):
            if len(s) == 1:
                stands.setdefault((s, case(c)), c)
                if c.isascii():
                    plain.setdefault(s, c)
        found = {}
        for c, s in zip(letters, skeletons, strict=True):
            if len(s) == 1 and not c.isascii():
                to = stands[s, case(c)] if case(c) else plain.get(s, stands[s, ""])
                if to != c:
                    found[ord(c)] = to
        _loaded["table"] = found | _TABLE
    return _loaded["table"]


def bare(text: str) -> str:
    """The canonical form without accents and other marks."""
    text = canonical(text)
    return text if text.isascii() else "".join(c for c in ud.normalize("NFD", text) if not ud.combining(c))


def _per_distinct(f, values: pd.Series) -> pd.Series:
    codes, distinct = pd.factorize(values, use_na_sentinel=True)
    done = [f(x) for x in distinct]
    return pd.Series([None if c < 0 else done[c] for c in codes], index=values.index, dtype=object)


def canonical_form(table: dict[int, str] = _TABLE) -> Callable:
    """A column function: the consistent form of a text."""

    @F.pandas_udf(StringType())
    def form(values: pd.Series) -> pd.Series:
        return _per_distinct(lambda t: canonical(t, table), values)

    return form


def reading(table: dict[int, str] = _TABLE) -> Callable:
    """A column function: STRUCT<form STRING, marks STRING> of a text, both null for null."""

    @F.pandas_udf("form string, marks string")
    def both(values: pd.Series) -> pd.DataFrame:
        got = _per_distinct(lambda t: form_and_marks(t, table), values)
        return pd.DataFrame({"form": [g and g[0] for g in got], "marks": [g and g[1] for g in got]}, index=values.index, dtype=object)

    return both


@F.pandas_udf(StringType())
def word_set(values: pd.Series) -> pd.Series:
    """The different words of a text, without accents and numbers, in order of the alphabet, joined by spaces."""
    return _per_distinct(lambda t: " ".join(sorted({w for w in re.findall(r"[^\W_]+", bare(t)) if not w.isdecimal()})), values)


def from_hex(digits: Column) -> Column:
    """The text spelt by hexadecimal UTF-8, however the bytes are set off (0x, \\x, spaces, commas).

    Null where the digits are null, of odd number, or spell no valid UTF-8.
    """
    clean = F.regexp_replace(F.lower(digits), r"0x|\\x|[^0-9a-f]", "")
    return F.when(F.length(clean) % 2 == 0, F.try_validate_utf8(F.unhex(clean).cast("string")))


def look_alike(df: DataFrame, texts: Sequence[str], table: dict[int, str] = _TABLE) -> DataFrame:
    """The rows of `df` whose texts that are not null, two or more, all look the same without all being the same.

    Texts of one canonical form are the candidates; of these, the ones stay whose marks agree too. Fewer than two texts, and equal ones, are no case.
    """
    read = reading(table)
    names = [f"_read{i}" for i in range(len(texts))]
    few = lambda part: F.size(F.array_distinct(F.array_compact(F.array(*[F.col(n)[part] for n in names])))) == 1
    differ = F.size(F.array_distinct(F.array_compact(F.array(*texts)))) > 1
    given = df.filter(differ).withColumns({n: read(F.col(t)) for n, t in zip(names, texts, strict=True)})
    return given.filter(few("form")).filter(few("marks")).drop(*names)
