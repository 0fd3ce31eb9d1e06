"""Reading level of documents, from readers' marks on some of them.

Every sentence of a document's prose is classified by a word model and a character model (ridge
regressions on the cumulative marks, over words and over the letter groups of words), which see no more of a
labelled document than its marks. A logistic combiner turns both and the sentence's shape into the
chances that it stands at level 2, 3, 4, 5 or above; a document has the mean of its sentences' chances,
calibrated by a second logistic step on documents that the models under it had not seen.
"""

from __future__ import annotations

import html
import re
import unicodedata as ud
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm.textform import _IGNORED, bare
from cotejo.llm.words import _ENTITY, _TAG, REMEMBERED, portions

LEVELS = 5
#: Labelled documents that a fit reads at most, drawn by hash, and characters of the longest of them.
LABELLED, LONGEST = 2000, 50_000
GRAM_BUCKETS = 1 << 16

_WORD = re.compile(r"\w+")
_DIGITS = re.compile(r"\d+")
_TABLE_MARKUP = re.compile(r"<(table|h[1-6]|title|thead|tbody|figure|pre)\b.*?</\1\s*>", re.I | re.S)
_BLOCK = re.compile(r"</?(?:p|div|br|li|ul|ol|section|article|tr|td|th|dd|dt|dl|hr|blockquote)\b[^<>]*>", re.I)
_COLUMNS = re.compile(r"\S {2,}\S.*\S {2,}\S")
_RULE = re.compile(r"[-|:+=_*\s]{3,}$")
_BULLET = re.compile(r"^\s*(?:[-*•·–—>]+|\(?\d{1,3}[.)º°ª]+|\(?[a-z]\))\s+")
_END = re.compile(r"[.!?…][\"»”')\]]*\s*$")
_SPLIT = re.compile(r"(?<=[.!?…])[\"»”')\]]*\s+(?=[\"«“'(¿¡]*[A-ZÀ-ÖØ-Þ])")


def sentences(text: str | None) -> list[str]:
    """The sentences of a document's prose.

    Tables, headings and references are left out, told by their form alone: a reference is a line without a sentence's end of which half the words or more have
    digits, or that is one quotation. A line break ends a sentence unless the next line, also an item of a
    list, goes on in lower case, or the text is wrapped (some line goes on so) and the line is full: the next line's first word would not have
    fitted into the width of the widest line.
    """
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub("", _BLOCK.sub("\n\n", _TABLE_MARKUP.sub("\n\n", text)))
    if "&" in text and _ENTITY.search(text):
        text = html.unescape(text)
    if not text.isascii():
        text = _IGNORED.sub("", ud.normalize("NFC", text))
    lines, first = [], True
    for line in text.splitlines():
        bare_line = line.strip()
        if not bare_line:
            lines.append("")
            continue
        open_ = not _END.search(bare_line)
        heading = bare_line[0] == "#" or (open_ and (first or bare_line.isupper()) and (first or len(bare_line) > 3) and len(bare_line.split()) <= 8)
        first = False
        if heading or _grid(bare_line) or (open_ and (_numbers(bare_line) or (bare_line[0] in "«“\"" and bare_line[-1] in "»”\""))):
            lines.append("")
        else:
            lines.append(_BULLET.sub("", line.rstrip()))
    wrapped = any(a and b and b.lstrip()[:1].islower() for a, b in zip(lines, lines[1:]))
    width = max(map(len, lines), default=0)
    parts, held = [], ""
    for line in lines:
        stripped = line.strip()
        if not stripped:
            if held:
                parts.append(held)
            held = last = ""
            continue
        goes_on = held and not (_END.search(last) and len(last) < width - 20)
        if goes_on and ((stripped[0].islower() and not _END.search(last)) or (wrapped and len(last) + 1 + len(stripped.split(None, 1)[0]) > width)):
            held = f"{held[:-1]}{stripped}" if held[-1] in "-‐" and held[-2:-1].isalpha() and stripped[0].islower() else f"{held} {stripped}"
        else:
            if held:
                parts.append(held)
            held = stripped
        last = line
    if held:
        parts.append(held)
    return [s for p in parts for s in _SPLIT.split(p) if s]


def _grid(line: str) -> bool:
    """Whether a line is part of a table or ruling."""
    return "\t" in line or line.count("|") > 1 or ("  " in line and _COLUMNS.search(line) is not None) or (not line[0].isalnum() and _RULE.match(line) is not None)


def _numbers(line: str) -> bool:
    """Whether half of a line's words or more have digits, as references and codes do."""
    if not (runs := _DIGITS.findall(line)):
        return False
    words = _WORD.findall(line)
    return 2 * len(runs) >= len(words) and 2 * sum(1 for w in words if _DIGITS.search(w)) >= len(words)  # no more such words than runs of digits


def tokens(sentence: str) -> list[str]:
    """The words as they stand; see number_free."""
    return _WORD.findall(sentence)


def number_free(word: str) -> str:
    """What a model knows a word by: in lower case, all numbers alike."""
    return "#" if word[0].isdigit() else word.lower()


def grams(word: str) -> list[int]:
    """Buckets of a word's letter groups of 3 to 5, its ends marked."""
    w = f"<{bare(word)}>"
    return [xxhash.xxh32_intdigest(w[i : i + n]) % GRAM_BUCKETS for n in (3, 4, 5) for i in range(max(0, len(w) - n) + 1)]


class Bag:
    """Sentences as rows of word numbers, laid end to end."""

    def __init__(self, rows: list[list[int]]):
        self.size = np.array([len(r) for r in rows])
        self.ids = np.fromiter((i for r in rows for i in r), dtype=np.int64, count=int(self.size.sum()))
        self.starts = np.r_[0, np.cumsum(self.size)[:-1]].astype(np.int64)
        self.row = np.repeat(np.arange(len(rows)), self.size)

    def mean(self, table: np.ndarray) -> np.ndarray:
        """Mean of the words' rows of `table`, by sentence."""
        if not len(self.size):
            return np.zeros((0, table.shape[1]))
        return np.add.reduceat(table[self.ids], self.starts, axis=0) / self.size[:, None]

    def back(self, values: np.ndarray, words: int) -> np.ndarray:
        """The transpose of mean."""
        each = (values / self.size[:, None])[self.row]
        return np.stack([np.bincount(self.ids, each[:, k], words) for k in range(values.shape[1])], axis=1)


def _conjugate(apply, rhs: np.ndarray, steps: int) -> np.ndarray:
    """Solves apply(x) = rhs for a symmetric positive operator, columns side by side."""
    x, r = np.zeros_like(rhs), rhs.copy()
    p, rs = r.copy(), (r * r).sum(0)
    for _ in range(steps):
        ap = apply(p)
        a = rs / np.maximum((p * ap).sum(0), 1e-30)
        x += a * p
        r -= a * ap
        new = (r * r).sum(0)
        p = r + (new / np.maximum(rs, 1e-30)) * p
        rs = new
    return x


def ridge_words(bag: Bag, words: int, y: np.ndarray, penalty: float, steps: int = 15) -> np.ndarray:
    """A weight per word and column of y: ridge regression of y on the sentences' word means."""
    return _conjugate(lambda w: bag.back(bag.mean(w), words) + penalty * w, bag.back(y, words), steps)


class Letters:
    """The words' letter groups; a word's row is their mean."""

    def __init__(self, vocabulary: list[str]):
        self.bag = Bag([grams(w) for w in vocabulary])

    def table(self, weights: np.ndarray) -> np.ndarray:
        return self.bag.mean(weights)

    def back(self, values: np.ndarray) -> np.ndarray:
        return self.bag.back(values, GRAM_BUCKETS)


def ridge_letters(bag: Bag, letters: Letters, words: int, y: np.ndarray, penalty: float, steps: int = 15) -> np.ndarray:
    """A weight per letter-group bucket and column of y."""
    return _conjugate(lambda w: letters.back(bag.back(bag.mean(letters.table(w)), words)) + penalty * w, letters.back(bag.back(y, words)), steps)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float, weight: np.ndarray | None = None, steps: int = 12) -> np.ndarray:
    """Weights (with the intercept last) per column of y in [0, 1]; Newton steps, ridge penalty on all but the intercept."""
    x = np.c_[x, np.ones(len(x))]
    weight = np.ones(len(x)) if weight is None else weight
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    out = np.zeros((x.shape[1], y.shape[1]))
    for k in range(y.shape[1]):
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ out[:, k], -30, 30)))
            g = x.T @ (weight * (p - y[:, k])) + ridge @ out[:, k]
            h = (x.T * (weight * np.maximum(p * (1 - p), 1e-4))) @ x + ridge
            out[:, k] -= np.linalg.solve(h, g)
    return out


def chances(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))


def _shape(size: np.ndarray, letters: np.ndarray) -> np.ndarray:
    mean = letters / np.maximum(size, 1)
    return np.c_[np.log(size), np.maximum(np.log(size) - 3, 0), mean / 5, (mean / 5) ** 2]


def _by_document(doc: np.ndarray, docs: int, p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Mean chances of a document's sentences: each counting the same, each counting its words, and the spread of levels."""
    def mean(values, w):
        total = np.bincount(doc, w, docs)
        return np.stack([np.bincount(doc, values[:, k] * w, docs) for k in range(values.shape[1])], axis=1) / np.maximum(total, 1e-9)[:, None]

    level = p.sum(1, keepdims=True)
    plain, by_size = mean(p, np.ones(len(p))), mean(p, size.astype(float))
    return np.c_[plain, by_size, mean(level**2, np.ones(len(p))) - plain.sum(1, keepdims=True) ** 2]


@dataclass
class Model:
    vocabulary: dict[str, int]
    words: np.ndarray
    letters: np.ndarray
    combiner: np.ndarray
    calibration: np.ndarray


def fit(texts: list[str], marks: list[list[int]], folds: int = 3, word_penalty: float = 0.5, letter_penalty: float = 0.5) -> Model:
    """A model from documents and how often readers gave each the marks 1 to 5 (a list of five numbers, not all 0)."""
    given = np.array(marks, dtype=float).reshape(-1, LEVELS)
    y_doc = given[:, ::-1].cumsum(1)[:, ::-1][:, 1:] / given.sum(1, keepdims=True)
    vocabulary: dict[str, int] = {}
    rows, doc, letters_n = [], [], []
    for d, text in enumerate(texts):
        for s in sentences(text):
            ws = tokens(s)
            if ws:
                rows.append([vocabulary.setdefault(number_free(w), len(vocabulary)) for w in ws])
                doc.append(d)
                letters_n.append(sum(len(number_free(w)) for w in ws))
    if not rows:
        base = np.zeros((LEVELS - 1 + 0, LEVELS - 1))
        return Model({}, base[:0], np.zeros((GRAM_BUCKETS, LEVELS - 1)), np.zeros((2 * (LEVELS - 1) + 5, LEVELS - 1)), np.zeros((2 * (LEVELS - 1) + 2, LEVELS - 1)))
    doc, letters_n = np.array(doc), np.array(letters_n, dtype=float)
    letters = Letters(list(vocabulary))
    n = len(vocabulary)
    y = y_doc[doc]
    weight = 1 / np.bincount(doc, minlength=len(texts))[doc]
    mid = y_doc[np.unique(doc)].mean(0)

    def models(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part = Bag([rows[i] for i in np.flatnonzero(keep)])
        return ridge_words(part, n, y[keep] - mid, word_penalty), ridge_letters(part, letters, n, y[keep] - mid, letter_penalty)

    bag = Bag(rows)
    unseen = np.zeros((len(rows), 2 * (LEVELS - 1)))
    for f in range(folds):
        out = doc % folds == f
        if out.any() and not out.all():
            w, g = models(~out)
            part = Bag([rows[i] for i in np.flatnonzero(out)])
            unseen[out] = np.c_[part.mean(w), part.mean(letters.table(g))]
    x = np.c_[unseen, _shape(bag.size, letters_n)]
    combiner = logistic(x, y, 0.1, weight)
    by_doc = _by_document(doc, len(texts), chances(x, combiner), bag.size)
    has = np.bincount(doc, minlength=len(texts)) > 0
    calibration = logistic(by_doc[has], y_doc[has], 0.1)
    w, g = models(np.ones(len(rows), dtype=bool))
    return Model(vocabulary, w.astype(np.float32), g.astype(np.float32), combiner, calibration)


class Scorer(dict):
    """Applies a model; remembers the weights of each distinct spelling (as a dict: its row of `table`)."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.table = np.zeros((4096, 2 * (LEVELS - 1) + 1), dtype=np.float32)

    def __missing__(self, spelling: str) -> int:
        n = self[spelling] = len(self)
        if n >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        m, word = self.model, number_free(spelling)
        at = m.vocabulary.get(word)
        self.table[n, : LEVELS - 1] = 0 if at is None else m.words[at]
        self.table[n, LEVELS - 1 : -1] = m.letters[grams(word)].mean(0)
        self.table[n, -1] = len(word)
        return n

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Chances of level 2, 3, 4, 5 or above by text; NaN for a text without prose."""
        ids, sizes, doc = [], [], []
        number, words = self.__getitem__, _WORD.findall
        for d, text in enumerate(texts):
            for s in sentences(text):
                ws = words(s)
                if ws:
                    ids += map(number, ws)
                    sizes.append(len(ws))
                    doc.append(d)
        out = np.full((len(texts), LEVELS - 1), np.nan)
        if sizes:
            size, doc = np.array(sizes), np.array(doc)
            starts = np.r_[0, np.cumsum(size)[:-1]]
            sums = np.add.reduceat(self.table[np.fromiter(ids, dtype=np.int64, count=len(ids))], starts, axis=0).astype(float)
            x = np.c_[sums[:, :-1] / size[:, None], _shape(size, sums[:, -1])]
            by_doc = _by_document(doc, len(texts), chances(x, self.model.combiner), size)
            has = np.bincount(doc, minlength=len(texts)) > 0
            out[has] = np.minimum.accumulate(chances(by_doc[has], self.model.calibration), axis=1)
        if len(self) > REMEMBERED:
            self.clear()
        return out


def labelled(documents: DataFrame, marks: DataFrame, doc_id: str, text: str, mark: str, most: int = LABELLED) -> tuple[list[str], list[list[int]]]:
    """Texts of at most `most` documents, drawn by hash, and how often each was given the marks 1 to 5. Repeated rows of marks count once, null marks and those off the scale not at all.

    The few ids are looked up in the scan, without a join; the scan of the texts is the only second reading of them.
    """
    counts = marks.distinct().filter(F.col(mark).between(1, LEVELS)).groupBy(doc_id).agg(*[F.count_if(F.col(mark) == k).alias(f"_{k}") for k in range(1, LEVELS + 1)])
    drawn = {r[doc_id]: [r[f"_{k}"] for k in range(1, LEVELS + 1)] for r in counts.orderBy(F.xxhash64(F.lit(3), doc_id), doc_id).limit(most).collect()}
    rows = documents.select(doc_id, F.col(text).alias("_text")).filter(F.col(doc_id).isin(list(drawn))).filter(F.length("_text").between(1, LONGEST)).collect()
    rows.sort(key=lambda r: xxhash.xxh64_intdigest(f"{r[doc_id]} {r['_text']}"))
    return [r["_text"] for r in rows], [drawn[r[doc_id]] for r in rows]


def levels(documents: DataFrame, doc_id: str, text: str, model: Model) -> DataFrame:
    """doc_id, level INT (1 to 5; the highest whose chance is at least a half), expected DOUBLE (mean level) and hard DOUBLE (chance of level 4 or 5).

    All three are null for a null or empty text and for one without prose. Whole texts are read, in one pass, without a shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = dict(documents.dtypes)[doc_id]

    def run(parts):
        scorer = Scorer(shared.value)
        for pdf in parts:
            texts = list(pdf["text"])
            p = np.concatenate([scorer.score(texts[a:b]) for a, b in portions(texts)])
            known = ~np.isnan(p[:, 0])
            level = pd.array(np.where(known, 1 + (p >= 0.5).sum(1), 0), dtype="Int32")
            level[~known] = pd.NA
            yield pd.DataFrame({"doc": pdf["doc"].to_numpy(), "level": level, "expected": 1 + p.sum(1), "hard": p[:, 2]})

    made = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).mapInPandas(run, f"doc {kind}, level int, expected double, hard double")
    null_nan = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("expected", "hard")]
    return made.select(F.col("doc").alias(doc_id), "level", *null_nan)
