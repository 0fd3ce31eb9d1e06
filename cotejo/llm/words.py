"""Words of marked-up, typeset or wrapped text, as arrays of hashes."""

from __future__ import annotations

import html
import re
import unicodedata as ud

import numpy as np
import xxhash

from cotejo.llm.textform import _IGNORED, bare

_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|a|font|mark|small|big|abbr|sup|sub|wbr)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z!?][^<>]*>")
_ENTITY = re.compile(r"&(?:#|[A-Za-z])")
_HYPHENATED = re.compile(r"(?<=[^\W\d_])[-‐]\s*\n\s*(?=[^\W\d_])")
_WORD = re.compile(r"\w+")
#: Distinct spellings remembered by a Python worker.
REMEMBERED = 2_000_000


def unmarked(text: str) -> str:
    """Text without entities, tags, invisible characters and line-end hyphens; line breaks stay."""
    if "&" in text and _ENTITY.search(text):
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if not text.isascii():
        text = ud.normalize("NFC", text)
        if _IGNORED.search(text):
            text = _IGNORED.sub("", text)
    if "-\n" in text or "‐\n" in text or _HYPHENATED.search(text):
        text = _HYPHENATED.sub("", text)
    return text


def spellings(text: str) -> list[str]:
    """The words of a text as they stand there."""
    text = unmarked(text)
    return _WORD.findall(text.replace("_", " ") if "_" in text else text)


def portions(texts, most: int = 2_000_000):
    """Ranges (first, after) of consecutive texts, of about `most` characters each, so that batches of long texts don't fill the memory."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t is not None else 0
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts) or not len(texts):
        yield first, len(texts)


class Hashes(dict):
    """64-bit hash of each spelling's bare form, worked out once per distinct spelling."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(bare(word))
        return h


#: Multiplier of the rolling hash.
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; len(hashes) - n + 1 of them."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * _BASE + hashes[i : i + size]
    return out ^ (out >> np.uint64(29))
