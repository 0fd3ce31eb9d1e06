"""A mix of sources with target shares of all tokens, and a limit on how often a document is used.

Shares are tempered: between the target shares (exponent 0) and the sources' own shares of the tokens (exponent 1) lie the shares
target ** (1 - e) * own ** e, normalised. With equal targets these are the sources' own shares raised to e. The exponent is found by bisection: the
least one whose shares a limit allows, or one whose shares have a given entropy.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotejo.sources import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how a public byte-level vocabulary splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = VOCABULARY) -> int:
    """Tokens of a text; none in a null or empty one."""
    if not text:
        return 0
    return len(_encoder(path).encode_ordinary(text))


def token_counter(path: str = VOCABULARY) -> Callable:
    """A column function: tokens BIGINT of a text, by the vocabulary file at `path`, which every executor must be able to read."""

    @F.pandas_udf("bigint")
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series([count_tokens(t, path) for t in texts], dtype="int64")

    return tokens


def tempered(own: np.ndarray, exponent: float, target: np.ndarray | None = None) -> np.ndarray:
    """Shares in proportion to target ** (1 - exponent) * own ** exponent; without target all targets are equal. A source with nothing of its own, or no target, has no share."""
    own = np.asarray(own, dtype=float)
    target = np.ones_like(own) if target is None else np.asarray(target, dtype=float)
    some = (own > 0) & (target > 0)
    raw = np.zeros_like(own)
    if some.any():
        logs = (1 - exponent) * np.log(target[some]) + exponent * np.log(own[some])
        raw[some] = np.exp(logs - logs.max())
    total = raw.sum()
    return raw / total if total else raw


def entropy(shares: np.ndarray) -> float:
    p = np.asarray(shares, dtype=float)
    p = p[p > 0]
    return float(-(p * np.log(p)).sum())


def exponent_for(own: np.ndarray, test: Callable[[np.ndarray], bool], target: np.ndarray | None = None, steps: int = 60) -> float:
    """The least exponent in [0, 1] whose shares pass `test`, by bisection; test must hold from some exponent on. 1 if none below passes."""
    low, high = 0.0, 1.0
    if test(tempered(own, 0.0, target)):
        return 0.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if test(tempered(own, mid, target)) else (mid, high)
    return high


def exponent_for_entropy(own: np.ndarray, wanted: float) -> float:
    """Exponent whose shares have an entropy of at most `wanted` (it falls as the exponent rises)."""
    return exponent_for(own, lambda w: entropy(w) <= wanted)


def exponent_for_repeats(own: np.ndarray, size: float, repeats: np.ndarray, target: np.ndarray | None = None) -> float:
    """Exponent from which no source is used more than `repeats` times in a mix of `size`."""
    own, repeats = np.asarray(own, dtype=float), np.asarray(repeats, dtype=float)
    return exponent_for(own, lambda w: bool(np.all(w * size <= repeats * own * (1 + 1e-12))), target)


def own_exponents(own: np.ndarray, target: np.ndarray, repeats: np.ndarray, size: float, steps: int = 60) -> np.ndarray:
    """For each source alone: how far the targets must be tempered towards the sources' own shares until the source can give its share of a mix of `size`.

    0 for a source that reaches its target; 1 for one that could not even give its own share, or has nothing. All sources are bisected at once; the shares' common
    divisor is read off a grid of exponents.
    """
    own, target, repeats = (np.asarray(x, dtype=float) for x in (own, target, repeats))
    out = np.zeros(len(own))
    short = repeats * own < target * size
    out[short & (own <= 0)] = 1.0
    at = np.flatnonzero(short & (own > 0))
    some = (own > 0) & (target > 0)
    if len(at):
        grid = np.linspace(0, 1, 1025)
        lt, lo = np.log(target[some]), np.log(own[some])
        logs = np.array([np.logaddexp.reduce((1 - e) * lt + e * lo) for e in grid])
        wanted = lambda e: (1 - e) * np.log(target[at]) + e * np.log(own[at]) - np.interp(e, grid, logs) + math.log(size)
        most = np.log(np.maximum(repeats[at] * own[at], 1e-300))
        low, high = np.zeros(len(at)), np.ones(len(at))
        for _ in range(steps):
            mid = (low + high) / 2
            fits = wanted(mid) <= most
            low, high = np.where(fits, low, mid), np.where(fits, mid, high)
        out[at] = high
    return out


def budgets(own: np.ndarray, target: np.ndarray, repeats: np.ndarray, size: float) -> np.ndarray:
    """Tokens to take of each source for a mix of `size`.

    A source whose exponent (see own_exponents) is 0 gets its target; another gets all it may give: repeats * size of the source. What these leave over is
    given to the sources that still have room, by tempered shares of their tokens, with the least exponent at which none passes its limit; if
    even their own shares pass it, each is filled up in proportion to its tokens as far as its limit goes. A mix that all limits together do not fill is smaller than `size`.
    """
    own, target, repeats = (np.asarray(x, dtype=float) for x in (own, target, repeats))
    limit = own * repeats
    out = np.where(own_exponents(own, target, repeats, size) > 0, limit, np.minimum(target * size, limit))
    missing = target.sum() * size - out.sum()
    room = np.where(limit - out > 1e-9 * size, limit - out, 0.0)
    if missing <= 1e-9 * size or not room.any():
        return out
    if missing >= room.sum():
        return out + room
    base = np.where(room > 0, own, 0.0)
    shares = tempered(base, exponent_for(base, lambda w: bool(np.all(w * missing <= room))))
    if np.all(shares * missing <= room * (1 + 1e-12)):
        return out + np.minimum(shares * missing, room)
    # Filled up to a common multiple of the tokens: sources whose room ends before it stop there.
    ratio = np.divide(room, base, out=np.zeros(len(base)), where=base > 0)
    order = np.argsort(ratio)
    full = np.cumsum(room[order]) - room[order]
    rest = np.cumsum(base[order][::-1])[::-1]
    level = np.divide(missing - full, rest, out=np.full(len(base), np.inf), where=rest > 0)
    k = np.flatnonzero((level <= ratio[order]) & (rest > 0))
    return out + (np.minimum(room, level[k[0]] * base) if len(k) else room)


PLAN = "source string, tokens bigint, target double, repeats int, wanted double, exponent double, reachable boolean, budget double"


def source_plan(sized: DataFrame, targets: DataFrame, source: str, tokens: str, target: str, repeats: str, size: float | None = None) -> DataFrame:
    """A row per source of targets, the columns of PLAN, written once.

    `sized` has documents with their source (spelt as in targets) and tokens; documents of null source count for nothing, those of other sources count for
    the size of the corpus, which is the mix's size unless `size` is given. A source listed twice has its larger target and limit. exponent is the source's own (see own_exponents);
    reachable says exactly whether repeats * tokens is enough for the target. The plan is worked out in one task, from one row per source however many documents there
    are: some ten million sources a GB.
    """
    per = sized.filter(F.col(source).isNotNull()).groupBy(source).agg(F.sum(tokens).cast("bigint").alias("_t"))
    total = per.agg(F.sum("_t")).first()[0] or 0
    whole = float(total if size is None else size)
    aims = targets.groupBy(F.col(source).alias("source")).agg(F.coalesce(F.max(target), F.lit(0.0)).cast("double").alias("target"), F.coalesce(F.max(repeats), F.lit(0)).cast("int").alias("repeats"))
    have = aims.join(per.select(F.col(source).alias("source"), "_t"), "source", "left").select("source", F.coalesce("_t", F.lit(0)).alias("tokens"), "target", "repeats")

    def work(parts):
        got = [p for p in parts if len(p)]
        if got:
            p = pd.concat(got, ignore_index=True).sort_values("source", ignore_index=True)
            own, aim, most = p["tokens"].to_numpy(float), p["target"].to_numpy(float), p["repeats"].to_numpy(float)
            p["wanted"] = aim * whole
            p["exponent"] = own_exponents(own, aim, most, whole)
            p["reachable"] = most * own >= p["wanted"].to_numpy()
            p["budget"] = budgets(own, aim, most, whole)
            yield p

    return cut(have.coalesce(1).mapInPandas(work, PLAN), "plan")


def mix(sized: DataFrame, plan: DataFrame, doc_id: str, source: str, tokens: str, seed: int = 5, together: int = 20_000) -> DataFrame:
    """The documents of the mix: doc_id, source, tokens, copies INT (1 or more). plan: as of source_plan.

    A source is gone through in whole passes and one last part of a pass. For the part, its documents stand in an order drawn by hash, cut into
    blocks of about `together` documents: whole blocks are taken while they fit, and only in the block where the budget ends is it filled document by document. So no task ever
    sorts a source, and a source's tokens miss its budget by less than one document. Documents without tokens are left out.
    """
    passes = F.floor(F.col("budget") / F.col("tokens"))
    want = plan.filter("tokens > 0 AND budget > 0").select(F.col("source").alias("_source"), passes.cast("int").alias("_passes"), (F.col("budget") - F.col("tokens") * passes).alias("_rest"))
    counted = sized.filter(F.col(tokens) > 0)
    many = counted.groupBy(F.col(source).alias("_source")).agg(F.count(F.lit(1)).alias("_docs"))
    bits = F.least(F.greatest(F.ceil(F.log2(F.col("_docs") / together)), F.lit(0)), F.lit(24)).cast("int")
    want = want.join(many, "_source").withColumn("_bits", bits).drop("_docs")
    draw = F.xxhash64(F.lit(seed), F.col(doc_id))
    block = F.when(F.col("_bits") == 0, F.lit(0).cast("bigint")).otherwise(F.expr("shiftright(_draw, 64 - _bits)"))
    docs = counted.join(want, F.col(source) == F.col("_source")).withColumn("_draw", draw).withColumn("_block", block)
    per_block = docs.groupBy("_source", "_block").agg(F.sum(tokens).alias("_sum"), F.max("_rest").alias("_limit"))
    upto = Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    state = per_block.withColumn("_before", F.coalesce(F.sum("_sum").over(upto), F.lit(0))).select(
        F.col("_source").alias("_s"), F.col("_block").alias("_b"), "_before", (F.col("_before") + F.col("_sum") <= F.col("_limit")).alias("_whole"),
        ((F.col("_before") < F.col("_limit")) & (F.col("_before") + F.col("_sum") > F.col("_limit"))).alias("_edge"),
    )
    placed = docs.join(state, (F.col("_source") == F.col("_s")) & (F.col("_block") == F.col("_b")))
    within = Window.partitionBy("_source", "_block").orderBy("_draw", doc_id).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = placed.filter("_edge").withColumn("_more", (F.col("_before") + F.sum(tokens).over(within) <= F.col("_rest")).cast("int"))
    plain = placed.filter("NOT _edge").withColumn("_more", F.col("_whole").cast("int"))
    return plain.unionByName(edge).select(doc_id, source, tokens, (F.col("_passes") + F.col("_more")).alias("copies")).filter("copies > 0")


def sized_documents(documents: DataFrame, doc_id: str, source: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """doc_id, source, tokens BIGINT, written once to the shared folder; documents of null source or without text are left out."""
    kept = documents.filter(F.col(source).isNotNull() & F.col(text).isNotNull() & (F.col(text) != ""))
    return cut(kept.select(doc_id, source, token_counter(path)(F.col(text)).alias("tokens")), "tokens")
