"""Passages of test items inside the documents of a corpus.

A document contains an item when at least half of the item's words stand in it in unbroken runs of eight
words or more. An item of m words with u different eight-word shingles then shares at least t = ceil(m / 2) / (8 r) of
them with the document (r: how often the item repeats its most repeated shingle), so whatever u - t + 1 of
them one takes, the document has one: the prefix. Taking the rarest of the corpus keeps the join small. That is the positional bound too: a first common
shingle at place p of the item's order leaves u - p + 1 that can be common, which is fewer than t beyond the prefix; within it, one hit and the t - 1 shingles after it
always suffice, so counting hits prunes nothing more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotejo.llm.textform import bare
from cotejo.llm.words import Hashes, portions, rolling, spellings
from cotejo.sources import cut

SHINGLE = 8
#: Item shingles that a task looks for in one pass (8 bytes each); more items mean more passes over the corpus.
PER_PASS = 2_000_000
#: Bits of the first look-up table: 2 to this power.
_TABLE_BITS = 22


def item_words(items: DataFrame, item_id: str, text: str, keep: str) -> DataFrame:
    """item BIGINT, m INT, words ARRAY<STRING> (bare forms), grams ARRAY<BIGINT> (hashes of the runs)."""

    def run(parts):
        hashes = Hashes()
        for pdf in parts:
            words = [spellings(t) if t is not None else [] for t in pdf["text"]]
            grams = [rolling(np.array([hashes[w] for w in ws], dtype=np.uint64), SHINGLE).view(np.int64) for ws in words]
            yield pd.DataFrame({"item": pdf["item"], "m": [len(ws) for ws in words], "words": pd.Series([[bare(w) for w in ws] for ws in words], dtype=object), "grams": pd.Series(grams, dtype=object)})

    return items.select(F.col(item_id).cast(keep).alias("item"), F.col(text).alias("text")).mapInPandas(run, f"item {keep}, m int, words array<string>, grams array<bigint>")


def matching_runs(documents: DataFrame, doc_id: str, text: str, wanted: np.ndarray, kind: str) -> DataFrame:
    """Longest runs of document words of which every eight in a row hash to a wanted value: doc, start INT (the place of its first word in the text), run ARRAY<STRING>.

    One pass over whole texts. `wanted` (sorted, bounded by PER_PASS) goes to the tasks.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(wanted)

    def run(parts):
        want = shared.value
        mask = np.uint64((1 << _TABLE_BITS) - 1)
        table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        table[(want & mask).astype(np.int64)] = True
        hashes = Hashes()
        for docs, texts in ((pdf["doc"].to_numpy()[a:b], pdf["text"].iloc[a:b]) for pdf in parts for a, b in portions(pdf["text"])):
            found = ([], [], [])
            words, ends = [], []
            for t in texts:
                if t is not None:
                    words += spellings(t)
                ends.append(len(words))
            if len(words) >= SHINGLE:
                h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
                grams = rolling(h, SHINGLE)
                at = np.flatnonzero(table[(grams & mask).astype(np.int64)])
                at = at[np.isin(grams[at], want)]
                doc = np.searchsorted(ends, at, side="right")
                inside = at + SHINGLE <= np.asarray(ends)[doc]
                at, doc = at[inside], doc[inside]
                if len(at):
                    first = np.flatnonzero(np.r_[True, (np.diff(at) > 1) | (np.diff(doc) > 0)])
                    for a, b in zip(first, np.r_[first[1:], len(at)], strict=True):
                        found[0].append(docs[doc[a]])
                        found[1].append(at[a] - (ends[doc[a] - 1] if doc[a] else 0))
                        found[2].append([bare(w) for w in words[at[a] : at[b - 1] + SHINGLE]])
            yield pd.DataFrame({"doc": found[0], "start": np.array(found[1], dtype=np.int32), "run": pd.Series(found[2], dtype=object)})

    return documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).mapInPandas(run, f"doc {kind}, start int, run array<string>")


def _grams(words: str) -> F.Column:
    """The eight-word runs of an array of words, as texts, in order."""
    places = F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(words, i, F.lit(SHINGLE)), " "))


def _in_window(matches: F.Column, width: F.Column) -> F.Column:
    """The most item words that matches (structs of at, the place in the document, and pos, that in the item) cover within `width` words of the document."""
    covered = lambda ps: F.size(F.array_distinct(F.flatten(F.transform(ps, lambda p: F.sequence(p["pos"], p["pos"] + (SHINGLE - 1))))))
    return F.array_max(F.transform(matches, lambda s: covered(F.filter(matches, lambda p: (p["at"] >= s["at"]) & (p["at"] + SHINGLE <= s["at"] + width)))))


def leaks(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, least: float = 0.5, window: float | None = None) -> DataFrame:
    """Documents and the items they contain: doc_id, item_id, words INT (of the item), found INT (of them, in the document).

    Case, accents, look-alike characters, punctuation, entities, tags, invisible characters, line ends and line-end hyphens
    make no difference. Words are compared, not hashes. Null and empty texts contain nothing, items of under eight words are contained nowhere, repeated rows of an id count once; of several texts under one id the first in order counts.
    `window` asks for the item's words within so many times the item's own length of the document's words; by default they may stand anywhere in it.
    """
    kinds = dict(documents.dtypes)[doc_id], dict(items.dtypes)[item_id]
    one = items.groupBy(item_id).agg(F.min(item_text).alias(item_text))
    known = cut(item_words(one, item_id, item_text, kinds[1]).filter(F.size("grams") > 0), "items")
    passes = -(-known.select(F.sum(F.size("grams"))).first()[0] // PER_PASS) if known.take(1) else 0
    runs = None
    for p in range(passes):
        hashed = known.select(F.explode("grams").alias("g")).distinct().filter(F.pmod("g", F.lit(passes)) == p)
        wanted = np.sort(hashed.toPandas()["g"].to_numpy(np.int64).view(np.uint64))
        part = matching_runs(documents, doc_id, text, wanted, kinds[0])
        runs = part if runs is None else runs.unionAll(part)
    empty = f"`{doc_id}` {kinds[0]}, `{item_id}` {kinds[1]}, words int, found int"
    if runs is None:
        return documents.sparkSession.createDataFrame([], empty)
    runs = cut(runs, "runs")

    of_item = known.select("item", "m", F.posexplode(_grams("words")).alias("pos", "gram"))
    places = runs.select("doc", "start", F.posexplode(_grams("run")).alias("_at", "gram")).select("doc", "gram", (F.col("start") + F.col("_at")).alias("at"))
    of_doc = places.select("doc", "gram").distinct()
    rarity = of_doc.groupBy("gram").agg(F.count(F.lit(1)).alias("docs"))
    ranked = (
        of_item.groupBy("item", "m", "gram").agg(F.count(F.lit(1)).alias("times"))
        .join(rarity, "gram", "left")
        .withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("docs", F.lit(0)), "gram")))
    )
    per_item = Window.partitionBy("item")
    must = F.ceil(F.ceil(F.col("m") * F.lit(least)) / (SHINGLE * F.max("times").over(per_item)))
    prefix = (
        ranked.withColumn("length", F.count(F.lit(1)).over(per_item) - must + 1).withColumn("repeats", F.max("times").over(per_item))
        .filter((F.col("place") <= F.col("length")) & F.col("docs").isNotNull()).select("item", "m", "repeats", "gram")
    )
    # Each of the document's different shingles covers eight words of an item at most, wherever the item has it.
    room = of_doc.groupBy("doc").agg((F.count(F.lit(1)) * SHINGLE).alias("room"))
    shortest = known.agg(F.min("m")).first()[0]
    most = of_item.groupBy("item", "gram").count().agg(F.max("count")).first()[0]
    able = of_doc.join(room.filter(F.col("room") * most >= F.ceil(F.lit(shortest * least))), "doc")
    pairs = able.join(prefix, "gram").filter(F.col("room") * F.col("repeats") >= F.ceil(F.col("m") * F.lit(least))).select("doc", "item").distinct()
    if window is not None:
        matched = pairs.join(places, "doc").join(of_item, ["item", "gram"]).groupBy("doc", "item", "m").agg(F.collect_set(F.struct("at", "pos")).alias("_p"))
        counted = matched.select("doc", "item", "m", _in_window(F.col("_p"), F.ceil(F.col("m") * F.lit(window))).alias("found"))
        return counted.filter(F.col("found") >= F.col("m") * F.lit(least)).select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), F.col("m").alias("words"), "found")
    shared = pairs.join(of_doc, "doc").join(of_item, ["item", "gram"])
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.collect_set("pos"), lambda p: F.sequence(p, p + (SHINGLE - 1))))))
    counted = shared.groupBy("doc", "item", "m").agg(covered.alias("found"))
    return counted.filter(F.col("found") >= F.col("m") * F.lit(least)).select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), F.col("m").alias("words"), "found")
