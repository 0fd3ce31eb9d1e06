"""A journal that grows while it is read.

Batches that the operators handle whole are also handled as they come in: every line lands in the results exactly once,
also when the stream is stopped in between and goes on from its checkpoint.
"""

from __future__ import annotations

import json
import threading

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from cotejo.sources.journal import EXTRACTION

#: Folders that a target's keys are dealt over.
BUCKETS = 256


def watch_journal(spark: SparkSession, path: str, schema: str = EXTRACTION, files_at_once: int = 1000) -> DataFrame:
    """A stream of a journal's lines, with _broken as of read_journal. New files in the folder are new lines."""
    reader = spark.readStream.schema(f"{schema}, _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken")
    return reader.option("maxFilesPerTrigger", files_at_once).json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_new(stream: DataFrame, key: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Appends to the Parquet table `target` the rows whose key it has not yet, all that are there now; ends then.

    The table has the stream's columns, and query, batch and bucket, which say who wrote a row. A batch that is run again after a failure writes to its own folder again, in
    place of what it left there, so nothing is doubled; the folder bears the query's id, which its checkpoint keeps, so a new checkpoint on an old target adds to
    it and overwrites nothing. Of rows of one key in a batch the smallest stays. Rows of a key that the table had are dropped; count them with journal.repeated. A
    batch looks for its keys only in the buckets of the table that its own keys fall into, and reads nothing but keys there.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        query = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        values = [c for c in batch.columns if c not in key]
        one = batch.groupBy(*key).agg(F.min(F.struct(*values)).alias("_v")).select(*key, "_v.*")
        fresh = one.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")).persist()
        try:
            buckets = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # BUCKETS at most
            out = fresh
            if buckets and _exists(spark, target):
                here = spark.read.schema(batch.select(*key).schema.add("query", "string").add("batch", "long").add("bucket", "integer")).parquet(target)
                seen = here.filter(F.col("bucket").isin(buckets) & ~((F.col("query") == query) & (F.col("batch") == number)))
                on = [F.col(f"n.{k}").eqNullSafe(F.col(f"s.{k}")) for k in ("bucket", *key)]
                out = fresh.alias("n").join(seen.select("bucket", *key).alias("s"), on, "left_anti").select("n.*")
            out.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/query={query}/batch={number}")
        finally:
            fresh.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """kind, start, n: events by window of their own time; a window is final once no event can come that is later than `late`.

    For a stream and for a table alike.
    """
    e = events.withWatermark(at, late) if events.isStreaming else events
    return e.groupBy(F.window(at, window), kind).agg(F.count(F.lit(1)).alias("n")).select(kind, F.col("window.start").alias("start"), "n")


TOTALS = "tried bigint, spent bigint, stop boolean"


def stop_totals(stream: DataFrame, spent: Column, order: str, least: int = 20, share: float = 0.05) -> DataFrame:
    """tried, spent, stop after each batch: a stream's totals, kept in its state, up to the attempt after which it is to stop.

    Attempts are judged one by one, in `order` within a batch: the first one after which at least `least` have been tried and over `share` of them were spent is the last that counts;
    what comes later changes nothing. The rule is about one order, so its state is one row, and a task sees the two columns of one batch, whose size the stream's reader bounds.
    """

    def step(_, parts, state):
        tried, gone, stop = state.get if state.exists else (0, 0, False)
        rows = pd.concat(list(parts), ignore_index=True)
        if not stop and len(rows):
            flags = rows.sort_values("at", kind="stable")["spent"].to_numpy()
            t, s = tried + np.arange(1, len(flags) + 1), gone + np.cumsum(flags)
            over = np.flatnonzero((t >= least) & (s > share * t))
            last = over[0] if len(over) else len(flags) - 1
            tried, gone, stop = int(t[last]), int(s[last]), bool(len(over))
            state.update((tried, gone, stop))
        yield pd.DataFrame({"tried": [tried], "spent": [gone], "stop": [stop]})

    flat = stream.select(F.lit(1).alias("rule"), F.col(order).alias("at"), F.coalesce(spent.cast("int"), F.lit(0)).alias("spent"))
    return flat.groupBy("rule").applyInPandasWithState(step, TOTALS, TOTALS, "update", GroupStateTimeout.NoTimeout)


def stop_when(stream: DataFrame, spent: Column, order: str, checkpoint: str, least: int = 20, share: float = 0.05) -> tuple[int, int, bool]:
    """Follows a harvest as far as it has come, or until it is to stop, and says: tried, spent, stop (see stop_totals).

    The query ends with the batch that says stop; later batches are left unread. Run again on its checkpoint, it goes on from the totals it had.
    """
    said, last = threading.Event(), []

    def hear(batch: DataFrame, _: int) -> None:
        for row in batch.collect():  # a row at most; all parts of the state are committed
            if not said.is_set():
                last[:] = [tuple(row)]
                if row["stop"]:
                    said.set()

    query = stop_totals(stream, spent, order, least, share).writeStream.outputMode("update").foreachBatch(hear).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    while not query.awaitTermination(0.2):
        if said.is_set():
            query.stop()
            break
    if last:
        return last[0]
    kept = stream.sparkSession.read.format("statestore").load(checkpoint) if _exists(stream.sparkSession, f"{checkpoint}/state") else None
    row = kept.select("value.groupState.*").first() if kept is not None else None
    return tuple(row) if row is not None else (0, 0, False)
