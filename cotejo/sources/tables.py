"""Parquet tables, and intermediate tables written to the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table `name` under `root`; a Parquet file or a folder of them."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    It is the session's spark.checkpoint.dir. Only on a single machine (master local or
    local[...]) may it be unset; then a temporary folder is made and set for the session.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    own = getattr(spark, "_cotejo_work_dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="cotejo-")
        spark._cotejo_work_dir = own
    return own


def cut(df: DataFrame, label: str = "step", by: Sequence[str] = ()) -> DataFrame:
    """Writes `df` once to the shared folder and reads it back.

    Lineage ends there, the rows no longer depend on executors that may be lost, and a result
    that depends on row order or on a random draw is computed exactly once. `by` names columns of few values whose rows are kept in folders of their
    own, so that reading one value reads no other. The table stays until clear() or scratch() takes it away.
    """
    path = work_path(df.sparkSession, label)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, noted for clear()."""
    path = f"{work_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _written(spark).append(path)
    return path


def _written(spark: SparkSession) -> list[str]:
    if not hasattr(spark, "_cotejo_written"):
        spark._cotejo_written = []
    return spark._cotejo_written


def clear(spark: SparkSession, since: int = 0) -> int:
    """Deletes the tables that this session has cut, after the first `since` of them, and says how many. Results that still read them can't be computed any more."""
    gone = _written(spark)[since:]
    del _written(spark)[since:]
    jvm = spark._jvm
    for path in gone:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(gone)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were cut inside; write or collect results before."""
    before = len(_written(spark))
    try:
        yield
    finally:
        clear(spark, before)
