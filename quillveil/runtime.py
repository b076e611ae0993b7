"""Helpers shared by all operators: tables, work folders, size-checked broadcasts, skew-safe lookups."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; the size is checked before the hint is given.
BROADCAST_ROWS = 20_000
#: A key is hot when it holds more than this share of the rows; so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 0.001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables.

    It is the one that the session names in ``spark.checkpoint.dir``, which all executors share. Only where the
    setting is missing and the session is local a folder of this machine is used; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "quillveil-work")
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the work folder that nothing has been written to."""
    return f"{work_dir(spark)}/quillveil/{name}-{uuid.uuid4().hex}"


_WRITTEN: list[tuple[SparkSession, str]] = []


def remove_written(spark: SparkSession) -> None:
    """Delete the intermediate tables of a session; nothing that was made of them may be computed afterwards."""
    jvm = spark.sparkContext._jvm
    for owner, path in [x for x in _WRITTEN if x[0] is spark]:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _WRITTEN.remove((owner, path))


def _remove_written() -> None:
    for spark in {id(s): s for s, _ in _WRITTEN}.values():
        try:
            remove_written(spark)
        except Exception:  # noqa: BLE001, S112 - the session is gone already
            continue


def written(df: DataFrame, name: str, spark: SparkSession | None = None) -> DataFrame:
    """Write a table to the shared work folder and read it again: this cuts its lineage and survives lost executors.

    What is made of it may be computed at any time later, so the table stays until the program or its session ends.
    """
    spark = spark or df.sparkSession
    path = fresh_path(spark, name)
    if not _WRITTEN:
        atexit.register(_remove_written)
    _WRITTEN.append((spark, path))
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_checked(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if the table has at most ``max_rows`` rows; else leave the join to Spark.

    The count stops at ``max_rows + 1`` rows, so that it stays cheap on a large table.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def lookup_join(rows: DataFrame, entries: DataFrame, keys: Sequence[str], weight: str, total: int, hot_share: float = HOT_SHARE) -> DataFrame:
    """Inner join of rows with a dictionary, unique by ``keys``, without a hot partition.

    ``weight`` is the dictionary's column with the number of rows of each key, ``total`` the sum of it. Keys that hold
    more than ``hot_share`` of all rows are at most ``1 / hot_share`` many, so they are broadcast; all other rows are
    joined by a shuffle on the keys, in which no key is hot any more. Keys must be non-null. ``weight`` is dropped.
    """
    keys = list(keys)
    least = total * hot_share
    hot, cold = entries.filter(F.col(weight) > least).drop(weight), entries.filter(F.col(weight) <= least).drop(weight)
    by_hot = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return by_hot.unionByName(rest.join(cold, keys))
