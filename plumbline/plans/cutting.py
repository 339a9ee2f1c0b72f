"""Where long plans are cut.

Cuts go to the shared folder named by ``spark.checkpoint.dir``, so a lost
executor never costs more than the work since the last cut.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Owns what is staged inside: those tables are removed at the end.

    Results must be written before that, or staged with ``outer=True``, which hands them
    to the scope around this one, if there is any. Tables staged outside of any such scope stay,
    for lazy results may still read them; checkpoints are removed by Spark's cleaner if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can write; nothing happens if it is not there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def checkpoint_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; a fresh local one only in local mode."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current is None:
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="run-")
        context.setCheckpointDir(named)
    return named or current


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` now and continue from its reliable checkpoint."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str, outer: bool = False) -> str:
    """A new path under the checkpoint folder, owned by the current scope or by the one around it."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    owners = _scopes[:-1] if outer else _scopes
    if owners:
        owners[-1].append(path)
    return path


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files behind tables that are written.

    It does so when the driver collects garbage, which a driver with little to do may put off
    until the disks are full.
    """
    spark._jvm.System.gc()


@contextmanager
def together_by_one_key(spark: SparkSession) -> Iterator[None]:
    """Inside, tables that lie by one of the columns of a join are joined without a shuffle. What is joined must be written inside."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stage(df: DataFrame, name: str, outer: bool = False, key: str | None = None) -> DataFrame:
    """Write ``df`` as parquet in the checkpoint folder and continue from the table.

    Preferred over :func:`cut` for wide rows read several times, since each later
    reader only fetches the columns it needs. With ``key`` the table is written in buckets of
    it, so joins, sums and windows by that column read it without a shuffle; a bucket
    is read by one task, so no key may be heavy.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name, outer)
    if key is not None:
        buckets, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"staged_{uuid.uuid4().hex}"
        df.repartition(buckets, key).write.option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table, format="parquet")
        staged = spark.table(table)
        spark.sql(f"DROP TABLE {table}")  # the name only: the plan knows files and layout
        return staged
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
