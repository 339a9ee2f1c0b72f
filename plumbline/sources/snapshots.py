"""A numbered series of tables, one ``iteration=N`` folder each, and a manifest of finished ones.

The number is an integer partition column, so 10 sorts after 9 and a reader of
some iterations opens only their folders.

A round counts once its entry is in the manifest: a small file, written when the table is
complete and put in place by a rename. Readers go by the manifest, so what a crash left of
a table is never read, and a later attempt at that round replaces it. An entry holds the
round's row count, observed on the write itself, and its schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from plumbline.plans.cutting import remove
from plumbline.sources.entries import place, read_entry, write_entry

COLUMN = "iteration"
MANIFEST = "_rounds"  # readers of the tables pass over names with an underscore


def _folder(root: str, iteration: int) -> str:
    return f"{root.rstrip('/')}/{COLUMN}={iteration}"


def _entry(root: str, iteration: int) -> str:
    return f"{root.rstrip('/')}/{MANIFEST}/{iteration}.json"


def write_snapshot(df: DataFrame, root: str, iteration: int, mode: str = "errorifexists") -> None:
    """Write one round and enter it in the manifest.

    What an unfinished attempt left is replaced. A finished round is an error unless
    ``mode`` is ``overwrite``; it then stops counting until the new one is complete.
    """
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError(f"mode must be 'errorifexists' or 'overwrite', not {mode!r}")
    spark = df.sparkSession
    if iteration in committed(spark, root):
        if mode == "errorifexists":
            raise FileExistsError(f"round {iteration} is finished in {root}")
        remove(spark, _entry(root, iteration))
    written = Observation()
    df.observe(written, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(_folder(root, iteration))
    _commit(spark, root, iteration, {COLUMN: iteration, "rows": written.get["rows"], "schema": df.schema.jsonValue()})


def _commit(spark: SparkSession, root: str, iteration: int, entry: dict) -> None:
    write_entry(spark, _entry(root, iteration), entry)


def committed(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the finished rounds in ascending order; no table is opened for it."""
    folder, system = place(spark, f"{root.rstrip('/')}/{MANIFEST}")
    if not system.exists(folder):
        return []
    names = [status.getPath().getName() for status in system.listStatus(folder)]
    return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json"))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """[iteration, rows] of the finished rounds."""
    wanted = [(i, _read_entry(spark, root, i)["rows"]) for i in committed(spark, root)]
    return spark.createDataFrame(wanted, f"{COLUMN} int, rows bigint")


def _read_entry(spark: SparkSession, root: str, iteration: int) -> dict:
    if iteration not in committed(spark, root):
        raise FileNotFoundError(f"no finished round {iteration} in {root}")
    return read_entry(spark, _entry(root, iteration))


def read_snapshot(spark: SparkSession, root: str, iteration: int, schema: T.StructType | None = None) -> DataFrame:
    """One finished round without the iteration column."""
    entry = _read_entry(spark, root, iteration)
    return spark.read.schema(schema or T.StructType.fromJson(entry["schema"])).parquet(_folder(root, iteration))


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """All finished rounds with an integer ``iteration`` column."""
    found = committed(spark, root)
    if not found:
        raise FileNotFoundError(f"no finished round in {root}")
    df = spark.read.option("basePath", root).parquet(*[_folder(root, i) for i in found])
    return df.withColumn(COLUMN, F.col(COLUMN).cast("int"))


def last_iteration(spark: SparkSession, root: str) -> int | None:
    """Highest finished round, to resume from; None if there is none."""
    return max(committed(spark, root), default=None)
