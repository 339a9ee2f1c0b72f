"""Small JSON files beside tables, put in place as a whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def place(spark: SparkSession, path: str):
    """The path and its file system, whichever it is."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, system = place(spark, path)
    return system.exists(found)


def write_entry(spark: SparkSession, path: str, entry: dict) -> None:
    """Write under another name, then rename."""
    goal, system = place(spark, path)
    draft, _ = place(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = system.create(draft, True)
    try:
        out.write(bytearray(json.dumps(entry).encode()))
    finally:
        out.close()
    if not system.rename(draft, goal):
        raise OSError(f"could not put {path} in place")


def read_entry(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
