"""Tables bucketed by a key, which joins, sums and windows by that key read without a shuffle.

The bucket layout lives in a small entry beside the files, so any session can read the
table as clustered; no metastore has to remember it. Who reads it otherwise sees plain
parquet.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline.plans.skew import GROUP_LIMIT, heavy_keys, if_any
from plumbline.sources.entries import exists, read_entry, write_entry
from plumbline.sources.writers import write_table

ENTRY = "_clustered/layout.json"  # readers of the table pass over names with an underscore


def write_clustered(df: DataFrame, path: str, key: str, buckets: int | None = None, limit: int = GROUP_LIMIT) -> bool:
    """Write ``df`` in buckets of ``key``, sorted by it within each; the session's shuffle partitions by default.

    A bucket is read by one task. So if some key has more than ``limit`` rows, which would
    make its bucket as heavy, the table is written plainly instead. Returns whether it is
    clustered. Rows without a key share a bucket and count as one key. An existing path is
    an error.
    """
    spark = df.sparkSession
    if exists(spark, path):
        raise FileExistsError(path)
    crowded = if_any(heavy_keys(df.withColumn("_key", F.coalesce(F.col(key).cast("string"), F.lit(""))), "_key", limit))
    if crowded is not None:
        write_table(df, path)
        return False
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"clustered_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: files at a given path stay
    write_entry(spark, f"{path}/{ENTRY}", {"key": key, "buckets": buckets, "schema": df.schema.jsonValue()})
    return True


def read_clustered(spark: SparkSession, path: str) -> DataFrame:
    """The table with its layout, or as plain parquet if it has none."""
    if not exists(spark, f"{path}/{ENTRY}"):
        return spark.read.parquet(path)
    entry = read_entry(spark, f"{path}/{ENTRY}")
    fields = T.StructType.fromJson(entry["schema"]).fields
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    name, place = f"clustered_{uuid.uuid4().hex}", path.replace("\\", "\\\\").replace("'", "\\'")
    layout = f"CLUSTERED BY (`{entry['key']}`) SORTED BY (`{entry['key']}`) INTO {entry['buckets']} BUCKETS"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {layout} LOCATION '{place}'")
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the plan knows files and layout
    return table
