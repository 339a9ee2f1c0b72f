"""Scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from plumbline.sources import schemas

#: A line that is no record, and the file that it is in.
BROKEN, FILE = "broken", "file"


def read_reviews(spark: SparkSession, path: str, keep_broken: bool = False) -> DataFrame:
    """Review JSON lines with the column names used throughout.

    A line that is no record of the schema gives no row. With ``keep_broken`` it is a row
    with the line in the column ``broken``, and its file in ``file``.
    """
    c = F.col
    raw = _json_lines(spark, path, schemas.REVIEW_JSON)
    reviews = raw.select(
        c("reviewerID").alias("src"),
        c("asin").alias("dst"),
        c("overall"),
        c("reviewerName").alias("reviewer_name"),
        c("verified"),
        c("vote"),
        c("reviewTime").alias("review_time"),
        c("unixReviewTime").alias("unix_review_time"),
        c("summary"),
        c("reviewText").alias("review_text"),
        c(BROKEN),
        c(FILE),
    )
    return reviews if keep_broken else valid_rows(reviews)


def read_products(spark: SparkSession, path: str, keep_broken: bool = False) -> DataFrame:
    """[asin, title] from product metadata JSON lines, duplicates removed; ``keep_broken`` as in :func:`read_reviews`."""
    products = _json_lines(spark, path, schemas.METADATA_JSON)
    return products if keep_broken else valid_rows(products).distinct()


def _json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    wanted = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    lines = spark.read.schema(wanted).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).json(path)
    return lines.withColumn(FILE, F.input_file_name())


def _fully_read(lines: DataFrame) -> Column:
    """Always true, in a form that keeps every field in the scan: a field that is not read is not checked."""
    missing = [F.col(c).isNull().cast("int") for c in lines.columns if c not in (BROKEN, FILE)]
    return F.greatest(*missing) < 2


def valid_rows(lines: DataFrame) -> DataFrame:
    """The rows of lines that are records."""
    return lines.where(F.col(BROKEN).isNull() & _fully_read(lines)).drop(BROKEN, FILE)


def broken_lines(lines: DataFrame) -> DataFrame:
    """The lines that are no record, with their file and what could be read of them."""
    return lines.where(F.col(BROKEN).isNotNull() & _fully_read(lines))


def watched(lines: DataFrame) -> tuple[DataFrame, Observation]:
    """The valid rows, and a watch that tells ``broken`` lines once an action has read them all.

    The watch sits in the scan, so a stage that is run again may make it tell too many: it
    shows whether there are broken lines, their table how many.
    """
    seen = Observation()
    return valid_rows(lines.observe(seen, F.count_if(F.col(BROKEN).isNotNull()).alias("broken"))), seen


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet, self-describing unless a schema is given."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_spread(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Parquet for work that is heavy per row, with at least one task per core.

    A scan has one task per row group at most. Where that leaves cores idle (a few
    large files) rows are spread by the hash of ``key``; a scan with enough tasks is
    left alone.
    """
    df = read_table(spark, path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def read_degree_histogram(spark: SparkSession, path: str) -> DataFrame:
    """[degree, frequency] from CSV files with a header line."""
    return spark.read.schema(schemas.DEGREE_CSV).option("header", True).csv(path)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """[token, valence] from tab-separated lines; further columns are ignored."""
    return spark.read.schema(schemas.LEXICON).option("sep", "\t").option("quote", "").csv(path)
