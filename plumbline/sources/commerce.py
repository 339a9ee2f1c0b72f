"""Order tables seen as reviews: a customer reviews a part with every order line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.sources.readers import read_spread

# tables that start long chains of work, with the column that spreads their rows
_SPREAD = {"lineitem": "l_orderkey", "documents": "doc_id"}

#: The key by which reviews with one ``dst`` lie together, where a caller wants to profit from it.
PLACE = "_part"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}.parquet"
    return read_spread(spark, path, _SPREAD[name]) if name in _SPREAD else spark.read.parquet(path)


def _epoch_seconds(moment: str) -> Column:
    """Seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    day = F.unix_date(F.to_date(moment)).cast("bigint")
    return day * 86400 + F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)


def reviews(spark: SparkSession, folder: str, placed: bool = False) -> DataFrame:
    """All order lines as reviews of parts by customers.

    ``compound`` is a stand-in sentiment taken from the discount; ``doc_id`` points
    at the document that serves as the review's text. Customers meet their orders first, so
    the many order lines are shuffled once less. With ``placed`` there is a column ``PLACE`` too, and
    if no two customers have one key, ``reviewer_name`` is only what ``src`` leaves open of it: equal
    rows stay equal and their order is the same, but names are not shuffled.
    """
    c = F.col
    line = table(spark, folder, "lineitem")
    customer = table(spark, folder, "customer").select("c_custkey", "c_name")
    name = c("c_name")
    if placed and customer.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        customer = customer.select("c_custkey", F.col("c_name").isNotNull().alias("_named"))
        name = F.when(c("_named"), "")
    order = table(spark, folder, "orders").select("o_orderkey", "o_custkey").join(customer, c("o_custkey") == c("c_custkey"))
    part = table(spark, folder, "part").select("p_partkey", "p_type")
    documents = table(spark, folder, "documents").agg(F.count(F.lit(1)).alias("n")).scalar()
    number = c("l_linenumber")
    vote = (
        F.when(number == 1, F.lit(None).cast("string"))
        .when(number == 2, "")
        .when(number == 7, F.concat(F.lit("1,"), (100 + c("l_orderkey") % 900).cast("string")))
        .otherwise((c("l_orderkey") % 40).cast("string"))
    )
    return (
        line.join(order, c("l_orderkey") == c("o_orderkey"))
        .join(part, c("l_partkey") == c("p_partkey"))
        .select(
            F.concat(F.lit("u"), c("o_custkey").cast("string")).alias("src"),
            F.concat(F.lit("p"), c("l_partkey").cast("string")).alias("dst"),
            (1 + c("l_quantity").cast("int") % 5).alias("overall"),
            (c("l_returnflag") != "R").alias("verified"),
            vote.alias("vote"),
            F.concat(name, F.when(number == 3, " Jr").otherwise("")).alias("reviewer_name"),
            _epoch_seconds("l_shipdate").alias("unix_review_time"),
            F.round(c("l_discount") * 20 - 1, 2).alias("compound"),
            (c("l_orderkey") % documents).alias("doc_id"),
            c("p_type").alias("category"),
            *_place(placed),
        )
    )


def _place(placed: bool) -> list[Column]:
    return [F.col("l_partkey").alias(PLACE)] if placed else []


def offer_reviews(spark: SparkSession, folder: str, placed: bool = False) -> DataFrame:
    """All order lines as reviews of one supplier's offer of a part by one-off accounts.

    Every order is its own account and an offer is a part, a supplier and a line
    status, so many accounts and offers occur once and the graph falls apart into
    many components. With ``placed`` there is a column ``PLACE`` too.
    """
    c = F.col
    line = table(spark, folder, "lineitem")
    part = table(spark, folder, "part").select("p_partkey", "p_type")
    return line.join(part, c("l_partkey") == c("p_partkey")).select(
        F.concat(F.lit("u"), c("l_orderkey").cast("string")).alias("src"),
        F.concat_ws("-", F.concat(F.lit("p"), c("l_partkey").cast("string")), c("l_suppkey").cast("string"), "l_linestatus").alias("dst"),
        (1 + c("l_quantity").cast("int") % 5).alias("overall"),
        (c("l_returnflag") != "R").alias("verified"),
        (c("l_orderkey") % 40).cast("string").alias("vote"),
        _epoch_seconds("l_shipdate").alias("unix_review_time"),
        F.round(c("l_discount") * 20 - 1, 2).alias("compound"),
        c("p_type").alias("category"),
        *_place(placed),
    )


def account_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """[src, dst]: all order lines as reviews of parts by one-off accounts."""
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("u"), F.col("l_orderkey").cast("string")).alias("src"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"),
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    """[asin, title] of all parts."""
    return table(spark, folder, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("asin"), F.col("p_name").alias("title")
    )
