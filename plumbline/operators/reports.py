"""Summaries of graphs, beliefs and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions import buckets


def degree_histogram(vertices: DataFrame) -> DataFrame:
    """[type, degree, frequency]."""
    return vertices.groupBy("type", F.col("deg").alias("degree")).agg(F.count(F.lit(1)).alias("frequency"))


def belief_histogram(beliefs: DataFrame, column: str = "p_fraud", series: str = "category") -> DataFrame:
    """[series, belief, nodes]: nodes per step 0.0, 0.1 ... 1.0; nodes without a belief left out."""
    return (
        beliefs.where(F.col(column).isNotNull())
        .groupBy(series, buckets.nearest_tenth(F.col(column)).alias("belief"))
        .agg(F.count(F.lit(1)).alias("nodes"))
    )


def node_class_counts(beliefs: DataFrame) -> DataFrame:
    """[type, class, nodes]: fraudster/honest users, bad/good products, unknown ones."""

    def side(kind: str, first: str, second: str, names: tuple[str, str]) -> Column:
        return F.when(
            F.col("type") == kind,
            F.when(F.col(first).isNull(), "unknown")
            .when(F.round(F.col(first) - F.col(second), 9) > 0, names[0])
            .otherwise(names[1]),
        )

    verdict = F.coalesce(
        side("u", "p_fraud", "p_honest", ("fraudster", "honest")), side("p", "p_bad", "p_good", ("bad", "good"))
    )
    return beliefs.groupBy("type", verdict.alias("class")).agg(F.count(F.lit(1)).alias("nodes"))


def review_label_distribution(labelled: DataFrame, base: str) -> DataFrame:
    """Label shares per tenth of ``base`` (a belief in [0, 1]), in whole percent.

    [bucket, lower, upper, reviews, fake_pct, uncertain_pct, genuine_pct]; tenths
    without reviews do not appear. Needs ``label``; rows without one are left out.
    """
    tenth = buckets.tenth(F.col(base))
    counted = (
        labelled.where(F.col(base).isNotNull())
        .groupBy(tenth.alias("bucket"))
        .agg(
            F.count("label").alias("reviews"),
            *[F.count_if(F.col("label") == label).alias(label) for label in ("fake", "uncertain", "genuine")],
        )
        .where("reviews > 0")
    )
    return counted.select(
        "bucket",
        (F.col("bucket") / 10).alias("lower"),
        ((F.col("bucket") + 1) / 10).alias("upper"),
        "reviews",
        *[
            buckets.whole_percent(F.col(label), F.col("reviews")).alias(f"{label}_pct")
            for label in ("fake", "uncertain", "genuine")
        ],
    )


def label_shares(labelled: DataFrame) -> DataFrame:
    """[label, reviews, share] over all labelled reviews."""
    counts = labelled.groupBy("label").agg(F.count("label").alias("reviews")).where("reviews > 0")
    # three rows at most from here on
    return counts.withColumn("share", F.col("reviews") / F.sum("reviews").over(Window.partitionBy()))


def label_by_singleton(labelled: DataFrame) -> DataFrame:
    """[label, single_user, single_product, reviews]: who occurs once, per label."""
    return (
        labelled.groupBy(
            "label", (F.col("u_deg") == 1).alias("single_user"), (F.col("p_deg") == 1).alias("single_product")
        )
        .agg(F.count("label").alias("reviews"))
        .where("reviews > 0")
    )


def convergence(snapshots: DataFrame) -> DataFrame:
    """Sums of the four messages per ``iteration`` and previous minus current.

    [iteration, fraud, honest, bad, good, fraud_diff, honest_diff, bad_diff, good_diff].
    """
    sums = snapshots.groupBy("iteration").agg(
        F.sum("mu_fraud").alias("fraud"),
        F.sum("mu_honest").alias("honest"),
        F.sum("mp_bad").alias("bad"),
        F.sum("mp_good").alias("good"),
    )
    # one row per iteration from here on
    order = Window.orderBy("iteration")
    return sums.select(
        "*", *[(F.lag(c).over(order) - F.col(c)).alias(f"{c}_diff") for c in ("fraud", "honest", "bad", "good")]
    )
