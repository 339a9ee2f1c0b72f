"""Scoring reviews from their fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import parsing, scoring


def parse_fields(df: DataFrame) -> DataFrame:
    """Add ``votes`` and ``rating_weight`` from ``vote`` and ``overall``."""
    return df.withColumns(
        {
            "votes": parsing.vote_count(F.col("vote")),
            "rating_weight": parsing.rating_weight(F.col("overall")),
        }
    )


def repair_zero_compound(df: DataFrame) -> DataFrame:
    """Give reviews whose ``compound`` is 0 a sentiment.

    Text without any charged word falls back on the stars; otherwise the stronger
    of ``pos`` and ``neg`` becomes the compound. ``pos_or_neg`` is refreshed.
    """
    flat = F.col("compound") == 0
    wordless = flat & ((F.col("neu") == 1) | ((F.col("pos") == 0) & (F.col("neg") == 0)))
    stand_in = scoring.rating_sentiment(F.col("overall"))
    repaired = df.withColumn("_stand_in", stand_in).withColumns(
        {
            "neg": F.when(wordless, F.col("_stand_in.neg")).otherwise(F.col("neg")),
            "neu": F.when(wordless, F.col("_stand_in.neu")).otherwise(F.col("neu")),
            "pos": F.when(wordless, F.col("_stand_in.pos")).otherwise(F.col("pos")),
            "compound": F.when(wordless, F.col("_stand_in.compound"))
            .when(flat, scoring.stronger_side(F.col("pos"), F.col("neg")))
            .otherwise(F.col("compound")),
        }
    )
    return repaired.withColumn("pos_or_neg", scoring.stronger_side(F.col("pos"), F.col("neg"))).drop("_stand_in")


def review_score(
    df: DataFrame,
    rating_weight: float = 1.0,
    text_weight: float = 1.0,
    vote_weight: float = 0.01,
    tie: str = "rating",
) -> DataFrame:
    """Add the signed score ``s``; ``vote`` becomes the number of votes.

    Needs ``overall``, ``vote`` (text) and ``compound``. A rating outside 1..5 gives
    a null score; :func:`rejected_rows` counts those.
    """
    s = score(rating_weight, text_weight, vote_weight, tie)
    return df.withColumns({"s": s, "vote": parsing.vote_count(F.col("vote"))})


def score(rating_weight: float = 1.0, text_weight: float = 1.0, vote_weight: float = 0.01, tie: str = "rating") -> Column:
    """The signed score ``s`` of :func:`review_score` alone."""
    return scoring.signed_score(
        parsing.rating_weight(F.col("overall")), F.col("compound"), parsing.vote_count(F.col("vote")),
        rating_weight, text_weight, vote_weight, tie,
    ).alias("s")


def rejected_counts() -> dict[str, Column]:
    """Aggregates: reviews read, with an unusable rating, with votes that are no number."""
    vote = F.col("vote")
    return {
        "reviews": F.count(F.lit(1)),
        "bad_rating": F.count_if(parsing.rating_weight(F.col("overall")).isNull()),
        "bad_vote": F.count_if((F.length(vote) > 0) & parsing.vote_number(vote).isNull()),
    }


def rejected_rows(df: DataFrame) -> DataFrame:
    """One row of :func:`rejected_counts`."""
    return df.agg(*[count.alias(name) for name, count in rejected_counts().items()])
