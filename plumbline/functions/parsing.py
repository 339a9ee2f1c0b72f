"""Turning raw review fields into numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Weight of each star rating.
RATING_WEIGHTS = {1: -1.0, 2: -0.8, 3: 0.3, 4: 0.8, 5: 1.0}


def vote_number(vote: Column) -> Column:
    """Helpful votes as a long; null where the text is not a number."""
    return F.regexp_replace(vote, ",", "").try_cast("bigint")


def vote_count(vote: Column) -> Column:
    """Helpful votes with thousands commas removed; empty, null or malformed is 0."""
    return F.coalesce(vote_number(vote), F.lit(0).cast("bigint"))


def rating_stars(overall: Column) -> Column:
    """Whole stars, dropping any fraction."""
    return overall.cast("double").try_cast("int")


def rating_weight(overall: Column) -> Column:
    """Weight of a star rating; null outside the five known ratings."""
    stars = rating_stars(overall)
    weight = F.lit(None).cast("double")
    for star, value in RATING_WEIGHTS.items():
        weight = F.when(stars == star, F.lit(value)).otherwise(weight)
    return weight
