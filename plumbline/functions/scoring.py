"""Signed review score from rating weight, text sentiment and helpful votes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plumbline.functions.parsing import rating_stars

# Fixed value: sentiment per star used when the text says nothing.
FALLBACK_STEP = 0.02


def signed_score(
    rating: Column,
    sentiment: Column,
    votes: Column,
    rating_weight: float = 1.0,
    text_weight: float = 1.0,
    vote_weight: float = 0.01,
    tie: str = "rating",
) -> Column:
    """Weighted mean of rating and sentiment, pushed away from 0 by votes, in [-1, 1].

    ``rating`` is already a weight (see :func:`plumbline.functions.parsing.rating_weight`).
    A score that would be exactly 0 takes the share of the ``tie`` side alone.
    """
    if tie not in ("rating", "text"):
        raise ValueError(f"tie must be 'rating' or 'text', not {tie!r}")
    total = float(rating_weight) + float(text_weight)
    mean = (rating * F.lit(float(rating_weight)) + sentiment * F.lit(float(text_weight))) / F.lit(total)
    push = votes * F.lit(float(vote_weight))
    tie_break = (rating if tie == "rating" else sentiment) / F.lit(total)
    raised = F.least(mean + push, F.lit(1.0))
    return (
        F.when(mean < 0, F.greatest(mean - push, F.lit(-1.0)))
        .when(mean >= 0, F.when(raised == 0, tie_break).otherwise(raised))
    )


def stronger_side(pos: Column, neg: Column) -> Column:
    """Positive share if it is at least the negative one, else minus the negative share."""
    return F.when(pos >= neg, pos).otherwise(-neg)


def rating_sentiment(overall: Column) -> Column:
    """Small stand-in sentiment struct(neg, neu, pos, compound) from the stars alone."""
    stars = rating_stars(overall)
    liked = stars > 3
    size = F.when(liked, stars * F.lit(FALLBACK_STEP)).otherwise((5 - stars) * F.lit(FALLBACK_STEP))
    zero = F.lit(0.0)
    return F.struct(
        F.when(liked, zero).otherwise(size).alias("neg"),
        zero.alias("neu"),
        F.when(liked, size).otherwise(zero).alias("pos"),
        F.when(liked, size).otherwise(-size).alias("compound"),
    )
