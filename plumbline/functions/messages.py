"""Belief-propagation arithmetic for binary variables.

A message pair (first, second) is kept as its log-odds ``ln(first / second)`` and
its total ``first + second``. Products of messages then become sums, which Spark
combines before the shuffle and which cannot underflow.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Compatibility of user state (rows fraud, honest) with product
# state (columns bad, good) for a positive and a negative review.
EPSILON = 0.1
POSITIVE = ((1 - 2 * EPSILON, 2 * EPSILON), (EPSILON, 1 - EPSILON))
NEGATIVE = ((2 * EPSILON, 1 - 2 * EPSILON), (1 - EPSILON, EPSILON))

_FAR = 700.0  # beyond this exp() leaves the double range


def log_odds(first: Column, second: Column) -> Column:
    return F.log(first) - F.log(second)


def first_share(logit: Column) -> Column:
    """Probability of the first value, 1 / (1 + e^-x)."""
    return 1.0 / (1.0 + F.exp(-_bounded(logit)))


def second_share(logit: Column) -> Column:
    return 1.0 / (1.0 + F.exp(_bounded(logit)))


def normalise_pair(first: Column, second: Column, base: float = 1.0) -> tuple[Column, Column]:
    """Both values scaled so that they add up to ``base``; null when the sum is 0."""
    total = first + second
    return F.try_divide(first * F.lit(float(base)), total), F.try_divide(second * F.lit(float(base)), total)


def message_to_product(cavity: Column, score: Column) -> Column:
    """Log-odds bad:good sent by a user whose other evidence has log-odds ``cavity``."""
    return _by_sign(cavity, score, lambda psi: (psi[0][0], psi[1][0], psi[0][1], psi[1][1]))


def message_to_user(cavity: Column, score: Column) -> Column:
    """Log-odds fraud:honest sent by a product whose other evidence has log-odds ``cavity``."""
    return _by_sign(cavity, score, lambda psi: (psi[0][0], psi[0][1], psi[1][0], psi[1][1]))


def _by_sign(cavity, score, weights):
    odds = F.exp(_bounded(cavity))

    def through(potential):
        a, b, c, d = (F.lit(w) for w in weights(potential))
        return F.log((a * odds + b) / (c * odds + d))

    return F.when(score > 0, through(POSITIVE)).otherwise(through(NEGATIVE))


def _bounded(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(_FAR)), F.lit(-_FAR))
