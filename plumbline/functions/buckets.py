"""Binning of probabilities without floating-point edges."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def tenth(p: Column) -> Column:
    """0..9 for [0, .1), [.1, .2) ... [.9, 1], decided on 4 decimals."""
    scaled = F.round(p, 4).cast("decimal(6,4)") * 10
    return F.least(F.floor(scaled), F.lit(9)).cast("int")


def nearest_tenth(p: Column) -> Column:
    """0.0, 0.1 ... 1.0, the closest step."""
    return F.floor(F.round(p, 6) * 10 + 0.5) / 10


def whole_percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to the nearest integer, a half going to the even one."""
    hundred = part.cast("bigint") * 100
    quotient = F.floor(F.try_divide(hundred, whole)).cast("bigint")
    doubled_rest = (hundred - quotient * whole) * 2
    up = (doubled_rest > whole) | ((doubled_rest == whole) & (quotient % 2 == 1))
    return (quotient + F.when(up, 1).otherwise(0)).cast("double")
