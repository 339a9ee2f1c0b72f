"""Explicit schemas, so that no scan is spent on inference."""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


REVIEW_JSON = _struct(
    ("reviewerID", T.StringType()),
    ("asin", T.StringType()),
    ("overall", T.DoubleType()),
    ("reviewerName", T.StringType()),
    ("verified", T.BooleanType()),
    ("vote", T.StringType()),
    ("reviewTime", T.StringType()),
    ("unixReviewTime", T.LongType()),
    ("summary", T.StringType()),
    ("reviewText", T.StringType()),
)

METADATA_JSON = _struct(("asin", T.StringType()), ("title", T.StringType()))

DEGREE_CSV = _struct(("degree", T.LongType()), ("frequency", T.LongType()))

LEXICON = _struct(("token", T.StringType()), ("valence", T.DoubleType()))
