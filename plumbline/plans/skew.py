"""Joins and sums that stay balanced when one key holds a large part of the rows.

A key with more than ``limit`` rows is split into ``ceil(rows / limit)`` salted
groups, and its single lookup row is copied to each of them. At most
``total_rows / limit`` keys can be that heavy, so the list of heavy keys is small
by construction (a trillion rows at the default limit: one million short rows)
and is the only thing broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.plans.cutting import cut, stage

GROUP_LIMIT = 1_000_000

HEAVY_KEY = "_heavy_key"
_SALT = "_salt"
_SALTS = "_salts"
_NULL_SALTS = 1 << 20


def salts_for(rows: Column, limit: int) -> Column:
    """Number of groups a key with that many rows is split into."""
    return F.greatest(F.ceil(rows / F.lit(limit)), F.lit(1)).cast("int")


def heavy_keys(rows: DataFrame, key: str, limit: int = GROUP_LIMIT) -> DataFrame:
    """Keys of ``rows`` with more than ``limit`` rows, with their group count.

    The count combines on the map side, so a heavy key is cheap to find.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    return heavy_among(counts, key, "_rows", limit)


def heavy_among(counts: DataFrame, key: str, rows: str, limit: int = GROUP_LIMIT) -> DataFrame:
    """The heavy keys of a table that lists every key with its row count."""
    return counts.where(F.col(rows) > limit).select(
        F.col(key).alias(HEAVY_KEY), salts_for(F.col(rows), limit).alias(_SALTS)
    )


def heavy_if_any(rows: DataFrame, key: str, limit: int = GROUP_LIMIT, buckets: int = 1 << 16) -> DataFrame | None:
    """The heavy keys of ``rows``, counted once and kept, or None if there are none.

    A bucket of hashes has at least the rows of any key in it. So the keys are only
    shuffled to be counted if one of the buckets has too many rows.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets))
    counts = rows.where(F.col(key).isNotNull()).groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_rows"))
    most = counts.agg(F.max("_rows")).first()[0] or 0
    return if_any(cut(heavy_keys(rows, key, limit))) if most > limit else None


def if_any(heavy: DataFrame) -> DataFrame | None:
    """The list of heavy keys, or None if a quick look finds it empty."""
    return None if heavy.isEmpty() else heavy


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    table_key: str,
    how: str = "inner",
    limit: int = GROUP_LIMIT,
    spread: list[str] | None = None,
    heavy: DataFrame | str | None = "measure",
) -> DataFrame:
    """Join ``rows`` to ``table`` (unique on ``table_key``) on ``key = table_key``.

    ``spread`` names the columns whose hash picks a row's salt (all columns by
    default). The hash makes the choice repeatable, so a retried task produces the
    same rows. ``table_key`` is dropped from the result. ``heavy`` is the list of
    heavy keys if it is known already, None if there are none; by default ``rows`` are
    measured first, which suits rows that come straight from a table.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be 'inner' or 'left', not {how!r}")
    lookup = "_lookup_key"
    table = table.withColumnRenamed(table_key, lookup)
    if isinstance(heavy, str):
        heavy = heavy_if_any(rows, key, limit)
    hashed = F.xxhash64(*[F.col(c) for c in spread or rows.columns])
    # rows without a key match nothing, but a left join keeps them: spread those as well
    keyless = F.when(F.col(key).isNull(), F.pmod(hashed, F.lit(_NULL_SALTS)))
    if heavy is None:
        if how == "inner":
            return rows.join(table, F.col(key) == F.col(lookup)).drop(lookup)
        salted_rows = rows.withColumn(_SALT, F.coalesce(keyless, F.lit(0)).cast("int"))
        # always 0, in a form that is not folded away and so stays part of the join key
        zero = F.pmod(F.xxhash64(lookup), F.lit(1)).cast("int")
        return _join_salted(salted_rows, table.withColumn("_lookup_salt", zero), key, lookup, how)
    listed = F.broadcast(heavy)
    salted_rows = (
        rows.join(listed, F.col(key) == F.col(HEAVY_KEY), "left")
        .withColumn(_SALT, F.coalesce(keyless, F.pmod(hashed, F.col(_SALTS)), F.lit(0)).cast("int"))
        .drop(HEAVY_KEY, _SALTS)
    )
    salted_table = (
        table.join(listed, F.col(lookup) == F.col(HEAVY_KEY), "left")
        .withColumn("_lookup_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_SALTS), F.lit(1)) - 1)))
        .drop(HEAVY_KEY, _SALTS)
    )
    return _join_salted(salted_rows, salted_table, key, lookup, how)


def add_group_sum(rows: DataFrame, key: str, value: Column, total: str, heavy: Column | None = None) -> DataFrame:
    """Give every row the sum of ``value`` over all rows with its ``key``.

    Rows are shuffled once by the key and summed in place, so a chain of such steps
    computes nothing twice. ``heavy`` marks rows of heavy keys, if there are any: those
    are pre-aggregated instead, and stay where they are while the short list of their
    sums is broadcast to them.
    """
    in_place = F.sum(value).over(Window.partitionBy(key))
    if heavy is None:
        return rows.withColumn(total, in_place)
    rows = stage(rows, "crowded")
    heavy = F.coalesce(heavy, F.lit(False))  # rows that do not say are summed in place
    sums = rows.where(heavy).groupBy(F.col(key).alias(HEAVY_KEY)).agg(F.sum(value).alias(total))
    crowded = rows.where(heavy).join(F.broadcast(sums), F.col(key) == F.col(HEAVY_KEY)).drop(HEAVY_KEY)
    return rows.where(~heavy).withColumn(total, in_place).unionByName(crowded)


def _join_salted(rows, table, key, lookup, how):
    on = (F.col(key) == F.col(lookup)) & (F.col(_SALT) == F.col("_lookup_salt"))
    return rows.join(table, on, how).drop(_SALT, "_lookup_salt", lookup)
