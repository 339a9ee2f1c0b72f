"""Exact global row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.plans.cutting import stage

_INDEX_BITS = 33  # monotonically_increasing_id: partition above, row index below


def number_rows(
    df: DataFrame, order: list[str | Column], column: str, distinct: bool = False,
    keep: list[str] | None = None, place: str | None = None, lead: int = 0,
) -> DataFrame:
    """Append ``column`` = 1, 2, 3 ... in ``order``, which should be a total order.

    With ``distinct`` equal rows are numbered once. They lie in one range, so this takes no
    shuffle of its own. Rows are range-partitioned and sorted once and kept as a staged table, so the
    ranges are fixed before the per-range row counts become offsets. The offset
    list has one row per range.

    ``keep`` lists what is wanted of the rows beside their number; the rest is not staged. If
    rows that agree in the first ``lead`` columns of ``order`` lie together by a column ``place``
    (which those decide), they are ranked there, and only that rank goes to the ranges
    instead of the other columns of ``order``.
    """
    slot, base, tie = "_slot", "_base", "_tie"
    wanted = ["*"] if keep is None else keep
    if lead and place in df.columns and keep is not None:
        first = order[:lead]
        ranked = F.dense_rank().over(Window.partitionBy(place, *first).orderBy(*order[lead:]))
        df = df.withColumn(tie, ranked).select(*dict.fromkeys([*first, *keep]), tie)
        order = [*first, tie]
    ranges = df.repartitionByRange(*order)
    ranged = stage(
        (ranges.dropDuplicates() if distinct else ranges)
        .sortWithinPartitions(*order)
        .select(*wanted, F.monotonically_increasing_id().alias(slot)),
        "numbered",
    )
    part = F.shiftright(F.col(slot), _INDEX_BITS)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias(base))
    within = F.col(slot).bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    return (
        ranged.withColumn("_of", part)
        .join(F.broadcast(offsets), F.col("_of") == F.col("_part"))
        .withColumn(column, F.col(base) + within + 1)
        .drop(slot, base, "_of", "_part")
    )
