"""Positions inside groups of any size."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.session import durable

_PART_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33


def with_position(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    position: str = "position",
    size: str = "size",
    fixed: Callable[[DataFrame], DataFrame] = durable,
) -> DataFrame:
    """Adds the 1-based position of a row in its group and the size of the group.

    ``order`` must be total inside a group; rows with a null key form a group like any other.  The rows
    are range-partitioned by group and order, so a hot group is split over many tasks; positions come
    from the place inside the range plus the rows of the group in earlier ranges.  The ranges are
    checkpointed first (or ``fixed`` in another way), because both steps must see the same ones.
    """
    by = list(by)
    ranged = (
        df.repartitionByRange(*by, *order)
        .sortWithinPartitions(*by, *order)
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    ranged = fixed(ranged).withColumn("_part", F.shiftright("_seq", _PART_BITS))
    keys = [f"_key{i}" for i in range(len(by))]
    runs = ranged.groupBy("_part", *(F.col(name).alias(key) for name, key in zip(by, keys, strict=True))).agg(
        F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("_part").alias("_in"),
        *keys,
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        F.sum("_rows").over(group).alias(size),
    )
    same = [F.col(name).eqNullSafe(F.col(key)) for name, key in zip(by, keys, strict=True)]
    placed = ranged.join(runs, reduce(Column.__and__, same, F.col("_part") == F.col("_in")))
    return placed.withColumn(position, F.col("_seq") + F.col("_shift")).select(*df.columns, position, size)
