"""Running totals in a global order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlode.llm.common import durable


def before(frame: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """All columns and out: the sum of value over the rows of the group that come earlier.

    Rows are dealt by range over (group, order), nulls first, so a group may span many tasks;
    each task adds up its own stretch, and only the stretches' sums, a row for each task, are
    added up along a group. Rows that are equal in group and order come in any one order. The
    sorted rows are written to the shared folder, so a repeated task sees the same order.
    """
    keys = [F.col(name).asc_nulls_first() for name in [*group, *order]]
    placed = durable(
        frame.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("row_place", F.monotonically_increasing_id()).withColumn("stretch", F.shiftright("row_place", 33)),
        "running",
    )
    earlier = Window.partitionBy(*group, "stretch").orderBy("row_place").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*group).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*group, "stretch").agg(F.sum(value).alias("own"))
    names = {name: f"of_{at}" for at, name in enumerate(group)}
    starts = sums.select(
        *[F.col(name).alias(new) for name, new in names.items()], F.col("stretch").alias("at_stretch"),
        F.coalesce(F.sum("own").over(along), F.lit(0)).alias("base"),
    )
    on = F.col("stretch") == F.col("at_stretch")
    for name, new in names.items():
        on &= F.col(name).eqNullSafe(F.col(new))
    own = F.coalesce(F.sum(value).over(earlier), F.lit(0))
    return placed.withColumn("own_before", own).join(starts, on).select(
        *[F.col(name) for name in frame.columns], (F.col("own_before") + F.col("base")).cast("long").alias(out)
    )
