"""Numbering all rows in an order without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recscan.scratch import written

_BITS = 33


def ranked(df: DataFrame, order: list[Column], name: str, running: str | None = None) -> DataFrame:
    """``df`` with ``name``, each row's place in the order from 0, and with ``running`` the column {running}_before:
    the sum of that column over all rows before.

    Rows are dealt out by ranges, sorted and written with their place in their partition; what is
    added is the totals of the partitions before, one row for each. Keep ``df`` narrow.
    """
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_id", _BITS).alias("_part")
    size = F.sum(running) if running else F.lit(0)
    totals = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"), size.alias("_s"))
    # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s"))
    out = placed.withColumn("_part", F.shiftright("_id", _BITS)).join(F.broadcast(offsets), "_part")
    out = out.withColumn(name, F.col("_n") + F.col("_id").bitwiseAND(F.lit((1 << _BITS) - 1)))
    if running:
        within = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(f"{running}_before", F.col("_s") + F.coalesce(F.sum(running).over(within), F.lit(0)))
    return out.drop("_part", "_id", "_n", "_s")
