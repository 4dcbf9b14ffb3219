"""Order and running sums over data of any size: rows are sorted by range, and only a row per range meets in a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored


def in_ranges(rows: DataFrame, *order: str | Column) -> DataFrame:
    """rows, written, with part, the number of the range they lie in, and place, which grows in the given order.

    Ranges come from a sample of the sort columns, so each holds about as many rows whatever their values are,
    unless rows are equal in all of them.
    """
    line = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return stored(line.withColumn("part", F.shiftright("place", 33).cast("int")), "ranges")


def _based(line: DataFrame, value: Column) -> DataFrame:
    """in_ranges() rows with _base, the sum of value over the parts before a row's, and _first, its part's first place."""
    parts = line.groupBy("part").agg(F.sum(value).alias("_n"), F.min("place").alias("_first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    parts = parts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return line.join(F.broadcast(parts), "part")


def numbered(rows: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """rows with column `name`, 0, 1, ... in the given order. A part starts where the parts before it end."""
    found = _based(in_ranges(rows, *order), F.lit(1)).withColumn(name, F.col("_base") + F.col("place") - F.col("_first"))
    return found.drop("part", "place", "_base", "_first")


def summed_before(rows: DataFrame, name: str, value: str, *order: str | Column) -> DataFrame:
    """rows with column `name`, the sum of `value` over the rows before in the given order."""
    found = _based(in_ranges(rows, *order), F.col(value))
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return found.drop("part", "place", "_base", "_first")


def filled(rows: DataFrame, name: str, value: str, *order: str | Column) -> DataFrame:
    """rows with column `name`, the last value that isn't null at or before a row in the given order."""
    line = in_ranges(rows, *order)
    last = line.where(F.col(value).isNotNull()).groupBy("part").agg(F.max_by(value, "place").alias("_last"))
    parts = line.select("part").distinct().join(last, "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    parts = parts.withColumn("_carried", F.last("_last", True).over(before)).drop("_last")
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    found = line.join(F.broadcast(parts), "part").withColumn(name, F.coalesce(F.last(value, True).over(inside), F.col("_carried")))
    return found.drop("part", "place", "_carried")
