"""Binary splits on numeric attributes by weighted gini, and interval (spectral) candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as K
from ..functions import spectra
from ..sources.storage import stored
from . import impurity
from ..sources.ranges import in_ranges


def attributes(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys, series_id, label, attribute, value), values to six decimals."""
    return rows.select(*keys, "series_id", "label", F.posexplode(column).alias("attribute", "v")).select(
        *keys, "series_id", "label", "attribute", K.r6(F.col("v")).alias("value")
    )


def _best_sides(sides: DataFrame, by: list[str]) -> DataFrame:
    """Of each attribute's splits (value, next, nl, nr and the squared class counts ql, qr of both sides) the best."""
    wgini = (F.col("nl") * (1 - F.col("ql") / (F.col("nl") * F.col("nl"))) + F.col("nr") * (1 - F.col("qr") / (F.col("nr") * F.col("nr")))) / (F.col("nl") + F.col("nr"))
    sides = sides.where("next is not null").withColumn("wgini", F.round(wgini, 9)).withColumn("threshold", (F.col("value") + F.col("next")) / 2)
    best = sides.groupBy(*by).agg(F.min(F.struct("wgini", "threshold")).alias("b"))
    return best.select(*by, F.col("b.threshold").alias("threshold"), F.col("b.wgini").alias("wgini"))


def small_gini_splits(values: DataFrame, keys: list[str], count: str) -> DataFrame:
    """gini_splits() where it is known that an attribute's values fit one window: no ranges, one plan."""
    by = [*keys, "attribute"]
    counts = values.groupBy(*by, "value", "label").agg(F.sum(count).alias("c"))
    own = Window.partitionBy(*by, "label")
    rows = counts.withColumn("l", F.sum("c").over(own.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("c").over(own))
    lower, after = F.col("l") - F.col("c"), lambda upto: (F.col("all") - upto) * (F.col("all") - upto)
    points = rows.groupBy(*by, "value").agg(
        F.sum("c").alias("n"), F.sum(F.col("l") * F.col("l") - lower * lower).alias("ql"), F.sum(after(F.col("l")) - after(lower)).alias("qr"),
        F.sum(F.when(lower == 0, F.col("all") * F.col("all")).otherwise(0)).alias("squares"),
    )
    whole, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("value")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    nl = F.sum("n").over(run)
    sides = points.select(
        *by, "value", F.lead("value").over(order).alias("next"), nl.alias("nl"), (F.sum("n").over(whole) - nl).alias("nr"), F.sum("ql").over(run).alias("ql"),
        (F.sum("squares").over(whole) + F.sum("qr").over(run)).alias("qr"),
    )
    return _best_sides(sides, by)


def task_gini_splits(values: DataFrame, keys: list[str], count: str) -> DataFrame:
    """small_gini_splits() by arrays: an attribute's values meet in a task, which sorts them and adds up squared class counts."""
    schema = T.StructType([*[values.schema[k] for k in (*keys, "attribute")], *T._parse_datatype_string("threshold double, wgini double").fields])

    def work(table: pa.Table) -> pa.Table:
        v, n = table.column("value").to_numpy(), table.column(count).to_numpy().astype(np.int64)
        _, y = np.unique(table.column("label").to_numpy(), return_inverse=True)
        order = np.lexsort((v, y))
        v, n, y = v[order], n[order], y[order]
        every = np.bincount(y, weights=n).astype(np.int64)
        upto = np.cumsum(n) - (np.cumsum(every) - every)[y]  # of the own class, with this row
        left, right = upto * upto - (upto - n) ** 2, (every[y] - upto) ** 2 - (every[y] - upto + n) ** 2
        line = np.argsort(v, kind="stable")
        v, at = v[line], np.flatnonzero(v[line][1:] > v[line][:-1])
        names = {c: table.column(c)[:1] for c in (*keys, "attribute")}
        if not len(at):
            return pa.Table.from_arrays([*[c[:0] for c in names.values()], pa.array([], pa.float64()), pa.array([], pa.float64())], names=schema.names)
        nl, ql, qr = np.cumsum(n[line])[at], np.cumsum(left[line])[at], (every * every).sum() + np.cumsum(right[line])[at]
        nr = n.sum() - nl
        wgini = np.round((nl * (1 - ql / (nl * nl)) + nr * (1 - qr / (nr * nr))) / (nl + nr), 9)
        k = int(wgini.argmin())
        return pa.Table.from_arrays([*names.values(), pa.array([float((v[at[k]] + v[at[k] + 1]) / 2)]), pa.array([float(wgini[k])])], names=schema.names)

    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, "attribute"]
    return values.select(*by, "value", "label", count).repartition(tasks, *by).groupBy(*by).applyInArrow(work, schema)


def gini_splits(values: DataFrame, keys: list[str], count: str | None = None) -> DataFrame:
    """(keys, attribute, threshold, wgini): each attribute's best binary split, values below the
    threshold against the rest; thresholds halfway between neighbouring values, the smallest of equally
    good ones. An attribute with one value has no row. count: a column of how often a row stands.

    Counts per value and class are sorted by range; windows run inside the parts of an attribute, and from part
    to part go the sums of whole parts, so no task holds an attribute's values. Squared class counts on either
    side are running sums too: a value changes only those of its own classes.
    """
    by = [*keys, "attribute"]
    counts = values.groupBy(*by, "value", "label").agg((F.sum(count) if count else F.count("*")).alias("c"))
    line = in_ranges(counts, *by, "value").drop("place")
    after = lambda upto: (F.col("all") - upto) * (F.col("all") - upto)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)

    classes = Window.partitionBy(*by, "label")
    parts = line.groupBy(*by, "part", "label").agg(F.sum("c").alias("here"), F.min("value").alias("lowest"))
    parts = parts.withColumn("all", F.sum("here").over(classes)).withColumn("before", F.coalesce(F.sum("here").over(earlier(classes.orderBy("part"))), F.lit(0)))
    parts = stored(parts, "part-counts")
    upto = F.col("before") + F.col("here")
    steps = parts.groupBy(*by, "part").agg(
        F.sum("here").alias("n"), F.sum(upto * upto - F.col("before") * F.col("before")).alias("ql"), F.sum(after(upto) - after(F.col("before"))).alias("qr"),
        F.min("lowest").alias("lowest"), F.sum(F.when(F.col("before") == 0, F.col("all") * F.col("all")).otherwise(0)).alias("squares"),
    )
    whole = Window.partitionBy(*by)
    runs = earlier(whole.orderBy("part"))
    starts = steps.select(
        *by, "part", *[F.coalesce(F.sum(c).over(runs), F.lit(0)).alias(f"{c}0") for c in ("n", "ql")], (F.sum("squares").over(whole) + F.coalesce(F.sum("qr").over(runs), F.lit(0))).alias("qr0"),
        F.sum("n").over(whole).alias("total"), F.lead("lowest").over(whole.orderBy("part")).alias("following"),
    )

    inside = Window.partitionBy(*by, "part", "label").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    rows = line.join(parts.select(*by, "part", "label", "all", "before"), [*by, "part", "label"]).withColumn("l", F.col("before") + F.sum("c").over(inside))
    lower = F.col("l") - F.col("c")
    points = rows.groupBy(*by, "part", "value").agg(F.sum("c").alias("n"), F.sum(F.col("l") * F.col("l") - lower * lower).alias("ql"), F.sum(after(F.col("l")) - after(lower)).alias("qr"))
    run, order = Window.partitionBy(*by, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by, "part").orderBy("value")
    sums = points.select(*by, "part", "value", *[F.sum(c).over(run).alias(c) for c in ("n", "ql", "qr")], F.lead("value").over(order).alias("next")).join(starts, [*by, "part"])
    sides = sums.select(
        *by, "value", F.coalesce("next", "following").alias("next"), (F.col("n0") + F.col("n")).alias("nl"), (F.col("total") - F.col("n0") - F.col("n")).alias("nr"),
        (F.col("ql0") + F.col("ql")).alias("ql"), (F.col("qr0") + F.col("qr")).alias("qr"),
    )
    return _best_sides(sides, by)


def attribute_budget(length: int, rule: str | int) -> int:
    """How many attributes a split may try: sqrt, loge, log2 or a number; 0 or too many means all."""
    import math

    rules = {"sqrt": lambda: int(math.sqrt(length)), "loge": lambda: int(math.log(length)), "log2": lambda: int(math.log2(length))}
    m = rules[rule]() if isinstance(rule, str) else rule
    return m if 0 < m <= length else length


def interval_filter(series: DataFrame, start: int, end: int, kind: str) -> DataFrame:
    """The [start, end) part of each series under a filter, as array column `f`."""
    part = series.withColumn("x", F.slice("x", start + 1, end - start))
    return spectra.filtered(part, end - start, kind)


def labelled_by_gain(values: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, threshold, label, gain, sign): the class an attribute's threshold tells most of, over all
    of values; of equal gains the largest label. sign 1: at least half of the class lies at or above it."""
    rows = values.join(thresholds.select(*keys, "threshold"), keys)
    gains = impurity.fixed_gain(rows, [*keys, "threshold"], F.col("threshold"))
    best = gains.groupBy(*keys, "threshold").agg(F.max(F.struct(F.round("gain", 9).alias("gain"), "label", "far", "near")).alias("b"))
    return best.select(*keys, "threshold", "b.label", "b.gain", F.when(F.col("b.far") >= F.col("b.near"), 1).otherwise(0).alias("sign"))


def best_of(candidates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One candidate of each keys: the smallest weighted gini, ties in the given order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("wgini", *order))
    return candidates.withColumn("nth", nth).where("nth = 1").drop("nth")
