"""Where series come from and go to: delimited and ARFF files, ordinary tables, feature tables.

A series is a row (series_id long, label int, x array<double>), equally long within a dataset; position
is its time. Values are read as doubles and labels as doubles cut to ints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ranges

SPLITS = ("train", "validate", "test")


def _parsed(lines: DataFrame, sep: str, target_first: bool) -> DataFrame:
    cells = F.split(F.trim("value"), f"\\Q{sep}\\E")
    label = F.element_at("cells", 1 if target_first else -1)
    values = F.slice("cells", 2 if target_first else 1, F.size("cells") - 1)
    return lines.where(F.trim("value") != "").withColumn("cells", cells).select(
        "series_id", label.try_cast("double").cast("int").alias("label"), F.transform(values, lambda v: F.trim(v).try_cast("double")).alias("x")
    )


def _numbered(lines: DataFrame) -> DataFrame:
    """series_id from the line's place: file and offset order, dense ids aren't needed."""
    return lines.withColumn("series_id", F.monotonically_increasing_id())


def read_delimited(spark: SparkSession, path: str, sep: str = "\t", target_first: bool = True, header: bool = False) -> DataFrame:
    """Series from delimited text, any length per file; header lines (not numbers) are left out."""
    lines = _numbered(spark.read.text(path))
    if header:
        label = F.element_at(F.split(F.trim("value"), f"\\Q{sep}\\E"), 1 if target_first else -1)
        lines = lines.where(label.try_cast("double").isNotNull())
    return _parsed(lines, sep, target_first)


def read_arff(spark: SparkSession, path: str, target_first: bool = False) -> DataFrame:
    """Series from ARFF: header, comments and everything before @data are left out. Header lines start with
    @ and comments with %, so files split over tasks need no state; a value `?` is null, NaN stays NaN."""
    lines = _numbered(spark.read.text(path)).where(~F.regexp_like(F.trim("value"), F.lit(r"^[@%]")))
    return _parsed(lines.withColumn("value", F.regexp_replace("value", r"\?", "")), ",", target_first)


def read_series(spark: SparkSession, path: str, **options) -> DataFrame:
    """The reader by the file's suffix."""
    if path.endswith(".arff"):
        return read_arff(spark, path, **{k: v for k, v in options.items() if k == "target_first"})
    return read_delimited(spark, path, **options)


def read_archive(spark: SparkSession, folder: str, name: str, split: str = "TRAIN", suffix: str = "txt", sep: str = ",") -> DataFrame:
    """<folder>/<name>/<name>_<SPLIT>.<suffix>, as series archives lay their files out."""
    return read_series(spark, f"{folder}/{name}/{name}_{split}.{suffix}", sep=sep)


def read_word_parameters(spark: SparkSession, path: str, alphabet: int = 4) -> DataFrame:
    """(dataset, norm_mean, window_len, word_len, alphabet) of a file with a line per dataset: name, whether
    windows lose their mean, window and letters. Lines that don't hold these are left out."""
    cells = F.transform(F.split("value", ","), lambda c: F.trim(c))
    rows = spark.read.text(path).select(*[F.get(cells, F.lit(k)).alias(n) for k, n in enumerate(("dataset", "norm_mean", "window_len", "word_len"))])
    rows = rows.select("dataset", F.lower("norm_mean").try_cast("boolean").alias("norm_mean"), *[F.col(c).try_cast("int").alias(c) for c in ("window_len", "word_len")])
    return rows.where("norm_mean is not null and window_len > 0 and word_len > 0").withColumn("alphabet", F.lit(alphabet))


def shape(series: DataFrame) -> DataFrame:
    """rows and length of a dataset."""
    return series.agg(F.count("*").alias("n_rows"), F.max(F.size("x")).alias("length"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table as a labelled dataset with a split by id."""
    split = F.when(F.col("vec_id") % 5 == 0, "test").when(F.col("vec_id") % 5 == 1, "validate").otherwise("train")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("series_id"), "label", split.alias("split"), F.col("embedding").cast("array<double>").alias("x")
    )


def bucketed(rows: DataFrame, key: str, bucket: Column, value: Column, buckets: int) -> DataFrame:
    """One series per key: sums of value per bucket 0..buckets-1, 0 where there is none. Sums are made
    per (key, bucket) first, so that a hot key reaches its task as at most `buckets` rows."""
    sums = rows.select(key, bucket.alias("b"), value.alias("v")).where(F.col("b").between(0, buckets - 1)).groupBy(key, "b").agg(F.sum("v").alias("v"))
    cells = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("b", "v"))).alias("m"))
    return cells.select(key, F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("x"))


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed value per user and day, from the first day of the table to its last."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    start, last = events.agg(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).first()
    days = (last - start).days + 1 if start else 1
    return bucketed(events, "user_id", F.datediff(F.to_date("ts"), F.lit(start).cast("date")), F.coalesce("value", F.lit(0.0)), days)


def monthly_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per supplier and month, from the first month of the table to its last."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    first, last = items.agg(F.min(month), F.max(month)).first()
    months = last - first + 1 if first else 1
    return bucketed(items, "l_suppkey", month - (first or 0), F.col("l_extendedprice") * (1 - F.col("l_discount")), months)


def write_features(features: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Feature rows as headerless CSV, one folder per type."""
    features.write.mode(mode).partitionBy("type").csv(path)


def read_features(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What write_features() wrote, with the columns of schema; a folder without rows gives none."""
    inside = T.StructType([f for f in schema.fields if f.name != "type"])
    return spark.read.schema(T.StructType([*inside.fields, T.StructField("type", T.StringType())])).csv(path).select(*schema.names)


def read_wide_values(spark: SparkSession, path: str, series: DataFrame) -> DataFrame:
    """(feature_id, series_id, value) of a headerless file of one line per feature, id first, and a value
    for each series in the order of series_id. Empty lines and files give no row."""
    cells = F.split("value", ",")
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.get(cells, F.lit(0)).cast("int").alias("feature_id"), F.slice(cells, 2, F.size(cells) - 1).alias("cells"))
    rows = lines.select("feature_id", F.posexplode("cells").alias("place", "value"))
    ids = ranges.numbered(series.select("series_id"), "nth", "series_id").select("series_id", F.col("nth").cast("int").alias("place"))
    return rows.join(ids, "place").select("feature_id", "series_id", F.col("value").cast("double").alias("value"))


def write_filtered(features: DataFrame, values: DataFrame, accuracies: DataFrame, path: str) -> None:
    """The outcome of filtering: the chosen features by type, their values by split and type, and the
    accuracy of every prefix, each in a folder of its own."""
    write_features(features, f"{path}/features")
    write_values(values, f"{path}/values")
    accuracies.write.mode("overwrite").csv(f"{path}/accuracies")


def write_clusters(clusters: DataFrame, result: DataFrame, path: str) -> None:
    """The outcome of clustering: the clusters by group, and the accuracy that they reach."""
    clusters.write.mode("overwrite").partitionBy("group_id").csv(f"{path}/clusters")
    result.write.mode("overwrite").csv(f"{path}/accuracy")


def write_values(values: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Feature values in long form (split, type, feature_id, series_id, value), partitioned for scans."""
    values.write.mode(mode).partitionBy("split", "type").parquet(path)


def wide_values(values: DataFrame, most: int = 65_536) -> DataFrame:
    """feature_id, chunk and the values of up to `most` successive series ids as a line of text: the exchange
    form of the long table. A feature's lines in the order of chunks have the values of all series."""
    cells = F.array_sort(F.collect_list(F.struct("series_id", "value")))
    return values.groupBy("feature_id", F.floor(F.col("series_id") / most).alias("chunk")).agg(cells.alias("c")).select(
        "feature_id", "chunk", F.concat_ws(",", F.col("feature_id").cast("string"), F.transform("c", lambda c: c["value"].cast("string"))).alias("line")
    )


def renumbered(features: DataFrame) -> DataFrame:
    """Dense ids 0.. over trees: each tree's ids start where those of the trees before it end. The
    window over everything has a row per tree."""
    per = features.groupBy("tree_id").agg((F.max("local_id") + 1).alias("own"))
    before = per.select("tree_id", F.coalesce(F.sum("own").over(Window.orderBy("tree_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return features.join(before, "tree_id").withColumn("feature_id", F.col("base") + F.col("local_id")).drop("base")
