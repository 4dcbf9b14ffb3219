"""Series formed from a stream of events: watermarked daily sums per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import shared_folder


def daily_stream(events: DataFrame, late: str = "7 days") -> DataFrame:
    """(user_id, day, v, n) of a stream of (ts, user_id, value): sums per day. A day is final, and its
    state goes, once the newest event is more than `late` past its end; later events for it are left out."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", F.coalesce("value", F.lit(0.0)).alias("value")).withWatermark("ts", late)
    sums = rows.groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    return sums.select("user_id", F.to_date("w.start").alias("day"), "v", "n")


def daily_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream to its end; micro-batches write what they change."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    out = shared_folder(spark, "daily")
    # A pattern, since the table may be a file or a folder.
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    sums = daily_stream(events)

    def write(rows: DataFrame, number: int) -> None:
        rows.withColumn("b", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    sums.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*sums.schema.fields, T.StructField("b", T.IntegerType())])).parquet(f"{out}/rows")
    last = rows.groupBy("user_id", "day").agg(F.max_by(F.struct("v", "n"), "b").alias("s"))
    return last.select("user_id", F.col("day").cast("string").alias("day"), F.round("s.v", 4).alias("v"), F.col("s.n").alias("n"))
