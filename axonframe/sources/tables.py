"""The engine's domain tables from the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axonframe.functions.waveform import doubles

#: Microseconds since 1970 without a time zone.
MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(spike_id, cluster, w): embeddings as waveforms of sorted spikes."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("spike_id"), F.col("label").alias("cluster"), doubles(F.col("embedding")).alias("w"))


def timed_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(spike_id, cluster, w, t): spikes with the time in microseconds of the event of the same number."""
    times = table(spark, sf_dir, "events").select(F.col("event_id").alias("spike_id"), F.expr(MICROS).alias("t"))
    return spikes(spark, sf_dir).join(times, "spike_id")


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, unit, rec, trial, us, t): events as spikes of units; us in microseconds, t in minutes, recordings 0 to 4, trials by day."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("unit"), (F.col("user_id") % 5).cast("int").alias("rec"),
        F.date_format("ts", "yyyy-MM-dd").alias("trial"), F.expr(MICROS).alias("us"), (F.expr(MICROS) / 60e6).alias("t"),
    )


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, fs, offset): one row a region; a dimension that is broadcast."""
    return table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("rec"), (F.col("r_regionkey") * 5000.0 + 20000.0).alias("fs"), (F.col("r_regionkey") * 1000).cast("long").alias("offset")
    )


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, ix, v): event values of a type in time order as samples of a channel, numbered from 0.

    Days are numbered apart and shifted by the counts of the days before, so no window holds a channel.
    """
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), "ts", "event_id", F.col("value").alias("v"), F.to_date("ts").alias("day"))
    sizes = rows.groupBy("channel", "day").agg(F.count("*").alias("c"))
    before = Window.partitionBy("channel").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("channel", "day", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("channel", "day").orderBy("ts", "event_id")) - 1
    return rows.withColumn("k", within).join(starts, ["channel", "day"]).select("channel", (F.col("start") + F.col("k")).alias("ix"), "v")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cluster, x, y, z): line items as rows of a large feature matrix."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cluster"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z"))
