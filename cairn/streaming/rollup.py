"""Event streams: windowed counts with a watermark, rolled-up buckets, thinned samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import series
from cairn.sources import layers


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of event files (a glob may name single files); times become instants, which watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums of each window and type; events later than `late` are dropped."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").cast("long").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


def run_to_table(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, key: tuple[str, ...] = ("w", "event_type")) -> DataFrame:
    """Runs over what is there; gives the newest row of each key.

    Update mode: a batch writes the groups it changed as a layer, and groups that the watermark has passed leave the
    state. A repeated batch replaces its own layer.
    """
    q = (
        stream.writeStream.outputMode("update").foreachBatch(lambda batch, n: layers.add(batch, path, n))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return layers.read(spark, path, list(key))


def roll_up(spark: SparkSession, path: str, events: DataFrame, granularity: str, raw_floor) -> DataFrame:
    """Adds the buckets that changed to those at the path as a layer, and returns them; adds nothing if none did.

    Buckets before the floor, whose raw events may be gone, are left as they are, so running again changes nothing.
    """
    fresh = series.buckets(events.filter(F.col("ts") >= F.lit(raw_floor)), [granularity])
    n = layers.newest(spark, path)
    if n < 0:
        layers.add(fresh, path, 0)
        return fresh
    layers.add(series.changed(layers.read(spark, path, series.KEY), fresh), path, n + 1)
    return spark.read.parquet(f"{path}/layer={n + 1}").drop("deleted")


def thin(samples: DataFrame, every: int, keep: int) -> DataFrame:
    """The first sample of every so many seconds of a series, and of these the newest `keep`."""
    from pyspark.sql.window import Window

    slot = F.floor(F.unix_timestamp("ts") / every)
    first = Window.partitionBy("series", slot).orderBy("ts", "seq")
    newest = Window.partitionBy("series").orderBy(F.desc("ts"), F.desc("seq"))
    once = samples.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return once.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= keep).drop("_n")
