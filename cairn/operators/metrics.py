"""Metric samples: counters, windows, percentiles, lines for exporters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def identity(name: Column, labels: Column) -> Column:
    """Name and sorted labels as text."""
    parts = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(F.lit("."), e["key"], F.lit("="), e["value"]))
    return F.concat(name, F.array_join(parts, ""))


def counter_deltas(samples: DataFrame) -> DataFrame:
    """Difference to the sample before; a reset where the process changed or the value fell. samples: series, process,
    ts, seq, value."""
    order = Window.partitionBy("series").orderBy("ts", "seq")
    before, process = F.lag("value").over(order), F.lag("process").over(order)
    reset = (process != F.col("process")) | (F.col("value") < before)
    return samples.select(
        "series", "seq", "value", F.when(before.isNotNull() & ~reset, F.col("value") - before).alias("delta"), F.coalesce(reset, F.lit(False)).alias("reset")
    )


def window_baseline(samples: DataFrame, seconds: int) -> DataFrame:
    """Rate over a sliding window: against the last sample at or before its start, else the first inside (warming).

    Time is cut into spans as long as the window, so a window starts in the span before its sample's. Each span of a
    series is sorted apart: its samples, those of the span before moved on by the window's length, and one row that
    carries the last sample of all earlier spans and the first of the series. Samples without a time know each other only.
    """
    t = F.unix_timestamp("ts")
    point, span = F.struct("t", "seq", "value"), F.col("t") - F.pmod("t", F.lit(seconds))
    s = samples.select("series", "seq", "value", t.alias("t")).withColumn("span", span)
    spans = s.filter("span IS NOT NULL").groupBy("series", "span").agg(F.max(point).alias("last"), F.min(point).alias("first"))
    order = Window.partitionBy("series").orderBy("span")
    none = F.lit(None).cast(spans.schema["last"].dataType)
    carried = spans.select(
        "series", "span", F.col("span").alias("at"), F.max("last").over(order.rangeBetween(Window.unboundedPreceding, -2 * seconds)).alias("older"),
        F.min("first").over(Window.partitionBy("series")).alias("oldest"), none.alias("sample"),
    )
    moved = s.select("series", F.col("span") + seconds, F.col("t") + seconds, point, none, none)
    asking = s.select("series", "span", "t", none, none, point)
    within = Window.partitionBy("series", "span").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = carried.union(moved).union(asking).select("series", "sample", F.max("older").over(within).alias("older"), F.max("oldest").over(within).alias("oldest"))
    now, base = F.col("sample"), F.coalesce("older", "oldest")
    state = F.when(F.col("older").isNull(), "warming").when(base["value"] > now["value"], "reset").otherwise("ready")
    return rows.filter(now.isNotNull()).select(
        "series", now["seq"].alias("seq"), state.alias("state"), (now["value"] - base["value"]).alias("change"), (now["t"] - base["t"]).alias("seconds")
    )


def slots(events: DataFrame, slot: str) -> DataFrame:
    """Tumbling slots: events, and the greatest and total value."""
    return events.groupBy(F.date_trunc(slot, "ts").alias("slot"), "type").agg(
        F.count("*").cast("long").alias("n"), F.max("physical_size").alias("most"), F.sum("physical_size").cast("long").alias("total")
    )


def trailing(slotted: DataFrame, keep: int) -> DataFrame:
    """Sums over the last `keep` slots of each type."""
    w = Window.partitionBy("type").orderBy("slot").rowsBetween(-(keep - 1), 0)
    return slotted.select("slot", "type", F.sum("n").over(w).cast("long").alias("n"), F.sum("total").over(w).cast("long").alias("total"))


def percentile(buckets: DataFrame, p: int) -> DataFrame:
    """Nearest-rank percentile of bucket counts, as the upper bound of its bucket. buckets: series, bound, n."""
    so_far = Window.partitionBy("series").orderBy("bound").rowsBetween(Window.unboundedPreceding, 0)
    rows = buckets.withColumn("cum", F.sum("n").over(so_far)).withColumn("total", F.sum("n").over(Window.partitionBy("series")))
    hit = rows.filter(F.col("cum") >= F.ceil(F.col("total") * p / 100))
    return hit.groupBy("series").agg(F.min("bound").alias("value"), F.max("total").cast("long").alias("samples"))


def latency_buckets(events: DataFrame) -> DataFrame:
    """Power-of-two buckets of a value, named by their upper bound."""
    v = F.greatest(F.col("physical_size"), F.lit(1)).cast("double")
    return events.groupBy(F.col("type").alias("series"), F.pow(F.lit(2), F.ceil(F.log2(v))).cast("long").alias("bound")).agg(F.count("*").cast("long").alias("n"))


def by_class(events: DataFrame, now) -> DataFrame:
    """Operations of each class and the age of the oldest, in seconds."""
    return events.groupBy("type").agg(F.count("*").cast("long").alias("operations"), (F.unix_timestamp(F.lit(now)) - F.unix_timestamp(F.min("ts"))).alias("oldest_s"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([,= \\])", r"\\$1")


def influx_lines(samples: DataFrame, deployment: str) -> DataFrame:
    """Line protocol of counters: value, delta and reset flag."""
    d = counter_deltas(samples)
    line = F.concat(
        F.lit("counter,deployment="), escape(F.lit(deployment)), F.lit(",series="), escape(F.col("series")), F.lit(" value="), F.col("value").cast("string"), F.lit("i"),
        F.coalesce(F.concat(F.lit(",delta="), F.col("delta").cast("string"), F.lit("i")), F.lit("")), F.lit(",reset="), F.col("reset").cast("string"), F.lit(" "), F.col("seq").cast("string"),
    )
    return d.select(line.alias("value"))
