"""Pack history: buckets of events, series, histograms and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What a bucket may know about its time, worst last.
COVERAGE = ["complete", "partial", "reconstructed"]
METRICS = ["added", "deleted", "repacked", "promoted"]
KEY = ["granularity", "start", "backend", "pack_type"]
GRANULARITIES = ["hour", "day", "month"]


def coverage(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, COVERAGE)), rank + 1)


def _measures() -> list[Column]:
    kind, size = F.col("type"), F.col("physical_size")
    which = {"added": ["created", "imported"], "deleted": ["deleted"], "repacked": ["repacked-into"], "promoted": ["promoted"]}
    out = [F.count("*").cast("long").alias("events_observed")]
    for name, kinds in which.items():
        out.append(F.count_if(kind.isin(*kinds)).cast("long").alias(f"{name}_packs"))
        out.append(F.coalesce(F.sum(F.when(kind.isin(*kinds), size)), F.lit(0)).cast("long").alias(f"{name}_bytes"))
    out.append(F.max(F.when(kind == "imported", 2).otherwise(F.col("floor_rank"))).alias("coverage_rank"))
    return out


def buckets(events: DataFrame, granularities: list[str] | None = None, complete_since=None) -> DataFrame:
    """Events by hour, day and month, backend and pack type. A bucket that begins before `complete_since` is partial,
    one with an import reconstructed; unknown kinds of event only count as observed."""
    floor = lambda start: F.when(start < F.lit(complete_since), 1).otherwise(0) if complete_since is not None else F.lit(0)
    starts = F.array(*(F.struct(F.lit(g).alias("granularity"), F.date_trunc(g, "ts").alias("start")) for g in granularities or GRANULARITIES))
    rows = events.select("type", "physical_size", "backend", "pack_type", F.explode(starts).alias("b")).select("type", "physical_size", "backend", "pack_type", "b.*")
    return rows.withColumn("floor_rank", floor(F.col("start"))).groupBy(*KEY).agg(*_measures())


def merged(stored: DataFrame, events: DataFrame, granularity: str) -> DataFrame:
    """Buckets of one granularity: a stored bucket wins over events that come late for it."""
    raw = buckets(events, [granularity])
    kept = stored.filter(F.col("granularity") == granularity)
    return kept.unionByName(raw.join(kept.select(*KEY), KEY, "left_anti"))


def series(bucketed: DataFrame, metric: str, by: str | None = None) -> DataFrame:
    """(start, group, value, coverage, events_observed) of one metric."""
    group = F.coalesce(F.col(by).cast("string"), F.lit("unknown")) if by else F.lit("all")
    return bucketed.groupBy("start", group.alias("group")).agg(
        F.sum(metric).cast("long").alias("value"), coverage(F.max("coverage_rank")).alias("coverage"), F.sum("events_observed").cast("long").alias("events_observed")
    )


def weekly(events: DataFrame) -> DataFrame:
    return buckets(events, ["week"])


def histogram(points: DataFrame, bins: int = 10) -> DataFrame:
    """bin, from, to, points: bins of equal whole width, at least 1, empty ones too; the last ends at the greatest value
    and takes it; one bin where all are equal."""
    ends = points.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = F.greatest(F.lit(1), F.floor((F.col("hi") - F.col("lo")) / bins))
    bin_no = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("value") - F.col("lo")) / F.col("w")), F.lit(bins - 1)))
    rows = points.select("value").join(F.broadcast(ends.withColumn("w", width.cast("long"))))  # one row
    inside = (F.col("hi") == F.col("lo")) | (F.col("value") <= F.when(bin_no == bins - 1, F.col("hi")).otherwise(F.col("lo") + (bin_no + 1) * F.col("w")))
    counts = rows.filter(inside).groupBy(bin_no.cast("int").alias("bin")).agg(F.count("*").cast("long").alias("points"))
    grid = ends.filter("lo IS NOT NULL").withColumn("w", width.cast("long"))
    last = F.when(F.col("hi") == F.col("lo"), 0).otherwise(bins - 1)
    grid = grid.select("lo", "hi", "w", F.explode(F.sequence(F.lit(0), last)).alias("bin"))
    upper = F.when(F.col("bin") == last, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * F.col("w"))
    bounds = grid.select("bin", (F.col("lo") + F.col("bin") * F.col("w")).cast("long").alias("from"), upper.cast("long").alias("to"))
    return bounds.join(counts, "bin", "left").na.fill(0, ["points"])


def forecast(points: DataFrame, allow_incomplete: bool = False) -> DataFrame:
    """Least squares over the number of the bucket, and the next value; nothing from fewer than two points, from
    incomplete ones unless allowed, or where values do not vary."""
    numbered = points.withColumn("x", (F.row_number().over(Window.orderBy("start")) - 1).cast("double"))  # a row a bucket
    fit = numbered.agg(
        F.regr_slope(F.col("value").cast("double"), F.col("x")).alias("slope"),
        F.regr_intercept(F.col("value").cast("double"), F.col("x")).alias("intercept"),
        F.count("*").cast("long").alias("points"),
        F.bool_and(F.col("coverage") == "complete").alias("complete"),
        (F.max("value") > F.min("value")).alias("varies"),
    )
    ok = F.col("varies") & (F.col("points") >= 2) & (F.col("complete") | F.lit(allow_incomplete))
    return fit.filter(ok).select("points", "slope", "intercept", (F.col("intercept") + F.col("slope") * F.col("points")).alias("next_value"))


def changed(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh buckets that are new or differ from what is stored: all that an idempotent roll-up writes."""
    return fresh.select(*sorted(fresh.columns)).exceptAll(stored.select(*sorted(fresh.columns)))
