"""Sinks: deterministic exports, listings, metric lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def select_for_export(packs: DataFrame, full: bool = False, pending_only: bool = False, since: int | None = None) -> DataFrame:
    """Everything, only pending packs, those after a sequence, or by default those not yet published; deleted ones
    never."""
    alive = packs.filter("lifecycle <> 'deleted'")
    if full:
        return alive
    if pending_only:
        return alive.filter("lifecycle = 'export-pending'")
    if since is not None:
        return alive.filter(F.col("sequence") > since)
    return alive.filter("lifecycle <> 'published'")


def numbered(packs: DataFrame, per_file: int = 1000) -> DataFrame:
    """Packs with the number of the file they go to, by pack id. Ranks come from counts of id ranges, so that no task
    sorts everything."""
    ranged = packs.repartitionByRange("pack_id").withColumn("_part", F.spark_partition_id())
    ranged = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy("pack_id")))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    first = ranged.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    joined = ranged.join(F.broadcast(first), "_part")
    return joined.withColumn("batch", F.floor((F.col("_first") + F.col("_n") - 1) / per_file).cast("long")).drop("_part", "_n", "_first")


def export(packs: DataFrame, path: str, per_file: int = 1000, done: DataFrame | None = None) -> None:
    """JSON files by batch; packs in `done` (a checkpoint of an earlier run) are left out."""
    if done is not None:
        packs = packs.join(done.select("pack_id"), "pack_id", "left_anti")
    numbered(packs, per_file).repartition("batch").sortWithinPartitions("batch", "pack_id").write.partitionBy("batch").json(path)


def listing_json(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.to_json(F.struct(*sorted(nodes.columns))).alias("value"))


def listing_text(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.format_string("%s %12d %s", F.substring("type", 1, 1), "size", "path").alias("value"))


def listing_usage(nodes: DataFrame) -> DataFrame:
    """Name, apparent size, size in 512-byte blocks and inode of each file, for disk usage viewers."""
    name = F.element_at(F.split("path", "/"), -1)
    disk = F.ceil(F.col("size") / 512) * 512
    return nodes.select(F.to_json(F.struct(name.alias("name"), F.col("size").alias("asize"), disk.cast("long").alias("dsize"), F.col("inode").alias("ino"))).alias("value"))


def append_lines(df: DataFrame, path: str) -> None:
    """JSON lines, appended as new files."""
    df.write.mode("append").json(path)


def write_text(df: DataFrame, path: str) -> None:
    df.select("value").write.mode("append").text(path)
