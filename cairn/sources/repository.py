"""Repository metadata as JSON: index files, snapshots, trees, event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX = "packs array<struct<id:string, blobs:array<struct<id:string, type:string, offset:bigint, length:bigint, uncompressed_length:bigint>>>>, supersedes array<string>"
SNAPSHOT = (
    "time string, tree string, parent string, paths array<string>, hostname string, username string, uid bigint, gid bigint, tags array<string>, label string, original string, "
    "delete struct<mode:string, after:string>, summary struct<total_bytes_processed:bigint, data_added:bigint, files_new:bigint>"
)
NODE = "name string, type string, mode bigint, mtime string, atime string, ctime string, uid bigint, gid bigint, inode bigint, device_id bigint, links bigint, size bigint, content array<string>, subtree string"
EVENT = "ts timestamp, seq bigint, pack_id string, type string, pack_type string, backend bigint, physical_size bigint, payload_size bigint, _corrupt_record string"


def _name(column: str = "_metadata.file_name") -> F.Column:
    return F.regexp_extract(F.col(column), r"([^/.]+)(?:\.json)?$", 1)


def index_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each blob in each index file; packs superseded index files list still appear and are told apart by
    index_id."""
    files = spark.read.schema(INDEX).json(path, multiLine=True).select(_name().alias("index_id"), F.explode("packs").alias("p"))
    return files.select("index_id", F.col("p.id").alias("pack_id"), F.posexplode("p.blobs").alias("ordinal", "b")).select(
        "index_id", "pack_id", "ordinal", F.col("b.id").alias("blob_id"), "b.type", "b.offset", "b.length", F.col("b.uncompressed_length").alias("uncompressed")
    )


def merged_index(blobs: DataFrame) -> DataFrame:
    """One row for each (pack, blob) whatever number of index files list it."""
    return blobs.groupBy("pack_id", "blob_id").agg(*(F.min(c).alias(c) for c in ("type", "offset", "length", "uncompressed")))


def import_packs(blobs: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Pack rows of blobs; packs already imported take no part."""
    if done is not None:
        blobs = blobs.join(done.select("pack_id").distinct(), "pack_id", "left_anti")
    return blobs.groupBy("pack_id").agg(F.count("*").cast("long").alias("blob_count"), F.sum("length").cast("long").alias("payload_size"))


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots by file name, times in UTC with the offset they were written in."""
    raw = spark.read.schema(SNAPSHOT).json(path, multiLine=True)
    sign = F.when(F.regexp_extract("time", r"([+-])\d\d:\d\d$", 1) == "-", -1).otherwise(1)
    part = lambda n: F.coalesce(F.try_to_number(F.regexp_extract("time", r"[+-](\d\d):(\d\d)$", n), F.lit("99")), F.lit(0)).cast("int")
    return raw.select(
        _name().alias("id"),
        *(F.to_timestamp("time").alias("time") if c == "time" else F.col(c) for c in raw.columns),
        (sign * (60 * part(1) + part(2))).alias("tz_offset_min"),
    )


def trees(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of tree files in their order; names must be strictly sorted, which `unsorted` reports."""
    raw = spark.read.schema(f"nodes array<struct<{NODE.replace(' array<', ':array<').replace(' string', ':string').replace(' bigint', ':bigint')}>>").json(path, multiLine=True)
    return raw.select(_name().alias("tree"), F.posexplode("nodes").alias("ordinal", "n")).select("tree", "ordinal", "n.*")


def unsorted(nodes: DataFrame) -> DataFrame:
    """Trees whose names do not strictly rise."""
    g = nodes.groupBy("tree").agg(F.array_sort(F.collect_list(F.struct("ordinal", "name"))).alias("n"))
    names = F.col("n.name")
    return g.filter(names != F.array_sort(F.array_distinct(names))).select("tree")


def event_log(spark: SparkSession, path: str, since=None, until=None) -> tuple[DataFrame, DataFrame]:
    """(events in [since, until), count of corrupt rows) of a log of JSON lines; corrupt rows are skipped."""
    raw = spark.read.schema(EVENT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    bad = F.col("_corrupt_record").isNotNull() | F.col("ts").isNull()
    good = raw.filter(~bad).drop("_corrupt_record")
    if since is not None:
        good = good.filter(F.col("ts") >= F.lit(since))
    if until is not None:
        good = good.filter(F.col("ts") < F.lit(until))
    # Spark refuses plans that read only the corrupt column
    return good, raw.select("ts", "_corrupt_record").groupBy(bad.alias("bad")).count().filter("bad").select(F.col("count").alias("corrupt"))


def objects(spark: SparkSession, path: str) -> DataFrame:
    """Objects and bytes by the first directory of a storage path, without reading contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    kind = F.element_at(F.split("path", "/"), -2)
    return files.groupBy(kind.alias("type")).agg(F.count("*").cast("long").alias("objects"), F.sum("length").cast("long").alias("bytes"))
