"""The driver's test tables seen as storage metadata, each as a DataFrame and as SQL for the oracle.

facts: an order is a file, its customer the owner, region / nation / segment the volume path. packs: an order is a
pack, its line items the blobs in it, suppliers the backends. snapshots: an order is a snapshot of its customer's
host. nodes: a page's url is a path. events: pack events, object revisions and metric samples.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark) -> str:
    """A new folder in the shared checkpoint directory; a temporary one only under a local master that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.gettempdir()
    return f"{root}/cairn-{uuid.uuid4().hex}"


def revisions(spark: SparkSession, d: str) -> DataFrame:
    """Inode revisions: null where the original store would say that a value is unknown."""
    key = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("timestamp")
    return (
        table(spark, d, "orders")
        .join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            (key % 2 + 1).cast("int").alias("fsid"),
            key.cast("long").alias("inode"),
            F.lit(1).cast("long").alias("generation"),
            (key % 5 + 1).cast("long").alias("revision"),
            F.when(key % 17 != 0, F.col("o_custkey").cast("long")).alias("uid"),
            F.col("c_nationkey").cast("long").alias("gid"),
            F.when(key % 3 == 0, day).alias("ctime"),
            F.when(key % 23 != 0, day).alias("mtime"),
            F.when(key % 50 != 0, F.round("o_totalprice").cast("long")).alias("size"),
            F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name", F.lit("/"), "c_mktsegment", F.lit("/file-"), key.cast("string")).alias("path"),
            F.when(key % 100 == 1, "unknown").when(key % 10 == 1, "source-generation").otherwise("proven").alias("continuity"),
            F.when(F.col("o_orderstatus") == "O", "live").when(F.col("o_orderstatus") == "F", "archive-only").otherwise("unknown").alias("state"),
        )
    )


REVISIONS = """
revisions AS (
  SELECT (o_orderkey % 2 + 1)::INTEGER AS fsid, o_orderkey::BIGINT AS inode, 1::BIGINT AS generation, (o_orderkey % 5 + 1)::BIGINT AS revision,
         CASE WHEN o_orderkey % 17 <> 0 THEN o_custkey::BIGINT END AS uid, c_nationkey::BIGINT AS gid,
         CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS ctime, CASE WHEN o_orderkey % 23 <> 0 THEN o_orderdate END AS mtime,
         CASE WHEN o_orderkey % 50 <> 0 THEN round(o_totalprice)::BIGINT END AS size,
         '/' || r_name || '/' || n_name || '/' || c_mktsegment || '/file-' || o_orderkey AS path,
         CASE WHEN o_orderkey % 100 = 1 THEN 'unknown' WHEN o_orderkey % 10 = 1 THEN 'source-generation' ELSE 'proven' END AS continuity,
         CASE o_orderstatus WHEN 'O' THEN 'live' WHEN 'F' THEN 'archive-only' ELSE 'unknown' END AS state
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

FACTS = (
    REVISIONS
    + """,
facts AS (
  SELECT fsid, inode, generation, revision, uid, gid, coalesce(ctime, mtime) AS created_at,
         CASE WHEN ctime IS NOT NULL THEN 'ctime' WHEN mtime IS NOT NULL THEN 'mtime' ELSE 'unknown' END AS creation_basis,
         continuity AS identity_continuity, state AS residency, path AS source_path,
         year(coalesce(ctime, mtime))::INTEGER AS year, month(coalesce(ctime, mtime))::INTEGER AS month,
         isoyear(coalesce(ctime, mtime))::INTEGER AS iso_year, weekofyear(coalesce(ctime, mtime))::INTEGER AS workweek,
         split_part(path, '/', 2) AS svm, split_part(path, '/', 3) AS volume, split_part(path, '/', 4) AS path_group,
         size AS logical_size, CASE WHEN size = 0 THEN 0 ELSE floor(log10(size::DOUBLE))::INTEGER END AS size_log10
  FROM revisions)"""
)


def packs(spark: SparkSession, d: str) -> DataFrame:
    """Packs with evidence gaps: usage, retention, tier and creation time are null for some."""
    key = F.col("l_orderkey")
    line = table(spark, d, "lineitem").select(
        key, F.col("l_quantity").cast("long").alias("q"), F.round("l_extendedprice").cast("long").alias("b"), "l_returnflag", "l_shipdate"
    )
    g = line.groupBy("l_orderkey").agg(
        F.sum("b").cast("long").alias("payload_size"),
        F.count("*").cast("long").alias("blob_count"),
        F.sum(F.when(F.col("l_returnflag") != "R", F.col("b")).otherwise(0)).cast("long").alias("used"),
        F.max((F.col("l_returnflag") == "N").cast("int")).alias("data"),
        F.max((F.col("l_returnflag") == "A").cast("int")).alias("tree"),
        F.min(F.col("l_shipdate").cast("timestamp")).alias("first"),
    )
    known = key % 9 != 0
    kind = F.when((F.col("data") == 1) & (F.col("tree") == 1), "mixed").when(F.col("data") == 1, "data").when(F.col("tree") == 1, "tree").otherwise("unknown")
    return g.select(
        F.lpad(key.cast("string"), 10, "0").alias("pack_id"),
        kind.alias("type"),
        (F.col("payload_size") + 37 * F.col("blob_count") + 36).alias("physical_size"),
        "payload_size",
        (37 * F.col("blob_count") + 36).alias("header_size"),
        "blob_count",
        F.when(key % 31 != 0, F.col("first")).alias("created_at"),
        F.when(key % 11 == 0, "delete-pending").when(key % 13 == 0, "deleted").when(key % 7 == 0, "export-pending").otherwise("published").alias("lifecycle"),
        F.when(key % 4 == 0, "hot").when(key % 4 == 1, "cold").when(key % 4 == 2, "mirrored").alias("tier"),
        F.when(key % 5 != 0, F.col("first") + F.expr("INTERVAL 90 DAYS")).alias("min_retention_until"),
        F.when(known, F.col("used")).alias("used_bytes"),
        F.when(known, F.col("payload_size") - F.col("used")).alias("unused_bytes"),
    )


PACKS = """
pack_lines AS (
  SELECT l_orderkey AS k, sum(round(l_extendedprice)::BIGINT)::BIGINT AS payload_size, count(*)::BIGINT AS blob_count,
         sum(CASE WHEN l_returnflag <> 'R' THEN round(l_extendedprice)::BIGINT ELSE 0 END)::BIGINT AS used,
         bool_or(l_returnflag = 'N') AS data, bool_or(l_returnflag = 'A') AS tree, min(l_shipdate)::TIMESTAMP AS first
  FROM lineitem GROUP BY l_orderkey),
packs AS (
  SELECT lpad(k::VARCHAR, 10, '0') AS pack_id,
         CASE WHEN data AND tree THEN 'mixed' WHEN data THEN 'data' WHEN tree THEN 'tree' ELSE 'unknown' END AS type,
         payload_size + 37 * blob_count + 36 AS physical_size, payload_size, 37 * blob_count + 36 AS header_size, blob_count,
         CASE WHEN k % 31 <> 0 THEN first END AS created_at,
         CASE WHEN k % 11 = 0 THEN 'delete-pending' WHEN k % 13 = 0 THEN 'deleted' WHEN k % 7 = 0 THEN 'export-pending' ELSE 'published' END AS lifecycle,
         CASE k % 4 WHEN 0 THEN 'hot' WHEN 1 THEN 'cold' WHEN 2 THEN 'mirrored' END AS tier,
         CASE WHEN k % 5 <> 0 THEN first + INTERVAL 90 DAY END AS min_retention_until,
         CASE WHEN k % 9 <> 0 THEN used END AS used_bytes, CASE WHEN k % 9 <> 0 THEN payload_size - used END AS unused_bytes
  FROM pack_lines)"""


def placements(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    state = F.when(F.min("l_linestatus") == "O", "live").when(F.max("l_linenumber") % 3 == 0, "pending").otherwise("deleted")
    return line.groupBy("l_orderkey", "l_suppkey").agg(
        state.alias("state"), F.sum(F.round("l_extendedprice").cast("long")).alias("bytes"), F.min(F.col("l_shipdate").cast("timestamp")).alias("placed_at")
    ).select(F.lpad(F.col("l_orderkey").cast("string"), 10, "0").alias("pack_id"), F.col("l_suppkey").cast("long").alias("backend"), "state", "bytes", "placed_at")


def backends(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        s.cast("long").alias("backend"),
        F.when(s % 4 == 0, "archive").when(s % 4 == 1, "primary").when(s % 4 == 2, "replica").otherwise("read-cache").alias("role"),
        (s % 3 == 0).alias("offsite"),
        F.col("s_nationkey").cast("long").alias("failure_domain"),
    )


PLACEMENTS = """
placements AS (
  SELECT lpad(l_orderkey::VARCHAR, 10, '0') AS pack_id, l_suppkey::BIGINT AS backend,
         CASE WHEN min(l_linestatus) = 'O' THEN 'live' WHEN max(l_linenumber) % 3 = 0 THEN 'pending' ELSE 'deleted' END AS state,
         sum(round(l_extendedprice)::BIGINT)::BIGINT AS bytes, min(l_shipdate)::TIMESTAMP AS placed_at
  FROM lineitem GROUP BY l_orderkey, l_suppkey),
backends AS (
  SELECT s_suppkey::BIGINT AS backend, CASE s_suppkey % 4 WHEN 0 THEN 'archive' WHEN 1 THEN 'primary' WHEN 2 THEN 'replica' ELSE 'read-cache' END AS role,
         s_suppkey % 3 = 0 AS offsite, s_nationkey::BIGINT AS failure_domain
  FROM supplier)"""


def blob_locations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").cast("long").alias("blob_id"),
        F.lpad(F.col("l_orderkey").cast("string"), 10, "0").alias("pack_id"),
        F.when(F.col("l_returnflag") == "A", "tree").otherwise("data").alias("type"),
        F.round("l_extendedprice").cast("long").alias("length"),
        F.col("l_linenumber").cast("int").alias("ordinal"),
    )


BLOBS = """
blob_locations AS (
  SELECT l_partkey::BIGINT AS blob_id, lpad(l_orderkey::VARCHAR, 10, '0') AS pack_id, CASE WHEN l_returnflag = 'A' THEN 'tree' ELSE 'data' END AS type,
         round(l_extendedprice)::BIGINT AS length, l_linenumber::INTEGER AS ordinal
  FROM lineitem)"""


def pack_events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").cast("long").alias("seq"),
        F.concat(F.lit("p"), (F.col("event_id") % 97).cast("string")).alias("pack_id"),
        F.when(kind == "click", "created").when(kind == "error", "deleted").when(kind == "purchase", "repacked-into").when(kind == "signup", "imported").when(kind == "view", "promoted").otherwise("checked").alias("type"),
        F.when(F.col("user_id") % 2 == 0, "data").otherwise("tree").alias("pack_type"),
        (F.col("user_id") % 5).cast("long").alias("backend"),
        F.round(F.col("value") * 100).cast("long").alias("physical_size"),
    )


EVENTS = """
pack_events AS (
  SELECT ts::TIMESTAMP AS ts, event_id::BIGINT AS seq, 'p' || (event_id % 97) AS pack_id,
         CASE event_type WHEN 'click' THEN 'created' WHEN 'error' THEN 'deleted' WHEN 'purchase' THEN 'repacked-into' WHEN 'signup' THEN 'imported' WHEN 'view' THEN 'promoted' ELSE 'checked' END AS type,
         CASE WHEN user_id % 2 = 0 THEN 'data' ELSE 'tree' END AS pack_type, (user_id % 5)::BIGINT AS backend, round(value * 100)::BIGINT AS physical_size
  FROM events)"""


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        key.cast("long").alias("id"),
        F.col("o_orderdate").cast("timestamp").alias("time"),
        (F.col("o_custkey") % 3 * 60).cast("int").alias("tz_offset_min"),
        F.concat(F.lit("host"), (F.col("o_custkey") % 40).cast("string")).alias("hostname"),
        F.when(key % 7 == 0, F.lit(None)).otherwise(F.array(F.concat(F.lit("/data/"), (F.col("o_custkey") % 2).cast("string")), F.lit("/home"))).alias("paths"),
        F.when(key % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("o_orderstatus", F.concat(F.lit("t"), (key % 3).cast("string")))).alias("tags"),
        F.col("o_orderpriority").alias("label"),
        F.round("o_totalprice").cast("long").alias("size"),
        F.when(key % 19 == 0, "never").when(key % 17 == 0, "after").alias("delete_mode"),
        F.when(key % 17 == 0, F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 400 DAYS")).alias("delete_after"),
    )


SNAPSHOTS = """
snapshots AS (
  SELECT o_orderkey::BIGINT AS id, o_orderdate::TIMESTAMP AS time, (o_custkey % 3 * 60)::INTEGER AS tz_offset_min, 'host' || (o_custkey % 40) AS hostname,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE ['/data/' || (o_custkey % 2), '/home'] END AS paths,
         CASE WHEN o_orderkey % 4 = 0 THEN []::VARCHAR[] ELSE [o_orderstatus, 't' || (o_orderkey % 3)] END AS tags,
         o_orderpriority AS label, round(o_totalprice)::BIGINT AS size,
         CASE WHEN o_orderkey % 19 = 0 THEN 'never' WHEN o_orderkey % 17 = 0 THEN 'after' END AS delete_mode,
         CASE WHEN o_orderkey % 17 = 0 THEN o_orderdate::TIMESTAMP + INTERVAL 400 DAY END AS delete_after
  FROM orders)"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Two versions of a tree of pages: the second drops, adds and changes some."""
    page = F.col("page_id")
    path = F.concat(F.lit("/"), F.regexp_replace("url", "^[a-z]+://|[?#].*$", ""))
    base = table(spark, d, "pages").select(
        F.concat(path, F.lit("/p"), page.cast("string")).alias("path"),
        page.cast("long").alias("inode"),
        F.length("html").cast("long").alias("size"),
        F.md5("html").alias("content"),
        F.when(page % 11 == 0, "symlink").otherwise("file").alias("type"),
        (page % 4).cast("int").alias("mode"),
    )
    one = base.filter(page_mod(5, 1)).withColumn("snapshot", F.lit("a"))
    two = base.filter(page_mod(7, 1)).select(
        "path",
        "inode",
        (F.col("size") + F.when(F.col("inode") % 13 == 0, 5).otherwise(0)).alias("size"),
        F.when(F.col("inode") % 13 == 0, F.lit("changed")).otherwise(F.col("content")).alias("content"),
        F.when(F.col("inode") % 17 == 0, "dir").otherwise(F.col("type")).alias("type"),
        F.when(F.col("inode") % 3 == 0, 9).otherwise(F.col("mode")).alias("mode"),
        F.lit("b").alias("snapshot"),
    )
    return one.unionByName(two)


def page_mod(n: int, skip: int):
    return F.col("page_id") % n != skip


NODES = """
page_nodes AS (
  SELECT '/' || regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') || '/p' || page_id AS path, page_id::BIGINT AS inode, length(html)::BIGINT AS size, md5(html) AS content,
         CASE WHEN page_id % 11 = 0 THEN 'symlink' ELSE 'file' END AS type, (page_id % 4)::INTEGER AS mode
  FROM pages),
nodes AS (
  SELECT path, inode, size, content, type, mode, 'a' AS snapshot FROM page_nodes WHERE inode % 5 <> 1
  UNION ALL
  SELECT path, inode, size + CASE WHEN inode % 13 = 0 THEN 5 ELSE 0 END, CASE WHEN inode % 13 = 0 THEN 'changed' ELSE content END,
         CASE WHEN inode % 17 = 0 THEN 'dir' ELSE type END, CASE WHEN inode % 3 = 0 THEN 9 ELSE mode END, 'b'
  FROM page_nodes WHERE inode % 7 <> 1)"""


def with_sql(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes) + "\n"
