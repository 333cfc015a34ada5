"""Stored objects: listings against the catalog and each other, restore order, discovery, placement class, erasure."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Age from which data is worth promoting, if a policy names none.
CROSSOVER = "INTERVAL 8 DAYS"


def against_listing(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """Packs of only one side, by kind: 'missing' ones are lost, 'unknown' ones are waste. Both: pack_id."""
    a, b = catalog.select("pack_id").distinct(), listing.select("pack_id").distinct()
    lost = a.join(b, "pack_id", "left_anti").withColumn("kind", F.lit("missing"))
    return lost.unionByName(b.join(a, "pack_id", "left_anti").withColumn("kind", F.lit("unknown")))


def compare_mirrors(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Objects that two mirrors do not hold alike: presence first, then size, then content. Both: name, size, content."""
    both = hot.select("name", F.col("size").alias("a"), F.col("content").alias("ac"), F.lit(True).alias("h")).join(
        cold.select("name", F.col("size").alias("b"), F.col("content").alias("bc"), F.lit(True).alias("c")), "name", "full_outer"
    )
    kind = (
        F.when(F.col("c").isNull(), "missing in cold").when(F.col("h").isNull(), "missing in hot")
        .when(~F.col("a").eqNullSafe(F.col("b")), "size differs").when(~F.col("ac").eqNullSafe(F.col("bc")), "content differs")
    )
    return both.withColumn("kind", kind).filter("kind IS NOT NULL").select("name", "kind")


def totals_by_type(listing: DataFrame) -> DataFrame:
    """Objects and bytes of each type."""
    return listing.groupBy("type").agg(F.count("*").cast("long").alias("objects"), F.sum("size").cast("long").alias("bytes"))


def restore_plan(chunks: DataFrame, locations: DataFrame, present: DataFrame) -> DataFrame:
    """Where each chunk that must be read lies: file, ordinal, offset, length, pack_id, first_file, first_ordinal.

    chunks: file, ordinal, blob_id. locations: blob_id, pack_id, length, priority; the location of least priority
    counts. present: file, ordinal of chunks that the target holds already; these are left out but move the offsets
    on. Packs are to be read in the order of (first_file, first_ordinal), their first use. The query fails at a blob
    without a location.
    """
    first = locations.groupBy("blob_id").agg(F.min(F.struct("priority", "pack_id", "length")).alias("at"))
    placed = chunks.join(first, "blob_id", "left")
    known = F.assert_true(F.col("at").isNotNull(), F.concat(F.lit("unknown blob "), F.col("blob_id").cast("string")))
    placed = placed.filter(known.isNull()).select("file", "ordinal", F.col("at.pack_id").alias("pack_id"), F.col("at.length").alias("length"))
    before = Window.partitionBy("file").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    wanted = placed.join(present.select("file", "ordinal"), ["file", "ordinal"], "left_anti")
    order = wanted.groupBy("pack_id").agg(F.min(F.struct("file", "ordinal")).alias("use"))
    return wanted.join(order, "pack_id").select("file", "ordinal", "offset", "length", "pack_id", F.col("use.file").alias("first_file"), F.col("use.ordinal").alias("first_ordinal"))


def discovered_at(members: DataFrame, unreachable: DataFrame, known_packs: DataFrame, known_blobs: DataFrame, now: datetime) -> DataFrame:
    """When each pack was first found to be garbage: the earliest note of it or of a member that is unreachable.

    members: pack_id, blob_id; unreachable: blob_id; notes: pack_id or blob_id, and at. A pack's own note counts even
    if later than now; without notes it is now.
    """
    gone = members.join(unreachable.select("blob_id").distinct(), "blob_id", "left_semi").join(known_blobs, "blob_id")
    earliest = gone.groupBy("pack_id").agg(F.min("at").alias("of_blobs"))
    packs = members.select("pack_id").distinct().join(known_packs.groupBy("pack_id").agg(F.min("at").alias("own")), "pack_id", "left").join(earliest, "pack_id", "left")
    return packs.select("pack_id", F.least(F.coalesce("own", F.lit(now)), "of_blobs").alias("discovered_at"))


def placement_class(packs: DataFrame, eligibility: DataFrame, archive_retention: str | None, now: datetime, crossover: str = CROSSOVER) -> DataFrame:
    """pack_id and class: metadata, recent-data, archival-data or cache.

    eligibility: pack_id, evaluated_at, survival_until, indefinite, promoted. Data is archival if it was promoted, or
    if an archive exists (archive_retention, an interval, is its longest minimum retention), the pack is used and old
    enough, was evaluated after its creation, and is sure to survive that retention.
    """
    e = packs.join(eligibility, "pack_id", "left")
    at = F.lit(now)
    due = F.lit(False)
    if archive_retention is not None:
        due = (
            (F.col("used_bytes") > 0)
            & (F.col("evaluated_at") >= F.col("created_at"))
            & (at >= F.col("created_at") + F.expr(crossover))
            & (F.col("indefinite") | (F.col("survival_until") >= at + F.expr(archive_retention)))
        )
    archival = F.coalesce(F.col("promoted"), F.lit(False)) | F.coalesce(due, F.lit(False))
    kind = F.when(F.col("type") == "tree", "metadata").when((F.col("type") == "data") & archival, "archival-data").when(F.col("type") == "data", "recent-data").otherwise("cache")
    return e.select("pack_id", kind.alias("class"))


def erase_plan(references: DataFrame, members: DataFrame, uid: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(revisions to redact, blobs with their remaining references, packs to delete) to erase an owner.

    references: uid, inode, revision, blob_id; members: pack_id, blob_id. Packs go if they hold blobs of the owner
    and no blob that anyone else refers to.
    """
    redacted = references.filter(F.col("uid") == uid).select("inode", "revision").distinct()
    mine = F.coalesce(F.col("uid") == uid, F.lit(False))
    left = references.groupBy("blob_id").agg(F.count_if(~mine).cast("long").alias("remaining"), F.max(mine).alias("touched"))
    blobs = left.filter("touched").select("blob_id", "remaining")
    g = members.select("pack_id", "blob_id").distinct().join(left, "blob_id", "left").groupBy("pack_id").agg(
        F.coalesce(F.sum("remaining"), F.lit(0)).alias("remaining"), F.coalesce(F.max("touched"), F.lit(False)).alias("touched")
    )
    return redacted, blobs, g.filter((F.col("remaining") == 0) & F.col("touched")).select("pack_id")


def hard_links(edges: DataFrame) -> DataFrame:
    """child and its sorted 'parent/name' places, for children with several. edges: parent, name, child."""
    g = edges.groupBy("child").agg(F.array_sort(F.collect_set(F.concat_ws("/", "parent", "name"))).alias("links"))
    return g.filter(F.size("links") > 1)
