"""Reports over facts: growth, owners, erasure audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNITS = ["year", "month", "week"]


def time_roll_up(facts: DataFrame, scopes: tuple[str, ...] = ("path_group", "uid")) -> DataFrame:
    """Files and bytes created in every year, month and ISO week, overall and by each scope, in one pass.

    Unknown creation times take no part; an unknown scope value is 'unknown'.
    """
    starts = F.array(*(F.struct(F.lit(u).alias("unit"), F.date_trunc(u, "created_at").alias("start")) for u in UNITS))
    over = [F.struct(F.lit("all").alias("scope"), F.lit("").alias("value"))]
    over += [F.struct(F.lit(s).alias("scope"), F.coalesce(F.col(s).cast("string"), F.lit("unknown")).alias("value")) for s in scopes]
    rows = facts.filter(F.col("created_at").isNotNull()).select("logical_size", F.explode(starts).alias("t"), F.array(*over).alias("over"))
    rows = rows.select("logical_size", "t.unit", "t.start", F.explode("over").alias("o"))
    return rows.groupBy("unit", "start", "o.scope", "o.value").agg(
        F.count("*").cast("long").alias("files"), F.coalesce(F.sum("logical_size"), F.lit(0)).cast("long").alias("logical_bytes")
    )


def growth(facts: DataFrame, unit: str) -> DataFrame:
    """Files and bytes by creation bucket, with the running total."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}")
    per = facts.filter(F.col("created_at").isNotNull()).groupBy(F.date_trunc(unit, "created_at").alias("start")).agg(
        F.count("*").cast("long").alias("files"), F.coalesce(F.sum("logical_size"), F.lit(0)).cast("long").alias("logical_bytes")
    )
    so_far = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, 0)  # a row for each bucket of time
    return per.withColumn("total_bytes", F.sum("logical_bytes").over(so_far).cast("long"))


def owner_summary(facts: DataFrame, owner: str) -> DataFrame:
    return facts.groupBy(F.coalesce(F.col(owner).cast("string"), F.lit("unknown")).alias(owner), "residency").agg(
        F.count("*").cast("long").alias("files"), F.coalesce(F.sum("logical_size"), F.lit(0)).cast("long").alias("logical_bytes")
    )


def owner_ranking(facts: DataFrame, owner: str, limit: int) -> DataFrame:
    """The largest owners by bytes, files, then id; unknown owners take no part."""
    s = owner_summary(facts.filter(F.col(owner).isNotNull()), owner).withColumn(owner, F.col(owner).cast("long"))
    return s.orderBy(F.desc("logical_bytes"), F.desc("files"), owner, "residency").limit(limit)


def audit_blobs(references: DataFrame, packs: DataFrame, uid: int) -> DataFrame:
    """Blobs that an owner's files refer to: references, first sight, whether they outlive the owner, and retention.

    references: uid, inode, blob_id, pack_id, seen. A blob survives if another owner refers to it.
    """
    all_refs = references.groupBy("blob_id").agg(
        F.count_if(F.col("uid") == uid).cast("long").alias("own_refs"),
        F.count_if(F.coalesce(F.col("uid") != uid, F.lit(True))).cast("long").alias("other_refs"),
        F.min(F.when(F.col("uid") == uid, F.col("seen"))).alias("first_seen"),
    )
    own = references.filter(F.col("uid") == uid).select("blob_id", "pack_id").distinct()
    kept = own.join(packs.select("pack_id", "min_retention_until"), "pack_id", "left").groupBy("blob_id").agg(
        F.count("*").cast("long").alias("packs"), F.max("min_retention_until").alias("retained_until")
    )
    return kept.join(all_refs, "blob_id").withColumn("survives", F.col("other_refs") > 0)


def audit_inodes(facts: DataFrame, uid: int) -> DataFrame:
    return facts.filter(F.col("uid") == uid).select("fsid", "inode", "residency", "logical_size")


#: References that one task sorts, about.
TASK_ROWS = 1_000_000


def other_references(references: DataFrame, uid: int, limit: int) -> DataFrame:
    """For the owner's blobs, how many references others hold and the first inodes that hold them.

    The references are dealt by blob to as many tasks as their number asks for and read in order, the owner's first; of
    each blob only the first inodes and the last rank are kept, so a task holds a part of bounded size and no table.
    """
    other = F.coalesce(F.col("uid") != uid, F.lit(True)).alias("other")
    rows = references.filter("blob_id IS NOT NULL").select("blob_id", "inode", other)
    dealt = rows.repartition(max(1, -(-rows.count() // TASK_ROWS)), "blob_id")
    inode = F.asc_nulls_last("inode")
    blob = Window.partitionBy("blob_id").orderBy("other", inode)
    ranked = dealt.select(
        "blob_id", "inode", "other", F.dense_rank().over(Window.partitionBy("blob_id", "other").orderBy(inode)).alias("n"),
        F.min("other").over(blob.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("foreign"), F.lead("other").over(blob).isNull().alias("last"),
    )
    kept = ranked.filter(F.col("other") & ~F.col("foreign") & ((F.col("n") <= limit) | F.col("last")))
    return kept.groupBy("blob_id").agg(F.max("n").cast("long").alias("sources"), F.array_sort(F.collect_set(F.when(F.col("n") <= limit, F.col("inode")))).alias("first_sources"))


def audit_locations(references: DataFrame, packs: DataFrame, placements: DataFrame, backends: DataFrame, uid: int) -> DataFrame:
    """Where the blobs that an owner's files refer to lie: each pack that holds one, and each placement of it with its
    backend. A pack that no backend holds is one row without a backend; deleted placements are no location."""
    own = references.filter(F.col("uid") == uid).select("blob_id", "pack_id").distinct()
    there = placements.filter("state <> 'deleted'").select("pack_id", "backend", "state").join(backends.select("backend", "role", "offsite"), "backend", "left")
    held = packs.select("pack_id", "lifecycle", "min_retention_until")
    return own.join(held, "pack_id", "left").join(there, "pack_id", "left")


def view_drift(stored: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """Groups of a stored view that differ from the same view computed afresh from the facts: kind is 'missing',
    'unexpected' or 'different'. Null group values are values."""
    measures = [c for c in expected.columns if c not in by]
    a = stored.select(*by, F.struct(*(F.col(c).cast(expected.schema[c].dataType) for c in measures)).alias("a"))
    b = expected.select(*(F.col(c).alias(f"_{c}") for c in by), F.struct(*measures).alias("b"))
    on = [a[c].eqNullSafe(b[f"_{c}"]) for c in by]
    joined = a.join(b, on, "full_outer")
    kind = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "unexpected").when(~F.col("a").eqNullSafe(F.col("b")), "different")
    return joined.withColumn("kind", kind).filter("kind IS NOT NULL").select(*(F.coalesce(c, f"_{c}").alias(c) for c in by), "kind")
