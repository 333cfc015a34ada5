"""Histories: states in force, changes, islands of equal states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(versions: DataFrame, commit: int) -> DataFrame:
    """The binding of every path at a commit. versions: path, commit, state and the rest."""
    rest = [c for c in versions.columns if c != "path"]
    past = versions.filter(F.col("commit") <= commit).groupBy("path").agg(F.max_by(F.struct(*rest), F.struct("commit", *[c for c in rest if c != "commit"])).alias("b"))
    return past.select("path", "b.*")


def binding_changes(versions: DataFrame, attributes: list[str]) -> DataFrame:
    """Versions whose binding differs from the one before; the first counts as a change."""
    order = Window.partitionBy("path").orderBy("commit")
    differs = F.lag("commit").over(order).isNull()
    for a in attributes:
        differs = differs | ~F.col(a).eqNullSafe(F.lag(a).over(order))
    return versions.withColumn("_d", differs).filter("_d").drop("_d")


def coalesced(versions: DataFrame, attributes: list[str]) -> DataFrame:
    """Runs of equal consecutive states: first and last commit, how many, and what kind of change began each."""
    order = Window.partitionBy("path").orderBy("commit")
    previous = {a: F.lag(a).over(order) for a in attributes}
    first = F.lag("commit").over(order).isNull()
    differs = first
    for a in attributes:
        differs = differs | ~F.col(a).eqNullSafe(previous[a])
    was_gone = F.lag("state").over(order) == "deleted"
    kind = (
        F.when(first | (was_gone & (F.col("state") != "deleted")), "created").when(F.col("state") == "deleted", "deleted")
        .when(~F.col("inode").eqNullSafe(F.lag("inode").over(order)), "rebound").otherwise("modified")
    )
    rows = versions.withColumn("_d", differs.cast("int")).withColumn("kind", kind)
    rows = rows.withColumn("island", F.sum("_d").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("path", "island").agg(
        F.min("commit").alias("first_commit"), F.max("commit").alias("last_commit"), F.count("*").cast("long").alias("commits"), F.min_by("kind", "commit").alias("kind")
    )


def content_flags(revisions: DataFrame) -> DataFrame:
    """Whether each revision of an inode changed its content or only its attributes. revisions: inode, revision, content."""
    order = Window.partitionBy("inode").orderBy("revision")
    before = F.lag("content").over(order)
    first = F.lag("revision").over(order).isNull()
    return revisions.select("inode", "revision", (first | ~F.col("content").eqNullSafe(before)).alias("content_changed"), (~first & F.col("content").eqNullSafe(before)).alias("metadata_only"))


def commit_range(versions: DataFrame, since: int, until: int) -> DataFrame:
    return versions.filter((F.col("commit") >= since) & (F.col("commit") < until))
