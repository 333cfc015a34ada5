"""Creation facts: construction, filters, grouped counts and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions import dates, numbers, paths

#: Dimensions a fact query may group by.
DIMENSIONS = ["uid", "gid", "year", "month", "iso_year", "workweek", "svm", "volume", "path_group", "residency", "size_log10", "identity_continuity", "creation_basis"]
IDENTITY = ["fsid", "inode", "generation"]


def make_facts(revisions: DataFrame, prefixes: list[str] | None = None, depths: tuple[int, int, int] = (1, 2, 3)) -> DataFrame:
    """Facts of inode revisions: creation time from ctime, else mtime, else unknown (null); calendar parts, decade of
    the size and path dimensions. residency is what the revision says, archive-only where it says nothing."""
    created = F.coalesce("ctime", "mtime")
    path = F.col("path")
    return revisions.select(
        *IDENTITY,
        "revision",
        "uid",
        "gid",
        created.alias("created_at"),
        F.when(F.col("ctime").isNotNull(), "ctime").when(F.col("mtime").isNotNull(), "mtime").otherwise("unknown").alias("creation_basis"),
        F.coalesce("continuity", F.lit("unknown")).alias("identity_continuity"),
        F.coalesce("state", F.lit("archive-only")).alias("residency"),
        path.alias("source_path"),
        *(c.alias(n) for n, c in dates.calendar(created).items()),
        paths.component(path, depths[0]).alias("svm"),
        paths.component(path, depths[1]).alias("volume"),
        paths.classify(path, prefixes or [], depths[2]).alias("path_group"),
        F.col("size").alias("logical_size"),
        numbers.size_log10(F.col("size")).alias("size_log10"),
    )


def dimension(name: str) -> Column:
    """A group key as text, 'unknown' where the value is."""
    if name not in DIMENSIONS:
        raise ValueError(f"unknown dimension {name!r}")
    return F.coalesce(F.col(name).cast("string"), F.lit("unknown")).alias(name)


def current(facts: DataFrame, version: str = "epoch") -> DataFrame:
    """The newest row of every identity."""
    newest = Window.partitionBy(*IDENTITY).orderBy(F.desc(version))
    return facts.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def with_residency(facts: DataFrame, overlay: DataFrame) -> DataFrame:
    """Facts with the overlay's state where it has one."""
    over = overlay.select(*IDENTITY, F.col("state").alias("_state"))
    joined = facts.join(over, IDENTITY, "left")
    return joined.withColumn("residency", F.coalesce("_state", "residency")).drop("_state")


def with_names(facts: DataFrame, key: str, dictionary: DataFrame, name: str) -> DataFrame:
    """Replaces a dictionary number by its text; 0 and numbers without text are 'unknown'."""
    d = dictionary.select(F.col("id").alias("_id"), F.col("value").alias("_value")).filter("_id <> 0")
    return facts.join(d, facts[key] == d["_id"], "left").withColumn(name, F.coalesce("_value", F.lit("unknown"))).drop("_id", "_value")




def measures() -> list[Column]:
    return [
        F.count("*").cast("long").alias("files"),
        F.coalesce(F.sum("logical_size"), F.lit(0)).cast("long").alias("logical_bytes"),
        F.count_if(F.col("created_at").isNull()).cast("long").alias("unknown_creation"),
    ]


def grouped(facts: DataFrame, by: list[str], totals: bool = False) -> DataFrame:
    """Files, known bytes and unknown creation times of every group; with totals, a row of nulls for all."""
    keyed = facts.select(*(dimension(n) for n in by), "logical_size", "created_at")
    if not by:
        return keyed.agg(*measures())
    if totals:
        return keyed.groupingSets([by, []], *by).agg(*measures())
    return keyed.groupBy(*by).agg(*measures())


def roll_up(groups: DataFrame, by: list[str]) -> DataFrame:
    """A coarser grouping from a finer one; all measures are sums."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("files", "logical_bytes", "unknown_creation")]
    return groups.groupBy(*by).agg(*sums)


def first_revisions(revisions: DataFrame) -> DataFrame:
    first = Window.partitionBy("fsid", "inode").orderBy("revision")
    return revisions.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def revision_generations(generations: DataFrame, revisions: DataFrame) -> DataFrame:
    """Each revision with the generation in force: generation <= revision < the next generation of the inode."""
    span = generations.select("fsid", "inode", "generation", F.lead("generation").over(Window.partitionBy("fsid", "inode").orderBy("generation")).alias("next"))
    r = revisions.select("fsid", "inode", "revision")
    return r.join(span, ["fsid", "inode"]).filter("revision >= generation AND (next IS NULL OR revision < next)").select("fsid", "inode", "revision", "generation")
