"""Incremental facts: a change feed applied in micro-batches, each of which writes only what it changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cairn.sources.layers import stored

DELTA = "commit long, kind string, inode long, uid long, size long, state string, ref_op string, refs long"


def residency(state: F.Column, refs: F.Column) -> F.Column:
    """deleted files are archived while snapshots refer to them and expired after; unknown never proves deletion."""
    return F.when(state == "deleted", F.when(refs > 0, "archive-only").otherwise("expired")).otherwise(F.coalesce(state, F.lit("unknown")))


def changes(deltas: DataFrame) -> DataFrame:
    """One row for each inode in the deltas: the last owner and size (create, classify), the last source state, the
    last set of references, the steps (inc, dec) after it, and the last commit. Sums and maxima only, so that Spark
    combines an inode with very many deltas before its shuffle."""
    kind, op = F.col("kind"), F.col("ref_op")
    is_set = (kind == "refs") & (op == "set")
    sets = deltas.filter(is_set).groupBy(F.col("inode").alias("_i")).agg(F.max("commit").alias("_set"))
    step = F.when(op == "inc", F.col("refs")).when(op == "dec", -F.col("refs"))
    later = (kind == "refs") & (F.col("_set").isNull() | (F.col("commit") > F.col("_set")))
    last = lambda cond, *c: F.max(F.when(cond, F.struct("commit", *c)))
    return deltas.join(sets, F.col("inode") == F.col("_i"), "left").groupBy("inode").agg(
        last(kind.isin("create", "classify"), "uid", "size").alias("owner"),
        last(kind == "state", "state").alias("source"),
        last(is_set, F.col("refs").alias("base")).alias("base"),
        F.coalesce(F.sum(F.when(later, step)), F.lit(0)).alias("step"),
        F.max("commit").alias("upto"),
    )


def merged(rows: DataFrame) -> DataFrame:
    """Rows of `changes` from batches that followed each other in commit order, as if the batches had been one."""
    top = rows.groupBy("inode").agg(
        F.max("owner").alias("owner"), F.max("source").alias("source"), F.max("base").alias("base"),
        F.collect_list(F.struct("upto", "base", "step")).alias("parts"), F.max("upto").alias("upto"),
    )
    counts = lambda p: F.col("base").isNull() | (p["upto"] > F.col("base.commit")) | F.coalesce(p["base"]["commit"] == F.col("base.commit"), F.lit(False))
    step = F.aggregate(F.filter("parts", counts), F.lit(0).cast("long"), lambda a, p: a + p["step"])
    return top.select("inode", "owner", "source", "base", step.alias("step"), "upto")


def current(rows: DataFrame) -> DataFrame:
    """inode, uid, size, state, refs and the commit that last set the references. References below zero are an error."""
    refs = F.coalesce(F.col("base.base"), F.lit(0)) + F.col("step")
    sure = F.when(refs < 0, F.raise_error(F.lit("references below zero")).cast("long")).otherwise(refs)
    return rows.select("inode", "owner.uid", "owner.size", F.col("source.state").alias("state"), sure.alias("refs"), F.col("base.commit").alias("set_commit"))


def _marks(spark: SparkSession, path: str) -> DataFrame:
    return stored(spark, f"{path}/marks", "upto long, after long")


def watermark(spark: SparkSession, path: str) -> int:
    """The highest commit that is wholly applied; -1 before any."""
    return _marks(spark, path).agg(F.coalesce(F.max("upto"), F.lit(-1))).first()[0]


def layers(spark: SparkSession, path: str) -> DataFrame:
    """What the finished batches changed. A batch counts once its mark is written, after its rows."""
    return spark.read.parquet(f"{path}/changes").join(_marks(spark, path).select("after"), "after", "left_semi").drop("after")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The present state of each inode."""
    return current(merged(layers(spark, path)))


def _write(rows: DataFrame, path: str, after: int) -> int:
    """The rows of a batch under the watermark they follow, then its mark; returns the new watermark."""
    seen = Observation()
    rows.observe(seen, F.max("upto").alias("upto")).write.mode("overwrite").parquet(f"{path}/changes/after={after}")
    upto = seen.get["upto"]
    if upto is None:
        return after
    rows.sparkSession.range(1).select(F.lit(upto).cast("long").alias("upto")).coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/after={after}")
    return upto


def catch_up(spark: SparkSession, deltas: str, path: str, checkpoint: str, files_per_batch: int = 1) -> int:
    """Applies all deltas that are there in micro-batches; returns the watermark.

    A batch writes the rows of the inodes it changes and reads nothing of the state but the watermark, so its work grows
    with the batch alone. Commits up to the watermark are passed over. A batch that Spark repeats replaces its rows if it
    failed before its mark, and has none left to apply if it failed after; so a lost checkpoint costs time, not rows.
    """

    mark = watermark(spark, path)

    def one(batch: DataFrame, _: int) -> None:
        nonlocal mark
        mark = _write(changes(batch.filter(F.col("commit") > mark)), path, mark)

    stream = spark.readStream.schema(DELTA).option("maxFilesPerTrigger", files_per_batch).parquet(deltas)
    q = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return mark


def fold(spark: SparkSession, path: str, into: str) -> None:
    """Writes one row for each inode to a new folder, where the same stream can go on: keeps reading cheap after very
    many batches. The old folder stays as it is for those who read it."""
    _write(merged(layers(spark, path)), into, -2)


def view_changes(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """Signed change of a grouped view: new contributions less old ones, without zero rows."""
    part = lambda df, sign: df.select(by, F.lit(sign).cast("long").alias("files"), (sign * F.coalesce("size", F.lit(0))).alias("bytes"))
    sums = part(old, -1).unionByName(part(new, 1)).groupBy(by).agg(F.sum("files").cast("long").alias("files"), F.sum("bytes").cast("long").alias("bytes"))
    return sums.filter("files <> 0 OR bytes <> 0")
