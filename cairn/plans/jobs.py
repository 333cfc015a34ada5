"""Jobs over segments that a later run resumes: aggregates of a query, rebuilds of a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import facts as ops
from cairn.plans.cuts import cut
from cairn.plans.query import Query
from cairn.sources.layers import stored


def resume(source: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, segments: int | None = None) -> bool:
    """Builds the rows of segments that are not done, so many at most, and says whether all are done.

    `source` has a column `segment`, which `build` keeps. Rows lie in a folder for each segment; a segment worked on
    again, after a run that failed before it noted what it did, replaces its folder, so it counts once. The path
    belongs to one build over one version of the source. Segment numbers stay in Spark.
    """
    spark = source.sparkSession
    every = source.select("segment").distinct()
    left = lambda: every.join(stored(spark, f"{path}/done", "segment long"), "segment", "left_anti")
    picked = cut(left() if segments is None else left().orderBy("segment").limit(segments))
    if not picked.isEmpty():
        rows = build(source.join(picked, "segment", "left_semi"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment").parquet(f"{path}/rows")
        picked.write.mode("append").parquet(f"{path}/done")
    return left().isEmpty()


def built(spark, path: str, schema: str) -> DataFrame:
    """The rows of the segments that are done."""
    done = stored(spark, f"{path}/done", "segment long").distinct()
    return stored(spark, f"{path}/rows", schema).join(done, "segment", "left_semi")


def partial_groups(query: Query) -> Callable[[DataFrame], DataFrame]:
    """The groups of a query in each segment."""

    def build(facts: DataFrame) -> DataFrame:
        rows = facts.filter(query.validate().condition())
        keyed = rows.select("segment", *(ops.dimension(n) for n in query.group_by), "logical_size", "created_at")
        return keyed.groupBy("segment", *query.group_by).agg(*ops.measures())

    return build


def result(spark, path: str, query: Query) -> DataFrame:
    """The groups of the query over all segments done."""
    columns = ", ".join(f"`{c}` string" for c in query.group_by)
    schema = f"{columns + ', ' if columns else ''}files long, logical_bytes long, unknown_creation long, segment long"
    return ops.roll_up(built(spark, path, schema), list(query.group_by))
