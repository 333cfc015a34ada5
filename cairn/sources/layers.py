"""Tables kept as layers: Parquet folders of changed rows, of which the newest row of a key counts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at the path; an empty one of the schema if nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def add(df: DataFrame, path: str, n: int) -> None:
    """Writes layer n; writing it again replaces it. Rows with `deleted` (optional) take their key away."""
    flagged = df if "deleted" in df.columns else df.withColumn("deleted", F.lit(False))
    flagged.write.mode("overwrite").parquet(f"{path}/layer={n}")


def newest(spark: SparkSession, path: str) -> int:
    """The number of the last layer; -1 without any. Only folder names and row counts are read."""
    return stored(spark, path, "layer int").agg(F.coalesce(F.max("layer"), F.lit(-1))).first()[0]


def read(spark: SparkSession, path: str, key: list[str], upto: int | None = None) -> DataFrame:
    """The newest row of each key, in the layers up to a number if one is given; one shuffle on the key."""
    rows = spark.read.parquet(path)
    if upto is not None:
        rows = rows.filter(F.col("layer") <= upto)
    rest = [c for c in rows.columns if c not in (*key, "layer")]
    top = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "layer").alias("_row"))
    return top.filter("NOT _row.deleted").select(*key, *(F.col(f"_row.{c}").alias(c) for c in rest if c != "deleted"))
