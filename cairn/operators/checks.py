"""Consistency checks: two sides compared, expected against stored, sampled verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def compare(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys that only one side has, or whose values differ: missing (left only), unexpected (right only), different."""
    a = left.select(*keys, F.struct(*values).alias("want"), F.lit(True).alias("l"))
    b = right.select(*keys, F.struct(*values).alias("got"), F.lit(True).alias("r"))
    kind = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "unexpected").when(~F.col("want").eqNullSafe(F.col("got")), "different")
    return a.join(b, keys, "full_outer").withColumn("kind", kind).filter("kind IS NOT NULL").select("kind", *keys)


def except_both_ways(left: DataFrame, right: DataFrame) -> DataFrame:
    """Multiset difference in both directions."""
    only = lambda x, y, kind: x.exceptAll(y).withColumn("kind", F.lit(kind))
    return only(left, right, "missing").unionByName(only(right, left, "unexpected"))


def three_way(catalog: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Packs of a catalog against two summaries of their blobs. All: pack_id, blobs, bytes."""
    sides = {"c": catalog, "o": old, "n": new}
    out = None
    for k, df in sides.items():
        part = df.select("pack_id", F.col("blobs").alias(f"{k}_blobs"), F.col("bytes").alias(f"{k}_bytes"))
        out = part if out is None else out.join(part, "pack_id", "full_outer")
    has = lambda k: F.col(f"{k}_blobs").isNotNull()
    same = lambda a, b: (F.col(f"{a}_blobs") == F.col(f"{b}_blobs")) & (F.col(f"{a}_bytes") == F.col(f"{b}_bytes"))
    kind = (
        F.when(~has("c"), "not in catalog").when(~has("o") & ~has("n"), "catalog only").when(~has("o"), "missing in old")
        .when(~has("n"), "missing in new").when(~same("o", "n"), "summaries differ").when(~same("c", "n"), "catalog differs")
    )
    return out.withColumn("kind", kind).filter("kind IS NOT NULL").select("pack_id", "kind")


def findings(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first findings in canonical order."""
    return rows.orderBy(*order).limit(limit)


def sample(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """The n rows with the least hash of seed and key: the same for every run."""
    score = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    return rows.withColumn("score", score).orderBy("score").limit(n)


def random_share(rows: DataFrame, percent: float, seed: int) -> DataFrame:
    """percent of the rows, rounded down but at least one, chosen by a hash of seed and row.

    Rows whose hash is clearly below the share's limit are taken as they are scanned; only those near the limit are
    sorted. Rows that are equal have different places in the order by their number among equals.
    """
    total = rows.count()
    wanted = max(1, int(total * percent / 100)) if total else 0
    hashed = rows.withColumn("_r", F.pmod(F.xxhash64(F.lit(seed), *rows.columns), F.lit(1 << 40)))
    slack = int((1 << 40) * min(1.0, 4 * (wanted**0.5 + 4) / max(total, 1)))
    at = int((1 << 40) * wanted / max(total, 1))
    sure = hashed.filter(F.col("_r") < at - slack)
    short = wanted - sure.count()
    near = hashed.filter((F.col("_r") >= at - slack) & (F.col("_r") <= at + slack))
    if short < 0 or near.count() < short:  # the hashes of repeated rows are not spread evenly
        sure, near, short = hashed.filter("false"), hashed, wanted
    return sure.unionByName(near.orderBy("_r", *rows.columns).limit(short)).drop("_r")


def reduce_references(edges: DataFrame, counters: DataFrame) -> DataFrame:
    """Blobs whose counted edges differ from the stored counter. edges: blob_id, kind; counters: blob_id, references."""
    counted = edges.groupBy("blob_id").agg(F.count_if(F.col("kind") == "content").cast("long").alias("counted"), F.count_if(F.col("kind") != "content").cast("long").alias("others"))
    joined = counted.join(counters, "blob_id", "full_outer").na.fill(0)
    return joined.filter(F.col("counted") != F.col("references")).select("blob_id", "counted", "others", F.col("references").alias("stored"))


def candidates(packs: DataFrame, placements: DataFrame, verified: DataFrame, types: list[str], since) -> DataFrame:
    """Live copies of packs of some types that were not verified since a time, the longest unverified first."""
    live = placements.filter("state = 'live'").select("pack_id", "backend")
    rows = packs.filter(F.col("type").isin(*types)).select("pack_id", "physical_size").join(live, "pack_id").join(verified, ["pack_id", "backend"], "left")
    return rows.filter(F.col("verified_at").isNull() | (F.col("verified_at") < F.lit(since)))


def rewrite_index(entries: DataFrame) -> DataFrame:
    """Keeps an index whose packs are all new in the order of indexes; of others only packs unseen before.
    entries: index_id, pack_id."""
    first = F.row_number().over(Window.partitionBy("pack_id").orderBy("index_id")) == 1
    rows = entries.distinct().withColumn("fresh", first)
    g = rows.groupBy("index_id").agg(F.count("*").cast("long").alias("packs"), F.count_if("fresh").cast("long").alias("fresh"))
    return g.withColumn("action", F.when(F.col("packs") == F.col("fresh"), "keep").when(F.col("fresh") == 0, "drop").otherwise("rewrite"))
