"""Packing: clusters given from outside, repeated rows, and what sharding costs."""

import collections

from pyspark.sql import functions as F

from cairn.llm import jaccard, packing


def test_clusters_of_the_jaccard_join(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i // 4}x{j}" for j in range(60)) + f" end{i}", "s") for i in range(80)], "doc_id long, text string, source string")
    found = jaccard.similar_components(docs, 4, 85).select("doc_id", "component_id")
    got = packing.pack(docs.join(found, "doc_id"), capacity=256, source_limit=4, cluster=F.col("component_id")).collect()
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.bin].append(r)
    assert len(got) == 80 and len({r.cluster for r in got}) == 20
    assert all(len({r.cluster for r in x}) == len(x) for x in bins.values()) and max(map(len, bins.values())) == 4
    alone = packing.pack(docs.withColumn("none", F.lit(None).cast("long")), capacity=256, source_limit=4, cluster=F.col("none"))
    assert alone.agg(F.countDistinct("bin"), F.count("cluster")).first() == (20, 0)


def test_repeated_rows_spread_over_shards(spark):
    docs = spark.range(2000).selectExpr("cast(1 as bigint) doc_id", "repeat('word ', 100) text", "'s' source")
    got = packing.pack(docs, shard_rows=100).selectExpr("bin >> 32 as shard", "bin", "length").cache()
    assert got.count() == 2000 and got.agg(F.countDistinct("bin"), F.sum("length")).first() == (2000, 200_000)
    sizes = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 150


def test_shards_cost_few_bins(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bins = [packing.pack(docs, shard_rows=n).select("bin").distinct().count() for n in (250, 10**9)]
    assert bins[0] <= 1.05 * bins[1]
