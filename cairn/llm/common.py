"""Helpers that the corpus operators share: tables, lineage cuts, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a session with a local master may name none: it gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    root = root or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="cairn-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage in the shared folder.

    Files of frames no longer used are removed if the session sets spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables written below the shared folder as Parquet; leaving the block drops them, after failures too."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/cairn-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(text: Column) -> Column:
    """A to Z only; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one value whose fields are numbered, whatever the columns are called."""
    return F.struct(*(df[f"`{c.replace('`', '``')}`"].alias(f"c{i}") for i, c in enumerate(df.columns)))


def row_columns(columns: list[str], row: str = "row", **instead: Column) -> list[Column]:
    """The columns that `whole_row` took together, under their own names; `instead` replaces some."""
    return [(instead[c] if c in instead else F.col(row).getField(f"c{i}")).alias(c) for i, c in enumerate(columns)]


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """id, h and more columns. Rows equal in doc_id and text share id and h.

    id is the doc_id, 0 where that is null; h is a hash of the text whose lowest bit says whether doc_id is null. So
    neither is ever null, which keeps them whole numbers inside Python tasks and lets joins use plain equality.
    """
    h = F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(F.isnull("doc_id").cast("long"))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), h.alias("h"), *more)


def real_id(prefix: str = "") -> Column:
    return F.when(F.col(f"{prefix}h").bitwiseAND(F.lit(1)) == 0, F.col(f"{prefix}id"))


#: Rows of a slim table (a few whole numbers) in one partition, about.
SLIM = 250_000


def slim(df: DataFrame, rows: int) -> DataFrame:
    """The slim table in as many partitions as its rows need. In one partition Spark joins and groups it without a shuffle."""
    return df.coalesce(max(1, -(-rows // SLIM)))


def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges a, b -> id, root: each end and the smallest end connected with it, within every SLIM edges or so."""

    def joined(held: list[np.ndarray]) -> pd.DataFrame:
        ids, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        (x, y), root = at.reshape(2, -1), np.arange(len(ids))
        while len(x):
            low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
            apart = root[x] != root[y]
            x, y = x[apart], y[apart]
        return pd.DataFrame({"id": ids, "root": ids[root]})

    held, n = [], 0
    for pdf in batches:
        held.append(np.stack((pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64))))
        n += len(pdf)
        if n >= SLIM:
            yield joined(held)
            held, n = [], 0
    if n:
        yield joined(held)


def components(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Smallest node of each node's component. nodes(id), edges(a, b) -> (id, root). Without nodes: the ends of the edges.

    Each task first joins the edges it holds, so that only the connections between tasks are left: none if all edges
    fit into one partition. The number of jobs and tasks, which the driver keeps account of, is then small for a small
    graph, whatever the number of shuffle partitions. Edges are read twice, so they should be written or cheap.

    For what is left it alternates two joins until nothing changes: each edge is pulled to the smaller root of its ends,
    then roots jump to their own roots. Rounds grow with the logarithm of a chain's length. A hot root is only
    ever aggregated with min(), which Spark combines before its shuffle. Tables of a round are kept in as many
    partitions as their rows need, so that small graphs don't leave many tiny files behind.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
    if nodes is not None:
        edges = edges.unionByName(nodes.select(F.col("id").cast("long").alias("a"), F.col("id").cast("long").alias("b")))
    n_edges = edges.count()
    joined = cut(slim(edges, n_edges).mapInPandas(stars, "id long, root long"))
    if n_edges <= SLIM:
        return joined
    nodes = cut(joined.select("id").distinct())
    ends = F.array(F.struct(F.col("id").alias("a"), F.col("root").alias("b")), F.struct(F.col("root").alias("a"), F.col("id").alias("b")))
    both = cut(joined.filter("id <> root").select(F.explode(ends).alias("e")).select("e.a", "e.b"))
    n_nodes = nodes.count()
    few = lambda df: cut(slim(df, n_nodes))
    both = slim(both, both.count())
    labels = few(nodes.select("id", F.col("id").alias("root")))
    while True:
        # the smallest root among a node's neighbours, offered to the node and to its present root
        near = both.join(labels.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
        offers = near.groupBy(F.col("a").alias("id")).agg(F.min("rb").alias("offer"))
        offered = few(labels.join(offers, "id").filter("offer < root"))
        if offered.isEmpty():
            return labels
        better = offered.select("id", "offer").unionByName(offered.select(F.col("root").alias("id"), "offer"))
        better = better.groupBy("id").agg(F.min("offer").alias("offer"))
        hooked = few(labels.join(better, "id", "left").select("id", F.least("root", "offer").alias("root")))
        jump = hooked.select(F.col("id").alias("root"), F.col("root").alias("next"))
        hooked = few(hooked.join(jump, "root").select("id", F.col("next").alias("root")))
        jump = hooked.select(F.col("id").alias("root"), F.col("root").alias("next"))
        labels = few(hooked.join(jump, "root").select("id", F.col("next").alias("root")))
