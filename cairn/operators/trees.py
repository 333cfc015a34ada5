"""Trees of files: walks, listings, differences, merges, statistics."""

from __future__ import annotations

import hashlib
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from cairn.functions import globs, numbers, paths
from cairn.plans.cuts import cut, sided, written


def walk(edges: DataFrame, roots: DataFrame, depth: int = 64, prune: Column | None = None) -> DataFrame:
    """(root, path, key, level) of everything below the roots. edges: parent, name, child; written once, before. A level
    is one join, written before the next; deeper levels than `depth` are an error. Nodes for which `prune` holds (over
    root, path, key, level) are given, but not what is below them. Trees must not have cycles."""
    edges = written(edges.select("parent", "name", "child"))
    level = roots.select("root", F.lit("").alias("path"), F.col("root").alias("key"), F.lit(0).alias("level"))
    out, n, rows = level, 0, level.count()
    while True:
        n += 1
        open_nodes = level if prune is None else level.filter(~F.coalesce(prune, F.lit(False)))
        level = written(
            edges.join(sided(open_nodes, rows), F.col("key") == F.col("parent"))
            .select("root", F.concat("path", F.lit("/"), "name").alias("path"), F.col("child").alias("key"), F.lit(n).alias("level"))
        )
        rows = level.count()
        if not rows:
            return out
        if n > depth:
            raise ValueError(f"tree deeper than {depth}")
        out = out.unionByName(level)


def visit(edges: DataFrame, roots: DataFrame, skip: Column, depth: int = 64) -> DataFrame:
    """(root, path, type, key, level) of the nodes that a visitor sees who may skip. edges: parent, name, type, child.

    `skip` is asked of each node (root, path, name, type, key, level). A directory for which it holds is seen, but not
    entered; a node of another type for which it holds is seen, and ends its directory: names after it are not. A level
    is a join and a small aggregate, written before the next. What to do with each node is a DataFrame step after this.
    """
    edges = written(edges.select("parent", "name", "type", "child"))
    level = roots.select("root", F.lit("").alias("path"), F.lit("dir").alias("type"), F.col("root").alias("key"), F.lit(0).alias("level"))
    out, skipped, columns = level, F.coalesce(skip, F.lit(False)), ["root", "path", "type", "key", "level"]
    for n in range(1, depth + 2):
        rows = level.count()
        parents = level.select("root", F.col("path").alias("_dir"), F.col("key").alias("parent"))
        kids = written(
            edges.join(sided(parents, rows), "parent")
            .select("root", "_dir", F.concat("_dir", F.lit("/"), "name").alias("path"), "name", "type", F.col("child").alias("key"), F.lit(n).alias("level"))
            .withColumn("_skip", skipped)
        )
        ends = kids.filter(F.col("_skip") & (F.col("type") != "dir")).groupBy("root", "_dir").agg(F.min("name").alias("_end"))
        seen = cut(kids.join(ends, ["root", "_dir"], "left").filter(F.col("_end").isNull() | (F.col("name") <= F.col("_end"))))
        if seen.isEmpty():
            return out
        if n > depth:
            break
        out = out.unionByName(seen.select(*columns))
        level = seen.filter((F.col("type") == "dir") & ~F.col("_skip")).select(*columns)
    raise ValueError(f"tree deeper than {depth}")


ATTRIBUTES = ["size", "content", "type", "mode"]


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and flag of what differs: + added, - removed, M content, T type, U attributes only."""
    a = old.select("path", *(F.col(c).alias(f"a_{c}") for c in ATTRIBUTES), F.lit(True).alias("in_a"))
    b = new.select("path", *(F.col(c).alias(f"b_{c}") for c in ATTRIBUTES), F.lit(True).alias("in_b"))
    differ = lambda c: ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    flag = (
        F.when(F.col("in_a").isNull(), "+").when(F.col("in_b").isNull(), "-").when(differ("type"), "T")
        .when(differ("content"), "M").when(differ("mode") | differ("size"), "U")
    )
    joined = a.join(b, "path", "full_outer").withColumn("flag", flag).filter("flag IS NOT NULL")
    return joined.select("path", "flag", F.coalesce("a_size", F.lit(0)).alias("old_size"), F.coalesce("b_size", F.lit(0)).alias("new_size"))


def diff_statistics(old: DataFrame, new: DataFrame) -> DataFrame:
    d = diff(old, new)
    flags = d.agg(
        *(F.count_if(F.col("flag") == f).cast("long").alias(n) for n, f in (("added", "+"), ("removed", "-"), ("changed", "M"), ("retyped", "T"), ("touched", "U"))),
        F.coalesce(F.sum(F.when(F.col("flag") == "+", F.col("new_size"))), F.lit(0)).cast("long").alias("added_bytes"),
        F.coalesce(F.sum(F.when(F.col("flag") == "-", F.col("old_size"))), F.lit(0)).cast("long").alias("removed_bytes"),
    )
    a, b = old.select("content").distinct(), new.select("content").distinct()
    blobs = lambda x, y, n: x.join(y, "content", "left_anti").agg(F.count("*").cast("long").alias(n))
    return flags.join(F.broadcast(blobs(b, a, "new_blobs"))).join(F.broadcast(blobs(a, b, "old_blobs")))  # one row each


def merge(versions: DataFrame) -> DataFrame:
    """Union of trees: the newest version of each path. versions: path, time and attributes. Where the newest of a
    path is no directory, older things below it go."""
    newest = Window.partitionBy("path").orderBy(F.desc("time"))
    top = versions.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    files = top.filter("type <> 'dir'").select(F.col("path").alias("blocker"))
    blocked = top.filter(F.size(parts) > 2).select("path", F.explode(above).alias("blocker")).join(files, "blocker", "left_semi")
    return top.join(blocked.select("path").distinct(), "path", "left_anti")


def find(nodes: DataFrame, patterns: list[str], oldest: datetime | None = None, newest: datetime | None = None, ignore_case: bool = False) -> DataFrame:
    """Nodes that any pattern fits, modified within the window, both ends included."""
    out = nodes.filter(globs.select(F.col("path"), patterns, ignore_case))
    if oldest is not None:
        out = out.filter(F.col("mtime") >= F.lit(oldest))
    if newest is not None:
        out = out.filter(F.col("mtime") <= F.lit(newest))
    return out


def listing(nodes: DataFrame, order: str, reverse: bool = False) -> DataFrame:
    """Sorted by name, size, time or extension, ties by path; reverse turns everything round."""
    keys = {
        "name": [F.col("path")], "size": [F.col("size"), F.col("path")], "mtime": [F.col("mtime"), F.col("path")],
        "extension": [paths.extension(F.col("path")), F.col("path")],
    }[order]
    return nodes.orderBy(*(k.desc() if reverse else k.asc() for k in keys))


def restore_size(nodes: DataFrame) -> DataFrame:
    """Files and bytes of each snapshot; a hard-linked inode counts its bytes once."""
    first = F.row_number().over(Window.partitionBy("snapshot", "inode", "type").orderBy("path"))
    rows = nodes.withColumn("_n", first)
    return rows.groupBy("snapshot").agg(F.count("*").cast("long").alias("files"), F.sum(F.when(F.col("_n") == 1, F.col("size")).otherwise(0)).cast("long").alias("bytes"))


def files_by_content(nodes: DataFrame) -> DataFrame:
    """Distinct contents and their bytes, each by its first path."""
    first = Window.partitionBy("content").orderBy("path", "snapshot")
    once = nodes.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return once.agg(F.count("*").cast("long").alias("files"), F.sum("size").cast("long").alias("bytes"))


def blobs_per_file(blobs: DataFrame) -> DataFrame:
    """Distinct (file, blob) pairs and their bytes. blobs: pack_id as file, blob_id, length."""
    once = blobs.groupBy("pack_id", "blob_id").agg(F.min("length").alias("length"))
    return once.agg(F.count("*").cast("long").alias("blobs"), F.sum("length").cast("long").alias("bytes"))


def raw_data(blobs: DataFrame) -> DataFrame:
    """Distinct blobs: stored and plain bytes, ratio and saving. blobs: blob_id, length, uncompressed (or null)."""
    once = blobs.groupBy("blob_id").agg(F.min("length").alias("length"), F.min("uncompressed").alias("plain"))
    stored = F.sum("length")
    plain = F.sum(F.coalesce("plain", "length"))
    return once.agg(
        F.count("*").cast("long").alias("blobs"), stored.cast("long").alias("stored_bytes"), plain.cast("long").alias("plain_bytes"),
        F.round(F.try_divide(plain.cast("double"), stored.cast("double")), 9).alias("ratio"),
        F.round(100 * (1 - F.try_divide(stored.cast("double"), plain.cast("double"))), 6).alias("saving"),
    )


def size_histogram(nodes: DataFrame, limit: int) -> DataFrame:
    """Files by decade of size; those above the limit in a bucket of their own."""
    b = F.when(F.col("size") > limit, -1).otherwise(numbers.decade(F.col("size"))).cast("int")
    return nodes.groupBy(b.alias("bucket")).agg(F.count("*").cast("long").alias("files"), F.sum("size").cast("long").alias("bytes"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """Every directory above a path that is not itself listed."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    dirs = nodes.filter(F.size(parts) > 2).select(F.explode(above).alias("path")).distinct()
    return dirs.join(nodes.select("path"), "path", "left_anti")


def collapse(paths_df: DataFrame) -> DataFrame:
    """Paths that lie below no other path of the set."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    tops = paths_df.select(F.col("path").alias("top")).distinct()
    below = paths_df.filter(F.size(parts) > 2).select("path", F.explode(above).alias("top")).join(tops, "top", "left_semi").select("path")
    return paths_df.select("path").distinct().join(below.distinct(), "path", "left_anti")


def rewrite(nodes: DataFrame, drop: list[str]) -> DataFrame:
    """The tree without what the patterns fit, and its size."""
    kept = nodes.filter(~globs.select(F.col("path"), drop))
    return kept.groupBy("snapshot").agg(F.count("*").cast("long").alias("files"), F.sum("size").cast("long").alias("bytes"))


def range_of_file(content: DataFrame, start: int, length: int) -> DataFrame:
    """The chunks that a byte range of each file touches. content: file, ordinal, blob_id, length."""
    w = Window.partitionBy("file").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    rows = content.withColumn("end", F.sum("length").over(w)).withColumn("begin", F.col("end") - F.col("length"))
    rows = rows.filter((F.col("begin") < start + length) & (F.col("end") > start))
    return rows.select("file", "ordinal", "blob_id", F.greatest(F.lit(0), start - F.col("begin")).cast("long").alias("from"), F.least(F.col("length"), start + length - F.col("begin")).cast("long").alias("to"))


def fixed_chunks(texts: DataFrame, size: int) -> DataFrame:
    """Chunks of a fixed number of characters with their SHA-256. texts: id, text."""
    n = F.ceil(F.length("text") / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("text"), i * size + 1, F.lit(size)))
    rows = texts.filter(F.length("text") > 0).select("id", F.posexplode(cut).alias("ordinal", "chunk"))
    return rows.select("id", "ordinal", F.sha2("chunk", 256).alias("blob_id"), F.length("chunk").cast("long").alias("length"))


def content_id(chunks: DataFrame) -> DataFrame:
    """SHA-256 of the ordered chunk ids of each file."""
    g = chunks.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "blob_id"))).alias("c"))
    return g.select("id", F.sha2(F.array_join("c.blob_id", ""), 256).alias("content_id"), F.size("c").cast("long").alias("chunks"))


def rewrite_nodes(nodes: DataFrame, drop: Column, **changes: Column) -> DataFrame:
    """The nodes with changed columns; those for which `drop` holds go, and with a directory all that is below it."""
    gone = nodes.filter(drop).select("snapshot", F.col("path").alias("top"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    below = nodes.select("snapshot", "path", F.explode(above).alias("top")).join(gone, ["snapshot", "top"], "left_semi").select("snapshot", "path").distinct()
    return nodes.join(below, ["snapshot", "path"], "left_anti").withColumns(changes)


def resolve(edges: DataFrame, root: str | int, path: str) -> DataFrame:
    """key of what `path` names below a root; a missing component is an error. edges: parent, name, child."""
    at = root
    for name in (p for p in path.split("/") if p):
        found = edges.filter((F.col("parent") == at) & (F.col("name") == name)).select("child").limit(1).collect()
        if not found:
            raise ValueError(f"{path!r}: nothing named {name!r}")
        at = found[0]["child"]
    return edges.sparkSession.createDataFrame([(at,)], StructType([StructField("key", edges.schema["child"].dataType)]))


def content_chunks(texts: DataFrame, key: str, text: str, least: int = 512, average_bits: int = 10, most: int = 8192) -> DataFrame:
    """key, ordinal, offset, length, sha256: pieces of each text's UTF-8 bytes, cut where the content says so.

    A cut follows a byte where the lowest bits of a hash of the last 64 bytes are zero, never within `least` bytes of the
    piece's begin, and at `most` bytes at the latest. So an insertion moves only the cuts near it. Null texts have none.
    """

    @F.pandas_udf("array<struct<ordinal:int,offset:long,length:long,sha256:string>>")
    def cuts(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            raw = v.encode() if isinstance(v, str) else b""
            ends = chunk_ends(raw, least, average_bits, most)
            out.append([{"ordinal": i, "offset": a, "length": b - a, "sha256": hashlib.sha256(raw[a:b]).hexdigest()} for i, (a, b) in enumerate(zip([0, *ends], ends, strict=False))])
        return pd.Series(out, dtype=object)

    return texts.filter(F.col(text).isNotNull()).select(key, F.inline(cuts(text)))


#: A number for each byte, drawn from a fixed seed.
GEAR = np.random.default_rng(1).integers(0, 1 << 63, 256, dtype=np.uint64)


def chunk_ends(raw: bytes, least: int, average_bits: int, most: int) -> list[int]:
    h, size = GEAR[np.frombuffer(raw, dtype=np.uint8)], 1
    while size < 64:  # by doubling: the hash of the last 2n bytes from two of n
        shifted = np.zeros_like(h)
        shifted[size:] = h[:-size] << np.uint64(size) if len(h) > size else 0
        h, size = h + shifted, 2 * size
    marks = np.flatnonzero(h & np.uint64((1 << average_bits) - 1) == 0) + 1
    out, at = [], 0
    while at < len(raw):
        i = int(np.searchsorted(marks, at + least))
        end = min(int(marks[i]) if i < len(marks) else len(raw), at + most, len(raw))
        out.append(end)
        at = end
    return out
