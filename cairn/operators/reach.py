"""Reachability, garbage collection and prune planning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.plans.cuts import cut, sided, written


#: Rounds of a walk whose new keys are kept apart before they are written as one table.
ROUNDS = 8


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Every key reachable from the roots, each visited once. edges: parent, child; roots: key. Cycles, shared children
    and repeated edges are fine: a round joins only what is new, and writes only that. The edges are written once,
    before; they stay where they are while a round has few new keys."""
    edges = written(edges.select("parent", "child"))
    frontier = seen = written(roots.select("key").distinct())
    new = total = frontier.count()
    n = 0
    while True:
        step = edges.join(sided(frontier, new), F.col("key") == F.col("parent")).select(F.col("child").alias("key")).distinct()
        frontier = written(step.join(sided(seen, total), "key", "left_anti"))
        new = frontier.count()
        if not new:
            return seen
        n, total = n + 1, total + new
        seen = seen.unionByName(frontier)
        if n % ROUNDS == 0:
            seen = written(seen)


def unreferenced(blobs: DataFrame, references: DataFrame) -> DataFrame:
    return blobs.join(references.select("blob_id").distinct(), "blob_id", "left_anti")


def dangling(references: DataFrame, blobs: DataFrame) -> DataFrame:
    return references.join(blobs.select("blob_id").distinct(), "blob_id", "left_anti")


def orphan_roots(trees: DataFrame, edges: DataFrame) -> DataFrame:
    """Trees that are no subtree of another. trees: key; edges: parent, child."""
    return trees.join(edges.select(F.col("child").alias("key")).distinct(), "key", "left_anti")


def collectable(blobs: DataFrame, kept: DataFrame, reverse: DataFrame) -> DataFrame:
    """Blobs that nothing kept reaches, and that are trees or have no reverse reference."""
    loose = blobs.join(kept.select("blob_id").distinct(), "blob_id", "left_anti")
    known = reverse.select("blob_id", F.lit(True).alias("_r")).distinct()
    return loose.join(known, "blob_id", "left").filter("type = 'tree' OR _r IS NULL").drop("_r")


def pack_usage(packs: DataFrame, members: DataFrame, unreachable: DataFrame) -> DataFrame:
    """Used and unused payload by reachability; unaccounted where the members do not add up to the payload."""
    gone = unreachable.select("blob_id", F.lit(True).alias("_gone")).distinct()
    g = members.join(gone, "blob_id", "left").groupBy("pack_id").agg(
        F.sum(F.when(F.col("_gone"), 0).otherwise(F.col("length"))).cast("long").alias("u"), F.sum("length").cast("long").alias("t")
    )
    ok = F.col("t") == F.col("payload_size")
    joined = packs.select("pack_id", "payload_size").join(g, "pack_id", "left")
    return joined.select(
        "pack_id", F.coalesce(ok, F.lit(False)).alias("accounted"), F.when(ok, F.col("u")).alias("used_bytes"), F.when(ok, F.col("t") - F.col("u")).alias("unused_bytes")
    )


def prune_accounts(members: DataFrame, used: DataFrame) -> DataFrame:
    """Used, duplicate and unused blobs and bytes of each pack. Of the copies of a used blob one is kept: in the pack
    with the smallest id."""
    u = used.select("blob_id", F.lit(True).alias("_u")).distinct()
    copy = Window.partitionBy("blob_id").orderBy("pack_id", "ordinal")
    rows = members.join(u, "blob_id", "left").withColumn("_n", F.row_number().over(copy))
    state = F.when(F.col("_u").isNull(), "unused").when(F.col("_n") == 1, "used").otherwise("duplicate")
    rows = rows.withColumn("state", state)
    out = []
    for s in ("used", "duplicate", "unused"):
        out += [F.count_if(F.col("state") == s).cast("long").alias(f"{s}_blobs"), F.coalesce(F.sum(F.when(F.col("state") == s, F.col("length"))), F.lit(0)).cast("long").alias(f"{s}_bytes")]
    return rows.groupBy("pack_id").agg(*out)


def classify_packs(accounts: DataFrame, small: int) -> DataFrame:
    """remove: nothing used; repack: something unused or duplicate, or too small; keep: the rest."""
    waste = F.col("unused_bytes") + F.col("duplicate_bytes")
    plan = F.when(F.col("used_bytes") == 0, "remove").when((waste > 0) | (F.col("used_bytes") < small), "repack").otherwise("keep")
    return accounts.withColumn("waste", waste).withColumn("plan", plan)


def percentile_size(packs: DataFrame, percent: int, least: int, num: int, den: int) -> DataFrame:
    """num/den, rounded down, of the larger of a least size and the exact percentile of pack sizes (place n * percent / 100).

    The place is found 16 bits of the size at a time from counts, 65,536 at most, so no task sorts all sizes. Without
    packs the least size counts.
    """
    sizes = cut(packs.filter("physical_size IS NOT NULL").select(F.col("physical_size").cast("long").alias("v")))  # read four times
    found, place = None, None
    for shift in (48, 32, 16, 0):
        inside = sizes if found is None else sizes.filter(F.shiftright("v", shift + 16) == found)
        counts = inside.groupBy(F.shiftright("v", shift).alias("b")).count().orderBy("b").collect()
        if found is None:
            place = sum(r["count"] for r in counts) * percent // 100
        for r in counts:
            if place < r["count"]:
                found = r["b"]
                break
            place -= r["count"]
    target = max(least, found if found is not None else 0) * num // den
    return packs.sparkSession.range(1).select(F.lit(target).cast("long").alias("target"))


def candidate_order(classified: DataFrame, target: int) -> DataFrame:
    """Repack candidates in the order to take them: packs with trees first, then small ones, then by waste over use."""
    c = classified.filter("plan = 'repack'")
    order = [F.col("type") == "data", F.col("used_bytes") + F.col("waste") >= target, -F.try_divide(F.col("waste").cast("double"), F.col("used_bytes").cast("double")), F.col("pack_id")]
    return c.select("pack_id", "type", "used_bytes", "waste", *(o.alias(f"o{i}") for i, o in enumerate(order[:3])))


#: Candidates that are finished on the driver once no more can fit.
FEW = 50_000


def _prefix_sums(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """rows with `before`: the sum of `value` over all rows that come first. No task sorts everything: parts of the order
    are summed, and each starts at the sum of those before it."""
    parts = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = sorted(parts.groupBy("_part").agg(F.sum(value).alias("s")).collect())  # a row for each part
    begin, at = {}, 0
    for r in sums:
        begin[r["_part"]], at = at, at + r["s"]
    starts = rows.sparkSession.createDataFrame(list(begin.items()), "_part int, _begin long")
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(F.broadcast(starts), "_part").withColumn("before", F.col("_begin") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_part", "_begin")


def budgeted(candidates: DataFrame, repack_bytes: int, unused_after: int) -> DataFrame:
    """pack_id, used_bytes, waste of the candidates to repack, taken in their order.

    A candidate is passed over if its used and wasted bytes would bring the sum to the budget or above. Packs of data that
    are large enough (o1) are also passed over once the waste left in all candidates is below `unused_after`; packs with
    trees, small ones and those that must be compressed (`must_compress`, if there) are not.

    Taking goes on in rounds: in each the longest run that fits is found by prefix sums, and candidates too large for
    what is left then drop out. When FEW are left, the driver finishes them.
    """
    order = ["o0", "o1", "o2", "pack_id"]
    must = F.col("must_compress") if "must_compress" in candidates.columns else F.lit(False)
    tolerant = (F.col("type") == "data") & F.col("o1") & ~must
    rest = cut(candidates.select("pack_id", "used_bytes", "waste", *order[:3], (F.col("used_bytes") + F.col("waste")).alias("size"), tolerant.alias("tolerant")))
    room, left, taken = repack_bytes, rest.agg(F.coalesce(F.sum("waste"), F.lit(0))).first()[0], []
    schema = "pack_id string, used_bytes long, waste long"
    while True:
        rest = cut(rest.filter((F.col("size") < room) & (~F.col("tolerant") | (F.lit(left) >= unused_after))))
        if rest.count() <= FEW:
            break
        summed = cut(_prefix_sums(_prefix_sums(rest, order, "size").withColumnRenamed("before", "b_size"), order, "waste"))
        stop = (F.col("b_size") + F.col("size") >= room) | (F.col("tolerant") & (left - F.col("before") < unused_after))
        first = summed.filter(stop).orderBy(*order).limit(1).collect()
        if not first:
            taken.append(summed.select("pack_id", "used_bytes", "waste"))
            rest = rest.filter("false")
            break
        run = cut(summed.filter(F.col("b_size") < first[0]["b_size"]).select("pack_id", "used_bytes", "waste", "size"))
        taken.append(run.drop("size"))
        room, left = room - first[0]["b_size"], left - first[0]["before"]
        rest = summed.filter(F.col("b_size") >= first[0]["b_size"]).drop("b_size", "before")
    picked = []
    for r in sorted(rest.collect(), key=lambda r: tuple(r[c] for c in order)):  # FEW rows at most
        if r["size"] < room and not (r["tolerant"] and left < unused_after):
            room, left = room - r["size"], left - r["waste"]
            picked.append((r["pack_id"], r["used_bytes"], r["waste"]))
    out = rest.sparkSession.createDataFrame(picked, schema)
    for x in taken:
        out = out.unionByName(x)
    return out


def reference_counts(references: DataFrame) -> DataFrame:
    """References, distinct revisions and distinct inodes of each blob. references: blob_id, inode, revision."""
    return references.groupBy("blob_id").agg(
        F.count("*").cast("long").alias("references"), F.count_distinct("revision").cast("long").alias("revisions"), F.count_distinct("inode").cast("long").alias("inodes")
    )


def migration(placements: DataFrame, packs: DataFrame, requested: DataFrame, source: int, target: int) -> DataFrame:
    """Packs live on a source backend and not on the target, neither requested already nor going away."""
    live = placements.filter("state = 'live'")
    on = live.filter(F.col("backend") == source).select("pack_id").distinct()
    there = live.filter(F.col("backend") == target).select("pack_id")
    ok = packs.filter(~F.col("lifecycle").isin("deleted", "delete-pending")).select("pack_id", "physical_size")
    return ok.join(on, "pack_id", "left_semi").join(there, "pack_id", "left_anti").join(requested.select("pack_id"), "pack_id", "left_anti")


def next_placements(packs: DataFrame, placements: DataFrame, wanted: DataFrame) -> DataFrame:
    """Backends each pack still needs, and the first to act on. wanted: type, backend (a policy of few rows)."""
    need = packs.filter("lifecycle = 'published'").select("pack_id", "type").join(F.broadcast(wanted), "type").select("pack_id", "backend")
    missing = need.join(placements.filter("state = 'live'").select("pack_id", "backend"), ["pack_id", "backend"], "left_anti")
    return missing.groupBy("pack_id").agg(F.count("*").cast("long").alias("missing"), F.min("backend").alias("next_backend"))


def scheduler_summary(plan: DataFrame, packs: DataFrame, placements: DataFrame) -> DataFrame:
    n = F.count("*").cast("long")
    scanned = packs.filter("lifecycle = 'published'").agg(n.alias("scanned"))
    unsatisfied = plan.agg(n.alias("unsatisfied"), F.coalesce(F.sum("missing"), F.lit(0)).cast("long").alias("missing"))
    pending = placements.filter("state = 'pending'").agg(n.alias("pending"))
    return scanned.join(F.broadcast(unsatisfied)).join(F.broadcast(pending))  # one row each


def retained(edges: DataFrame, snapshots: DataFrame, ignored: DataFrame) -> DataFrame:
    """Every key reachable from the trees of snapshots that are not ignored. snapshots: id, tree; ignored: id."""
    kept = snapshots.join(ignored.select("id"), "id", "left_anti")
    return closure(edges, kept.select(F.col("tree").alias("key")))


def identities(edges: DataFrame, nodes: DataFrame, root: DataFrame, oldest: bool = False) -> DataFrame:
    """Distinct (fsid, inode, revision) of the nodes under a root; with `oldest`, of each inode the oldest revision known.
    nodes: key, fsid, inode, revision; root: key."""
    found = nodes.join(closure(edges, root).hint("merge"), "key", "left_semi").select("fsid", "inode", "revision").distinct()
    if not oldest:
        return found
    first = nodes.groupBy("fsid", "inode").agg(F.min("revision").alias("revision"))
    return found.select("fsid", "inode").distinct().join(first, ["fsid", "inode"])


def import_trees(edges: DataFrame, trees: DataFrame, roots: DataFrame, depth: int = 64) -> tuple[DataFrame, DataFrame]:
    """(root, path, key, level) of what can be read below the roots, and debts (root, path, key, reason) instead of
    failures: 'unreadable' trees that are not there, 'cycle' where a tree lies below itself, 'too deep' beyond `depth`.

    edges: parent, name, child; trees: key of each readable tree; roots: root. One join a level, written before the next;
    the edges are written once, with what is readable.
    """
    readable = trees.select("key", F.lit(True).alias("_r")).distinct()
    known = readable.select(F.col("key").alias("child"), "_r")
    edges = written(edges.select("parent", "name", "child").join(known, "child", "left"))
    level = roots.select("root", F.lit("").alias("path"), F.col("root").alias("key"), F.lit(0).alias("level"), F.array().cast(f"array<{roots.schema['root'].dataType.simpleString()}>").alias("above"))
    level = level.join(readable, "key", "left")
    good, bad, n = None, None, 0
    while True:
        reason = F.when(F.array_contains("above", F.col("key")), "cycle").when(F.col("_r").isNull(), "unreadable").when(F.lit(n > depth), "too deep")
        level = written(level.withColumn("reason", reason))
        fine = level.filter("reason IS NULL")
        a, b = fine.select("root", "path", "key", "level"), level.filter("reason IS NOT NULL").select("root", "path", "key", "reason")
        good, bad = (a, b) if good is None else (good.unionByName(a), bad.unionByName(b))
        rows = fine.count()
        if n > depth or not rows:
            return good, bad
        n += 1
        level = edges.join(sided(fine.drop("_r"), rows), F.col("key") == F.col("parent")).select(
            "root", F.concat("path", F.lit("/"), "name").alias("path"), F.col("child").alias("key"), F.lit(n).alias("level"), F.array_append("above", F.col("parent")).alias("above"), "_r"
        )
