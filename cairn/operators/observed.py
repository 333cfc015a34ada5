"""What was observed of a source: identities after a crawl, reusable subtrees, mappings, rejected nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.paths import clean, lineage

IDENTITY = ["fsid", "inode", "generation"]
#: What must be equal, besides being verified, for the stored revision of a file to be used again.
REUSED_BY = ("mtime", "ctime", "size", "mode", "uid", "gid", "parent", "path", "content")


def binding_residency(bindings: DataFrame, proofs: DataFrame, retained: DataFrame) -> DataFrame:
    """Residency of each bound identity.

    bindings: identity, source, state, commit. proofs: source, commit, complete, debt_free, completed_at. retained:
    identity, refs. A live file is live. A deleted one needs a complete proof without debts from the commit that saw
    it last, else the query fails; it is archive-only while references are retained, then expired. All else is
    unknown, with no references and no crawl.
    """
    joined = bindings.join(proofs, ["source", "commit"], "left").join(retained.groupBy(*IDENTITY).agg(F.sum("refs").alias("refs")), IDENTITY, "left")
    deleted = F.col("state") == "deleted"
    proven = F.coalesce(F.col("complete") & F.col("debt_free"), F.lit(False))
    refs = F.coalesce(F.col("refs"), F.lit(0)).cast("long")
    failed = F.raise_error(F.concat(F.lit("deleted file without a valid crawl proof: "), F.concat_ws(":", *IDENTITY))).cast("string")
    residency = F.when(deleted & ~proven, failed).when(deleted & (refs > 0), "archive-only").when(deleted, "expired").when(F.col("state") == "live", "live").otherwise("unknown")
    return joined.select(
        *IDENTITY,
        residency.alias("residency"),
        F.when(deleted, refs).otherwise(F.lit(0)).cast("long").alias("retained_refs"),
        F.when(deleted, F.col("completed_at")).alias("last_complete_crawl"),
    )


def missing_identities(bindings: DataFrame, seen: DataFrame, complete: bool, debt_free: bool, start_fence: int) -> DataFrame:
    """Bindings that a crawl did not see, with their new state and continuity; those deleted before stay as they are.

    A file is deleted only if the crawl was complete and free of debts and had last seen it no later than its start;
    its continuity is proven if it was live and no other generation of its inode is unknown. Else it is unknown, and
    so is its continuity.
    """
    unknown = bindings.filter(F.col("state") == "unknown").groupBy("fsid", "inode").agg(F.count("*").alias("n"))
    gone = bindings.filter(F.col("state") != "deleted").join(seen.select(*IDENTITY).distinct(), IDENTITY, "left_anti").join(unknown, ["fsid", "inode"], "left")
    others = F.coalesce(F.col("n"), F.lit(0))  # asked of live ones only
    deleted = F.lit(complete and debt_free) & (F.col("commit") <= start_fence)
    continuity = F.when(~deleted, "unknown").when((F.col("state") == "live") & (others == 0), "proven").otherwise(F.col("continuity"))
    return gone.select(*IDENTITY, F.when(deleted, "deleted").otherwise("unknown").alias("state"), continuity.alias("continuity"))


def reuse_decisions(listing: DataFrame, current: DataFrame, verified: Column) -> DataFrame:
    """Each listed or known path: 'reuse' if verified and all of REUSED_BY are equal, 'read', 'new', or 'gone'.

    Two nulls are equal. Both: path as the key, and the columns of REUSED_BY.
    """
    a = listing.select(F.col("path").alias("key"), F.struct(*REUSED_BY).alias("now"), verified.alias("verified"))
    b = current.select(F.col("path").alias("key"), F.struct(*REUSED_BY).alias("known"))
    same = F.col("verified") & F.col("now").eqNullSafe(F.col("known"))
    kind = F.when(F.col("known").isNull(), "new").when(F.col("now").isNull(), "gone").when(same, "reuse").otherwise("read")
    return a.join(b, "key", "full_outer").select(F.col("key").alias("path"), kind.alias("decision"))


#: What a stat holds of a path.
STAT = ("mtime", "ctime", "size", "mode", "uid", "gid")


def capture(nodes: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, errors): what a crawl saw of each node, to be replayed later.

    nodes: path, parent, content; stats: path and STAT, one row for a path. An observation holds the stats of the node
    and of its parent; a node without either of them is an error (path) instead.
    """
    of = lambda path, name: stats.select(F.col("path").alias(path), F.struct(*STAT).alias(name))
    seen = nodes.select("path", "parent", "content").join(of("path", "stat"), "path", "left").join(of("parent", "parent_stat"), "parent", "left")
    whole = F.col("stat").isNotNull() & F.col("parent_stat").isNotNull()
    return seen.filter(whole), seen.filter(~whole).select("path")


def replay(observations: DataFrame, root: str, current: DataFrame, verified: Column) -> DataFrame:
    """The reuse decisions that a crawl of the captured nodes would take: path, decision. Observations without the root,
    or with an empty path or parent, are an error."""
    named = (F.coalesce(F.col("path"), F.lit("")) != "") & (F.coalesce(F.col("parent"), F.lit("")) != "")
    found = observations.agg(F.count_if(~named).alias("unnamed"), F.count_if((F.col("path") == root) | (F.col("parent") == root)).alias("roots")).first()
    if found["unnamed"]:
        raise ValueError(f"{found['unnamed']} observations without a path or parent")
    if not found["roots"]:
        raise ValueError(f"nothing captured of {root!r}")
    return reuse_decisions(observations.select("path", "parent", "content", "stat.*"), current, verified)


def observed_generations(observed: DataFrame, bindings: DataFrame) -> DataFrame:
    """fsid, inode, generation, continuity, is_new of each observed inode (fsid, inode, revision).

    An inode whose last binding is live goes on in its generation. After a proven deletion a new generation begins at
    the observed revision, and its continuity is proven; after an unknown gap, or if the inode was never bound, one
    begins whose continuity is unknown.
    """
    prior = bindings.groupBy("fsid", "inode").agg(F.max(F.struct("generation", "state", "continuity")).alias("p"))
    joined = observed.join(prior, ["fsid", "inode"], "left")
    live = F.coalesce(F.col("p.state") == "live", F.lit(False))
    proven = F.coalesce(F.col("p.state") == "deleted", F.lit(False))
    return joined.select(
        "fsid", "inode",
        F.when(live, F.col("p.generation")).otherwise(F.col("revision")).alias("generation"),
        F.when(live, F.col("p.continuity")).when(proven, "proven").otherwise("unknown").alias("continuity"),
        (~live).alias("is_new"),
    )


def reusable_subtrees(subtrees: DataFrame, changed: DataFrame) -> DataFrame:
    """The subtrees (path, and more) with no change at, above or below them. changed: path. Paths are cleaned first.

    Two joins on equality: a subtree's own lineage against the changes, and the lineages of the changes against it.
    """
    own = subtrees.withColumn("cleaned", clean(F.col("path")))
    there = changed.select(clean(F.col("path")).alias("at")).distinct()
    at_or_above = own.select("cleaned", F.explode(lineage(F.col("cleaned"))).alias("at")).join(there, "at", "left_semi").select("cleaned")
    below = there.select(F.explode(lineage(F.col("at"))).alias("cleaned"))
    return own.join(at_or_above.union(below).distinct(), "cleaned", "left_anti").select(subtrees.columns)


def match_mappings(targets: DataFrame, mappings: DataFrame, required: list[str]) -> DataFrame:
    """Each target's one complete mapping; the query fails at a target with none or several.

    targets: target; mappings: target and the required columns, which must not be null or empty.
    """
    complete = F.lit(True)
    for c in required:
        complete &= F.coalesce(F.col(c) != "", F.lit(False))
    found = mappings.filter(complete).groupBy("target").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in required))
    one = F.assert_true(F.coalesce(F.col("n") == 1, F.lit(False)), F.concat(F.lit("not one complete mapping of "), F.col("target")))
    return targets.join(found, "target", "left").filter(one.isNull()).select("target", *required)


def reject_nodes(nodes: DataFrame, max_size: int | None = None, devices: list[int] | None = None, marker: str | None = None, owners: DataFrame | None = None) -> DataFrame:
    """Nodes (path, type, size, ...) that no rule rejects.

    Rules: files larger than max_size; nodes on other devices; nodes in or below a directory that holds a file
    named `marker`, the marker itself excepted; nodes whose uid is among `owners`.
    """
    kept = nodes
    if max_size is not None:
        kept = kept.filter(~F.coalesce((F.col("type") == "file") & (F.col("size") > max_size), F.lit(False)))
    if devices is not None:
        kept = kept.filter(F.col("device").isin(devices))
    if owners is not None:
        kept = kept.join(owners.select("uid").distinct(), "uid", "left_anti").select(nodes.columns)
    if marker is not None:
        parent = F.regexp_replace("path", "/[^/]*$", "")
        root = F.when(parent == "", "/").otherwise(parent)
        name = F.substring_index("path", "/", -1)
        marked = nodes.filter((F.col("type") == "file") & (name == marker)).select(root.alias("at")).distinct()
        above = F.filter(lineage(F.col("path")), lambda p: (p != F.col("path")) & ~((name == marker) & (p == root)))
        hit = kept.select("path", F.explode(above).alias("at"))
        kept = kept.join(hit.join(marked, "at", "left_semi").select("path").distinct(), "path", "left_anti").select(nodes.columns)
    return kept


def bound_revisions(bindings: DataFrame, revisions: DataFrame) -> DataFrame:
    """Each binding with the revision it names; a binding without its revision is an error. Both: fsid, inode, revision."""
    joined = bindings.join(revisions.withColumn("_there", F.lit(True)), ["fsid", "inode", "revision"], "left")
    sure = F.assert_true("_there", F.concat_ws(" ", F.lit("no revision of binding"), F.col("fsid"), F.col("inode"), F.col("revision")))
    return joined.filter(sure.isNull()).drop("_there")


def covered_windows(windows: DataFrame, coverage: DataFrame, retained_from) -> DataFrame:
    """The windows with `valid`: whether one unbroken stretch of observation spans them and none begins before what is
    retained. windows: source, start, end; coverage: source, start, end (half-open, in any order, overlapping or touching)."""
    before = Window.partitionBy("source").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    breaks = coverage.select("source", "start", "end").withColumn("_new", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int"))
    run = F.sum("_new").over(Window.partitionBy("source").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    whole = breaks.withColumn("_run", run).groupBy("source", "_run").agg(F.min("start").alias("_from"), F.max("end").alias("_to"))
    return windows.join(whole.withColumnRenamed("source", "_s"), (F.col("source") == F.col("_s")) & (F.col("_from") <= F.col("start")) & (F.col("end") <= F.col("_to")), "left").select(
        "source", "start", "end", (F.col("_s").isNotNull() & (F.col("start") >= F.lit(retained_from)) & (F.col("start") < F.col("end"))).alias("valid")
    )


def feed_gaps(feed: DataFrame) -> DataFrame:
    """first_missing and last_missing: commits that a change feed lacks between those it has."""
    following = feed.select("commit").distinct().withColumn("_part", F.floor(F.col("commit") / 65_536))
    ahead = F.lead("commit").over(Window.partitionBy("_part").orderBy("commit"))
    firsts = following.groupBy("_part").agg(F.min("commit").alias("_first"))  # a row for each 65,536 commits
    later = firsts.select(F.lag("_part").over(Window.orderBy("_part")).alias("_part"), F.col("_first").alias("_next"))
    rows = following.withColumn("_ahead", ahead).join(later, "_part", "left").withColumn("_ahead", F.coalesce("_ahead", "_next"))
    return rows.filter(F.col("_ahead") > F.col("commit") + 1).select((F.col("commit") + 1).alias("first_missing"), (F.col("_ahead") - 1).alias("last_missing"))
