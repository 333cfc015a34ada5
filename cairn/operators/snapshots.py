"""Snapshots: filters, newest ones, retention."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions import dates


def same_set(a: Column, b: Column) -> Column:
    """Equal as sets: order and repeats do not matter."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def has_all(have: Column, want: Column) -> Column:
    return F.size(F.array_except(want, F.coalesce(have, F.array().cast("array<string>")))) == 0


@dataclass(frozen=True)
class SnapshotFilter:
    """tags is a list of lists: any whose tags are all there; an empty list or tag fits untagged snapshots. Times are
    strict, sizes inclusive. where is a Spark SQL predicate over the snapshot's columns and `doc`, the snapshot's JSON as
    a VARIANT (for try_variant_get); a snapshot for which it gives null does not fit."""

    hosts: tuple[str, ...] = ()
    tags: tuple[tuple[str, ...], ...] = ()
    paths: tuple[str, ...] = ()
    exact_paths: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    after: datetime | None = None
    before: datetime | None = None
    size_min: int | None = None
    size_max: int | None = None
    added_min: int | None = None
    added_max: int | None = None
    where: str | None = None

    def condition(self) -> Column:
        c, out = F.col, [F.lit(True)]
        listed = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
        if self.hosts:
            out.append(c("hostname").isin(*self.hosts))
        if self.tags:
            tags = F.coalesce("tags", F.array().cast("array<string>"))
            any_of = [F.size(tags) == 0 if not [t for t in want if t] else has_all(tags, listed(want)) for want in self.tags]
            out.append(reduce(lambda a, b: a | b, any_of))
        if self.paths:
            out.append(has_all(c("paths"), listed(self.paths)))
        if self.exact_paths:
            out.append(F.coalesce(same_set(c("paths"), listed(self.exact_paths)), F.lit(False)))
        if self.labels:
            out.append(c("label").isin(*self.labels))
        if self.after:
            out.append(c("time") > F.lit(self.after))
        if self.before:
            out.append(c("time") < F.lit(self.before))
        if self.size_min is not None:
            out.append(c("size") >= self.size_min)
        if self.size_max is not None:
            out.append(c("size") <= self.size_max)
        if self.added_min is not None:
            out.append(c("size_added") >= self.added_min)
        if self.added_max is not None:
            out.append(c("size_added") <= self.added_max)
        if self.where:
            out.append(F.coalesce(F.expr(self.where).cast("boolean"), F.lit(False)))
        return reduce(lambda a, b: a & b, out)

    def apply(self, snapshots: DataFrame) -> DataFrame:
        if not self.where:
            return snapshots.filter(self.condition())
        seen = snapshots.withColumn("doc", F.parse_json(F.to_json(F.struct(*snapshots.columns))))
        return seen.filter(self.condition()).drop("doc")


def latest(snapshots: DataFrame, n: int, group: list[str] | None = None) -> DataFrame:
    """The newest n of each group; by default of each host and set of paths."""
    by = [F.col(g) for g in group] if group else [F.col("hostname"), F.array_join(F.array_sort(F.coalesce("paths", F.array().cast("array<string>"))), "\0")]
    order = Window.partitionBy(*by).orderBy(F.desc("time"), F.desc("id"))
    return snapshots.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")


def nth_latest(snapshots: DataFrame, n: int) -> DataFrame:
    """The n-th before the newest. It is an error if there are not so many."""
    newest = snapshots.orderBy(F.desc("time"), F.desc("id")).limit(n + 1)
    found = newest.count()
    if found <= n:
        raise ValueError(f"latest~{n} asks for {n + 1} snapshots, there are {found}")
    return newest.orderBy("time", "id").limit(1)


def newest(snapshots: DataFrame, n: int) -> DataFrame:
    return snapshots.orderBy(F.desc("time"), F.desc("id")).limit(n)


def protection(now: datetime) -> Column:
    """keep: never to be deleted, or not before a later time; delete: that time is past; else free."""
    past = F.col("delete_after") < F.lit(now)
    return F.when(F.col("delete_mode") == "never", "keep").when((F.col("delete_mode") == "after") & ~past, "keep").when(F.col("delete_mode") == "after", "delete").otherwise("free")


RULES = ["last", "minute", "hour", "day", "week", "month", "quarter", "half", "year"]


@dataclass(frozen=True)
class Policy:
    """How many to keep by rule (-1: all), for how long by rule, and which tags to keep."""

    keep: dict[str, int] = field(default_factory=dict)
    within: dict[str, dates.Span] = field(default_factory=dict)
    tags: tuple[tuple[str, ...], ...] = ()


def retention(snapshots: DataFrame, policy: Policy, now: datetime, group: list[str] | None = None) -> DataFrame:
    """id, keep and reasons of every snapshot.

    Newest first within a group, a rule keeps a snapshot when its calendar bucket, in the snapshot's own offset, differs
    from that of the one before and fewer than n were kept; the oldest is kept too if the rule has some left. A
    within rule does the same for snapshots strictly later than a time before the newest one not in the future.
    """
    by = group or ["hostname"]
    order = Window.partitionBy(*by).orderBy(F.desc("time"), F.desc("id"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    df = snapshots.withColumn("_n", F.row_number().over(order)).withColumn("_all", F.count("*").over(whole))
    df = df.withColumn("_top", F.coalesce(F.max(F.when(F.col("time") < F.lit(now), F.col("time"))).over(whole), F.max("time").over(whole)))
    reasons = []
    for kind, rules in (("", policy.keep), ("within ", policy.within)):
        for rule, amount in rules.items():
            name = f"_{kind}{rule}".replace(" ", "_")
            value = F.col("_n").cast("long") if rule == "last" else dates.bucket(F.col("time"), rule, F.col("tz_offset_min"))
            df = df.withColumn(name, value).withColumn(name, F.coalesce(F.col(name) != F.lag(name).over(order), F.lit(True)))
            if kind:
                reasons.append(F.when(F.col(name) & (F.col("time") > dates.minus(F.col("_top"), amount)), f"{kind}{rule}"))
            elif amount:
                df = df.withColumn(f"{name}_c", F.sum(F.col(name).cast("int")).over(so_far))
                room = F.lit(True) if amount < 0 else F.col(f"{name}_c") <= amount
                spare = F.lit(True) if amount < 0 else F.col(f"{name}_c") < amount
                oldest = (F.col("_n") == F.col("_all")) & ~F.col(name) & spare
                reasons.append(F.when(F.col(name) & room, rule).when(oldest, f"oldest {rule}"))
    for want in policy.tags:
        listed = F.array(*map(F.lit, want)).cast("array<string>")
        reasons.append(F.when(has_all(F.col("tags"), listed), f"tags {','.join(want)}"))
    found = F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")
    df = df.withColumn("_r", found)
    keep = F.lit(True) if not reasons else F.size("_r") > 0
    return df.select("id", *by, keep.alias("keep"), F.array_join("_r", "; ").alias("reasons"))


def horizons(snapshots: DataFrame, policy: Policy) -> DataFrame:
    """How long kept snapshots are sure to stay by the within rules: the latest end over rules; null is for ever."""
    ends = [F.timestamp_micros(2 * F.unix_micros("time") - F.unix_micros(dates.minus(F.col("time"), s))) for s in policy.within.values()]
    forever = F.lit(any(n < 0 for n in policy.keep.values())) if not policy.tags else reduce(
        lambda a, b: a | b, (has_all(F.col("tags"), F.array(*map(F.lit, t)).cast("array<string>")) for t in policy.tags)
    )
    latest_end = F.greatest(*ends) if len(ends) > 1 else ends[0]
    return snapshots.select("id", F.when(~forever, latest_end).alias("keep_until"), forever.alias("for_ever"))


def add_tags(tags: Column, new: list[str]) -> Column:
    return F.array_union(F.coalesce(tags, F.array().cast("array<string>")), F.array(*map(F.lit, new)))


def remove_tags(tags: Column, old: list[str]) -> Column:
    return F.array_except(tags, F.array(*map(F.lit, old)))


def not_yet_copied(source: DataFrame, copies: DataFrame, attributes: list[str]) -> DataFrame:
    """Snapshots without a copy of the same original id and attributes."""
    c = copies.select("original", *attributes).distinct()
    on = source["id"] == c["original"]
    for a in attributes:
        on = on & source[a].eqNullSafe(c[a])
    return source.join(c, on, "left_anti")


def by_id_prefix(snapshots: DataFrame, prefixes: list[str]) -> DataFrame:
    """Each prefix with the number of ids it fits and the id where that is one."""
    p = snapshots.sparkSession.createDataFrame([(x,) for x in prefixes], "prefix string")
    ids = snapshots.select(F.col("id").cast("string").alias("sid"))
    hits = F.broadcast(p).join(ids, F.col("sid").startswith(F.col("prefix")), "left")  # prefixes that the user typed
    return hits.groupBy("prefix").agg(F.count("sid").cast("long").alias("fits"), F.min("sid").alias("first")).select(
        "prefix", "fits", F.when(F.col("fits") == 1, F.col("first")).alias("id")
    )
