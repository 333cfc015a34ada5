"""Work queues and plans over placements: deadlines, limits by target, views for watching."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from cairn.plans.cuts import cut


def due(requests: DataFrame, limits: DataFrame, now: datetime) -> DataFrame:
    """The requests with `decision`: 'attempt', 'deferred' (before its time), or 'limited'.

    requests: pack_id, backend, deadline, not_before, bytes; taken by deadline, then pack. limits: backend,
    max_requests, max_bytes in the window (null: none). A request that would exceed its target's bytes is passed over,
    unless it is the target's first; later smaller ones may still go. A request to an unknown target is an error.

    Targets are dealt to tasks and their requests sorted; a task reads them one after another and holds a count and a
    sum, so a long queue needs no memory.
    """
    known = limits.select("backend", "max_requests", "max_bytes", F.lit(True).alias("_known"))
    rows = requests.join(F.broadcast(known), "backend", "left") if limits.count() < 100_000 else requests.join(known, "backend", "left")
    sure = F.assert_true("_known", F.concat(F.lit("request to unknown target "), F.col("backend").cast("string")))
    rows = rows.filter(sure.isNull()).withColumn("_wait", F.coalesce(F.col("not_before") > F.lit(now), F.lit(False)))
    rows = rows.select(*requests.columns, "_wait", F.coalesce("max_requests", F.lit(-1)).cast("long").alias("_n"), F.coalesce("max_bytes", F.lit(-1)).cast("long").alias("_b"))
    ordered = rows.repartition("backend").sortWithinPartitions("backend", "deadline", "pack_id")

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, count, used = None, 0, 0
        for pdf in batches:
            out = []
            for backend, size, wait, most, room in zip(pdf["backend"], pdf["bytes"], pdf["_wait"], pdf["_n"], pdf["_b"], strict=True):
                if backend != target:
                    target, count, used = backend, 0, 0
                if wait:
                    out.append("deferred")
                elif (most >= 0 and count >= most) or (room >= 0 and used and used + size > room):
                    out.append("limited")
                else:
                    count, used = count + 1, used + size
                    out.append("attempt")
            yield pdf.assign(decision=out)

    return ordered.mapInPandas(decide, StructType([*ordered.schema, StructField("decision", StringType())])).select(*requests.columns, "decision")


def placement_plan(packs: DataFrame, placements: DataFrame, backends: DataFrame, copies: int, domains: int = 0, offsite: int = 0, grace_hours: int = 24) -> DataFrame:
    """pack_id, missing_copies, missing_domains, missing_offsite, excess, next_backend, deadline of unsatisfied packs.

    Read caches count for nothing. The next backend is the smallest that adds what is missing first: an off-site copy,
    then a new failure domain, then any copy; a pack looks at as many candidates as it has copies, and one. `excess` counts live copies beyond the wanted ones where nothing is
    missing. The deadline is the pack's creation plus the grace time. packs: pack_id, created_at; backends (few rows):
    backend, role, offsite, failure_domain.
    """
    domains = domains or copies
    lasting = backends.filter("role <> 'read-cache'").select("backend", "offsite", "failure_domain")
    live = placements.filter("state = 'live'").select("pack_id", "backend").distinct().join(F.broadcast(lasting), "backend")
    have = live.groupBy("pack_id").agg(
        F.count("*").alias("c"), F.count_if("offsite").alias("o"), F.collect_set("failure_domain").alias("d"), F.collect_set("backend").alias("b")
    )  # sets no larger than the list of backends
    have = cut(have)  # read twice
    at = packs.select("pack_id", "created_at").join(have, "pack_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    short = lambda want, c: F.greatest(F.lit(0).cast("long"), F.lit(want).cast("long") - n(c))
    at = at.select(
        "pack_id", "created_at", F.coalesce("b", F.array().cast("array<long>")).alias("b"), F.coalesce("d", F.array().cast("array<long>")).alias("d"), n(F.col("c")).alias("c"),
        short(copies, F.col("c")).alias("missing_copies"), short(domains, F.size("d")).alias("missing_domains"), short(offsite, F.col("o")).alias("missing_offsite"),
    )
    # of k sorted backends (or domains) a pack that has fewer lacks one: no pack has to look at more
    most = (have.agg(F.max(F.greatest(F.size("b"), F.size("d")))).first()[0] or 0) + 1
    known = lasting.filter("backend IS NOT NULL")
    by_domain = known.filter("failure_domain IS NOT NULL").groupBy("failure_domain")
    firsts = [
        ("any", known.select("backend").distinct(), "backend"),
        ("off", known.filter("offsite").select("backend").distinct(), "backend"),
        ("new", by_domain.agg(F.min("backend").alias("backend")), "failure_domain"),
        ("both", by_domain.agg(F.min(F.when(F.col("offsite"), F.col("backend"))).alias("backend")).filter("backend IS NOT NULL"), "failure_domain"),
    ]
    for name, rows, by in firsts:
        listed = rows.select("backend", F.col(by).cast("long").alias("is")).orderBy("backend", "is").limit(most)
        at = at.join(F.broadcast(listed.agg(F.array_sort(F.collect_list(F.struct("backend", "is"))).alias(name))))  # one row
    free = lambda name, taken: F.get(F.filter(F.slice(name, 1, F.size(taken) + 1), lambda x: ~F.array_contains(taken, x["is"])), 0)["backend"]
    wanting = F.col("missing_copies") + F.col("missing_domains") + F.col("missing_offsite")
    pick = F.when(F.col("missing_offsite") > 0, F.coalesce(free("both", "d"), free("off", "b")))
    pick = F.coalesce(pick, F.when(F.col("missing_domains") > 0, free("new", "d")), F.when(wanting > 0, free("any", "b")))
    excess = F.when(wanting == 0, F.greatest(F.lit(0).cast("long"), F.col("c") - F.greatest(F.lit(copies), F.lit(domains)))).otherwise(0).cast("long")
    out = at.select("pack_id", "missing_copies", "missing_domains", "missing_offsite", excess.alias("excess"), pick.alias("next_backend"), (F.col("created_at") + F.expr(f"INTERVAL {grace_hours} HOURS")).alias("deadline"))
    return out.filter("missing_copies + missing_domains + missing_offsite + excess > 0")


def view_order(rows: DataFrame, key: str, ties: list[str], descending: bool = False) -> DataFrame:
    """The rows of a view (a bounded report) with their place in it: what is available first, then what is stale, then
    what is not there; within these by a key, missing ones last, ties by name. `availability` holds one of the three."""
    rank = F.when(F.col("availability") == "available", 0).when(F.col("availability") == "stale", 1).otherwise(2)
    by = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last()
    return rows.withColumn("place", F.row_number().over(Window.orderBy(rank, by, *ties)))
