"""The pack catalog: filters that know when they cannot decide, composition, placement facts, ordering."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.numbers import ratio

def unused_ratio() -> Column:
    """Unused share of accounted packs; null where usage is not accounted."""
    return F.when(F.col("used_bytes").isNotNull(), ratio(F.col("unused_bytes"), F.col("used_bytes")))


@dataclass(frozen=True)
class PackFilter:
    """Every predicate set must hold. One on a missing value is undecided: such packs are left out and counted."""

    types: tuple[str, ...] = ()
    tiers: tuple[str, ...] = ()
    states: tuple[str, ...] = ()
    backends: tuple[int, ...] = ()
    created_before: datetime | None = None
    created_after: datetime | None = None
    size_min: int | None = None
    size_max: int | None = None
    unused_above: float | None = None
    retention_expired_at: datetime | None = None
    retention_unknown: bool = False
    delete_pending: bool = False
    not_offsite: bool = False
    classes: tuple[str, ...] = ()
    promotion_due_at: int | None = None

    def tests(self) -> dict[str, Column]:
        c, out = F.col, {}
        if self.types:
            out["type"] = c("type").isin(*self.types)
        if self.tiers:
            out["tier"] = c("tier").isin(*self.tiers)
        if self.states:
            out["state"] = c("lifecycle").isin(*self.states)
        if self.created_before:
            out["created"] = c("created_at") < F.lit(self.created_before)
        if self.created_after:
            after = c("created_at") > F.lit(self.created_after)
            out["created"] = out["created"] & after if "created" in out else after
        if self.size_min is not None:
            out["size_min"] = c("physical_size") >= self.size_min
        if self.size_max is not None:
            out["size_max"] = c("physical_size") <= self.size_max
        if self.unused_above is not None:
            out["usage"] = unused_ratio() > self.unused_above
        if self.retention_expired_at:
            out["retention"] = c("min_retention_until") <= F.lit(self.retention_expired_at)
        if self.retention_unknown:
            out["retention_unknown"] = c("min_retention_until").isNull()
        if self.delete_pending:
            out["delete_pending"] = c("lifecycle") == "delete-pending"
        if self.promotion_due_at is not None:
            out["promotion_due"] = c("eligible") & (c("horizon") <= self.promotion_due_at)
        if self.classes:
            out["class"] = F.arrays_overlap(F.coalesce("live_classes", F.array().cast("array<string>")), F.array(*map(F.lit, self.classes)))
        if self.backends or self.not_offsite:
            live = F.coalesce(c("live_backends"), F.array().cast("array<bigint>"))
            if self.backends:
                out["backend"] = F.arrays_overlap(live, F.array(*(F.lit(b).cast("long") for b in self.backends)))
            if self.not_offsite:
                out["not_offsite"] = F.coalesce(c("offsite_copies"), F.lit(0)) == 0
        return out

    def apply(self, packs: DataFrame, placements: DataFrame | None = None, backends: DataFrame | None = None, promotion: DataFrame | None = None) -> DataFrame:
        """promotion: pack_id, eligible, horizon, as `promotion_horizons` gives them; packs without are not due."""
        if self.backends or self.not_offsite:
            packs = packs.join(placement_sets(placements, backends), "pack_id", "left")
        if self.classes:
            live = placements.filter("state = 'live'").groupBy("pack_id").agg(F.collect_set("storage_class").alias("live_classes"))
            packs = packs.join(live, "pack_id", "left")
        if self.promotion_due_at is not None:
            packs = packs.join(promotion, "pack_id", "left")
        for test in self.tests().values():
            packs = packs.filter(test)
        return packs

    def undecided(self, packs: DataFrame) -> DataFrame:
        """Of the packs that no known value rules out, how many each missing value leaves undecided."""
        tests = self.tests()
        possible = packs
        for t in tests.values():
            possible = possible.filter(t | t.isNull())
        return possible.agg(*(F.count_if(t.isNull()).cast("long").alias(f"undecided_{n}") for n, t in tests.items()))


def placement_sets(placements: DataFrame, backends: DataFrame) -> DataFrame:
    """The live placements of each pack: backends, copies off site, failure domains."""
    live = placements.filter("state = 'live'").join(backends, "backend")
    return live.groupBy("pack_id").agg(
        F.array_sort(F.collect_set("backend")).alias("live_backends"),
        F.count_if("offsite").cast("long").alias("offsite_copies"),
        F.count_distinct("failure_domain").cast("long").alias("domains"),
        F.count("*").cast("long").alias("copies"),
    )


SUMS = ["physical_size", "payload_size", "blob_count"]


def _sums() -> list[Column]:
    return [F.count("*").cast("long").alias("packs"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in SUMS)]


def composition(packs: DataFrame, placements: DataFrame, backends: DataFrame) -> DataFrame:
    """Packs and bytes by type, tier, state, backend and role; a pack counts once for each backend or role it is on."""
    on = placements.filter("state = 'live'").join(backends.select("backend", "role"), "backend")
    sets = on.groupBy("pack_id").agg(F.collect_set(F.col("backend").cast("string")).alias("b"), F.collect_set("role").alias("r"))
    one = lambda n, c: F.array(F.struct(F.lit(n).alias("dimension"), F.coalesce(c, F.lit("unknown")).alias("key")))
    many = lambda n, c: F.transform(F.coalesce(F.col(c), F.array(F.lit("none"))), lambda x: F.struct(F.lit(n).alias("dimension"), x.alias("key")))
    keys = F.concat(one("type", F.col("type")), one("tier", F.col("tier")), one("state", F.col("lifecycle")), many("backend", "b"), many("class", "r"))
    rows = packs.join(sets, "pack_id", "left").select(*SUMS, F.explode(keys).alias("k"))
    return rows.groupBy("k.dimension", "k.key").agg(*_sums())


def gaps(packs: DataFrame) -> DataFrame:
    """Totals beside counts of missing evidence."""
    missing = {"tier": "tier", "retention": "min_retention_until", "usage": "used_bytes", "creation": "created_at"}
    return packs.agg(
        *_sums(),
        *(F.count_if(F.col(c).isNull()).cast("long").alias(f"unknown_{n}") for n, c in missing.items()),
        F.count_if(F.col("type") == "unknown").cast("long").alias("unknown_type"),
        F.sum("unused_bytes").cast("long").alias("unused_bytes"),
        F.round(ratio(F.sum("unused_bytes"), F.sum("used_bytes")), 9).alias("unused_ratio"),
    )


def aggregates(packs: DataFrame) -> DataFrame:
    """Stored summaries: by type, by tier and in total. Deleted packs take no part."""
    sets = packs.filter("lifecycle <> 'deleted'").groupingSets([["type"], ["tier"], []], "type", "tier")
    out = sets.agg(*_sums(), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 1, "type").when(F.col("g") == 2, "tier").otherwise("all")
    key = F.when(F.col("g") == 1, F.col("type")).when(F.col("g") == 2, F.coalesce("tier", F.lit("unknown"))).otherwise("")
    return out.select(kind.alias("kind"), key.alias("key"), "packs", *SUMS)


def drift(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows where stored summaries differ from recomputed ones; missing ones count as 0."""
    a = stored.select("kind", "key", *(F.col(c).alias(f"old_{c}") for c in ("packs", *SUMS)))
    b = fresh.select("kind", "key", *(F.col(c).alias(f"new_{c}") for c in ("packs", *SUMS)))
    joined = a.join(b, ["kind", "key"], "full_outer").na.fill(0)
    differ = F.lit(False)
    for c in ("packs", *SUMS):
        differ = differ | (F.col(f"old_{c}") != F.col(f"new_{c}"))
    return joined.filter(differ)


def apply_changes(stored: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Summaries after changed packs: old rows are taken off, new ones added; rows left with no packs go. A negative
    sum is an error, raised when the rows are computed."""
    signed = aggregates(new).unionByName(
        aggregates(old).select("kind", "key", *((-F.col(c)).alias(c) for c in ("packs", *SUMS)))
    ).unionByName(stored.select("kind", "key", "packs", *SUMS))
    sums = signed.groupBy("kind", "key").agg(*(F.sum(c).cast("long").alias(c) for c in ("packs", *SUMS)))
    safe = [F.when(F.col(c) < 0, F.raise_error(F.lit(f"{c} below zero")).cast("long")).otherwise(F.col(c)).alias(c) for c in ("packs", *SUMS)]
    return sums.select("kind", "key", *safe).filter("packs <> 0")


# Orders of a pack listing; all but deadlines and ids go down.
ORDERS = {"size": "physical_size", "created": "created_at", "unused": "unused_bytes", "ratio": "unused_ratio", "payload": "payload_size", "retention": "min_retention_until", "id": "pack_id"}


def listing(packs: DataFrame, order: str, limit: int) -> DataFrame:
    """The first packs in an order, ties by id. Counts of a filter are taken before the limit, not here."""
    up = order in ("retention", "id")
    key = F.asc_nulls_last(ORDERS[order]) if up else F.desc_nulls_last(ORDERS[order])
    return packs.withColumn("unused_ratio", unused_ratio()).orderBy(key, "pack_id").limit(limit)


def matched_and_returned(packs: DataFrame, limit: int) -> DataFrame:
    n = F.count("*").cast("long")
    return packs.agg(n.alias("matched"), F.least(n, F.lit(limit).cast("long")).alias("returned"), F.coalesce(F.sum("physical_size"), F.lit(0)).cast("long").alias("matched_bytes"))


def type_of_members(blobs: DataFrame) -> DataFrame:
    """data, tree or both (mixed), from the blobs in a pack."""
    g = blobs.groupBy("pack_id").agg(F.max((F.col("type") == "data").cast("int")).alias("d"), F.max((F.col("type") == "tree").cast("int")).alias("t"))
    return g.select("pack_id", F.when((F.col("d") == 1) & (F.col("t") == 1), "mixed").when(F.col("d") == 1, "data").when(F.col("t") == 1, "tree").otherwise("unknown").alias("type"))


def sizes_from_index(blobs: DataFrame, header: int = 37, trailer: int = 36) -> DataFrame:
    return blobs.groupBy("pack_id").agg((F.sum("length") + header * F.count("*") + trailer).cast("long").alias("size"), F.count("*").cast("long").alias("blobs"))


def inventory(packs: DataFrame) -> DataFrame:
    """Bytes by type of packs in use, and whether every record was plausible: else the total is not to be trusted."""
    used = packs.filter(F.col("lifecycle").isin("published", "export-pending", "imported"))
    ok = (F.col("physical_size") > 0) & (F.col("type") != "unknown") & (F.col("physical_size") >= F.col("payload_size"))
    return used.groupBy("type").agg(F.sum("physical_size").cast("long").alias("bytes"), F.bool_and(ok).alias("available"))


def backend_counts(placements: DataFrame) -> DataFrame:
    return placements.filter("state = 'live'").groupBy("backend").agg(F.count("*").cast("long").alias("objects"), F.sum("bytes").cast("long").alias("bytes"))


def durability(packs: DataFrame, placements: DataFrame, backends: DataFrame, copies: int = 1, domains: int = 0, offsite: int = 0) -> DataFrame:
    """Whether each pack has enough copies, distinct failure domains and copies off site. Read caches count for none; 0
    copies means 1, and 0 domains as many as copies."""
    copies = copies or 1
    domains = domains or copies
    lasting = placement_sets(placements, backends.filter("role <> 'read-cache'"))
    sets = packs.select("pack_id").join(lasting.drop("live_backends"), "pack_id", "left").na.fill(0)
    ok = (F.col("copies") >= copies) & (F.col("domains") >= domains) & (F.col("offsite_copies") >= offsite)
    return sets.withColumn("durable", ok)


def derived_tier(packs: DataFrame, placements: DataFrame, backends: DataFrame) -> DataFrame:
    """From live placements outside read caches: none unknown, several mirrored, archive cold, primary hot, else single."""
    live = placements.filter("state = 'live'").join(backends.filter("role <> 'read-cache'"), "backend")
    g = live.groupBy("pack_id").agg(F.count("*").alias("n"), F.max("role").alias("role"))
    tier = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "unknown").when(F.col("n") > 1, "mirrored").when(F.col("role") == "archive", "cold")
        .when(F.col("role") == "primary", "hot").otherwise("single")
    )
    return packs.select("pack_id").join(g, "pack_id", "left").select("pack_id", tier.alias("tier"))


def delete_after(now: datetime, keep_days: int) -> Column:
    """The later of now plus the grace time and the known end of retention."""
    return F.greatest(F.lit(now) + F.expr(f"INTERVAL {keep_days} DAYS"), F.col("min_retention_until"))


#: Hours of a month, as prices count them.
MONTH = 24 * 30


def repack_pays(now: datetime, price: float, horizon_hours: float, egress: float = 0.0, per_1k_requests: float = 0.0, requests: int = 0, overhead: int = 0) -> Column:
    """Whether the storage saved on unused bytes over the horizon exceeds what it costs to read the pack, to ask for
    it, and to go on paying for it until its retention ends. The whole object is billed, with its overhead. Never
    without a price or a horizon, nor where the retention or the usage is unknown."""
    if price <= 0 or horizon_hours <= 0:
        return F.lit(False)
    gib = float(1 << 30)
    billed = (F.col("physical_size") + overhead) / gib
    left = F.greatest(F.lit(0.0), (F.unix_micros("min_retention_until") - F.unix_micros(F.lit(now).cast("timestamp"))) / 3_600_000_000.0) / MONTH
    saved = F.col("unused_bytes") / gib * price * (horizon_hours / MONTH)
    cost = billed * egress + requests / 1000 * per_1k_requests + billed * price * left
    return F.coalesce((saved > cost) & F.col("min_retention_until").isNotNull(), F.lit(False))


def promotion_horizons(reach: DataFrame, members: DataFrame) -> DataFrame:
    """Horizon of a pack: the least over its blobs of the greatest over snapshots that reach the blob; none if a blob
    has none. reach: blob_id, horizon. members: pack_id, blob_id."""
    of_blob = reach.groupBy("blob_id").agg(F.max("horizon").alias("horizon"))
    joined = members.join(of_blob, "blob_id", "left").groupBy("pack_id").agg(F.min("horizon").alias("horizon"), F.bool_and(F.col("horizon").isNotNull()).alias("eligible"))
    return joined.select("pack_id", "eligible", F.when(F.col("eligible"), F.col("horizon")).alias("horizon"))
