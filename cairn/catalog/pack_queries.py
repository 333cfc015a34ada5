"""Pack catalog, placement and history queries over line items and events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from cairn import adapters as A
from cairn.operators import packs as ops
from cairn.operators import reach, series
from cairn.registry import query

P = A.with_sql(A.PACKS)
PP = A.with_sql(A.PACKS, A.PLACEMENTS)
SUMS = "count(*)::BIGINT AS packs, coalesce(sum(physical_size), 0)::BIGINT AS physical_size, coalesce(sum(payload_size), 0)::BIGINT AS payload_size, coalesce(sum(blob_count), 0)::BIGINT AS blob_count"
RATIO = "CASE WHEN used_bytes IS NOT NULL THEN CASE WHEN used_bytes + unused_bytes = 0 THEN 0.0 ELSE unused_bytes::DOUBLE / (used_bytes + unused_bytes) END END"
LIVE = """
sets AS (SELECT pack_id, count(*) FILTER (WHERE offsite)::BIGINT AS offsite_copies, count(DISTINCT failure_domain)::BIGINT AS domains, count(*)::BIGINT AS copies, bool_or(backend IN (3, 5, 8, 13)) AS wanted
         FROM placements JOIN backends USING (backend) WHERE state = 'live' GROUP BY pack_id)"""

FILTER = ops.PackFilter(
    types=("data", "mixed"), tiers=("hot", "cold"), states=("published", "export-pending"), created_after=datetime(1995, 6, 1), created_before=datetime(2001, 1, 1),
    size_min=50_000, size_max=400_000, unused_above=0.2, retention_expired_at=datetime(2000, 6, 1),
)
CONDITION = {
    "type": "type IN ('data', 'mixed')", "tier": "tier IN ('hot', 'cold')", "state": "lifecycle IN ('published', 'export-pending')",
    "created": "created_at < TIMESTAMP '2001-01-01' AND created_at > TIMESTAMP '1995-06-01'", "size_min": "physical_size >= 50000", "size_max": "physical_size <= 400000",
    "usage": f"({RATIO}) > 0.2", "retention": "min_retention_until <= TIMESTAMP '2000-06-01'",
}
ALL = " AND ".join(f"({c})" for c in CONDITION.values())


@query(P + f"SELECT pack_id, type, tier, lifecycle, physical_size FROM packs WHERE {ALL}")
def pack_filter(spark, d):
    return FILTER.apply(A.packs(spark, d)).select("pack_id", "type", "tier", "lifecycle", "physical_size")


@query(
    P + "SELECT " + ", ".join(f"count(*) FILTER (WHERE ({c}) IS NULL)::BIGINT AS undecided_{n}" for n, c in CONDITION.items()) + " FROM packs WHERE " + " AND ".join(f"coalesce({c}, true)" for c in CONDITION.values())
)
def pack_filter_undecided(spark, d):
    return FILTER.undecided(A.packs(spark, d))


@query(A.with_sql(A.PACKS, A.PLACEMENTS, LIVE) + "SELECT pack_id, physical_size FROM packs LEFT JOIN sets USING (pack_id) WHERE wanted AND coalesce(offsite_copies, 0) = 0 AND min_retention_until IS NULL")
def pack_filter_by_placement(spark, d):
    f = ops.PackFilter(backends=(3, 5, 8, 13), not_offsite=True, retention_unknown=True)
    return f.apply(A.packs(spark, d), A.placements(spark, d), A.backends(spark, d)).select("pack_id", "physical_size")


@query(P + f"SELECT count(*)::BIGINT AS matched, least(count(*), 20)::BIGINT AS returned, coalesce(sum(physical_size), 0)::BIGINT AS matched_bytes FROM packs WHERE {ALL}")
def pack_filter_counts_before_limit(spark, d):
    return ops.matched_and_returned(FILTER.apply(A.packs(spark, d)), 20)


@query(
    A.with_sql(A.PACKS, A.PLACEMENTS) + f""", live AS (SELECT pack_id, backend, role FROM placements JOIN backends USING (backend) WHERE state = 'live'),
k AS (SELECT pack_id, 'type' AS dimension, type AS key FROM packs UNION ALL SELECT pack_id, 'tier', coalesce(tier, 'unknown') FROM packs UNION ALL SELECT pack_id, 'state', lifecycle FROM packs
      UNION ALL SELECT pack_id, 'backend', coalesce(backend::VARCHAR, 'none') FROM packs LEFT JOIN (SELECT DISTINCT pack_id, backend FROM live) USING (pack_id)
      UNION ALL SELECT pack_id, 'class', coalesce(role, 'none') FROM packs LEFT JOIN (SELECT DISTINCT pack_id, role FROM live) USING (pack_id))
SELECT dimension, key, {SUMS} FROM k JOIN packs USING (pack_id) GROUP BY ALL"""
)
def pack_composition(spark, d):
    return ops.composition(A.packs(spark, d), A.placements(spark, d), A.backends(spark, d))


@query(
    P + f"""SELECT {SUMS}, count(*) FILTER (WHERE tier IS NULL)::BIGINT AS unknown_tier, count(*) FILTER (WHERE min_retention_until IS NULL)::BIGINT AS unknown_retention,
count(*) FILTER (WHERE used_bytes IS NULL)::BIGINT AS unknown_usage, count(*) FILTER (WHERE created_at IS NULL)::BIGINT AS unknown_creation, count(*) FILTER (WHERE type = 'unknown')::BIGINT AS unknown_type,
sum(unused_bytes)::BIGINT AS unused_bytes, round(sum(unused_bytes)::DOUBLE / (sum(unused_bytes) + sum(used_bytes)), 9) AS unused_ratio FROM packs"""
)
def pack_evidence_gaps(spark, d):
    return ops.gaps(A.packs(spark, d))


AGG = f"""aggs AS (SELECT CASE WHEN grouping(type) = 0 THEN 'type' WHEN grouping(tier) = 0 THEN 'tier' ELSE 'all' END AS kind,
  CASE WHEN grouping(type) = 0 THEN type WHEN grouping(tier) = 0 THEN coalesce(tier, 'unknown') ELSE '' END AS key, {SUMS}
  FROM packs WHERE lifecycle <> 'deleted' GROUP BY GROUPING SETS ((type), (tier), ()))"""


@query(A.with_sql(A.PACKS, AGG) + "SELECT * FROM aggs")
def pack_aggregates(spark, d):
    return ops.aggregates(A.packs(spark, d))


@query(
    A.with_sql(A.PACKS, AGG) + """SELECT kind, key, packs - 1 AS old_packs, physical_size AS old_physical_size, payload_size AS old_payload_size, blob_count AS old_blob_count,
packs AS new_packs, physical_size AS new_physical_size, payload_size AS new_payload_size, blob_count AS new_blob_count FROM aggs WHERE kind = 'type'"""
)
def pack_aggregate_drift(spark, d):
    fresh = ops.aggregates(A.packs(spark, d))
    stored = fresh.withColumn("packs", F.when(F.col("kind") == "type", F.col("packs") - 1).otherwise(F.col("packs")))
    return ops.drift(stored, fresh)


@query(A.with_sql(A.PACKS, AGG) + "SELECT * FROM aggs")
def pack_aggregates_maintained(spark, d):
    """Summaries of packs before a change, brought up to date by the change, are those of the packs after it."""
    after = A.packs(spark, d)
    hit = F.pmod(F.xxhash64("pack_id"), F.lit(10)) == 0
    before = after.withColumn("tier", F.when(hit, "retired").otherwise(F.col("tier"))).withColumn("physical_size", F.col("physical_size") + F.when(hit, 7).otherwise(0))
    return ops.apply_changes(ops.aggregates(before), before.filter(hit), after.filter(hit))


@query(P + f"SELECT pack_id, unused_bytes, round({RATIO}, 9) AS unused_ratio FROM packs ORDER BY unused_bytes DESC NULLS LAST, pack_id LIMIT 50")
def packs_by_unused_bytes(spark, d):
    return ops.listing(A.packs(spark, d), "unused", 50).select("pack_id", "unused_bytes", F.round("unused_ratio", 9).alias("unused_ratio"))


@query(P + "SELECT pack_id, epoch_us(min_retention_until)::BIGINT AS retention_us FROM packs ORDER BY min_retention_until ASC NULLS LAST, pack_id LIMIT 50")
def packs_by_retention_deadline(spark, d):
    return ops.listing(A.packs(spark, d), "retention", 50).select("pack_id", F.unix_micros("min_retention_until").alias("retention_us"))


@query(P + "SELECT type, sum(physical_size)::BIGINT AS bytes, bool_and(physical_size > 0 AND type <> 'unknown' AND physical_size >= payload_size) AS available FROM packs WHERE lifecycle IN ('published', 'export-pending', 'imported') GROUP BY type")
def pack_inventory(spark, d):
    return ops.inventory(A.packs(spark, d))


@query(A.with_sql(A.BLOBS) + "SELECT pack_id, CASE WHEN bool_or(type = 'data') AND bool_or(type = 'tree') THEN 'mixed' WHEN bool_or(type = 'data') THEN 'data' ELSE 'tree' END AS type FROM blob_locations GROUP BY pack_id")
def pack_type_from_blobs(spark, d):
    return ops.type_of_members(A.blob_locations(spark, d))


@query(A.with_sql(A.BLOBS) + "SELECT pack_id, (sum(length) + 37 * count(*) + 36)::BIGINT AS size, count(*)::BIGINT AS blobs FROM blob_locations GROUP BY pack_id")
def pack_size_from_index(spark, d):
    return ops.sizes_from_index(A.blob_locations(spark, d))


@query(PP + "SELECT backend, count(*)::BIGINT AS objects, sum(bytes)::BIGINT AS bytes FROM placements WHERE state = 'live' GROUP BY backend")
def placement_counts_by_backend(spark, d):
    return ops.backend_counts(A.placements(spark, d))


@query(
    A.with_sql(A.PACKS, A.PLACEMENTS, LIVE.replace("state = 'live'", "state = 'live' AND role <> 'read-cache'")) + """SELECT pack_id, coalesce(offsite_copies, 0) AS offsite_copies, coalesce(domains, 0) AS domains, coalesce(copies, 0) AS copies,
coalesce(copies, 0) >= 2 AND coalesce(domains, 0) >= 2 AND coalesce(offsite_copies, 0) >= 1 AS durable FROM packs LEFT JOIN sets USING (pack_id)"""
)
def pack_durability(spark, d):
    return ops.durability(A.packs(spark, d), A.placements(spark, d), A.backends(spark, d), copies=2, offsite=1)


@query(
    PP + """, g AS (SELECT pack_id, count(*) AS n, max(role) AS role FROM placements JOIN backends USING (backend) WHERE state = 'live' AND role <> 'read-cache' GROUP BY pack_id)
SELECT pack_id, CASE WHEN coalesce(n, 0) = 0 THEN 'unknown' WHEN n > 1 THEN 'mirrored' WHEN role = 'archive' THEN 'cold' WHEN role = 'primary' THEN 'hot' ELSE 'single' END AS tier FROM packs LEFT JOIN g USING (pack_id)"""
)
def derived_tier(spark, d):
    return ops.derived_tier(A.packs(spark, d), A.placements(spark, d), A.backends(spark, d))


@query(
    P + """SELECT pack_id, epoch_us(greatest(TIMESTAMP '1999-01-31', min_retention_until))::BIGINT AS delete_us,
coalesce(unused_bytes / 1073741824.0 * 2.0 * 12 > (physical_size + 4096) / 1073741824.0 * (3.0 + 2.0 * greatest(0, epoch_us(min_retention_until) - epoch_us(TIMESTAMP '1996-01-01')) / 3600e6 / 720) + 2 / 1000.0 * 1e-6
  AND min_retention_until IS NOT NULL, false) AS pays FROM packs"""
)
def repack_economics(spark, d):
    return A.packs(spark, d).select("pack_id", F.unix_micros(ops.delete_after(datetime(1999, 1, 1), 30)).alias("delete_us"), ops.repack_pays(datetime(1996, 1, 1), 2.0, 12 * ops.MONTH, 3.0, 1e-6, 2, 4096).alias("pays"))


@query(
    A.with_sql(A.BLOBS) + """, h AS (SELECT p_partkey::BIGINT AS blob_id, max(p_size)::BIGINT AS horizon FROM part WHERE p_partkey % 50 <> 0 GROUP BY 1)
SELECT pack_id, bool_and(horizon IS NOT NULL) AS eligible, CASE WHEN bool_and(horizon IS NOT NULL) THEN min(horizon) END AS horizon FROM blob_locations LEFT JOIN h USING (blob_id) GROUP BY pack_id"""
)
def promotion_horizon(spark, d):
    r = A.table(spark, d, "part").filter("p_partkey % 50 <> 0").select(F.col("p_partkey").cast("long").alias("blob_id"), F.col("p_size").cast("long").alias("horizon"))
    return ops.promotion_horizons(r, A.blob_locations(spark, d).select("pack_id", "blob_id"))


WANTED = [("data", 1), ("data", 2), ("data", 3), ("tree", 1), ("mixed", 5)]
PLAN = """
wanted AS (SELECT * FROM (VALUES ('data', 1), ('data', 2), ('data', 3), ('tree', 1), ('mixed', 5)) t(type, backend)),
plan AS (SELECT pack_id, count(*)::BIGINT AS missing, min(w.backend)::BIGINT AS next_backend FROM packs JOIN wanted w USING (type)
  WHERE lifecycle = 'published' AND NOT EXISTS (FROM placements l WHERE l.state = 'live' AND l.pack_id = packs.pack_id AND l.backend = w.backend) GROUP BY pack_id)"""


def wanted(spark):
    return spark.createDataFrame(WANTED, "type string, backend long")


@query(A.with_sql(A.PACKS, A.PLACEMENTS, PLAN) + "SELECT * FROM plan")
def placement_plan(spark, d):
    return reach.next_placements(A.packs(spark, d), A.placements(spark, d), wanted(spark))


@query(
    A.with_sql(A.PACKS, A.PLACEMENTS, PLAN) + """SELECT (SELECT count(*) FROM packs WHERE lifecycle = 'published')::BIGINT AS scanned, count(*)::BIGINT AS unsatisfied, coalesce(sum(missing), 0)::BIGINT AS missing,
(SELECT count(*) FROM placements WHERE state = 'pending')::BIGINT AS pending FROM plan"""
)
def placement_scheduler_summary(spark, d):
    plan = reach.next_placements(A.packs(spark, d), A.placements(spark, d), wanted(spark))
    return reach.scheduler_summary(plan, A.packs(spark, d), A.placements(spark, d))


@query(
    PP + """SELECT pack_id, physical_size FROM packs WHERE lifecycle NOT IN ('deleted', 'delete-pending') AND pack_id IN (SELECT pack_id FROM placements WHERE state = 'live' AND backend = 7)
AND pack_id NOT IN (SELECT pack_id FROM placements WHERE state = 'live' AND backend = 9) AND pack_id NOT IN (SELECT pack_id FROM placements WHERE state = 'pending')"""
)
def pool_migration(spark, d):
    p = A.placements(spark, d)
    return reach.migration(p, A.packs(spark, d), p.filter("state = 'pending'"), 7, 9)


def _buckets(units):
    kinds = {"added": "type IN ('created', 'imported')", "deleted": "type = 'deleted'", "repacked": "type = 'repacked-into'", "promoted": "type = 'promoted'"}
    sums = ", ".join(f"count(*) FILTER (WHERE {c})::BIGINT AS {n}_packs, coalesce(sum(physical_size) FILTER (WHERE {c}), 0)::BIGINT AS {n}_bytes" for n, c in kinds.items())
    return f"""buckets AS (SELECT granularity, date_trunc(granularity, ts)::TIMESTAMP AS start, backend, pack_type, count(*)::BIGINT AS events_observed, {sums}, max(CASE WHEN type = 'imported' THEN 2 ELSE 0 END)::INTEGER AS coverage_rank
  FROM pack_events, (SELECT unnest({units}) AS granularity) g GROUP BY ALL)"""


B = A.with_sql(A.EVENTS, _buckets(["hour", "day", "month"]))


@query(B + "SELECT * EXCLUDE (start), epoch_us(start)::BIGINT AS start_us FROM buckets")
def event_buckets(spark, d):
    out = series.buckets(A.pack_events(spark, d))
    return out.select(*(c for c in out.columns if c != "start"), F.unix_micros("start").alias("start_us"))


COVER = "CASE max(coverage_rank) WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' ELSE 'reconstructed' END AS coverage"


def _series(metric, by, units, granularity):
    group = f"coalesce({by}, 'unknown')" if by else "'all'"
    return A.with_sql(A.EVENTS, _buckets(units)) + f"""SELECT epoch_us(start)::BIGINT AS start_us, {group} AS "group", sum({metric})::BIGINT AS value, {COVER}, sum(events_observed)::BIGINT AS events_observed
FROM buckets WHERE granularity = '{granularity}' GROUP BY start, {group}"""


def _points(spark, d, metric, by, granularity):
    return series.series(series.buckets(A.pack_events(spark, d), [granularity]), metric, by)


def _micros(out):
    return out.select(F.unix_micros("start").alias("start_us"), "group", "value", "coverage", "events_observed")


@query(_series("added_bytes", None, ["day"], "day"))
def history_series_added_by_day(spark, d):
    return _micros(_points(spark, d, "added_bytes", None, "day"))


@query(_series("deleted_packs", "pack_type", ["hour"], "hour"))
def history_series_deleted_by_hour_and_type(spark, d):
    return _micros(_points(spark, d, "deleted_packs", "pack_type", "hour"))


@query(_series("repacked_bytes", "pack_type", ["week"], "week"))
def history_series_repacked_by_week(spark, d):
    return _micros(_points(spark, d, "repacked_bytes", "pack_type", "week"))


@query(_series("promoted_packs", None, ["month"], "month"))
def history_series_promoted_by_month(spark, d):
    return _micros(_points(spark, d, "promoted_packs", None, "month"))


@query(
    A.with_sql(A.EVENTS, _buckets(["day"])) + """SELECT epoch_us(start)::BIGINT AS start_us, backend, pack_type,
CASE WHEN start < TIMESTAMP '2024-01-10' THEN added_packs + 1000 ELSE added_packs END AS added_packs FROM buckets"""
)
def stored_buckets_win_over_late_events(spark, d):
    fresh = series.buckets(A.pack_events(spark, d), ["day"])
    stored = fresh.filter(F.col("start") < F.lit(datetime(2024, 1, 10))).withColumn("added_packs", F.col("added_packs") + 1000)
    return series.merged(stored, A.pack_events(spark, d), "day").select(F.unix_micros("start").alias("start_us"), "backend", "pack_type", "added_packs")


H = A.with_sql(A.EVENTS, _buckets(["hour"])) + ", p AS (SELECT start, sum(added_bytes)::BIGINT AS value FROM buckets GROUP BY start)"


@query(
    H + """, e AS (SELECT min(value) AS lo, max(value) AS hi, greatest(1, (max(value) - min(value)) // 10)::BIGINT AS w FROM p)
SELECT bin::INTEGER AS bin, (lo + bin * w)::BIGINT AS "from", CASE WHEN bin = 9 OR lo = hi THEN hi ELSE lo + (bin + 1) * w END::BIGINT AS "to",
  (SELECT count(*) FROM p WHERE lo = hi OR (value >= lo + bin * w AND CASE WHEN bin = 9 THEN value <= hi ELSE value < lo + (bin + 1) * w END))::BIGINT AS points
FROM e, range(10) r(bin) WHERE lo < hi OR bin = 0"""
)
def series_histogram(spark, d):
    return series.histogram(_points(spark, d, "added_bytes", None, "hour"))


@query(
    H + """, x AS (SELECT value::DOUBLE AS y, (row_number() OVER (ORDER BY start) - 1)::DOUBLE AS x FROM p)
SELECT count(*)::BIGINT AS points, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_intercept(y, x) + regr_slope(y, x) * count(*), 6) AS next_value FROM x"""
)
def series_forecast(spark, d):
    out = series.forecast(_points(spark, d, "added_bytes", None, "hour"), allow_incomplete=True)
    return out.select("points", *(F.round(c, 6).alias(c) for c in ("slope", "intercept", "next_value")))


@query(A.with_sql(A.EVENTS, _buckets(["month"])) + "SELECT backend, pack_type, added_packs FROM buckets WHERE backend = 2")
def buckets_that_changed(spark, d):
    fresh = series.buckets(A.pack_events(spark, d), ["month"])
    stored = fresh.withColumn("added_packs", F.when(F.col("backend") == 2, F.lit(0)).otherwise(F.col("added_packs")).cast("long"))
    return series.changed(stored, fresh).select("backend", "pack_type", "added_packs")
