"""Streams, incremental state, published generations, exports and jobs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from cairn import adapters as A
from cairn.catalog.fact_queries import MEASURES, WITH, facts
from cairn.operators import facts as ops
from cairn.operators import metrics, series
from cairn.plans import jobs
from cairn.plans.query import Query
from cairn.registry import query
from cairn.sources import layers, repository, sinks
from cairn.streaming import catchup, rollup


def event_schema(spark, d):
    return A.table(spark, d, "events").schema


@query("SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts::TIMESTAMP, TIMESTAMP '2000-01-01'))::BIGINT AS start_us, event_type, count(*)::BIGINT AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL")
def stream_tumbling_windows(spark, d):
    at = A.folder(spark)
    stream = rollup.windowed_counts(rollup.read_events(spark, f"{d}/events.parque[t]", event_schema(spark, d)), "6 hours")
    out = rollup.run_to_table(spark, stream, f"{at}/out", f"{at}/checkpoint")
    return out.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", "cents")


@query("""SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP, TIMESTAMP '2000-01-01') - to_hours(k))::BIGINT AS start_us, event_type, count(*)::BIGINT AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents
FROM events, (SELECT unnest(range(0, 3))::INTEGER AS k) GROUP BY ALL""")
def stream_sliding_windows(spark, d):
    at = A.folder(spark)
    stream = rollup.windowed_counts(rollup.read_events(spark, f"{d}/events.parque[t]", event_schema(spark, d)), "3 hours", "1 hour")
    out = rollup.run_to_table(spark, stream, f"{at}/out", f"{at}/checkpoint")
    return out.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", "cents")


DELTAS = """deltas AS (SELECT event_id::BIGINT AS commit, (user_id % 500)::BIGINT AS inode, CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'classify' WHEN 'error' THEN 'state' ELSE 'refs' END AS kind,
 CASE WHEN event_type IN ('signup', 'click') THEN (user_id % 50)::BIGINT END AS uid, CASE WHEN event_type IN ('signup', 'click') THEN round(value * 100)::BIGINT END AS size,
 CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'deleted' ELSE 'live' END END AS state, CASE event_type WHEN 'view' THEN 'inc' WHEN 'purchase' THEN 'set' END AS ref_op,
 CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN event_id % 3 END::BIGINT AS refs FROM events)"""
STATE = DELTAS + """,
sets AS (SELECT inode, max(commit) FILTER (WHERE ref_op = 'set') AS s, arg_max(refs, commit) FILTER (WHERE ref_op = 'set') AS base FROM deltas GROUP BY inode),
final AS (SELECT inode, arg_max_null(uid, commit) FILTER (WHERE kind IN ('create', 'classify')) AS uid, arg_max_null(size, commit) FILTER (WHERE kind IN ('create', 'classify')) AS size,
  arg_max(state, commit) FILTER (WHERE kind = 'state') AS state, (coalesce(max(base), 0) + count(*) FILTER (WHERE ref_op = 'inc' AND (s IS NULL OR commit > s)))::BIGINT AS refs
  FROM deltas JOIN sets USING (inode) GROUP BY inode)"""


def deltas(spark, d):
    e = A.table(spark, d, "events")
    kind, i = F.col("event_type"), F.col("event_id").cast("long")
    owns = kind.isin("signup", "click")
    return e.select(
        i.alias("commit"), F.when(kind == "signup", "create").when(kind == "click", "classify").when(kind == "error", "state").otherwise("refs").alias("kind"), (F.col("user_id") % 500).cast("long").alias("inode"),
        F.when(owns, F.col("user_id") % 50).cast("long").alias("uid"), F.when(owns, F.round(F.col("value") * 100)).cast("long").alias("size"),
        F.when(kind == "error", F.when(i % 2 == 0, "deleted").otherwise("live")).alias("state"), F.when(kind == "view", "inc").when(kind == "purchase", "set").alias("ref_op"),
        F.when(kind == "view", F.lit(1).cast("long")).when(kind == "purchase", i % 3).alias("refs"),
    )


RESIDENCY = "CASE WHEN state = 'deleted' THEN CASE WHEN refs > 0 THEN 'archive-only' ELSE 'expired' END ELSE coalesce(state, 'unknown') END AS residency"


@query(A.with_sql(STATE) + f"SELECT inode, uid, size, refs, {RESIDENCY} FROM final")
def stream_catch_up_in_batches(spark, d):
    """Four files of deltas, one micro-batch each: the state must be that of all deltas at once."""
    at = A.folder(spark)
    all_deltas = deltas(spark, d)
    top = all_deltas.agg(F.max("commit")).first()[0] or 0
    for k in range(4):  # files in commit order
        all_deltas.filter((F.col("commit") * 4 >= top * k) & (F.col("commit") * 4 < top * (k + 1) + 4 * (k == 3))).coalesce(1).write.mode("append").parquet(f"{at}/deltas")
    catchup.catch_up(spark, f"{at}/deltas", f"{at}/state", f"{at}/checkpoint")
    return catchup.read(spark, f"{at}/state").select("inode", "uid", "size", "refs", catchup.residency(F.col("state"), F.col("refs")).alias("residency"))


@query(A.with_sql(STATE) + f"SELECT inode, uid, size, refs, {RESIDENCY} FROM final")
def deltas_applied_at_once(spark, d):
    out = catchup.current(catchup.changes(deltas(spark, d)))
    return out.select("inode", "uid", "size", "refs", catchup.residency(F.col("state"), F.col("refs")).alias("residency"))


@query("SELECT o_custkey % 10 AS owner, (count(*) FILTER (WHERE o_orderkey % 2 = 0) - count(*) FILTER (WHERE o_orderkey % 3 = 0))::BIGINT AS files, (coalesce(sum(round(o_totalprice)::BIGINT) FILTER (WHERE o_orderkey % 2 = 0), 0) - coalesce(sum(round(o_totalprice)::BIGINT) FILTER (WHERE o_orderkey % 3 = 0), 0))::BIGINT AS bytes FROM orders GROUP BY 1")
def signed_view_changes(spark, d):
    o = A.table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("owner"), F.round("o_totalprice").cast("long").alias("size"), "o_orderkey")
    return catchup.view_changes(o.filter("o_orderkey % 3 = 0").drop("o_orderkey"), o.filter("o_orderkey % 2 = 0").drop("o_orderkey"), "owner")


@query("SELECT o_orderkey, (CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1000000 ELSE o_custkey END)::BIGINT AS owner FROM orders WHERE o_orderkey % 7 <> 0")
def layered_generations(spark, d):
    """A whole table, a layer of changed rows and a layer of deletions, read as one table."""
    at = A.folder(spark)
    o = A.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("owner"))
    layers.add(o, at, 0)
    layers.add(o.filter("o_orderkey % 5 = 0").select("o_orderkey", (F.col("owner") + 1_000_000).alias("owner")), at, 1)
    layers.add(o.filter("o_orderkey % 7 = 0").withColumn("deleted", F.lit(True)), at, 2)
    return layers.read(spark, at, ["o_orderkey"])


@query(A.with_sql(A.PACKS) + "SELECT pack_id, ((row_number() OVER (ORDER BY pack_id) - 1) // 1000)::BIGINT AS batch FROM packs WHERE lifecycle IN ('export-pending', 'delete-pending')")
def export_batches(spark, d):
    return sinks.numbered(sinks.select_for_export(A.packs(spark, d))).select("pack_id", "batch")


@query(A.with_sql(A.PACKS) + "SELECT pack_id, lifecycle FROM packs WHERE lifecycle = 'export-pending'")
def export_round_trip(spark, d):
    at = A.folder(spark)
    sinks.export(sinks.select_for_export(A.packs(spark, d), pending_only=True).select("pack_id", "lifecycle"), at, per_file=500)
    return spark.read.schema("pack_id string, lifecycle string").json(f"{at}/*").select("pack_id", "lifecycle")


@query(A.with_sql(A.BLOBS) + "SELECT pack_id, count(*)::BIGINT AS blob_count, sum(length)::BIGINT AS payload_size FROM (SELECT pack_id, blob_id, min(length) AS length FROM blob_locations GROUP BY ALL) WHERE pack_id::BIGINT % 4 <> 0 GROUP BY pack_id")
def index_import(spark, d):
    """Index files written as JSON, read back, merged and imported; packs imported before take no part."""
    at = A.folder(spark)
    b = A.blob_locations(spark, d)
    blobs = F.collect_list(F.struct(F.col("blob_id").cast("string").alias("id"), "type", F.lit(0).cast("long").alias("offset"), "length"))
    packs = b.groupBy("pack_id").agg(blobs.alias("blobs")).select("pack_id", F.struct(F.col("pack_id").alias("id"), "blobs").alias("p"))
    files = max(1, b.agg(F.approx_count_distinct("pack_id")).first()[0] // 500)  # about 500 packs in a file, however many there are
    index = packs.groupBy(F.pmod(F.xxhash64("pack_id"), F.lit(files)).alias("file")).agg(F.collect_list("p").alias("packs"))
    index.select("packs").write.option("maxRecordsPerFile", 1).json(f"{at}/index")
    done = b.filter("CAST(pack_id AS BIGINT) % 4 = 0").select("pack_id")
    return repository.import_packs(repository.merged_index(repository.index_files(spark, f"{at}/index")), done)


@query(WITH + f"SELECT svm, {MEASURES} FROM facts WHERE identity_continuity <> 'unknown' GROUP BY svm")
def job_resumed_by_segment(spark, d):
    f = facts(spark, d).withColumn("segment", (F.col("inode") % 6).cast("long"))
    at, q = A.folder(spark), Query(group_by=("svm",))
    for n in (2, 1, None):
        jobs.resume(f, jobs.partial_groups(q), at, n)
    return jobs.result(spark, at, q)


@query(WITH + "SELECT * EXCLUDE (created_at), epoch_us(created_at)::BIGINT AS created_us FROM facts")
def facts_rebuilt_in_steps(spark, d):
    """The fact table rebuilt from revisions, a few segments in each run."""
    at = A.folder(spark)
    r = A.revisions(spark, d).withColumn("segment", (F.col("inode") % 6).cast("long"))
    build = lambda part: ops.make_facts(part).withColumn("segment", (F.col("inode") % 6).cast("long"))
    for n in (4, None):
        jobs.resume(r, build, at, n)
    out = jobs.built(spark, at, "segment long").drop("segment")
    return out.select(*(c for c in out.columns if c != "created_at"), F.unix_micros("created_at").alias("created_us"))


@query("SELECT 'm' || (user_id % 20) AS series, event_id::BIGINT AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 20, floor(epoch(ts))::BIGINT // 900 ORDER BY ts, event_id) = 1")
def thinned_samples(spark, d):
    s = A.table(spark, d, "events").select(F.concat(F.lit("m"), (F.col("user_id") % 20).cast("string")).alias("series"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("seq"))
    return rollup.thin(s, 900, 1_000_000_000).select("series", "seq")


@query("""WITH s AS (SELECT 'm' || (user_id % 20) AS series, event_id::BIGINT AS seq, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 20, floor(epoch(ts))::BIGINT // 15 ORDER BY ts, event_id) = 1)
SELECT series, seq FROM s QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts DESC, seq DESC) <= 62""")
def thinned_samples_in_a_ring(spark, d):
    """A sample each 15 seconds at most, and the newest 62 of a series."""
    s = A.table(spark, d, "events").select(F.concat(F.lit("m"), (F.col("user_id") % 20).cast("string")).alias("series"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("seq"))
    return rollup.thin(s, 15, 62).select("series", "seq")


@query(A.with_sql(A.EVENTS) + "SELECT backend, pack_type, epoch_us(date_trunc('day', ts)::TIMESTAMP)::BIGINT AS start_us, count(*)::BIGINT AS events_observed FROM pack_events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY ALL")
def roll_up_is_idempotent(spark, d):
    """Buckets stored, half of the events repeated: only days at or after the floor change, and a second run nothing."""
    at = A.folder(spark)
    e = A.pack_events(spark, d)
    layers.add(series.buckets(e.unionByName(e), ["day"]), at, 0)
    rollup.roll_up(spark, at, e, "day", datetime(2024, 1, 20))
    if not rollup.roll_up(spark, at, e, "day", datetime(2024, 1, 20)).isEmpty():
        raise AssertionError("a second roll-up changed buckets")
    rows = layers.read(spark, at, series.KEY).filter(F.col("start") >= F.lit(datetime(2024, 1, 20)))
    return rows.select("backend", "pack_type", F.unix_micros("start").alias("start_us"), "events_observed")


@query(A.with_sql(A.NODES) + """SELECT path, substr(type, 1, 1) || ' ' || lpad(size::VARCHAR, 12, ' ') || ' ' || path AS line FROM nodes WHERE snapshot = 'a'""")
def listing_as_text(spark, d):
    n = A.nodes(spark, d).filter("snapshot = 'a'")
    return sinks.listing_text(n).select(F.regexp_extract("value", r"^. +\d+ (.*)$", 1).alias("path"), F.col("value").alias("line"))


@query("SELECT event_id, 'requests' AS name, event_id * 2 AS value FROM events")
def metric_json_lines(spark, d):
    at = A.folder(spark)
    e = A.table(spark, d, "events").select("event_id", F.lit("requests").alias("name"), (F.col("event_id") * 2).alias("value"))
    sinks.append_lines(e, at)
    return spark.read.schema(e.schema).json(at)


@query("SELECT event_id, 'requests' AS name, event_id * 2 AS value FROM events")
def metric_json_lines_all_events(spark, d):
    at = A.folder(spark)
    e = A.table(spark, d, "events").select("event_id", F.lit("requests").alias("name"), (F.col("event_id") * 2).alias("value"))
    sinks.append_lines(e, at)
    return spark.read.schema(e.schema).json(at)


@query(A.with_sql(A.EVENTS) + "SELECT seq, type FROM pack_events WHERE seq % 10 <> 0 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'")
def event_log_with_corrupt_rows(spark, d):
    at = A.folder(spark)
    e = A.pack_events(spark, d)
    line = F.when(F.col("seq") % 10 == 0, F.lit('{"ts": broken')).otherwise(F.to_json(F.struct(*e.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}))
    e.select(line.alias("value")).write.text(at)
    good, _ = repository.event_log(spark, at, datetime(2024, 1, 5), datetime(2024, 1, 25))
    return good.select("seq", "type")


@query("SELECT DISTINCT event_type AS type, count(*)::BIGINT AS operations FROM events GROUP BY 1")
def operations_of_stream(spark, d):
    return metrics.by_class(A.table(spark, d, "events").select(F.col("event_type").alias("type"), F.col("ts").cast("timestamp").alias("ts")), datetime(2024, 2, 1)).select("type", "operations")
