"""Work queues, placement plans, audits by location, views against facts, walks from retained roots, imports with debts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn import adapters as A
from cairn.catalog.fact_queries import REFS, WITH, facts, references
from cairn.catalog.pack_queries import RATIO
from cairn.catalog.tree_queries import ALL_AP, ALL_EDGES, accounts, edge_rows
from cairn.operators import facts as fact_ops
from cairn.operators import observed, packs, reach, reports, snapshots, trees, work
from cairn.registry import query


@query(
    A.with_sql(A.PACKS, A.PLACEMENTS, REFS) + """SELECT blob_id, pack_id, lifecycle, epoch_us(min_retention_until)::BIGINT AS retained_us, backend, state, role, offsite
FROM (SELECT DISTINCT blob_id, pack_id FROM refs WHERE uid = 7) LEFT JOIN packs USING (pack_id)
LEFT JOIN (SELECT pack_id, backend, state, role, offsite FROM placements LEFT JOIN backends USING (backend) WHERE state <> 'deleted') USING (pack_id)"""
)
def erasure_audit_locations(spark, d):
    out = reports.audit_locations(references(spark, d), A.packs(spark, d), A.placements(spark, d), A.backends(spark, d), 7)
    return out.select("blob_id", "pack_id", "lifecycle", F.unix_micros("min_retention_until").alias("retained_us"), "backend", "state", "role", "offsite")


@query(
    WITH + """, v AS (SELECT coalesce(svm, 'unknown') AS svm, coalesce(year::VARCHAR, 'unknown') AS year FROM facts GROUP BY ALL)
SELECT svm, year, CASE WHEN year = '1993' THEN 'missing' ELSE 'different' END AS kind FROM v WHERE year IN ('1993', '1995')
UNION ALL SELECT DISTINCT svm, '1900', 'unexpected' FROM v"""
)
def view_against_facts(spark, d):
    """A stored view that lacks a year, miscounts another and holds one of no fact."""
    fresh = fact_ops.grouped(facts(spark, d), ["svm", "year"])
    wrong = fresh.filter("year <> '1993'").withColumn("files", F.col("files") + F.when(F.col("year") == "1995", 1).otherwise(0))
    ghost = fresh.select("svm").distinct().select(*(F.col("svm") if c == "svm" else F.lit("1900" if c == "year" else 1).cast(fresh.schema[c].dataType).alias(c) for c in fresh.columns))
    return reports.view_drift(wrong.unionByName(ghost), fresh, ["svm", "year"])


HORIZON = """h AS (SELECT p_partkey::BIGINT AS blob_id, max(p_size)::BIGINT AS horizon FROM part WHERE p_partkey % 50 <> 0 GROUP BY 1),
promotion AS (SELECT pack_id, bool_and(horizon IS NOT NULL) AS eligible, CASE WHEN bool_and(horizon IS NOT NULL) THEN min(horizon) END AS horizon FROM blob_locations LEFT JOIN h USING (blob_id) GROUP BY pack_id)"""


@query(
    A.with_sql(A.PACKS, A.PLACEMENTS, A.BLOBS, HORIZON) + """SELECT pack_id, horizon FROM packs JOIN promotion USING (pack_id)
WHERE eligible AND horizon <= 10 AND pack_id IN (SELECT pack_id FROM placements JOIN backends USING (backend) WHERE state = 'live' AND role IN ('archive', 'replica'))"""
)
def pack_filter_by_class_and_promotion(spark, d):
    """The role of a backend stands for the storage class of what lies there."""
    r = A.table(spark, d, "part").filter("p_partkey % 50 <> 0").select(F.col("p_partkey").cast("long").alias("blob_id"), F.col("p_size").cast("long").alias("horizon"))
    promotion = packs.promotion_horizons(r, A.blob_locations(spark, d).select("pack_id", "blob_id"))
    classes = A.placements(spark, d).join(A.backends(spark, d).select("backend", F.col("role").alias("storage_class")), "backend")
    f = packs.PackFilter(classes=("archive", "replica"), promotion_due_at=10)
    return f.apply(A.packs(spark, d), classes, None, promotion).select("pack_id", "horizon")


@query(A.with_sql(A.SNAPSHOTS) + "SELECT id FROM snapshots WHERE size % 1000 BETWEEN 100 AND 250")
def snapshot_filter_by_size_added(spark, d):
    s = A.snapshots(spark, d).withColumn("size_added", F.col("size") % 1000)
    return snapshots.SnapshotFilter(added_min=100, added_max=250).apply(s).select("id")


NOW = datetime(1996, 6, 1)
REQUESTS = """requests AS (SELECT lpad(l_orderkey::VARCHAR, 10, '0') || '-' || l_linenumber AS pack_id, l_suppkey::BIGINT AS backend, l_shipdate::TIMESTAMP + INTERVAL 30 DAY AS deadline,
  CASE WHEN l_returnflag = 'N' THEN l_shipdate::TIMESTAMP END AS not_before, round(l_extendedprice)::BIGINT AS bytes FROM lineitem)"""


def requests(spark, d):
    day = F.col("l_shipdate").cast("timestamp")
    return A.table(spark, d, "lineitem").select(
        F.concat(F.lpad(F.col("l_orderkey").cast("string"), 10, "0"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("pack_id"), F.col("l_suppkey").cast("long").alias("backend"),
        (day + F.expr("INTERVAL 30 DAYS")).alias("deadline"), F.when(F.col("l_returnflag") == "N", day).alias("not_before"), F.round("l_extendedprice").cast("long").alias("bytes"),
    )


@query(
    A.with_sql(REQUESTS) + """, r AS (SELECT *, coalesce(not_before > TIMESTAMP '1996-06-01', false) AS wait FROM requests)
SELECT pack_id, backend, CASE WHEN wait THEN 'deferred' WHEN row_number() OVER (PARTITION BY backend, wait ORDER BY deadline, pack_id) <= backend % 7 * 20 THEN 'attempt' ELSE 'limited' END AS decision FROM r"""
)
def work_due_by_deadline(spark, d):
    limits = A.backends(spark, d).select("backend", (F.col("backend") % 7 * 20).alias("max_requests"), F.lit(None).cast("long").alias("max_bytes"))
    return work.due(requests(spark, d), limits, NOW).select("pack_id", "backend", "decision")


@query(
    A.with_sql(A.PACKS, A.PLACEMENTS) + """, lasting AS (SELECT * FROM backends WHERE role <> 'read-cache'),
live AS (SELECT DISTINCT pack_id, backend, offsite, failure_domain FROM placements JOIN lasting USING (backend) WHERE state = 'live'),
have AS (SELECT pack_id, count(backend)::BIGINT AS c, count(*) FILTER (WHERE offsite)::BIGINT AS o, count(DISTINCT failure_domain)::BIGINT AS dn FROM packs LEFT JOIN live USING (pack_id) GROUP BY pack_id),
miss AS (SELECT *, greatest(0, 2 - c) AS missing_copies, greatest(0, 2 - dn) AS missing_domains, greatest(0, 1 - o) AS missing_offsite FROM have),
free AS (SELECT pack_id, backend, offsite, failure_domain NOT IN (SELECT failure_domain FROM live l WHERE l.pack_id = m.pack_id) AS fresh
  FROM (SELECT pack_id FROM miss WHERE missing_copies + missing_domains + missing_offsite > 0) m, lasting b WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.pack_id = m.pack_id AND l.backend = b.backend)),
pick AS (SELECT pack_id, min(backend) AS f_any, min(backend) FILTER (WHERE fresh) AS f_new, min(backend) FILTER (WHERE offsite) AS f_off, min(backend) FILTER (WHERE offsite AND fresh) AS f_both FROM free GROUP BY pack_id)
SELECT pack_id, missing_copies::BIGINT AS missing_copies, missing_domains::BIGINT AS missing_domains, missing_offsite::BIGINT AS missing_offsite,
  CASE WHEN missing_copies + missing_domains + missing_offsite = 0 THEN greatest(0, c - 2) ELSE 0 END::BIGINT AS excess,
  coalesce(CASE WHEN missing_offsite > 0 THEN coalesce(f_both, f_off) END, CASE WHEN missing_domains > 0 THEN f_new END, f_any) AS next_backend, epoch_us(created_at + INTERVAL 24 HOUR)::BIGINT AS deadline_us
FROM miss JOIN packs USING (pack_id) LEFT JOIN pick USING (pack_id) WHERE missing_copies + missing_domains + missing_offsite > 0 OR c > 2"""
)
def placement_plan_with_deadlines(spark, d):
    out = work.placement_plan(A.packs(spark, d), A.placements(spark, d), A.backends(spark, d), copies=2, offsite=1)
    return out.select("pack_id", "missing_copies", "missing_domains", "missing_offsite", "excess", "next_backend", F.unix_micros("deadline").alias("deadline_us"))


@query(
    """WITH v AS (SELECT s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'available' WHEN 1 THEN 'stale' ELSE 'gone' END AS availability, CASE WHEN s_suppkey % 5 > 0 THEN s_nationkey END AS latency FROM supplier)
SELECT name, row_number() OVER (ORDER BY CASE availability WHEN 'available' THEN 0 WHEN 'stale' THEN 1 ELSE 2 END, latency DESC NULLS LAST, name)::INTEGER AS place FROM v"""
)
def watched_view_in_order(spark, d):
    k = F.col("s_suppkey")
    v = A.table(spark, d, "supplier").select(
        F.col("s_name").alias("name"), F.when(k % 3 == 0, "available").when(k % 3 == 1, "stale").otherwise("gone").alias("availability"), F.when(k % 5 > 0, F.col("s_nationkey")).alias("latency")
    )
    return work.view_order(v, "latency", ["name"], descending=True).select("name", "place")


@query(
    A.with_sql(ALL_EDGES) + """, t AS (SELECT s_suppkey AS id, 's' || s_suppkey AS tree FROM supplier WHERE s_suppkey % 50 = 0),
r(key) AS (SELECT tree AS key FROM t WHERE id % 100 <> 0 UNION SELECT child FROM r JOIN edges ON parent = key) SELECT key FROM r"""
)
def reachable_from_retained_snapshots(spark, d):
    s = A.table(spark, d, "supplier").filter("s_suppkey % 50 = 0").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("tree"))
    return reach.retained(edge_rows(spark, d), s, s.filter("id % 100 = 0").select("id"))


#: Parts as a binary tree: part n lies below part n / 2.
TREE = """tree AS (SELECT (p_partkey // 2)::BIGINT AS parent, 'n' || p_partkey AS name, p_partkey::BIGINT AS child FROM part WHERE p_partkey > 1)"""


def tree(spark, d):
    k = F.col("p_partkey")
    return A.table(spark, d, "part").filter("p_partkey > 1").select(F.floor(k / 2).cast("long").alias("parent"), F.concat(F.lit("n"), k.cast("string")).alias("name"), k.cast("long").alias("child"))


@query(
    A.with_sql(TREE) + """, r(key) AS (SELECT 5::BIGINT AS key UNION SELECT child FROM r JOIN tree ON parent = key),
n AS (SELECT p_partkey::BIGINT AS key, (p_partkey % 3)::INTEGER AS fsid, (p_partkey % 40)::BIGINT AS inode, p_size::BIGINT AS revision FROM part)
SELECT fsid, inode, min(revision) AS revision FROM n WHERE (fsid, inode) IN (SELECT (fsid, inode) FROM n JOIN r USING (key)) GROUP BY ALL"""
)
def identities_below_a_root(spark, d):
    k = F.col("p_partkey")
    n = A.table(spark, d, "part").select(k.cast("long").alias("key"), (k % 3).cast("int").alias("fsid"), (k % 40).cast("long").alias("inode"), F.col("p_size").cast("long").alias("revision"))
    return reach.identities(tree(spark, d), n, spark.createDataFrame([(5,)], "key long"), oldest=True)


@query(
    A.with_sql(TREE) + """, e AS (SELECT * FROM tree UNION ALL SELECT child, 'back', parent FROM tree WHERE child % 17 = 0),
r AS (SELECT 1::BIGINT AS root, '' AS path, 1::BIGINT AS key, 0 AS level, []::BIGINT[] AS above, NULL::VARCHAR AS reason
  UNION ALL SELECT root, path || '/' || name, child, level + 1, list_append(above, key),
    CASE WHEN list_contains(list_append(above, key), child) THEN 'cycle' WHEN child % 13 = 0 THEN 'unreadable' WHEN level + 1 > 5 THEN 'too deep' END FROM r JOIN e ON parent = key WHERE reason IS NULL)
SELECT path, key, coalesce(reason, 'read') AS outcome FROM r"""
)
def tree_import_with_debts(spark, d):
    t = tree(spark, d)
    e = t.unionByName(t.filter("child % 17 = 0").select(F.col("child").alias("parent"), F.lit("back").alias("name"), F.col("parent").alias("child")))
    readable = A.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("key")).filter("key % 13 <> 0")
    good, bad = reach.import_trees(e, readable, spark.createDataFrame([(1,)], "root long"), 5)
    return good.select("path", "key", F.lit("read").alias("outcome")).unionByName(bad.select("path", "key", F.col("reason").alias("outcome")))


@query(A.with_sql(TREE) + ", r AS (SELECT '' AS path, 1::BIGINT AS key, 0 AS level UNION ALL SELECT path || '/' || name, child, level + 1 FROM r JOIN tree ON parent = key WHERE key % 7 <> 3) SELECT path, key, level FROM r")
def tree_walk_with_prune(spark, d):
    return trees.walk(tree(spark, d), spark.createDataFrame([(1,)], "root long"), prune=F.col("key") % 7 == 3).select("path", "key", "level")


@query("SELECT 13::BIGINT AS key")
def subfolder_of_a_snapshot(spark, d):
    return trees.resolve(tree(spark, d), 1, "/n3/n6/n13")


@query(A.with_sql(A.NODES) + "SELECT snapshot, path, CASE WHEN type = 'file' THEN 0 ELSE mode END::INTEGER AS mode FROM nodes WHERE type <> 'symlink' AND size % 10 <> 0")
def nodes_rewritten_or_dropped(spark, d):
    drop = (F.col("type") == "symlink") | (F.col("size") % 10 == 0)
    return trees.rewrite_nodes(A.nodes(spark, d), drop, mode=F.when(F.col("type") == "file", 0).otherwise(F.col("mode")).cast("int")).select("snapshot", "path", "mode")


@query()
def content_defined_chunks(spark, d):
    return trees.content_chunks(A.table(spark, d, "pages"), "page_id", "html")


@query(
    """WITH b AS (SELECT (o_orderkey % 2)::INTEGER AS fsid, o_orderkey::BIGINT AS inode, (o_orderkey % 3)::BIGINT AS revision, o_orderstatus AS name FROM orders)
SELECT fsid, inode, revision, name, round(o_totalprice)::BIGINT AS size FROM b JOIN orders ON o_orderkey = inode"""
)
def bindings_with_their_revision(spark, d):
    k = F.col("o_orderkey")
    o = A.table(spark, d, "orders").select((k % 2).cast("int").alias("fsid"), k.cast("long").alias("inode"), (k % 3).cast("long").alias("revision"), F.col("o_orderstatus").alias("name"), F.round("o_totalprice").cast("long").alias("size"))
    return observed.bound_revisions(o.select("fsid", "inode", "revision", "name"), o.select("fsid", "inode", "revision", "size"))


COVER = """cover AS (SELECT (o_custkey % 20)::BIGINT AS source, o_orderdate::TIMESTAMP AS start, o_orderdate::TIMESTAMP + to_days((o_orderkey % 9 + 1)::INTEGER) AS "end" FROM orders),
win AS (SELECT (o_custkey % 20)::BIGINT AS source, o_orderdate::TIMESTAMP + INTERVAL 12 HOUR AS start, o_orderdate::TIMESTAMP + INTERVAL 60 HOUR AS "end" FROM orders WHERE o_orderstatus = 'F')"""


@query(
    A.with_sql(COVER) + """, b AS (SELECT *, coalesce(start > max("end") OVER (PARTITION BY source ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM cover),
g AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY source ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM b),
w AS (SELECT source, min(start) AS a, max("end") AS z FROM g GROUP BY source, run)
SELECT source, epoch_us(start)::BIGINT AS start_us, start >= TIMESTAMP '1994-01-01' AND EXISTS (SELECT 1 FROM w WHERE w.source = win.source AND a <= win.start AND win."end" <= z) AS valid FROM win"""
)
def windows_observed_without_a_gap(spark, d):
    o, day = A.table(spark, d, "orders"), F.col("o_orderdate").cast("timestamp")
    source = (F.col("o_custkey") % 20).cast("long").alias("source")
    cover = o.select(source, day.alias("start"), (day + F.make_dt_interval((F.col("o_orderkey") % 9 + 1).cast("int"))).alias("end"))
    windows = o.filter("o_orderstatus = 'F'").select(source, (day + F.expr("INTERVAL 12 HOURS")).alias("start"), (day + F.expr("INTERVAL 60 HOURS")).alias("end"))
    return observed.covered_windows(windows, cover, datetime(1994, 1, 1)).select("source", F.unix_micros("start").alias("start_us"), "valid")


@query("SELECT (c + 1)::BIGINT AS first_missing, (n - 1)::BIGINT AS last_missing FROM (SELECT o_orderkey AS c, lead(o_orderkey) OVER (ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'O') WHERE n > c + 1")
def gaps_of_a_change_feed(spark, d):
    return observed.feed_gaps(A.table(spark, d, "orders").filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").cast("long").alias("commit")))


@query(
    ALL_AP + """SELECT pack_id, type = 'data' AS o0, plan.used_bytes + waste >= 50000 AS o1, round(-waste / plan.used_bytes, 9) AS o2 FROM plan JOIN packs USING (pack_id) WHERE plan = 'repack'"""
)
def repack_candidate_order(spark, d):
    c = reach.classify_packs(accounts(spark, d), 100_000).join(A.packs(spark, d).select("pack_id", "type"), "pack_id")
    return reach.candidate_order(c, 50_000).select("pack_id", "o0", "o1", F.round("o2", 9).alias("o2"))


@query(
    A.with_sql(A.PACKS) + "SELECT * FROM (" + " UNION ALL ".join(
        f"(SELECT '{name}' AS listing, row_number() OVER (ORDER BY {key} {'ASC' if name in ('retention', 'id') else 'DESC'} NULLS LAST, pack_id)::INTEGER AS place, pack_id FROM packs ORDER BY place LIMIT 30)"
        for name, key in {**packs.ORDERS, "ratio": f"({RATIO})"}.items()
    ) + ")"
)
def packs_in_each_order(spark, d):
    out = None
    for name in packs.ORDERS:
        rows = packs.listing(A.packs(spark, d), name, 30)
        up = name in ("retention", "id")
        key = F.asc_nulls_last(packs.ORDERS[name]) if up else F.desc_nulls_last(packs.ORDERS[name])
        rows = rows.withColumn("place", F.row_number().over(Window.orderBy(key, "pack_id"))).select(F.lit(name).alias("listing"), "place", "pack_id")  # 30 rows
        out = rows if out is None else out.unionByName(rows)
    return out
