"""Snapshots, trees, contents, histories, reachability, checks and metrics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from cairn import adapters as A
from cairn.functions import dates, paths
from cairn.operators import checks, history, metrics, reach, snapshots, trees
from cairn.registry import query

S = A.with_sql(A.SNAPSHOTS)
N = A.with_sql(A.NODES)
B = A.with_sql(A.BLOBS)


@query(
    S + """SELECT id FROM snapshots WHERE hostname IN ('host1', 'host2', 'host3') AND (len(list_filter(['O', 't1'], lambda t: NOT list_contains(tags, t))) = 0 OR len(tags) = 0)
AND paths IS NOT NULL AND list_contains(paths, '/home') AND label IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND time > TIMESTAMP '1995-06-01' AND time < TIMESTAMP '2001-01-01' AND size >= 1000 AND size <= 400000"""
)
def snapshot_filter(spark, d):
    f = snapshots.SnapshotFilter(
        hosts=("host1", "host2", "host3"), tags=(("O", "t1"), ("",)), paths=("/home",), labels=("1-URGENT", "2-HIGH", "3-MEDIUM"), after=datetime(1995, 6, 1), before=datetime(2001, 1, 1), size_min=1000, size_max=400_000
    )
    return f.apply(A.snapshots(spark, d)).select("id")


@query(S + "SELECT id FROM snapshots WHERE list_sort(paths) = ['/data/1', '/home']")
def snapshot_filter_exact_paths(spark, d):
    return snapshots.SnapshotFilter(exact_paths=("/home", "/data/1", "/home")).apply(A.snapshots(spark, d)).select("id")


@query(S + "SELECT id FROM snapshots WHERE (size > 200000 AND regexp_matches(hostname, '^host[12]$')) OR (label = '5-LOW' AND len(tags) = 2 AND delete_mode = 'never')")
def snapshot_filter_by_expression(spark, d):
    get = "try_variant_get(doc, '$.{}', '{}')".format
    big = f"{get('size', 'long')} > 200000 AND {get('hostname', 'string')} RLIKE '^host[12]$'"
    low = f"{get('label', 'string')} = '5-LOW' AND size({get('tags', 'array<string>')}) = 2 AND {get('delete_mode', 'string')} = 'never'"
    return snapshots.SnapshotFilter(where=f"({big}) OR ({low})").apply(A.snapshots(spark, d)).select("id")


RANKED = "row_number() OVER (PARTITION BY hostname, array_to_string(list_sort(coalesce(paths, [])), chr(1)) ORDER BY time DESC, id DESC) AS n"


@query(S + f"SELECT id, hostname FROM (SELECT *, {RANKED} FROM snapshots) WHERE n <= 3")
def latest_snapshots_of_host_and_paths(spark, d):
    return snapshots.latest(A.snapshots(spark, d), 3).select("id", "hostname")


@query(S + "SELECT id FROM snapshots ORDER BY time DESC, id DESC LIMIT 1 OFFSET 5")
def latest_but_five(spark, d):
    return snapshots.nth_latest(A.snapshots(spark, d), 5).select("id")


@query(S + "SELECT id FROM snapshots WHERE hostname = 'host7' ORDER BY time DESC, id DESC LIMIT 10")
def newest_of_filtered(spark, d):
    return snapshots.newest(A.snapshots(spark, d).filter("hostname = 'host7'"), 10).select("id")


@query(S + "SELECT id, CASE WHEN delete_mode = 'never' THEN 'keep' WHEN delete_mode = 'after' AND delete_after >= TIMESTAMP '1999-01-01' THEN 'keep' WHEN delete_mode = 'after' THEN 'delete' ELSE 'free' END AS protection FROM snapshots")
def delete_protection(spark, d):
    return A.snapshots(spark, d).select("id", snapshots.protection(datetime(1999, 1, 1)).alias("protection"))


def _rule(name, n, bucket):
    c = f"sum(CASE WHEN c_{name} THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING)"
    return name, bucket, f"CASE WHEN c_{name} AND ({n} < 0 OR {c} <= {n}) THEN '{name}' WHEN NOT c_{name} AND n = total AND ({n} < 0 OR {c} < {n}) THEN 'oldest {name}' END"


LOCAL = "(time + to_minutes(tz_offset_min))"
KEEP = {"last": 2, "day": 3, "week": 4, "month": 6, "year": -1}
RULES = [
    _rule("last", 2, "n"), _rule("day", 3, f"date_trunc('day', {LOCAL})"), _rule("week", 4, f"isoyear({LOCAL}) * 100 + weekofyear({LOCAL})"),
    _rule("month", 6, f"year({LOCAL}) * 100 + month({LOCAL})"), _rule("year", -1, f"year({LOCAL})"),
]


@query(
    S + f""", s AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY hostname) AS total FROM snapshots WINDOW w AS (PARTITION BY hostname ORDER BY time DESC, id DESC)),
k AS (SELECT *, {", ".join(f"{b} AS b_{x}" for x, b, _ in RULES)} FROM s),
c AS (SELECT *, {", ".join(f"coalesce(b_{x} <> lag(b_{x}) OVER w, true) AS c_{x}" for x, _, _ in RULES)} FROM k WINDOW w AS (PARTITION BY hostname ORDER BY time DESC, id DESC)),
r AS (SELECT id, hostname, [{", ".join(e for _, _, e in RULES)}] AS r, list_contains(tags, 'F') AND list_contains(tags, 't2') AS t FROM c WINDOW w AS (PARTITION BY hostname ORDER BY time DESC, id DESC)),
f AS (SELECT id, hostname, list_filter(r || [CASE WHEN t THEN 'tags F,t2' END], lambda x: x IS NOT NULL) AS r FROM r)
SELECT id, hostname, len(r) > 0 AS keep, array_to_string(r, '; ') AS reasons FROM f"""
)
def retention_policy(spark, d):
    return snapshots.retention(A.snapshots(spark, d), snapshots.Policy(keep=KEEP, tags=(("F", "t2"),)), datetime(2002, 1, 1))


@query(
    S + f""", top AS (SELECT hostname, max(time) FILTER (WHERE time < TIMESTAMP '2000-01-01') AS top FROM snapshots GROUP BY hostname),
c AS (SELECT s.*, top - INTERVAL 40 DAY AS start, coalesce(date_trunc('day', {LOCAL}) <> lag(date_trunc('day', {LOCAL})) OVER w, true) AS changed
      FROM snapshots s JOIN top USING (hostname) WINDOW w AS (PARTITION BY hostname ORDER BY time DESC, id DESC))
SELECT id, hostname, changed AND time > start AS keep, CASE WHEN changed AND time > start THEN 'within day' ELSE '' END AS reasons FROM c"""
)
def retention_within_duration(spark, d):
    return snapshots.retention(A.snapshots(spark, d), snapshots.Policy(within={"day": dates.Span(days=40)}), datetime(2000, 1, 1))


@query(S + "SELECT id, CASE WHEN NOT list_contains(tags, 'O') THEN epoch_us(time + INTERVAL 60 DAY)::BIGINT END AS keep_us, list_contains(tags, 'O') AS for_ever FROM snapshots")
def retention_horizon(spark, d):
    out = snapshots.horizons(A.snapshots(spark, d), snapshots.Policy(within={"day": dates.Span(days=40), "week": dates.Span(days=60)}, tags=(("O",),)))
    return out.select("id", F.unix_micros("keep_until").alias("keep_us"), "for_ever")


@query(S + "SELECT id, array_to_string(tags || list_filter(['new', 'O'], lambda t: NOT list_contains(tags, t)), ',') AS added, array_to_string(list_filter(tags, lambda t: t <> 't1'), ',') AS removed FROM snapshots")
def tag_changes(spark, d):
    return A.snapshots(spark, d).select("id", F.array_join(snapshots.add_tags(F.col("tags"), ["new", "O"]), ",").alias("added"), F.array_join(snapshots.remove_tags(F.col("tags"), ["t1"]), ",").alias("removed"))


@query(S + "SELECT id FROM snapshots WHERE NOT (id % 3 = 0 AND hostname <> 'host5')")
def snapshots_not_yet_copied(spark, d):
    s = A.snapshots(spark, d)
    copies = s.filter("id % 3 = 0").select(F.col("id").alias("original"), F.when(F.col("hostname") == "host5", "other").otherwise(F.col("hostname")).alias("hostname"), "time")
    return snapshots.not_yet_copied(s, copies, ["hostname", "time"]).select("id")


@query("SELECT prefix, count(sid)::BIGINT AS fits, CASE WHEN count(sid) = 1 THEN min(sid) END AS id FROM (VALUES ('1499'), ('77'), ('none'), ('15000')) p(prefix) LEFT JOIN (SELECT o_orderkey::VARCHAR AS sid FROM orders) ON starts_with(sid, prefix) GROUP BY prefix")
def id_by_prefix(spark, d):
    return snapshots.by_id_prefix(A.snapshots(spark, d), ["1499", "77", "none", "15000"])


def versions(spark, d):
    n = A.nodes(spark, d)
    return n.filter("snapshot = 'a'"), n.filter("snapshot = 'b'")


DIFF = """, x AS (SELECT path, a.size AS a_size, b.size AS b_size, CASE WHEN a.path IS NULL THEN '+' WHEN b.path IS NULL THEN '-' WHEN a.type <> b.type THEN 'T' WHEN a.content <> b.content THEN 'M' WHEN a.mode <> b.mode OR a.size <> b.size THEN 'U' END AS flag
FROM (FROM nodes WHERE snapshot = 'a') a FULL JOIN (FROM nodes WHERE snapshot = 'b') b USING (path))"""


@query(N + DIFF + " SELECT path, flag, coalesce(a_size, 0) AS old_size, coalesce(b_size, 0) AS new_size FROM x WHERE flag IS NOT NULL")
def snapshot_diff(spark, d):
    return trees.diff(*versions(spark, d))


@query(
    N + DIFF + """ SELECT count(*) FILTER (WHERE flag = '+')::BIGINT AS added, count(*) FILTER (WHERE flag = '-')::BIGINT AS removed, count(*) FILTER (WHERE flag = 'M')::BIGINT AS changed,
count(*) FILTER (WHERE flag = 'T')::BIGINT AS retyped, count(*) FILTER (WHERE flag = 'U')::BIGINT AS touched, coalesce(sum(b_size) FILTER (WHERE flag = '+'), 0)::BIGINT AS added_bytes,
coalesce(sum(a_size) FILTER (WHERE flag = '-'), 0)::BIGINT AS removed_bytes,
(SELECT count(DISTINCT content) FROM nodes WHERE snapshot = 'b' AND content NOT IN (SELECT content FROM nodes WHERE snapshot = 'a'))::BIGINT AS new_blobs,
(SELECT count(DISTINCT content) FROM nodes WHERE snapshot = 'a' AND content NOT IN (SELECT content FROM nodes WHERE snapshot = 'b'))::BIGINT AS old_blobs FROM x"""
)
def snapshot_diff_statistics(spark, d):
    return trees.diff_statistics(*versions(spark, d))


@query(
    N + """, v AS (SELECT path, type, size, snapshot FROM nodes UNION ALL SELECT regexp_replace(path, '/[^/]*$', ''), 'file', 1, 'c' FROM nodes WHERE inode % 50 = 2),
t AS (SELECT path, max_by(type, snapshot) AS type, max(snapshot) AS snapshot FROM v GROUP BY path)
SELECT path, type, snapshot AS time FROM t WHERE NOT EXISTS (FROM t f WHERE f.type <> 'dir' AND starts_with(t.path, f.path || '/'))"""
)
def tree_merge(spark, d):
    n = A.nodes(spark, d).select("path", "type", "size", F.col("snapshot").alias("time"), "inode")
    blockers = n.filter("inode % 50 = 2").select(F.regexp_replace("path", "/[^/]*$", "").alias("path"), F.lit("file").alias("type"), F.lit(1).cast("long").alias("size"), F.lit("c").alias("time")).distinct()
    return trees.merge(n.drop("inode").unionByName(blockers)).select("path", "type", "time")


@query(
    """WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS parent, n_name AS name, 'n' || n_nationkey AS child FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT 'n' || s_nationkey, s_name, 's' || s_suppkey FROM supplier),
w AS (SELECT 'r' || r_regionkey AS root, '' AS path, 'r' || r_regionkey AS key, 0 AS level FROM region UNION ALL SELECT root, path || '/' || name, child, level + 1 FROM w JOIN e ON parent = key)
SELECT root, path, key, level::INTEGER AS level FROM w"""
)
def tree_walk(spark, d):
    t = lambda n: A.table(spark, d, n)
    region = t("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("root"))
    one = t("nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.col("n_name").alias("name"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"))
    two = t("supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("parent"), F.col("s_name").alias("name"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("child"))
    return trees.walk(one.unionByName(two), region)


@query(N + "SELECT path, snapshot FROM nodes WHERE regexp_matches(path, '(^|/)p[0-9]*7(/.*)?$') OR regexp_matches(path, '^/blog[^/]*/en(/.*)?$')")
def find_by_pattern(spark, d):
    return trees.find(A.nodes(spark, d), ["p*7", "/blog*/en"]).select("path", "snapshot")


@query(N + "SELECT path, size FROM (SELECT *, row_number() OVER (ORDER BY size DESC, path DESC) AS n FROM nodes WHERE snapshot = 'a') WHERE n <= 40")
def listing_by_size(spark, d):
    return trees.listing(A.nodes(spark, d).filter("snapshot = 'a'"), "size", reverse=True).select("path", "size").limit(40)


@query(N + "SELECT path, snapshot FROM nodes WHERE path = '/blog.tionsh.example.net/en' OR starts_with(path, '/blog.tionsh.example.net/en/')")
def nodes_within_directory(spark, d):
    return A.nodes(spark, d).filter(paths.within(F.col("path"), "/blog.tionsh.example.net/en/")).select("path", "snapshot")


@query(N + "SELECT snapshot, count(*)::BIGINT AS files, sum(CASE WHEN n = 1 THEN size ELSE 0 END)::BIGINT AS bytes FROM (SELECT *, row_number() OVER (PARTITION BY snapshot, inode % 60, type ORDER BY path) AS n FROM nodes) GROUP BY snapshot")
def restore_size_with_hard_links(spark, d):
    return trees.restore_size(A.nodes(spark, d).withColumn("inode", F.col("inode") % 60))


@query(N + "SELECT count(*)::BIGINT AS files, sum(size)::BIGINT AS bytes FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY path, snapshot) AS n FROM nodes) WHERE n = 1")
def files_by_content(spark, d):
    return trees.files_by_content(A.nodes(spark, d))


@query(B + "SELECT count(*)::BIGINT AS blobs, sum(length)::BIGINT AS bytes FROM (SELECT pack_id, blob_id, min(length) AS length FROM blob_locations GROUP BY ALL)")
def blobs_per_file(spark, d):
    return trees.blobs_per_file(A.blob_locations(spark, d))


@query(
    B + """SELECT count(*)::BIGINT AS blobs, sum(s)::BIGINT AS stored_bytes, sum(p)::BIGINT AS plain_bytes, round(sum(p)::DOUBLE / sum(s), 9) AS ratio, round(100 * (1 - sum(s)::DOUBLE / sum(p)), 6) AS saving
FROM (SELECT blob_id, min(length) AS s, coalesce(min(CASE WHEN blob_id % 2 = 0 THEN length * 3 END), min(length)) AS p FROM blob_locations GROUP BY blob_id)"""
)
def raw_data_statistics(spark, d):
    return trees.raw_data(A.blob_locations(spark, d).withColumn("uncompressed", F.when(F.col("blob_id") % 2 == 0, F.col("length") * 3)))


@query(N + "SELECT CASE WHEN size > 3000 THEN -1 WHEN size = 0 THEN 0 ELSE length(size::VARCHAR) END::INTEGER AS bucket, count(*)::BIGINT AS files, sum(size)::BIGINT AS bytes FROM nodes GROUP BY 1")
def file_size_histogram(spark, d):
    return trees.size_histogram(A.nodes(spark, d), 3000)


ABOVE = "unnest(list_transform(range(2, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/')))"


@query(N + f"SELECT DISTINCT p AS path FROM (SELECT {ABOVE} AS p FROM nodes) WHERE p NOT IN (SELECT path FROM nodes)")
def missing_ancestors(spark, d):
    return trees.ancestors(A.nodes(spark, d))


@query(
    N + """, p AS (SELECT DISTINCT CASE WHEN inode % 9 = 0 THEN regexp_replace(path, '/[^/]*$', '') ELSE path END AS path FROM nodes)
SELECT path FROM p WHERE NOT EXISTS (FROM p q WHERE starts_with(p.path, q.path || '/'))"""
)
def collapsed_paths(spark, d):
    n = A.nodes(spark, d).select(F.when(F.col("inode") % 9 == 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.col("path")).alias("path"))
    return trees.collapse(n)


@query(N + "SELECT snapshot, count(*)::BIGINT AS files, sum(size)::BIGINT AS bytes FROM nodes WHERE NOT regexp_matches(path, '(^|/)de(/.*)?$') GROUP BY snapshot")
def tree_rewritten_without_patterns(spark, d):
    return trees.rewrite(A.nodes(spark, d), ["de"])


@query(
    """WITH c AS (SELECT l_orderkey::BIGINT AS file, l_linenumber::INTEGER AS ordinal, l_partkey::BIGINT AS blob_id, l_quantity::BIGINT AS length, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) AS n FROM lineitem),
u AS (SELECT file, ordinal, min(blob_id) AS blob_id, sum(length)::BIGINT AS length FROM c GROUP BY file, ordinal),
w AS (SELECT *, sum(length) OVER (PARTITION BY file ORDER BY ordinal) AS e FROM u)
SELECT file, ordinal, blob_id, greatest(0, 20 - (e - length))::BIGINT AS "from", least(length, 20 + 50 - (e - length))::BIGINT AS "to" FROM w WHERE e - length < 70 AND e > 20"""
)
def byte_range_of_files(spark, d):
    c = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("file"), F.col("l_linenumber").cast("int").alias("ordinal")).agg(
        F.min("l_partkey").cast("long").alias("blob_id"), F.sum(F.col("l_quantity").cast("long")).alias("length")
    )
    return trees.range_of_file(c, 20, 50)


CHUNKS = """WITH c AS (SELECT doc_id AS id, i::INTEGER AS ordinal, substr(text, i * 512 + 1, 512) AS chunk FROM documents, LATERAL (SELECT unnest(range(0, ceil(length(text) / 512.0)::BIGINT)) AS i)),
k AS (SELECT id, ordinal, sha256(chunk) AS blob_id, length(chunk)::BIGINT AS length FROM c)
"""


@query(CHUNKS + "SELECT * FROM k")
def fixed_size_chunks(spark, d):
    return trees.fixed_chunks(A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), 512)


@query(CHUNKS + "SELECT id, sha256(string_agg(blob_id, '' ORDER BY ordinal)) AS content_id, count(*)::BIGINT AS chunks FROM k GROUP BY id")
def content_identity(spark, d):
    return trees.content_id(trees.fixed_chunks(A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), 512))


V = """, v AS (SELECT 'u' || (user_id % 300) AS path, event_id::BIGINT AS commit, CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'live' END AS state, CASE WHEN event_type = 'error' THEN NULL ELSE (user_id % 2 + CASE WHEN event_type = 'signup' THEN 10 ELSE 0 END)::BIGINT END AS inode FROM events)
"""


def path_versions(spark, d):
    kind = F.col("event_type")
    return A.table(spark, d, "events").select(
        F.concat(F.lit("u"), (F.col("user_id") % 300).cast("string")).alias("path"), F.col("event_id").cast("long").alias("commit"), F.when(kind == "error", "deleted").otherwise("live").alias("state"),
        F.when(kind != "error", F.col("user_id") % 2 + F.when(kind == "signup", 10).otherwise(0)).cast("long").alias("inode"),
    )


W = "WITH e AS (SELECT 1)" + V


@query(W + "SELECT path, arg_max(commit, commit) AS commit, arg_max(state, commit) AS state, arg_max_null(inode, commit) AS inode FROM v WHERE commit <= 5000 GROUP BY path")
def binding_as_of_commit(spark, d):
    return history.as_of(path_versions(spark, d), 5000)


CH = "x AS (SELECT *, lag(commit) OVER w IS NULL AS first, lag(state) OVER w AS p_state, lag(inode) OVER w AS p_inode FROM v WINDOW w AS (PARTITION BY path ORDER BY commit))"


@query(W + ", " + CH + " SELECT path, commit, state, inode FROM x WHERE first OR state IS DISTINCT FROM p_state OR inode IS DISTINCT FROM p_inode")
def binding_changes(spark, d):
    return history.binding_changes(path_versions(spark, d), ["state", "inode"])


@query(
    W + ", " + CH + """, y AS (SELECT *, sum(CASE WHEN first OR state IS DISTINCT FROM p_state OR inode IS DISTINCT FROM p_inode THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY commit) AS island,
CASE WHEN first OR (p_state = 'deleted' AND state <> 'deleted') THEN 'created' WHEN state = 'deleted' THEN 'deleted' WHEN inode IS DISTINCT FROM p_inode THEN 'rebound' ELSE 'modified' END AS kind FROM x)
SELECT path, island::BIGINT AS island, min(commit) AS first_commit, max(commit) AS last_commit, count(*)::BIGINT AS commits, arg_min(kind, commit) AS kind FROM y GROUP BY path, island"""
)
def coalesced_changes(spark, d):
    return history.coalesced(path_versions(spark, d), ["state", "inode"])


@query("SELECT (user_id % 50)::BIGINT AS inode, event_id::BIGINT AS revision, lag(event_id) OVER w IS NULL OR event_type <> lag(event_type) OVER w AS content_changed, coalesce(event_type = lag(event_type) OVER w, false) AS metadata_only FROM events WINDOW w AS (PARTITION BY user_id % 50 ORDER BY event_id)")
def content_or_metadata_changed(spark, d):
    e = A.table(spark, d, "events").select((F.col("user_id") % 50).cast("long").alias("inode"), F.col("event_id").cast("long").alias("revision"), F.col("event_type").alias("content"))
    return history.content_flags(e)


@query(W + "SELECT path, commit FROM v WHERE commit >= 100 AND commit < 2000")
def commit_range(spark, d):
    return history.commit_range(path_versions(spark, d), 100, 2000).select("path", "commit")


ALL_EDGES = """edges AS (SELECT DISTINCT 's' || l_suppkey AS parent, 'p' || l_partkey AS child FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem)"""


def edge_rows(spark, d):
    """The edges, some of them more than once."""
    l = A.table(spark, d, "lineitem")  # noqa: E741
    s, p = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    return l.select(s.alias("parent"), p.alias("child")).union(l.select(p, s))


def all_edges(spark, d):
    return edge_rows(spark, d).distinct()


@query(A.with_sql(ALL_EDGES) + ", r(key) AS (SELECT 's10' AS key UNION SELECT child FROM r JOIN edges ON parent = key) SELECT key FROM r")
def reachable_from_roots(spark, d):
    return reach.closure(edge_rows(spark, d), spark.createDataFrame([("s10",)], "key string"))


@query(A.with_sql(ALL_EDGES) + ", t AS (SELECT parent AS key FROM edges UNION SELECT 's' || s_suppkey FROM supplier) SELECT key FROM t WHERE key NOT IN (SELECT child FROM edges)")
def orphan_tree_roots(spark, d):
    e = all_edges(spark, d)
    t = e.select(F.col("parent").alias("key")).union(A.table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")))).distinct()
    return reach.orphan_roots(t, e)


@query(A.with_sql(ALL_EDGES) + ", r(key) AS (SELECT 's10' AS key UNION SELECT child FROM r JOIN edges ON parent = key) SELECT key FROM r")
def reachable_from_roots_all_edges(spark, d):
    return reach.closure(edge_rows(spark, d), spark.createDataFrame([("s10",)], "key string"))


@query(A.with_sql(ALL_EDGES) + ", t AS (SELECT parent AS key FROM edges UNION SELECT 's' || s_suppkey FROM supplier) SELECT key FROM t WHERE key NOT IN (SELECT child FROM edges)")
def orphan_tree_roots_all_edges(spark, d):
    e = all_edges(spark, d)
    t = e.select(F.col("parent").alias("key")).union(A.table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")))).distinct()
    return reach.orphan_roots(t, e)


def parts(spark, d):
    return A.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("blob_id"))


@query(B + "SELECT p_partkey::BIGINT AS blob_id FROM part WHERE p_partkey NOT IN (SELECT blob_id FROM blob_locations WHERE length > 50000)")
def unreferenced_blobs(spark, d):
    return reach.unreferenced(parts(spark, d), A.blob_locations(spark, d).filter("length > 50000"))


@query(B + "SELECT blob_id, pack_id, type, length, ordinal FROM blob_locations WHERE blob_id NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0)")
def dangling_references(spark, d):
    return reach.dangling(A.blob_locations(spark, d), parts(spark, d).filter("blob_id % 10 <> 0"))


@query(B + "SELECT blob_id, pack_id, type, length, ordinal FROM blob_locations WHERE blob_id % 3 <> 0 AND (type = 'tree' OR blob_id % 5 <> 0)")
def collectable_blobs(spark, d):
    b = A.blob_locations(spark, d)
    return reach.collectable(b, parts(spark, d).filter("blob_id % 3 = 0"), parts(spark, d).filter("blob_id % 5 = 0"))


PB = A.with_sql(A.PACKS, A.BLOBS)


@query(
    PB + """, g AS (SELECT pack_id, sum(CASE WHEN blob_id % 4 = 0 THEN 0 ELSE length END)::BIGINT AS u, sum(length)::BIGINT AS t FROM blob_locations WHERE blob_id % 200 <> 0 GROUP BY pack_id)
SELECT pack_id, coalesce(t = payload_size, false) AS accounted, CASE WHEN t = payload_size THEN u END AS used_bytes, CASE WHEN t = payload_size THEN t - u END AS unused_bytes FROM packs LEFT JOIN g USING (pack_id)"""
)
def pack_usage_by_reachability(spark, d):
    b = A.blob_locations(spark, d).filter("blob_id % 200 <> 0")
    return reach.pack_usage(A.packs(spark, d), b, parts(spark, d).filter("blob_id % 4 = 0"))


ACCOUNTS = """
acc AS (SELECT pack_id, """ + ", ".join(f"count(*) FILTER (WHERE state = '{s}')::BIGINT AS {s}_blobs, coalesce(sum(length) FILTER (WHERE state = '{s}'), 0)::BIGINT AS {s}_bytes" for s in ("used", "duplicate", "unused")) + """
  FROM (SELECT pack_id, length, CASE WHEN blob_id % 3 = 0 THEN 'unused' WHEN row_number() OVER (PARTITION BY blob_id ORDER BY pack_id, ordinal, length) = 1 THEN 'used' ELSE 'duplicate' END AS state FROM members) GROUP BY pack_id),
plan AS (SELECT *, unused_bytes + duplicate_bytes AS waste, CASE WHEN used_bytes = 0 THEN 'remove' WHEN unused_bytes + duplicate_bytes > 0 OR used_bytes < 100000 THEN 'repack' ELSE 'keep' END AS plan FROM acc)"""
ALL_MEMBERS = "members AS (SELECT blob_id, pack_id, min(ordinal) AS ordinal, min(length) AS length FROM blob_locations GROUP BY blob_id, pack_id)"
ALL_AP = A.with_sql(A.PACKS, A.BLOBS, ALL_MEMBERS, ACCOUNTS)


def accounts(spark, d):
    m = A.blob_locations(spark, d).groupBy("blob_id", "pack_id").agg(F.min("ordinal").alias("ordinal"), F.min("length").alias("length"))
    return reach.prune_accounts(m, parts(spark, d).filter("blob_id % 3 <> 0").union(spark.createDataFrame([(0,)], "blob_id long").filter("false")))


@query(ALL_AP + "SELECT * FROM acc")
def prune_accounts(spark, d):
    return accounts(spark, d)


@query(ALL_AP + "SELECT pack_id, waste, plan FROM plan")
def prune_classification(spark, d):
    return reach.classify_packs(accounts(spark, d), 100_000).select("pack_id", "waste", "plan")


@query(ALL_AP + "SELECT * FROM acc")
def prune_accounts_all_blobs(spark, d):
    return accounts(spark, d)


@query(ALL_AP + "SELECT pack_id, waste, plan FROM plan")
def prune_classification_all_blobs(spark, d):
    return reach.classify_packs(accounts(spark, d), 100_000).select("pack_id", "waste", "plan")


@query(A.with_sql(A.PACKS) + "SELECT (greatest(physical_size, 4096) * 4 // 5)::BIGINT AS target FROM (SELECT physical_size, row_number() OVER (ORDER BY physical_size) AS n, count(*) OVER () AS total FROM packs) WHERE n = total * 3 // 100 + 1")
def percentile_pack_size(spark, d):
    return reach.percentile_size(A.packs(spark, d), 3, 4096, 4, 5)


@query()
def budgeted_repack_selection(spark, d):
    c = reach.classify_packs(accounts(spark, d), 100_000).join(A.packs(spark, d).select("pack_id", "type"), "pack_id")
    return reach.budgeted(reach.candidate_order(c, 50_000), 5_000_000, 1_000_000)


@query("SELECT l_partkey::BIGINT AS blob_id, count(*)::BIGINT AS \"references\", count(DISTINCT l_linenumber)::BIGINT AS revisions, count(DISTINCT l_orderkey)::BIGINT AS inodes FROM lineitem GROUP BY 1")
def reference_counters(spark, d):
    return reach.reference_counts(A.table(spark, d, "lineitem").select(F.col("l_partkey").cast("long").alias("blob_id"), F.col("l_orderkey").alias("inode"), F.col("l_linenumber").alias("revision")))


IDX = "s AS (SELECT pack_id, count(*)::BIGINT AS blobs, sum(length)::BIGINT AS bytes FROM blob_locations GROUP BY pack_id)"


def summaries(spark, d):
    return A.blob_locations(spark, d).groupBy("pack_id").agg(F.count("*").cast("long").alias("blobs"), F.sum("length").cast("long").alias("bytes"))


@query(A.with_sql(A.BLOBS, IDX) + "SELECT CASE WHEN blobs % 7 = 0 THEN 'missing' WHEN bytes % 5 = 0 THEN 'unexpected' ELSE 'different' END AS kind, pack_id FROM s WHERE blobs % 7 = 0 OR bytes % 5 = 0 OR bytes % 11 = 0")
def compare_expected_with_stored(spark, d):
    s = summaries(spark, d)
    right = s.filter("blobs % 7 <> 0").withColumn("bytes", F.col("bytes") + F.when(F.col("bytes") % 11 == 0, 1).otherwise(0))
    left = s.filter("bytes % 5 <> 0 OR blobs % 7 = 0")
    return checks.compare(left, right, ["pack_id"], ["blobs", "bytes"])


@query("SELECT l_partkey::BIGINT AS blob_id, 'missing' AS kind FROM lineitem WHERE l_partkey % 6 = 0 UNION ALL SELECT l_partkey::BIGINT, 'unexpected' FROM lineitem WHERE l_partkey % 7 = 0 AND l_partkey % 6 <> 0")
def multiset_difference_both_ways(spark, d):
    b = A.table(spark, d, "lineitem").select(F.col("l_partkey").cast("long").alias("blob_id"))
    left = b.filter("blob_id % 7 <> 0 OR blob_id % 6 = 0")
    return checks.except_both_ways(left, b.filter("blob_id % 6 <> 0"))


@query(
    A.with_sql(A.BLOBS, IDX) + """SELECT pack_id, CASE WHEN k % 10 = 1 THEN 'not in catalog' WHEN k % 10 = 2 THEN 'missing in old' WHEN k % 10 = 3 THEN 'missing in new' WHEN k % 10 = 4 THEN 'summaries differ' WHEN k % 10 = 5 THEN 'catalog differs' END AS kind
FROM (SELECT pack_id, pack_id::BIGINT AS k FROM s) WHERE k % 10 BETWEEN 1 AND 5"""
)
def three_way_catalog_check(spark, d):
    s, k = summaries(spark, d), F.col("pack_id").cast("long") % 10
    bump = lambda df, n: df.withColumn("bytes", F.col("bytes") + F.when(k == n, 1).otherwise(0))
    return checks.three_way(bump(s.filter(k != 1), 5), bump(s.filter(k != 2), 4), s.filter(k != 3))


@query(B + "SELECT pack_id, blob_id FROM blob_locations WHERE blob_id % 10 = 0 ORDER BY pack_id, blob_id LIMIT 100")
def first_findings(spark, d):
    return checks.findings(reach.dangling(A.blob_locations(spark, d), parts(spark, d).filter("blob_id % 10 <> 0")), ["pack_id", "blob_id"], 100).select("pack_id", "blob_id")


@query("SELECT o_orderkey, sha256('42:' || o_orderkey) AS score FROM orders ORDER BY 2 LIMIT 64")
def seeded_sample(spark, d):
    return checks.sample(A.table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 42, 64)


@query()
def random_share_of_packs(spark, d):
    return checks.random_share(A.packs(spark, d).select("pack_id"), 2.5, 7)


@query("""SELECT l_partkey::BIGINT AS blob_id, count(*) FILTER (WHERE l_returnflag = 'N')::BIGINT AS counted, count(*) FILTER (WHERE l_returnflag <> 'N')::BIGINT AS others, (count(*) FILTER (WHERE l_returnflag = 'N') + 1)::BIGINT AS stored
FROM lineitem WHERE l_partkey % 9 = 0 GROUP BY 1""")
def reference_count_check(spark, d):
    e = A.table(spark, d, "lineitem").select(F.col("l_partkey").cast("long").alias("blob_id"), F.when(F.col("l_returnflag") == "N", "content").otherwise("tree").alias("kind"))
    stored = e.groupBy("blob_id").agg((F.count_if(F.col("kind") == "content") + F.when(F.col("blob_id") % 9 == 0, 1).otherwise(0)).cast("long").alias("references"))
    return checks.reduce_references(e, stored)


@query(
    A.with_sql(A.PACKS, A.PLACEMENTS) + """SELECT pack_id, backend, physical_size FROM packs JOIN placements USING (pack_id) WHERE type IN ('data', 'mixed') AND state = 'live' AND (backend % 3 <> 0 OR placed_at < TIMESTAMP '1998-01-01')"""
)
def verification_candidates(spark, d):
    p = A.placements(spark, d)
    done = p.filter("backend % 3 = 0").select("pack_id", "backend", F.col("placed_at").alias("verified_at"))
    return checks.candidates(A.packs(spark, d), p, done, ["data", "mixed"], datetime(1998, 1, 1)).select("pack_id", "backend", "physical_size")


@query(
    """WITH e AS (SELECT DISTINCT (o_custkey % 500)::BIGINT AS index_id, (o_orderkey % 4000)::BIGINT AS pack_id FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY pack_id ORDER BY index_id) = 1 AS fresh FROM e),
g AS (SELECT index_id, count(*)::BIGINT AS packs, count(*) FILTER (WHERE fresh)::BIGINT AS fresh FROM f GROUP BY index_id)
SELECT index_id, packs, fresh, CASE WHEN packs = fresh THEN 'keep' WHEN fresh = 0 THEN 'drop' ELSE 'rewrite' END AS action FROM g"""
)
def index_rewrite(spark, d):
    return checks.rewrite_index(A.table(spark, d, "orders").select((F.col("o_custkey") % 500).cast("long").alias("index_id"), (F.col("o_orderkey") % 4000).cast("long").alias("pack_id")))


SAMPLES = "samples AS (SELECT 'm' || (user_id % 20) AS series, 'proc' || (event_id // 2500) AS process, ts::TIMESTAMP AS ts, event_id::BIGINT AS seq, (event_id * 3 - CASE WHEN event_id % 97 = 0 THEN 500 ELSE 0 END)::BIGINT AS value FROM events)"


def samples(spark, d):
    i = F.col("event_id").cast("long")
    return A.table(spark, d, "events").select(
        F.concat(F.lit("m"), (F.col("user_id") % 20).cast("string")).alias("series"), F.concat(F.lit("proc"), F.floor(i / 2500).cast("string")).alias("process"), F.col("ts").cast("timestamp").alias("ts"),
        i.alias("seq"), (i * 3 - F.when(i % 97 == 0, 500).otherwise(0)).alias("value"),
    )


DELTAS = """d AS (SELECT series, seq, value, lag(value) OVER w AS b, coalesce(lag(process) OVER w <> process OR lag(value) OVER w > value, false) AS reset FROM samples WINDOW w AS (PARTITION BY series ORDER BY ts, seq))"""


@query(A.with_sql(SAMPLES, DELTAS) + "SELECT series, seq, value, CASE WHEN NOT reset THEN value - b END AS delta, reset FROM d")
def counter_deltas_with_reset(spark, d):
    return metrics.counter_deltas(samples(spark, d))


@query(
    A.with_sql(SAMPLES) + """, s AS (SELECT *, floor(epoch(ts))::BIGINT AS t FROM samples), r AS (SELECT *,
max({'t': t, 'seq': seq, 'value': value}) OVER (PARTITION BY series ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 86400 PRECEDING) AS o, min({'t': t, 'seq': seq, 'value': value}) OVER (PARTITION BY series ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS i FROM s)
SELECT series, seq, CASE WHEN o IS NULL THEN 'warming' WHEN coalesce(o, i).value > value THEN 'reset' ELSE 'ready' END AS state, value - coalesce(o, i).value AS change, t - coalesce(o, i).t AS seconds FROM r"""
)
def sliding_window_rates(spark, d):
    return metrics.window_baseline(samples(spark, d), 86_400)


SLOTS = "slots AS (SELECT date_trunc('day', ts)::TIMESTAMP AS slot, type, count(*)::BIGINT AS n, max(physical_size) AS most, sum(physical_size)::BIGINT AS total FROM pack_events GROUP BY ALL)"


@query(A.with_sql(A.EVENTS, SLOTS) + "SELECT epoch_us(slot)::BIGINT AS slot_us, type, sum(n) OVER w::BIGINT AS n, sum(total) OVER w::BIGINT AS total FROM slots WINDOW w AS (PARTITION BY type ORDER BY slot ROWS 4 PRECEDING)")
def trailing_slots(spark, d):
    out = metrics.trailing(metrics.slots(A.pack_events(spark, d), "day"), 5)
    return out.select(F.unix_micros("slot").alias("slot_us"), "type", "n", "total")


@query(
    A.with_sql(A.EVENTS) + """, b AS (SELECT type AS series, pow(2, ceil(log2(greatest(physical_size, 1)::DOUBLE)))::BIGINT AS bound, count(*) AS n FROM pack_events GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY series ORDER BY bound) AS cum, sum(n) OVER (PARTITION BY series) AS total FROM b)
SELECT series, min(bound) AS value, max(total)::BIGINT AS samples FROM c WHERE cum >= ceil(total * 95 / 100.0) GROUP BY series"""
)
def histogram_percentile(spark, d):
    return metrics.percentile(metrics.latency_buckets(A.pack_events(spark, d)), 95)


@query(A.with_sql(A.EVENTS) + "SELECT type, count(*)::BIGINT AS operations, (epoch(TIMESTAMP '2024-02-01')::BIGINT - floor(epoch(min(ts)))::BIGINT) AS oldest_s FROM pack_events GROUP BY type")
def operations_by_class(spark, d):
    return metrics.by_class(A.pack_events(spark, d), datetime(2024, 2, 1))


@query("SELECT event_id, 'requests' || '.kind=' || event_type || '.user=' || (user_id % 9) AS identity FROM events")
def metric_identity(spark, d):
    labels = F.create_map(F.lit("user"), (F.col("user_id") % 9).cast("string"), F.lit("kind"), F.col("event_type"))
    return A.table(spark, d, "events").select("event_id", metrics.identity(F.lit("requests"), labels).alias("identity"))


@query(
    A.with_sql(SAMPLES, DELTAS) + """SELECT 'counter,deployment=a\\ b,series=' || series || ' value=' || value || 'i' || CASE WHEN NOT reset AND b IS NOT NULL THEN ',delta=' || (value - b) || 'i' ELSE '' END || ',reset=' || reset || ' ' || seq AS value FROM d"""
)
def metric_lines(spark, d):
    return metrics.influx_lines(samples(spark, d), "a b")


@query("SELECT n_name AS name FROM nation WHERE n_nationkey % 2 = 0 INTERSECT SELECT n_name FROM nation WHERE n_nationkey % 3 = 0")
def set_intersection(spark, d):
    n = A.table(spark, d, "nation")
    return n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("name")).intersect(n.filter("n_nationkey % 3 = 0").select("n_name"))


@query("SELECT l_partkey FROM lineitem WHERE l_linenumber = 1 UNION SELECT l_partkey FROM lineitem WHERE l_linenumber = 2 EXCEPT SELECT l_partkey FROM lineitem WHERE l_linenumber = 3")
def set_union_and_difference(spark, d):
    p = lambda n: A.table(spark, d, "lineitem").filter(f"l_linenumber = {n}").select("l_partkey")
    return p(1).union(p(2)).distinct().subtract(p(3))


@query("SELECT l_partkey, l_orderkey FROM lineitem WHERE l_linenumber <= 2 UNION ALL SELECT l_partkey, l_orderkey FROM lineitem WHERE l_linenumber = 2")
def multiset_union(spark, d):
    p = lambda c: A.table(spark, d, "lineitem").filter(c).select("l_partkey", "l_orderkey")
    return p("l_linenumber <= 2").union(p("l_linenumber = 2"))
