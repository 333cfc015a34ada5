"""Observed identities, subtrees, mappings, listings, restore order, placement class and erasure."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from cairn import adapters as A
from cairn.functions import numbers, paths
from cairn.operators import objects, observed, trees
from cairn.registry import query

N, B = A.with_sql(A.NODES), A.with_sql(A.BLOBS)
NOW = datetime(1998, 1, 1)

BIND = """
bindings AS (SELECT (o_orderkey % 2 + 1)::INTEGER AS fsid, (o_orderkey // 2)::BIGINT AS inode, (o_orderkey % 3)::BIGINT AS generation, (o_custkey % 5)::INTEGER AS source,
  CASE o_orderstatus WHEN 'O' THEN 'live' WHEN 'F' THEN 'deleted' ELSE 'unknown' END AS state, (o_custkey % 7)::BIGINT AS commit, 'source-generation' AS continuity FROM orders)"""


def bindings(spark, d):
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    return A.table(spark, d, "orders").select(
        (key % 2 + 1).cast("int").alias("fsid"), F.floor(key / 2).cast("long").alias("inode"), (key % 3).cast("long").alias("generation"), (F.col("o_custkey") % 5).cast("int").alias("source"),
        F.when(status == "O", "live").when(status == "F", "deleted").otherwise("unknown").alias("state"), (F.col("o_custkey") % 7).cast("long").alias("commit"), F.lit("source-generation").alias("continuity"),
    )


@query(
    A.with_sql(BIND) + """, refs AS (SELECT (l_orderkey % 2 + 1)::INTEGER AS fsid, (l_orderkey // 2)::BIGINT AS inode, (l_orderkey % 3)::BIGINT AS generation, count(*)::BIGINT AS refs FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2, 3)
SELECT fsid, inode, generation, CASE WHEN state = 'deleted' THEN CASE WHEN refs > 0 THEN 'archive-only' ELSE 'expired' END ELSE state END AS residency,
  CASE WHEN state = 'deleted' THEN coalesce(refs, 0) ELSE 0 END AS retained_refs, CASE WHEN state = 'deleted' THEN 1000 + source * 10 + commit END AS last_complete_crawl FROM bindings LEFT JOIN refs USING (fsid, inode, generation)"""
)
def residency_of_bindings(spark, d):
    c = F.col("id")
    proofs = spark.range(35).select(
        F.floor(c / 7).cast("int").alias("source"), (c % 7).alias("commit"), F.lit(True).alias("complete"), F.lit(True).alias("debt_free"), (1000 + F.floor(c / 7) * 10 + c % 7).cast("long").alias("completed_at")
    )
    k = F.col("l_orderkey")
    refs = A.table(spark, d, "lineitem").filter("l_returnflag = 'R'").select((k % 2 + 1).cast("int").alias("fsid"), F.floor(k / 2).cast("long").alias("inode"), (k % 3).cast("long").alias("generation"), F.lit(1).alias("refs"))
    return observed.binding_residency(bindings(spark, d), proofs, refs)


@query(
    A.with_sql(BIND) + """SELECT fsid, inode, generation, CASE WHEN commit <= 4 THEN 'deleted' ELSE 'unknown' END AS state,
  CASE WHEN commit > 4 THEN 'unknown' WHEN state = 'live' AND NOT EXISTS (SELECT 1 FROM bindings u WHERE u.state = 'unknown' AND u.fsid = b.fsid AND u.inode = b.inode) THEN 'proven' ELSE continuity END AS continuity
FROM bindings b WHERE state <> 'deleted' AND inode % 3 <> 0"""
)
def identities_missing_after_crawl(spark, d):
    b = bindings(spark, d)
    return observed.missing_identities(b, b.filter("inode % 3 = 0"), True, True, 4)


SAME = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in ("size", "content", "mode"))


@query(
    N + f""", a AS (SELECT * FROM nodes WHERE snapshot = 'b'), b AS (SELECT * FROM nodes WHERE snapshot = 'a')
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'gone' WHEN a.inode % 4 <> 0 AND {SAME} THEN 'reuse' ELSE 'read' END AS decision FROM a FULL JOIN b ON a.path = b.path"""
)
def stored_files_used_again(spark, d):
    n = A.nodes(spark, d)
    for c in ("mtime", "ctime", "uid", "gid", "parent"):
        n = n.withColumn(c, F.lit(None).cast("long"))
    return observed.reuse_decisions(n.filter("snapshot = 'b'"), n.filter("snapshot = 'a'"), F.col("inode") % 4 != 0)


@query(
    N + f""", a AS (SELECT * FROM nodes WHERE snapshot = 'b'), b AS (SELECT * FROM nodes WHERE snapshot = 'a')
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'gone' WHEN a.size % 4 <> 0 AND {SAME} THEN 'reuse' ELSE 'read' END AS decision FROM a FULL JOIN b ON a.path = b.path"""
)
def captured_crawl_replayed(spark, d):
    """A crawl captured with the stats of nodes and parents, written, read back and replayed against what is stored."""
    n = A.nodes(spark, d).withColumn("parent", F.regexp_replace("path", "/[^/]*$", ""))
    for c in ("mtime", "ctime", "uid", "gid"):
        n = n.withColumn(c, F.lit(None).cast("long"))
    crawl, known = n.filter("snapshot = 'b'"), n.filter("snapshot = 'a'")
    folders = crawl.select("parent").distinct().select(F.col("parent").alias("path"), *(F.lit(None).cast("long").alias(c) for c in observed.STAT))
    observations, errors = observed.capture(crawl, crawl.select("path", *observed.STAT).unionByName(folders))
    if not errors.isEmpty():
        raise AssertionError("nodes without a stat")
    at = A.folder(spark)
    observations.write.parquet(at)
    root = known.select("parent").first()["parent"]
    return observed.replay(spark.read.parquet(at), root, known, F.col("size") % 4 != 0)


@query(
    A.with_sql(BIND) + """, last AS (SELECT fsid, inode, arg_max(state, generation) AS state, max(generation) AS g FROM bindings GROUP BY 1, 2),
seen AS (SELECT (l_orderkey % 2 + 1)::INTEGER AS fsid, (l_orderkey // 2 + l_linenumber % 2 * 7)::BIGINT AS inode, max(l_orderkey)::BIGINT + 10 AS revision FROM lineitem GROUP BY 1, 2)
SELECT fsid, inode, CASE WHEN state = 'live' THEN g ELSE revision END AS generation, CASE WHEN state = 'live' THEN 'source-generation' WHEN state = 'deleted' THEN 'proven' ELSE 'unknown' END AS continuity,
  state IS DISTINCT FROM 'live' AS is_new FROM seen LEFT JOIN last USING (fsid, inode)"""
)
def generations_of_observed_inodes(spark, d):
    k = F.col("l_orderkey")
    inode = (F.floor(k / 2) + F.col("l_linenumber") % 2 * 7).cast("long")
    seen = A.table(spark, d, "lineitem").groupBy((k % 2 + 1).cast("int").alias("fsid"), inode.alias("inode")).agg((F.max("l_orderkey").cast("long") + 10).alias("revision"))
    return observed.observed_generations(seen, bindings(spark, d))


@query(
    """WITH c AS (SELECT n_regionkey, n_nationkey, c_custkey, 'c' || lpad(c_custkey::VARCHAR, 9, '0') AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),
e AS (SELECT n_nationkey, min(name) FILTER (WHERE c_custkey % 40 = 0) AS stop FROM c GROUP BY 1)
SELECT '/r' || r_regionkey AS path, 'dir' AS type, 1 AS level FROM region
UNION ALL SELECT '/r' || n_regionkey || '/n' || n_nationkey, 'dir', 2 FROM nation WHERE n_regionkey <> 2
UNION ALL SELECT '/r' || n_regionkey || '/n' || n_nationkey || '/' || name, 'file', 3 FROM c JOIN e USING (n_nationkey) WHERE n_regionkey <> 2 AND n_nationkey % 4 <> 1 AND (stop IS NULL OR name <= stop)"""
)
def tree_visited_with_skips(spark, d):
    """Regions, nations and customers as a tree; a region and some nations aren't entered, some customers end their nation."""
    text = lambda c: F.col(c).cast("string")
    r = A.table(spark, d, "region").select(F.lit("top").alias("parent"), F.concat(F.lit("r"), text("r_regionkey")).alias("name"), F.lit("dir").alias("type"))
    n = A.table(spark, d, "nation").select(F.concat(F.lit("r"), text("n_regionkey")).alias("parent"), F.concat(F.lit("n"), text("n_nationkey")).alias("name"), F.lit("dir").alias("type"))
    c = A.table(spark, d, "customer").select(F.concat(F.lit("n"), text("c_nationkey")).alias("parent"), F.concat(F.lit("c"), F.lpad(text("c_custkey"), 9, "0")).alias("name"), F.lit("file").alias("type"))
    edges = r.union(n).union(c).withColumn("child", F.col("name"))
    number = F.regexp_extract("name", "[0-9]+", 0).cast("long")
    skip = (F.col("name") == "r2") | (F.col("name").startswith("n") & (number % 4 == 1)) | (F.col("name").startswith("c") & (number % 40 == 0))
    out = trees.visit(edges, spark.range(1).select(F.lit("top").alias("root")), skip)
    return out.filter("level > 0").select("path", "type", "level")


@query(
    N + """, dirs AS (SELECT path, regexp_replace(rtrim(path, '/'), '/+', '/', 'g') AS c FROM (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS path FROM nodes)),
changed AS (SELECT regexp_replace(rtrim(path, '/'), '/+', '/', 'g') AS x FROM (SELECT path FROM nodes WHERE inode % 23 = 0 UNION SELECT regexp_replace(path, '/[^/]*$', '') FROM nodes WHERE inode % 29 = 0))
SELECT path FROM dirs WHERE NOT EXISTS (SELECT 1 FROM changed WHERE x = c OR starts_with(c, x || '/') OR starts_with(x, c || '/'))"""
)
def subtrees_without_changes(spark, d):
    n, parent = A.nodes(spark, d), F.regexp_replace("path", "/[^/]*$", "").alias("path")
    changed = n.filter("inode % 23 = 0").select("path").union(n.filter("inode % 29 = 0").select(parent))
    return observed.reusable_subtrees(n.select(parent).distinct(), changed)


@query("SELECT s_name AS target, 'svm' || s_suppkey AS svm, '/vol/' || s_nationkey AS remote_path FROM supplier")
def mapping_of_each_target(spark, d):
    s = A.table(spark, d, "supplier")
    full = s.select(F.col("s_name").alias("target"), F.concat(F.lit("svm"), F.col("s_suppkey").cast("string")).alias("svm"), F.concat(F.lit("/vol/"), F.col("s_nationkey").cast("string")).alias("remote_path"))
    partial = full.withColumn("svm", F.lit("")).filter(F.length("target") % 2 == 0)
    return observed.match_mappings(s.select(F.col("s_name").alias("target")), full.union(partial), ["svm", "remote_path"])


@query(
    N + """, marked AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM nodes WHERE type = 'file' AND regexp_matches(path, '/p7$'))
SELECT path, snapshot FROM nodes n WHERE NOT (type = 'file' AND size > 3000) AND mode IN (0, 1, 9) AND inode NOT IN (SELECT page_id FROM pages WHERE page_id % 10 = 3)
AND NOT EXISTS (SELECT 1 FROM marked WHERE starts_with(n.path, folder || '/') AND NOT (regexp_matches(n.path, '/p7$') AND regexp_replace(n.path, '/[^/]*$', '') = folder))"""
)
def nodes_not_rejected(spark, d):
    n = A.nodes(spark, d).withColumn("device", F.col("mode")).withColumn("uid", F.col("inode"))
    owners = A.table(spark, d, "pages").filter("page_id % 10 = 3").select(F.col("page_id").cast("long").alias("uid"))
    return observed.reject_nodes(n, 3000, [0, 1, 9], "p7", owners).select("path", "snapshot")


@query(
    A.with_sql(A.PACKS, A.PLACEMENTS) + """, held AS (SELECT DISTINCT pack_id FROM placements WHERE state = 'live' UNION SELECT 'x' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)
SELECT pack_id, 'missing' AS kind FROM (SELECT pack_id FROM packs EXCEPT SELECT pack_id FROM held) UNION ALL SELECT pack_id, 'unknown' FROM (SELECT pack_id FROM held EXCEPT SELECT pack_id FROM packs)"""
)
def catalog_against_listing(spark, d):
    strange = A.table(spark, d, "supplier").filter("s_suppkey % 3 = 0").select(F.concat(F.lit("x"), F.col("s_suppkey").cast("string")).alias("pack_id"))
    return objects.against_listing(A.packs(spark, d), A.placements(spark, d).filter("state = 'live'").select("pack_id").union(strange))


@query(
    N + """, hot AS (SELECT * FROM nodes WHERE snapshot = 'a'), cold AS (SELECT * FROM nodes WHERE snapshot = 'b')
SELECT name, kind FROM (SELECT coalesce(hot.path, cold.path) AS name, CASE WHEN cold.path IS NULL THEN 'missing in cold' WHEN hot.path IS NULL THEN 'missing in hot' WHEN hot.size <> cold.size THEN 'size differs' WHEN hot.content <> cold.content THEN 'content differs' END AS kind
FROM hot FULL JOIN cold ON hot.path = cold.path) WHERE kind IS NOT NULL"""
)
def mirrors_compared(spark, d):
    n = A.nodes(spark, d).withColumnRenamed("path", "name")
    return objects.compare_mirrors(n.filter("snapshot = 'a'"), n.filter("snapshot = 'b'"))


@query(N + "SELECT type, count(*)::BIGINT AS objects, sum(size)::BIGINT AS bytes FROM nodes GROUP BY type")
def object_totals(spark, d):
    return objects.totals_by_type(A.nodes(spark, d))


@query(
    B + """, loc AS (SELECT blob_id, min(struct_pack(p := pack_id, l := length)) AS spot FROM blob_locations GROUP BY blob_id),
placed AS (SELECT l_orderkey AS file, l_linenumber AS ordinal, spot.p AS pack_id, spot.l AS length, coalesce(sum(spot.l) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) JOIN loc ON blob_id = l_partkey),
wanted AS (SELECT * FROM placed WHERE (file + ordinal) % 4 <> 0), uses AS (SELECT pack_id, min(struct_pack(f := file, o := ordinal)) AS u FROM wanted GROUP BY pack_id)
SELECT file, ordinal, "offset", length, pack_id, u.f AS first_file, u.o AS first_ordinal FROM wanted JOIN uses USING (pack_id)"""
)
def restore_in_order_of_first_use(spark, d):
    file = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("ordinal"))  # an ordinal may repeat there
    chunks = file.agg(F.min("l_partkey").cast("long").alias("blob_id"))
    return objects.restore_plan(chunks, A.blob_locations(spark, d).withColumn("priority", F.lit(0)), chunks.filter("(file + ordinal) % 4 = 0"))


@query(
    B + """, notes AS (SELECT p_partkey AS blob_id, TIMESTAMP '1997-01-01' + to_days((p_partkey % 500)::INTEGER) AS noted FROM part WHERE p_partkey % 3 = 0),
own AS (SELECT pack_id, TIMESTAMP '1998-06-01' AS noted FROM blob_locations WHERE pack_id LIKE '%3' GROUP BY 1), gone AS (SELECT pack_id, min(noted) AS b FROM blob_locations JOIN notes USING (blob_id) WHERE blob_id % 2 = 0 GROUP BY 1)
SELECT pack_id, epoch_us(least(coalesce(own.noted, TIMESTAMP '1998-01-01'), coalesce(b, TIMESTAMP '2999-01-01')))::BIGINT AS discovered_us FROM (SELECT DISTINCT pack_id FROM blob_locations) LEFT JOIN own USING (pack_id) LEFT JOIN gone USING (pack_id)"""
)
def garbage_discovered_at(spark, d):
    part, b = A.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("blob_id")), A.blob_locations(spark, d)
    at = F.timestamp_add("DAY", (F.col("blob_id") % 500).cast("int"), F.lit("1997-01-01").cast("timestamp"))
    own = b.filter("pack_id LIKE '%3'").select("pack_id", F.lit("1998-06-01").cast("timestamp").alias("at")).distinct()
    out = objects.discovered_at(b, part.filter("blob_id % 2 = 0"), own, part.filter("blob_id % 3 = 0").withColumn("at", at), NOW)
    return out.select("pack_id", F.unix_micros("discovered_at").alias("discovered_us"))


@query(
    A.with_sql(A.PACKS) + """SELECT pack_id, CASE type WHEN 'tree' THEN 'metadata' WHEN 'data' THEN CASE WHEN pack_id LIKE '%5' OR (used_bytes > 0 AND created_at <= TIMESTAMP '1997-12-24'
  AND created_at <= TIMESTAMP '1997-06-01' AND (pack_id LIKE '%8' OR created_at + INTERVAL 900 DAY >= TIMESTAMP '1998-04-01')) THEN 'archival-data' ELSE 'recent-data' END ELSE 'cache' END AS class FROM packs"""
)
def placement_class_of_packs(spark, d):
    p, ends = A.packs(spark, d), F.col("pack_id")
    e = p.select("pack_id", F.lit("1997-06-01").cast("timestamp").alias("evaluated_at"), (F.col("created_at") + F.expr("INTERVAL 900 DAYS")).alias("survival_until"), ends.endswith("8").alias("indefinite"), ends.endswith("5").alias("promoted"))
    return objects.placement_class(p, e, "INTERVAL 90 DAYS", NOW)


REFS = "refs AS (SELECT l_suppkey % 4 AS uid, l_orderkey AS inode, l_linenumber AS revision, l_partkey AS blob_id FROM lineitem WHERE l_returnflag <> 'R')"


def erase(spark, d):
    line = A.table(spark, d, "lineitem")
    refs = line.filter("l_returnflag <> 'R'").select((F.col("l_suppkey") % 4).alias("uid"), F.col("l_orderkey").alias("inode"), F.col("l_linenumber").alias("revision"), F.col("l_partkey").alias("blob_id"))
    members = line.filter("l_linenumber = 3").select(F.concat(F.lit("p"), F.floor(F.col("l_orderkey") / 2).cast("string")).alias("pack_id"), F.col("l_partkey").alias("blob_id"))
    return objects.erase_plan(refs, members, 3)


@query("WITH " + REFS + " SELECT DISTINCT inode, revision FROM refs WHERE uid = 3")
def erasure_redacts_revisions(spark, d):
    return erase(spark, d)[0]


@query("WITH " + REFS + " SELECT blob_id, count(*) FILTER (WHERE uid <> 3)::BIGINT AS remaining FROM refs GROUP BY 1 HAVING bool_or(uid = 3)")
def erasure_leaves_references(spark, d):
    return erase(spark, d)[1]


@query(
    "WITH " + REFS + """, m AS (SELECT DISTINCT 'p' || l_orderkey // 2 AS pack_id, l_partkey AS blob_id FROM lineitem WHERE l_linenumber = 3)
SELECT pack_id FROM m LEFT JOIN refs USING (blob_id) GROUP BY pack_id HAVING count(*) FILTER (WHERE uid <> 3) = 0 AND count(*) FILTER (WHERE uid = 3) > 0"""
)
def erasure_deletes_packs(spark, d):
    return erase(spark, d)[2]


@query("SELECT l_partkey AS child, list_sort(list(DISTINCT l_orderkey || '/' || l_linenumber)) AS links FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey || '/' || l_linenumber) > 1")
def hard_links_by_parent(spark, d):
    return objects.hard_links(A.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("parent"), F.col("l_linenumber").cast("string").alias("name"), F.col("l_partkey").alias("child")))


@query(
    A.with_sql(A.REVISIONS) + """SELECT inode, list_filter([CASE WHEN mtime IS NOT NULL THEN 'mtime' END, CASE WHEN ctime IS NOT NULL THEN 'ctime' END, CASE WHEN size IS NOT NULL THEN 'size' END,
  CASE WHEN uid IS NOT NULL THEN 'uid' END, 'gid', 'path'], lambda x: x IS NOT NULL) AS known FROM revisions"""
)
def known_fields_of_revisions(spark, d):
    none = F.lit(None)
    return A.revisions(spark, d).select("inode", numbers.known_fields(F.col("mtime"), F.col("ctime"), F.col("size"), none, F.col("uid"), F.col("gid"), none, F.col("path")).alias("known"))


@query(A.with_sql(A.REVISIONS) + "SELECT inode, printf('%08X', fsid) || hex(path) || '00' || printf('%016X', revision) AS key FROM revisions")
def ordered_version_keys(spark, d):
    return A.revisions(spark, d).select("inode", F.hex(paths.version_key(F.col("fsid"), F.col("path"), F.col("revision"))).alias("key"))


@query(
    "SELECT k, CASE " + " ".join(f"WHEN k >= {1 << p} THEN printf('%.3f {u}', k / {1 << p}.0::DOUBLE)" for p, u in ((40, "TiB"), (30, "GiB"), (20, "MiB"), (10, "KiB")))
    + " ELSE k || ' B' END AS shown FROM (SELECT (o_orderkey * [1, 64, 4096, 1048577, 1073741825][1 + o_custkey % 5])::BIGINT AS k FROM orders)"
)
def sizes_as_text(spark, d):
    factor = F.element_at(F.array(*(F.lit(x).cast("long") for x in (1, 64, 4096, 1048577, 1073741825))), (F.col("o_custkey") % 5 + 1).cast("int"))
    return A.table(spark, d, "orders").select((F.col("o_orderkey") * factor).cast("long").alias("k")).select("k", numbers.format_bytes(F.col("k")).alias("shown"))
