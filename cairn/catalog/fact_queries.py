"""Fact queries, reports and scalar functions over orders seen as files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from cairn import adapters as A
from cairn.functions import dates, globs, numbers, paths
from cairn.operators import facts as ops
from cairn.operators import reports
from cairn.plans.query import Query, from_view, save_view
from cairn.registry import query


def facts(spark, d):
    return ops.make_facts(A.revisions(spark, d))


WITH = A.with_sql(A.FACTS)
MEASURES = "count(*)::BIGINT AS files, coalesce(sum(logical_size), 0)::BIGINT AS logical_bytes, count(*) FILTER (WHERE created_at IS NULL)::BIGINT AS unknown_creation"
FLAGSHIP = Query(uid=tuple(range(1, 900)), year=(1993, 1994, 1995, 1996, 1997, 1999), size_min=1000, size_max=300_000, residency=("archive-only", "live"), group_by=("svm", "year"))
YEARS = "(1993, 1994, 1995, 1996, 1997, 1999)"
WHERE = f"uid BETWEEN 1 AND 899 AND year IN {YEARS} AND logical_size >= 1000 AND logical_size < 300000 AND residency IN ('archive-only', 'live') AND identity_continuity <> 'unknown'"


@query(WITH + f"SELECT coalesce(svm, 'unknown') AS svm, coalesce(year::VARCHAR, 'unknown') AS year, {MEASURES} FROM facts WHERE {WHERE} GROUP BY ALL")
def fact_query_grouped(spark, d):
    return FLAGSHIP.run(facts(spark, d))


@query(WITH + "SELECT * EXCLUDE (created_at), epoch_us(created_at)::BIGINT AS created_us FROM facts")
def fact_construction(spark, d):
    out = facts(spark, d)
    return out.select(*(c for c in out.columns if c != "created_at"), F.unix_micros("created_at").alias("created_us"))


@query(WITH + f"SELECT {MEASURES} FROM facts WHERE {WHERE}")
def fact_query_totals(spark, d):
    return Query(**{**FLAGSHIP.__dict__, "group_by": ()}).run(facts(spark, d))


@query(WITH + f"SELECT svm, volume, {MEASURES} FROM facts WHERE identity_continuity <> 'unknown' GROUP BY GROUPING SETS ((svm, volume), ())")
def fact_query_with_grand_total(spark, d):
    return ops.grouped(facts(spark, d).filter(Query().condition()), ["svm", "volume"], totals=True)


@query(
    WITH + "SELECT " + ", ".join(f"coalesce({c}::VARCHAR, 'unknown') AS {c}" for c in ops.DIMENSIONS) + f", {MEASURES} FROM facts GROUP BY ALL"
)
def fact_query_all_dimensions(spark, d):
    return Query(include_incomplete=True, group_by=tuple(ops.DIMENSIONS)).run(facts(spark, d))


@query(WITH + f"SELECT coalesce(year::VARCHAR, 'unknown') AS year, {MEASURES} FROM facts WHERE {WHERE} GROUP BY ALL")
def fact_query_rolled_up_from_view(spark, d):
    view = save_view(FLAGSHIP, facts(spark, d), A.folder(spark))
    return from_view(Query(**{**FLAGSHIP.__dict__, "group_by": ("year",)}), FLAGSHIP, view)


@query(
    WITH + f"""SELECT count(*) FILTER (WHERE {WHERE})::BIGINT AS matched,
       count(*) FILTER (WHERE {WHERE.replace("<> 'unknown'", "= 'unknown'")})::BIGINT AS left_out_continuity,
       count(*) FILTER (WHERE ({WHERE.replace(" AND identity_continuity <> 'unknown'", "")}) IS NULL)::BIGINT AS undecided FROM facts"""
)
def fact_query_explained(spark, d):
    return FLAGSHIP.explain(facts(spark, d))


@query(
    WITH + f"SELECT svm, {MEASURES} FROM facts WHERE created_at >= TIMESTAMP '1996-03-01' AND created_at < TIMESTAMP '1998-01-01' AND creation_basis = 'mtime' AND identity_continuity = 'proven' GROUP BY svm"
)
def fact_query_time_range(spark, d):
    q = Query(created_min=datetime(1996, 3, 1), created_max=datetime(1998, 1, 1), creation_basis=("mtime",), identity_continuity=("proven",), group_by=("svm",))
    return q.run(facts(spark, d))


OVERLAY = """,
overlay AS (SELECT fsid, inode, generation, 'expired' AS state FROM facts WHERE inode % 6 = 0 AND residency = 'archive-only')"""


@query(WITH.rstrip() + OVERLAY + f" SELECT coalesce(o.state, residency) AS residency, {MEASURES} FROM facts LEFT JOIN overlay o USING (fsid, inode, generation) GROUP BY 1")
def facts_with_residency_overlay(spark, d):
    f = facts(spark, d)
    over = f.filter("inode % 6 = 0 AND residency = 'archive-only'").select(*ops.IDENTITY, F.lit("expired").alias("state"))
    return ops.grouped(ops.with_residency(f, over), ["residency"])


@query(
    WITH + "SELECT inode, logical_size + e AS logical_size FROM facts, (SELECT unnest([0, 1, 2]) AS e) WHERE e = inode % 3 AND logical_size IS NOT NULL"
)
def newest_row_of_identity(spark, d):
    f = facts(spark, d).filter("logical_size IS NOT NULL")
    rows = f.select(*ops.IDENTITY, "logical_size", F.explode(F.sequence(F.lit(0), (F.col("inode") % 3).cast("int"))).alias("epoch"))
    return ops.current(rows).select("inode", (F.col("logical_size") + F.col("epoch")).alias("logical_size"))


@query("SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey = 0 OR n_nationkey % 7 = 0 THEN 'unknown' ELSE n_name END AS name FROM nation")
def dictionary_decode(spark, d):
    n = A.table(spark, d, "nation")
    ids = n.select(F.col("n_nationkey").cast("long").alias("id"))
    dictionary = n.filter("n_nationkey % 7 <> 0").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("value"))
    return ops.with_names(ids.withColumnRenamed("id", "k"), "k", dictionary, "name").select(F.col("k").alias("id"), "name")


@query("SELECT o_custkey::BIGINT AS inode, min(o_orderkey)::BIGINT AS revision, 1::INTEGER AS fsid FROM orders GROUP BY o_custkey")
def first_revision_of_inode(spark, d):
    o = A.table(spark, d, "orders").select(F.lit(1).alias("fsid"), F.col("o_custkey").cast("long").alias("inode"), F.col("o_orderkey").cast("long").alias("revision"))
    return ops.first_revisions(o)


@query("""WITH g AS (SELECT o_custkey AS inode, o_orderkey AS generation, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next FROM orders WHERE o_orderkey % 3 = 0)
SELECT o.o_custkey::BIGINT AS inode, o.o_orderkey::BIGINT AS revision, g.generation::BIGINT AS generation, 1::INTEGER AS fsid
FROM orders o JOIN g ON g.inode = o.o_custkey AND o.o_orderkey >= g.generation AND (g.next IS NULL OR o.o_orderkey < g.next)""")
def revision_in_generation(spark, d):
    o = A.table(spark, d, "orders").select(F.lit(1).alias("fsid"), F.col("o_custkey").cast("long").alias("inode"), F.col("o_orderkey").cast("long").alias("revision"))
    return ops.revision_generations(o.filter("revision % 3 = 0").withColumnRenamed("revision", "generation"), o)


SCOPES = "SELECT 'all' AS scope, '' AS value UNION ALL SELECT 'path_group', coalesce(path_group, 'unknown') UNION ALL SELECT 'uid', coalesce(uid::VARCHAR, 'unknown')"


@query(
    WITH + f"""SELECT u.unit, epoch_us(date_trunc(u.unit, created_at)::TIMESTAMP)::BIGINT AS start_us, s.scope, s.value, count(*)::BIGINT AS files, coalesce(sum(logical_size), 0)::BIGINT AS logical_bytes
FROM facts, (SELECT unnest(['year', 'month', 'week']) AS unit) u, LATERAL ({SCOPES}) s WHERE created_at IS NOT NULL GROUP BY ALL"""
)
def time_roll_up_by_year_month_week(spark, d):
    out = reports.time_roll_up(facts(spark, d))
    return out.select("unit", F.unix_micros("start").alias("start_us"), "scope", "value", "files", "logical_bytes")


def _growth(unit):
    return WITH + f"""SELECT epoch_us(start)::BIGINT AS start_us, files, logical_bytes, sum(logical_bytes) OVER (ORDER BY start)::BIGINT AS total_bytes
FROM (SELECT date_trunc('{unit}', created_at)::TIMESTAMP AS start, count(*)::BIGINT AS files, coalesce(sum(logical_size), 0)::BIGINT AS logical_bytes FROM facts WHERE created_at IS NOT NULL GROUP BY 1)"""


def _grow(spark, d, unit):
    return reports.growth(facts(spark, d), unit).select(F.unix_micros("start").alias("start_us"), "files", "logical_bytes", "total_bytes")


@query(_growth("year"))
def growth_by_year(spark, d):
    return _grow(spark, d, "year")


@query(_growth("month"))
def growth_by_month(spark, d):
    return _grow(spark, d, "month")


@query(_growth("week"))
def growth_by_iso_week(spark, d):
    return _grow(spark, d, "week")


@query(WITH + "SELECT coalesce(uid::VARCHAR, 'unknown') AS uid, residency, count(*)::BIGINT AS files, coalesce(sum(logical_size), 0)::BIGINT AS logical_bytes FROM facts GROUP BY ALL")
def owner_summary_by_user(spark, d):
    return reports.owner_summary(facts(spark, d), "uid")


@query(WITH + "SELECT coalesce(gid::VARCHAR, 'unknown') AS gid, residency, count(*)::BIGINT AS files, coalesce(sum(logical_size), 0)::BIGINT AS logical_bytes FROM facts GROUP BY ALL")
def owner_summary_by_group(spark, d):
    return reports.owner_summary(facts(spark, d), "gid")


@query(
    WITH + "SELECT uid, residency, count(*)::BIGINT AS files, coalesce(sum(logical_size), 0)::BIGINT AS logical_bytes FROM facts WHERE uid IS NOT NULL GROUP BY ALL ORDER BY logical_bytes DESC, files DESC, uid, residency LIMIT 25"
)
def top_owners(spark, d):
    return reports.owner_ranking(facts(spark, d), "uid", 25)


REFS = """
refs AS (SELECT (l_suppkey % 20)::BIGINT AS uid, l_orderkey::BIGINT AS inode, l_partkey::BIGINT AS blob_id, lpad(l_orderkey::VARCHAR, 10, '0') AS pack_id, l_linenumber::BIGINT AS seen FROM lineitem)"""


def references(spark, d):
    return A.table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 20).cast("long").alias("uid"), F.col("l_orderkey").cast("long").alias("inode"), F.col("l_partkey").cast("long").alias("blob_id"),
        F.lpad(F.col("l_orderkey").cast("string"), 10, "0").alias("pack_id"), F.col("l_linenumber").cast("long").alias("seen"),
    )


@query(
    A.with_sql(A.PACKS, REFS) + """SELECT k.blob_id, k.packs, epoch_us(k.retained_until)::BIGINT AS retained_us, r.own_refs, r.other_refs, r.first_seen, r.other_refs > 0 AS survives
FROM (SELECT blob_id, count(*)::BIGINT AS packs, max(min_retention_until) AS retained_until FROM (SELECT DISTINCT blob_id, pack_id FROM refs WHERE uid = 7) LEFT JOIN packs USING (pack_id) GROUP BY 1) k
JOIN (SELECT blob_id, count(*) FILTER (WHERE uid = 7)::BIGINT AS own_refs, count(*) FILTER (WHERE uid <> 7)::BIGINT AS other_refs, min(seen) FILTER (WHERE uid = 7) AS first_seen FROM refs GROUP BY 1) r USING (blob_id)"""
)
def erasure_audit_blobs(spark, d):
    out = reports.audit_blobs(references(spark, d), A.packs(spark, d), 7)
    return out.select("blob_id", "packs", F.unix_micros("retained_until").alias("retained_us"), "own_refs", "other_refs", "first_seen", "survives")


@query(WITH + "SELECT fsid, inode, residency, logical_size FROM facts WHERE uid = 7")
def erasure_audit_inodes(spark, d):
    return reports.audit_inodes(facts(spark, d), 7)


@query(
    A.with_sql(REFS) + """, o AS (SELECT DISTINCT blob_id, inode FROM refs WHERE uid <> 7 AND blob_id IN (SELECT blob_id FROM refs WHERE uid = 7)),
r AS (SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY inode) AS n FROM o)
SELECT blob_id, count(*)::BIGINT AS sources, string_agg(inode::VARCHAR, ',' ORDER BY inode) FILTER (WHERE n <= 3) AS first_sources FROM r GROUP BY blob_id"""
)
def shared_references_of_others(spark, d):
    out = reports.other_references(references(spark, d), 7, 3)
    return out.select("blob_id", "sources", F.array_join("first_sources", ",").alias("first_sources"))


@query("""SELECT page_id, coalesce(nullif(split_part(p, '/', 2), ''), 'unknown') AS a, coalesce(nullif(split_part(p, '/', 4), ''), 'unknown') AS c, regexp_extract(p, '(\\.[^./]*)$', 1) AS ext
FROM (SELECT page_id, '/' || regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS p FROM pages)""")
def path_components(spark, d):
    p = F.concat(F.lit("/"), F.regexp_replace("url", "^[a-z]+://|[?#].*$", ""))
    return A.table(spark, d, "pages").select("page_id", paths.component(p, 1).alias("a"), paths.component(p, 3).alias("c"), paths.extension(p).alias("ext"))


@query("""SELECT page_id, CASE WHEN p = '/a' OR p LIKE '/a/%' THEN CASE WHEN p = '/a/en' OR p LIKE '/a/en/%' THEN '/a/en' ELSE '/a' END ELSE split_part(p, '/', 3) END AS g
FROM (SELECT page_id, (CASE WHEN page_id % 2 = 0 THEN '/a' ELSE '/b' END) || regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS p FROM pages)""")
def longest_prefix_group(spark, d):
    p = F.concat(F.when(F.col("page_id") % 2 == 0, "/a").otherwise("/b"), F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", ""))
    return A.table(spark, d, "pages").select("page_id", paths.classify(p, ["/a", "/a/en/"], 2).alias("g"))


@query("""SELECT page_id, regexp_matches(p, '^/[^/]*\\.example\\.com/en(/.*)?$') AS anchored, regexp_matches(p, '(^|/)[0-9][0-9]?[0-9]?\\.html(/.*)?$') AS loose,
       regexp_matches(p, '/fr(/.*)?$') OR (regexp_matches(p, '/de(/.*)?$') AND NOT regexp_matches(p, '/8[^/]*(/.*)?$')) AS listed
FROM (SELECT page_id, '/' || regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS p FROM pages)""")
def glob_matches(spark, d):
    p = F.concat(F.lit("/"), F.regexp_replace("url", "^[a-z]+://|[?#].*$", ""))
    return A.table(spark, d, "pages").select(
        "page_id", globs.matches(p, "/*.example.com/en").alias("anchored"),
        (globs.matches(p, "?.html") | globs.matches(p, "??.html") | globs.matches(p, "[0-9]??.html")).alias("loose"),
        globs.select(p, ["de", "!8*", "fr"]).alias("listed"),
    )


@query("""SELECT o_orderkey, CASE WHEN s = 0 THEN 0 ELSE floor(log10(s::DOUBLE))::INTEGER END AS log10, CASE WHEN s = 0 THEN 0 ELSE length(s::VARCHAR)::INTEGER END AS decade,
       least(100, 4 + 2 * floor(sqrt(s::DOUBLE))::BIGINT)::BIGINT AS target, (('0x' || substr(md5(s::VARCHAR), 1, 2))::INTEGER % 7)::INTEGER AS bucket
FROM (SELECT o_orderkey, round(o_totalprice)::BIGINT % 20000 AS s FROM orders)""")
def size_functions(spark, d):
    s = F.round("o_totalprice").cast("long") % 20000
    return A.table(spark, d, "orders").select(
        "o_orderkey", numbers.size_log10(s).alias("log10"), numbers.decade(s).cast("int").alias("decade"),
        numbers.target_size(s, 4, 2, 100).cast("long").alias("target"), numbers.hash_bucket(F.md5(s.cast("string")), 7).alias("bucket"),
    )


@query("SELECT o_orderstatus, least(sum(o_orderkey::DECIMAL(38,0) * 1000000000000), 18446744073709551615)::VARCHAR AS total FROM orders GROUP BY 1")
def saturating_sums(spark, d):
    v = F.col("o_orderkey").cast("decimal(38,0)") * F.lit(10**12).cast("decimal(13,0)")
    return A.table(spark, d, "orders").groupBy("o_orderstatus").agg(numbers.saturating_sum(v).cast("string").alias("total"))


UNITS = {
    "minute": "epoch_us(t) // 60000000", "hour": "epoch_us(t) // 3600000000", "day": "epoch_us(date_trunc('day', t)::TIMESTAMP) // 86400000000", "week": "isoyear(t) * 100 + weekofyear(t)",
    "month": "year(t) * 100 + month(t)", "quarter": "year(t) * 10 + quarter(t)", "half": "year(t) * 10 + CASE WHEN month(t) <= 6 THEN 1 ELSE 2 END", "year": "year(t)",
}


@query("SELECT event_id, " + ", ".join(f"({e})::BIGINT AS {u}" for u, e in UNITS.items()) + " FROM (SELECT event_id, ts::TIMESTAMP + to_minutes((event_id % 3 * 60)::INTEGER) AS t FROM events)")
def calendar_buckets(spark, d):
    t, off = F.col("ts").cast("timestamp"), F.col("event_id") % 3 * 60
    return A.table(spark, d, "events").select("event_id", *(dates.bucket(t, u, off).alias(u) for u in UNITS))


@query("""SELECT o_orderkey, epoch_us(make_timestamp((year(m))::BIGINT, (month(m))::BIGINT, 1, 0, 0, 0) + to_days((day(t) - 1 - 3)::INTEGER) + (t - date_trunc('day', t)) - INTERVAL 5 HOUR)::BIGINT AS us
FROM (SELECT o_orderkey, o_orderdate::TIMESTAMP AS t, date_trunc('month', o_orderdate::TIMESTAMP) - INTERVAL 14 MONTH AS m FROM orders)""")
def calendar_subtraction(spark, d):
    t = F.col("o_orderdate").cast("timestamp")
    return A.table(spark, d, "orders").select("o_orderkey", F.unix_micros(dates.minus(t, dates.parse_span("1y2m3d5h"))).alias("us"))


@query("""SELECT o_orderkey, epoch_us(o_orderdate::TIMESTAMP)::BIGINT AS us FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, epoch_us(date_trunc('day', o_orderdate)::TIMESTAMP)::BIGINT FROM orders WHERE o_orderkey % 2 = 1""")
def many_layouts_of_time(spark, d):
    t = F.col("o_orderdate").cast("timestamp")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(t, "dd.MM.yyyy"))
    return A.table(spark, d, "orders").select("o_orderkey", F.unix_micros(dates.parse(text)).alias("us"))
