"""Rules that SQL does not show: budgets, queues, freshness, errors, chunks, sources and listings."""

import datetime
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import globs, numbers
from cairn.operators import checks, observed, reach, snapshots, trees, work
from cairn.plans.query import Query, StaleError, check_freshness
from cairn.sources import repository, sinks

DAY = datetime.datetime(2024, 1, 1)


def chosen(rows, budget, unused_after):
    """(pack, type, used, waste, large) in order, one after another."""
    room, left, out = budget, sum(r[3] for r in rows), []
    for pack, kind, used, waste, large in rows:
        if used + waste < room and not (kind == "data" and large and left < unused_after):
            room, left = room - used - waste, left - waste
            out.append((pack, used, waste))
    return sorted(out)


@pytest.mark.parametrize("few", [50_000, 0, 5])
@pytest.mark.parametrize(("budget", "unused"), [(10**9, 0), (900, 0), (10**9, 700), (2500, 900), (0, 0)])
def test_repack_budget(spark, monkeypatch, few, budget, unused):
    monkeypatch.setattr(reach, "FEW", few)
    rng = random.Random(budget + unused)
    rows = [(f"p{i:03}", rng.choice(["data", "tree", "mixed"]), rng.choice([5, 20, 90]), rng.choice([1, 10, 200])) for i in range(40)]
    df = spark.createDataFrame([(p, t, u, w, "repack") for p, t, u, w in rows], "pack_id string, type string, used_bytes long, waste long, plan string")
    order = sorted(rows, key=lambda r: (r[1] == "data", r[2] + r[3] >= 100, -r[3] / r[2], r[0]))
    got = reach.budgeted(reach.candidate_order(df, 100), budget, unused)
    assert sorted(map(tuple, got.collect())) == chosen([(*r, r[2] + r[3] >= 100) for r in order], budget, unused)


def test_queue_passes_over_what_does_not_fit(spark):
    rows = [("a", 1, 1, None, 50), ("b", 1, 2, None, 60), ("c", 1, 3, None, 40), ("d", 1, 4, DAY, 1), ("e", 1, 5, None, 10), ("f", 2, 1, None, 500), ("g", 2, 2, None, 1), ("h", 3, 9, None, 7)]
    requests = spark.createDataFrame(rows, "pack_id string, backend long, deadline int, not_before timestamp, bytes long")
    limits = spark.createDataFrame([(1, 3, 100), (2, None, 100), (3, 0, None)], "backend long, max_requests long, max_bytes long")
    got = {r.pack_id: r.decision for r in work.due(requests, limits, DAY - datetime.timedelta(1)).collect()}
    assert got == {"a": "attempt", "b": "limited", "c": "attempt", "d": "deferred", "e": "attempt", "f": "attempt", "g": "limited", "h": "limited"} | {"e": "attempt" if 50 + 40 + 10 <= 100 else "limited"}
    with pytest.raises(Exception, match="unknown target"):
        work.due(requests, limits.filter("backend < 3"), DAY).collect()


def test_freshness():
    assert check_freshness(Query(), 5, 5) == check_freshness(Query(require_current=True), 6, 5) == "current"
    assert check_freshness(Query(allow_stale=True), 4, 5) == "stale" and check_freshness(Query(), 4, None) == "unknown"
    for q, head in ((Query(), 5), (Query(require_current=True), 5), (Query(require_current=True), None)):
        with pytest.raises(StaleError):
            check_freshness(q, 4, head)


def test_canonical_form_of_queries():
    a, b = Query(uid=(2, 1, 1), group_by=("svm", "year")), Query(uid=(1, 2), group_by=("year", "svm"), allow_stale=True)
    assert a.canonical() == b.canonical() and a.key(1) == b.key(1) != a.key(2)
    assert json.loads(json.loads(a.canonical())["where"])["uid"] == [1, 2] and a.canonical() != Query(uid=(1,)).canonical()


def test_errors(spark):
    s = spark.createDataFrame([(i, DAY) for i in range(3)], "id long, time timestamp")
    assert snapshots.nth_latest(s, 2).collect()[0].id == 0
    with pytest.raises(ValueError, match="asks for 4"):
        snapshots.nth_latest(s, 3)
    e = spark.createDataFrame([("r", "a", "x")], "parent string, name string, child string")
    assert trees.resolve(e, "r", "/a/").first().key == "x"
    with pytest.raises(ValueError, match="nothing named 'b'"):
        trees.resolve(e, "r", "a/b")
    b = spark.createDataFrame([(1, 1, 1)], "fsid int, inode long, revision long")
    assert observed.bound_revisions(b, b).count() == 1
    with pytest.raises(Exception, match="no revision of binding 1 1 1"):
        observed.bound_revisions(b, b.withColumn("revision", F.lit(2).cast("long"))).collect()


def test_random_share(spark):
    rows = spark.range(5000).select("id")
    one = {r.id for r in checks.random_share(rows, 2.5, 7).collect()}
    assert len(one) == 125 and one == {r.id for r in checks.random_share(rows.repartition(7), 2.5, 7).collect()} != {r.id for r in checks.random_share(rows, 2.5, 8).collect()}
    assert checks.random_share(rows.selectExpr("1 AS id"), 10, 7).count() == 500
    assert checks.random_share(rows.limit(3), 1, 7).count() == 1 and checks.random_share(rows.filter("false"), 1, 7).count() == 0


def test_content_chunks(spark):
    rng = random.Random(4)
    raw = bytes(rng.randrange(256) for _ in range(60_000))

    def slow(raw, least, bits, most):
        out, at = [], 0
        for i in range(len(raw)):
            h = sum(int(trees.GEAR[raw[i - j]]) << j for j in range(min(64, i + 1))) & (1 << bits) - 1
            if (i + 1 - at >= least and h == 0) or i + 1 - at == most or i + 1 == len(raw):
                out.append(i + 1)
                at = i + 1
        return out

    for x in (b"", b"a", b"z" * 5000, raw[:9000]):
        assert trees.chunk_ends(x, 100, 8, 700) == slow(x, 100, 8, 700)
    a, b = trees.chunk_ends(raw, 512, 10, 8192), trees.chunk_ends(raw[:20_000] + b"inserted" + raw[20_000:], 512, 10, 8192)
    assert len(a) > 20 and len(set(a) & {x - 8 for x in b}) + len(set(a) & set(b)) >= len(a) - 3
    texts = [(1, "é" * 4000), (2, None), (3, "")]
    got = trees.content_chunks(spark.createDataFrame(texts, "k int, t string"), "k", "t").collect()
    assert {r.k for r in got} == {1} and sum(r.length for r in got) == 8000
    whole = texts[0][1].encode()
    assert all(hashlib.sha256(whole[r.offset : r.offset + r.length]).hexdigest() == r.sha256 for r in got)


def test_sizes():
    assert [numbers.parse_size(x) for x in ("7", " 2 kB ", "3MiB")] == [7, 2000, 3 << 20]
    assert numbers.parse_binary_size("2K") == 2048
    assert [numbers.parse_size_range(x) for x in ("1k..2k", "5:", ":9", "4")] == [(1000, 2000), (5, 0), (0, 9), (4, 4)]
    for bad in ("x", "1 furlong", str(1 << 70)):
        with pytest.raises(ValueError, match="size"):
            numbers.parse_size(bad)
    with pytest.raises(ValueError, match="ends before"):
        numbers.parse_size_range("5..4")


def test_globs_below_directories(spark):
    tree = ["/", "/a", "/a/b", "/a/b/c", "/x", "/a/x/c", "/a/b/c/d"]
    df = spark.createDataFrame([(p,) for p in tree], "path string")
    for pattern, below in (("/a/b/*.c", {"/", "/a", "/a/b"}), ("*.c", set(tree)), ("/a/**/c", {"/", "/a", "/a/b", "/a/b/c", "/a/x/c", "/a/b/c/d"}), ("/x", {"/", "/x"})):
        assert {r.path for r in df.filter(globs.may_match_below(F.col("path"), pattern)).collect()} == below, pattern


def test_pattern_files(monkeypatch):
    monkeypatch.setenv("BASE", "/srv")
    assert globs.read_patterns("# no\n\n $BASE/*.tmp \n!${BASE}/keep\n$$x\n") == ["/srv/*.tmp", "!/srv/keep", "$x"]


def test_ignoring_case(spark):
    df = spark.createDataFrame([("/A/x.TMP",), ("/a/y.tmp",), ("/a/z",)], "path string")
    pick = lambda **k: {r.path for r in df.filter(globs.select(F.col("path"), ["*.tmp"], **k)).collect()}
    assert pick() == {"/a/y.tmp"} and pick(ignore_case=True) == {"/A/x.TMP", "/a/y.tmp"}


def test_sources_of_files(spark, tmp_path):
    at = tmp_path / "snapshots"
    at.mkdir()
    (at / "abc").write_text(json.dumps({"time": "2024-03-01T01:30:00+02:00", "tree": "t1", "paths": ["/x"], "hostname": "h", "tags": None}))
    (at / "def.json").write_text(json.dumps({"time": "2024-03-01T01:30:00Z", "tree": "t2", "summary": {"data_added": 5}}))
    got = {r.id: r for r in repository.snapshots(spark, str(at)).withColumn("us", F.unix_micros("time")).collect()}
    utc = lambda h, m, d: int(datetime.datetime(2024, 2, d, h, m, tzinfo=datetime.UTC).timestamp() * 10**6)
    assert (got["abc"].us, got["abc"].tz_offset_min, got["abc"].paths) == (utc(23, 30, 29), 120, ["/x"])
    assert got["def"].tz_offset_min == 0 and got["def"].summary.data_added == 5
    at = tmp_path / "trees"
    at.mkdir()
    for name, names in (("good", ["a", "b"]), ("twice", ["a", "a"]), ("wrong", ["b", "a"])):
        (at / name).write_text(json.dumps({"nodes": [{"name": n, "type": "file", "size": 3, "content": ["c"]} for n in names]}))
    nodes = repository.trees(spark, str(at))
    assert [(r.ordinal, r.name, r.size, r.content) for r in nodes.filter("tree = 'good'").orderBy("ordinal").collect()] == [(0, "a", 3, ["c"]), (1, "b", 3, ["c"])]
    assert {r.tree for r in repository.unsorted(nodes).collect()} == {"twice", "wrong"}
    objects = {r.type: (r.objects, r.bytes) for r in repository.objects(spark, str(tmp_path)).collect()}
    assert objects["snapshots"][0] == 2 and objects["trees"] == (3, sum(f.stat().st_size for f in at.iterdir()))


def test_listings(spark):
    n = spark.createDataFrame([("/a/b.txt", "file", 700, 9)], "path string, type string, size long, inode long")
    assert json.loads(sinks.listing_json(n).first().value) == {"path": "/a/b.txt", "type": "file", "size": 700, "inode": 9}
    assert json.loads(sinks.listing_usage(n).first().value) == {"name": "b.txt", "asize": 700, "dsize": 1024, "ino": 9}


@pytest.mark.parametrize(("order", "paths"), [("name", "abc"), ("size", "bca"), ("mtime", "cab"), ("extension", "cba")])
def test_order_of_listings(spark, order, paths):
    rows = [("/a.z", 3, 2), ("/b.y", 1, 3), ("/c.x", 2, 1)]
    df = spark.createDataFrame(rows, "path string, size long, mtime int")
    assert "".join(r.path[1] for r in trees.listing(df, order).collect()) == paths
    assert "".join(r.path[1] for r in trees.listing(df, order, reverse=True).collect()) == paths[::-1]
