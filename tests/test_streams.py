"""Streams, layers and jobs: repeated batches, late rows, folding, resuming, views."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import observed, series, trees
from cairn.plans import jobs
from cairn.plans.query import Query, from_view, save_view
from cairn.sources import layers
from cairn.streaming import catchup, rollup

DAY = datetime.datetime(2024, 1, 1)


def slow(deltas):
    """State of each inode, delta after delta."""
    out = {}
    for _, kind, inode, uid, size, state, op, refs in sorted(deltas):
        s = out.setdefault(inode, {"uid": None, "size": None, "state": None, "refs": 0})
        if kind in ("create", "classify"):
            s["uid"], s["size"] = uid, size
        elif kind == "state":
            s["state"] = state
        else:
            s["refs"] = refs if op == "set" else s["refs"] + (refs if op == "inc" else -refs)
    return {i: tuple(s.values()) for i, s in out.items()}


def feed(n, seed=1):
    rng, out = random.Random(seed), []
    for c in range(n):
        kind = rng.choice(["create", "classify", "state", "refs", "refs", "refs"])
        op = rng.choice(["inc", "inc", "set", "dec"]) if kind == "refs" else None
        refs = None if op is None else 100 + rng.randrange(9) if op == "set" else 2 if op == "inc" else 0
        inode = 7 if rng.random() < 0.4 else rng.randrange(20)
        owns = kind in ("create", "classify")
        out.append((c, kind, inode, rng.choice([None, 5, 6]) if owns else None, rng.randrange(99) if owns else None, rng.choice(["live", "deleted"]) if kind == "state" else None, op, refs))
    return out


def state(df):
    return {r.inode: (r.uid, r.size, r.state, r.refs) for r in df.collect()}


def test_catch_up(spark, tmp_path):
    rows, src, at, checkpoint = feed(400), str(tmp_path / "feed"), str(tmp_path / "state"), str(tmp_path / "checkpoint")
    df = spark.createDataFrame(rows, catchup.DELTA)
    assert state(catchup.current(catchup.changes(df))) == slow(rows)
    assert catchup.watermark(spark, at) == -1
    for a in (0, 100, 200):
        df.filter(F.col("commit").between(a, a + 99)).coalesce(1).write.mode("append").parquet(src)
    assert catchup.catch_up(spark, src, at, checkpoint) == 299
    assert state(catchup.read(spark, at)) == slow(rows[:300])
    # the same commits once more, in another file: passed over
    df.filter("commit < 300").coalesce(1).write.mode("append").parquet(src)
    assert catchup.catch_up(spark, src, at, checkpoint) == 299 and state(catchup.read(spark, at)) == slow(rows[:300])
    # all from the start, as after a lost checkpoint: passed over
    assert catchup.catch_up(spark, src, at, str(tmp_path / "other")) == 299 and state(catchup.read(spark, at)) == slow(rows[:300])
    # rows of a batch that failed before its mark don't count, and are replaced by its next run
    catchup.changes(df.filter("commit >= 300")).write.mode("overwrite").parquet(f"{at}/changes/after=299")
    assert state(catchup.read(spark, at)) == slow(rows[:300])
    folded = str(tmp_path / "folded")
    catchup.fold(spark, at, folded)
    df.filter("commit >= 300").coalesce(1).write.mode("append").parquet(src)
    assert catchup.watermark(spark, folded) == 299 and catchup.catch_up(spark, src, folded, checkpoint) == 399
    assert state(catchup.read(spark, folded)) == slow(rows)
    assert catchup.catch_up(spark, src, at, str(tmp_path / "third")) == 399 and state(catchup.read(spark, at)) == slow(rows)


def test_references_below_zero(spark):
    df = spark.createDataFrame([(1, "refs", 3, None, None, None, "dec", 1)], catchup.DELTA)
    with pytest.raises(Exception, match="references below zero"):
        catchup.current(catchup.changes(df)).collect()
    assert catchup.current(catchup.changes(df.filter("false"))).count() == 0


def test_windows_over_late_rows(spark, tmp_path):
    src, schema = str(tmp_path / "events"), "ts timestamp, event_type string, value double"
    stamp = lambda h: DAY + datetime.timedelta(hours=h)
    at, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run(*hours):
        spark.createDataFrame([(stamp(h), "x", 1.0) for h in hours], schema).coalesce(1).write.mode("append").parquet(src)
        out = rollup.run_to_table(spark, rollup.windowed_counts(rollup.read_events(spark, src, schema), "2 hours"), at, checkpoint)
        return {r.start.replace(tzinfo=None): r.n for r in out.select(F.col("w.start").alias("start"), "n").collect()}

    assert run(0, 1, 10) == {stamp(0): 2, stamp(10): 1}
    assert run(10.5, 9.5) == {stamp(0): 2, stamp(10): 2, stamp(8): 1}
    assert run(0.5, 11) == {stamp(0): 2, stamp(10): 3, stamp(8): 1}  # 00:30 came after the watermark had passed its window


def test_layers(spark, tmp_path):
    at = str(tmp_path / "t")
    assert layers.newest(spark, at) == -1
    layers.add(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string"), at, 0)
    layers.add(spark.createDataFrame([(2, None), (4, "d")], "k int, v string"), at, 1)
    layers.add(spark.createDataFrame([(1, "x", True)], "k int, v string, deleted boolean"), at, 2)
    read = lambda n=None: sorted(map(tuple, layers.read(spark, at, ["k"], n).collect()))
    assert read(0) == [(1, "a"), (2, "b"), (3, None)] and read() == [(2, None), (3, None), (4, "d")] and layers.newest(spark, at) == 2
    layers.add(spark.createDataFrame([(1, "back")], "k int, v string"), at, 2)
    assert read()[0] == (1, "back")


def test_roll_up(spark, tmp_path):
    at = str(tmp_path / "t")
    rows = [(DAY + datetime.timedelta(days=d), "created", 10, 1, "data") for d in (0, 0, 1)]
    e = spark.createDataFrame(rows, "ts timestamp, type string, physical_size long, backend long, pack_type string")
    assert rollup.roll_up(spark, at, e, "day", DAY).count() == 2
    assert rollup.roll_up(spark, at, e, "day", DAY).isEmpty()
    assert rollup.roll_up(spark, at, e.union(e), "day", DAY + datetime.timedelta(days=1)).count() == 1
    assert sorted(r.events_observed for r in layers.read(spark, at, series.KEY).collect()) == [2, 2]


def facts(spark):
    rows = [(i % 4, f"s{i % 3}", i % 5, 10 * i, None if i % 7 == 0 else DAY, "proven") for i in range(60)]
    return spark.createDataFrame(rows, "segment long, svm string, uid long, logical_size long, created_at timestamp, identity_continuity string")


def test_job_goes_on_where_it_stopped(spark, tmp_path):
    f, at, q = facts(spark), str(tmp_path / "job"), Query(uid=(1, 2), group_by=("svm",))
    get = lambda df: sorted(map(tuple, df.select("svm", "files", "logical_bytes", "unknown_creation").collect()))
    build = jobs.partial_groups(q)
    assert jobs.result(spark, at, q).count() == 0
    assert not jobs.resume(f, build, at, 1)
    # a run that wrote its rows and failed before it said so
    build(f.filter("segment = 1")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment").parquet(f"{at}/rows")
    assert get(jobs.result(spark, at, q)) == get(q.run(f.filter("segment = 0")))
    assert not jobs.resume(f, build, at, 2) and jobs.resume(f, build, at) and jobs.resume(f, build, at)
    assert get(jobs.result(spark, at, q)) == get(q.run(f))


def test_views(spark, tmp_path):
    f, fine = facts(spark), Query(uid=(1, 2), group_by=("svm", "uid"))
    view = save_view(fine, f, str(tmp_path / "view"))
    coarse = Query(uid=(2, 1), group_by=("svm",))
    assert sorted(map(str, from_view(coarse, fine, view).collect())) == sorted(map(str, coarse.run(f).collect()))
    for other in (Query(uid=(1,), group_by=("svm",)), Query(uid=(1, 2), group_by=("year",))):
        with pytest.raises(ValueError, match="does not answer"):
            from_view(other, fine, view)


def test_replay_needs_its_root(spark):
    nodes = spark.createDataFrame([("/r/a", "/r", "x"), ("/r/b", "/r", "y"), ("/q/c", "/q", "z")], "path string, parent string, content string")
    stat = ", ".join(f"{c} long" for c in observed.STAT)
    stats = spark.createDataFrame([(p, *[k] * 6) for p, k in (("/r", 1), ("/r/a", 2), ("/r/b", 3), ("/q/c", 4))], f"path string, {stat}")
    seen, errors = observed.capture(nodes, stats)
    assert [r.path for r in errors.collect()] == ["/q/c"] and seen.count() == 2
    known = nodes.join(stats, "path").withColumn("size", F.when(F.col("path") == "/r/b", 9).otherwise(F.col("size")))
    got = {r.path: r.decision for r in observed.replay(seen, "/r", known, F.lit(True)).collect()}
    assert got == {"/r/a": "reuse", "/r/b": "read", "/q/c": "gone"}
    with pytest.raises(ValueError, match="nothing captured"):
        observed.replay(seen, "/q", known, F.lit(True))
    with pytest.raises(ValueError, match="without a path"):
        observed.replay(seen.withColumn("parent", F.lit(None).cast("string")), "/r", known, F.lit(True))


def test_visit(spark):
    edges = [("t", "a", "dir", "A"), ("t", "b", "file", None), ("t", "c", "dir", "C"), ("A", "x", "file", None), ("A", "y", "file", None), ("A", "z", "dir", "Z"), ("Z", "deep", "file", None), ("C", "x", "file", None)]
    df = spark.createDataFrame(edges, "parent string, name string, type string, child string")
    roots = spark.createDataFrame([("t",)], "root string")
    see = lambda skip: {r.path for r in trees.visit(df, roots, skip).collect()}
    assert see(F.lit(False)) == {"", "/a", "/b", "/c", "/a/x", "/a/y", "/a/z", "/a/z/deep", "/c/x"}
    assert see(F.col("name") == "a") == {"", "/a", "/b", "/c", "/c/x"}
    assert see(F.col("name") == "b") == {"", "/a", "/b", "/a/x", "/a/y", "/a/z", "/a/z/deep"}
    assert see(F.col("path") == "/a/x") == {"", "/a", "/b", "/c", "/a/x", "/c/x"}
    with pytest.raises(ValueError, match="deeper than 2"):
        trees.visit(df, roots, F.lit(None).cast("boolean"), 2)
