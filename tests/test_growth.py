"""Queries whose work or memory once grew faster than their tables: their rows against the SQL on odd small tables, and
the plan that keeps the work in proportion."""

import contextlib
import datetime
import io
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401 (registers the queries)
from cairn import registry
from cairn.operators import reach, reports, trees
from cairn.plans import cuts


def sql_rows(d, name, *tables):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    found = con.execute(registry.ORACLES[name])
    return [c[0] for c in found.description], found.fetchall()


def same_rows(spark, d, name, *tables):
    columns, expected = sql_rows(d, name, *tables)
    got = registry.QUERIES[name](spark, d).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    return expected


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def test_window_rates_look_at_no_window_sample_by_sample(spark, folder):
    rng, day = random.Random(3), datetime.timedelta(days=1)
    start = datetime.datetime(1969, 12, 30, 12)
    times = [start, start, start + day, start + 2 * day, start + 9 * day, None, None] + [start + datetime.timedelta(seconds=rng.choice([1, 86_400, 43_200]) * rng.randint(0, 20)) for _ in range(300)]
    events = [(i, t, rng.choice([1, 2, 21])) for i, t in enumerate(times)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long").write.parquet(f"{folder}/events.parquet")
    expected = same_rows(spark, folder, "sliding_window_rates", "events")
    assert {r[2] for r in expected} == {"warming", "ready", "reset"}
    # a frame that begins and ends near its row is read anew for each row
    assert "-86400, currentrow" not in plan_of(registry.QUERIES["sliding_window_rates"](spark, folder)).replace("$()", "").lower()


def test_placement_plan_lists_no_more_backends_than_packs_have_copies(spark, folder):
    rng, day = random.Random(5), datetime.datetime(1996, 1, 1)
    spark.createDataFrame([(s, rng.randint(0, 4)) for s in range(1, 41)], "s_suppkey long, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    lines = [(k, n, rng.choice([rng.randint(1, 6), rng.randint(1, 40)]), 1.0, 10.0 * n, rng.choice("NAR"), rng.choice("OOOF"), day) for k in range(1, 400) for n in range(1, rng.randint(2, 9))]
    lines += [(1000, s, s, 1.0, 5.0, "N", "O", day) for s in range(1, 20)]
    schema = "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(lines, schema).write.parquet(f"{folder}/lineitem.parquet")
    expected = same_rows(spark, folder, "placement_plan_with_deadlines", "lineitem", "supplier")
    assert len({r[5] for r in expected}) > 4 and any(r[4] > 10 for r in expected)
    # the lists of backends that each pack looks through end before the list of all
    assert plan_of(registry.QUERIES["placement_plan_with_deadlines"](spark, folder)).count("TakeOrderedAndProject") == 4


def counted(spark, df):
    """The rows of df, and a counter of how often one of them was computed."""
    n = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            n.add(len(b))
            yield b

    return df.mapInPandas(count, df.schema), n


#: A tree of 200 nodes in which node k lies below k / 2, with a cycle and a repeated edge for walks that allow them.
EDGES = [(k // 2, f"n{k}", k) for k in range(2, 201)]


@pytest.mark.parametrize("few", [50_000, 0])
def test_closure_computes_its_edges_once(spark, monkeypatch, few):
    monkeypatch.setattr(cuts, "FEW_ROWS", few)
    edges, n = counted(spark, spark.createDataFrame([*EDGES, (200, "back", 1), (2, "n4", 4), (300, "n301", 301)], "parent long, name string, child long"))
    assert sorted(r.key for r in reach.closure(edges, spark.createDataFrame([(1,), (1,)], "key long")).collect()) == list(range(1, 201))
    assert n.value == len(EDGES) + 3


@pytest.mark.parametrize("few", [50_000, 0])
def test_walk_computes_its_edges_once(spark, monkeypatch, few):
    monkeypatch.setattr(cuts, "FEW_ROWS", few)
    edges, n = counted(spark, spark.createDataFrame(EDGES, "parent long, name string, child long"))
    got = trees.walk(edges, spark.createDataFrame([(1,)], "root long"), prune=F.col("key") % 7 == 3).collect()
    expected, todo = [], [("", 1, 0)]
    while todo:
        path, key, level = todo.pop()
        expected.append((path, key, level))
        todo += [(f"{path}/{name}", child, level + 1) for parent, name, child in EDGES if parent == key and key % 7 != 3]
    assert sorted((r.path, r.key, r.level) for r in got) == sorted(expected)
    assert n.value == len(EDGES)


def test_identities_below_a_root_send_no_edges_to_the_driver(spark):
    edges = spark.createDataFrame(EDGES, "parent long, name string, child long")
    nodes = spark.createDataFrame([(k, k % 3, k % 40, k % 50) for k in range(1, 201)], "key long, fsid int, inode long, revision long")
    found = reach.identities(edges, nodes, spark.createDataFrame([(5,)], "key long"))
    under = {5}
    for parent, _, child in EDGES:
        under |= {child} if parent in under else set()
    assert sorted(map(tuple, found.collect())) == sorted({(k % 3, k % 40, k % 50) for k in under})
    assert "Broadcast" not in plan_of(found)


@pytest.mark.parametrize("name", ["reachable_from_roots", "reachable_from_roots_all_edges"])
def test_reachability_does_not_sort_all_edges(spark, folder, monkeypatch, name):
    spark.createDataFrame([(7, 10), (7, 10), (7, 11), (8, 12)], "l_partkey long, l_suppkey long").write.parquet(f"{folder}/lineitem.parquet")
    given = []
    closure = reach.closure
    monkeypatch.setattr(reach, "closure", lambda edges, roots: given.append(edges) or closure(edges, roots))
    same_rows(spark, folder, name, "lineitem")
    assert "Exchange" not in plan_of(given[0])


def test_shared_references_are_dealt_to_tasks_by_their_number(spark, folder, monkeypatch):
    monkeypatch.setattr(reports, "TASK_ROWS", 100, raising=False)
    rng = random.Random(8)
    lines = [(rng.choice([None, *range(1, 30)]), rng.randint(1, 5), rng.choice([None, *range(1, 60)]), rng.choice([None, 7, 27, *range(1, 40)])) for _ in range(950)]
    lines += [(1, 1, 100, 7), (2, 1, 101, 7), (2, 2, 101, 8), (3, 1, 102, 9)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{folder}/lineitem.parquet")
    # the SQL's `uid <> 7` passes over references without a user; the operator counts them as another's
    columns, _ = sql_rows(folder, "shared_references_of_others", "lineitem")
    got = {r.blob_id: (r.sources, r.first_sources) for r in registry.QUERIES["shared_references_of_others"](spark, folder).select(*columns).collect()}
    own = {b for _, _, b, s in lines if s is not None and s % 20 == 7}
    expected = {}
    for order, _, blob, s in lines:
        if blob in own and blob is not None and (s is None or s % 20 != 7):
            expected.setdefault(blob, set()).add(order)
    first = lambda orders: ",".join(map(str, sorted(o for o in orders if o is not None)[:3]))
    assert got == {b: (len(orders), first(orders)) for b, orders in expected.items()}
    assert "hashpartitioning(blob_id" in plan_of(registry.QUERIES["shared_references_of_others"](spark, folder))
    n = -(-sum(b is not None for _, _, b, _ in lines) // 100)
    assert f", {n}), REPARTITION_BY_NUM" in plan_of(registry.QUERIES["shared_references_of_others"](spark, folder))
