"""Queries over all edges, members and events, against brute-force versions on small tables whose ids a modulo filter would drop."""

import datetime

import pytest

import __spark_entry__  # noqa: F401 (registers the queries)
from cairn import registry
from cairn.catalog import tree_queries

#: l_orderkey (pack), l_linenumber, l_partkey (blob), l_suppkey, l_quantity, l_extendedprice, l_returnflag
LINES = [
    (1, 1, 7, 10, 5, 200_000.0, "N"), (1, 2, 14, 11, 5, 50_000.0, "A"), (2, 1, 7, 11, 5, 90_000.0, "N"), (2, 2, 13, 12, 5, 30_000.0, "R"),
    (3, 1, 15, 13, 5, 1_000.0, "N"), (3, 2, 21, 13, 5, 2_000.0, "N"), (4, 1, 5, 14, 5, 500.0, "A"), (5, 1, 8, 15, 5, 700_000.0, "N"),
]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    day = datetime.datetime(1997, 1, 1)
    rows = [(*x[:4], float(x[4]), *x[5:], day) for x in LINES]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(i,) for i in range(10, 18)], "s_suppkey long").write.parquet(f"{d}/supplier.parquet")
    spark.createDataFrame([(i,) for i in range(1, 30)], "p_partkey long").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(i,) for i in range(1, 251)], "event_id long").write.parquet(f"{d}/events.parquet")
    return d


def run(spark, data, name):
    return registry.QUERIES[name](spark, data).collect()


def test_reachability_takes_all_edges(spark, data):
    edges = {(f"s{s}", f"p{p}") for _, _, p, s, *_ in LINES} | {(f"p{p}", f"s{s}") for _, _, p, s, *_ in LINES}
    seen, todo = {"s10"}, ["s10"]
    while todo:
        at = todo.pop()
        new = {c for p, c in edges if p == at} - seen
        seen |= new
        todo += new
    for name in ("reachable_from_roots", "reachable_from_roots_all_edges"):
        assert {r.key for r in run(spark, data, name)} == seen == {"s10", "s11", "p7", "p14"}
    keys = {p for p, _ in edges} | {f"s{i}" for i in range(10, 18)}
    for name in ("orphan_tree_roots", "orphan_tree_roots_all_edges"):
        assert {r.key for r in run(spark, data, name)} == keys - {c for _, c in edges} == {"s16", "s17"}


def members():
    """(blob, pack) -> (state, length) of every blob, by the smallest pack that holds it."""
    out = {}
    for pack, _, blob, _, _, price, _ in sorted(LINES):
        first = all(b != blob for b, _ in out)
        out[blob, f"{pack:010}"] = ("unused" if blob % 3 == 0 else "used" if first else "duplicate", round(price))
    return out


def classified():
    got = {}
    for (_, pack), (state, length) in members().items():
        blobs, size = got.setdefault(pack, ({}, {}))
        blobs[state] = blobs.get(state, 0) + 1
        size[state] = size.get(state, 0) + length
    return got


def plan(size):
    waste = size.get("unused", 0) + size.get("duplicate", 0)
    return waste, "remove" if not size.get("used") else "repack" if waste or size["used"] < 100_000 else "keep"


def test_prune_plans_take_all_members(spark, data):
    expected = classified()
    rows = {r.pack_id: r for r in run(spark, data, "prune_accounts")}
    assert set(rows) == set(expected) and rows == {r.pack_id: r for r in run(spark, data, "prune_accounts_all_blobs")}
    for pack, (blobs, size) in expected.items():
        for s in ("used", "duplicate", "unused"):
            assert rows[pack][f"{s}_blobs"] == blobs.get(s, 0) and rows[pack][f"{s}_bytes"] == size.get(s, 0)
    plans = {r.pack_id: (r.waste, r.plan) for r in run(spark, data, "prune_classification_all_blobs")}
    assert plans == {pack: plan(size) for pack, (_, size) in expected.items()}
    repack = {(pack, size.get("used", 0), plan(size)[0]) for pack, (_, size) in expected.items() if plan(size)[1] == "repack"}
    assert len(repack) == 2
    # both fit the budget; they waste less than what may stay, so only small packs and those with trees are taken
    trees = {f"{x[0]:010}" for x in LINES if x[6] == "A"}
    assert {tuple(r) for r in run(spark, data, "budgeted_repack_selection")} == {r for r in repack if r[0] in trees or r[1] + r[2] < 50_000}


def test_metric_lines_take_all_events(spark, data):
    for name in ("metric_json_lines", "metric_json_lines_all_events"):
        assert sorted(tuple(r) for r in run(spark, data, name)) == [(i, "requests", 2 * i) for i in range(1, 251)]
    assert tree_queries.all_edges(spark, data).count() == 2 * len({(s, p) for _, _, p, s, *_ in LINES})
