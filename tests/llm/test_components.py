"""Components of a graph: the same within one task and across tasks, and few tasks for few edges."""

import random

from cairn.llm import common, jaccard


def brute(nodes, edges):
    root = {i: i for i in [*nodes, *(i for e in edges for i in e)]}
    while True:
        before = dict(root)
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return set(root.items())


def graph(seed, n):
    """Chains in mixed order, stars, loops and repeats, negative and huge ids."""
    rng = random.Random(seed)
    ids = [*rng.sample(range(-(10**6), 10**6), n), 2**63 - 1, -(2**63)]
    chain = ids[: n // 3]
    edges = list(zip(chain, chain[1:], strict=False)) + [(ids[n // 2], x) for x in ids[n // 2 : n // 2 + n // 5]]
    edges += [(rng.choice(ids[-n // 4 :]), rng.choice(ids[-n // 4 :])) for _ in range(n // 5)]
    edges += rng.choices(edges, k=n // 10)
    rng.shuffle(edges)
    return edges


def tasks(spark, name, work):
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        out = work()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
    return out, sum(tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s))


def test_components_within_a_task_and_across_tasks(spark, monkeypatch):
    edges = graph(1, 300)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7).cache()
    expected = brute([], edges)
    got = lambda nodes=None: sorted(map(tuple, common.components(nodes, df).collect()))
    assert got() == sorted(expected) and len({r for _, r in expected}) > 5
    lone = spark.createDataFrame([(5 * 10**6,), (edges[0][0],)], "id long")
    assert got(lone) == sorted(expected | {(5 * 10**6, 5 * 10**6)})
    monkeypatch.setattr(common, "SLIM", 40)
    assert got() == sorted(expected)
    assert got(lone) == sorted(expected | {(5 * 10**6, 5 * 10**6)})
    assert common.components(None, df.limit(0)).collect() == []


def test_a_small_graph_takes_few_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.range(2_000).selectExpr("(id * 7919) % 2003 a", "((id + 1) * 7919) % 2003 b").coalesce(2)
        rows, n = tasks(spark, "components", lambda: common.components(None, edges).collect())
        assert len(rows) == 2_001 and len({r.root for r in rows}) == 1 and n < 20
        # a group of near copies, one of exact copies, and texts that link with nothing
        rng = random.Random(2)
        words = [f"w{i}" for i in range(4_000)]
        base = rng.sample(words, 200)
        texts = [" ".join([*base[:-1], f"last{i}"]) for i in range(12)] + [" ".join(words[:80])] * 5
        texts += [" ".join(rng.sample(words, 60)) for _ in range(20)] + ["", None, ""]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        kept, n = tasks(spark, "jaccard", lambda: jaccard.keep_one_each(docs, 5, 80).collect())
        assert sorted(r.doc_id for r in kept) == [0, 12, *range(17, 40)]
        assert n < 60 * 150  # skipped ones count; 14,103 while every round of joins was shuffled
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
