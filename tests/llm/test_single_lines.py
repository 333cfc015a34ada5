"""Line dedup: runs and single lines, in the operator, its SQL and the pipeline's stage."""

import random

import duckdb
import pytest

import corpus_pipeline
from cairn.llm import lines, queries

LONG = "w" * lines.ALONE
SHORT = "w" * (lines.ALONE - 1)
DATA = "/root/testdata"


def brute(rows, run, alone):
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    first, one = {}, {}
    for i, t in order:
        x = [] if t is None else t.split("\n")
        for a in range(len(x)):
            one.setdefault(x[a], (i, t, a))
            if a + run <= len(x):
                first.setdefault(tuple(x[a : a + run]), (i, t, a))
    out = []
    for i, t in rows:
        x = [] if t is None else t.split("\n")
        gone = {b for a in range(len(x) - run + 1) if first[tuple(x[a : a + run])] != (i, t, a) for b in range(a, a + run)}
        if alone is not None:
            gone |= {a for a in range(len(x)) if one[x[a]] != (i, t, a) and (len(x) == 1 or len(x[a]) >= alone)}
        out.append((i, None if t is None else "\n".join(y for b, y in enumerate(x) if b not in gone), len(x), len(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("letters", [2, 8])
@pytest.mark.parametrize(("k", "window"), [(1, 2), (2, 4), (3, 1), (1, 1)])
def test_runs(spark, k, window, letters):
    rng = random.Random(k * 10 + window + letters)
    base = [rng.choice("abcdefgh") for _ in range(40)]
    rows = [(None, None), (None, "b\na\nb\nc"), (1, ""), (1, ""), (2, "x\ny\nz\nv\nw"), (2, "x\ny\nz\nv\nw"), (3, "p\nx\ny\nz\nv\nw\nq"), (4, "a\n" * 12), (5, "\n" * 9)]
    rows += [(i, "\n".join(rng.choice("abcdefgh"[:letters]) for _ in range(rng.randint(1, 30)))) for i in range(10, 30)]
    for i in range(30, 60):
        a, b = sorted(rng.choices(range(40), k=2))
        rows.append((i, "\n".join([*rng.choices("xyz", k=rng.randrange(4)), *base[a:b], *rng.choices("xyz", k=rng.randrange(4))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in lines.dedup_lines(docs, k, window, None).collect()), key=str)
    assert got == brute(rows, k + window - 1, None)
    assert lines.dedup_lines(docs.filter("false"), k, window).count() == 0


@pytest.mark.parametrize("alone", [3, lines.ALONE])
def test_single_lines(spark, alone):
    rng = random.Random(4)
    lone = ["a", "b", "cd", "e f", "h  i\tj k", LONG, SHORT]
    rows = [(None, None), (None, f"b\n{LONG}\nc"), (1, ""), (2, f"x\n{LONG}\ny"), (3, f"p\n{SHORT}\nq"), (4, f"r\n{SHORT}\ns"), (5, SHORT), (5, SHORT), (6, SHORT), (7, "one"), (8, "one"), (9, f"{LONG}\n{LONG}")]
    rows += [(i, "\n".join(rng.choice(lone) for _ in range(rng.choice([1, 1, 2, 5, 12])))) for i in range(10, 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in lines.dedup_lines(docs, alone=alone).collect()), key=str)
    assert got == brute(rows, lines.K + lines.WINDOW - 1, alone)
    out = {(i, n_removed) for i, _, _, n_removed in got}
    assert {(2, 1), (6, 1), (8, 1)} <= out
    if alone == lines.ALONE:
        assert (4, 0) in out
    assert lines.dedup_lines(docs.filter("false"), alone=alone).count() == 0


def test_columns_of_clashing_names(spark):
    rows = [(1, "a" * 80, 7, 8, "x", 3), (2, "a" * 80, 7, 8, "y", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_LINES int, n_removed int, `a.b` string, n_chars int")
    got = lines.without_repeated_lines(docs)
    assert got.columns == docs.columns and got.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert sorted(map(tuple, got.collect())) == [rows[0], (2, "", 7, 8, "y", 0)]
    assert lines.dedup_lines(docs).columns == ["doc_id", "text", "a.b", "n_chars", "n_lines", "n_removed"]


def test_many_equal_rows(spark):
    docs = spark.range(2000).selectExpr("cast(1 as bigint) doc_id", "concat_ws('\n', transform(sequence(1, 30), x -> concat('line ', x))) text")
    got = lines.dedup_lines(docs.unionByName(docs.limit(1).selectExpr("cast(0 as bigint) doc_id", "text"))).groupBy("doc_id", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(0, 0, 1), (1, 30, 2000)]


def test_the_sql_and_the_pipeline_agree(spark):
    for d in (f"{DATA}/sf0.001", f"{DATA}/sf0.01"):
        con = duckdb.connect()
        name = f"{d}/documents.parquet"
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{name}'")
        expected = sorted(con.execute(lines.dedup_sql()).fetchall())
        assert sorted(tuple(r) for r in queries.op1_line_dedup(spark, d).select("doc_id", "text", "n_lines", "n_removed").collect()) == expected
        docs = spark.read.parquet(name)
        stage = corpus_pipeline.without_repeated_lines(spark, docs, d)
        assert sorted((r.doc_id, r.text) for r in stage.collect()) == [x[:2] for x in expected]
