"""Failures and edge cases of observed identities, mappings, restore plans and size rendering."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cairn.functions import numbers, paths
from cairn.operators import objects, observed, reach

BINDING = "fsid int, inode long, generation long, source int, state string, commit long, continuity string"
PROOF = "source int, commit long, complete boolean, debt_free boolean, completed_at long"
REFS = "fsid int, inode long, generation long, refs long"


def residency(spark, state, proofs, refs=()):
    bindings = spark.createDataFrame([(1, 5, 0, 1, state, 9, "proven")], BINDING)
    return observed.binding_residency(bindings, spark.createDataFrame(list(proofs), PROOF), spark.createDataFrame(list(refs), REFS)).first()


def test_residency_follows_proof_and_references(spark):
    good = [(1, 9, True, True, 77)]
    assert residency(spark, "live", [])[3:] == ("live", 0, None)
    assert residency(spark, "deleted", good)[3:] == ("expired", 0, 77)
    assert residency(spark, "deleted", good, [(1, 5, 0, 2), (1, 5, 0, 1)])[3:] == ("archive-only", 3, 77)
    assert residency(spark, None, good)[3:] == ("unknown", 0, None)


@pytest.mark.parametrize("proofs", [[], [(1, 9, False, True, 77)], [(1, 9, True, False, 77)], [(1, 8, True, True, 77)]])
def test_deletion_without_a_valid_proof_fails(spark, proofs):
    with pytest.raises(PySparkException, match="valid crawl proof"):
        residency(spark, "deleted", proofs)


def test_missing_files_are_deleted_only_by_a_proven_crawl(spark):
    rows = [(1, 1, 0, 1, "live", 3, "source-generation"), (1, 2, 0, 1, "live", 9, "proven"), (1, 3, 0, 1, "live", 3, "source-generation"), (1, 3, 1, 1, "unknown", 3, "unknown"), (1, 4, 0, 1, "deleted", 1, "proven")]
    bindings, none = spark.createDataFrame(rows, BINDING), spark.createDataFrame([], BINDING)
    got = {(r.inode, r.generation): (r.state, r.continuity) for r in observed.missing_identities(bindings, none, True, True, 5).collect()}
    assert got == {(1, 0): ("deleted", "proven"), (2, 0): ("unknown", "unknown"), (3, 0): ("deleted", "source-generation"), (3, 1): ("deleted", "unknown")}
    assert {r.state for r in observed.missing_identities(bindings, none, True, False, 5).collect()} == {"unknown"}


def test_each_target_needs_one_complete_mapping(spark):
    targets = spark.createDataFrame([("/a",)], "target string")
    run = lambda rows: observed.match_mappings(targets, spark.createDataFrame(rows, "target string, svm string"), ["svm"]).collect()
    assert [tuple(r) for r in run([("/a", "s"), ("/a", None), ("/a", ""), ("/b", "t")])] == [("/a", "s")]
    for rows in ([("/a", "")], [("/a", "s"), ("/a", "t")]):
        with pytest.raises(PySparkException, match="complete mapping"):
            run(rows)


def test_subtrees_next_to_a_change_are_reused(spark):
    trees = spark.createDataFrame([(p,) for p in ("/a", "/a/b", "/a/b/c", "/ab", "/a/x/", "/")], "path string")
    changed = spark.createDataFrame([("/a//b/",)], "path string")
    assert sorted(r.path for r in observed.reusable_subtrees(trees, changed).collect()) == ["/a/x/", "/ab"]


def test_a_marker_rejects_what_lies_beside_and_below_it(spark):
    rows = [("/a", "dir"), ("/a/TAG", "file"), ("/a/f", "file"), ("/a/d", "dir"), ("/a/d/TAG", "file"), ("/ab", "file")]
    kept = observed.reject_nodes(spark.createDataFrame(rows, "path string, type string"), marker="TAG")
    assert sorted(r.path for r in kept.collect()) == ["/a", "/a/TAG", "/ab"]


def test_restore_skips_chunks_that_are_there_and_fails_at_unknown_blobs(spark):
    chunks = spark.createDataFrame([("f", 0, 1), ("f", 1, 2), ("f", 2, 1)], "file string, ordinal int, blob_id long")
    at = spark.createDataFrame([(1, "p2", 10, 1), (1, "p1", 10, 2), (2, "p3", 5, 1)], "blob_id long, pack_id string, length long, priority int")
    there = spark.createDataFrame([("f", 0)], "file string, ordinal int")
    got = sorted((r.ordinal, r.offset, r.pack_id, r.first_ordinal) for r in objects.restore_plan(chunks, at, there).collect())
    assert got == [(1, 10, "p3", 1), (2, 15, "p2", 2)]
    with pytest.raises(PySparkException, match="unknown blob 2"):
        objects.restore_plan(chunks, at.filter("blob_id = 1"), there).collect()


def test_sizes_round_halves_to_even(spark):
    row = spark.range(1).select(*(numbers.format_bytes(F.lit(n).cast("long")).alias(f"c{i}") for i, n in enumerate((0, 1023, 1024, 1088, 1216, 5 << 30)))).first()
    assert tuple(row) == ("0 B", "1023 B", "1.000 KiB", "1.062 KiB", "1.188 KiB", "5.000 GiB")


def test_version_keys_sort_a_path_before_what_lies_below(spark):
    rows = [(1, "/ab", 1), (1, "/a/b", 1), (1, "/a", 300), (1, "/a", 2), (0, "/z", 9)]
    df = spark.createDataFrame(rows, "f int, p string, r long").orderBy(paths.version_key(F.col("f"), F.col("p"), F.col("r")))
    assert [tuple(r) for r in df.collect()] == [(0, "/z", 9), (1, "/a", 2), (1, "/a", 300), (1, "/a/b", 1), (1, "/ab", 1)]


@pytest.mark.parametrize("sizes", [[], [7], [10, 10, 10], list(range(1, 201)), [1 << 40, 3, (1 << 40) + 1, 1 << 17, None]])
def test_percentile_size_is_exact(spark, sizes):
    packs = spark.createDataFrame([(x,) for x in sizes], "physical_size long")
    known = sorted(x for x in sizes if x is not None)
    for percent in (3, 50, 99):
        want = max(5, known[len(known) * percent // 100] if known else 0) * 4 // 5
        assert reach.percentile_size(packs, percent, 5, 4, 5).first()["target"] == want
