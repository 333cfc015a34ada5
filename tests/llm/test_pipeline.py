"""The pipeline's stages, each on what its predecessor kept, against brute-force versions on an awkward table."""

import collections
import itertools
import random
import re

import pytest
from test_operators import SPACE, corpus, leaks, shingles
from test_single_lines import brute

import corpus_pipeline
from cairn.llm import lines, quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipeline"))
    rng = random.Random(21)
    items = [(i, " ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(40)) for _ in range(30))) for i in range(4)] + [(None, "x y z w v"), (9, None)]
    rows = corpus(22, 25)
    rows += [(70_000 + i, " ".join([*rows[-1][1].split()[i * 50 : i * 50 + 60], *items[i % 4][1].split()[3:20]])) for i in range(6)]
    rows += [(80_000 + i, "$$$!! " * 300 + "BUY NOW!! " * i) for i in range(30)]
    rows += [(90_000 + i, f"first {i}\n" + "\n".join(f"shared line {j}" for j in range(8)) + f"\nlast {i}") for i in range(5)]
    docs = [(i, t, None, f"s{k % 3}" if k % 4 else None, None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    labels = {i: int(i < 80_000) for i, *_ in docs if i is not None and i not in (1, 3)}
    spark.createDataFrame([(i, q, 0) for i, q in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, items


def one_each(rows):
    """Of each component of similar shingle sets the smallest id; texts without shingles all stay."""
    sets = [shingles(t, 5) for _, t in rows]
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [a if r == b else r for r in root]
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[root[i] if sets[i] else ("none", i)].append(r)
    return groups.values()


def test_stages(spark, data, tmp_path):
    d, items = data
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
        out = stage(spark, docs, d)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen[name] = (before, docs)
    rows = lambda name: sorted(((r.doc_id, r.text) for r in seen[name][1].collect()), key=str)

    before, _ = seen["quality classifier"]
    scores = quality.score_quality(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    good = collections.Counter(r.doc_id for r in scores.filter("predicted = 1").collect())
    assert collections.Counter(i for i, _ in rows("quality classifier")) == good
    assert sum(i is not None and 80_000 <= i < 90_000 for i in good) <= 3 and len(good) > 40

    before, _ = seen["line dedup"]
    expected = brute(before, lines.K + lines.WINDOW - 1, lines.ALONE)
    assert rows("line dedup") == sorted(((i, t) for i, t, _, _ in expected), key=str)
    changed = {(i, t) for i, t, _, gone in expected if gone}
    assert changed and all(r.n_chars == len(r.text) for r in seen["line dedup"][1].collect() if (r.doc_id, r.text) in changed)

    before, _ = seen["n-gram Jaccard join"]
    kept = collections.Counter(rows("n-gram Jaccard join"))
    for group in one_each(before):
        ids = [i for i, _ in group if i is not None]
        stay = [r for r in set(group) if kept[r]]
        assert len(stay) == 1 and (not ids or stay[0][0] == min(ids))
    assert len(set(before)) > len(kept)

    before, _ = seen["benchmark decontamination"]
    assert rows("benchmark decontamination") == [r for r in before if not leaks([r], items)] and len(rows("benchmark decontamination")) < len(before)

    before, packed = seen["best-fit packing"]
    words = collections.Counter()
    for i, t in before:
        words[i] += len(re.findall(SPACE, t or ""))
    got = packed.collect()
    assert {i: sum(r.length for r in got if r.doc_id == i) for i in words} == dict(words)
    assert sorted(map(str, corpus_pipeline.run(spark, d).collect())) == sorted(map(str, got))
