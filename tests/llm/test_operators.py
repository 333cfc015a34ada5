"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows and odd columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import decontam, jaccard, licenses, lines, packing, quality, shards, substrings, textkit, topk, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, row int, key string, id string"
SPACE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def documents(spark, rows):
    """Rows of (doc_id, text), with nulls elsewhere and columns named like the operators' own."""
    return spark.createDataFrame([(i, t, None, f"s{k % 3}" if k % 4 else None, None, "x", k, None, "y") for k, (i, t) in enumerate(rows)], DOCS)


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["The", "Das,", "é", "語"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(50))
    rows = [(None, None), (1, ""), (1, ""), (2, "   "), (3, "one"), (3, "one"), (None, "a b c d e f"), (4, "A b c  d e f"), (2**60 + 1, "spam " * 90)]
    for i in range(10, 10 + n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 120, 300]))]
        rows.append((i, " ".join(words)))
        if rng.random() < 0.5:
            for j in range(rng.choice([1, 2, 5])):
                copy = list(words)
                for _ in range(rng.randint(0, len(copy) // 30)):
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
                rows.append((1000 * i + j, " ".join(copy)))
        if rng.random() < 0.3:
            rows.append((i + 500, f"{rng.random()} {passage}\n{rng.random()}"))
    rows.append((999_999, " ".join(rng.choice(vocabulary) for _ in range(20_000))))
    return rows


def key(x):
    return str(x)


def test_masks_lose_nothing():
    for differ in itertools.combinations(range(decontam.LENGTH), decontam.SUBSTITUTED):
        assert any(
            all(not (mask[p - at] == "1") for p in differ if at <= p < at + len(mask))
            for mask in decontam.MASKS
            for at in range(decontam.LENGTH - len(mask) + 1)
        )


def test_masks_of_short_items_lose_nothing():
    for n in range(1, decontam.LENGTH):
        for differ in itertools.combinations(range(n), decontam.differing(n)):
            assert any(all(mask[p] == "0" for p in differ) and "1" in mask for mask in decontam.masks_of(n))


def leaks(rows, items):
    """By brute force: every window against every aligned run of words."""
    texts = collections.defaultdict(list)
    for item, text in items:
        if item is not None:
            texts[item].append(re.findall(ALNUM, fold(text)))
    out = []
    for i, t in rows:
        w = re.findall(ALNUM, fold(t))
        for item, runs in texts.items():
            windows, equal = set(), set()
            for x in runs:
                n = min(13, len(x))
                if not n or (n < 5 and len(w) != n):
                    continue
                for a, b in itertools.product(range(len(w) - n + 1), range(len(x) - n + 1)):
                    same = [a + j for j in range(n) if w[a + j] == x[b + j]]
                    if n - len(same) <= 2 * n // 13:
                        windows.add((a, a + n))
                        equal.update(same)
            stretches = []
            for a, b in sorted(windows):
                if stretches and a < stretches[-1][1]:
                    stretches[-1][1] = max(b, stretches[-1][1])
                else:
                    stretches.append([a, b])
            out += [(i, item, a, b - a, len(equal & set(range(a, b)))) for a, b in stretches]
    return out


@pytest.mark.parametrize(("round_words", "part"), [(1_000_000, 50_000), (150, 14)])
def test_decontamination(spark, monkeypatch, round_words, part):
    monkeypatch.setattr(decontam, "ROUND_WORDS", round_words)
    monkeypatch.setattr(decontam, "PART", part)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 6, 7, 8, 10, 12, 13, 20, 40])))) for i in range(25)]
    items += [(97, "the " * 30), (98, ""), (99, None), (None, "w1 " * 20), (5, "a second text of one item that has more than thirteen words in it all")]
    gap = [f"g{j}" for j in range(60)]
    items.append((96, " ".join(gap)))
    rows = [(None, None), (0, ""), (1, "the " * 50), (1, "the " * 50), (None, "x " + " ".join(gap))]
    rows.append((2**40, " ".join([*gap[:15], *(f"z{j}" for j in range(30)), *gap[45:]])))
    rows += [(500 + i, t) for i, t in items[:8]]
    for i in range(40):
        x = (rng.choice(items)[1] or "").split()
        for _ in range(rng.randint(0, 5)):
            if x:
                x[rng.randrange(len(x))] = rng.choice(vocabulary)
        x = x[rng.randint(0, max(0, len(x) - 8)) :]
        rows.append((i + 2, " ".join([rng.choice(vocabulary), *(y.upper() + "," for y in x), rng.choice(vocabulary)])))
    docs, benchmark = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    expected = leaks(rows, items)
    assert [x for x in expected if x[0] == 2**40 and x[1] == 96] == [(2**40, 96, 0, 17, 15), (2**40, 96, 43, 17, 15)]
    assert sorted(map(tuple, decontam.find_leaks(docs, benchmark).collect()), key=key) == sorted(expected, key=key)
    kept = decontam.drop_leaking(docs, benchmark)
    assert kept.columns == docs.columns
    clean = [r for r in rows if not leaks([r], items)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted(clean, key=key)
    assert decontam.find_leaks(documents(spark, []), benchmark).count() == 0
    assert decontam.find_leaks(docs, benchmark.filter("false")).count() == 0


@pytest.mark.parametrize(("asked", "page"), [(topk.ASKED, topk.PAGE_MOST), (3, 200)])
def test_top_k(spark, monkeypatch, asked, page):
    monkeypatch.setattr(topk, "ASKED", asked)
    monkeypatch.setattr(topk, "PAGE_MOST", page)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    vectors = [(i, (centres[i % 6] + rng.normal(size=8) * 0.1).tolist()) for i in range(1500)]
    vectors += [(i, [0.5] * 8) for i in range(1500, 2000)]  # one very common vector: ties
    vectors += [(None, [1.0] * 8), (3000, None), (3001, [float("nan")] * 8), (3002, [float("inf")] + [0.0] * 7), (3003, [None] * 8), (3100, [0.25, -0.5]), (3100, [0.25, -0.5])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<double>, cell string")
    got = topk.top_k(df, df.filter("vec_id % 100 = 0")).collect()
    good = [(i, np.floor(1024 * np.array(v + [0.0] * (8 - len(v)))).astype(int)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = set()
    for q, v in {i: v for i, v in good if i % 100 == 0}.items():
        best = sorted((-int(v @ x), i) for i, x in good if i != q)[:10]
        expected |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == expected
    few = spark.createDataFrame([(100, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(few, few.filter("vec_id = 100")).collect()] == [(100, 1, 1, 1024 * 2048)]
    assert topk.top_k(few.filter("false"), few.filter("false")).count() == 0


def smallest_capacity(sizes, shards):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid, used, room = (lo + hi) // 2, 1, 0
        room = mid
        for s in sizes:
            if s > room:
                used, room = used + 1, mid
            room -= s
        lo, hi = (lo, mid) if used <= shards else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("hot", [0, 60])
def test_sharding(spark, hot):
    rows = corpus(4) + [(10_000 + i, "copy of a long text " * 40) for i in range(hot)]
    got = shards.minimax_shards(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=key) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=key)
    group = collections.Counter()
    for _, t in rows:
        group[hashlib.sha256((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
    load = collections.Counter()
    for r in got:
        load[r.shard] += r.size
    assert max(load.values()) <= smallest_capacity([group[k] for k in sorted(group)], 8)
    assert set(load) <= set(range(8))
    for s in load:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    of = collections.defaultdict(set)
    for r in got:
        of[r.text_crc32].add(r.shard)
    assert all(len(x) == 1 for x in of.values())
    assert shards.minimax_shards(documents(spark, [])).count() == 0


def test_cuts_are_minimax_when_prefixes_hold_many_groups():
    rng = random.Random(8)
    for _ in range(30):
        keys = sorted({f"{rng.randrange(16**6):06x}" for _ in range(rng.randint(1, 200))})
        size = {k: rng.choice([1, 5, 50, 400]) for k in keys}

        def fetch(prefixes, keys=keys, size=size):
            out = {}
            for p in prefixes:
                for k in keys:
                    if k.startswith(p):
                        out.setdefault(k[: len(p) + 1], []).append(k)
            return [(p, sum(size[k] for k in ks), len(ks) == 1) for p, ks in out.items()]

        line = shards._Line(fetch)
        capacity, cuts = shards._cuts(line, 5)
        assert capacity == smallest_capacity([size[k] for k in keys], 5)
        load = collections.Counter()
        for k in keys:
            load[sum(k >= c for c in cuts)] += size[k]
        assert max(load.values()) <= capacity


def test_quality(spark):
    rng = random.Random(6)
    good = lambda: ". ".join(" ".join(rng.choice(["the", "river", "went", "slowly", "home", "again"]) + str() for _ in range(9)).capitalize() for _ in range(rng.randint(2, 40)))
    bad = lambda: rng.choice([" ".join(w.upper() + "!!" for w in good().split()), " ".join(w + "$$$" for w in good().split()), "buy " * 80])
    rows = [(i, good() if i % 3 else bad()) for i in range(400)] + [(None, None), (1000, ""), (1000, "")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(None, 1, 0), (1000, None, None)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert len(held) > 50 and np.mean([r.predicted == (r.doc_id % 3 > 0) for r in held if r.doc_id < 400]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert {r.score for r in quality.score_quality(docs, labels.filter("false")).collect()} == {0.5}
    assert quality.score_quality(documents(spark, []), labels).count() == 0


def test_gradient():
    """Training lowers the loss on bags of one informative passage among noise."""
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 2, 200).astype(float)
    bags = [rng.normal(size=(rng.integers(1, 6), quality.FEATURES)).astype(np.float32) for _ in labels]
    for bag, y in zip(bags, labels, strict=True):
        bag[0, 3] = 6 * y
    model = quality.train(bags, labels)
    bounds = np.concatenate(([0], np.cumsum([len(b) for b in bags])))
    assert np.mean((model.score(np.vstack(bags), bounds) > 0.5) == labels) > 0.95


def test_packing(spark):
    rows = corpus(7)
    got = packing.pack(documents(spark, rows), capacity=256, shard_rows=20).collect()
    words = collections.Counter()
    bins = collections.defaultdict(list)
    for r in got:
        assert r.start == r.piece * 256
        words[r.doc_id] += r.length
        if r.bin is not None:
            bins[r.bin].append(r)
    expected = collections.Counter()
    for i, t in rows:
        expected[i] += len(re.findall(SPACE, t or ""))
    assert words == expected
    assert len(got) == sum(max(1, -(-len(re.findall(SPACE, t or "")) // 256)) for _, t in rows)
    for x in bins.values():
        x.sort(key=lambda r: r.bin_offset)
        assert x[-1].bin_offset + x[-1].length <= 256
        assert all(a.bin_offset + a.length == b.bin_offset for a, b in itertools.pairwise(x))
        assert max(collections.Counter(r.cluster for r in x).values()) == 1
        assert max(collections.Counter(r.source for r in x).values()) <= 2
    assert packing.pack(documents(spark, [])).count() == 0


def test_best_fit_takes_the_tightest_bin_allowed():
    rng = random.Random(9)
    for _ in range(50):
        rows = sorted(((rng.randint(1, 60), rng.randrange(4), rng.choice([-1, 0, 1])) for _ in range(40)), reverse=True)
        room, held, placed = [], [], []
        for n, source, cluster in rows:
            fits = [b for b in range(len(room)) if room[b] >= n and sum(s == source for s, _ in held[b]) < 2 and (cluster < 0 or all(c != cluster for _, c in held[b]))]
            b = min(fits, key=lambda b: (room[b], b)) if fits else len(room)
            if b == len(room):
                room.append(100)
                held.append([])
            placed.append((b, 100 - room[b]))
            room[b] -= n
            held[b].append((source, cluster))
        assert packing.best_fit(rows, 100, 2) == placed


def test_urls(spark):
    given = [
        ("https://EXAMPLE.com/en/71?x", "example.com/en/7", "allow"), ("http://a.b.com/en/", "com/en/", "block"), ("http://acom/en/", None, "allow"),
        ("http://com/en/x", "com/en/", "block"), ("http://x.example.net/de/8", "example.net/de/8", "block"), ("http://x.net/de/8#", "net/de/", "block"),
        ("http://x.org/ES/", None, "allow"), ("http://cheap-pills.example.com/fr/", None, "block"), ("http://pillsbury.com/", None, "allow"),
        ("no scheme", None, "allow"), (None, None, "allow"), ("", None, "allow"), ("http://casino.com/en/7", "com/en/", "block"), ("x://?q=com/en/", None, "allow"),
        ("http://a.com/x/en/", None, "allow"), ("http://ünï.com\n/en/", None, "allow"),
    ]
    df = spark.createDataFrame([(i, u, None) for i, (u, _, _) in enumerate(given)] + [(0, given[0][0], None)], "page_id long, url string, host string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(df).collect()}
    assert got == {i: (rule, verdict) for i, (_, rule, verdict) in enumerate(given)}
    assert urls.judge_urls(df).count() == len(given) + 1
    assert urls.judge_urls(df.filter("false")).count() == 0


def shingles(t, k):
    w = re.findall(SPACE, fold(t))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("k", "num", "block", "elements"), [(4, 85, 256, 1 << 19), (5, 80, 4, 1 << 19), (4, 85, 256, 400)])
def test_jaccard(spark, monkeypatch, k, num, block, elements):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "ELEMENTS", elements)
    rows = corpus(10)
    sets = [shingles(t, k) for _, t in rows]
    parent, n_links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
            n_links[i] += 1
            n_links[j] += 1
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    smallest = lambda x: min((i for i in x if i is not None), default=None)
    expected = [(rows[i][0], len(sets[i]), smallest(groups[root(i)]), n_links[i]) for i in range(len(rows))]
    docs = documents(spark, rows)
    got = [(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard.similar_components(docs, k, num).collect()]
    assert sorted(got, key=key) == sorted(expected, key=key)
    kept = jaccard.keep_one_each(docs, k, num)
    assert kept.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    for x in groups.values():
        assert ids[smallest(x)] >= 1
    assert {i for i in ids if i is not None} == {smallest(x) for x in groups.values()} - {None}
    assert jaccard.similar_components(documents(spark, []), k, num).count() == 0


@pytest.mark.parametrize("mu", [0.01, 1.0])
@pytest.mark.parametrize("across", [False, True])
def test_divide_skip_finds_every_link(monkeypatch, across, mu):
    monkeypatch.setattr(jaccard, "MU", mu)
    rng = np.random.default_rng(12)
    base = rng.choice(10_000, size=(4, 120), replace=False)
    sets = [np.unique(np.where(rng.random(120) < rng.choice([0.02, 0.1, 0.3]), rng.integers(0, 10_000, 120), base[i % 4])).astype(np.uint64) for i in range(60)]
    weights = rng.integers(1, 9, 60)
    links = [(i, j) for i, j in itertools.combinations(range(60), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j])) and (not across or i < 25 <= j)]
    sums = np.zeros(60, dtype=int)
    for i, j in links:
        sums[i] += weights[j]
        sums[j] += weights[i]
    forest, got = jaccard.divide_skip(sets, 25, 80, 100, across, weights)
    assert got.tolist() == sums.tolist() and set(forest) <= set(links) and len(links) > 30

    def classes(edges):
        at = list(range(60))
        for i, j in edges:
            at = [at[i] if x == at[j] else x for x in at]
        return [at.index(x) for x in at]

    assert classes(forest) == classes(links) == classes(jaccard.divide_skip(sets, 25, 80, 100, across)[0])


@pytest.mark.parametrize(("window", "anchor"), [(35, 8), (6, 3)])
def test_substrings(spark, window, anchor):
    rows = corpus(11) + [(5000, " ".join("ab"[i % 2] for i in range(90))), (5001, "spam " * 36)]
    words = [re.findall(SPACE, t or "") for _, t in rows]
    count = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    expected = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {j for a in range(len(w) - window + 1) if count[tuple(w[a : a + window])] > 1 for j in range(a, a + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        expected.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in substrings.dedup_substrings(documents(spark, rows), window, anchor).collect()]
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert substrings.dedup_substrings(documents(spark, [])).count() == 0


def test_parse_goes_on_at_the_same_reference():
    blocks = [(9, 4, True, False, 2, 100), (0, 5, True, False, 1, 50), (5, 4, True, True, 1, 50), (13, 2, False, True, 3, 0), (20, 3, True, False, 1, 50)]
    factors, checks = substrings.parse(*map(np.array, zip(*blocks, strict=True)), 10)
    assert factors.tolist() == [[0, 18], [9, 22], [20, 32]]
    assert checks.tolist() == [5, 6, 7, 8, 13, 14]


def test_anchors_of_long_texts(monkeypatch):
    x = np.random.default_rng(1).integers(0, 5, 3000).astype(np.uint64) << np.uint64(40)
    whole = substrings.anchors(x, 9).tolist()
    assert whole == [i + int(np.argmin(x[i : i + 9])) for i in range(len(x) - 8)]
    monkeypatch.setattr(substrings, "CHUNK", 100)
    assert substrings.anchors(x, 9).tolist() == whole


def test_words_that_a_polynomial_confuses():
    a = "0"
    while len(a) < 1024:
        a += a.translate(str.maketrans("01", "10"))
    b = a.translate(str.maketrans("01", "10"))
    w, _ = textkit.words([a.encode(), b.encode(), a.encode()], textkit.SPACES, False)
    assert w[0] == w[2] != w[1]
    texts = [x.replace("0", "u ").replace("1", "v ") for x in (a, b)]
    g = [textkit.grams(textkit.words([t.encode()], textkit.SPACES, False)[0], 1024)[0] for t in texts]
    assert g[0] != g[1]
    rng = random.Random(3)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    w, _ = textkit.words([" ".join(words).encode()], textkit.SPACES, False)
    assert len(set(zip(words, w.tolist(), strict=True))) == len(set(words)) == len(set(w.tolist()))


def test_equal_rows_in_linear_time(spark):
    text = " ".join(f"w{i * i % 3001}" for i in range(3000))
    docs = spark.range(2000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    assert substrings.dedup_substrings(docs).groupBy("doc_id", "n_words", "n_removed").count().collect() == [(1, 3000, 3000, 2000)]


def test_licenses(spark):
    texts = [
        None, "", "...", "CC BY cc by", "x CC-by\ny all rights  RESERVED.", "Released under the MIT license\nmore", "Released under MIT",
        "gnu general public license, version 3: this work is licensed under the", "Licensed under the Apache License, Version 2", "ñcc by", "cc byé", "cc by",
        "words " * 3000 + "all rights reserved", "Licensed under CC BY-NC 4.0.", "all rights all rights reserved rights",
        "// Licensed under the Apache License,\n// Version 2.0", "Released under\n * the MIT\n\n * License", "released " + "x " * 9 + "under the mit license",
        "released " + "x " * 7 + "under the mit license", "the license " * 2000 + "mit " + "the license " * 2000 + "released under the mit license " * 3,
        "Permission to use, copy, modify,\nand distribute this software for any\npurpose with or without fee is hereby\ngranted",
    ]
    rng = random.Random(13)
    vocabulary = ["licensed", "under", "the", "license", "mit", "version", "2", "0", "apache", "x", "y", "rights", "all", "reserved", "released"]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([4, 9, 30, 200]))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "cc by"), (5, texts[5])]

    def brute(templates):
        phrases = [(p.split(), x) for p, x in licenses.PHRASES]
        expected = []
        for i, t in rows:
            w = re.findall(ALNUM, fold(t))
            places = [(a, x) for p, x in phrases for a in range(len(w) - len(p) + 1) if w[a : a + len(p)] == p]
            found = {}
            for name, template in templates:
                own = re.findall(ALNUM, fold(template))
                for a in range(len(w)):
                    share = len(set(own) & set(w[a : a + 2 * len(own)])) / len(set(own)) if own and w[a] in own else 0
                    if share >= licenses.CONTAINMENT - 1e-9:
                        found[name] = max(found.get(name, 0), share)
            base = sorted({x for _, x in places})
            score = max([*found.values(), 1.0 if places else 0.0])
            at = [a for a, _ in places]
            expected.append((i, len(w), len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted({*base, *found})), score))
        return sorted(expected, key=key)

    docs = documents(spark, rows)
    expected = brute(licenses.TEMPLATES)
    assert sorted((tuple(r) for r in licenses.scan_licenses(docs).collect()), key=key) == expected
    labels = {r[0]: r[6] for r in expected}
    assert labels[15] == "apache-2.0" and labels[16] == "mit" and labels[20] == "isc" and labels[18] == "mit" and labels[17] == "mit"
    other = [("one", "x y"), ("one", "rights x"), ("none", "")]
    table = spark.createDataFrame(other, "label string, text string")
    assert sorted((tuple(r) for r in licenses.scan_licenses(docs, table).collect()), key=key) == brute(other)
    assert sorted((tuple(r) for r in licenses.scan_licenses(docs, []).collect()), key=key) == brute([])
    assert licenses.scan_licenses(documents(spark, [])).count() == 0


def test_native_plans(spark):
    docs = documents(spark, [(1, "a\nb\nc"), (2, "a\nb\nc")])
    for df in (lines.dedup_lines(docs), licenses.scan_licenses(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_components_of_a_long_chain(spark):
    from cairn.llm.common import components

    nodes = spark.range(200).union(spark.range(500, 503)).select(F.col("id"))
    edges = spark.range(199).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(501, 500), (501, 502)], "a long, b long"))
    assert {(r.id, r.root) for r in components(nodes, edges).collect()} == {(i, 0) for i in range(200)} | {(i, 500) for i in range(500, 503)}
