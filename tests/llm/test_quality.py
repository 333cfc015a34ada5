"""The quality classifier's features, forward pass, sample and held-out accuracy against a slow version."""

import math
import random
import zlib

import numpy as np

from cairn.llm import queries, quality, textkit


def kind(b):
    if b >= 0x80:
        return 7
    c = chr(b)
    for n, group in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\v\f\r", ".,;:'\"()-?")):
        if c in group:
            return n
    return 6


def bucket(word):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in word)
    return (int(textkit.words([low], textkit.SPACES, False)[0][0]) >> 40) % quality.BUCKETS


def slow(raw, more):
    """Features of one text's passages; `more`: the byte after the text."""
    whole = raw + more
    starts = [i for i in range(len(raw)) if raw[i] not in b" \t\n\v\f\r" and (i == 0 or raw[i - 1] in b" \t\n\v\f\r")]
    count = max(1, round(len(raw) / quality.PASSAGE))
    step = max(1, math.ceil(len(raw) / count))
    cuts = {next((s for s in starts if s >= j * step), None) for j in range(1, count)} - {None}
    edges = [0, *sorted(cuts - {0}), len(raw)]
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        row = [0.0] * quality.FEATURES
        own = raw[a:b].split()
        if b > a:
            for i in range(a, b):
                row[kind(whole[i]) * 8 + kind(whole[i + 1])] += 1 / (b - a)
            folded = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in own]
            n = max(1, len(own))
            row[64:68] = [sum(x == y for x, y in zip(folded, folded[1:], strict=False)) / n, len(set(folded)) / n, (b - a) / n / 10, math.log1p(b - a) / 10]
            for w in own:
                row[68 + bucket(w)] += 1 / n
        out.append(row)
    return np.array(out)


def texts():
    rng = random.Random(3)
    words = ["The", "the", "é", "語", "x" * 900, "42", "$$", "end.\n", "(a)", "-"]
    return ["", "   ", "a", "x" * 5000, " \n " * 500, *(" ".join(rng.choice(words) for _ in range(n)) for n in (1, 50, 700, 2000))]


def test_features():
    raw = [t.encode() for t in texts()]
    x, bounds = quality.passages(raw)
    assert len(bounds) == len(raw) + 1
    for i, r in enumerate(raw):
        expected = slow(r, b"\n")
        assert bounds[i + 1] - bounds[i] == len(expected)
        np.testing.assert_allclose(x[bounds[i] : bounds[i + 1]], expected, atol=1e-5)


def test_forward_pass():
    rng = np.random.default_rng(2)
    f, h, a = quality.FEATURES, quality.HIDDEN, quality.ATTENTION
    m = quality.Model(rng.normal(size=f), rng.random(f) + 0.5, rng.normal(size=(f, h)) / 9, rng.normal(size=h), rng.normal(size=(h, a)), rng.normal(size=(h, a)), rng.normal(size=a), rng.normal(size=h), rng.normal(size=1))
    bags = [rng.normal(size=(n, f)) for n in (1, 4, 2)]
    got = m.score(np.vstack(bags), np.array([0, 1, 5, 7]))
    for bag, p in zip(bags, got, strict=True):
        codes = [[math.tanh(sum((x[i] - m.mean[i]) / m.scale[i] * m.e[i, j] for i in range(f)) + m.eb[j]) for j in range(h)] for x in bag]
        gates = [sum(math.tanh(np.dot(c, m.v[:, k])) / (1 + math.exp(-np.dot(c, m.u[:, k]))) * m.a[k] for k in range(a)) for c in codes]
        share = [math.exp(g) / sum(map(math.exp, gates)) for g in gates]
        y = sum(s * np.dot(c, m.c) for s, c in zip(share, codes, strict=True)) + m.b[0]
        assert abs(p - 1 / (1 + math.exp(-y))) < 1e-9


def test_gradient_is_the_slope_of_the_loss(monkeypatch):
    """One step of training moves every weight against the numerical slope."""
    monkeypatch.setattr(quality, "EPOCHS", 1)
    rng = np.random.default_rng(5)
    bags, labels = [rng.normal(size=(n, quality.FEATURES)) for n in (3, 1, 2)], np.array([1.0, 0.0, 1.0])
    monkeypatch.setattr(quality, "RATE", 0.0)
    before = quality.train(bags, labels)
    before = before._replace(**{k: getattr(before, k) / (1 - 1e-4) for k in before._fields[2:]})
    monkeypatch.setattr(quality, "RATE", 1e-3)
    after = quality.train(bags, labels)
    bounds = np.array([0, 3, 4, 6])

    def loss(model):
        p = model.score(np.vstack(bags), bounds)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for name in before._fields[2:]:
        w = getattr(before, name)
        for at in list(np.ndindex(w.shape))[:: max(1, w.size // 7)]:
            d = np.zeros(w.shape)
            d[at] = 1e-5
            slope = (loss(before._replace(**{name: w + d})) - loss(before._replace(**{name: w - d}))) / 2e-5
            moved = getattr(after, name)[at] - w[at]
            assert abs(slope) < 1e-5 or moved * slope < 0


def test_every_passage_is_learnt_from(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda bags, labels, seed=7: seen.append(([len(b) for b in bags], labels.tolist())))
    docs = spark.createDataFrame([(i, "word and another. " * (40 * i)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    quality.fit(docs, labels)
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    sizes = {i: len(quality.passages([("word and another. " * (40 * i)).encode()])[0]) for i in ids}
    assert seen == [([sizes[i] for i in ids], [i % 2 for i in ids])] and max(seen[0][0]) > 60
    monkeypatch.setattr(quality, "SAMPLE_PASSAGES", 300)
    quality.fit(docs, labels)
    assert 0 < sum(seen[1][0]) <= 300 and set(seen[1][0]) <= set(sizes.values())


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op5_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").filter("quality IS NOT NULL"), "doc_id").filter("held_out").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert np.mean([r.predicted for r in good]) > 0.97 and np.mean([r.predicted for r in bad]) < 0.1
