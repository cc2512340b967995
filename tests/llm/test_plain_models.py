"""The trained operators against plain loops: all paths of a lattice, dense fits, every text by itself."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np

from .helpers import DOC, prose


def _channel(seed=1):
    from eventloom.llm.toxicity import CLASSES, Channel

    rng = np.random.default_rng(seed)
    return Channel(rng.integers(0, 50, (CLASSES, CLASSES, CLASSES)) ** 2)


def _all_paths(channel, word):
    """Every reading of a word with its score, each arc taken and not taken."""
    from eventloom.llm.toxicity import LEET, SEPARATORS

    word = word.lower()
    steps = []
    for k, ch in enumerate(word):
        arcs = []
        if ch.isalpha():
            arcs.append((ch, 0.0))
            if k and ch == word[k - 1]:
                arcs.append(("", -0.5))
        if ch in LEET:
            arcs += [(x, -1.0) for x in LEET[ch]]
        if ch in SEPARATORS or not arcs:
            arcs += [("", -0.3), (" ", -1.5)]
        steps.append(arcs)
    for choice in itertools.product(*steps):
        score, a, b = 0.0, 0, 0
        for x, cost in choice:
            score += cost
            if x:
                c = channel._class(x)
                score += channel.logp[a][b][c]
                a, b = b, c
        yield score + channel.logp[a][b][0], "".join(x for x, _ in choice).strip() or None


def test_lattices_equal_all_their_paths():
    rng = random.Random(3)
    words = ["1d10t", "a$$h0le", "f.o.o", "sccuumm", "s-c_u*m", "h3ll00", "@@", "b4d!", "éa1", "aabb", "aabbccdd", "x.y..z", "!!", "l33t$p3", "aaaa1", "(b)ad"]
    words += ["".join(rng.choice("abxs013$@!.-_*é") for _ in range(rng.randrange(1, 8))) for _ in range(120)]
    for seed in (1, 2):
        channel = _channel(seed)
        for w in words:
            paths = list(_all_paths(channel, w))
            best = max(s for s, _ in paths)
            assert channel.restore(w) in {p for s, p in paths if s >= best - 1e-9}, w


def test_scores_are_sums_over_distinct_features(spark):
    """score() of a table equals a sum over each text's features, decoded without any memory of tokens."""
    from eventloom.llm import toxicity

    rng = random.Random(8)
    channel = _channel()
    texts = [prose(rng, rng.randrange(1, 60)) + rng.choice(["", " 1d10t", " s c u m", " b4d!!", "\nNO $h1t"]) for _ in range(50)] + [None, "", " \n", "x" * 500, "i d i o t you"] * 2
    pool = sorted({f for t in texts for tok in toxicity._tokens(t or "") for f in toxicity.features(tok, channel)})
    weights = {f: rng.random() * 3 for f in rng.sample(pool, len(pool) // 3)}
    model = toxicity.Model(-2.0, weights, channel)

    def plain(text):
        found = set().union(*[toxicity.features(tok, channel) for tok in toxicity._tokens(text or "")])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, -2.0 + sum(weights[f] for f in sorted(found & set(weights)))))))

    docs = spark.createDataFrame([(i, t, "en", "s", 0, "") for i, t in enumerate(texts)], DOC).repartition(3)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert abs(got[i].score - plain(t)) < 1e-12 and got[i].predicted == int(plain(t) >= 0.5)


def test_linear_fit_is_a_dense_loop():
    from eventloom.llm.toxicity import _fit_linear

    rng = np.random.default_rng(4)
    x = (rng.random((40, 9)) < 0.3).astype(float)
    y = (x[:, 0] + x[:, 3] + 0.3 * rng.standard_normal(40) > 0.5).astype(float)
    w, m, v = np.zeros(10), np.zeros(10), np.zeros(10)
    xs = np.hstack([x, np.ones((40, 1))])
    for t in range(1, 301):
        g = xs.T @ ((1 / (1 + np.exp(-(xs @ w))) - y) / 40)
        g[:9] += 2e-3 * w[:9] / 10
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    b, got = _fit_linear([list(np.flatnonzero(r)) for r in x], y, 9)
    assert np.allclose(got, w[:9], atol=1e-8) and abs(b - w[9]) < 1e-8


def test_machine_fit_is_a_loop_over_pairs(monkeypatch):
    """The fit equals one that adds up every pair of columns, row by row, on a small machine."""
    from eventloom.llm import quality

    words, stats, rank = 6, len(quality.STATS), 2
    monkeypatch.setattr(quality, "_WORDS", words)
    monkeypatch.setattr(quality, "_N", words + stats)
    n, total = 12, words + stats
    rng = np.random.default_rng(6)
    parts = []
    for _ in range(n):
        cells = np.sort(rng.choice(words, rng.integers(0, 4), replace=False))
        parts.append((cells, rng.random(len(cells)), rng.random(stats)))
    y = (rng.random(n) < 0.5).astype(float)
    y[0], y[1] = 0, 1
    got = quality.fit(parts, y, rank=rank, epochs=3, batch=5, seed=7)

    order = np.random.default_rng(7)
    s = np.stack([p[2] for p in parts])
    mean, scale = s.mean(0), np.maximum(s.std(0), 1e-3)
    x = np.zeros((n, total))
    for i, (c, v, z) in enumerate(parts):
        x[i, c] = v
        x[i, words:] = (z - mean) / scale / np.sqrt(stats)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w0, w, v = np.log(share / (1 - share)), np.zeros(total), order.normal(0, 0.02, (total, rank))
    gw, gv, g0 = np.full(total, 1e-4), np.full((total, rank), 1e-4), 1e-4
    for _ in range(3):
        o = order.permutation(n)
        for lo in range(0, n, 5):
            at = o[lo : lo + 5]
            e, dw, dv, used = [], np.zeros(total), np.zeros((total, rank)), np.zeros(total, bool)
            for i in at:
                z = w0 + x[i] @ w + sum(v[a] @ v[b] * x[i, a] * x[i, b] for a in range(total) for b in range(a))
                err = 1 / (1 + np.exp(-z)) - y[i]
                e.append(err)
                dw += err * x[i] / len(at)
                for a in range(total):
                    dv[a] += err * x[i, a] * sum((v[b] * x[i, b] for b in range(total) if b != a), np.zeros(rank)) / len(at)
                used[parts[i][0]] = used[words:] = True
            dw, dv = (dw + 1e-5 * w) * used, (dv + 1e-5 * v) * used[:, None]
            gw, gv, g0 = gw + dw**2, gv + dv**2, g0 + np.mean(e) ** 2
            w, v, w0 = w - 0.08 * dw / np.sqrt(gw), v - 0.04 * dv / np.sqrt(gv), w0 - 0.08 * np.mean(e) / np.sqrt(g0)
    assert np.allclose(got.w, w, atol=1e-9) and np.allclose(got.v, v, atol=1e-9) and abs(got.w0 - w0) < 1e-9


def test_quality_scores_do_not_depend_on_neighbours(spark):
    """Every row of a table scores as its text does alone, repeated rows, blank and very long texts included."""
    from eventloom.llm import quality

    rng = np.random.default_rng(2)
    model = quality.Machine(-0.3, rng.normal(0, 1, quality._N), rng.normal(0, 0.2, (quality._N, 3)), np.full(len(quality.STATS), 0.2), np.full(len(quality.STATS), 0.5))
    prng = random.Random(4)
    texts = [prose(prng, prng.randrange(1, 80)).upper() if i % 5 == 0 else prose(prng, prng.randrange(1, 80)) for i in range(40)] + [None, "", "  \n\t ", "y" * 200_000, prose(prng, 4000), "é ü 漢"] * 2
    rows = [(i, t, "en", "s", 0, "") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 0, "")]
    got = sorted((r.doc_id, r.score, r.predicted) for r in quality.score(spark.createDataFrame(rows, DOC).repartition(2), model).collect())
    want = []
    for i, t, *_ in rows:
        data = np.frombuffer((t or "").encode(), np.uint8)
        s = float(model.predict(data, np.array([0, len(data)]), 1)[0])
        want.append((i, s, int(s >= 0.3)))
    assert [(a, c) for a, _, c in got] == [(a, c) for a, _, c in sorted(want)]
    assert max(abs(a[1] - b[1]) for a, b in zip(got, sorted(want), strict=True)) < 1e-9
