"""Mixing, resampling and the filter audit against plain versions, with their edge cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from .helpers import DOC, prose, words

CLASH = "doc_id long, text string, source string, size long, row long, target double, words string, round int, pid int, part string, n long, mask int"
EXTRA = (9, 9, 9.0, "w", 9, 9, "p", 9, 9)


def docs_of(seed, n=150, sources=("a", "b", "B", "é", None)):
    """Documents of uneven sources, with copies, repeated rows, empty and long texts, a null id."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = prose(rng, rng.choice([1, 5, 30, 199, 200, 260]))
        if i % 6 == 0:
            text = text.upper() if i % 12 else text + " $#"
        if i % 5 == 0 and rows:
            text = rows[rng.randrange(len(rows))][1]
        rows.append((i, text, sources[0] if i % 3 == 0 else rng.choice(sources)))
    rows += [rows[7], rows[7], (n, None, "a"), (n + 1, "", "b"), (n + 2, " \t\n", None), (None, "word " * 50, "a"), (None, "word " * 50, "a"), (n + 3, prose(rng, 5000), "b"), (n + 4, "x" * 70000, "a"), (n + 5, rows[3][1], ""), (3, "another text under one id", "B")]
    rng.shuffle(rows)
    return [(*r, *EXTRA) for r in rows]


# ---------------------------------------------------------------- running totals


def test_running_total_spreads_a_hot_group(spark):
    from eventloom.llm.common import running_total

    rows = [(None if i % 3 else "hot", i, i % 7) for i in range(4000)] + [("z", 1, 5)]
    got = running_total(spark.createDataFrame(rows, "g string, o long, n long").repartition(7), ["g"], ["o"], "n", "upto")
    want, sums = {}, defaultdict(int)
    for g, o, n in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        sums[g] += n
        want[g, o] = sums[g]
    assert {(r.g, r.o): r.upto for r in got.collect()} == want
    assert got.select("g").filter("g is null").count() == sum(r[0] is None for r in rows)


# ---------------------------------------------------------------- mixing


def plain_mix(rows, weights=(3, 1, 2), share=1.5, cap=2):
    size = defaultdict(int)
    for _, text, source, *_ in rows:
        size[source] += len(words(text))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    held, budget = set(), share * sum(size.values())
    while True:
        free = sum(w[s] for s in names if s not in held)
        level = budget - sum(cap * size[s] for s in held)
        more = {s for s in names if s not in held and level * w[s] / free > cap * size[s]}
        if not more:
            break
        held |= more
    target = {s: float(cap * size[s]) if s in held else level * w[s] / free for s in names}
    taken = defaultdict(list)
    for s in names:
        served = 0
        for turn in range(cap):
            order = sorted(((hashlib.md5(f"mix:{turn}:{'' if i is None else i}".encode()).hexdigest(), i is not None, i or 0, len(words(t))) for i, t, src, *_ in rows if src == s and words(t)))
            for _, known, i, n in order:
                taken[i if known else None, s, n].append(max(0, min(n, math.floor(target[s]) - served)))
                served += n
    return size, target, taken


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_equals_plain_queues(spark, seed):
    from eventloom.llm.mixing import queue, taken_words

    rows = docs_of(seed)
    size, target, taken = plain_mix(rows)
    d = spark.createDataFrame(rows, CLASH)
    got = taken_words(d).collect()
    assert len(got) == len(rows)
    per = defaultdict(int)
    for r in got:
        per[r.source_size, r.target] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(words(t))) for i, t, *_ in rows)
    for s in size:
        assert (size[s], target[s]) in per
        assert sum(r.taken for r in got if (r.source_size, r.target) == (size[s], target[s])) == math.floor(target[s])
    # Each document's words, added up over equal rows.
    by_doc = defaultdict(int)
    for r in got:
        by_doc[r.doc_id, r.source_size, r.size] += r.taken
    assert dict(by_doc) == {(i, size[s], n): t for (i, s, n), t in ((k, sum(v)) for k, v in taken.items())} | {k: 0 for k in by_doc if k[2] == 0}
    # The mix in order: gapless, within the budget, every source at the same pace.
    _, _, mix = queue(d)
    m = sorted(mix.collect(), key=lambda r: r.total)
    assert [r.total - r.words for r in m] == [0, *[r.total for r in m[:-1]]]
    assert [r.finish for r in m] == sorted(r.finish for r in m) and m[-1].finish <= 1
    assert m[-1].total == sum(math.floor(t) for t in target.values())


def test_mix_reruns_and_empty(spark):
    from eventloom.llm.mixing import taken_words

    d = spark.createDataFrame(docs_of(3), CLASH)
    a, b = (sorted(map(str, taken_words(x).collect())) for x in (d, d.repartition(9, "text")))
    assert a == b
    assert taken_words(spark.createDataFrame([], DOC)).count() == 0
    none = taken_words(spark.createDataFrame([(1, None, "en", "s", 0, ""), (2, "  ", "en", None, 0, "")], DOC)).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in none) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


# ---------------------------------------------------------------- resampling

FEATURE = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, n=1):
    w = FEATURE.findall((text or "").encode().translate(bytes(b + 32 if 65 <= b < 91 else b for b in range(256))))
    return len(w), [b" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain_resample(rows, target, n=1, percent=10, least=20, seed=2024):
    bucket = lambda f: zlib.crc32(f) % 10000
    own = [(i, *plain_features(t, n)) for i, t, *_ in rows]
    s = Counter(bucket(f) for _, _, fs in own for f in fs)
    t = Counter(bucket(f) for x in target for f in plain_features(x, n)[1])
    s_all, t_all = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all)))
    out = []
    for i, m, fs in own:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), m >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    ranks = defaultdict(list)
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        ranks[tuple(r[:4])].append(k)
    return [(*r[:4], ranks[tuple(r[:4])].pop(0) if r[4] and ranks[tuple(r[:4])] else None) for r in out]


@pytest.mark.parametrize(("n", "range_rows", "fan"), [(1, 1 << 20, 64), (1, 5, 2), (3, 20, 3)])
def test_resample_equals_plain_sort(spark, monkeypatch, n, range_rows, fan):
    from eventloom.llm import resampling

    monkeypatch.setattr(resampling, "FAN_IN", fan)
    monkeypatch.setattr(resampling, "BLOCK", 4)
    rows = docs_of(4)
    target = [prose(random.Random(5), 300), None, "", "Ä ß 漢字 words"]
    d, t = spark.createDataFrame(rows, CLASH).repartition(9), spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    for percent in (10, 0, 100):
        got = resampling.resample(d, t, n=n, percent=percent, range_rows=range_rows)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, plain_resample(rows, target, n, percent)))


def test_resample_empty_sides(spark):
    from eventloom.llm.resampling import resample

    none = spark.createDataFrame([], "item_id long, text string")
    assert resample(spark.createDataFrame([], DOC), none).count() == 0
    rows = docs_of(6, 40)
    got = resample(spark.createDataFrame(rows, CLASH), none).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, plain_resample(rows, [])))


def test_crc_of_spans():
    from eventloom.llm.resampling import crc32s, features

    rng = random.Random(1)
    data = np.frombuffer(bytes(rng.randrange(256) for _ in range(5000)), np.uint8)
    starts = np.array([rng.randrange(4000) for _ in range(300)])
    ends = starts + np.array([rng.choice([0, 1, 3, 63, 64, 65, 900]) for _ in range(300)])
    assert crc32s(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
    texts = ["One two-three\x00four", None, "", "x" * 3000 + " Yé", "a b", "...", "c"]
    for n in (1, 2, 4):
        got = {}
        for lo, _, bounds, f in features(pa.array(texts), n):
            got |= {lo + i: sorted(f[bounds[i] : bounds[i + 1]].tolist()) for i in range(len(bounds) - 1)}
        assert got == {i: sorted(zlib.crc32(x) % 10000 for x in plain_features(t, n)[1]) for i, t in enumerate(texts)}


def test_tournament_is_a_merge():
    from eventloom.llm.resampling import tournament

    rng = random.Random(2)
    for k in (1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randrange(40) for _ in range(rng.randrange(30))) for _ in range(k)]
        got = list(tournament([(((x,), x) for x in run) for run in runs]))
        assert got == sorted(itertools.chain(*runs))


# ---------------------------------------------------------------- filter audit


def plain_audit(rows, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    masks = []
    for i, t, s, *_ in rows:
        t, w = t or "", words(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        masks.append((s or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out, shap = [], Counter()
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = lambda m, b=before: bool(m[1] & b)
                here = [m for m in own if f in m[1] and not gone(m)]
                shap[part, f] += len(here)
                out.append([part, order, k + 1, sum(not gone(m) and f not in m[1] for m in own), len(here), sum(f in m[1] and gone(m) for m in own), sum(m[1] == {f} for m in own), sum(m[2] for m in here), sum(m[3] for m in here)])
    return sorted((*r, shap[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_equals_plain_filters(spark):
    from eventloom.llm.filter_audit import audit

    rows = docs_of(7)
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 150, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (9999, 1, 1)]
    got = audit(spark.createDataFrame(rows, CLASH), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, labels)


def test_audit_edges(spark):
    from eventloom.llm.filter_audit import audit

    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(spark.createDataFrame([], DOC), none).count() == 0
    rows = [(1, None, "en", None, 0, ""), (1, "", "en", "", 0, ""), (2, "", "en", None, 0, ""), (2, "", "en", None, 0, "")]
    got = audit(spark.createDataFrame(rows, DOC), none).collect()
    assert len(got) == 600 and {r.part for r in got} == {""}
    assert {(r.kept, r.removed, r.redundant) for r in got if r.filter_order == "EABCD" and r.step == 1} == {(2, 2, 0)}
