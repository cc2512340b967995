from __future__ import annotations

import random
import zlib

import numpy as np

from .helpers import DOC, prose, words


def _labels(rows):
    return "doc_id long, quality int, toxic int", rows


def _held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def _auc(score, y):
    a, b = [s for s, t in zip(score, y, strict=True) if t], [s for s, t in zip(score, y, strict=True) if not t]
    return np.mean([(p > n) + 0.5 * (p == n) for p in a for n in b])


def _toxic_set(seed=1, n=400):
    rng = random.Random(seed)
    bad = ["idiot", "scum", "moron"]
    docs, labels = [], []
    for i in range(n):
        w = prose(rng, rng.randrange(20, 80)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((i, " ".join(w), "en", "s", 0, "x"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_held_out_and_disguises(spark):
    from eventloom.llm.toxicity import reject, score, train

    docs, labels = _toxic_set()
    extra = ["you 1d10t really", "you i.d.i.o.t really", "what a s c u m here", "such a morooooon here", "M0R0N!!!", "fine clean words here", None, "", "x" * 20_000, "1234 ... $$$"]
    rows = docs + [(9000 + i, t, "", "", 0, "x") for i, t in enumerate(extra)] + [(None, "scum", "", "", 0, "x")]
    df = spark.createDataFrame(rows, DOC)
    lab = spark.createDataFrame(labels, _labels([])[0])
    model = train(df, lab)
    got = {r.doc_id: r for r in score(df, model).collect()}
    held = [x for x in labels if _held(x[0])]
    assert _auc([got[i].score for i, _, _ in held], [t for *_, t in held]) > 0.97
    assert [got[9000 + i].predicted for i in range(len(extra))] == [1] * 5 + [0] * 5
    assert all(got[i].held_out == _held(i) for i in range(400)) and not got[None].held_out and got[None].predicted == 1
    kept = reject(df, model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score < 0.5}


def _channel():
    from eventloom.llm import toxicity as x

    text = "you are a worthless idiot and a pathetic moron or clown with all the other people of this town who call that good food better than a letter from the little moor " * 20
    c = x._CLASS[np.frombuffer(text.encode(), np.uint8)].astype(int)
    c = np.concatenate([[0, 0], c, [0]])
    return x.Channel(np.bincount((c[:-2] << 10) | (c[1:-1] << 5) | c[2:], minlength=x.CLASSES**3).reshape(x.CLASSES, x.CLASSES, x.CLASSES))


def _features(text):
    from eventloom.llm.toxicity import _tokens, features

    channel = _channel()
    return set().union(*(features(t, channel) for t in _tokens(text)))


def test_toxicity_reads_long_tokens_to_the_end():
    assert "idiot" in _features("y o u a r e a w o r t h l e s s i d i o t")
    assert "idiot" in _features("idi" + "o" * 60 + "t")
    assert {"pathetic", "idiot", "clown"} <= _features("you-are-a-pathetic-worthless-1d10t-and-clown")
    assert "moron" in _features("people-of-this-town-" * 400 + "m0r0n")


def test_toxicity_reads_around_any_sign():
    for text in ("“idiot”", "idiot…", "idiot—you", "idiot&clown", "‘idiot’", "a=idiot%", "«“idiot”»,", "1d10t—you", "“1d10t”", "i—d—i—o—t"):
        assert "idiot" in _features(text), text
    assert {"clown", "clow^"} <= _features("idiot&clown")


def test_toxicity_reads_spelled_and_doubled_words():
    for text in ("i d i o t.", "you are an i d i o t! really", "it's i d i o t, clown", "(i d i o t)", "“i d i o t”", "i.d.i.o.t.", "i-d-i-o-t; no", "iddiioott", "idiott", "IIDDIIOOTT!"):
        assert "idiot" in _features(text), text
    assert "moron" in _features("m o r o n! ")
    assert {"letter", "good"} <= _features("good letter")


def test_models_ignore_held_out_labels(spark):
    from eventloom.llm.toxicity import score, train

    docs, labels = _toxic_set(n=150)
    df = spark.createDataFrame(docs, DOC)
    a = score(df, train(df, spark.createDataFrame(labels, _labels([])[0]))).collect()
    turned = [(i, q, 1 - t if _held(i) else t) for i, q, t in labels] + [(None, 1, 1), (3, None, None)]
    b = score(df, train(df, spark.createDataFrame(turned, _labels([])[0]))).collect()
    assert {r.doc_id: r.score for r in a} == {r.doc_id: r.score for r in b}


def test_toxicity_without_labels(spark):
    from eventloom.llm.toxicity import score, train

    df = spark.createDataFrame(_toxic_set(n=10)[0], DOC)
    none = spark.createDataFrame([], _labels([])[0])
    assert {r.predicted for r in score(df, train(df, none)).collect()} == {0}
    assert score(df.limit(0), train(df.limit(0), none)).count() == 0


def _quality_set(n=400):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        text = prose(rng, rng.randrange(5, 90))
        good = i % 3 != 0
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split()) if i % 2 else " ".join(w + rng.choice(["$$$", "%%%"]) for w in text.split())
        docs.append((i, text, "en", "s", 0, "x"))
        labels.append((i, int(good), 0))
    return docs, labels


def test_quality_held_out(spark):
    from eventloom.llm.quality import score, train

    docs, labels = _quality_set()
    df = spark.createDataFrame(docs + [(900, None, "", "", 0, ""), (901, "", "", "", 0, ""), (None, "x" * 9000, "", "", 0, "")], DOC)
    lab = spark.createDataFrame(labels, _labels([])[0])
    got = {r.doc_id: r for r in score(df, train(df, lab)).collect()}
    held = [x for x in labels if _held(x[0])]
    assert _auc([got[i].score for i, _, _ in held], [q for _, q, _ in held]) > 0.97
    assert len(got) == len(docs) + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    none = spark.createDataFrame([], _labels([])[0])
    assert score(df, train(df, none)).count() == len(docs) + 3
    assert score(df.limit(0), train(df.limit(0), lab)).count() == 0


def test_machine_equals_its_formula():
    from eventloom.llm import quality as q

    rng = np.random.default_rng(0)
    m = q.Machine(0.3, rng.normal(size=q._N), rng.normal(size=(q._N, 4)), np.zeros(len(q.STATS)), np.ones(len(q.STATS)))
    col, x = np.array([3, 70, 900, q._WORDS + 1]), np.array([0.5, 1.0, -0.2, 0.7])
    z = 0.3 + m.w[col] @ x + sum(m.v[col[i]] @ m.v[col[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert np.isclose(m.raw(np.zeros(4, int), col, x, 1)[0], z)


def _bag(s):
    out = {}
    for x in s:
        out[x] = out.get(x, 0) + 1
    return out


def _similarity(a, b):
    a, b = _bag(a), _bag(b)
    same = sum(min(n, b.get(x, 0)) for x, n in a.items())
    return same / (sum(a.values()) + sum(b.values()) - same)


def _grams(w, k=5):
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)]


def test_decontamination_equals_brute_force(spark):
    from eventloom.llm.decontaminate import clean_documents, find_leaks

    rng = random.Random(8)
    items = [(i, prose(rng, rng.randrange(6, 70))) for i in range(14)] + [(20, "a b c"), (21, None), (22, ""), (None, "lost item of six words here"), (23, "re re re re re re re re re re re re")]
    items.append((24, items[0][1].upper()))
    docs = []
    for i in range(60):
        w = prose(rng, rng.randrange(10, 60)).split()
        it = items[i % 14][1].split()
        if i % 3 == 0:
            at = rng.randrange(len(w))
            it = list(it)
            if i % 2:
                it[-1 if i % 4 == 1 else 0] = "changed"
            if i % 9 == 0 and len(it) > 45:
                it[rng.randrange(5, len(it) - 5)] = "swap"
            w[at:at] = it
        docs.append((i, " ".join(w), "", "", 0, ""))
    docs += [(100, None, "", "", 0, ""), (101, "", "", "", 0, ""), (102, "a b c", "", "", 0, ""), (103, items[3][1], "", "", 0, ""), (103, items[3][1], "", "", 0, ""), (None, items[3][1], "", "", 0, ""), (104, prose(rng, 8000) + " " + items[5][1].upper(), "", "", 0, "")]
    docs.append((105, " ".join(items[6][1].split()[:-1]), "", "", 0, ""))
    df, bench = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in find_leaks(df, bench).collect()}
    want = {}
    for i, t, *_ in docs:
        d = [x.decode().lower() for x in words(t)]
        for j, it in items:
            w = [x.decode().lower() for x in words(it)]
            if not d or not w or i is None or j is None:
                continue
            n = min(len(w), len(d))
            best = max(_similarity(_grams(d[s : s + n]), _grams(w)) for s in range(len(d) - n + 1))
            if best >= 0.8:
                want[i, j] = best
    assert len(want) > 20 and any(s < 1 for s in want.values())
    assert got == want
    kept = clean_documents(df, bench)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d[0]) for d in docs if d[0] not in {i for i, _ in want})
    assert find_leaks(df.limit(0), bench).count() == 0 and find_leaks(df, bench.limit(0)).count() == 0


def _brute_leaks(docs, items):
    want = {}
    for i, t, *_ in docs:
        d = [x.decode().lower() for x in words(t)]
        for j, it in items:
            w = [x.decode().lower() for x in words(it)]
            n = min(len(w), len(d))
            best = max(_similarity(_grams(d[s : s + n]), _grams(w)) for s in range(len(d) - n + 1))
            if best >= 0.8:
                want[i, j] = best
    return want


def test_decontamination_finds_reordered_items(spark):
    """Blocks moved far inside an item cost only the shingles at their seams."""
    from eventloom.llm.decontaminate import find_leaks

    rng = random.Random(5)
    items = [(i, " ".join(f"item{i}word{j}" for j in range(n))) for i, n in enumerate((45, 50, 60, 200))] + [(4, prose(rng, 90))]
    docs = []
    for i, it in items:
        w = it.split()
        for c in (len(w) // 2, len(w) // 3, len(w) - 10):
            docs.append((len(docs), " ".join([prose(rng, 70), *w[c:], *w[:c], prose(rng, 70)]), "", "", 0, ""))
        c = len(w) // 3
        docs.append((len(docs), " ".join([prose(rng, 9), *w[2 * c :], *w[c : 2 * c], *w[:c], prose(rng, 30)]), "", "", 0, ""))
    want = _brute_leaks(docs, items)
    assert {(0, 0), (4, 1), (8, 2), (12, 3), (15, 3), (16, 4)} <= set(want)
    got = find_leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.similarity for r in got.collect()} == want


def test_decontamination_finds_short_items_in_longer_documents(spark):
    from eventloom.llm.decontaminate import find_leaks

    items = [(0, "a b c"), (1, "lone"), (2, "one two three four"), (3, "five words are one shingle")]
    texts = ["x y a b c z w", "a b", "A b C", "c b a b c", "the lone word", "lone", "one two three four five six", "zero one two three", "lone a b c lone", "so five words are one shingle it is"]
    docs = [(i, t, "", "", 0, "") for i, t in enumerate(texts)]
    got = find_leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.similarity for r in got.collect()} == dict.fromkeys([(0, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, 2), (8, 0), (8, 1), (9, 3)], 1.0)


def test_decontamination_at_the_edge_of_similarity(spark):
    """Items of 15, 30 and 60 words, each edited at one end to the least similarity that still counts: all are found, well inside the radius."""
    from eventloom.llm.decontaminate import RADIUS, find_leaks

    rng = random.Random(21)
    items, docs = [], []
    for i in range(60):
        n = (15, 30, 60)[i % 3]
        w = [f"{x}{rng.randrange(10_000)}" for x in prose(rng, n).split()]
        items.append((i, " ".join(w)))
        cut = (n - 4) // 9
        w[:cut] = [f"odd{rng.randrange(10**6)}" for _ in range(cut)]
        docs.append((i, " ".join([*prose(rng, 30).split(), *w, *prose(rng, 30).split()]), "", "", 0, ""))
    got = {(r.doc_id, r.item_id): r for r in find_leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(i, i) for i in range(60)}
    assert min(r.similarity for r in got.values()) < 0.84 and max(r.distance for r in got.values()) <= RADIUS - 4


def test_decontamination_stays_native(spark):
    from eventloom.llm.decontaminate import find_leaks

    df = spark.createDataFrame([(1, "a b c d e f", "", "", 0, "")], DOC)
    plan = find_leaks(df, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_toxicity_stage_with_clashing_columns(spark):
    from eventloom.llm import toxicity

    model = toxicity.Model(-1.0, {"scum": 5.0}, toxicity.Channel(np.zeros((32, 32, 32))))
    docs = spark.createDataFrame([(1, "you scum", 0.1, 0.2), (2, "you", 0.3, 0.4)], ["doc_id", "TEXT", "_score", "score"])
    assert [tuple(r) for r in toxicity.reject(docs, model).collect()] == [(2, "you", 0.3, 0.4)]


def test_toxicity_of_repeated_ids_is_bounded(spark):
    """Repeated rows of one id are one row of the sample."""
    from eventloom.llm.training import labelled_sample

    docs = spark.createDataFrame([(1, "a"), (1, "b"), (1, None), (2, None), (4, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in (1, 1, 2, 4)], "doc_id long, toxic int")
    got = sorted(tuple(r) for r in labelled_sample(docs, labels, "toxic").collect())
    assert got == [x for x in [(1, "b", 1), (2, "", 1), (4, "c", 1)] if zlib.crc32(str(x[0]).encode()) % 5]
