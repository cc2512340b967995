from __future__ import annotations

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from .helpers import DOC, components, corpus, prose, words


def _shingles(text, k):
    w = words(text, lower=True)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_ngram_join_equals_brute_force(spark, k, num):
    from eventloom.llm.ngram_join import jaccard_components

    rows = corpus()
    sets = {r[0]: _shingles(r[1], k) for r in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = jaccard_components(spark.createDataFrame(rows, DOC), k, num, 100).collect()
    assert len(links) > 5
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), want[i]) for i, s in sets.items()}


def test_ngram_join_edges(spark):
    from eventloom.llm.ngram_join import jaccard_components

    assert jaccard_components(spark.createDataFrame([], DOC)).count() == 0
    rows = [(1, "a b c d e f", "", "", 0, ""), (1, "a b c d e f", "", "", 0, ""), (None, "a b c d e f", "", "", 0, ""), (2, "A B C D E F", "", "", 0, "")]
    got = sorted(jaccard_components(spark.createDataFrame(rows, DOC)).collect(), key=str)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == [(1, 1), (1, 1), (2, 1), (None, None)]


def test_ngram_join_of_two_texts_under_one_id(spark):
    """Classes are sets: a document like the second text of an id is linked with it, whichever text comes first."""
    from eventloom.llm.ngram_join import jaccard_components

    a, b = prose(random.Random(31), 80), prose(random.Random(32), 80)
    near = " ".join([*b.split()[:-1], "odd"])
    for rows in ([(1, a), (1, b), (2, near)], [(2, near), (1, b), (1, a)], [(1, a), (1, b), (2, near), (3, a), (3, near), (4, prose(random.Random(33), 80))]):
        rows = [(i, t, "", "", 0, "") for i, t in rows]
        want = components(range(len(rows)), [(x, y) for x, y in itertools.combinations(range(len(rows)), 2) if 100 * len(_shingles(rows[x][1], 3) & _shingles(rows[y][1], 3)) >= 90 * len(_shingles(rows[x][1], 3) | _shingles(rows[y][1], 3))])
        least = {c: min(rows[x][0] for x in want if want[x] == c) for c in want.values()}
        got = jaccard_components(spark.createDataFrame(rows, DOC), 3, 90, 100).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((rows[x][0], len(_shingles(rows[x][1], 3)), least[c]) for x, c in want.items())


def test_embeddings_of_two_vectors_under_one_id(spark):
    from eventloom.llm.embedding_dedup import near_duplicates

    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.001]), (3, [0.001, 1.0]), (3, [0.001, 1.0]), (4, [-1.0, -1.0])]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (3, 2, 1), (4, 0, 4)]


def test_ngram_join_hot_group(spark):
    """A long chain of near copies stays one component though its ends are far apart."""
    from eventloom.llm.ngram_join import jaccard_components

    base = prose(random.Random(3), 200).split()
    rows = []
    for i in range(40):
        w = list(base)
        for j in range(i + 1):
            w[(j * 5) % 200] = f"new{j}"
        rows.append((i, " ".join(w), "", "", 0, ""))
    sets = {r[0]: _shingles(r[1], 3) for r in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, DOC), 3, 90, 100).collect()}
    assert got == components(sets, links)


def _kept_tables(monkeypatch):
    """Ids in every table of these names that the join writes."""
    from eventloom.llm import ngram_join

    seen, write = {"met": [], "sets": []}, ngram_join.materialize

    def keep(df, name):
        out = write(df, name)
        if name in seen:
            seen[name] += [r.id for r in out.select("id").distinct().collect()]
        return out

    monkeypatch.setattr(ngram_join, "materialize", keep)
    return seen


def test_ngram_join_ships_sets_of_likely_links_only(spark, monkeypatch):
    """Pairs a little below the threshold share prefix tokens under every order; their sets stay where they are."""
    from eventloom.llm.ngram_join import jaccard_components

    seen, rows = _kept_tables(monkeypatch), []
    for i in range(20):
        w = [f"w{i}x{j}" for j in range(400)]
        near, at = list(w), [j * 30 + 5 for j in range(12 if i % 4 else 3)]  # similarity 0.83, every fourth 0.96
        for j in at:
            near[j] = f"odd{i}x{j}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(near))]
        # Short texts repeat what differs, so that it is more common than what the two share.
        parts = " ".join(f"{' '.join(x[j - 2 : j + 3])} cut{i}x{j}" for j in at for x in (w, near))
        rows += [(100 + 3 * i + h, parts + "".join(f" fill{i}x{h}x{j}" for j in range(n))) for h, n in enumerate((30, 80, 150)) if i % 4]
    docs = spark.createDataFrame([(i, t, "", "", 0, "") for i, t in rows], DOC)
    got = {r.doc_id: r.component_id for r in jaccard_components(docs, 3, 90, 100).collect()}
    assert got == {i: i - 1 if i < 40 and i % 8 == 1 else i for i, _ in rows}
    assert set(range(40)) <= set(seen["met"])
    assert sorted(seen["sets"]) == [i for i in range(40) if i % 8 < 2]


def test_ngram_join_postings_need_a_class_of_a_size_that_fits(spark, monkeypatch):
    """A short text that a long one quotes meets nothing, though both prefixes hold its rarest tokens."""
    from eventloom.llm.ngram_join import jaccard_components

    seen = _kept_tables(monkeypatch)
    short, common = " ".join(f"s{j}" for j in range(100)), " ".join(f"c{j}" for j in range(200))
    texts = [short, f"{short} {common}", *(f"{common} " + " ".join(f"m{i}x{j}" for j in range(100)) for i in range(5))]
    got = jaccard_components(spark.createDataFrame([(i, t, "", "", 0, "") for i, t in enumerate(texts)], DOC), 3, 90, 100).collect()
    assert all(r.doc_id == r.component_id for r in got)
    assert not {0, 1} & set(seen["met"])


@pytest.mark.parametrize("num", [40, 80, 90])
def test_parity_bits_lose_no_link(spark, num):
    """Sets at the threshold pass, also where their bits have unequal lengths; most well below it do not."""
    from eventloom.llm.ngram_join import _near, _parity

    rng, rows = np.random.default_rng(num), []
    for n in (1, 2, 31, 32, 33, 64, 65, 100, 127, 128, 129, 500, 512, 513, 900):
        for _ in range(6):
            pool = np.unique(rng.integers(0, 1 << 64, 4 * n + 8, dtype=np.uint64))
            rng.shuffle(pool)
            least = -(-num * n // 100)
            small = int(rng.integers(least, n + 1))  # of the longer set's n
            for a, b in ((pool[:n], pool[:small]), (pool[:n], pool[n - -(-num * (n + small) // (100 + num)) :][:small]), (pool[:n], pool[n // 2 :][:small])):
                both = len(np.intersect1d(a, b))
                rows.append((100 * both >= num * (len(a) + len(b) - both), n, *((len(x), _parity(x).tolist()) for x in (a, b))))
    rows = [(link, n, *a, *b) for link, n, a, b in rows] + [(link, n, *b, *a) for link, n, a, b in rows]
    got = spark.createDataFrame(rows, "link boolean, n int, an long, ap array<long>, bn long, bp array<long>").selectExpr("link", "n", f"{_near(num, 100)} as near").collect()
    assert all(r.near for r in got if r.link) and sum(r.link for r in got) > len(got) / 4
    apart = [r.near for r in got if not r.link and r.n >= 100]
    assert num < 80 or sum(apart) < len(apart) / 4


def test_embeddings_recall_and_edges(spark):
    from eventloom.llm.embedding_dedup import near_duplicates

    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 16))
    for g in range(20):
        x[g * 10 + 1 : g * 10 + 6] = x[g * 10] + 0.04 * rng.standard_normal((5, 16))
    x[300:330] = x[300]
    rows = [(i, v.astype("f4").tolist(), 0) for i, v in enumerate(x)]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [1.0, None] * 8, 0), (1004, [float("inf")] * 16, 0), (1005, [], 0), (1006, [1.0, 2.0], 0), (None, x[0].tolist(), 0)]
    got = {r.vec_id: r for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 0.95, leaf_rows=40).collect()}
    f = x.astype("f4").astype("f8")
    u = f / np.linalg.norm(f, axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    want = link.sum(1)
    n = np.array([got[i].n_links for i in range(600)])
    assert (n <= want).all()
    assert n.sum() >= 0.95 * want.sum()
    comp = components(range(600), zip(*np.nonzero(link), strict=True))
    assert np.mean([got[i].component_id == comp[i] for i in range(600)]) > 0.97
    for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].n_links == 0 and got[None].component_id is None
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embedding_blocks(spark, monkeypatch):
    from eventloom.llm import embedding_dedup as e

    monkeypatch.setattr(e, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = rng.standard_normal(12)
    x = base + 0.02 * rng.standard_normal((80, 12))
    got = e.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), 0.95).collect()
    assert {r.n_links for r in got} == {79} and {r.component_id for r in got} == {0}


def _substring_brute(rows, window=13):
    first = {}
    for i, t in sorted((r[0], r[1]) for r in rows if r[0] is not None):
        w = words(t)
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), i)
    out = {}
    for i, t, *_ in rows:
        w = words(t)
        gone = set()
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("most", [1000, 10, 2])
def test_substring_equals_brute_force(spark, most, monkeypatch):
    """With groups of any size, with long ones lengthened, and with nearly every repeat a node that is broadcast."""
    from eventloom.llm import substring_dedup as s

    monkeypatch.setattr(s, "SPLIT_PLACES", most)
    monkeypatch.setattr(s, "SPLIT_PART", 10**6)
    rows = corpus(seed=2)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in s.digests(spark.createDataFrame(rows, DOC)).collect()}
    want = _substring_brute(rows)
    assert sum(x[1] for x in want.values()) > 300
    assert got == want


def test_substring_edges(spark):
    from eventloom.llm.substring_dedup import digests, remove_repeats

    assert digests(spark.createDataFrame([], DOC)).count() == 0
    t = " ".join(f"w{i}" for i in range(20))
    rows = [(5, t, "", "", 0, ""), (5, t, "", "", 0, ""), (None, t, "", "", 0, ""), (7, t + " tail", "", "", 0, "")]
    got = sorted(((r.doc_id or -1), r.n_removed) for r in digests(spark.createDataFrame(rows, DOC)).collect())
    assert got == [(-1, 0), (5, 0), (5, 0), (7, 20)]
    out = {r.doc_id: r.new_text for r in remove_repeats(spark.createDataFrame(rows, DOC)).collect()}
    assert out[7] == "tail" and out[5] is None


def test_subtrees_join_neighbours():
    from eventloom.llm.substring_dedup import _repeats

    word = lambda i: i.to_bytes(5, "little")
    run = b"".join(map(word, range(20)))
    assert _repeats([(7, 100, run), (3, 0, run[10:]), (9, 4, run[:75])], 13) == [(7, 102, 120), (9, 4, 19)]


def test_substring_stage_with_clashing_columns(spark):
    from eventloom.llm.substring_dedup import remove_repeats

    t = " ".join(f"w{i}" for i in range(20))
    names = ["doc_id", "text", "_id", "id", "spans", "n_removed", "new_text"]
    docs = spark.createDataFrame([(1, t, 1, 2, 3, 4, "x"), (2, t + " tail", 1, 2, 3, 4, "y")], names)
    out = remove_repeats(docs)
    assert out.columns[:-2] == names
    assert sorted((r[0], r[5], r[6], r[-2], r[-1]) for r in out.collect()) == [(1, 4, "x", 0, None), (2, 4, "y", 20, "tail")]


def test_components_of_a_path(spark):
    from eventloom.llm.common import connected_components

    e = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 90), (90, 95)], "src long, dst long")
    got = {r.id: r.comp for r in connected_components(e).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 90: 90, 95: 90, 100: 90}
    assert math.isclose(len(got), 54)


def _exchanges(spark, run) -> list[int]:
    """Exchanges in the plans, first and last, of each SQL execution that ``run`` starts."""
    store = spark._jsparkSession.sharedState().statusStore()

    def wait():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return store.executionsList().size()

    before = wait()
    run()
    n, every = wait(), store.executionsList()
    return [len(re.findall(r"^\(\d+\) (?:Broadcast|Reused)?Exchange", every.apply(i).physicalPlanDescription(), re.M)) for i in range(before, n)]


def test_components_plan_no_stage_many_times(spark):
    """The driver's memory goes with what it plans: no half of a round holds the half before it several times."""
    from eventloom.llm.common import connected_components

    e = spark.createDataFrame([(i, i + 1) for i in range(20)], "src long, dst long")
    found = _exchanges(spark, lambda: connected_components(e).collect())
    assert found and max(found) <= 8, found


def test_no_second_pass_without_pairs(spark, monkeypatch):
    """Copies alone leave no pairs for the second pass, so nothing of it is planned."""
    from eventloom.llm import ngram_join

    passes, verify = [], ngram_join._verify
    monkeypatch.setattr(ngram_join, "_verify", lambda *a: passes.append(1) or verify(*a))
    rng = random.Random(5)
    texts = [prose(rng, 40) for _ in range(6)]
    docs = spark.createDataFrame([(i, texts[i % 6]) for i in range(12)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs, 3, 90, 100).collect()} == {i: i % 6 for i in range(12)}
    assert len(passes) == 1


def test_long_runs_sort_places_not_copies(monkeypatch):
    """The two ways of laying out a group agree, and 20,000 equal words stay far below a copy of every suffix."""
    import tracemalloc

    from eventloom.llm import substring_dedup as sd

    rng = random.Random(12)
    word = lambda x: x.to_bytes(sd.WORD_BYTES, "little")
    for _ in range(60):
        k = rng.randrange(1, 4)
        group = [(rng.randrange(4), rng.randrange(50), b"".join(word(rng.randrange(k)) for _ in range(rng.randrange(5, 60)))) for _ in range(rng.randrange(2, 6))]
        monkeypatch.setattr(sd, "SHORT_RUN", 10**9)
        want = sd._repeats(group, 5)
        monkeypatch.setattr(sd, "SHORT_RUN", 0)
        assert sd._repeats(group, 5) == want
    monkeypatch.undo()
    group = [(1, 0, word(7) * 20_000), (2, 3, word(7) * 20_000)]
    tracemalloc.start()
    assert sd._repeats(group, 13) == [(2, 3, 20_003)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000


def test_substring_dedup_of_texts_of_few_words(spark):
    from eventloom.llm.substring_dedup import digests

    texts = ["word " * 20_000, "word " * 12, "a b " * 4000, "b a " * 3000, "word " * 15_000, "x " + "word " * 300]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in digests(spark.createDataFrame([(i, t, "", "", 0, "") for i, t in enumerate(texts)], DOC)).collect()}
    assert got == {0: (20_000, 0), 1: (12, 0), 2: (8000, 0), 3: (6000, 6000), 4: (15_000, 15_000), 5: (301, 300)}
