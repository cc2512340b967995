"""run() against the same stages written plainly."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest

from .helpers import components, prose, words


def _write(spark, tmp_path, n=140):
    rng = random.Random(11)
    bench = [(i, prose(rng, 30)) for i in range(4)]
    passage = prose(rng, 60)
    docs, labels = [], []
    for i in range(n):
        text = prose(rng, rng.randrange(20, 120))
        toxic = i % 7 == 0
        if toxic:
            w = text.split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), ["idiot", "scum"][i % 2])
            text = " ".join(w)
        elif i % 11 == 0:
            text += " " + passage
        elif i % 13 == 0:
            text = text + " " + bench[i % 4][1] + " " + prose(rng, 5)
        elif i % 10 == 0 and i > 20 and (i - 3) % 7:
            text = docs[i - 3][1]
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(toxic)))
    docs += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (None, "a text without id", "en", "s", 17)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs, {i for i, _, t in labels if t}, bench


def _grams(w, k):
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] * bool(w)


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    from eventloom.llm.tokens import tokenizer_path

    docs, toxic, bench = _write(spark, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    rows = [(i, t) for i, t, *_ in docs if i not in toxic]
    known = {i: t for i, t in rows if i is not None}
    sets = {i: frozenset(_grams(words(t, True), 5)) for i, t in known.items()}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    assert links
    comp = components(sets, links)
    rows = [(i, t) for i, t in rows if i is None or comp[i] == i]
    first, out = {}, []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for g in _grams(words(t), 13) if len(words(t)) >= 13 else []:
            first.setdefault(g, i)
    for i, t in rows:
        w, gone = words(t), set()
        for j in range(len(w) - 12):
            if i is not None and first[tuple(w[j : j + 13])] < i:
                gone.update(range(j, j + 13))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone).decode() if gone else t
        if not (gone and kept == ""):
            out.append((i, kept))
    assert any(a != b for a, b in zip(rows, out, strict=False))

    def leaks(t):
        d = [x.decode().lower() for x in words(t)]
        for _, it in bench:
            g = [x.decode().lower() for x in words(it)]
            n = min(len(d), len(g))
            for s in range(len(d) - n + 1 if n else 0):
                a, b = _grams(d[s : s + n], 5), _grams(g, 5)
                same = sum(min(a.count(x), b.count(x)) for x in set(a))
                if 10 * same >= 8 * (len(a) + len(b) - same):
                    return True
        return False

    want = [(i, t) for i, t in out if i is None or not leaks(t)]
    assert len(want) < len(out)
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in want}
    mine = {}
    for r in got:
        mine.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.length))
    assert {i: sum((p for _, p, _ in sorted(x)), []) for i, x in mine.items()} == ids
    assert all(zlib.crc32(b"") == 0 and n == len(p) for x in mine.values() for _, p, n in x)


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    _write(spark, tmp_path, 40)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert (out.columns, [t for _, t in out.dtypes]) == (docs.columns, [t for _, t in docs.dtypes]), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0
