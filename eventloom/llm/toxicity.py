"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over all documents.  Words that look
disguised (digits or signs among letters, letters spelled apart, letters doubled
or drawn out) become lattices: signs may stand for letters, separators may be dropped,
repeats may be one letter.  The best path under the character model is the
restored word.  A linear model over words and word beginnings, plain and
restored, gives the score; its vocabulary and weights are learnt from labels.
Words are learnt that MIN_DOCS toxic texts hold; texts that are near copies of
each other count there as one, and all rows of the sample are fitted on.

Defined results: null or empty text scores by the bias alone; repeated rows
score alike; a null doc_id is scored and not held out; other columns are
ignored by ``score`` and pass through ``reject``.
"""

from __future__ import annotations

import math
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, forget, lean, materialize, small_batches, text_chunks, trim, unused
from .training import SAMPLE_ROWS, labelled_sample

CLASSES = 32
OTHER, FOREIGN = 0, 27
#: Signs and the letters that they stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = " .-_*~'`,:;/\\^·"
#: After so many characters what all paths have in common is set aside: time and memory stay linear in the length.
SETTLE = 64
MEMORY = 100_000
_PUNCT = ".,;:!?\"'()[]{}<>|$%&*#@+-_=~/\\^`«»¡¿"
#: A run starts and ends at white space or signs, but not after the apostrophe of "it's".
_APART = re.compile(r"(?<![^\W_])(?<![^\W_]['’])[^\W_](?:[ .\-_*][^\W_]){2,}(?![^\W_])")
#: What every such run holds; found much faster.
_APART_HINT = re.compile(r"[ .\-_*](?<=[^\W_].)[^\W_][ .\-_*][^\W_](?![^\W_])")
_LETTERS = re.compile(r"[^\W\d_]+")
_DRAWN = re.compile(r"(.)\1")
MIN_DOCS = 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[0xC0:] = FOREIGN


def letter_counts(docs: DataFrame) -> np.ndarray:
    """Character trigram counts of all texts, CLASSES**3 cells."""

    def run(batches):
        total = np.zeros(CLASSES**3, np.int64)
        for b in batches:
            for _, _, data, _ in text_chunks(b.column("text")):
                c = _CLASS[data[(data & 0xC0) != 0x80]].astype(np.int32)
                c = np.concatenate([[0, 0], c, [0]]).astype(np.int32)
                total += np.bincount((c[:-2] << 10) | (c[1:-1] << 5) | c[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch({"cell": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    t = docs.select("text").mapInArrow(lean(run), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES**3, np.int64)
    out[t.column("cell").to_numpy()] = t.column("n").to_numpy()
    return out.reshape(CLASSES, CLASSES, CLASSES)


class Channel:
    """Decodes disguised words under a character model."""

    def __init__(self, counts: np.ndarray):
        n = counts.astype(float) + 0.2
        self.logp = np.log(n / n.sum(2, keepdims=True)).tolist()

    @staticmethod
    def _class(ch: str) -> int:
        if "a" <= ch <= "z":
            return ord(ch) - 96
        return FOREIGN if ord(ch) >= 0xC0 else OTHER

    def _doubled(self, word: str, doubles: list[int]) -> str:
        """restore() for letters alone, of which a few are doubled: all forms are scored."""
        best, forms = None, [(word, 0.0)]
        for i in reversed(doubles):
            forms += [(w[:i] + w[i + 1 :], cost - 0.5) for w, cost in forms]
        for form, cost in forms:
            a = b = 0
            for ch in form:
                c = ord(ch) - 96
                cost += self.logp[a][b][c]
                a, b = b, c
            cost += self.logp[a][b][0]
            if best is None or cost > best[0]:
                best = cost, form
        return best[1]

    def restore(self, word: str) -> str | None:
        """The likeliest letters behind a disguised word; None where there is nothing to decode."""
        word = word.lower()
        if word.isascii() and word.isalpha():
            doubles = [i for i in range(1, len(word)) if word[i] == word[i - 1]]
            if len(doubles) < 4:
                return self._doubled(word, doubles)
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        settled: list[str] = []
        for k, ch in enumerate(word):
            if k % SETTLE == SETTLE - 1:
                settled.append(os.path.commonprefix([p for _, p in states.values()]))
                states = {key: (s, p[len(settled[-1]) :]) for key, (s, p) in states.items()}
            arcs: list[tuple[str, float]] = []
            if ch.isalpha():
                arcs.append((ch, 0.0))
                if k and ch == word[k - 1]:
                    arcs.append(("", -0.5))
            if ch in LEET:
                arcs += [(x, -1.0) for x in LEET[ch]]
            if ch in SEPARATORS or not arcs:  # any sign not known otherwise separates too
                arcs += [("", -0.3), (" ", -1.5)]
            new: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, path) in states.items():
                for x, cost in arcs:
                    if x:
                        c = self._class(x)
                        key, s, p = (b, c), score + cost + self.logp[a][b][c], path + x
                    else:
                        key, s, p = (a, b), score + cost, path
                    if key not in new or new[key][0] < s:
                        new[key] = (s, p)
            states = new
        best = max(((s + self.logp[a][b][0], p) for (a, b), (s, p) in states.items()), default=(0, ""))[1]
        return ("".join(settled) + best).strip() or None


def disguised(word: str) -> bool:
    """Whether a word (stripped of outer punctuation, lower case) is worth decoding."""
    return not word.isalpha() and any(c.isalpha() for c in word) or _DRAWN.search(word) is not None


def _spelled(word: str) -> list[str]:
    """A plain word and its beginnings."""
    out = [word]
    if len(word) > 4:
        out += [f"{word[:4]}^", f"{word[:5]}^"]
    return out


def features(token: str, channel: Channel) -> set[str]:
    """What a white-space token contributes: the word or its runs of letters, their beginnings, and those of its restored form."""
    low = token.lower()
    core = low.strip(_PUNCT)
    if not core:
        core = low
    out = set(_spelled(core)) if core.isalpha() else {f for part in _LETTERS.findall(core) for f in _spelled(part)}
    if disguised(core) or (core != low and disguised(low) and not core.isalpha()):
        # Letters spelled apart may have a lone word before or after them.
        forms = [core] + [core[2:], core[:-2]] * (_APART.fullmatch(core) is not None and len(core) > 6)
        for back in filter(None, map(channel.restore, forms)):
            for word in back.split():
                out.update(_spelled(word))
    return out


def _tokens(text: str) -> set[str]:
    """Distinct tokens of a text, with runs of letters spelled apart as tokens of their own."""
    found = set(text.split())
    if _APART_HINT.search(text):
        found.update(m[0] for m in _APART.finditer(text))
    return found


class Memory:
    """What tokens contribute, kept for the tokens of late: of two generations the older is dropped when the newer is full."""

    def __init__(self, of, size: int = MEMORY):
        self.of, self.size, self.some, self.none, self.old_some, self.old_none = of, size, {}, set(), {}, set()

    def of_text(self, text: str | None) -> set:
        """All that the tokens of a text contribute."""
        tokens, out = _tokens(text or ""), set()
        tokens -= self.none
        tokens -= self.old_none
        for t in tokens:
            got = self.some.get(t) or self.old_some.get(t)
            if got is None and (got := self.of(t)):
                self.some[t] = got
            if got:
                out.update(got)
            else:
                self.none.add(t)
        if len(self.some) + len(self.none) >= self.size:
            self.old_some, self.old_none, self.some, self.none = self.some, self.none, {}, set()
        return out


class Model:
    """bias + sum of weights over the distinct features of a text, through a sigmoid."""

    def __init__(self, bias: float, weights: dict[str, float], channel: Channel):
        self.bias, self.weights, self.channel = bias, weights, channel
        self.forget()

    def __getstate__(self):
        return self.bias, self.weights, self.channel

    def __setstate__(self, state):
        self.__init__(*state)

    def forget(self) -> None:
        self.memory = Memory(lambda token: tuple(f for f in features(token, self.channel) if f in self.weights))

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights[f] for f in sorted(self.memory.of_text(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _fit_linear(rows: list[list[int]], y: np.ndarray, n: int, l2: float = 2e-3, steps: int = 300) -> tuple[float, np.ndarray]:
    """Logistic regression over presence features by full-batch gradient steps with momentum (Adam)."""
    idx = np.concatenate([np.array(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, b = np.zeros(n + 1), 0.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[idx], minlength=len(rows)) + w[n]
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.append(np.bincount(idx, e[row], minlength=n)[:n] + l2 * w[:n] / 10, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    b = float(w[n])
    return b, w[:n]


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> Model:
    """Character model from all ``docs``; vocabulary and weights from at most ``limit`` labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    small_batches(spark)
    channel = Channel(letter_counts(docs))
    held = spark.sparkContext.broadcast(channel)

    def extract(batches):
        memory = Memory(lambda token: tuple((hash_feature(f), f) for f in features(token, held.value)), MEMORY // 8)
        for b in batches:
            hashes, names, groups = [], [], []
            for y, text in zip(b.column("y").to_pylist(), b.column("text").to_pylist(), strict=True):
                got = sorted(memory.of_text(text))
                hashes.append(np.array([h for h, _ in got], "<u8").tobytes())
                names.append([f for _, f in got] if y else [])
                # Near copies share their least features; what they teach counts once, see learnt().
                groups.append(hash_feature(" ".join(f for _, f in got[:3])) - (1 << 63))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "y": b.column("y"), "f": pa.array(hashes, pa.binary()), "names": pa.array(names, pa.list_(pa.string())), "near": pa.array(groups, pa.int64())})

    sample = materialize(labelled_sample(docs, labels, "toxic", limit).mapInArrow(lean(extract), "doc_id long, y int, f binary, names array<string>, near long"), "toxic-sample")
    # At most `limit` times the features of a text over MIN_DOCS names.
    known = sample.filter("y = 1").select("near", F.explode("names").alias("name")).distinct().groupBy("name").count().filter(F.col("count") >= MIN_DOCS)
    names = np.array(sorted(r["name"] for r in known.select("name").collect()), object)
    keys = np.array([hash_feature(x) for x in names], np.uint64)
    order = np.argsort(keys)
    names, keys = names[order], keys[order]

    def held_by(batches):
        for b in batches:
            at = [np.flatnonzero(np.isin(keys, np.frombuffer(f, "<u8"))).astype("<i4").tobytes() for f in b.column("f").to_pylist()]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "y": b.column("y"), "at": pa.array(at, pa.binary())})

    t = sample.select("doc_id", "y", "f").mapInArrow(lean(held_by), "doc_id long, y int, at binary").orderBy("doc_id").toArrow()
    forget(sample)
    held.destroy()
    y = t.column("y").to_numpy().astype(float)
    if not len(y) or not y.any() or y.all():
        share = float(y.mean()) if len(y) else 0.0
        return Model(math.log((share + 1e-3) / (1 - share + 1e-3)), {}, channel)
    rows = [np.frombuffer(x.as_py(), "<i4") for x in t.column("at")]
    n_all = np.bincount(np.concatenate(rows), minlength=len(keys))
    n_pos = np.bincount(np.concatenate([r for r, p in zip(rows, y, strict=True) if p]), minlength=len(keys))
    strong = n_pos / np.maximum(n_all, 1) >= min(0.9, 4 * y.mean())
    place = np.cumsum(strong) - 1
    bias, w = _fit_linear([place[r[strong[r]]] for r in rows], y, int(strong.sum()))
    del t, rows
    trim()
    return Model(bias, {str(f): float(x) for f, x in zip(names[strong], w, strict=True) if x > 0}, channel)


def hash_feature(f: str) -> int:
    """A 64-bit name of a feature that all workers agree on."""
    import xxhash

    return xxhash.xxh64_intdigest(f)


def _with_scores(docs: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """``docs`` with the score, in a column that no other has the name of."""
    from pyspark.sql.types import DoubleType, StructType

    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = StructType([*docs.schema.fields])
    names, name = kind.names, unused("score", docs)
    at = [c.lower() for c in names].index("text")

    def run(batches):
        for b in batches:
            s = [held.value.score(t) for t in b.column(at).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array(s, pa.float64())], [*names, name])
        held.value.forget()  # the worker outlives the task

    return docs.mapInArrow(lean(run), StructType([*kind.fields]).add(name, DoubleType())), name


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out, z = _with_scores(texts, model)
    fold = F.coalesce(crc_fold("doc_id") == 0, F.lit(False))
    return out.select("doc_id", fold.alias("held_out"), F.col(z).alias("score"), (F.col(z) >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score at or above ``threshold``."""
    out, z = _with_scores(docs, model)
    return out.filter(F.col(z) < threshold).drop(z)
