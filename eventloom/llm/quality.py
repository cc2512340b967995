"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

``score = w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``,
linear in the number of features of a text.  Words are hashed to 2**WORD_BITS
weights with log-scaled, length-normalised counts; the statistics describe case,
signs, word and line shape and repetition; metadata are the text's own lengths.
Labels, lang, source and doc_id are never inputs.

Fitted on a bounded sample (``training.SAMPLE_ROWS`` rows outside the held-out
fold) with Adagrad on the driver; the model has a fixed size and is broadcast.

Defined results: null or empty text scores by its (zero) features; repeated rows
score alike; a null doc_id is scored and not held out; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, hash_words, row_bounds, small_batches, text_chunks
from .training import SAMPLE_ROWS, labelled_sample

WORD_BITS = 15
RANK = 6
_WORDS = 1 << WORD_BITS
STATS = ("upper", "digit", "sign", "foreign", "space", "lines", "word_len", "long_words", "short_words", "distinct", "top_word", "sign_ends", "caps_words", "stop_share", "log_words", "log_chars", "line_repeat", "odd_end")
_N = _WORDS + len(STATS)

_UPPER, _DIGIT, _SIGN, _HIGH, _NL = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SIGN[33:48] = _SIGN[58:65] = _SIGN[91:97] = _SIGN[123:127] = True
_PLAIN_SIGNS = [ord(c) for c in ".,;:'\"?-"]
_HIGH[0xC0:] = True
_NL[10] = True
_ODD = _SIGN.copy()
_ODD[_PLAIN_SIGNS] = False


def features(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, word cell, value) of a chunk's texts and their statistics (n, len(STATS))."""
    h, rows, starts, ends = hash_words(data, off, lower=True)
    size = np.maximum(np.diff(off), 1).astype(float)
    words = np.bincount(rows, minlength=n).astype(float)
    some = np.maximum(words, 1)
    cum = lambda mask: (c := np.concatenate([[0], np.cumsum(mask)]))[off[1:]] - c[off[:-1]]
    per_word = lambda x: np.bincount(rows, x, minlength=n) / some
    cell = (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key, count = np.unique(rows * _WORDS + cell, return_counts=True)
    row, cell = key // _WORDS, key % _WORDS
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(row, value * value, minlength=n))
    value = value / np.maximum(norm[row], 1e-9)
    length = (ends - starts).astype(float)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    caps = np.concatenate([[0], np.cumsum(_UPPER[data])])
    n_caps = caps[ends] - caps[starts] if len(ends) else np.zeros(0)
    top = np.zeros(n)
    np.maximum.at(top, row, count)
    lines = cum(_NL[data]) + 1
    # Repeated stretches of eight words say that lines repeat.
    m = len(h) - 7
    repeat = np.zeros(n)
    if m > 0:
        from .common import chain

        ok = rows[:m] == rows[7:]
        k = np.unique(np.stack([rows[:m][ok].astype(np.uint64), chain(h, 8)[ok]], 1), axis=0)[:, 0].astype(np.int64)
        whole = np.bincount(rows[:m][ok], minlength=n)
        repeat = 1 - np.bincount(k, minlength=n) / np.maximum(whole, 1)
        repeat[whole == 0] = 0
    ended = np.zeros(n)
    bounds = row_bounds(rows, n)
    has = bounds[1:] > bounds[:-1]
    if len(last):
        ended[has] = _ODD[last[bounds[1:][has] - 1]]
    stats = np.stack(
        [
            cum(_UPPER[data]) / size, cum(_DIGIT[data]) / size, cum(_ODD[data]) / size, cum(_HIGH[data]) / size, 1 - words / size, np.log1p(lines / some * 10), np.log1p(per_word(length)), per_word(length > 12), per_word(length < 4),
            np.bincount(row, minlength=n) / some, top / some, per_word(_ODD[last] if len(last) else length), per_word(n_caps > 0.6 * length) if len(length) else np.zeros(n), per_word((length <= 3) & (n_caps == 0)) if len(length) else np.zeros(n),
            np.log1p(words) / 8, np.log1p(np.diff(off)) / 10, repeat, ended,
        ],
        1,
    )
    stats[words == 0] = 0
    return row, cell, value, stats


class Machine:
    """A fitted factorisation machine."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.w0, self.w, self.v, self.mean, self.scale = w0, w, v, mean, scale

    def columns(self, row, cell, value, stats):
        """Word cells and scaled statistics as one list of (row, column, value)."""
        n, k = stats.shape
        z = (stats - self.mean) / self.scale / np.sqrt(k)
        row = np.concatenate([row, np.repeat(np.arange(n), k)])
        return row, np.concatenate([cell, np.tile(np.arange(_WORDS, _WORDS + k), n)]), np.concatenate([value, z.ravel()])

    def raw(self, row, col, x, n: int) -> np.ndarray:
        out = self.w0 + np.bincount(row, self.w[col] * x, minlength=n)
        for f in range(self.v.shape[1]):
            vx = self.v[col, f] * x
            out += 0.5 * (np.bincount(row, vx, minlength=n) ** 2 - np.bincount(row, vx * vx, minlength=n))
        return out

    def predict(self, data, off, n: int) -> np.ndarray:
        row, cell, value, stats = features(data, off, n)
        z = self.raw(*self.columns(row, cell, value, stats), n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, rank: int = RANK, epochs: int = 8, batch: int = 256, rate: float = 0.08, l2: float = 1e-5, seed: int = 5) -> Machine:
    """Fit on rows of (cells, values, statistics) with Adagrad; rows are taken in a seeded order."""
    rng = np.random.default_rng(seed)
    stats = np.stack([p[2] for p in parts]) if parts else np.zeros((0, len(STATS)))
    mean = stats.mean(0) if len(stats) else np.zeros(len(STATS))
    scale = np.maximum(stats.std(0), 1e-3) if len(stats) else np.ones(len(STATS))
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    m = Machine(float(np.log(share / (1 - share))), np.zeros(_N), rng.normal(0, 0.02, (_N, rank)), mean, scale)
    if not len(y) or y.min() == y.max():
        return Machine(m.w0, m.w, m.v * 0, mean, scale)
    gw, gv, g0 = np.full(_N, 1e-4), np.full((_N, rank), 1e-4), 1e-4
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), batch):
            at = order[lo : lo + batch]
            n = len(at)
            row = np.repeat(np.arange(n), [len(parts[i][0]) for i in at])
            row, col, x = m.columns(row, np.concatenate([parts[i][0] for i in at]), np.concatenate([parts[i][1] for i in at]), stats[at])
            vx = m.v[col] * x[:, None]
            sums = np.stack([np.bincount(row, vx[:, f], minlength=n) for f in range(rank)], 1)
            sq = sum(np.bincount(row, vx[:, f] ** 2, minlength=n) for f in range(rank))
            z = m.w0 + np.bincount(row, m.w[col] * x, minlength=n) + 0.5 * ((sums**2).sum(1) - sq)
            e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]
            u, inv = np.unique(col, return_inverse=True)
            ex = e[row] * x
            dw = np.bincount(inv, ex, minlength=len(u)) / n + l2 * m.w[u]
            gw[u] += dw * dw
            m.w[u] -= rate * dw / np.sqrt(gw[u])
            for f in range(rank):
                dv = np.bincount(inv, ex * (sums[row, f] - vx[:, f]), minlength=len(u)) / n + l2 * m.v[u, f]
                gv[u, f] += dv * dv
                m.v[u, f] -= 0.5 * rate * dv / np.sqrt(gv[u, f])
            d0 = e.mean()
            g0 += d0 * d0
            m.w0 -= rate * d0 / np.sqrt(g0)
    return m


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS, rank: int = RANK) -> Machine:
    """Fit on at most ``limit`` labelled rows outside the held-out fold."""
    small_batches(docs.sparkSession)

    def extract(batches):
        for b in batches:
            cells, values, stats = [], [], []
            for _, n, data, off in text_chunks(b.column("text")):
                row, cell, value, s = features(data, off, n)
                at = np.searchsorted(row, np.arange(n + 1))
                cells += [cell[x:y].astype("<i2").tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                values += [value[x:y].astype("<f4").tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                stats += [r.tobytes() for r in s]
            if cells:
                yield pa.record_batch({"doc_id": b.column("doc_id"), "y": b.column("y"), "c": pa.array(cells, pa.binary()), "v": pa.array(values, pa.binary()), "s": pa.array(stats, pa.binary())})

    t = labelled_sample(docs, labels, "quality", limit).mapInArrow(extract, "doc_id long, y int, c binary, v binary, s binary").toArrow()
    order = np.lexsort((t.column("y").to_numpy(), t.column("doc_id").to_numpy())) if t.num_rows else []
    c, v, s = (t.column(k).to_pylist() for k in "cvs")
    parts = [(np.frombuffer(c[i], "<i2").astype(np.int64) & (_WORDS - 1), np.frombuffer(v[i], "<f4").astype(float), np.frombuffer(s[i], float)) for i in order]
    return fit(parts, t.column("y").to_numpy()[order].astype(float) if t.num_rows else np.zeros(0), rank)


def score(docs: DataFrame, model: Machine, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for b in batches:
            got = [held.value.predict(data, off, n) for _, n, data, off in text_chunks(b.column("text"))]
            if got:
                yield pa.record_batch({"doc_id": b.column("doc_id"), "score": pa.array(np.concatenate(got))})

    fold = F.coalesce(crc_fold("doc_id") == 0, F.lit(False))
    out = texts.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
