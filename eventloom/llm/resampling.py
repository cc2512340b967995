"""Importance resampling towards a target: hashed n-gram weights, Gumbel scores, an external merge of sorted runs.

1. Features of both sides are counted in ``BUCKETS`` buckets; a bucket's gain is
   the log ratio of its smoothed shares.  The gains, an array of fixed size, are
   all that a document's weight needs.
2. A document's score is its weight plus noise by a hash of its id, so the
   highest scores are a draw without replacement in proportion to exp(weight).
3. Every partition sorts its eligible documents and writes them as a run, a
   binary file in the shared folder.  The scores' counts cut all runs at the same
   scores into ranges; a range's slices are merged by a tournament tree that reads
   them block by block, ``FAN_IN`` slices at a time, in passes where there are more.
   Ranges know their first rank, those behind the draw are never read, and the last
   one stops at the exact count.  No task holds more than its blocks.

Defined results: null and empty texts have no features and weight 0; an id that
is null hashes as an empty text and is last among equal scores; repeated rows are
documents each and take ranks each; a target without features gives gains from
the smoothing alone; an empty table gives no rows.  Further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_path, lean, materialize, open_store, shared_path, small_batches, text_chunks

BUCKETS = 10_000
#: Slices that one tournament reads at once, records of a block read, and about how many records a range holds.
FAN_IN, BLOCK, RANGE = 64, 4096, 1 << 20
#: A record of a run: score, whether the id is null, id, features, weight.
FIELDS = ["score", "no_id", "doc_id", "n_features", "weight"]
WIDTH = 8 * len(FIELDS)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words are runs of digits, small letters and all that is not ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def crc32s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each span of ``data``: a byte of all spans at a time, long spans by themselves."""
    size = ends - starts
    out = np.zeros(len(size), np.uint32)
    short = np.flatnonzero(size <= 64)
    at = short[np.argsort(-size[short], kind="stable")]
    first, left = starts[at], -size[at]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for j in range(-int(left[0]) if len(left) else 0):
        m = int(np.searchsorted(left, -j, "left"))
        crc[:m] = _CRC[(crc[:m] ^ data[first[:m] + j]) & np.uint32(255)] ^ (crc[:m] >> np.uint32(8))
    out[at] = ~crc
    for i in np.flatnonzero(size > 64):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return out


def features(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, words of each row, feature bounds of the rows, bucket of each feature) of some whole texts at a time.

    Features are the runs of 1 to ``n`` words, joined by one space.
    """
    for lo, rows, data, off in text_chunks(column):
        data = _LOWER[data]
        word = np.concatenate([_WORD[data], [False]])
        edge = np.zeros(len(word), bool)
        edge[off] = True
        before = np.concatenate([[False], word[:-1]])
        starts = np.flatnonzero(word & (~before | edge))
        after = np.concatenate([word[1:], [False]])
        next_edge = np.concatenate([edge[1:], [True]])
        ends = np.flatnonzero(word & (~after | next_edge)) + 1
        row = np.searchsorted(off, starts, "right") - 1
        bounds = np.searchsorted(row, np.arange(rows + 1))
        if n == 1:
            yield lo, np.diff(bounds), bounds, crc32s(data, starts, ends) % np.uint32(BUCKETS)
            continue
        # The words again, one space between: a run of words is one span.
        size = ends - starts
        a = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        flat = np.full(int((size + 1).sum()), 32, np.uint8)
        flat[np.repeat(a - starts, size) + np.flatnonzero(word)] = data[word[:-1]]
        z, own = a + size, []
        for k in range(1, n + 1):
            i = np.arange(len(a) - k + 1)
            i = i[row[i] == row[i + k - 1]] if len(i) else i
            own.append((row[i], crc32s(flat, a[i], z[i + k - 1]) % np.uint32(BUCKETS)))
        r, f = (np.concatenate(x) for x in zip(*own, strict=True))
        o = np.argsort(r, kind="stable")
        yield lo, np.diff(bounds), np.searchsorted(r[o], np.arange(rows + 1)), f[o]


def bucket_counts(texts: DataFrame, n: int) -> np.ndarray:
    """Features of a table (text) in each bucket; each task hands on at most one row a bucket."""

    def count(batches):
        sums = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, _, _, f in features(b.column(0), n):
                sums += np.bincount(f, minlength=BUCKETS)
        at = np.flatnonzero(sums)
        yield pa.record_batch({"bucket": pa.array(at, pa.int64()), "n": pa.array(sums[at], pa.int64())})

    per = texts.mapInArrow(lean(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[per["bucket"].to_numpy(np.int64)] = per["n"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln of the target's smoothed share over the source's)."""
    s_all, t_all = int(source.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id, seed: int) -> int:
    """floor of a standard Gumbel draw times 1000, by the hash of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, target: DataFrame, n: int, seed: int, min_words: int) -> DataFrame:
    """(doc_id, n_features, weight, score, eligible) of every document, written out."""
    small_batches(docs.sparkSession)
    text = lambda d: d.select(F.col("text").cast("string").alias("text"))
    gain = gains(bucket_counts(text(docs), n), bucket_counts(text(target), n))

    def score(batches):
        for b in batches:
            ids, col = b.column(0), b.column(1)
            for lo, words, bounds, f in features(col, n):
                m = np.diff(bounds)
                total = np.concatenate([[0], np.cumsum(gain[f])])
                sums = total[bounds[1:]] - total[bounds[:-1]]
                weight = np.where(m > 0, sums // np.maximum(m, 1), 0)
                some = ids.slice(lo, len(m))
                g = np.array([noise(i, seed) for i in some.to_pylist()], np.int64)
                yield pa.record_batch({"doc_id": some, "n_features": pa.array(m.astype(np.int64)), "weight": pa.array(weight), "score": pa.array(weight + g), "eligible": pa.array(words >= min_words)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(lean(score), "doc_id long, n_features long, weight long, score long, eligible boolean"), "resample-scores")


# ---------------------------------------------------------------- runs and tournaments


def write_runs(rows: DataFrame, folder: str, tops: np.ndarray) -> DataFrame:
    """(range, file, at, n) of the slices of one run per partition; range r ends with the score tops[r]."""
    down = [F.col("score").desc(), "no_id", "doc_id", "n_features", "weight"]
    d = rows.select("score", F.col("doc_id").isNull().cast("long").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "n_features", "weight").sortWithinPartitions(*down)

    def write(batches):
        ctx = TaskContext.get()
        name, counts = f"run-{ctx.partitionId()}-{ctx.taskAttemptId()}", np.zeros(len(tops), np.int64)
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{name}", compression=None) as f:
            for b in batches:
                block = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in FIELDS], 1)
                f.write(block.tobytes())
                # Scores descend, so do the ranges' last scores.
                counts += np.bincount(np.searchsorted(-tops, -block[:, 0], "left"), minlength=len(tops))
        at, some = np.cumsum(counts) - counts, np.flatnonzero(counts)
        yield pa.record_batch({"range": pa.array(some, pa.int64()), "file": pa.array([name] * len(some), pa.string()), "at": pa.array(at[some], pa.int64()), "n": pa.array(counts[some], pa.int64())})

    return materialize(d.mapInArrow(write, "range long, file string, at long, n long"), "resample-slices")


def slice_records(store, path: str, at: int, n: int) -> Iterator[tuple]:
    """(order, record) of a slice of a run, a block at a time."""
    with store.open_input_file(path) as f:
        for i in range(at, at + n, BLOCK):
            block = np.frombuffer(f.read_at(min(BLOCK, at + n - i) * WIDTH, i * WIDTH), np.int64).reshape(-1, len(FIELDS))
            for r in block.tolist():
                yield (-r[0], r[1], r[2], r[3], r[4]), r


def tournament(sources: list[Iterator[tuple]]) -> Iterator[list]:
    """Records of sorted sources in one order, by a tree of losers: one comparison a level for each record."""
    k = len(sources)
    end = (math.inf,)
    head = [next(s, (end, None)) for s in sources]
    tree = [-1] * k  # tree[0] is the winner, tree[1..] the losers of the inner nodes
    for leaf in range(k):
        i, node = leaf, (leaf + k) // 2
        while node and tree[node] != -1:
            if head[tree[node]][0] < head[i][0]:
                tree[node], i = i, tree[node]
            node //= 2
        # The first to come to a node waits there for the other side.
        tree[node] = i
    while k and head[tree[0]][1] is not None:
        i = tree[0]
        yield head[i][1]
        head[i] = next(sources[i], (end, None))
        node = (i + k) // 2
        while node:
            if head[tree[node]][0] < head[i][0]:
                tree[node], i = i, tree[node]
            node //= 2
        tree[0] = i


def _slices(batches) -> Iterator[tuple[tuple, list]]:
    """Rows of a sorted manifest, by (range, group)."""
    key, some = None, []
    for b in batches:
        for r in b.to_pylist():
            k = (r["range"], r["grp"])
            if k != key and some:
                yield key, some
                some = []
            key = k
            some.append(r)
    if some:
        yield key, some


def _grouped(slices: DataFrame) -> DataFrame:
    """Slices dealt by (range, group of FAN_IN), each group in one task and in order."""
    nth = F.row_number().over(Window.partitionBy("range").orderBy("file", "at"))
    d = slices.withColumn("grp", F.floor((nth - 1) / FAN_IN).cast("long"))
    return d.repartition("range", "grp").sortWithinPartitions("range", "grp", "file", "at")


def merge_pass(slices: DataFrame, folder: str) -> DataFrame:
    """Every FAN_IN slices of a range become one."""

    def merge(batches):
        store, base = open_store(folder)
        for (r, g), some in _slices(batches):
            name = f"merge-{r}-{g}-{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(f"{base}/{name}", compression=None) as f:
                held = []
                for rec in tournament([slice_records(store, f"{base}/{s['file']}", s["at"], s["n"]) for s in some]):
                    held.append(rec)
                    if len(held) == BLOCK:
                        f.write(np.array(held, np.int64).tobytes())
                        held = []
                f.write(np.array(held, np.int64).tobytes())
            yield pa.record_batch({"range": pa.array([r], pa.int64()), "file": pa.array([name]), "at": pa.array([0], pa.int64()), "n": pa.array([sum(s["n"] for s in some)], pa.int64())})

    return materialize(_grouped(slices).mapInArrow(merge, "range long, file string, at long, n long"), "resample-slices")


def ranked(slices: DataFrame, folder: str, first: np.ndarray, draw: int) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of all ranges: ranks up to ``draw``, then none for records equal to the last one drawn."""

    def rank(batches):
        store, base = open_store(folder)
        for (r, _), some in _slices(batches):
            at, last, held = int(first[r]), None, []
            for rec in tournament([slice_records(store, f"{base}/{s['file']}", s["at"], s["n"]) for s in some]):
                at += 1
                if at > draw and rec[:3] != last:
                    break
                if at <= draw:
                    last = rec[:3]
                held.append([*rec, at if at <= draw else 0])
                if len(held) == BLOCK:
                    yield _rank_rows(held)
                    held = []
            if held:
                yield _rank_rows(held)

    return materialize(_grouped(slices).mapInArrow(rank, "doc_id long, n_features long, weight long, score long, rank long"), "resample-ranks")


def _rank_rows(held: list) -> pa.RecordBatch:
    a = np.array(held, np.int64)
    col = lambda i, null=None: pa.array(a[:, i], mask=null)
    return pa.record_batch({"doc_id": col(2, a[:, 1] == 1), "n_features": col(3), "weight": col(4), "score": col(0), "rank": col(5, a[:, 5] == 0)})


def resample(docs: DataFrame, target: DataFrame, n: int = 1, percent: int = 10, min_words: int = 20, seed: int = 2024, range_rows: int = RANGE) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; ``rank`` is null for those not drawn.

    Of the N documents with at least ``min_words`` words, floor(percent * N / 100) are drawn.
    """
    spark = docs.sparkSession
    all_rows = scored(docs, target, n, seed, min_words)
    able = all_rows.filter("eligible")
    # Scores are whole numbers between bounds that grow with the logarithm of the corpus: some hundred thousand at most.
    per = able.groupBy("score").count().orderBy(F.col("score").desc()).toPandas()
    scores, counts = per["score"].to_numpy(np.int64), per["count"].to_numpy(np.int64)
    draw = percent * int(counts.sum()) // 100
    none = F.lit(None).cast("long").alias("rank")
    if not draw:
        return all_rows.select("doc_id", "n_features", "weight", "score", none)
    upto = np.cumsum(counts)
    nr = (upto - 1) // range_rows
    last = np.flatnonzero(np.append(nr[1:] != nr[:-1], True))
    tops, first = scores[last], np.concatenate([[0], upto[last][:-1]])
    folder = shared_path(spark, "resample-runs")
    slices = write_runs(able, folder, tops).filter(F.col("range") < int(np.searchsorted(first, draw)))
    while (slices.groupBy("range").count().agg(F.max("count")).head()[0] or 0) > FAN_IN:
        slices = merge_pass(slices, folder)
    drawn = ranked(slices, folder, first, draw)
    drop_path(spark, folder)
    # Rows behind the last one drawn; those equal to it came out of the merge.
    end = drawn.filter(F.col("rank") == draw).head()
    tie = F.col("doc_id").isNotNull() & (F.col("doc_id") <= end["doc_id"]) if end["doc_id"] is not None else F.lit(True)
    behind = ~F.col("eligible") | (F.col("score") < end["score"]) | ((F.col("score") == end["score"]) & ~tie)
    return drawn.unionAll(all_rows.filter(behind).select("doc_id", "n_features", "weight", "score", none))
