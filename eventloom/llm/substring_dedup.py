"""Substring dedup by prefix-partitioned suffix trees over words.

A repeat is a window of ``window`` words that also starts in a document with a
smaller doc_id: an internal node of depth ``window`` or more in the suffix tree of
all documents.  The tree is never built whole:

1. A suffix belongs to the least ``LENGTHS[0]``-word gram among its first ``window``
   words, which is the same one in each copy of them.  These grams are counted;
   those that one document alone has hold no repeat, the others pass a filter of
   fixed size (false positives only cost time).
2. A gram with more suffixes than a part of a partition holds is lengthened: its
   suffixes go by their least gram of ``LENGTHS[1]`` words, and where that still is
   too common by their whole first ``window`` words.  What is too common even so is
   one single node; there are at most a few for each partition, and their least
   documents, found by partial aggregation, are broadcast.
3. Each group of suffixes then fits in memory: it is sorted, which lays out its
   subtree; neighbours that agree on ``window`` words or more hang from one deep
   internal node, whose least document keeps the words.  Neighbouring repeats of
   one document join into maximal ones.

Words travel as 40-bit hashes: two different words pass for one only where twelve
words around them agree and their hashes do, a chance of 1e-12 each.

Defined results: null text has no words; a null doc_id is left as it is and is
no earlier document; rows of one doc_id are copies of one document and treated
alike; other columns pass through in ``remove_repeats`` whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chain, forget, hash_words, lean, materialize, mix, row_bounds, small_batches, text_chunks, unused

WINDOW = 13
#: Words of a prefix, and of a lengthened one; the last length is the window's.
LENGTHS = (5, 9)
FILTER_BITS = 1 << 26
#: A group is split above this many suffix runs and this part of the mean partition.
SPLIT_PLACES, SPLIT_PART = 1000, 16
WORD_BYTES = 5


class _Windows:
    """The windows of a chunk of texts: start word, row, place in the row, prefix, and where that prefix stands."""

    def __init__(self, data: np.ndarray, off: np.ndarray, n: int, window: int):
        self.h, rows, _, _ = hash_words(data, off, lower=False)
        self.window, m = window, len(self.h) - window + 1
        self.start = np.flatnonzero(rows[:m] == rows[window - 1 :]) if m > 0 else np.zeros(0, np.int64)
        if not len(self.start):
            return
        self.row = rows[self.start]
        self.place = self.start - row_bounds(rows, n)[self.row]
        prefix = min(LENGTHS[0], window)
        grams = chain(self.h, prefix)
        self.at = self.start + np.lib.stride_tricks.sliding_window_view(grams, window - prefix + 1)[self.start].argmin(1)
        self.key = grams[self.at].view(np.int64)

    def longer(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengthened prefixes and whole windows of the windows ``at``, under names apart from the prefixes'."""
        length = min(LENGTHS[1], self.window)
        grams = np.lib.stride_tricks.sliding_window_view(chain(self.h, length), self.window - length + 1)[self.start[at]].min(1)
        return mix(grams ^ np.uint64(length)).view(np.int64), mix(chain(self.h, self.window)[self.start[at]] ^ np.uint64(self.window << 8)).view(np.int64)


def _prefix_counts(docs: DataFrame, window: int) -> DataFrame:
    """(prefix, n): prefixes that several documents reach, with how many places have them."""

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            keys, owners = [], []
            for lo, n, data, off in text_chunks(b.column("text")):
                w = _Windows(data, off, n, window)
                if len(w.start):
                    new = np.flatnonzero(np.diff(w.at, prepend=-1))
                    keys.append(w.key[new])
                    owners.append(ids[lo + w.row[new]])
            if not keys:
                continue
            key, doc = np.concatenate(keys), np.concatenate(owners)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            first = np.flatnonzero(np.diff(key, prepend=key[0] ^ 1))
            last = np.append(first[1:], len(key)) - 1
            two = doc[last] != doc[first]
            n = np.concatenate([last - first + 1, np.zeros(int(two.sum()), np.int64)])
            yield pa.record_batch(
                {"prefix": pa.array(np.concatenate([key[first], key[first[two]]])), "doc": pa.array(np.concatenate([doc[first], doc[last[two]]])), "n": pa.array(n, pa.int32())}
            )

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = docs.mapInArrow(lean(run), "prefix long, doc long, n int").repartition(parts, "prefix")
    met = met.groupBy("prefix").agg(F.min("doc").alias("x"), F.max("doc").alias("y"), F.sum("n").alias("n"))
    return materialize(met.filter("x < y").select("prefix", "n"), "prefixes")


def _filter_words(prefixes: DataFrame) -> np.ndarray:
    words = (
        prefixes.select(F.expr(f"cast(shiftright(prefix & {FILTER_BITS - 1}L, 6) as int)").alias("w"), F.expr("shiftleft(1L, cast(prefix & 63L as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
    )
    out = np.zeros(FILTER_BITS // 64, np.int64)
    t = words.toArrow()
    out[t.column("w").to_numpy()] = t.column("b").to_numpy()
    return out


def _common(docs: DataFrame, hot: np.ndarray, most: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengthened prefixes that still are too common, and windows that are, with their least documents."""

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            found = [[], []], [[], []]
            for lo, n, data, off in text_chunks(b.column("text")):
                w = _Windows(data, off, n, window)
                if not len(w.start) or not len(at := np.flatnonzero(np.isin(w.key, hot))):
                    continue
                for (keys, docs_), key in zip(found, w.longer(at), strict=True):
                    keys.append(key)
                    docs_.append(ids[lo + w.row[at]])
            for whole, (keys, docs_) in enumerate(found):
                if keys:
                    key, doc = np.concatenate(keys), np.concatenate(docs_)
                    order = np.argsort(key, kind="stable")
                    key, doc = key[order], doc[order]
                    first = np.flatnonzero(np.diff(key, prepend=key[0] ^ 1))
                    yield pa.record_batch(
                        {"whole": pa.array(np.full(len(first), whole, np.int32)), "key": pa.array(key[first]), "n": pa.array(np.diff(np.append(first, len(key)))), "doc": pa.array(np.minimum.reduceat(doc, first))}
                    )

    met = docs.mapInArrow(lean(run), "whole int, key long, n long, doc long").groupBy("whole", "key").agg(F.sum("n").alias("n"), F.min("doc").alias("doc"))
    # Each stands for more than `most` windows: few for each partition.
    t = met.filter(F.col("n") > most).orderBy("whole", "key").toArrow()
    whole, key, doc = (t.column(c).to_numpy() for c in ("whole", "key", "doc"))
    return key[whole == 0], key[whole == 1], doc[whole == 1]


def _suffixes(docs: DataFrame, shared, window: int) -> DataFrame:
    """(key, doc_id, pos, words): runs of suffixes of one group, as their words; without words, how many words from pos on a single node covers."""

    def run(batches):
        bits, hot, hot_long, hot_whole, least = shared.value
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for lo, n, data, off in text_chunks(b.column("text")):
                w = _Windows(data, off, n, window)
                if not len(w.start):
                    continue
                low = w.key & (FILTER_BITS - 1)
                keep = np.flatnonzero((bits[low >> 6] >> (low & 63)) & 1)
                if not len(keep):
                    continue
                key, start, doc = w.key[keep], w.start[keep], ids[lo + w.row[keep]]
                alone = np.zeros(len(keep), bool)
                if len(hot) and len(at := np.flatnonzero(np.isin(key, hot))):
                    longer, whole = w.longer(keep[at])
                    key[at] = np.where(np.isin(longer, hot_long), whole, longer)
                    if len(hot_whole):
                        node = np.minimum(np.searchsorted(hot_whole, whole), len(hot_whole) - 1)
                        one = hot_whole[node] == whole
                        alone[at[one]] = True
                        # Named by whether the node's least document is an earlier one.
                        key[at[one]] = least[node[one]] < doc[at[one]]
                new = np.flatnonzero((np.diff(key, prepend=key[0] ^ 1) != 0) | (np.diff(start, prepend=-2) != 1) | (np.diff(alone, prepend=False) != 0))
                last = np.append(new[1:], len(key)) - 1
                kept = ~alone[new] | (key[new] == 1)
                new, last = new[kept], last[kept]
                if not len(new):
                    continue
                # The low bytes of a word's hash.
                flat = np.ascontiguousarray(w.h.view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]).tobytes()
                words = [None if single else flat[WORD_BYTES * x : WORD_BYTES * (y + window)] for x, y, single in zip(start[new].tolist(), start[last].tolist(), alone[new].tolist(), strict=True)]
                cover = np.where(alone[new], start[last] - start[new] + window, 0)
                yield pa.record_batch(
                    {
                        "key": pa.array(np.where(alone[new], mix(doc[new].view(np.uint64)).view(np.int64), key[new])), "doc_id": pa.array(doc[new]), "pos": pa.array(w.place[keep[new]].astype(np.int32)),
                        "words": pa.array(words, pa.binary()), "cover": pa.array(cover.astype(np.int32)),
                    }
                )

    return docs.mapInArrow(lean(run), "key long, doc_id long, pos int, words binary, cover int")


def _sorted_suffixes(words: np.ndarray) -> np.ndarray:
    """Places of ``words`` in the order of the suffixes that begin there: ranks of 1, 2, 4, ... words until all differ.

    Places are sorted, never copies of suffixes, so a run of equal words costs no more than any other.
    """
    rank, k = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
    while k < len(words) and rank.max() < len(words) - 1:
        after = np.full(len(words), -1, np.int64)
        after[:-k] = rank[k:]
        order = np.lexsort((after, rank))
        new = (rank[order[1:]] != rank[order[:-1]]) | (after[order[1:]] != after[order[:-1]])
        rank[order] = np.concatenate([[0], np.cumsum(new)])
        k *= 2
    return np.argsort(rank, kind="stable")


def _deep_nodes(group: list[tuple[int, int, bytes]], window: int) -> list[tuple[int, int]]:
    """(doc_id, pos) of a group's suffixes below an internal node of depth ``window`` or more whose least document is another."""
    flat, doc, pos = [], [], []
    for i, (d, p, data) in enumerate(group):
        n = len(data) // WORD_BYTES
        w = np.zeros((n + 1, 8), np.uint8)
        w[:n, :WORD_BYTES] = np.frombuffer(data, np.uint8).reshape(n, WORD_BYTES)
        w = w.reshape(-1).view(np.int64)
        w[n] = -1 - i  # a run ends in a word of its own
        flat.append(w)
        doc.append(np.full(n + 1, d, np.int64))
        pos.append(np.arange(p, p + n + 1))
        # Fewer words than a window are left from here on: no suffix of the group.
        pos[-1][max(0, n - window + 1) :] = -1
    words, doc, pos = (np.concatenate(x) for x in (flat, doc, pos))
    at = _sorted_suffixes(words)
    at = at[pos[at] >= 0]
    if len(at) < 2:
        return []
    # Common words of neighbours, up to the window: their lowest common node is at least as deep.
    common = np.ones(len(at) - 1, bool)
    for k in range(window):
        common &= words[at[1:] + k] == words[at[:-1] + k]
    node = np.concatenate([[0], np.cumsum(~common)])
    least = np.full(node[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, node, doc[at])
    late = at[doc[at] > least[node]]
    return list(zip(doc[late].tolist(), pos[late].tolist(), strict=True))


#: Runs up to this many words are sorted as copies of their suffixes, which is faster for few words.
SHORT_RUN = 256


def _repeats(group: list[tuple[int, int, bytes]], window: int) -> list[tuple[int, int, int]]:
    """Spans (doc_id, a, b) of a group's runs (doc_id, pos, words) that an earlier document has too."""
    one = group[0][0]
    if all(doc == one for doc, _, _ in group):
        return []
    if max(len(words) for _, _, words in group) > WORD_BYTES * SHORT_RUN:
        found = _deep_nodes(group, window)
    else:
        depth = WORD_BYTES * window
        suffixes = [(words[k:], doc, pos + k // WORD_BYTES) for doc, pos, words in group for k in range(0, len(words) - depth + 1, WORD_BYTES)]
        suffixes.sort()
        found, i, n = [], 0, len(suffixes)
        while i < n - 1:
            # Suffixes below one node of at least the window's depth follow each other.
            head, j = suffixes[i][0][:depth], i + 1
            while j < n and suffixes[j][0].startswith(head):
                j += 1
            if j > i + 1:
                least = min(x[1] for x in suffixes[i:j])
                found += [(doc, pos) for _, doc, pos in suffixes[i:j] if doc > least]
            i = j
    found.sort()
    spans: list[tuple[int, int, int]] = []
    for doc, pos in found:
        if spans and spans[-1][0] == doc and pos <= spans[-1][2]:
            spans[-1] = (doc, spans[-1][1], pos + window)
        else:
            spans.append((doc, pos, pos + window))
    return spans


def _subtrees(window: int):
    """Streams runs sorted by group; spans (doc_id, a, b)."""

    def table(spans):
        c = list(zip(*spans, strict=True)) or [[], [], []]
        return pa.record_batch({"doc_id": pa.array(c[0], pa.int64()), "a": pa.array(c[1], pa.int32()), "b": pa.array(c[2], pa.int32())})

    def run(batches):
        key, group = None, []
        for batch in batches:
            spans = []
            for k, doc, pos, words, cover in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "pos", "words", "cover")), strict=True):
                if words is None:
                    spans.append((doc, pos, pos + cover))
                    continue
                if k != key:
                    if len(group) > 1:
                        spans += _repeats(group, window)
                    key, group = k, []
                group.append((doc, pos, words))
            yield table(spans)
        if len(group) > 1:
            yield table(_repeats(group, window))

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, spans): words [a, b) of each document covered by windows that a smaller doc_id also has; maximal after joining overlaps."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    prefixes = _prefix_counts(docs, window)
    total = prefixes.agg(F.sum("n")).head()[0] or 0
    most = max(SPLIT_PLACES, total // (SPLIT_PART * parts))
    # At most SPLIT_PART * parts prefixes can have more places than that.
    hot = np.array(sorted(r["prefix"] for r in prefixes.filter(F.col("n") > most).collect()), np.int64)
    longer = _common(docs, hot, most, window) if len(hot) else (hot, hot, hot)
    shared = spark.sparkContext.broadcast((_filter_words(prefixes), hot, *longer))
    rows = _suffixes(docs, shared, window).repartition(parts, "key").sortWithinPartitions("key")
    found = materialize(rows.mapInArrow(lean(_subtrees(window)), "doc_id long, a int, b int"), "repeats")
    forget(prefixes)
    shared.destroy()
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _covered(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal repeats: overlapping or touching spans joined."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or []):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def kept_words(text: str | None, spans: list[dict] | None) -> tuple[int, int, str | None]:
    """(words, removed words, kept words joined by blanks or None where nothing goes)."""
    words = (text or "").encode().split()
    cover = _covered(spans)
    if not cover:
        return len(words), 0, None
    kept, at = [], 0
    for a, b in cover:
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept).decode()


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with two more, last columns: words removed, and the kept words (null where the text stays as it is).

    They are called n_removed and new_text, with signs before where ``docs`` has such columns.
    """
    from pyspark.sql.types import LongType, StringType, StructType

    own, place = unused("id", docs), unused("spans", docs)
    spans = repeated_spans(docs, window).select(F.col("doc_id").alias(own), F.col("spans").alias(place))
    joined = docs.join(spans, docs["doc_id"] == spans[own], "left").drop(own)
    text = [c.lower() for c in docs.columns].index("text")
    kind = StructType([*docs.schema.fields]).add(unused("n_removed", docs), LongType()).add(unused("new_text", docs), StringType())

    def run(batches):
        for b in batches:
            got = [kept_words(t, s) for t, s in zip(b.column(text).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
            yield pa.record_batch([*b.columns[:-1], pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.string())], kind.names)

    return joined.mapInArrow(lean(run), kind)


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    spans = repeated_spans(docs, window)
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(spans, "doc_id", "left")

    def run(batches):
        for b in batches:
            n, gone, sha = [], [], []
            for text, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words, removed, kept = kept_words(text, s)
                n.append(words)
                gone.append(removed)
                sha.append(hashlib.sha256(b" ".join((text or "").encode().split()) if kept is None else kept.encode()).hexdigest())
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": sha})

    return joined.mapInArrow(lean(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")
