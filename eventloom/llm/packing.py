"""Harmonic packing: token sequences of a fixed capacity with next to no padding.

Each worker packs its own documents.  A document's whole capacities become
sequences of their own.  What remains is cut into pieces of exactly
``capacity / k`` tokens, the longest first, for the k up to CLASSES that divide
the capacity; a bin of class k takes exactly k such pieces and is full.
Shorter rests, and the pieces of bins that a block of documents leaves
incomplete, make up the last class: they follow each other and are cut where a
sequence is full, so that at most one sequence of a block is not.  Sequence ids
are ``partition << 32 | count``, so workers need not know of each other.

Defined results: null or empty text is the end id alone; null doc_ids are kept;
repeated rows are packed each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches
from .tokens import END_ID, encoder

CAPACITY = 4096
CLASSES = 16
BLOCK_TOKENS = 1 << 22


def harmonic_bins(lengths: list[int], capacity: int = CAPACITY, classes: int = CLASSES) -> list[list[tuple[int, int, int]]]:
    """Bins of pieces (document, start, length); every token lies in exactly one piece."""
    of_class: dict[int, list[tuple[int, int, int]]] = {k: [] for k in range(1, classes + 1) if capacity % k == 0}
    rest = []
    for i, n in enumerate(lengths):
        at = 0
        for k, held in of_class.items():
            while n - at >= capacity // k:
                held.append((i, at, capacity // k))
                at += capacity // k
        if at < n:
            rest.append((i, at, n - at))
    bins = []
    for k, held in of_class.items():
        whole = len(held) - len(held) % k
        bins += [held[j : j + k] for j in range(0, whole, k)]
        rest += held[whole:]
    room = 0
    for i, at, n in rest:
        while n:
            if not room:
                bins.append([])
                room = capacity
            take = min(n, room)
            bins[-1].append((i, at, take))
            at, n, room = at + take, n - take, room - take
    return bins


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        enc = encoder(tokenizer)
        tail = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 32
        doc_ids, texts, held = [], [], 0

        def flush():
            nonlocal doc_ids, texts, held, sequence
            lengths = [len(t) // 4 for t in texts]
            rows = []
            for b in harmonic_bins(lengths, capacity):
                at = 0
                for i, s, n in b:
                    rows.append((doc_ids[i], s, n, texts[i][4 * s : 4 * (s + n)], lengths[i], sequence, at))
                    at += n
                sequence += 1
            doc_ids, texts, held = [], [], 0
            for lo in range(0, len(rows), 1000):
                c = list(zip(*rows[lo : lo + 1000], strict=True))
                ints = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
                yield pa.record_batch({k: pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in zip(ints, c, strict=True)})

        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                doc_ids.append(i)
                texts.append(enc.encode(text) + tail)
                held += len(texts[-1]) // 4
                if held >= BLOCK_TOKENS:
                    yield from flush()
        if doc_ids:
            yield from flush()

    return docs.mapInArrow(lean(run), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
