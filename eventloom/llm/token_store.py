"""Token-id files: shards of one concatenated id array with Elias-Fano coded document boundaries.

A shard is ``ELTK`` | width | n_docs | n_nulls | least doc_id | ids | Elias-Fano of
doc_ids | Elias-Fano of boundaries (n_docs + 1).  Ids take 16 bits where the
vocabulary allows.  Shards are range-partitioned by doc_id, so shard order and
order within a shard together ascend; a shard's own boundaries start at 0 and
the manifest carries where it starts among all ids.

Defined results: null text is empty (its document is the end id alone); null
doc_ids come first; repeated rows are stored as often as they came in, ordered
by text; other columns are ignored; an empty table makes an empty manifest.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import elias_fano
from .common import get_file, materialize, put_file, shared_path, small_batches
from .tokens import END_ID, encoder

MAGIC = b"ELTK"
_HEAD = struct.Struct("<4sBQQqQ")
SHARD_TOKENS = 1 << 25
#: Documents that a reader hands on at a time.
READ_DOCS = 1000


def pack_shard(doc_ids: list, parts: list[bytes], wide: bool) -> bytes:
    """One shard of documents in order; nulls come first."""
    nulls = sum(x is None for x in doc_ids)
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    ids = np.frombuffer(b"".join(parts), "<u4")
    ends = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) // 4 for p in parts], out=ends[1:])
    body = ids.astype("<u4" if wide else "<u2").tobytes()
    head = _HEAD.pack(MAGIC, 4 if wide else 2, len(parts), nulls, least, len(ids))
    return head + body + elias_fano.encode(known - least) + elias_fano.encode(ends)


class Shard:
    """A shard's documents by position."""

    def __init__(self, data: bytes):
        magic, width, self.n, self.nulls, self.least, self.n_ids = _HEAD.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, _HEAD.size)
        self.docs = elias_fano.Reader(data, _HEAD.size + width * self.n_ids)
        self.ends = elias_fano.Reader(data, self.docs.end)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.docs.select(i - self.nulls)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i) : self.ends.select(i + 1)]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> tuple[DataFrame, str]:
    """Encode ``docs(doc_id, text)`` and write the shards; (manifest, folder).

    Manifest: part, seq, file, n_docs, n_tokens, start (ids of all shards before it).
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_path(spark, "token-shards")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        enc, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        wide = enc.t.get_vocab_size() > 1 << 16 or end_id >= 1 << 16
        tail = np.array([end_id], "<u4").tobytes()
        ids, parts, held = [], [], 0

        def flush():
            nonlocal ids, parts, held, seq
            name = f"part-{part:06d}-{seq:04d}.eltk"
            put_file(folder, name, pack_shard(ids, parts, wide))
            row = pa.record_batch({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [name], "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([held], pa.int64())})
            ids, parts, held, seq = [], [], 0, seq + 1
            return row

        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids.append(i)
                parts.append(enc.encode(text) + tail)
                held += len(parts[-1]) // 4
                if held >= SHARD_TOKENS:
                    yield flush()
        if ids:
            yield flush()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = materialize(dealt.mapInArrow(run, "part int, seq int, file string, n_docs long, n_tokens long"), "token-manifest")
    # One row per shard, not per document.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long"))), folder


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, read from the shards; ids are little-endian unsigned 32-bit."""

    def run(batches):
        for b in batches:
            for name, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                s = Shard(get_file(folder, name))
                for lo in range(0, s.n, READ_DOCS):
                    hi = min(lo + READ_DOCS, s.n)
                    # Boundaries come from the coded array by select, for these documents alone.
                    ends = s.ends.values(lo, hi + 1)
                    nulls = min(max(s.nulls - lo, 0), hi - lo)
                    docs = [None] * nulls + (s.docs.values(lo + nulls - s.nulls, hi - s.nulls) + s.least).tolist()
                    yield pa.record_batch(
                        {
                            "doc_id": pa.array(docs, pa.int64()),
                            "start": pa.array(ends[:-1] + start, pa.int64()),
                            "n_tokens": pa.array(np.diff(ends), pa.int64()),
                            "ids": pa.array([s.ids[x:y].astype("<u4").tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                        }
                    )

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(n, "part", "seq").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
