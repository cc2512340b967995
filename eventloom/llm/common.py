"""Shared pieces of the corpus operators: storage, text hashing, connected components.

Nothing here depends on the input fitting in one process.  Intermediate tables
go to the folder in ``spark.checkpoint.dir`` (shared by driver and executors);
only fixed-size objects (sketches, filters, models) reach the driver.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import itertools
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

WS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
CHUNK_BYTES = 1 << 19


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, *tables: DataFrame) -> str:
    """``name`` with as many signs before it as no column of the tables has, whatever its case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# ---------------------------------------------------------------- storage


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; an own temporary one only in local mode (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return str(held.get()).rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = "file://" + tempfile.mkdtemp(prefix="eventloom-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, with its scheme: a bare path belongs to the default file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}")
    full = str(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path))
    return re.sub(r"^file:/(?!/)", "file:///", full)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for t in tables:
        drop_path(t.sparkSession, t.stored_at)


def trim() -> None:
    """Hand freed memory of this Python process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not on every platform
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run):
    """``run`` for mapInArrow; what it held goes back to the system when a task ends, as the worker stays."""

    def task(batches):
        yield from run(batches)
        trim()

    return task


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def open_store(uri: str):
    """(filesystem, path) of a shared folder for the operators that write real files."""
    from pyarrow import fs

    try:
        return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))
    except (pa.ArrowInvalid, OSError) as e:
        raise RuntimeError(f"{uri.split(':')[0]}:// can't be opened from Python workers ({e}); name a file, s3, gs or hdfs folder in spark.checkpoint.dir") from e


def put_file(uri: str, name: str, data: bytes) -> None:
    """Write under a temporary name, then move: a retried task replaces the file as a whole."""
    store, base = open_store(uri)
    store.create_dir(base, recursive=True)
    part = f"{base}/.{name}.{uuid.uuid4().hex[:8]}"
    with store.open_output_stream(part, compression=None) as f:
        f.write(data)
    store.move(part, f"{base}/{name}")


def get_file(uri: str, name: str, at: int = 0, size: int | None = None) -> bytes:
    """A file, or ``size`` bytes of it from ``at`` on."""
    store, base = open_store(uri)
    with store.open_input_file(f"{base}/{name}") as f:
        return f.read() if size is None else f.read_at(size, at)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of texts may hold: by bytes where Spark can, else by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    except Exception:  # older Spark: rows alone bound the batch
        pass


# ---------------------------------------------------------------- hashing

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_S33 = np.uint64(33)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (in place on a copy)."""
    h = h ^ (h >> _S33)
    h *= _M1
    h ^= h >> _S33
    h *= _M2
    h ^= h >> _S33
    return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k += m
    return out


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WS = np.zeros(256, bool)
_IS_WS[list(WS)] = True
_POW: dict[str, np.ndarray] = {}


def _pow_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        _POW["p"], _POW["q"] = _powers(_BASE, size), _powers(_BASE_INV, size)
    return _POW["p"], _POW["q"]


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, row offsets) of at most about CHUNK_BYTES of whole texts; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK_BYTES, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi - lo, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def hash_words(data: np.ndarray, off: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row: (64-bit hash, row, start byte, end byte) of every word in order."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    if lower:
        data = _LOWER[data]
    word = ~_IS_WS[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    p, q = _pow_tables(n + 1)
    acc = np.empty(n + 1, np.uint64)
    acc[0] = 0
    np.cumsum(_TABLE[data] * p[:n], out=acc[1:])
    h = mix((acc[ends] - acc[starts]) * q[starts] + (ends - starts).astype(np.uint64))
    rows = np.searchsorted(off, starts, "right") - 1
    return h, rows, starts, ends


_C = np.uint64(0x9FB21C651E98DF25)


def chain(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries (no row limits)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m] * _C
    for j in range(1, k):
        out ^= out >> np.uint64(29)
        out = (out + h[j : j + m]) * _C
    return mix(out + np.uint64(k))


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """First word of each row, n+1 entries."""
    return np.searchsorted(rows, np.arange(n + 1))


def shingle_sets(h: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """Distinct k-word shingles of each row, sorted; fewer words than k make one shingle; none make none."""
    whole, out = chain(h, k), []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        else:
            out.append(chain(h[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def crc_fold(doc_id: DataFrame | str):
    """crc32(doc_id as text) mod 5, as a column."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def crc32_of(value) -> int:
    return zlib.crc32(str(value).encode())


# ---------------------------------------------------------------- filters


BLOOM_BITS = 1 << 23


def id_filter(ids: DataFrame, col: str) -> np.ndarray:
    """A one-hash Bloom filter of fixed size over a long column, gathered as at most BLOOM_BITS/64 words.

    False positives only cost time; there are no false negatives.
    """
    bit = F.pmod(F.xxhash64(F.col(col)), F.lit(BLOOM_BITS))
    words = (
        ids.select(F.shiftright(bit, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({col}), {BLOOM_BITS}) & 63 as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .toPandas()
    )
    out = np.zeros(BLOOM_BITS // 64, np.int64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return out


# ---------------------------------------------------------------- running totals


def running_total(df: DataFrame, groups: list[str], order: list[str], amount: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` (long, none negative) over the rows of the same ``groups`` up to and including this one.

    Rows are range-sorted by groups and order, which must tell all rows apart that
    matter, and summed as they stream through each range; then each range gets the
    totals of the ranges before it, a table of one row per range and group in it.  A
    group as large as the table is spread over all ranges.
    """
    pid, own = unused("pid", df), unused("sum", df)
    kind = StructType([*df.schema.fields, StructField(own, LongType()), StructField(pid, IntegerType())])

    def add(batches):
        nr, last, carry = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            for c in groups:
                x = b.column(c)
                differ = pc.fill_null(pc.not_equal(x[1:], x[:-1]), False).to_numpy(zero_copy_only=False)
                null = x.is_null().to_numpy(zero_copy_only=False)
                new[1:] |= differ | (null[1:] != null[:-1])
            key = [b.column(c)[0].as_py() for c in groups]
            if key != last:
                carry = 0
            total = np.cumsum(b.column(amount).to_numpy(zero_copy_only=False).astype(np.int64))
            starts = [*np.flatnonzero(new), b.num_rows]
            base = np.full(b.num_rows, -carry, np.int64)
            for a, z in itertools.pairwise(starts):
                base[a:z] = total[a - 1]
            total -= base
            last, carry = [b.column(c)[-1].as_py() for c in groups], int(total[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(total), pa.array(np.full(b.num_rows, nr, np.int32))], [*b.schema.names, own, pid])

    keys = [*groups, *order]
    local = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(add, kind), "running")
    totals = local.groupBy(F.col(pid).alias("p"), *[F.col(c).alias(f"g{i}") for i, c in enumerate(groups)]).agg(F.max(own).alias("all"))
    before = Window.partitionBy(*[f"g{i}" for i in range(len(groups))]).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(totals.select("*", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("before")).drop("all"), "ranges")
    met = F.col(pid) == F.col("p")
    for i, c in enumerate(groups):
        met = met & F.col(c).eqNullSafe(F.col(f"g{i}"))
    return local.join(starts, met).select(*df.columns, (F.col(own) + F.col("before")).alias(out))


# ---------------------------------------------------------------- components


def connected_components(edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(id, comp) for every id of ``edges(src, dst)``: comp is the smallest id reachable.

    Alternating large-star / small-star rounds; each half of a round is written
    to the shared folder, and reads what is before it twice at most: the driver
    plans a stage anew as often as its plan holds it.  Groups are reduced by
    partial aggregation before each shuffle, and the joins may be split by
    adaptive execution.
    """

    def tidy(e: DataFrame) -> DataFrame:
        return e.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def ends(e: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
        return e.select(F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])).alias("x")).select("x.u", "x.v")

    def large(e: DataFrame) -> DataFrame:
        both = ends(e, ("u", "v"), ("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small(e: DataFrame) -> DataFrame:
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        return ends(e.join(low, "u"), ("v", "m"), ("u", "m"))

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        return tuple(r)

    e = materialize(tidy(edges.select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v"))), name)
    was = mark(e)
    for _ in range(max_rounds):
        if not was[0]:
            break
        for half in (large, small):
            last, e = e, materialize(tidy(half(e)), name)
            forget(last)
        now = mark(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    return ends(e, ("u", "v"), ("v", "v")).select(F.col("u").alias("id"), F.col("v").alias("comp")).distinct()
