"""WARC archives: write, normalise to one gzip member a record, index, read back.

``write_monolithic`` streams pages into archives of one gzip stream each, as
crawlers leave them.  ``normalise`` inflates each archive once, rewrites every
record as a gzip member of its own and lays a sidecar offset index beside it;
records whose payload another record already has become revisits on the way.
``read_records`` seeks by the sidecar, some members at a time, and inflates each alone.

Defined results: null html is an empty payload; a null page_id is written with
an empty id, never is a first record that others refer to unless all are null,
and comes back as null; repeated rows are written each (of equal ids the first
in file order is the response); other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, get_file, materialize, put_file, shared_path, small_batches

ARCHIVE_BYTES = 32 << 20
LEVEL = 4
GZIP = 16 + zlib.MAX_WBITS


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str, payload: bytes, sha: str, refers_to: int | None = None, length: int | None = None) -> bytes:
    """One WARC/1.1 record; a revisit carries no payload but its digest and length."""
    safe = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {safe}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Payload-Length: {len(payload) if length is None else length}",
    ]
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(head).encode() + payload + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, end) of the record at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(head["Content-Length"])
    return head, data[stop + 4 : stop + 4 + n], stop + 8 + n


def _id(value: str) -> int | None:
    text = value.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def write_monolithic(pages: DataFrame) -> tuple[DataFrame, str]:
    """(index, folder): archives of single gzip streams, and file, pos, page_id, digest, length of each record."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = shared_path(spark, "warc-mono")
    kinds = {"page_id": "long", "url": "string", "html": "string"}
    pages = pages.select(*[(F.col(c) if c in pages.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        squeeze, out, rows, raw = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), [], [], 0

        def flush():
            nonlocal squeeze, out, rows, raw, seq
            name = f"mono-{part:06d}-{seq:04d}.warc.gz"
            put_file(folder, name, b"".join(out) + squeeze.flush())
            c = list(zip(*rows, strict=True))
            batch = pa.record_batch({"file": [name] * len(rows), "pos": pa.array(range(len(rows)), pa.int32()), "page_id": pa.array(c[0], pa.int64()), "digest": list(c[1]), "length": pa.array(c[2], pa.int64())})
            squeeze, out, rows, raw, seq = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), [], [], 0, seq + 1
            return batch

        for b in batches:
            for page_id, url, html in zip(*(b.column(c).to_pylist() for c in kinds), strict=True):
                payload = (html or "").encode()
                sha = digest(payload)
                data = record("response", page_id, url, payload, sha)
                out.append(squeeze.compress(data))
                rows.append((page_id, sha, len(payload)))
                raw += len(data)
                if raw >= ARCHIVE_BYTES:
                    yield flush()
        if rows:
            yield flush()

    return materialize(pages.mapInArrow(run, "file string, pos int, page_id long, digest string, length long"), "warc-index"), folder


def normalise(index: DataFrame, folder: str, min_bytes: int = 0) -> tuple[DataFrame, str]:
    """Rewrite each archive with one member a record; (archives, folder of the normalised ones).

    Of records with equal payloads of at least ``min_bytes`` the one with the
    smallest page_id stays a response, the others become revisits of it.
    """
    spark = index.sparkSession
    target = shared_path(spark, "warc")
    order = F.struct(F.col("page_id").isNull().alias("a"), F.col("page_id").alias("b"), F.col("file").alias("c"), F.col("pos").alias("d"))
    first = index.filter(F.col("length") >= min_bytes).groupBy("digest", "length").agg(F.min(order).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    again = index.join(first, ["digest", "length"]).filter("file != first.c or pos != first.d")
    again = again.select("file", "pos", F.col("first.b").alias("refers_to"))
    # Only record numbers travel to an archive's task, never payloads.
    moves = again.groupBy("file").agg(F.collect_list(F.struct("pos", "refers_to")).alias("revisits"))
    work = index.select("file").distinct().join(moves, "file", "left")

    def run(batches):
        for b in batches:
            for name, revisits in zip(b.column("file").to_pylist(), b.column("revisits").to_pylist(), strict=True):
                change = {x["pos"]: x["refers_to"] for x in revisits or []}
                data = zlib.decompress(get_file(folder, name), GZIP)
                out, offsets, at, pos, size = [], [], 0, 0, 0
                while at < len(data):
                    head, payload, at = parse(data, at)
                    page_id, sha = _id(head["WARC-Record-ID"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if pos in change:
                        raw = record("revisit", page_id, head["WARC-Target-URI"], b"", sha, change[pos], len(payload))
                    else:
                        raw = record("response", page_id, head["WARC-Target-URI"], payload, sha)
                    z = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                    member = z.compress(raw) + z.flush()
                    out.append(member)
                    offsets.append((page_id, size, len(member)))
                    size += len(member)
                    pos += 1
                new = name.replace("mono-", "pages-")
                put_file(target, new, b"".join(out))
                put_file(target, new + ".idx", json.dumps(offsets).encode())
                yield pa.record_batch({"file": [new], "n_records": pa.array([pos], pa.int64())})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Dealt in turn: by file, the join's own few partitions would be taken over and merged into one task.
    done = materialize(work.repartition(n).mapInArrow(run, "file string, n_records long"), "warc-archives")
    return done, target


def read_records(archives: DataFrame, folder: str) -> DataFrame:
    """Every record by its sidecar entry: page_id, record_type, refers_to, payload_bytes, payload_digest, url, payload."""

    def run(batches):
        for b in batches:
            for name in b.column("file").to_pylist():
                index = json.loads(get_file(folder, name + ".idx"))
                for lo in range(0, len(index), 200):
                    rows, members = [], index[lo : lo + 200]
                    first = members[0][1]
                    data = get_file(folder, name, first, members[-1][1] + members[-1][2] - first)
                    for _, at, size in members:
                        head, payload, _ = parse(zlib.decompress(data[at - first : at - first + size], GZIP))
                        refers = head.get("WARC-Refers-To")
                        sha = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if head["WARC-Type"] == "response" and digest(payload) != sha:
                            raise ValueError(f"{name}@{at}: payload differs from its digest")
                        rows.append((_id(head["WARC-Record-ID"]), head["WARC-Type"], _id(refers) if refers else None, int(head["X-Payload-Length"]), sha, head["WARC-Target-URI"], payload))
                    c = list(zip(*rows, strict=True))
                    yield pa.record_batch(
                        {
                            "page_id": pa.array(c[0], pa.int64()), "record_type": list(c[1]), "refers_to": pa.array(c[2], pa.int64()), "payload_bytes": pa.array(c[3], pa.int64()),
                            "payload_digest": list(c[4]), "url": list(c[5]), "payload": pa.array(c[6], pa.binary()),
                        }
                    )

    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string, payload binary"
    return archives.repartition(n).mapInArrow(run, kinds)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write, normalise, drop the monolithic archives, read back."""
    index, mono = write_monolithic(pages)
    archives, folder = normalise(index, mono, min_bytes)
    drop_path(pages.sparkSession, mono)
    return read_records(archives, folder)
