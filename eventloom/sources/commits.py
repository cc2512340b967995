"""Tables whose appends are all or nothing: staged data folders that count only once a commit names them.

    <table>/data/<id>/       files of one append, never changed
    <table>/commits/<n>.json  the n-th commit: the folder it adds (or the folders it leaves)

A commit file is made by an exclusive create, so of two writers one gets number n;
the other checks its keys against what came in between and tries n + 1.  A job that
fails leaves a folder that no commit names.  Stores without an exclusive create need
a lock of their own around ``commit``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from eventloom.sources.storage import file_system


class Conflict(RuntimeError):
    """Another writer took the commit."""


def _read(fs, path) -> str:
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def commits(spark: SparkSession, table: str) -> list[dict]:
    """All commits, in order."""
    fs, root = file_system(spark, f"{table.rstrip('/')}/commits")
    if not fs.exists(root):
        return []
    names = sorted((s.getPath() for s in fs.listStatus(root) if s.getPath().getName().endswith(".json")), key=lambda p: p.getName())
    return [json.loads(_read(fs, p)) for p in names]


def folders(spark: SparkSession, table: str, since: int = 0) -> list[str]:
    """Folders that the table consists of; with ``since``, those that commits after the first ``since`` added."""
    own: list[str] = []
    for i, c in enumerate(commits(spark, table)):
        own = [x for x in own if x not in c.get("drops", [])]
        own += c["adds"] if i >= since else []
    return [f"{table.rstrip('/')}/data/{x}" for x in own]


def stage(spark: SparkSession, table: str) -> tuple[str, str]:
    """(name, path) of a new folder to write an append into."""
    name = uuid.uuid4().hex
    return name, f"{table.rstrip('/')}/data/{name}"


def commit(spark: SparkSession, table: str, number: int, adds: list[str], drops: list[str] | None = None, **facts) -> None:
    """Make ``number`` (from 0) the table's next commit; Conflict where another writer has it."""
    fs, path = file_system(spark, f"{table.rstrip('/')}/commits/{number:012d}.json")
    try:
        out = fs.create(path, False)
    except Exception as e:
        if fs.exists(path):
            raise Conflict(str(path)) from e
        raise
    try:
        out.write(bytearray(json.dumps({"adds": adds, "drops": drops or [], **facts}).encode()))
    finally:
        out.close()


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that no commit names."""
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def read_json(spark: SparkSession, table: str, schema: StructType, since: int = 0) -> DataFrame:
    """The committed rows of a table of JSON lines."""
    own = folders(spark, table, since)
    return spark.read.schema(schema).json(own) if own else spark.createDataFrame([], schema)
