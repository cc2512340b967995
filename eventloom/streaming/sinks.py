"""Alert sinks behind one stream: every sink gets every batch, once, across restarts.

A sink is a callable (rows, batch id).  What a sink has taken is noted in a ledger
in the shared folder, so a batch that Spark runs again after a crash goes only to
the sinks that had not finished it.  A table sink writes a batch into a folder of
its own, replacing what a crash left there: exactly once.  A sink with effects
outside (a bell, a message) may see a batch twice if it crashes between its effect
and its note.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.columns import rank
from eventloom.operators.recorder import SEVERITY, lookup
from eventloom.sources.storage import file_system

Sink = Callable[[DataFrame, int], None]


class Ledger:
    """Which sink has finished which batch, as empty files."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def has(self, sink: str, batch: int) -> bool:
        fs, p = file_system(self.spark, f"{self.folder}/{sink}/{batch}")
        return fs.exists(p)

    def note(self, sink: str, batch: int) -> None:
        fs, p = file_system(self.spark, f"{self.folder}/{sink}/{batch}")
        fs.create(p, True).close()


def json_sink(folder: str) -> Sink:
    """Alerts as JSON lines, nulls kept, a folder a batch."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder.rstrip('/')}/batch={batch}")

    return write


def csv_sink(folder: str) -> Sink:
    """A timeline as CSV, a folder a batch; lists as text."""

    def write(rows: DataFrame, batch: int) -> None:
        flat = [F.concat_ws("|", f.name).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in rows.schema]
        rows.select(*flat).write.mode("overwrite").option("header", True).csv(f"{folder.rstrip('/')}/batch={batch}")

    return write


class Bell:
    """Rings for each alert that asks for a sound: three times for the highest severity, once for the others."""

    def __init__(self, out=None):
        self.out, self.rings = out, 0

    def __call__(self, rows: DataFrame, batch: int) -> None:
        loud = F.array_contains("channels", "sound")
        n = rows.filter(loud).agg(F.coalesce(F.sum(F.when(F.col("severity") == "HIGH", 3).otherwise(1)), F.lit(0))).head()[0]
        self.rings += n
        if self.out is not None:
            self.out.write("\a" * n)


def console_sink(limit: int = 20, out=None) -> Sink:
    """The newest alerts of a batch as lines, and how many more there were; the limit is the console's own."""

    def write(rows: DataFrame, batch: int) -> None:
        to = out or sys.stdout
        kept = rows.orderBy(F.desc("t")).limit(limit).collect()
        for r in reversed(kept):
            to.write(f"{r['t']:8.2f} {r['severity']:<8} {r['session_id']} {r['headline']}\n")
        if (more := rows.count() - len(kept)) > 0:
            to.write(f"... and {more} more\n")

    return write


def fan_out(stream: DataFrame, sinks: dict[str, Sink], ledger: str, checkpoint: str, name: str | None = None):
    """Start a query that hands every micro-batch to all sinks; what is there now is taken, then it ends."""
    notes = Ledger(stream.sparkSession, ledger)

    def hand_on(rows: DataFrame, batch: int) -> None:
        waiting = [k for k in sinks if not notes.has(k, batch)]
        if not waiting:
            return
        # Worked out once for all sinks; lost blocks are worked out again from the batch's own input.
        rows = rows.persist()
        try:
            for k in waiting:
                sinks[k](rows, batch)
                notes.note(k, batch)
        finally:
            rows.unpersist()

    w = stream.writeStream.foreachBatch(hand_on).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (w.queryName(name) if name else w).start()


def alert_rows(levels: DataFrame, session: str, t: str, also: list[str] = []) -> DataFrame:  # noqa: B006
    """Alerts of level events (``previous``, ``level``) of a stream: severity, channels and headline of each, with an id made of session and time; ``also`` names columns to keep."""
    d = levels.withColumn("escalation", rank("level") > rank("previous"))
    loud = F.col("escalation") & (rank("level") >= 2)
    return d.select(
        F.concat_ws("_", F.lit("alert"), F.col(session), F.col(t)).alias("alert_id"), F.col(session).alias("session_id"), F.col(t).cast("double").alias("t"), "previous", "level", lookup(SEVERITY, "level").alias("severity"), "escalation",
        F.when(loud, F.array(F.lit("console"), F.lit("sound"))).otherwise(F.array(F.lit("console"))).alias("channels"), F.concat(F.when(F.col("escalation"), "Risk up: ").otherwise("Risk down: "), "previous", F.lit(" to "), F.col("level")).alias("headline"), *also,
    )
