"""Delayed evidence: an event's frames are told once its window is over, not when it happens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle
from pyspark.sql.types import StructType

from eventloom.streaming.in_order import InOrder, in_order

RELEASED = "event_id long, event_us long, frames array<long>, first_us long, last_us long, released_us long, truncated boolean"


class Evidence(InOrder):
    """Frames of the last ``before`` in a ring of list state; events wait for the first frame at or after their window's end.

    A session that ends earlier releases what it has, truncated, at the time its silence was noticed.
    """

    def __init__(self, schema: StructType, before: int, after: int, timeout: int):
        super().__init__(schema, "us", "frame_id", timeout)
        self.before, self.after = before, after

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "us long, frame_id long")

    def run(self, key, rows):
        ring, pending, out = [tuple(x) for x in self.ring.get()], self.own or [], []
        for r in rows:
            ring = [x for x in ring if r.us - x[0] <= self.before]
            ring.append((r.us, r.frame_id))
            for p in pending:
                if r.us <= p[1] + self.after:
                    p[2], p[4] = [*p[2], r.frame_id], r.us
            if r.event:
                # Frames at the event's own time that come later in order belong to its window as well: they are appended above.
                pending.append([r.frame_id, r.us, [x[1] for x in ring], ring[0][0], r.us])
            # A window that ends exactly here may still get frames of the same instant, so it goes with the next one.
            out += [(*p, r.us, False) for p in pending if r.us > p[1] + self.after]
            pending = [p for p in pending if r.us <= p[1] + self.after]
        self.ring.put(ring) if ring else self.ring.clear()
        self.own = pending or None
        return out

    def close_session(self, key, last):
        out = [(*p, last + self.timeout, last < p[1] + self.after) for p in self.own or ()]
        self.ring.clear()
        return out


def release_evidence(frames: DataFrame, session: str, ts: str, frame_id: str, event, before: int, after: int, timeout: int, lateness: str = "1 second") -> DataFrame:
    """(session, *RELEASED) of a stream of frames; ``event`` says which frames are events too, times are microseconds."""
    d = frames.select(session, F.col(ts).cast("timestamp").alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(frame_id).cast("long").alias("frame_id"), F.coalesce(event, F.lit(False)).alias("event"))
    return in_order(d, [session], "ts", Evidence(d.select("us", "frame_id", "event").schema, before, after, timeout), RELEASED, lateness)
