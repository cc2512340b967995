"""Eye-closure windows on a stream: a sliding deque of observed intervals and closures in a session's state."""

from __future__ import annotations

from collections import deque
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventloom.config import DriverSettings
from eventloom.operators.machines import Closures
from eventloom.streaming.in_order import InOrder, in_order

FEATURES = "us long, tie long, observed long, positive long, closed long, missing long, blinks int, long_closures int"


class Eyes(InOrder):
    """Features of each row as ``driver.eye_features`` has them, in microseconds.

    The deque holds the intervals that end inside the window, oldest first: the
    oldest alone may begin before it and is clipped.  What has left the window is
    evicted, so state is as long as the window, not the session.
    """

    def __init__(self, schema: StructType, window: int, max_gap: int, blink: int, long: int, timeout: int):
        super().__init__(schema, "us", "tie", timeout)
        self.window, self.rules = window, (max_gap, blink, long)

    def run(self, key, rows):
        spans, ends, first, us, closed, began, seen = self.own or (deque(), deque(), *(None,) * 5)
        eyes, out = Closures(*self.rules, began, seen), []
        observed = sum(z - a for a, z, _ in spans)
        positive = sum(z - a for a, z, p in spans if p)
        for t, same in groupby(rows, key=lambda r: r.us):
            first, told = t if first is None else first, []
            for r in same:
                if closed is not None and us < t <= us + self.rules[0]:
                    spans.append((us, t, closed))
                    observed, positive = observed + t - us, positive + (t - us) * closed
                missing = t - (first if eyes.seen is None else eyes.seen) if r.closed is None else 0
                end = eyes.update(t, r.closed)
                if end:
                    ends.append((t, end[2] == "blink", end[2] == "long"))
                us, closed = t, r.closed
                told.append((r.tie, None if r.closed is None else t - eyes.began if r.closed else 0, missing))
            low = t - self.window
            while spans and spans[0][1] < low:
                a, z, p = spans.popleft()
                observed, positive = observed - (z - a), positive - (z - a) * p
            while ends and ends[0][0] < low:
                ends.popleft()
            over = max(0, low - spans[0][0]) if spans else 0
            mine = over if spans and spans[0][2] else 0
            out += [(t, tie, observed - over, positive - mine, c, m, sum(e[1] for e in ends), sum(e[2] for e in ends)) for tie, c, m in told]
        self.own = spans, ends, first, us, closed, eyes.began, eyes.seen
        return out


def eye_stream(rows: DataFrame, session: str, ts: str, tie: str, closed: str, unit: int, timeout: int, lateness: str, s: DriverSettings = DriverSettings()) -> DataFrame:
    """(session, tie, features) of a stream; ``unit`` is what the settings count in, as microseconds."""
    d = rows.select(session, F.col(ts).cast("timestamp").alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(tie).cast("long").alias("tie"), F.col(closed).alias("closed"))
    width = lambda x: round(x * unit)
    eyes = Eyes(d.select("us", "tie", "closed").schema, width(s.window), width(s.max_gap), width(s.blink), width(s.long), timeout)
    f = in_order(d, [session], "ts", eyes, FEATURES, lateness)
    of = lambda c: F.col(c) / F.lit(float(unit))
    return f.select(
        session, F.col("tie").alias(tie), of("observed").alias("observed_seconds"), of("positive").alias("positive_seconds"), F.when(F.col("observed") > 0, F.round(F.col("positive") / F.col("observed"), 4)).alias("closure_ratio"),
        of("closed").alias("closed_seconds"), of("missing").alias("missing_seconds"), "blinks", "long_closures",
    )
