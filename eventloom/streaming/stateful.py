"""The session folds on a stream: the same machines as in batch, their state typed, in event-time order, gone after a session's silence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventloom.config import EventSettings, RiskSettings
from eventloom.operators.machines import Cooldown, Debounce, GridSampler, Hysteresis, Printer
from eventloom.streaming.in_order import InOrder, in_order


@dataclass(frozen=True)
class Kind:
    """A machine on a stream: how to make it, its state's columns, how to write and read them, and what it says of a row (None: nothing)."""

    make: Callable
    state: str
    dump: Callable
    load: Callable
    step: Callable


def _set(m, **values) -> None:
    for k, v in values.items():
        setattr(m, k, v)


class Fold(InOrder):
    """Rows that a machine keeps, with what it adds."""

    def __init__(self, schema: StructType, kind: Kind, keep: list[str], timeout: int):
        super().__init__(schema, "us", "tie", timeout)
        self.kind, self.keep = kind, keep

    def run(self, key, rows):
        m, kept, out = self.kind.make(), self.own, []
        if kept is not None:
            self.kind.load(m, kept)
        for r in rows:
            if (said := self.kind.step(m, r)) is not None:
                out.append((*(r[c] for c in self.keep), *said))
        self.own = self.kind.dump(m)
        return out


def fold_stream(rows: DataFrame, keys: list[str], ts: str, tie: str, kind: Kind, columns: list[str], adds: str, timeout: int, lateness: str) -> DataFrame:
    """(keys, ts, tie, columns, adds) of the rows that the machine keeps; ``timeout`` in microseconds."""
    d = rows.select(*keys, F.col(ts).cast("timestamp").alias("_time"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(tie).alias("tie"), *columns)
    own = Fold(d.select("us", "tie", *columns).schema, kind, ["us", "tie", *columns], timeout)
    kinds = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in ["us", "tie", *columns])
    out = in_order(d, keys, "_time", own, f"{kinds}, {adds}" if adds else kinds, lateness)
    return out.select(*keys, F.timestamp_micros("us").alias(ts), F.col("tie").alias(tie), *[c for c in out.columns if c not in (*keys, "us", "tie")])


def hysteresis_stream(rows: DataFrame, keys: list[str], ts: str, t: str, raw: str, tie: str, timeout: int, lateness: str, s: RiskSettings = RiskSettings()) -> DataFrame:
    """Smoothed level of each row; ``t`` is its time in seconds."""
    load = lambda m, x: _set(m, last=x[0], level=x[1], below=x[2], streaks=list(x[3:]))
    kind = Kind(lambda: Hysteresis(s), "last double, level int, below int, s1 int, s2 int, s3 int", lambda m: (m.last, m.level, m.below, *m.streaks), load, lambda m, r: (m.update(r[t], r[raw]),))
    return fold_stream(rows, keys, ts, tie, kind, [t, raw], "level int", timeout, lateness)


def cooldown_stream(rows: DataFrame, keys: list[str], ts: str, t: str, tie: str, seconds: float, timeout: int, lateness: str) -> DataFrame:
    """Rows at least ``seconds`` after the last kept row of their key."""
    kind = Kind(lambda: Cooldown(seconds), "last double", lambda m: (m.last,), lambda m, x: _set(m, last=x[0]), lambda m, r: () if m.update(r[t]) else None)
    return fold_stream(rows, keys, ts, tie, kind, [t], "", timeout, lateness)


def sampled_stream(rows: DataFrame, keys: list[str], ts: str, t: str, tie: str, fps: float, timeout: int, lateness: str) -> DataFrame:
    """Frames on a grid of ``fps``."""
    kind = Kind(lambda: GridSampler(fps), "due double", lambda m: (m.next,), lambda m, x: _set(m, next=x[0]), lambda m, r: () if m.update(r[t]) else None)
    return fold_stream(rows, keys, ts, tie, kind, [t], "", timeout, lateness)


def emitted_stream(rows: DataFrame, keys: list[str], ts: str, t: str, state: str, tie: str, every: float, timeout: int, lateness: str) -> DataFrame:
    """Rows worth printing: of a new state (text), or ``every`` seconds after the last."""
    kind = Kind(lambda: Printer(every), "last double, state string", lambda m: (m.at, m.state), lambda m, x: _set(m, at=x[0], state=x[1]), lambda m, r: () if m.update(r[t], r[state]) else None)
    return fold_stream(rows, keys, ts, tie, kind, [t, state], "", timeout, lateness)


def debounce_stream(rows: DataFrame, keys: list[str], ts: str, value: str, tie: str, timeout: int, lateness: str, s: EventSettings = EventSettings()) -> DataFrame:
    """Changes of the stable value."""
    kind = Kind(lambda: Debounce(s.change_observations), "stable string, candidate string, count int", lambda m: (m.stable, m.candidate, m.count), lambda m, x: _set(m, stable=x[0], candidate=x[1], count=x[2]), lambda m, r: m.update(r[value]))
    return fold_stream(rows, keys, ts, tie, kind, [value], "previous string, changed string", timeout, lateness).drop(value).withColumnRenamed("changed", "value")


def windowed_counts(rows: DataFrame, ts: str, key: str, width: str, lateness: str) -> DataFrame:
    """Event-time tumbling counts behind a watermark."""
    return rows.withWatermark(ts, lateness).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def unique_events(rows: DataFrame, ts: str, keys: list[str], lateness: str) -> DataFrame:
    """First of each key within the watermark."""
    return rows.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)
