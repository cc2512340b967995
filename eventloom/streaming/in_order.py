"""Event-time order inside a stream: the base of the stateful stream operators.

Rows of a session wait in state until the watermark has passed them and are
then taken in order of (time, tie), so what an operator says does not depend on
how its input was cut into micro-batches or shuffled within the lateness.  Rows
behind the watermark are dropped by Spark and counted in its progress.  Event-time
timers wake a session whose rows become due, and close one that has been silent
for ``timeout``; a closed session keeps no state.

Times are whole microseconds, so that comparisons are exact.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from itertools import chain
from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, _parse_datatype_string

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """A per-session operator that sees rows in order.

    ``schema`` is that of the input; ``us`` and ``tie`` name its time and tie-breaker.
    Subclasses take rows in ``run`` and keep what they carry on in ``own`` (plain values, None
    at first), which is read and written together with the waiting rows; further state they
    name in ``open``.  ``close_session`` is told that the session is over; ``own`` is then forgotten.
    A ``run`` that sets ``over`` ends the session itself, without waiting for its silence.
    """

    def __init__(self, schema: StructType, us: str, tie: str, timeout: int):
        self.schema, self.us, self.tie, self.timeout = schema, us, tie, timeout

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Names state beside ``own``."""

    def run(self, key: tuple, rows: list[Row]) -> Iterable[tuple]:
        """What the rows, in order and after all that came before, add to the output."""
        raise NotImplementedError

    def close_session(self, key: tuple, last: int) -> Iterable[tuple]:
        """What the end of the session adds; its last row was at ``last``."""
        return ()

    # ------------------------------------------------------------------ Spark's side

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value a session: every state call is a trip to the JVM, and those outweigh the rows.
        self.head = handle.getValueState("head", "last long, wake long, waiting binary, own binary")
        self.row, self.told = Row(*self.schema.names), Row(*self.names)
        self.order = itemgetter(*(self.schema.names.index(c) for c in (self.us, self.tie)))
        self.open(handle)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = next(rows)
        places = itemgetter(*(first.__fields__.index(c) for c in self.schema.names))
        return self._advance(key, [places(tuple(r)) for r in chain([first], rows)], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._advance(key, [], timerValues, expiredTimerInfo.getExpiryTimeInMs())

    def _advance(self, key: tuple, new: list[tuple], timers, expired: int | None = None) -> Iterator[Row]:
        mark = timers.getCurrentWatermarkInMs() * 1000
        last, wake, waiting, own = self.head.get() or (None,) * 4
        self.own, self.over = pickle.loads(own) if own is not None else None, False
        at = self.schema.names.index(self.us)
        rows = [*(pickle.loads(waiting) if waiting is not None else ()), *new]
        due = sorted((r for r in rows if r[at] < mark), key=self.order)
        rest = [r for r in rows if r[at] >= mark]
        out, part = [], []
        for r in due:
            if last is not None and r[at] - last > self.timeout:
                out += self.run(key, part) if part else ()
                out += self._close(key, last)
                part = []
            part.append(self.row(*r))
            last = r[at]
        out += self.run(key, part) if part else ()
        if self.over and not rest:
            last = self.own = None
        if last is not None and mark > last + self.timeout:
            out += self._close(key, last)
            last = None
        # Woken when the next row is due or the silence has been long enough, whichever is first.
        due_next = [min(r[at] for r in rest)] if rest else []
        if last is not None:
            due_next.append(last + self.timeout)
        then = min(due_next) // 1000 + 1 if due_next else None
        if then != wake:
            # Spark itself deletes the timer that has just expired.
            if wake is not None and wake != expired:
                self.handle.deleteTimer(wake)
            if then is not None:
                self.handle.registerTimer(then)
        if then is None:
            self.head.clear()
        else:
            self.head.update((last, then, (pickle.dumps(rest, 5) if new or due else waiting) if rest else None, pickle.dumps(self.own, 5) if self.own is not None else None))
        return (self.told(*key, *r) for r in out)

    def _close(self, key: tuple, last: int) -> Iterable[tuple]:
        said = list(self.close_session(key, last))
        self.own = None
        return said

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, keys: list[str], ts: str, processor: InOrder, adds: str, lateness: str | None, emits: str = "") -> DataFrame:
    """The output of ``processor`` over a stream: its keys and the columns ``adds``.

    ``lateness`` is None where ``ts`` comes out of another stateful step, which hands its
    watermark on.  ``emits`` names the event time of the output for a step behind this one.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    processor.names = [*keys, *_parse_datatype_string(adds).names]
    d = rows if lateness is None else rows.withWatermark(ts, lateness)
    return d.filter(F.col(ts).isNotNull()).groupBy(*keys).transformWithState(processor, f"{kinds}, {adds}", "append", "EventTime", eventTimeColumnName=emits)
