"""The overlap tracker on a stream: live tracks in list state, one entry a track, dropped as they end."""

from __future__ import annotations

from datetime import datetime, timezone
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle
from pyspark.sql.types import StructType

from eventloom.config import TrackSettings
from eventloom.operators.tracker import BOX, STEP_COLUMNS, Matcher
from eventloom.streaming.in_order import InOrder, in_order


class Tracks(InOrder):
    """Every track of every frame, as ``tracker.matched`` tells it; a session's silence ends its tracks."""

    def __init__(self, schema: StructType, settings: TrackSettings, timeout: int, timed: bool = False):
        super().__init__(schema, "us", "det_ix", timeout)
        self.settings, self.timed = settings, timed

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getListState("live", "track_id int, box array<double>, seen double, idle int, classes array<string>")

    def _load(self) -> tuple[Matcher, int]:
        m, at = Matcher(self.settings), 0
        if self.own is None:
            return m, at
        m.clock, m.born, at = self.own[:3]
        for i, box, seen, idle, classes in sorted(self._held(), key=lambda x: x[0]):
            m.box[i], m.seen[i], m.idle[i], m.classes[i], m.votes[i] = tuple(box), seen, idle, list(classes), {}
            for c in classes:
                m.votes[i][c] = m.votes[i].get(c, 0) + 1
        return m, at

    def _held(self):
        return self.live.get()

    def _keep(self, m: Matcher, at: int) -> None:
        live = self._live(m)
        self.live.put(live) if live else self.live.clear()
        self.own = m.clock, m.born, at

    @staticmethod
    def _live(m: Matcher) -> list[tuple]:
        return [(i, list(box), m.seen[i], m.idle[i], m.classes[i]) for i, box in m.box.items()]

    def _tell(self, steps, dets, index, at, us):
        time = (datetime.fromtimestamp(us // 1_000_000, timezone.utc).replace(microsecond=us % 1_000_000), us) if self.timed else ()
        for t, i, j, ended, idle, lead, classes in steps:
            seen = (None,) * 7 if j is None else (dets[j].class_name, dets[j].confidence, index, *(dets[j][c] for c in BOX))
            yield *time, at, t, i, j is not None, ended, idle, lead, classes, *seen

    def run(self, key, rows):
        m, at = self._load()
        out = []
        for (us, t, index), frame in groupby(rows, key=lambda r: (r.us, r.ts, r.frame_index)):
            dets = [r for r in frame if r.class_name is not None]
            out += self._tell(m.frame([(r.class_name, tuple(r[c] for c in BOX)) for r in dets], t), dets, index, at, us)
            at += 1
        self._keep(m, at)
        return out

    def close_session(self, key, last):
        m, at = self._load()
        out = list(self._tell(m.finish(), [], None, at, last + self.timeout))
        self.live.clear()
        return out


def timed_detections(dets: DataFrame, session: str, event_time: str) -> DataFrame:
    """(session, _time, us and the columns of ``Tracks``) of detections."""
    time = F.col(event_time).cast("timestamp")
    return dets.select(session, time.alias("_time"), F.unix_micros(time).alias("us"), "ts", "frame_index", "det_ix", "class_name", "confidence", *BOX)


def match_stream(dets: DataFrame, session: str, event_time: str, timeout: int, lateness: str, s: TrackSettings = TrackSettings(), emits: bool = False) -> DataFrame:
    """(session, *STEP_COLUMNS) of a stream of detections; ``tracker.described`` makes track rows of what it writes.

    With ``emits`` the steps carry event time too (time, us), for a stateful step behind this one.  ``dets`` has the columns of ``tracker.track`` and an event time that all rows of a frame share.
    """
    d = timed_detections(dets, session, event_time)
    own = Tracks(d.drop(session, "_time").schema, s, timeout, emits)
    return in_order(d, [session], "_time", own, f"time timestamp, us long, {STEP_COLUMNS}" if emits else STEP_COLUMNS, lateness, "time" if emits else "")
