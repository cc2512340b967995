"""The base of the stream operators makes few calls of its state and wakes a session no more often than it has to."""

from __future__ import annotations

from pyspark.sql import Row
from pyspark.sql.types import LongType, StructType

from eventloom.config import RiskSettings
from eventloom.streaming.in_order import InOrder
from eventloom.streaming.sessions import Motion


class Value:
    def __init__(self):
        self.kept, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.kept

    def update(self, x):
        self.calls, self.kept = self.calls + 1, tuple(x)

    def clear(self):
        self.calls, self.kept = self.calls + 1, None


class Handle:
    """State and timers of one session, in memory."""

    def __init__(self):
        self.values, self.timers = [], set()

    def getValueState(self, name, schema):
        self.values.append(Value())
        return self.values[-1]

    getListState = getValueState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


class Counted(InOrder):
    """Numbers the rows; the row 9 ends the session."""

    def open(self, handle):
        pass

    def run(self, key, rows):
        out = []
        for r in rows:
            self.own = (self.own or 0) + 1
            out.append((r.us, self.own))
            if r.tie == 9:
                self.over = True
        return out


def test_one_value_and_one_timer_a_session():
    handle = Handle()
    op = Counted(StructType().add("us", LongType()).add("tie", LongType()), "us", "tie", 10_000_000)
    op.names = ["k", "us", "n"]
    op.init(handle)
    mk = lambda *rows: iter([Row(k=1, us=u, tie=t) for u, t in rows])
    assert list(op.handleInputRows((1,), mk((3_000_000, 2), (1_000_000, 1)), Mark(0))) == []
    assert handle.timers == {1001}
    out = [tuple(r) for r in op.handleInputRows((1,), mk((5_000_000, 3)), Mark(4000))]
    # The timer of the rows just taken is gone, so the session is not loaded a second time in this batch.
    assert out == [(1, 1_000_000, 1), (1, 3_000_000, 2)] and handle.timers == {5001}
    assert len(handle.values) == 1 and handle.values[0].calls == 4
    assert [tuple(r) for r in op.handleInputRows((1,), mk((6_000_000, 9)), Mark(7000))] == [(1, 5_000_000, 3), (1, 6_000_000, 4)]
    assert handle.timers == set() and handle.values[0].kept is None


def test_motion_keeps_all_tracks_of_a_session_apart():
    names = ["track_id", "us", "time", "ts", "at", "active", "ended", "class_name", "observed_class", "confidence", "x1", "y1", "x2", "y2"]
    m = Motion(StructType(), 100.0, RiskSettings(), 1)
    m.own = None
    row = lambda i, at, x, ended=False: Row(*names)(i, at, None, at / 10, at, not ended, ended, "dog", "dog", 0.5, x, 0.0, x + 10.0, 10.0)
    out = m.run((1,), [row(i, at, 10.0 * i + i * at) for at in range(4) for i in (1, 2)])
    last = {r[0]: r for r in out}
    assert len(out) == 8 and [last[i][9] for i in (1, 2)] == [4, 4] and [round(last[i][-1], 9) for i in (1, 2)] == [0.1, 0.2]
    m.run((1,), [row(1, 4, 0.0, True)])
    assert list(m.own) == [2] and not m.over
    m.run((1,), [row(2, 5, 0.0, True)])
    assert not m.own and m.over


def test_tracks_and_motion_in_one_step_tell_evident_tracks_and_bare_frames(spark):
    from eventloom.config import TrackSettings
    from eventloom.streaming.sessions import TRACK, Motion, Moving
    from eventloom.streaming.tracks import Tracks
    from pyspark.sql.types import _parse_datatype_string

    s, names = RiskSettings(), _parse_datatype_string(TRACK).names
    schema = _parse_datatype_string("us long, ts double, frame_index int, det_ix long, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double")
    det = lambda f, j, x: Row(*schema.names)(f * 100_000, f / 10, f, j, "dog", 0.5, x, 0.0, x + 50.0, 50.0)
    # One track stays, the others last for a frame each; the second part comes in a later batch.
    rows = [det(f, j, x) for f in range(12) for j, x in enumerate((100.0 + f, 1000.0 + 100 * f))]
    moving, tracks, motion = Moving(schema, Motion(schema, 550.0, s, 10**9), TrackSettings(), 10**9), Tracks(schema, TrackSettings(), 10**9, True), Motion(schema, 550.0, s, 10**9)
    handle = Handle()
    moving.open(handle)
    assert not handle.values
    tracks.live = type("List", (), {"kept": (), "put": lambda self, x: setattr(self, "kept", x), "get": lambda self: self.kept, "clear": lambda self: setattr(self, "kept", ())})()
    moving.own = tracks.own = motion.own = None
    got, want = [], []
    for part in (rows[:14], rows[14:]):
        got += moving.run((1,), part)
        want += motion.run((1,), [moving.step(*x) for x in tracks.run((1,), part)])
    at = {c: i for i, c in enumerate(names)}
    evident = [r for r in want if r[at["persistence"]] >= 0.5 - 1e-9 and r[at["detections"]] >= 3 and r[at["missed"]] <= 0.3 + 1e-9]
    assert [r for r in got if r[0] is not None] == evident and len(evident) == 7 < len(want)
    bare = [r for r in got if r[0] is None]
    assert sorted(r[at["us"]] for r in bare) == [f * 100_000 for f in range(5)] and all(len(r) == len(names) for r in bare)
