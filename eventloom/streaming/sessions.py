"""Session runners: detections and driver rows in, event records out, in one append query.

    detections -> tracks and motion -> hazards of a frame -+
    driver rows ------------------------------------------+-> assessment -> smoothed levels -> level events
    driver rows -> stable states -------------------------------------------------------------> state events

Each arrow into a stateful step keeps event time, so Spark hands the watermark on
and every step sees complete input in order.  A provider that failed is a driver
row whose states are UNKNOWN: it holds its place in time and changes nothing.
Seconds are ``unit`` microseconds of event time.
"""

from __future__ import annotations

import math
from collections import deque, namedtuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from eventloom.config import EPS, LEVELS, EventSettings, RiskSettings, TrackSettings
from eventloom.functions.columns import level_name, rank
from eventloom.operators import risk
from eventloom.operators.machines import Cooldown, Debounce, Hysteresis
from eventloom.operators.records import event_records
from eventloom.operators.tracker import BOX, STEP_COLUMNS
from eventloom.streaming.in_order import InOrder, in_order
from eventloom.streaming.tracks import Tracks, timed_detections

TRACK = (
    "track_id int, time timestamp, us long, ts double, at int, class_name string, observed_class string, mean_confidence double, persistence double, detections int, missed double, label_changes int, "
    "cx double, cy double, y2 double, box_w double, box_h double, area double, vx double, vy double, area_rate double, growth double, lateral double"
)


def slope(points: list[tuple[float, float]]) -> float:
    """Least-squares slope of (t, y); 0 without spread.  Moments are added up as ``ordered.trailing_slope`` does."""
    n, mt, my, joint, spread = 0, 0.0, 0.0, 0.0, 0.0
    for t, y in points:
        n, dt = n + 1, t - mt
        mt, my = mt + dt / n, my + (y - my) / n
        joint, spread = math.fma(dt, y - my, joint), spread + dt * (t - mt)
    return (joint / n) / (spread / n) if spread > 0 else 0.0


class Motion(InOrder):
    """A track's row at every frame: means, counts, rates, and slopes over the last observations; an ended track keeps nothing.

    All tracks of a session are kept together: there are many more of them than sessions, and each key costs calls in every batch.
    """

    def __init__(self, schema: StructType, width: float, settings: RiskSettings, timeout: int):
        super().__init__(schema, "us", "at", timeout)
        self.width, self.s = width, settings

    def run(self, key, rows):
        tracks, of, out = self.own or {}, {}, []
        for r in rows:
            of.setdefault(r.track_id, []).append(r)
        for i, mine in of.items():
            kept, said = self._track(tracks.pop(i, None), mine)
            if kept is not None:
                tracks[i] = kept
            out += ((i, *x) for x in said)
        self.own, self.over = tracks, not tracks
        return out

    def _track(self, held, rows):
        """(what is kept of a track, its rows)."""
        recent, kept = held or (deque(), None)
        out, s = [], self.s
        first, total, n, changes, label, last, *box = kept[:10] if kept is not None else (None, 0.0, 0, 0, None, None, *(None,) * 4)
        vx, vy, ar, growth, lateral = kept[10:] if kept is not None else (None,) * 5
        for r in rows:
            if r.ended:
                continue
            if r.active:
                new, old = [r.x1, r.y1, r.x2, r.y2], box
                area = (new[2] - new[0]) * (new[3] - new[1])
                if last is not None and r.ts - last > EPS:
                    dt = r.ts - last
                    vx, vy = ((new[0] + new[2] - old[0] - old[2]) / 2 / dt, (new[1] + new[3] - old[1] - old[3]) / 2 / dt)
                    ar = (area - (old[2] - old[0]) * (old[3] - old[1])) / dt
                changes += label is not None and label != r.observed_class
                first, total, n, label, last, box = (r.ts if first is None else first), total + r.confidence, n + 1, r.observed_class, r.ts, new
                recent.append((r.ts, math.log(area) if area > 0 else None, (new[0] + new[2]) / 2 / self.width))
                while recent[0][0] < r.ts - (s.window + EPS):
                    recent.popleft()
                enough = len(recent) >= s.min_samples and recent[-1][0] - recent[0][0] >= s.min_span - EPS
                growth = slope([(t, y) for t, y, _ in recent if y is not None]) if enough else None
                lateral = slope([(t, c) for t, _, c in recent]) if enough else None
            w, h = box[2] - box[0], box[3] - box[1]
            out.append((r.time, r.us, r.ts, r.at, r.class_name, label, total / n, last - first, n, r.ts - last, changes, (box[0] + box[2]) / 2, (box[1] + box[3]) / 2, box[3], w, h, w * h, vx, vy, ar, growth, lateral))
        if rows[-1].ended or not n:
            return None, out
        return (recent, (first, total, n, changes, label, last, *box, vx, vy, ar, growth, lateral)), out


class Moving(Tracks):
    """Tracks and their motion in one step: the rows of tracks with the evidence a hazard needs, and of a frame without any, one that only says that it was there.

    Most tracks are too short to count, and each row out of one step and into another costs more than what is worked out for it.
    """

    def __init__(self, schema: StructType, motion: Motion, settings: TrackSettings, timeout: int):
        super().__init__(schema, settings, timeout, True)
        self.motion = motion
        self.steps = ["time", "us", *_parse_datatype_string(STEP_COLUMNS).names]
        self.said = {c: i for i, c in enumerate(_parse_datatype_string(TRACK).names)}

    def open(self, handle):
        self.step = namedtuple("Step", self.steps)

    def _held(self):
        return self.own[3]

    def _keep(self, m, at):
        self.own = m.clock, m.born, at, self._live(m), self.motion.own

    def run(self, key, rows):
        self.motion.own = self.own[4] if self.own is not None else None
        steps = super().run(key, rows)
        moved = self.motion.run(key, [self.step(*x) for x in steps])
        self.own = (*self.own[:4], self.motion.own)
        return self._evident(moved)

    def _evident(self, rows):
        s, c, frames, out = self.motion.s, self.said, {}, []
        for r in rows:
            frame = tuple(r[c[x]] for x in ("time", "us", "ts", "at"))
            told = r[c["persistence"]] >= s.min_persistence - EPS and r[c["detections"]] >= s.min_detections and r[c["missed"]] <= s.max_missed + EPS
            frames[frame] = frames.get(frame, False) or told
            if told:
                out.append(r)
        return out + [(None, *frame, *(None,) * (len(c) - 5)) for frame, told in frames.items() if not told]

    def close_session(self, key, last):
        return ()


class Carry(InOrder):
    """Frames with the latest driver row: its columns, and how old it is in seconds (null before the first)."""

    def __init__(self, schema: StructType, frame: list[str], states: list[str], unit: int, timeout: int):
        super().__init__(schema, "us", "tie", timeout)
        self.frame, self.states, self.unit = frame, states, unit

    def run(self, key, rows):
        driver, out = self.own, []
        for r in rows:
            if r.is_frame:
                age = None if driver is None else (r.us - driver[0]) / self.unit
                out.append((*(r[c] for c in self.frame), *(driver[1:] if driver is not None else (None,) * len(self.states)), age))
            else:
                driver = (r.us, *(r[c] for c in self.states))
        self.own = driver
        return out


class Levels(InOrder):
    """Level events: smoothed level and score of each frame, told where the level changes."""

    def __init__(self, schema: StructType, settings: RiskSettings, timeout: int):
        super().__init__(schema, "us", "tie", timeout)
        self.s = settings

    def run(self, key, rows):
        m, score, out = Hysteresis(self.s), None, []
        if (kept := self.own) is not None:
            m.last, m.level, m.below, m.streaks, score = kept[0], kept[1], kept[2], list(kept[3:6]), kept[6]
        for r in rows:
            before, last = m.level, m.last
            fresh = last is None or r.ts - last > self.s.reset_gap
            score = r.raw_score if fresh else max(r.raw_score, score - self.s.decay * (r.ts - last))
            level = m.update(r.ts, r.raw_rank)
            if level != before:
                out.append((*(r[c] for c in self.schema.names), before, level, score))
        self.own = m.last, m.level, m.below, *m.streaks, score
        return out


class Stable(InOrder):
    """Changes of a driver's stable states, each (kind, from, to) at most once in its cooldown."""

    def __init__(self, schema: StructType, kinds: list[str], settings: EventSettings, unit: int, timeout: int):
        super().__init__(schema, "us", "tie", timeout)
        self.kinds, self.s, self.unit = kinds, settings, unit

    def run(self, key, rows):
        (states, told), out = self.own or ({}, {}), []
        for kind in self.kinds:
            m = Debounce(self.s.change_observations)
            if kind in states:
                m.stable, m.candidate, m.count = states[kind]
            for r in rows:
                if (change := m.update(r[kind])) is None:
                    continue
                k = (kind, *change)
                c = Cooldown(self.s.change_cooldown * self.unit, told.get(k))
                if c.update(float(r.us)):
                    told[k] = c.last
                    out.append((r.time, r.us, r.tie, kind, *change))
            states[kind] = m.stable, m.candidate, m.count
        self.own = states, told
        return sorted(out, key=lambda x: x[1:4])


def _step(rows: DataFrame, keys: list[str], processor: InOrder, adds: str, lateness: str | None = None) -> DataFrame:
    return in_order(rows, keys, "time", processor, adds, lateness, emits="time")


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def assessed_frames(dets: DataFrame, driver: DataFrame, session: str, unit: int, timeout: int, lateness: str, size: tuple[float, float], s: RiskSettings = RiskSettings(), t: TrackSettings = TrackSettings(), rename=lambda tracks: tracks) -> DataFrame:
    """The assessment of every frame of a stream of detections and one of driver rows (``session, time``, states)."""
    d = timed_detections(dets, session, "time")
    moving = Moving(d.drop(session, "_time").schema, Motion(StructType(), size[0], s, timeout), t, timeout)
    tracks = in_order(d, [session], "_time", moving, TRACK, lateness, "time").withColumns({"width": F.lit(float(size[0])), "height": F.lit(float(size[1]))})
    seen = ["time", "us", "ts"]
    hazards = risk.track_hazards(rename(tracks).withColumn("confidence", F.col("mean_confidence")), s, keep=True)
    cols = ["track_id", "class_name", "hazard_type", "qualifies", "points", "quality", "factors", "groups", "phrases", "observed_class", "mean_confidence", "persistence", "detections", "label_changes", "cx", "cy", "box_w", "box_h", "area", "vx", "vy", "area_rate", "growth", "lateral"]
    # A track without evidence of a hazard, or a row without a track, still says that there was a frame.
    h = hazards.select(session, *seen, *[F.when(F.col("evident"), F.col(c)).alias(c) for c in cols])
    first = F.max_by(F.struct(*cols), F.struct("qualifies", "points", (-F.col("track_id")).alias("least")))
    frames = h.groupBy(session, *seen).agg(F.count_if("qualifies").cast("int").alias("n_qualifying"), first.alias("p"))
    frames = frames.withColumns({"is_frame": F.lit(True), "tie": F.lit(1)})
    states = [c for c in driver.columns if c not in (session, "time")]
    d = driver.select(session, F.col("time").cast("timestamp").alias("time"), *states).withWatermark("time", lateness)
    d = d.withColumns({"us": F.unix_micros("time"), "is_frame": F.lit(False), "tie": F.lit(0)})
    both = frames.unionByName(d, allowMissingColumns=True)
    # The latest driver row comes before a frame of its own instant.
    keep = ["time", "us", "ts", "n_qualifying", "p"]
    carry = Carry(both.select("us", "tie", "is_frame", *[c for c in keep if c != "us"], *states).schema, keep, states, unit, timeout)
    f = _step(both, [session], carry, f"{_ddl(both.select(*keep, *states).schema)}, driver_age double")
    own = ["track_id", "class_name", "hazard_type", "qualifies", "points", "quality", "factors", "groups", "phrases"]
    return risk.assess(f.select("*", *[F.col(f"p.{c}").alias(f"p_{c}") for c in own]), s)


def smoothed_levels(rows: DataFrame, session: str, ts: str, tie: str, unit: int, timeout: int, lateness: str, s: RiskSettings = RiskSettings()) -> DataFrame:
    """Level changes (seconds, previous, level, score) of a stream of assessments (session, ts, tie, raw_rank, raw_score)."""
    t = F.col(ts).cast("timestamp")
    d = rows.select(session, t.alias("time"), F.unix_micros(t).alias("us"), (F.unix_micros(t) / F.lit(float(unit))).alias("ts"), F.col(tie).cast("long").alias("tie"), F.col("raw_rank").cast("int").alias("raw_rank"), "raw_score")
    own = d.drop(session)
    told = in_order(d, [session], "time", Levels(own.schema, s, timeout), f"{_ddl(own.schema)}, previous_rank int, rank int, smoothed_score double", lateness)
    return told.select(session, F.col("ts").alias("seconds"), F.col("tie").alias(tie), level_name("previous_rank").alias("previous"), level_name("rank").alias("level"), F.col("smoothed_score").alias("score"))


def run_sessions(
    dets: DataFrame, driver: DataFrame, session: str, unit: int, timeout: int, lateness: str, size: tuple[float, float], kinds: list[str], risk_settings: RiskSettings = RiskSettings(), track_settings: TrackSettings = TrackSettings(), event_settings: EventSettings = EventSettings(), rename=lambda tracks: tracks, **fixed_values
) -> DataFrame:
    """The 60 columns of the event table for every level change and every driver-state change of two streams.

    ``dets``: what ``match_stream`` takes, with event time ``time``; ``driver``: session, time,
    drowsiness_level, driver_activity, head_away_seconds, observation_quality and the ``kinds`` watched.
    """
    a = assessed_frames(dets, driver, session, unit, timeout, lateness, size, risk_settings, track_settings, rename)
    given = a.select("time", "us", "ts", F.lit(0).alias("tie"), session, "raw_rank", "raw_score", "hazard", "primary_track", "reason", "factors", "gates", "risk_notes", "evidence_quality", "p", *[c for c in a.columns if c in ("hand_state", "drowsiness_level", "drowsiness_score", "driver_activity")])
    rows = given.drop(session)
    told = _step(given, [session], Levels(rows.schema, risk_settings, timeout), f"{_ddl(rows.schema)}, previous_rank int, rank int, smoothed_score double")
    shown = F.col("primary_track").isNotNull()
    seen = ["observed_class", "class_name", "persistence", "detections", "label_changes", "cx", "cy", "box_w", "box_h", "area", "vx", "vy", "area_rate", "growth"]
    level = told.select(
        session, "us", F.col("ts").alias("timestamp"), F.when(F.col("rank") > F.col("previous_rank"), "RISK_ESCALATED").otherwise("RISK_DEESCALATED").alias("event_type"), level_name("previous_rank").alias("previous_risk_level"), level_name("rank").alias("level"),
        *[c for c in told.columns if c not in (session, "us", "ts", "p", "time", "tie", "rank", "previous_rank", "raw_rank")], *[F.when(shown, F.col(f"p.{c}")).alias(c) for c in seen], F.when(shown, F.col("p.mean_confidence")).alias("confidence"),
    ).withColumns({"observation_type": F.lit("INFERRED"), "transition": F.concat("previous_risk_level", F.lit("->"), "level"), "alarm_recommended": rank("level") >= LEVELS.index(risk_settings.alarm_level), "width": F.lit(size[0]), "height": F.lit(size[1])})
    watched = driver.select(session, F.col("time").cast("timestamp").alias("time"), *kinds).withColumns({"us": F.unix_micros(F.col("time").cast("timestamp")), "tie": F.lit(0)})
    stable = Stable(watched.select("us", "time", "tie", *kinds).schema, kinds, event_settings, unit, timeout)
    c = _step(watched, [session], stable, "time timestamp, us long, tie int, change_kind string, before string, after string", lateness)
    change = c.select(
        session, "us", "change_kind", (F.col("us") / F.lit(float(unit))).alias("timestamp"), F.lit("DRIVER_STATE_CHANGE").alias("event_type"), F.concat("before", F.lit("->"), "after").alias("transition"), F.when(F.col("change_kind") == "hand_state", "OBSERVED").otherwise("INFERRED").alias("observation_type")
    )
    made = lambda d: event_records(d.withColumns({"event_id": F.concat_ws("_", F.lit("event"), session, "us", F.coalesce(F.col("change_kind") if "change_kind" in d.columns else F.lit(None), F.lit("level"))), "session_id": F.col(session).cast("string")}), **fixed_values)
    return made(level).unionByName(made(change))

