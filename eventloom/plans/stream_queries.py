"""Streams over the event table, each replayed slice by slice and held against SQL over the whole of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.config import EventSettings
from eventloom.operators import driver
from eventloom.operators.tracker import described
from eventloom.functions.columns import level_for_score
from eventloom.plans.adapter import BOXES_SQL, HOURS, STEPS_SQL, boxes, table
from eventloom.plans.registry import query
from eventloom.plans.risk_queries import HAZARDS_SQL, TRACKS_SELECT, risk_levels, track_columns, tracks_sql, with_car_names
from eventloom.plans.sequence_queries import EYE_SQL, EYES, HYST_SQL
from eventloom.schemas import validated
from eventloom.streaming.evidence import release_evidence
from eventloom.streaming.eyes import eye_stream
from eventloom.streaming.joins import backward_tail, backward_within
from eventloom.streaming.replay import END, replay, run_to_table
from eventloom.sources.storage import new_path
from eventloom.streaming.sessions import run_sessions, smoothed_levels
from eventloom.streaming.sinks import Bell, alert_rows, fan_out, json_sink
from eventloom.streaming.tracks import match_stream

#: Slices that a replay is cut into.
SLICES = 4
HOUR = 3_600_000_000
#: A session's silence of two days closes it.
SILENCE = 48 * HOUR


def sessions(spark, d):
    return table(spark, d, "events").withColumnRenamed("user_id", "session_id")


@query("stream_evidence", f"""WITH e AS (SELECT user_id AS session_id, event_id, event_type, epoch_us(ts) AS us FROM events),
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY session_id ORDER BY us, event_id) > {SILENCE} THEN 1 ELSE 0 END AS cut FROM e),
s AS (SELECT *, sum(cut) OVER (PARTITION BY session_id ORDER BY us, event_id) AS part FROM g), l AS (SELECT session_id, part, max(us) AS last FROM s GROUP BY ALL)
SELECT a.session_id, a.event_id, count(*) FILTER (b.us BETWEEN a.us - {5 * HOUR} AND a.us + {5 * HOUR}) AS n_frames, sum(b.event_id) FILTER (b.us BETWEEN a.us - {5 * HOUR} AND a.us + {5 * HOUR})::BIGINT AS frame_sum,
  coalesce(min(b.us) FILTER (b.us > a.us + {5 * HOUR}), min(last) + {SILENCE}) AS released_us, min(last) < a.us + {5 * HOUR} AS truncated
FROM s a JOIN s b ON a.session_id = b.session_id AND a.part = b.part JOIN l ON l.session_id = a.session_id AND l.part = a.part WHERE a.event_type = 'error' GROUP BY a.session_id, a.event_id, a.us""")
def stream_evidence(spark, d):
    """Evidence of each error event, released when its window is over."""
    s, late = replay(sessions(spark, d), "ts", "session_id", SLICES, "49 hours")
    out = run_to_table(release_evidence(s, "session_id", "ts", "event_id", F.col("event_type") == "error", 5 * HOUR, 5 * HOUR, SILENCE, late), "evidence")
    total = F.aggregate("frames", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.filter(F.col("session_id") != END).select("session_id", "event_id", F.size("frames").cast("long").alias("n_frames"), total.alias("frame_sum"), "released_us", "truncated")


SIDES_SQL = "WITH e AS (SELECT user_id AS session_id, event_id, event_type, epoch_us(ts) AS us FROM events), p AS (SELECT * FROM e WHERE event_type = 'purchase'), f AS (SELECT session_id, us AS fus, event_id AS fix FROM e WHERE event_type = 'view')"


def _sides(spark, d, quiet):
    """The two kinds of events as two streams of their own."""
    s = sessions(spark, d).select("session_id", "event_id", "event_type", "ts")
    side = lambda kind: replay(s.filter(F.col("event_type") == kind), "ts", "session_id", SLICES, quiet)
    (p, late), (f, late2) = side("purchase"), side("view")
    return p, f.withColumnRenamed("event_id", "fix"), max(late, late2, key=lambda x: int(x.split()[0]))


@query("stream_asof_staleness", f"""{SIDES_SQL} SELECT p.session_id, p.event_id, CASE WHEN p.us - f.fus <= {24 * HOUR} THEN f.fix END AS fix FROM p ASOF LEFT JOIN f ON p.session_id = f.session_id AND p.us >= f.fus""")
def stream_asof_staleness(spark, d):
    """The latest view within a day of each purchase, by an interval join of two streams."""
    p, f, late = _sides(spark, d, "72 hours")
    out = run_to_table(backward_within(p, f.withColumnRenamed("ts", "rt"), ["session_id"], "event_id", "ts", "rt", ["fix"], "24 HOURS", late), "asof")
    return out.filter(F.col("session_id") != END).select("session_id", "event_id", "fix")


@query("stream_asof_tail", f"""{SIDES_SQL}, l AS (SELECT session_id, max(fus) AS last FROM f GROUP BY 1), j AS (SELECT p.session_id, p.event_id, p.us, f.fix FROM p ASOF LEFT JOIN f ON p.session_id = f.session_id AND p.us >= f.fus)
SELECT j.session_id, j.event_id, CASE WHEN j.us <= l.last + {24 * HOUR} THEN j.fix END AS fix FROM j LEFT JOIN l USING (session_id)""")
def stream_asof_tail(spark, d):
    """The latest view before each purchase, none once the views have ended a day ago."""
    s, late = replay(sessions(spark, d).select("session_id", "event_id", "event_type", "ts").filter("event_type IN ('purchase', 'view')"), "ts", "session_id", SLICES, "400 days")
    views = s.filter("event_type = 'view' OR event_type IS NULL").withColumn("fix", F.col("event_id"))
    joined = backward_tail(s.filter("event_type = 'purchase'"), views, ["session_id"], "event_id", "ts", "ts", ["fix"], 24 * HOUR, 399 * 24 * HOUR, late)
    return run_to_table(joined, "asof").filter(F.col("session_id") != END).select("session_id", F.col("left_id").alias("event_id"), "fix")


#: A frame is a day of the calendar here, as a stream does not know when a session began.
DAY_FRAMES_SQL = f"""{STEPS_SQL}, {BOXES_SQL}, day AS (SELECT b.*, (epoch_us(e.ts) // {24 * HOUR} - 19700)::BIGINT AS day FROM boxes b JOIN events e USING (event_id)),
fr AS (SELECT session_id, day AS frame, day * 0.1::DOUBLE AS ts, row_number() OVER (PARTITION BY session_id ORDER BY day) AS rn, list({{'c': class_name, 'conf': (event_id % 100) / 100.0::DOUBLE, 'x1': x1::DOUBLE, 'y1': y1::DOUBLE, 'x2': x2::DOUBLE, 'y2': y2::DOUBLE}} ORDER BY event_id) AS dets FROM day GROUP BY session_id, day)"""


def day_detections(spark, d):
    """The boxes of ``adapter.boxes`` in frames of calendar days, with the day's begin as their event time."""
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (24 * HOUR)).cast("long")
    when = sessions(spark, d).select("event_id", day.alias("day"))
    b = boxes(spark, d).join(when, "event_id")
    return b.select(
        "session_id", F.timestamp_micros(F.col("day") * (24 * HOUR)).alias("time"), ((F.col("day") - 19700) * 0.1).alias("ts"), (F.col("day") - 19700).cast("int").alias("frame_index"), F.col("event_id").alias("det_ix"),
        "class_name", ((F.col("event_id") % 100) / F.lit(100.0)).alias("confidence"), "x1", "y1", "x2", "y2",
    )


@query("stream_tracks", tracks_sql(DAY_FRAMES_SQL, TRACKS_SELECT))
def stream_tracks(spark, d):
    """Tracks whose matching ran on a stream of frames; a month of silence ends a session."""
    s, late = replay(day_detections(spark, d), "time", "session_id", SLICES, "40 days")
    steps = run_to_table(match_stream(s, "session_id", "time", 31 * 24 * HOUR, late), "track-steps")
    return track_columns(described(steps.filter(F.col("session_id") != END)))


EYE_US_SQL = EYE_SQL.replace("round(closed_seconds, 6) AS closed_seconds", "round(closed_seconds * 3.6e9)::BIGINT AS closed_us").replace("round(CASE WHEN closed IS NULL THEN t - coalesce(seen, t0) ELSE 0 END, 6) AS missing_seconds", "round(CASE WHEN closed IS NULL THEN t - coalesce(seen, t0) ELSE 0 END * 3.6e9)::BIGINT AS missing_us")


@query("stream_eyes", EYE_US_SQL)
def stream_eyes(spark, d):
    """Eye features and drowsiness of each row of a stream."""
    s, late = replay(sessions(spark, d).select("session_id", "event_id", "event_type", "ts"), "ts", "session_id", SLICES, "40 days")
    s = s.withColumn("closed", F.when(F.col("event_type") == "error", None).otherwise(F.col("event_type").isin("view", "click")))
    f = eye_stream(s, "session_id", "ts", "event_id", "closed", HOUR, 31 * 24 * HOUR, late, EYES)
    score, level = driver.drowsiness("closure_ratio", "closed_seconds", "long_closures", "observed_seconds", EYES)
    us = lambda c: F.round(F.col(c) * 3.6e9).cast("long")
    f = f.select("session_id", "event_id", "closure_ratio", us("closed_seconds").alias("closed_us"), "blinks", "long_closures", us("missing_seconds").alias("missing_us"), score.alias("score"), level.alias("level"))
    return run_to_table(f, "eyes").filter(F.col("session_id") != END)


#: Microseconds of a session's second, as a frame of a day is a tenth of one.
UNIT = 10 * 24 * HOUR
_STATES = """st AS (SELECT user_id AS session_id, event_id, epoch_us(ts) AS us, CASE WHEN least(value, 100.0) >= 70 THEN 'CRITICAL' WHEN least(value, 100.0) >= 45 THEN 'HIGH' ELSE 'LOW' END AS lv, event_id % 7 = 0 AS off_wheel, event_id % 4 / 2.0::DOUBLE AS away,
  CASE WHEN event_id % 13 = 0 THEN 'UNKNOWN' WHEN value < 20 THEN 'BOTH_HANDS' WHEN value < 50 THEN 'ONE_HAND' ELSE 'NO_HANDS' END AS hand FROM events WHERE event_type = 'purchase')"""
_SESSION_LEVELS = risk_levels(
    f"""fs AS (SELECT fr.session_id, fr.ts, fr.rn, (fr.frame + 19700) * {24 * HOUR} AS us FROM fr), {_STATES},
w AS (SELECT fs.*, st.lv, st.off_wheel, st.away, coalesce((fs.us - st.us) / {UNIT}::DOUBLE <= 1, false) AS fresh FROM fs ASOF LEFT JOIN st ON fs.session_id = st.session_id AND fs.us >= st.us),
dr AS (SELECT w.*, h.points AS pp, coalesce(h.qualifies, false) AS rq, coalesce(h.g_pos, false) AS g_pos, coalesce(h.g_mot, false) AS g_mot, least(70, coalesce(h.points, 0) + CASE WHEN coalesce(h.nq, 0) >= 2 THEN 5 ELSE 0 END) AS road,
  CASE WHEN fresh AND lv = 'CRITICAL' THEN 45 WHEN fresh AND lv = 'HIGH' THEN 30 ELSE 0 END AS d1, CASE WHEN fresh AND off_wheel THEN 25 ELSE 0 END AS d2, CASE WHEN fresh AND away >= 1 THEN 10 ELSE 0 END AS d3 FROM w LEFT JOIN rk h ON h.session_id = w.session_id AND h.ts = w.ts AND h.k = 1),
dn AS (SELECT *, least(60, d1 + d2 + d3) AS drv, (d1 > 0)::INT + (d2 > 0)::INT + (d3 > 0)::INT AS nd FROM dr),
sc AS (SELECT *, least(100, road + drv + CASE WHEN nd > 0 AND rq THEN 15 * least(1, road / 30.0::DOUBLE) ELSE 0 END) AS score, nd + (rq AND g_pos)::INT + (rq AND g_mot)::INT AS groups FROM dn),
rr AS (SELECT *, CASE WHEN score >= 70 THEN 3 WHEN score >= 45 THEN 2 WHEN score >= 20 THEN 1 ELSE 0 END AS r0 FROM sc),
rg AS (SELECT *, CASE WHEN r0 = 3 AND NOT ((nd > 0 AND rq AND g_mot) OR (road >= 60 AND rq AND g_mot AND g_pos)) THEN 2 ELSE r0 END AS r1 FROM rr),
o AS (SELECT session_id, rn AS event_id, rn, ts AS t, score, CASE WHEN r1 >= 2 AND groups < 2 THEN 1 ELSE r1 END AS raw, ts - lag(ts) OVER (PARTITION BY session_id ORDER BY rn) AS dt FROM rg)"""
)
_NAME = lambda c: f"CASE {c} WHEN 0 THEN 'SAFE' WHEN 1 THEN 'CAUTION' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END"
_COOL = f"- kept.last >= {3 * 24 * HOUR}"
SESSIONS_SQL = tracks_sql(
    DAY_FRAMES_SQL,
    f""", {HAZARDS_SQL}, {_SESSION_LEVELS},
part AS (SELECT *, sum(coalesce(dt > 2.0, true)::INT) OVER (PARTITION BY session_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS seg FROM o),
ev AS (SELECT p.session_id, p.t, p.score, h.level, lag(h.level, 1, 0) OVER (PARTITION BY p.session_id ORDER BY p.rn) AS prev, max(p.score + 40 * p.t) OVER (PARTITION BY p.session_id, p.seg ORDER BY p.rn ROWS UNBOUNDED PRECEDING) - 40 * p.t AS smooth FROM part p JOIN h USING (session_id, rn)),
sv AS (SELECT session_id, event_id, us, 'hand_state' AS kind, hand AS v FROM st WHERE hand <> 'UNKNOWN' UNION ALL SELECT session_id, event_id, us, 'drowsiness_level', lv FROM st),
f AS (SELECT *, (lag(v) OVER x IS DISTINCT FROM v)::INT AS f FROM sv WINDOW x AS (PARTITION BY session_id, kind ORDER BY us, event_id)), r AS (SELECT *, sum(f) OVER (PARTITION BY session_id, kind ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id, kind, run ORDER BY us, event_id) AS kk FROM r), sb AS (SELECT *, lag(v) OVER (PARTITION BY session_id, kind ORDER BY us, event_id) AS previous FROM n WHERE kk = 2),
c AS (SELECT *, row_number() OVER (PARTITION BY session_id, kind, previous, v ORDER BY us, event_id) AS rn FROM sb WHERE previous <> v),
kept AS (SELECT session_id, kind, previous, v, rn, us, us AS last, true AS keep FROM c WHERE rn = 1
  UNION ALL SELECT c.session_id, c.kind, c.previous, c.v, c.rn, c.us, CASE WHEN c.us {_COOL} THEN c.us ELSE kept.last END, c.us {_COOL} FROM kept JOIN c ON c.session_id = kept.session_id AND c.kind = kept.kind AND c.previous = kept.previous AND c.v = kept.v AND c.rn = kept.rn + 1)
SELECT session_id::VARCHAR AS session_id, CASE WHEN level > prev THEN 'RISK_ESCALATED' ELSE 'RISK_DEESCALATED' END AS event_type, round(t, 6) AS timestamp, NULL AS change_kind, {_NAME("prev")} || '->' || {_NAME("level")} AS transition, {_NAME("level")} AS risk_level, {_NAME("prev")} AS previous_risk_level,
  round_even(score, 3) AS raw_risk_score, round_even(smooth, 3) AS smoothed_risk_score, 'INFERRED' AS observation_type, 0 AS problems FROM ev WHERE level <> prev
UNION ALL SELECT session_id::VARCHAR, 'DRIVER_STATE_CHANGE', round(us / {UNIT}::DOUBLE, 6), kind, previous || '->' || v, NULL, NULL, NULL, NULL, CASE kind WHEN 'hand_state' THEN 'OBSERVED' ELSE 'INFERRED' END, 0 FROM kept WHERE keep""",
)


@query("stream_sessions", SESSIONS_SQL)
def stream_sessions(spark, d):
    """Frames and driver rows of all sessions into event records, five stateful steps in one stream."""
    n, x = F.col("event_id"), F.least("value", F.lit(100.0))
    level = F.when(x >= 70, "CRITICAL").when(x >= 45, "HIGH").otherwise("LOW")
    hand = F.when(n % 13 == 0, "UNKNOWN").when(F.col("value") < 20, "BOTH_HANDS").when(F.col("value") < 50, "ONE_HAND").otherwise("NO_HANDS")
    states = sessions(spark, d).filter("event_type = 'purchase'").select(
        "session_id", F.col("ts").alias("time"), level.alias("drowsiness_level"), F.when(n % 7 == 0, "HANDS_OFF_WHEEL").otherwise("NORMAL").alias("driver_activity"), (n % 4 / F.lit(2.0)).alias("head_away_seconds"), F.lit(0.75).alias("observation_quality"), hand.alias("hand_state")
    )
    (dets, late), (driver_rows, late2) = (replay(t, "time", "session_id", SLICES, "40 days") for t in (day_detections(spark, d), states))
    late = max(late, late2, key=lambda z: int(z.split()[0]))
    e = run_sessions(
        dets, driver_rows, "session_id", UNIT, 31 * 24 * HOUR, late, (550.0, 430.0), ["hand_state", "drowsiness_level"], event_settings=EventSettings(change_observations=2, change_cooldown=0.3), rename=with_car_names,
        run_id="run_001", camera="front+driver", data_source="LOCAL_REAL",
    )
    out = validated(run_to_table(e, "events").filter(F.col("session_id") != str(END)))
    kept = ["session_id", "event_type", "change_kind", "transition", "risk_level", "previous_risk_level", "raw_risk_score", "smoothed_risk_score", "observation_type"]
    return out.select(*kept, F.round("timestamp", 6).alias("timestamp"), F.size("problems").alias("problems"))


_ALERTS_SQL = HYST_SQL.rsplit("SELECT session_id, event_id, raw, level FROM h", 1)[0] + f""", l AS (SELECT h.session_id, h.event_id, h.level, lag(h.level, 1, 0) OVER (PARTITION BY h.session_id ORDER BY s.t, h.event_id) AS prev FROM h JOIN steps s USING (event_id))
SELECT session_id, event_id, {_NAME("prev")} AS previous, {_NAME("level")} AS level, CASE level WHEN 0 THEN 'INFO' WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' ELSE 'HIGH' END AS severity, level > prev AS escalation, level > prev AND level >= 2 AS sound FROM l WHERE level <> prev"""


@query("stream_alerts", _ALERTS_SQL)
def stream_alerts(spark, d):
    """Alerts of every session's smoothed level, handed to a table sink and a bell batch by batch."""
    score = F.least("value", F.lit(100.0))
    rows = sessions(spark, d).select("session_id", "ts", "event_id", score.alias("raw_score"))
    s, late = replay(rows, "ts", "session_id", SLICES, "40 days")
    s = s.withColumn("raw_score", F.coalesce("raw_score", F.lit(0.0)))
    levels = smoothed_levels(s.withColumn("raw_rank", level_for_score("raw_score")), "session_id", "ts", "event_id", HOUR, 31 * 24 * HOUR, late, HOURS)
    told, folder = alert_rows(levels, "session_id", "seconds", ["event_id"]), new_path(spark, "alerts")
    fan_out(told, {"json": json_sink(folder), "bell": Bell()}, new_path(spark, "ledger"), new_path(spark, "alerts-checkpoint")).awaitTermination()
    out = spark.read.schema(told.schema).json(folder)
    return out.select("session_id", "event_id", "previous", "level", "severity", "escalation", F.array_contains("channels", "sound").alias("sound"))
