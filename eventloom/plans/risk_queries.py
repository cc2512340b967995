"""Risk scoring, driver state, validation, tracking and scenario queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom import schemas
from eventloom.config import DriverSettings
from eventloom.functions.columns import level_name
from eventloom.operators import driver, risk, stats, tracker
from eventloom.plans.adapter import BOXES_SQL, LEVEL, LOG_SQL, STEPS_SQL, boxes, full_log, steps
from eventloom.plans.registry import query
from eventloom.sources.storage import stored

TRACKS_SQL = """
tr AS (
  SELECT session_id, CAST(floor(t / 24) AS BIGINT) AS frame, event_id AS track_id, ['car', 'person', 'dog', 'Bus', 'chair'][event_id % 5 + 1] AS class_name, (event_id % 40) / 10.0::DOUBLE AS persistence, event_id % 12 AS detections, (event_id % 5) / 10.0::DOUBLE AS missed,
         (event_id * 37) % 400 / 1.0::DOUBLE AS cx, (event_id * 53) % 300 / 1.0::DOUBLE AS y2, (event_id * 97) % 16000 / 1.0::DOUBLE AS area, CASE WHEN event_id % 11 = 0 THEN NULL ELSE (event_id % 23) / 20.0::DOUBLE - 0.2 END AS growth,
         CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id % 17) / 20.0::DOUBLE - 0.4 END AS lat_rate, (event_id % 100) / 100.0::DOUBLE AS confidence, event_id % 4 AS label_changes FROM steps
),
k AS (SELECT *, CASE WHEN lower(class_name) IN ('car', 'bus') THEN 'vehicle' WHEN lower(class_name) = 'person' THEN 'person' WHEN lower(class_name) = 'dog' THEN 'animal' END AS kind, abs(cx / 400.0::DOUBLE - 0.5) AS off, cx / 400.0::DOUBLE - 0.5 AS side,
  y2 / 300.0::DOUBLE >= 0.45 AS is_lower, area / (400 * 300) AS share FROM tr WHERE persistence >= 0.5 - 1e-9 AND detections >= 3 AND missed <= 0.3 + 1e-9),
m AS (SELECT *, coalesce(growth >= 0.15, false) AS approaching, CASE WHEN off <= 0.2 THEN abs(lat_rate) WHEN side > 0 THEN -lat_rate ELSE lat_rate END AS toward, coalesce(abs(lat_rate) >= 0.05, false) AS sideways,
  CASE WHEN off <= 0.2 THEN 1.0::DOUBLE WHEN off <= 0.35 THEN 0.5 ELSE 0 END * CASE WHEN is_lower THEN 1.0::DOUBLE ELSE 0.5 END AS place FROM k WHERE kind IS NOT NULL),
p AS (SELECT *, coalesce(toward >= 0.05, false) AS moving_in,
  10 * greatest(0, least(1, persistence / 2.0::DOUBLE)) + CASE WHEN kind = 'vehicle' THEN 10 ELSE 15 END * place + CASE WHEN approaching THEN CASE WHEN kind = 'vehicle' THEN 25 ELSE 15 END * (0.4::DOUBLE + 0.6::DOUBLE * least(1, (growth - 0.15::DOUBLE) / 0.65::DOUBLE)) ELSE 0 END
  + CASE WHEN coalesce(toward >= 0.05, false) THEN CASE WHEN kind = 'vehicle' THEN 5 ELSE 20 END * (0.4::DOUBLE + 0.6::DOUBLE * least(1, (toward - 0.05::DOUBLE) / 0.25::DOUBLE)) ELSE 0 END
  + CASE WHEN kind = 'vehicle' THEN 10 ELSE 5 END * greatest(0, least(1, (share - 0.01::DOUBLE) / 0.11::DOUBLE)) AS total FROM m),
q AS (SELECT *, CASE kind WHEN 'vehicle' THEN approaching WHEN 'person' THEN off <= 0.35 AND (moving_in OR approaching) ELSE (off <= 0.35 OR is_lower) AND (approaching OR sideways) END AS qualifies,
  greatest(0.5::DOUBLE, least(1, confidence / 0.6::DOUBLE)) * greatest(0.5::DOUBLE, 1 - 0.15::DOUBLE * label_changes) AS quality FROM p),
hz AS (SELECT *, CASE WHEN NOT qualifies THEN least(20, total * least(1, quality)) ELSE total * least(1, quality) END AS points, qualifies AND off <= 0.2 AND is_lower AS g_pos, qualifies AND (approaching OR moving_in) AS g_mot,
  CASE WHEN NOT qualifies THEN 'ROAD_USER_PRESENT' WHEN kind = 'vehicle' THEN 'APPROACHING_VEHICLE' WHEN kind = 'person' THEN 'PEDESTRIAN_CONFLICT' ELSE 'ANIMAL_HAZARD' END AS hazard_type FROM q)"""


def tracks(spark, d):
    n = F.col("event_id")
    s = steps(spark, d).select("session_id", F.floor(F.col("t") / 24).cast("long").alias("frame"), "event_id")
    f = lambda c, k: c / F.lit(float(k))
    return s.withColumns(
        {
            "track_id": n, "class_name": F.element_at(F.array(*[F.lit(x) for x in ("car", "person", "dog", "Bus", "chair")]), (n % 5 + 1).cast("int")), "persistence": f(n % 40, 10), "detections": n % 12, "missed": f(n % 5, 10), "cx": f((n * 37) % 400, 1),
            "y2": f((n * 53) % 300, 1), "area": f((n * 97) % 16000, 1), "growth": F.when(n % 11 != 0, f(n % 23, 20) - 0.2), "lateral": F.when(n % 13 != 0, f(n % 17, 20) - 0.4), "confidence": f(n % 100, 100), "label_changes": n % 4, "width": F.lit(400.0), "height": F.lit(300.0),
        }
    )


@query("track_hazards", f"WITH {STEPS_SQL}, {TRACKS_SQL} SELECT session_id, track_id, kind, qualifies, hazard_type, round(points, 9) AS points, round(quality, 9) AS quality FROM hz")
def track_hazards(spark, d):
    return risk.track_hazards(tracks(spark, d)).select("session_id", "track_id", "kind", "qualifies", "hazard_type", F.round("points", 9).alias("points"), F.round("quality", 9).alias("quality"))


ASSESS_SQL = f"""WITH {STEPS_SQL}, {TRACKS_SQL},
fr AS (SELECT DISTINCT session_id, CAST(floor(t / 24) AS BIGINT) AS frame FROM steps),
rk AS (SELECT *, row_number() OVER (PARTITION BY session_id, frame ORDER BY qualifies DESC, points DESC, track_id) AS k, count(*) FILTER (qualifies) OVER (PARTITION BY session_id, frame) AS nq FROM hz),
dr AS (SELECT fr.*, h.points AS pp, coalesce(h.qualifies, false) AS rq, h.g_pos, h.g_mot, h.hazard_type, h.track_id, coalesce(h.nq, 0) AS nq,
  CASE (fr.session_id + fr.frame) % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'LOW' END AS lv, (fr.session_id + fr.frame) % 7 = 0 AS off_wheel, (fr.session_id * 3 + fr.frame) % 4 / 2.0::DOUBLE AS away, (fr.session_id + fr.frame) % 3 <> 2 AS fresh FROM fr LEFT JOIN rk h ON h.session_id = fr.session_id AND h.frame = fr.frame AND h.k = 1),
a AS (SELECT *, CASE WHEN fresh AND lv = 'CRITICAL' THEN 45 WHEN fresh AND lv = 'HIGH' THEN 30 ELSE 0 END AS d1, CASE WHEN fresh AND off_wheel THEN 25 ELSE 0 END AS d2, CASE WHEN fresh AND away >= 1 THEN 10 ELSE 0 END AS d3,
  least(70, coalesce(pp, 0) + CASE WHEN nq >= 2 THEN 5 ELSE 0 END) AS road FROM dr),
b AS (SELECT *, least(60, d1 + d2 + d3) AS drv, (d1 > 0)::INTEGER + (d2 > 0)::INTEGER + (d3 > 0)::INTEGER AS nd FROM a),
c AS (SELECT *, least(100, road + drv + CASE WHEN nd > 0 AND rq THEN 15 * least(1, road / 30.0::DOUBLE) ELSE 0 END) AS score FROM b),
e AS (SELECT *, CASE WHEN score >= 70 THEN 3 WHEN score >= 45 THEN 2 WHEN score >= 20 THEN 1 ELSE 0 END AS r0, nd + (rq AND g_pos)::INTEGER + (rq AND g_mot)::INTEGER AS groups FROM c),
g AS (SELECT *, CASE WHEN r0 = 3 AND NOT ((nd > 0 AND rq AND g_mot) OR (road >= 60 AND rq AND g_mot AND g_pos)) THEN 2 ELSE r0 END AS r1 FROM e)
SELECT session_id, frame, round(score, 9) AS raw_score, CASE WHEN r1 >= 2 AND groups < 2 THEN 1 ELSE r1 END AS raw_rank, round(road, 9) AS road_points, drv::DOUBLE AS driver_points,
  CASE WHEN nd > 0 AND rq THEN 'COMBINED_DRIVER_HAZARD' WHEN rq THEN hazard_type WHEN nd > 0 THEN CASE WHEN d1 > 0 THEN 'DRIVER_DROWSINESS' WHEN d2 > 0 THEN 'HANDS_OFF_WHEEL' ELSE 'DRIVER_HEAD_AWAY' END WHEN pp >= 20 THEN 'ROAD_USER_PRESENT' ELSE 'NONE' END AS hazard FROM g"""


def assessed(spark, d):
    """Every frame's assessment, the driver's state made up of session and frame."""
    t = tracks(spark, d)
    p = risk.frame_hazards(risk.track_hazards(t), ["session_id", "frame"])
    n = F.col("session_id") + F.col("frame")
    f = t.select("session_id", "frame").distinct().join(p, ["session_id", "frame"], "left").withColumns(
        {
            "drowsiness_level": F.when(n % 5 == 0, "CRITICAL").when(n % 5 == 1, "HIGH").otherwise("LOW"), "driver_activity": F.when(n % 7 == 0, "HANDS_OFF_WHEEL").otherwise("NORMAL"),
            "head_away_seconds": (F.col("session_id") * 3 + F.col("frame")) % 4 / F.lit(2.0), "driver_age": F.when(n % 3 != 2, 0.2).otherwise(5.0), "observation_quality": F.lit(0.75),
        }
    )
    return risk.assess(f)


@query("risk_assessment", ASSESS_SQL)
def risk_assessment(spark, d):
    return assessed(spark, d).select("session_id", "frame", F.round("raw_score", 9).alias("raw_score"), "raw_rank", F.round("road_points", 9).alias("road_points"), "driver_points", "hazard")


@query("drowsiness", f"""WITH {STEPS_SQL}, f AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 50) / 100.0::DOUBLE END AS ratio, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 30) / 10.0::DOUBLE END AS closed, event_id % 5 AS longs, (event_id % 20) / 1.0::DOUBLE AS obs FROM steps),
w AS (SELECT *, least(1, coalesce(closed, 0) / 2.0::DOUBLE) AS now, CASE WHEN obs >= 5 AND ratio IS NOT NULL THEN 0.6::DOUBLE * least(1, ratio / 0.3::DOUBLE) + 0.4::DOUBLE * least(1, longs / 3.0::DOUBLE) END AS win FROM f),
s AS (SELECT *, round(CASE WHEN win IS NOT NULL THEN greatest(now, win) WHEN now > 0 THEN now END, 4) AS score FROM w)
SELECT event_id, score, CASE WHEN score IS NULL THEN 'UNKNOWN' WHEN score >= 0.8 THEN 'CRITICAL' WHEN score >= 0.5 THEN 'HIGH' WHEN win IS NULL THEN 'UNKNOWN' ELSE 'LOW' END AS level FROM s""")
def drowsiness(spark, d):
    n = F.col("event_id")
    f = steps(spark, d).select("event_id", F.when(n % 5 != 0, n % 50 / F.lit(100.0)).alias("ratio"), F.when(n % 3 != 0, n % 30 / F.lit(10.0)).alias("closed"), (n % 5).alias("longs"), (n % 20 / F.lit(1.0)).alias("obs"))
    score, level = driver.drowsiness("ratio", "closed", "longs", "obs", DriverSettings())
    return f.select("event_id", score.alias("score"), level.alias("level"))


def _event_table(spark, d):
    """The log as a full 60-column table, some rows of it broken on purpose."""
    n = F.col("event_id")
    e = full_log(spark, d)
    own = {
        "schema_version": F.when(n % 31 == 0, "0.9").otherwise("1.0"), "event_id": F.format_string("event_%06d", n), "session_id": F.col("session_id").cast("string"), "camera": F.when(n % 29 != 0, "front"), "data_source": F.when(n % 37 == 0, "ELSEWHERE").otherwise("LOCAL_REAL"),
        "observation_type": F.when(n % 23 == 0, "OBSERVED").otherwise("INFERRED"), "gps_lat": F.when(n % 19 == 0, n % 100 + 0.5), "gps_lon": F.when(n % 38 == 0, n % 200 + 0.5), "gps_source": F.when(n % 38 == 0, "LOG").otherwise("UNAVAILABLE"), "evidence_kind": F.lit("NONE"), "evidence_path": F.when(n % 41 == 0, "/abs/x.jpg"),
        "notes": F.when(n % 43 == 0, "{broken").otherwise("[]"), "timestamp": F.when(n % 47 == 0, F.lit(float("nan"))).otherwise(F.col("timestamp")), "primary_track_id": n, "risk_level": F.when(n % 53 == 0, "SAFE").otherwise(F.col("risk_level")),
    }
    cols = []
    for f in schemas.EVENT_SCHEMA:
        c = own.get(f.name, F.col(f.name) if f.name in e.columns else F.lit(None))
        cols.append(c.cast(f.dataType).alias(f.name))
    return e.select(*cols)


@query("validation", f"""WITH {STEPS_SQL}, {LOG_SQL}, e AS (SELECT event_id AS n, event_type, CASE WHEN event_id % 53 = 0 THEN 'SAFE' ELSE risk_level END AS lv, previous_risk_level AS pv FROM log),
r AS (SELECT n, CASE lv WHEN 'SAFE' THEN 0 WHEN 'CAUTION' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END AS a, CASE pv WHEN 'SAFE' THEN 0 WHEN 'CAUTION' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END AS b, event_type = 'RISK_ESCALATED' AS up FROM e),
p AS (SELECT 'version' AS problem FROM r WHERE n % 31 = 0 UNION ALL SELECT 'camera: null' FROM r WHERE n % 29 = 0 UNION ALL SELECT 'data_source: not allowed' FROM r WHERE n % 37 = 0 UNION ALL SELECT 'inferred' FROM r WHERE n % 23 = 0
UNION ALL SELECT 'coordinates' FROM r WHERE n % 19 = 0 AND n % 38 <> 0 UNION ALL SELECT 'gps source' FROM r WHERE n % 19 = 0 AND n % 38 <> 0 UNION ALL SELECT 'gps range' FROM r WHERE (n % 19 = 0 AND n % 100 + 0.5 > 90) OR (n % 38 = 0 AND n % 200 + 0.5 > 180)
UNION ALL SELECT 'evidence' FROM r WHERE n % 41 = 0 UNION ALL SELECT 'evidence paths' FROM r WHERE n % 41 = 0 UNION ALL SELECT 'notes: not JSON' FROM r WHERE n % 43 = 0 UNION ALL SELECT 'timestamp: not finite' FROM r WHERE n % 47 = 0 UNION ALL SELECT 'direction' FROM r WHERE up <> (a > b))
SELECT problem, count(*) AS n FROM p GROUP BY 1""")
def validation(spark, d):
    v = schemas.validated(_event_table(spark, d))
    return v.select(F.explode("problems").alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


def _detections(spark, d):
    b = boxes(spark, d)
    return b.select("session_id", (F.col("frame") * 0.1).alias("ts"), F.col("frame").cast("int").alias("frame_index"), F.col("event_id").alias("det_ix"), "class_name", ((F.col("event_id") % 100) / F.lit(100.0)).alias("confidence"), "x1", "y1", "x2", "y2")


_BOX = lambda b: ", ".join(f"'{c}': {b}.{c}" for c in ("x1", "y1", "x2", "y2"))


def tracks_sql(frames: str, select: str) -> str:
    """The tracker as a recursion over a session's frames, whose state is the list of live tracks.

    ``frames`` defines fr(session_id, rn, frame, ts, dets) and what it needs.  A frame's pairs, sorted,
    are reduced to those that find both sides free.
    """
    side = "greatest(0.0, least(a.x2, d.x2) - greatest(a.x1, d.x1)) * greatest(0.0, least(a.y2, d.y2) - greatest(a.y1, d.y1))"
    return f"""WITH RECURSIVE {frames},
none AS (SELECT list_filter([{{'id': 0, 'x1': 0.0::DOUBLE, 'y1': 0.0::DOUBLE, 'x2': 0.0::DOUBLE, 'y2': 0.0::DOUBLE, 'cs': ['']::VARCHAR[], 'conf': 0.0::DOUBLE, 'first': 0.0::DOUBLE, 'seen': 0.0::DOUBLE, 'area0': 0.0::DOUBLE, 'fi': 0::BIGINT}}], lambda x: false) AS tracks),
k AS (
  SELECT session_id, 0::BIGINT AS rn, 0::BIGINT AS frame, 0.0::DOUBLE AS ts, 0 AS born, tracks FROM (SELECT DISTINCT session_id FROM fr), none
  UNION ALL
  SELECT session_id, rn, frame, ts, born + len(births), list_concat(list_transform(live, lambda a: CASE WHEN list_contains(got.ts, a.id) THEN list_transform([dets[got.ds[list_position(got.ts, a.id)]]],
      lambda d: {{'id': a.id, {_BOX("d")}, 'cs': list_append(a.cs, d.c), 'conf': a.conf + d.conf, 'first': a.first, 'seen': ts, 'area0': a.area0, 'fi': frame}})[1] ELSE a END),
    list_transform(range(1, len(births) + 1), lambda i: list_transform([dets[births[i]]], lambda d: {{'id': (born + i)::INT, {_BOX("d")}, 'cs': [d.c], 'conf': d.conf, 'first': ts, 'seen': ts, 'area0': (d.x2 - d.x1) * (d.y2 - d.y1), 'fi': frame}})[1]))
  FROM (
    SELECT *, list_filter(range(1, len(dets) + 1), lambda j: NOT list_contains(got.ds, j)) AS births
    FROM (
      SELECT *, list_reduce(list_prepend({{'ts': []::INT[], 'ds': []::BIGINT[]}}, list_transform(list_sort(pairs), lambda p: {{'ts': [p.i], 'ds': [p.j]}})),
          lambda acc, x: CASE WHEN list_contains(acc.ts, x.ts[1]) OR list_contains(acc.ds, x.ds[1]) THEN acc ELSE {{'ts': list_concat(acc.ts, x.ts), 'ds': list_concat(acc.ds, x.ds)}} END) AS got
      FROM (
        SELECT *, list_filter(flatten(list_transform(live, lambda a: list_transform(range(1, len(dets) + 1), lambda j: list_transform([dets[j]], lambda d:
          {{'s': (d.c <> a.cs[-1] AND d.c <> list_aggregate(a.cs, 'mode'))::INT, 'o': -({side}) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (d.x2 - d.x1) * (d.y2 - d.y1) - {side}), 'i': a.id, 'j': j}})[1]))),
          lambda p: -p.o >= CASE p.s WHEN 1 THEN 0.6 ELSE 0.3 END - 1e-9) AS pairs
        FROM (SELECT fr.session_id, fr.rn, fr.frame, fr.ts, fr.dets, k.born, list_filter(k.tracks, lambda a: fr.ts - a.seen <= 1.0 + 1e-9) AS live FROM k JOIN fr ON fr.session_id = k.session_id AND fr.rn = k.rn + 1)))))
{select}"""


FRAMES_SQL = f"""{STEPS_SQL}, {BOXES_SQL},
fr AS (SELECT session_id, frame, frame * 0.1::DOUBLE AS ts, row_number() OVER (PARTITION BY session_id ORDER BY frame) AS rn, list({{'c': class_name, 'conf': (event_id % 100) / 100.0::DOUBLE, 'x1': x1::DOUBLE, 'y1': y1::DOUBLE, 'x2': x2::DOUBLE, 'y2': y2::DOUBLE}} ORDER BY event_id) AS dets FROM boxes GROUP BY session_id, frame)"""
_OF_CLASSES = "len(a.cs)::INT AS detections, coalesce(list_sum(list_transform(range(2, len(a.cs) + 1), lambda i: (a.cs[i] <> a.cs[i - 1])::INT)), 0)::INT AS label_changes"
TRACKS_SELECT = f"SELECT session_id, a.fi::INT AS frame_index, a.id AS track_id, list_aggregate(a.cs, 'mode') AS class_name, {_OF_CLASSES}, round(a.seen - a.first, 6) AS persistence, round((a.x2 - a.x1) * (a.y2 - a.y1), 3) AS area FROM (SELECT session_id, unnest(tracks) AS a FROM k)"


@query("tracks", tracks_sql(FRAMES_SQL, TRACKS_SELECT))
def tracks_query(spark, d):
    return track_columns(tracker.track(_detections(spark, d)))


def track_columns(t):
    return t.filter("not ended").select("session_id", "frame_index", "track_id", "class_name", "detections", "label_changes", F.round("persistence", 6).alias("persistence"), F.round("area", 3).alias("area"))


@query("track_summary", tracks_sql(FRAMES_SQL, f"""SELECT session_id, a.id AS track_id, {_OF_CLASSES.split(",")[0]}, least({_OF_CLASSES.split(", ", 1)[1].split(" AS label")[0]}, 3)::INT AS changes, round(a.seen - a.first, 6) AS persistence,
  round(CASE WHEN len(a.cs) >= 3 AND a.area0 > 0 THEN (a.x2 - a.x1) * (a.y2 - a.y1) / a.area0 END, 6) AS growth_ratio FROM (SELECT session_id, rn, unnest(tracks) AS a FROM k) QUALIFY row_number() OVER (PARTITION BY session_id, a.id ORDER BY rn DESC) = 1"""))
def track_summary(spark, d):
    t = tracker.track(_detections(spark, d)).filter("not ended")
    return stats.track_summary(t, ["session_id", "track_id"]).select("session_id", "track_id", "detections", "changes", F.round("persistence", 6).alias("persistence"), F.round("growth_ratio", 6).alias("growth_ratio"))


def _sized(sql: str) -> str:
    """The hazard rules for images of 550 x 430."""
    return sql.replace("400.0::DOUBLE", "550.0::DOUBLE").replace("300.0::DOUBLE", "430.0::DOUBLE").replace("(400 * 300)", "(550 * 430)")


def risk_levels(start: str) -> str:
    """HYST_SQL's recursion over o(session_id, event_id, rn, raw, dt) of ``start``, with the risk settings' own gap."""
    from eventloom.plans.sequence_queries import HYST_SQL

    tail = HYST_SQL[HYST_SQL.index("h AS (") :]
    return (start + ",\n" + tail.rsplit("SELECT session_id, event_id, raw, level FROM h", 1)[0]).replace("> 48", "> 2.0")


#: Live tracks of every frame with their motion over the last second, and their hazards; needs ``k`` of tracks_sql.
HAZARDS_SQL = """live AS (SELECT session_id, frame, ts, unnest(tracks) AS a FROM k WHERE rn > 0),
obs AS (SELECT session_id, a.id AS id, ts, ln((a.x2 - a.x1) * (a.y2 - a.y1)) AS la, (a.x1 + a.x2) / 2 / 550.0::DOUBLE AS cxw FROM live WHERE a.fi = frame),
mo AS (SELECT session_id, id, ts, CASE WHEN count(*) OVER w >= 3 AND max(ts) OVER w - min(ts) OVER w >= 0.3 - 1e-9 THEN coalesce(regr_slope(la, ts) OVER w, 0) END AS growth, CASE WHEN count(*) OVER w >= 3 AND max(ts) OVER w - min(ts) OVER w >= 0.3 - 1e-9 THEN coalesce(regr_slope(cxw, ts) OVER w, 0) END AS lat_rate
  FROM obs WINDOW w AS (PARTITION BY session_id, id ORDER BY ts RANGE BETWEEN 1.000000001::DOUBLE PRECEDING AND CURRENT ROW)),
tr AS (SELECT live.session_id, live.frame, live.ts, a.id AS track_id, CASE list_aggregate(a.cs, 'mode') WHEN 'view' THEN 'car' WHEN 'click' THEN 'person' ELSE 'dog' END AS class_name, a.seen - a.first AS persistence, len(a.cs) AS detections, live.ts - a.seen AS missed, (a.x1 + a.x2) / 2 AS cx, a.y2 AS y2, (a.x2 - a.x1) * (a.y2 - a.y1) AS area,
  growth, lat_rate, a.conf / len(a.cs) AS confidence, coalesce(list_sum(list_transform(range(2, len(a.cs) + 1), lambda i: (a.cs[i] <> a.cs[i - 1])::INT)), 0) AS label_changes FROM live LEFT JOIN mo ON mo.session_id = live.session_id AND mo.id = a.id AND mo.ts = a.seen),
""" + _sized(TRACKS_SQL[TRACKS_SQL.index("k AS (SELECT *") :].replace("k AS (SELECT *, CASE", "kd AS (SELECT *, CASE", 1).replace("FROM k WHERE kind", "FROM kd WHERE kind")) + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY session_id, ts ORDER BY qualifies DESC, points DESC, track_id) AS k, count(*) FILTER (qualifies) OVER (PARTITION BY session_id, ts) AS nq FROM hz)"""


RISK_SQL = tracks_sql(FRAMES_SQL, f"""SELECT session_id, round(ts, 3) AS ts, raw AS raw_rank, level, round(score, 6) AS raw_score FROM risk""")
_LEVELS = risk_levels("""dr AS (SELECT fr.session_id, fr.ts, fr.rn, h.points AS pp, coalesce(h.qualifies, false) AS rq, h.g_pos, h.g_mot, least(70, coalesce(h.points, 0) + CASE WHEN coalesce(h.nq, 0) >= 2 THEN 5 ELSE 0 END) AS score FROM fr LEFT JOIN rk h ON h.session_id = fr.session_id AND h.ts = fr.ts AND h.k = 1),
rr AS (SELECT *, CASE WHEN score >= 70 THEN 3 WHEN score >= 45 THEN 2 WHEN score >= 20 THEN 1 ELSE 0 END AS r0 FROM dr),
rg AS (SELECT *, CASE WHEN r0 = 3 AND NOT (score >= 60 AND rq AND g_mot AND g_pos) THEN 2 ELSE r0 END AS r1 FROM rr),
o AS (SELECT session_id, rn AS event_id, rn, ts AS t, score, CASE WHEN r1 >= 2 AND coalesce((rq AND g_pos)::INT, 0) + coalesce((rq AND g_mot)::INT, 0) < 2 THEN 1 ELSE r1 END AS raw, ts - lag(ts) OVER (PARTITION BY session_id ORDER BY rn) AS dt FROM rg)""")
RISK_SQL = RISK_SQL.replace("SELECT session_id, round(ts, 3)", f", {HAZARDS_SQL}, {_LEVELS}, risk AS (SELECT o.session_id, o.t AS ts, o.raw, h.level, o.score FROM o JOIN h USING (session_id, rn))\nSELECT session_id, round(ts, 3)").replace(")\n,", "),\n", 1)


def with_car_names(t):
    """The kinds of events as kinds of objects, in images of 550 x 430."""
    return t.withColumn("class_name", F.when(F.col("class_name") == "view", "car").when(F.col("class_name") == "click", "person").otherwise("dog")).withColumns({"width": F.lit(550.0), "height": F.lit(430.0)})


@query("risk_pipeline", RISK_SQL)
def risk_pipeline(spark, d):
    """Detections -> tracks -> motion -> hazards -> assessment -> hysteresis, per session."""
    from eventloom.operators import folds

    # Written once: the matcher is not run again for each of the three tables made of its steps.
    t = with_car_names(tracker.described(stored(tracker.matched(_detections(spark, d)), "track-steps")).filter("not ended"))
    seen = risk.motion_features(t.filter("active"), ["session_id", "track_id"]).select("session_id", "track_id", "last_seen", "growth", "lateral")
    h = risk.track_hazards(t.join(seen, ["session_id", "track_id", "last_seen"], "left").withColumn("confidence", F.col("mean_confidence")))
    p = risk.frame_hazards(h, ["session_id", "ts"])
    f = t.select("session_id", "ts").distinct().join(p, ["session_id", "ts"], "left").withColumns({"drowsiness_level": F.lit("LOW"), "driver_activity": F.lit("NORMAL"), "head_away_seconds": F.lit(0.0), "driver_age": F.lit(None).cast("double"), "observation_quality": F.lit(1.0)})
    a = risk.assess(f).select("session_id", "ts", "raw_rank", "raw_score")
    return folds.hysteresis(a, ["session_id"], ["ts"], "ts", "raw_rank").select("session_id", F.round("ts", 3).alias("ts"), "raw_rank", "level", F.round("raw_score", 6).alias("raw_score"))


@query("level_counts", f"WITH {STEPS_SQL} SELECT {LEVEL.format('raw')} AS level, count(*) AS n FROM steps GROUP BY 1")
def level_counts(spark, d):
    return steps(spark, d).groupBy(level_name("raw").alias("level")).agg(F.count("*").alias("n"))
