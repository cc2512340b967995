"""Record queries: event records, events behind alerts, instance summaries and notes, rules of synthetic rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom import schemas
from eventloom.functions.columns import level_name
from eventloom.operators import records
from eventloom.plans.adapter import LEVEL, LOG_SQL, STEPS_SQL, log, steps
from eventloom.plans.registry import query
from eventloom.plans.risk_queries import ASSESS_SQL, assessed, tracks

_GATED = ASSESS_SQL[: ASSESS_SQL.rindex("SELECT session_id, frame, round(score, 9)")]


@query("event_records", _GATED + f""", v AS (SELECT *, CASE WHEN r1 >= 2 AND groups < 2 THEN 1 ELSE r1 END AS lvl, CASE WHEN rq OR pp >= 20 AND NOT (nd > 0) THEN track_id END AS shown FROM g)
SELECT session_id::VARCHAR AS session_id, frame AS frame_index, 'PERSISTENT_HAZARD' AS event_type, {LEVEL.format('lvl')} AS risk_level, round_even(score + 1e-6, 3) AS raw_risk_score, shown AS primary_track_id, class_name AS hazard_track_class, round_even(v.area, 1) AS bbox_area, v.detections AS track_detection_count,
  round_even(v.growth, 4) AS box_growth_per_second, 400 AS image_width, 'LOCAL_REAL' AS data_source, 'UNAVAILABLE' AS gps_source, '[' || CASE WHEN r0 = 3 AND r1 = 2 THEN '"CRITICAL needs a driver factor with a moving road hazard, or a very strong road hazard"' || CASE WHEN r1 >= 2 AND groups < 2 THEN ',' ELSE '' END ELSE '' END || CASE WHEN r1 >= 2 AND groups < 2 THEN '"HIGH needs at least 2 independent evidence groups"' ELSE '' END || ']' AS risk_gates,
  NULL::VARCHAR AS evidence_path, 0::BIGINT AS problems FROM (SELECT v.*, h.class_name, h.area, h.detections, h.growth FROM v LEFT JOIN hz h ON h.track_id = v.shown) v""")
def event_records(spark, d):
    # Sums end on ties of the third place, where the order of adding would decide: a little is added on both sides.
    a = assessed(spark, d).withColumn("level", level_name("raw_rank")).withColumn("raw_score", F.col("raw_score") + 1e-6)
    t = tracks(spark, d).select(F.col("track_id").alias("primary_track"), "session_id", "frame", "class_name", "area", "detections", "growth", "width", "height")
    r = a.join(t, ["session_id", "frame", "primary_track"], "left").withColumns({"session_id": F.col("session_id").cast("string"), "frame_index": F.col("frame"), "timestamp": F.col("frame") * 24.0, "event_id": F.concat_ws("_", F.lit("event"), "session_id", "frame"), "smoothed_score": F.col("raw_score"), "width": F.lit(400), "height": F.lit(300)})
    e = records.event_records(r, run_id="run_001", camera="front", data_source="LOCAL_REAL", observation_type="INFERRED", event_type="PERSISTENT_HAZARD")
    kept = ["session_id", "frame_index", "event_type", "risk_level", "raw_risk_score", "primary_track_id", "hazard_track_class", "bbox_area", "track_detection_count", "box_growth_per_second", "image_width", "data_source", "gps_source", "risk_gates", "evidence_path"]
    return schemas.validated(e).select(*kept, F.size("problems").cast("long").alias("problems"))


@query("alert_events", f"""WITH {STEPS_SQL}, {LOG_SQL}, ev AS (SELECT event_id, session_id, floor(timestamp) AS t FROM log), al AS (SELECT event_id AS alert, session_id, floor(timestamp) AS t FROM log WHERE event_type = 'RISK_ESCALATED')
SELECT alert, al.session_id, al.t::DOUBLE AS t, count(ev.event_id) AS n, array_to_string(list(ev.event_id ORDER BY ev.event_id), ',') AS event_ids FROM al LEFT JOIN ev ON ev.session_id = al.session_id AND ev.t = al.t GROUP BY 1, 2, 3""")
def alert_events(spark, d):
    e = log(spark, d).withColumn("t", F.floor("timestamp").cast("double"))
    a = e.filter(F.col("event_type") == "RISK_ESCALATED").select(F.col("event_id").alias("alert"), "session_id", "t")
    out = records.alert_events(a, e.select("session_id", "t", "event_id"), ["session_id"], "t", "t")
    return out.select("alert", "session_id", "t", F.size("event_ids").cast("long").alias("n"), F.array_join(F.transform("event_ids", lambda i: i.cast("string")), ",").alias("event_ids"))


_INSTANCE_SQL = f"""WITH {STEPS_SQL}, i AS (SELECT *, floor(t) * 10000000 + event_id AS ts, least(raw, 2) AS shown FROM steps)"""


def _instances(spark, d):
    """Sessions as instances: a step's confirmed level is its raw one, at most HIGH."""
    s = steps(spark, d).withColumn("ts", (F.floor("t") * 10_000_000 + F.col("event_id")).cast("double"))
    one = F.array(F.struct(F.col("event_type").alias("name"), (F.floor("x") + 0.5).alias("points")))
    return s.withColumns({"level": level_name(F.least("raw", F.lit(2))), "raw_level": level_name("raw"), "raw_score": F.floor("x") + 0.5, "hazard": F.when(F.col("raw") > 0, F.col("event_type")), "factors": one, "gates": F.when(F.col("raw") == 3, F.array(F.lit("held"))).otherwise(F.array().cast("array<string>")), "reason": F.col("event_type")})


@query("instance_summary", f"""{_INSTANCE_SQL}
SELECT session_id, {LEVEL.format('max(shown)')} AS peak, {LEVEL.format('arg_min(shown, ts)')} AS first_level, {LEVEL.format('arg_max(shown, ts)')} AS final_level, count(*) FILTER (shown = 0) AS n_safe, count(*) FILTER (shown = 1) AS n_caution, count(*) FILTER (shown = 2) AS n_high, 0::BIGINT AS n_critical,
  count(*) AS steps, (max(ts) - min(ts))::DOUBLE AS duration, count(*) FILTER (shown >= 2) AS alarms, sum((event_type = 'error')::INTEGER)::BIGINT AS events FROM i GROUP BY 1""")
def instance_summary(spark, d):
    i = _instances(spark, d).withColumn("alarm", F.col("level").isin("HIGH", "CRITICAL")).withColumn("emitted", (F.col("event_type") == "error").cast("long"))
    return records.instance_summary(i, ["session_id"], "level", "ts", "alarm", "emitted")


@query("peak_notes", f"""{_INSTANCE_SQL}, k AS (SELECT *, max(shown) OVER (PARTITION BY session_id) AS top, max(ts) OVER (PARTITION BY session_id) AS last FROM i),
n AS (SELECT session_id, count(*) FILTER (raw > top) AS above, min(ts) FILTER (raw > top) AS first_above FROM k GROUP BY 1), b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY shown DESC, floor(x) DESC, ts) = 1)
SELECT session_id, 'At the peak step (t = ' || printf('%.2f', ts::DOUBLE) || ' s of ' || printf('%.2f', last::DOUBLE) || ' s): level ' || {LEVEL.format('shown')} || ' (raw level ' || {LEVEL.format('raw')} || '), raw score ' || printf('%.1f', floor(x) + 0.5) || ', hazard ' || CASE WHEN raw > 0 THEN event_type ELSE 'None' END
  || ', factors [' || event_type || ' +' || printf('%.1f', floor(x) + 0.5) || ']' || CASE WHEN raw = 3 THEN ', gates [held]' ELSE '' END || '.' AS note, event_type AS reason, above, first_above::DOUBLE AS first_above FROM b JOIN n USING (session_id)""")
def peak_notes(spark, d):
    return records.peak_notes(_instances(spark, d), ["session_id"])


def _sim_table(spark, d):
    """Steps as rows of the synthetic table, some of them broken on purpose."""
    n, s = F.col("event_id"), steps(spark, d)
    own = {
        "event_id": F.when(n % 11 == 0, F.format_string("event_%06d", n)).otherwise(F.format_string("sim_%06d", n)), "session_id": F.col("session_id").cast("string"), "data_source": F.when(n % 13 == 0, "LOCAL_REAL").otherwise("SYNTHETIC"), "camera": F.when(n % 17 == 0, "front").otherwise("front+driver"),
        "timestamp": F.col("t"), "frame_index": n, "gps_lat": F.when(n % 19 == 0, 95.0).otherwise(10.0), "location_source": F.when(n % 23 == 0, "GPS").otherwise(schemas.LOCATION_SOURCE), "parent_real_event_id": F.when(n % 29 == 0, "event_000001").when(n % 31 == 0, "other"),
        "parent_real_run_id": F.when(n % 2 == 0, "run_001"), "risk_level": level_name("raw"), "actual_risk_level": F.when(n % 37 == 0, None).otherwise(level_name("raw")), "trajectory_overlap": F.when(n % 41 == 0, 1.5), "notes": F.when(n % 43 == 0, "{").otherwise("[]"), "alarm_triggered": n % 47 == 0,
    }
    texts = {c: F.lit("SYNTHETIC") for c in ("observation_type", "timestamp_source", "gps_source")} | {c: F.lit("[]") for c in ("events_emitted", "expected_peak_levels")} | {"instance_peak_risk_level": F.lit("SAFE")}
    blank = {"string": F.lit("-"), "double": F.lit(0.0), "bigint": F.lit(1), "boolean": F.lit(True)}
    value = lambda f: own.get(f.name, texts.get(f.name, F.lit(None) if f.nullable else blank[f.dataType.simpleString()]))
    return s.select(n.alias("n"), *[value(f).cast(f.dataType).alias(f.name) for f in schemas.SIM_SCHEMA])


@query("synthetic_rules", """WITH p AS (SELECT event_id AS n, 'camera: not allowed' AS problem FROM events WHERE event_id % 17 = 0 UNION ALL SELECT event_id, 'notes: not JSON' FROM events WHERE event_id % 43 = 0),
r AS (SELECT event_id AS n FROM events WHERE event_id % 17 > 0 AND event_id % 43 > 0),
q AS (SELECT * FROM p UNION ALL SELECT n, 'looks real' FROM r WHERE n % 11 = 0 UNION ALL SELECT n, 'data_source: not synthetic' FROM r WHERE n % 13 = 0 UNION ALL SELECT n, 'gps range' FROM r WHERE n % 19 = 0 UNION ALL SELECT n, 'location source' FROM r WHERE n % 23 = 0
  UNION ALL SELECT n, 'parent id' FROM r WHERE n % 31 = 0 AND n % 29 > 0 UNION ALL SELECT n, 'parent run' FROM r WHERE (n % 29 = 0 OR n % 31 = 0) AND n % 2 = 1 UNION ALL SELECT n, 'actual level' FROM r WHERE n % 37 = 0 UNION ALL SELECT n, 'overlap' FROM r WHERE n % 41 = 0 UNION ALL SELECT n, 'alarm triggered' FROM r WHERE n % 47 = 0)
SELECT problem, count(*) AS rows, min(n) AS first FROM q GROUP BY 1""")
def synthetic_rules(spark, d):
    v = schemas.sim_validated(_sim_table(spark, d))
    return v.select("n", F.explode("problems").alias("problem")).groupBy("problem").agg(F.count("*").alias("rows"), F.min("n").alias("first"))
