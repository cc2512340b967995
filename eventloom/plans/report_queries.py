"""Report, reason and record queries over an event table that holds every kind of event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators import report, stats
from eventloom.plans.adapter import LOG_SQL, STEPS_SQL, full_log
from eventloom.plans.registry import query
from eventloom.plans.risk_queries import ASSESS_SQL, assessed

#: Every sixth level change made a driver-state change, every sixth a persistent hazard; two runs.
MIXED_SQL = f"""{STEPS_SQL}, {LOG_SQL},
kinded AS (SELECT *, CASE event_id % 6 WHEN 0 THEN 'DRIVER_STATE_CHANGE' WHEN 1 THEN 'PERSISTENT_HAZARD' ELSE event_type END AS kind, (event_id // 6) % 3 AS which, (event_id // 18) % 2 AS way FROM log),
mixed AS (
  SELECT event_id, session_id, 'run_' || session_id % 2 AS run_id, kind AS event_type, floor(timestamp) + event_id % 4 / 4.0::DOUBLE AS timestamp, previous_risk_level,
         CASE WHEN kind <> 'DRIVER_STATE_CHANGE' THEN risk_level END AS risk_level, CASE WHEN kind <> 'DRIVER_STATE_CHANGE' THEN floor(smoothed_risk_score) + 0.5::DOUBLE END AS score,
         CASE WHEN kind = 'DRIVER_STATE_CHANGE' THEN ['hand_state', 'driver_activity', 'drowsiness_level'][which + 1] END AS change_kind,
         CASE kind WHEN 'DRIVER_STATE_CHANGE' THEN [['TWO_HANDS->NO_HANDS', 'NO_HANDS->ONE_HAND'], ['NORMAL->HANDS_OFF_WHEEL', 'HANDS_OFF_WHEEL->NORMAL'], ['LOW->HIGH', 'HIGH->LOW']][which + 1][way + 1] WHEN 'PERSISTENT_HAZARD' THEN NULL ELSE previous_risk_level || '->' || risk_level END AS transition,
         CASE WHEN kind <> 'DRIVER_STATE_CHANGE' THEN hazard_type END AS hazard_type, CASE WHEN hazard_type = 'APPROACHING_VEHICLE' AND kind <> 'DRIVER_STATE_CHANGE' THEN 'car' END AS hazard_class,
         CASE WHEN event_id % 5 > 0 THEN 'as seen' END AS risk_reason, CASE WHEN event_id % 4 = 0 THEN 'ev/' || event_id || '.jpg' END AS evidence_path, CASE WHEN event_id % 3 > 0 THEN 'clip.mp4' END AS source_file,
         CASE WHEN kind = 'DRIVER_STATE_CHANGE' THEN 'driver' ELSE 'front' END AS camera, CASE WHEN event_id % 7 > 0 THEN risk_level IN ('HIGH', 'CRITICAL') END AS alarm, CASE WHEN kind = 'PERSISTENT_HAZARD' THEN event_id % 8 / 2.0::DOUBLE END AS hazard_persistence
  FROM kinded
)"""
ADVICE_SQL = """CASE WHEN event_type = 'DRIVER_STATE_CHANGE' THEN CASE WHEN transition IN ('LOW->HIGH') THEN 'drowsiness' WHEN change_kind = 'drowsiness_level' THEN 'drowsiness_info' WHEN transition IN ('TWO_HANDS->NO_HANDS', 'NORMAL->HANDS_OFF_WHEEL') THEN 'hands_off' ELSE 'hand_info' END
  WHEN event_type = 'RISK_DEESCALATED' THEN 'deescalation' ELSE CASE hazard_type WHEN 'PEDESTRIAN_CONFLICT' THEN 'pedestrian' WHEN 'APPROACHING_VEHICLE' THEN 'vehicle' WHEN 'ANIMAL_HAZARD' THEN 'animal' WHEN 'DRIVER_DROWSINESS' THEN 'drowsiness' ELSE 'none' END END"""
_TEXTS = "MAP {" + ", ".join(f"'{k}': '{v.replace(chr(39), chr(39) * 2)}'" for k, v in stats.ADVICE.items()) + "}"


def mixed(spark, d) -> DataFrame:
    e, n = full_log(spark, d), F.col("event_id")
    kind = F.when(n % 6 == 0, "DRIVER_STATE_CHANGE").when(n % 6 == 1, "PERSISTENT_HAZARD").otherwise(F.col("event_type"))
    driver, held = F.col("event_type") == "DRIVER_STATE_CHANGE", F.col("event_type") == "PERSISTENT_HAZARD"
    which, way = (F.floor(n / 6) % 3 + 1).cast("int"), (F.floor(n / 18) % 2 + 1).cast("int")
    of = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    moves = of(of("TWO_HANDS->NO_HANDS", "NO_HANDS->ONE_HAND"), of("NORMAL->HANDS_OFF_WHEEL", "HANDS_OFF_WHEEL->NORMAL"), of("LOW->HIGH", "HIGH->LOW"))
    e = e.withColumn("alarm_recommended", F.when(n % 7 != 0, F.col("risk_level").isin("HIGH", "CRITICAL"))).withColumn("event_type", kind)
    score = F.when(~driver, F.floor("smoothed_risk_score") + 0.5)
    return e.withColumns(
        {
            "run_id": F.concat(F.lit("run_"), (F.col("session_id") % 2).cast("string")), "timestamp": F.floor("timestamp") + n % 4 / 4.0, "risk_level": F.when(~driver, F.col("risk_level")), "smoothed_risk_score": score, "raw_risk_score": score,
            "change_kind": F.when(driver, F.element_at(of("hand_state", "driver_activity", "drowsiness_level"), which)), "transition": F.when(driver, F.element_at(F.element_at(moves, which), way)).when(~held, F.col("transition")),
            "hazard_type": F.when(~driver, F.col("hazard_type")), "hazard_class": F.when(~driver & (F.col("hazard_type") == "APPROACHING_VEHICLE"), "car"), "risk_reason": F.when(n % 5 > 0, "as seen"), "evidence_path": F.when(n % 4 == 0, F.concat(F.lit("ev/"), n.cast("string"), F.lit(".jpg"))),
            "source_file": F.when(n % 3 > 0, "clip.mp4"), "camera": F.when(driver, "driver").otherwise("front"), "observation_type": F.lit("INFERRED"), "hazard_persistence": F.when(held, n % 8 / 2.0),
        }
    )


@query("event_entries", f"""WITH {MIXED_SQL}, k AS (SELECT *, {ADVICE_SQL} AS key FROM mixed)
SELECT event_id, run_id, event_type, printf('%.2f', timestamp) || ' s into ' || coalesce(source_file, session_id::VARCHAR) AS time, camera,
  CASE WHEN event_type = 'DRIVER_STATE_CHANGE' THEN 'not recorded' ELSE risk_level || ' (score ' || printf('%.1f', score) || ')' || coalesce(', ' || transition, '') END AS risk,
  CASE WHEN event_type = 'DRIVER_STATE_CHANGE' THEN change_kind || ': ' || transition ELSE coalesce(hazard_type, 'not recorded') || coalesce(' (' || hazard_class || ')', '') END AS hazard,
  coalesce(risk_reason, CASE WHEN event_type = 'DRIVER_STATE_CHANGE' THEN change_kind || ' changed ' || transition || ' (held for the configured observations)' ELSE 'not recorded' END) AS reason,
  coalesce('../' || evidence_path, 'none recorded') AS evidence_path, key AS recommendation_key, {_TEXTS}[key] AS recommendation, 'INFERRED' AS observation_type, 'LOCAL_REAL' AS data_source FROM k""")
def event_entries(spark, d):
    return report.event_entries(mixed(spark, d), "../")


@query("recommended_events", f"""WITH {MIXED_SQL}, k AS (SELECT event_id, {ADVICE_SQL} AS key FROM mixed)
SELECT key, event_id, {_TEXTS}[key] AS recommendation, key IN ('road_user_present', 'hand_info', 'drowsiness_info', 'deescalation', 'none') AS informational FROM k""")
def recommended_events(spark, d):
    return report.recommended_events(mixed(spark, d))


_FIVE = "count({0})::DOUBLE AS n, round(avg({0}), 3) AS mean, round(median({0}), 3) AS median, round(max({0}), 3) AS max, round(min({0}), 3) AS min"
_LEVELS = ("SAFE", "CAUTION", "HIGH", "CRITICAL")


@query("event_statistics", f"""WITH {MIXED_SQL}, k AS (SELECT *, {ADVICE_SQL} AS advice FROM mixed),
ch AS (SELECT * FROM mixed WHERE event_type IN ('RISK_ESCALATED', 'RISK_DEESCALATED')),
st AS (SELECT *, sum(CASE WHEN previous_risk_level = 'SAFE' AND event_type = 'RISK_ESCALATED' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING) AS ep FROM ch),
nu AS (SELECT *, row_number() OVER (PARTITION BY session_id, ep ORDER BY timestamp, event_id) AS k FROM st WHERE ep > 0), en AS (SELECT *, min(CASE WHEN risk_level = 'SAFE' AND k > 1 THEN k END) OVER (PARTITION BY session_id, ep) AS ke FROM nu),
sp AS (SELECT session_id, ep, min(timestamp) AS s0, max(CASE WHEN k = ke THEN timestamp END) AS e0 FROM en WHERE ke IS NULL OR k <= ke GROUP BY 1, 2),
epi AS (SELECT *, round(e0 - s0, 3) AS seconds FROM (SELECT *, max(ep) OVER (PARTITION BY session_id) AS last FROM sp) WHERE e0 IS NOT NULL OR ep = last),
pat AS (SELECT 'Pedestrian hazards' AS key, count(*) FILTER (hazard_type = 'PEDESTRIAN_CONFLICT' AND event_type IN ('RISK_ESCALATED', 'PERSISTENT_HAZARD')) AS v FROM mixed
  UNION ALL SELECT 'Approaching-vehicle hazards', count(*) FILTER (hazard_type = 'APPROACHING_VEHICLE' AND event_type IN ('RISK_ESCALATED', 'PERSISTENT_HAZARD')) FROM mixed UNION ALL SELECT 'Animal hazards', count(*) FILTER (hazard_type = 'ANIMAL_HAZARD' AND event_type IN ('RISK_ESCALATED', 'PERSISTENT_HAZARD')) FROM mixed
  UNION ALL SELECT 'Driver-state changes', count(*) FILTER (event_type = 'DRIVER_STATE_CHANGE') FROM mixed UNION ALL SELECT 'Risk escalations', count(*) FILTER (event_type = 'RISK_ESCALATED' AND risk_level <> 'SAFE') FROM mixed
  UNION ALL SELECT 'Escalations to HIGH or CRITICAL', count(*) FILTER (event_type = 'RISK_ESCALATED' AND risk_level IN ('HIGH', 'CRITICAL')) FROM mixed),
five AS (SELECT 'smoothed_risk_score' AS category, {_FIVE.format("score")} FROM mixed UNION ALL SELECT 'raw_risk_score', {_FIVE.format("score")} FROM mixed UNION ALL SELECT 'elevated_risk_episode_seconds', {_FIVE.format("seconds")} FROM epi WHERE e0 IS NOT NULL),
lv AS (SELECT unnest({list(_LEVELS)}) AS key),
r AS (SELECT 'total' AS category, 'events' AS key, count(*)::DOUBLE AS value FROM mixed UNION ALL SELECT 'total', 'sessions', count(DISTINCT session_id) FROM mixed
  UNION ALL SELECT 'events_by_type', event_type, count(*) FROM mixed GROUP BY 2 UNION ALL SELECT 'events_by_camera', camera, count(*) FROM mixed GROUP BY 2 UNION ALL SELECT 'events_by_hazard_type', coalesce(hazard_type, 'not recorded'), count(*) FROM mixed GROUP BY 2
  UNION ALL SELECT 'risk_transitions', transition, count(*) FROM ch GROUP BY 2 UNION ALL SELECT 'alarm_recommended', CASE WHEN alarm THEN 'true' WHEN NOT alarm THEN 'false' ELSE 'not recorded' END, count(*) FROM mixed GROUP BY 2
  UNION ALL SELECT 'driver_state_events', change_kind || ': ' || transition, count(*) FROM mixed WHERE event_type = 'DRIVER_STATE_CHANGE' GROUP BY 2
  UNION ALL SELECT 'events_by_risk_level', key, (SELECT count(*) FROM mixed WHERE risk_level = key) FROM lv UNION ALL SELECT 'persistent_hazards', 'count', count(*) FILTER (event_type = 'PERSISTENT_HAZARD') FROM mixed
  UNION ALL SELECT 'elevated_risk_episodes', 'count', count(*) FROM epi UNION ALL SELECT 'elevated_risk_episodes', 'closed', count(e0) FROM epi UNION ALL SELECT 'elevated_risk_episodes', 'open_at_end_of_clip', count(*) - count(e0) FROM epi
  UNION ALL SELECT 'pattern_events', key, v FROM pat UNION ALL SELECT 'recommendation_events', advice, count(*) FROM k GROUP BY 2 UNION ALL SELECT category, key, value FROM five UNPIVOT (value FOR key IN (n, mean, median, max, min)))
SELECT 'REAL' AS scope, category, key, value FROM r""")
def event_statistics(spark, d):
    return report.statistics(mixed(spark, d))


REASON_SQL = ASSESS_SQL[: ASSESS_SQL.rindex("SELECT session_id, frame, round(score, 9)")] + f""", dd AS (SELECT g.*, h.class_name, h.persistence, h.detections, h.approaching, h.moving_in, h.growth, h.toward, h.off, pp >= 20 AS present, r0 = 3 AND r1 = 2 AS capped, r1 >= 2 AND groups < 2 AS low,
  array_to_string(list_filter([CASE WHEN d1 > 0 THEN 'drowsiness level ' || lv END, CASE WHEN d2 > 0 THEN 'inferred HANDS_OFF_WHEEL (sustained NO_HANDS)' END, CASE WHEN d3 > 0 THEN 'head turned away for ' || printf('%.1f', away) || ' s (yaw n/a, pitch n/a; relative head-pose signal)' END], lambda x: x IS NOT NULL), ' and ') AS drv_text
  FROM g LEFT JOIN hz h USING (track_id)),
ra AS (SELECT *, 'persistent ' || class_name || ' #' || track_id || ' (observed ' || printf('%.1f', persistence) || ' s, ' || detections || ' detections)' AS lead, CASE WHEN off <= 0.2 THEN 'across' ELSE 'toward' END AS how FROM dd),
rb AS (SELECT *, list_filter([CASE WHEN approaching THEN 'image-space box area growing ' || printf('%.0f', 100 * (exp(growth) - 1)) || '%/s' END, CASE WHEN moving_in THEN 'moving ' || how || ' the central band at ' || printf('%.2f', toward) || ' frame-widths/s (image space)' END,
  CASE WHEN off <= 0.2 THEN 'in the central image band' WHEN off <= 0.35 THEN 'near the central image band' END], lambda x: x IS NOT NULL) AS bits FROM ra),
rc AS (SELECT *, lead || CASE WHEN len(bits) > 0 THEN ': ' || array_to_string(bits, ', ') ELSE '' END AS road_text, CASE WHEN nq > 2 THEN ' (+' || (nq - 1) || ' other road hazards)' WHEN nq = 2 THEN ' (+1 other road hazard)' ELSE '' END AS more, class_name || ' #' || track_id AS name FROM rb)
SELECT session_id, frame, CASE WHEN nd > 0 AND rq THEN upper(drv_text[1]) || drv_text[2:] || ' coincides with a ' || road_text || more || '.' WHEN rq THEN upper(road_text[1]) || road_text[2:] || more || '.'
  WHEN nd > 0 THEN upper(drv_text[1]) || drv_text[2:] || '; no road hazard with approach/conflict evidence.' WHEN present THEN 'Persistent ' || name || ' is visible but shows no approach or conflict evidence in image space.' ELSE 'No persistent road hazard and no driver impairment signal.' END AS reason,
  array_to_string(list_filter([CASE WHEN capped THEN 'CRITICAL needs a driver factor with a moving road hazard, or a very strong road hazard' END, CASE WHEN low THEN 'HIGH needs at least 2 independent evidence groups' END], lambda x: x IS NOT NULL), '; ') AS gates FROM rc"""


@query("risk_reasons", REASON_SQL)
def risk_reasons(spark, d):
    return assessed(spark, d).select("session_id", "frame", "reason", F.array_join("gates", "; ").alias("gates"))
