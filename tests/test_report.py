"""Reports, records, sinks and synthetic tables on small inputs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from eventloom import schemas
from eventloom.config import RiskSettings
from eventloom.operators import files, records, report, risk, stats
from eventloom.operators.ordered import placed
from eventloom.sources import writers

EVENTS = "event_id string, run_id string, session_id string, event_type string, transition string, previous_risk_level string, risk_level string, change_kind string, hazard_type string, hazard_class string, smoothed_risk_score double, raw_risk_score double, timestamp double, camera string, source_file string, risk_reason string, evidence_path string, observation_type string, data_source string, alarm_recommended boolean, alarm_triggered boolean, hazard_persistence double, track_persistence_seconds double, ordinal int"
ROWS = [
    ("e1", "r", "s", "RISK_ESCALATED", "SAFE->HIGH", "SAFE", "HIGH", None, "PEDESTRIAN_CONFLICT", "person", 50.0, 51.0, 1.234, "front", None, "a|b", "x.jpg", "INFERRED", "LOCAL_REAL", True, False, None, None, 1),
    ("e2", "r", "s", "DRIVER_STATE_CHANGE", "LOW->HIGH", None, None, "drowsiness_level", None, None, None, None, 2.0, "driver", "clip.mp4", "", None, "INFERRED", "LOCAL_REAL", None, False, None, None, 2),
    ("e3", "r", "s", "RISK_DEESCALATED", "HIGH->SAFE", "HIGH", "SAFE", None, None, "", 3.0, 4.0, None, None, None, None, "", None, None, False, False, None, None, 3),
    ("e4", "r", "s", "PERSISTENT_HAZARD", None, None, "CAUTION", None, "ROAD_USER_PRESENT", "car", 20.0, 20.0, 4.0, "front", None, None, None, "INFERRED", "LOCAL_REAL", None, False, 2.5, 3.0, 4),
]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(ROWS, EVENTS)


def test_entries(events):
    got = {r.event_id: r for r in report.event_entries(events, "../").collect()}
    assert (got["e1"].time, got["e1"].risk, got["e1"].hazard, got["e1"].evidence_path) == ("1.23 s into s", "HIGH (score 50.0), SAFE->HIGH", "PEDESTRIAN_CONFLICT (person)", "../x.jpg")
    assert (got["e2"].time, got["e2"].risk, got["e2"].hazard, got["e2"].recommendation_key) == ("2.00 s into clip.mp4", "not recorded", "drowsiness_level: LOW->HIGH", "drowsiness")
    assert got["e2"].reason == "drowsiness_level changed LOW->HIGH (held for the configured observations)"
    assert (got["e3"].time, got["e3"].hazard, got["e3"].camera, got["e3"].evidence_path, got["e3"].recommendation) == ("not recorded", "not recorded", "not recorded", "none recorded", stats.ADVICE["deescalation"])
    text = {r.value for r in report.entry_lines(report.event_entries(events.filter("event_id = 'e4'"))).collect()}
    assert len(text) == 1 and "- **Reason (engine's overall assessment at this time):** not recorded" in text.pop()
    assert set(stats.ADVICE) >= set(stats.HAZARD_ADVICE.values()) | set(stats.INFORMATIONAL)


def test_report_files(spark, events, tmp_path):
    paths = report.write_report(events, f"file://{tmp_path}/r")
    md = "\n".join(r.value for r in spark.read.text(paths["summary_md"]).collect())
    assert "Total events: 4" in md and "Pedestrian hazards: 1 event(s)" in md and stats.ADVICE["drowsiness"] in md
    assert [r["key"] for r in json.loads(spark.read.text(paths["summary_json"]).first().value)["recommendations"]] == ["drowsiness", "pedestrian", "deescalation", "road_user_present"]
    long = {(r.category, r.key): r.value for r in spark.read.option("header", True).csv(paths["statistics_csv"], inferSchema=True).collect()}
    assert long["total", "events"] == 4 and long["persistent_hazards", "count"] == 1 and long["events_by_risk_level", "CRITICAL"] == 0 and long["driver_state_events", "drowsiness_level: LOW->HIGH"] == 1
    assert spark.read.json(paths["entries_json"]).count() == 3 and spark.read.parquet(paths["recommended_events"]).count() == 4
    assert report.statistics(events.limit(0)).filter("category = 'total'").select("value").collect()[0].value == 0
    assert "No events found." in report.render(events.limit(0))


def test_factor_details_and_reasons(spark):
    t = spark.createDataFrame([(1, 7, "car", 1.5, 8, 0.0, 200.0, 290.0, 12000.0, 0.5, None, 0.3, 1), (1, 9, "person", 1.0, 4, 0.0, 200.0, 290.0, 600.0, None, 0.2, 0.9, 0)], "frame int, track_id long, class_name string, persistence double, detections int, missed double, cx double, y2 double, area double, growth double, lateral double, confidence double, label_changes int")
    h = risk.track_hazards(t.withColumns({"width": F.lit(400.0), "height": F.lit(300.0)})).cache()
    car = h.filter("track_id = 7").first()
    assert [f["track_id"] for f in car.factors] == [7] * len(car.factors) and car.factors[0]["detail"] == "car #7 observed for 1.5 s (8 detections)"
    assert car.phrases == ["observed 1.5 s, 8 detections", "image-space box area growing 65%/s", "in the central image band"]
    assert car.factors[-1]["detail"] == "car #7 points x0.42: mean detector confidence 0.30 < 0.60; 1 detector label change(s) (car)"
    f = risk.frame_hazards(h, ["frame"]).withColumns({"drowsiness_level": F.lit("HIGH"), "drowsiness_score": F.lit(0.6), "driver_activity": F.lit("NORMAL"), "head_away_seconds": F.lit(0.0), "driver_age": F.lit(0.1), "observation_quality": F.lit(1.0)})
    a = risk.assess(f).first()
    assert a.n_qualifying == 2 and a.reason.startswith("Drowsiness level HIGH, score 0.60 coincides with a persistent ") and a.reason.endswith(" (+1 other road hazard).")
    assert a.risk_notes[-1] == risk.IMAGE_ONLY
    notes = [risk.assess(f.withColumn("driver_age", F.lit(x).cast("double"))).first().risk_notes[0] for x in (None, RiskSettings().driver_age + 1)]
    assert notes[0] == "no driver observation: driver factors not evaluated" and notes[1].endswith("driver factors not evaluated") and "s old" in notes[1]
    h.unpersist()


def test_records_and_links(spark):
    rows = spark.createDataFrame([("event_000001", "s", 1.0, "HIGH", 50.12345, 0, None), ("event_000002", "s", 2.0, None, None, 640, 10.0)], "event_id string, session_id string, timestamp double, level string, raw_score double, width int, gps_lat double")
    rows = rows.withColumn("factors", F.array(risk.factor("approach", F.lit(1.26), "road", "d", F.lit(3)))).withColumn("gps_source", F.lit("LOG"))
    a, b = records.event_records(rows, run_id="r", camera="front").orderBy("event_id").collect()
    assert list(a.asDict()) == schemas.EVENT_SCHEMA.names and (a.raw_risk_score, a.risk_level, a.image_width, a.gps_source, a.run_id, a.evidence_kind) == (50.123, "HIGH", None, "UNAVAILABLE", "r", "NONE")
    assert json.loads(a.risk_factors) == [{"name": "approach", "points": 1.3, "source": "road", "detail": "d", "track_id": 3}] and (b.image_width, b.gps_source, b.risk_level) == (640, "LOG", None)
    al = spark.createDataFrame([("a1", "s", 1.0), ("a2", "s", 9.0)], "alert string, session_id string, t double")
    assert [r.event_ids for r in records.alert_events(al, rows, ["session_id"], "t", "timestamp").orderBy("alert").collect()] == [["event_000001"], []]


def test_synthetic_table(spark, tmp_path):
    row = {f.name: None if f.nullable else {"string": "-", "double": 0.0, "bigint": 1, "boolean": True}[f.dataType.simpleString()] for f in schemas.SIM_SCHEMA}
    row |= dict.fromkeys(("data_source", "observation_type", "timestamp_source", "gps_source"), "SYNTHETIC") | dict.fromkeys(("events_emitted", "expected_peak_levels", "notes"), "[]")
    row |= {"event_id": "sim_000001", "camera": "front+driver", "location_source": schemas.LOCATION_SOURCE, "instance_peak_risk_level": "SAFE", "alarm_triggered": False}
    assert len(schemas.SIM_SCHEMA) == 73 and schemas.resolved("object_id") == "primary_track_id" and schemas.resolved("gps_lat") == "gps_lat"
    table = lambda **changes: spark.createDataFrame([row | changes], schemas.SIM_SCHEMA)
    found = lambda **changes: schemas.sim_validated(table(**changes)).first().problems
    assert found() == [] and found(event_id="event_000001") == ["looks real"] and found(parent_real_event_id="event_000001") == ["parent run"] and found(notes="{", trajectory_overlap=2.0) == ["notes: not JSON"]
    paths = writers.write_synthetic_table(table(), f"file://{tmp_path}/sim", "/real", {"seed": 42})
    assert spark.read.parquet(paths["parquet"]).count() == 1 and json.loads(spark.read.text(paths["manifest"]).first().value)["seed"] == 42
    for bad, root in ((table(data_source="LOCAL_REAL"), "/real"), (table(), f"file://{tmp_path}"), (table(alarm_triggered=True), "/real"), (table().drop("notes"), "/real")):
        with pytest.raises(writers.Rejected):
            writers.write_synthetic_table(bad, f"file://{tmp_path}/sim", root)
    out = writers.write_session(table().select("event_id"), table().select("timestamp", "hazard_type"), {"alerts": 1}, f"file://{tmp_path}/s")
    assert json.loads(spark.read.text(out["summary"]).first().value) == {"alerts": 1} and spark.read.json(out["alerts"]).count() == 1


def test_places_and_medians(spark):
    d = spark.createDataFrame([(None, 5.0, 1), (None, 5.0, 2), ("a", 1.0, 3), ("a", 9.0, 4), ("a", 9.0, 5), ("a", None, 6)], "k string, v double, i int")
    got = {(r.k, r.i): (r._r, r._n) for r in placed(d.withColumn("b", F.floor(F.coalesce("v", F.lit(-1.0)) / 4)), ["k"], ["v", "i"], "b").collect()}
    assert got == {(None, 1): (1, 2), (None, 2): (2, 2), ("a", 6): (1, 4), ("a", 3): (2, 4), ("a", 4): (3, 4), ("a", 5): (4, 4)}
    assert sorted(r.i for r in stats.evenly_spaced(d, ["k"], ["i"], 2).collect()) == [1, 2, 3, 6]
    assert stats.evenly_spaced(d.limit(0), ["k"], ["v"], 2).count() == 0
    assert [tuple(r) for r in stats.five_by(d, ["k"], "v").collect()] == [("a", 3, 6.333, 9.0, 9.0, 1.0)]
    o = stats.five_of(d.withColumn("w", F.lit(None).cast("double")), {"x": "v", "none": "w"})
    assert o.first().x.median == 5.0 and o.first()["none"] is None


def test_conflicts_with_repeats(spark):
    d = spark.createDataFrame([("h", "x", "bb"), ("h", "x", "a"), ("h", "x", "a"), ("g", "x", "c"), ("g", "y", "d"), (None, "x", "e")], "h string, l string, n string")
    assert sorted((r.n, r.verdict) for r in files.conflict_aware(d, "h", "l", "n").collect()) == [("a", "duplicate"), ("a", "kept"), ("bb", "duplicate"), ("c", "conflict"), ("d", "conflict"), ("e", "kept")]
