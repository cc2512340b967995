"""Hand-computed vectors, state machines, robustness."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from eventloom import config, schemas
from eventloom.functions import columns
from eventloom.operators import asof, driver, files, folds, machines, mleval, ordered, recorder, risk, simulate, stats, tracker
from eventloom.sources import readers, writers

S = ["session_id"]


def rows_of(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


# ---------------------------------------------------------------- fixture: eight events

EVENTS = [
    ("1", "RISK_ESCALATED", "s1", 0.5, "CAUTION", "SAFE", "PEDESTRIAN_CONFLICT", None), ("2", "RISK_ESCALATED", "s1", 1.5, "HIGH", "CAUTION", "PEDESTRIAN_CONFLICT", None), ("3", "PERSISTENT_HAZARD", "s1", 2.5, "HIGH", None, "PEDESTRIAN_CONFLICT", 2.0),
    ("4", "RISK_DEESCALATED", "s1", 4.0, "SAFE", "HIGH", "NONE", None), ("5", "RISK_ESCALATED", "s2", 0.3, "CAUTION", "SAFE", "APPROACHING_VEHICLE", None), ("6", "RISK_ESCALATED", "s2", 1.2, "HIGH", "CAUTION", "APPROACHING_VEHICLE", None),
    ("7", "DRIVER_STATE_CHANGE", "d1", 2.0, None, None, None, None), ("8", "DRIVER_STATE_CHANGE", "d1", 3.0, None, None, None, None),
]


def record(e, **more):
    i, kind, session, t, level, before, hazard, persisted = e
    change = {"7": ("drowsiness_level", "HIGH->CRITICAL"), "8": ("hand_state", "ONE_HAND->NO_HANDS")}.get(i, (None, None))
    out = dict.fromkeys(schemas.EVENT_SCHEMA.names)
    out |= {
        "schema_version": "1.0", "event_id": i, "run_id": "fixture_run", "session_id": session, "camera": "driver" if session == "d1" else "front", "data_source": "LOCAL_REAL", "observation_type": "OBSERVED" if i == "8" else "INFERRED", "timestamp": t, "event_type": kind,
        "risk_level": level, "previous_risk_level": before, "transition": f"{before}->{level}" if before else change[1], "hazard_type": hazard, "hazard_persistence": persisted, "change_kind": change[0], "gps_source": "UNAVAILABLE", "smoothed_risk_score": 30.0,
        "raw_risk_score": 28.0, "alarm_recommended": level in ("HIGH", "CRITICAL"), "alarm_triggered": False, "evidence_kind": "NONE",
    }
    return out | more


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame([record(e) for e in EVENTS], schemas.EVENT_SCHEMA).withColumn("ordinal", F.col("event_id").cast("long"))


def test_overview(events):
    o = stats.event_overview(events).first()
    assert (o.total_events, o.sessions, o.level_safe, o.level_caution, o.level_high, o.level_critical, o.without_level, o.alarm_true) == (8, 3, 1, 2, 3, 0, 2, 3)
    assert o.hazard_persistence.n == 1 and o.hazard_persistence.mean == 2.0 and o.runs == ["fixture_run"]
    got = dict(rows_of(stats.counted(events, F.col("transition"), "ordinal", F.col("event_type").startswith("RISK_")), "key", "n"))
    assert got == {"SAFE->CAUTION": 2, "CAUTION->HIGH": 2, "HIGH->SAFE": 1}


def test_episodes(events):
    e = ordered.elevated_episodes(events, ["run_id", "session_id"], "timestamp", ["ordinal"])
    assert sorted(rows_of(e, "session_id", "duration_seconds", "peak_level", "end_event")) == [("s1", 3.5, "HIGH", "4"), ("s2", None, "HIGH", None)]


def test_episode_restarts_and_orphans(spark):
    r = [("a", 0, "SAFE", "HIGH", "RISK_DEESCALATED"), ("b", 1, "CAUTION", "SAFE", "RISK_ESCALATED"), ("c", 2, "HIGH", "SAFE", "RISK_ESCALATED"), ("d", 3, "SAFE", "HIGH", "RISK_DEESCALATED"), ("e", 4, "SAFE", "CAUTION", "RISK_DEESCALATED"), ("f", float("nan"), "HIGH", "SAFE", "RISK_ESCALATED")]
    df = spark.createDataFrame([(x[0], float(x[1]), x[2], x[3], x[4], "s") for x in r], "event_id string, timestamp double, risk_level string, previous_risk_level string, event_type string, session_id string")
    assert rows_of(ordered.elevated_episodes(df, S), "start_event", "end_event", "peak_level") == [("c", "d", "HIGH")]


def test_patterns_and_advice(events):
    p = {r.pattern: r for r in stats.find_patterns(events, ids=True).collect()}
    assert (p["pedestrian_hazard"].events, p["pedestrian_hazard"].sessions_with_repeats, p["pedestrian_hazard"].event_ids) == (3, 1, ["1", "2", "3"])
    assert p["approaching_vehicle_hazard"].max_in_one_session == 2 and p["animal_hazard"].events == 0
    advice = dict(rows_of(events.select("event_id", stats.recommendation().alias("k")), "event_id", "k"))
    assert advice == {"1": "pedestrian", "2": "pedestrian", "3": "pedestrian", "4": "deescalation", "5": "vehicle", "6": "vehicle", "7": "drowsiness", "8": "hands_off"}
    text = dict(rows_of(stats.describe_patterns(stats.find_patterns(events)), "pattern", "text"))
    assert text["animal_hazard"] == "Animal hazards: none recorded."
    assert sorted(rows_of(events.filter(stats.is_significant()), "event_id")) == [("2",), ("3",), ("6",), ("7",), ("8",)]


def test_valid_rows_and_rules(spark, events):
    assert schemas.validated(events.drop("ordinal")).filter(F.size("problems") > 0).count() == 0
    bad = [
        record(EVENTS[0], observation_type="OBSERVED"), record(EVENTS[0], risk_level="SAFE"), record(EVENTS[0], gps_lat=1.0), record(EVENTS[0], trajectory_overlap=1.0), record(EVENTS[0], evidence_kind="CLIP", evidence_path="a/../b", evidence_files='["x"]'), record(EVENTS[0], risk_factors="{"),
        record(EVENTS[6], change_kind=None), record(EVENTS[0], raw_risk_score=float("inf")),
    ]
    got = [r.problems for r in schemas.validated(spark.createDataFrame(bad, schemas.EVENT_SCHEMA).coalesce(1)).collect()]
    assert got == [["inferred"], ["direction"], ["coordinates", "gps source"], ["reserved"], ["evidence paths"], ["risk_factors: not JSON"], ["driver fields"], ["raw_risk_score: not finite"]]
    assert schemas.schema_diff(spark.range(1).withColumnRenamed("id", "event_id"))[2] == ["event_id"]


def test_loader(spark, tmp_path):
    lines = [json.dumps(record(e)) for e in EVENTS]
    lines += [json.dumps(record(EVENTS[0], event_id="9", data_source="SYNTHETIC")), json.dumps(record(EVENTS[0], event_id="10", data_source=None)), "{not json", "[1, 2]", '{"event_id": "x"}', "", json.dumps(record(EVENTS[1], camera="late"))]
    lines.append('{"event_id": "11", "event_type": "PERSISTENT_HAZARD", "data_source": "PUBLIC", "timestamp": null, "raw_risk_score": "n/a", "smoothed_risk_score": true}')
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    got = readers.load_events(spark, [f"{tmp_path}/a.jsonl", f"{tmp_path}/none.jsonl"])
    assert [r.event_id for r in got.events.collect()] == ["11", "7", "8", "1", "2", "3", "4", "5", "6"]
    assert got.missing == [f"{tmp_path}/none.jsonl"]
    assert got.malformed.first()[0] == 3 and got.duplicates.first()[0] == 1
    assert dict(rows_of(got.excluded, "data_source", "n")) == {"SYNTHETIC": 1, "None": 1}
    last = got.events.filter("event_id = '11'").first()
    assert last.raw_risk_score is None and last.smoothed_risk_score is None
    (tmp_path / "empty.jsonl").write_text("")
    assert readers.load_events(spark, [f"{tmp_path}/empty.jsonl"]).events.count() == 0


def test_writer(spark, tmp_path):
    df = spark.createDataFrame([record(e) for e in EVENTS], schemas.EVENT_SCHEMA)
    path = f"{tmp_path}/events"
    assert writers.append_events(df, path) == 8
    for wrong in (df, df.limit(1).withColumn("event_id", F.lit("50")).withColumn("data_source", F.lit("SYNTHETIC")), df.drop("notes"), df.withColumn("event_id", F.lit("z"))):
        with pytest.raises(writers.Rejected):
            writers.append_events(wrong, path)
    writers.finalise(spark, path, f"{tmp_path}/columns")
    assert spark.read.parquet(f"{tmp_path}/columns").count() == 8
    with pytest.raises(writers.Rejected):
        writers.write_synthetic(df, f"{tmp_path}/real/x", f"{tmp_path}/real")
    with pytest.raises(writers.Rejected):
        writers.write_synthetic(df, f"{tmp_path}/syn", f"{tmp_path}/real")
    doc = json.loads(writers.schema_document())
    assert len(doc["fields"]) == 60
    assert "a/b" in writers.markdown_table(spark.createDataFrame([("a|b", None)], "x string, y string"))


# ---------------------------------------------------------------- tracker


DETS = "session_id string, ts double, frame_index int, det_ix int, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double"


def car(x, y=100.0, w=40.0, h=40.0, label="car", score=0.9):
    return (label, score, x - w / 2, y - h / 2, x + w / 2, y + h / 2)


def tracked(spark, frames, s=config.TrackSettings()):
    """Track rows, frame by frame, of (time, detections)."""
    rows = [("a", float(t), i, j, *d) for i, (t, dets) in enumerate(frames) for j, d in enumerate(dets or [(None,) * 6])]
    got = tracker.track(spark.createDataFrame(rows, DETS), "session_id", s).collect()
    return [sorted((r for r in got if r.ts == t and not r.ended), key=lambda r: r.track_id) for t, _ in frames], [r for r in got if r.ended]


def test_overlap_vectors():
    assert tracker.overlap((0, 0, 10, 10), (0, 0, 10, 10)) == 1
    assert tracker.overlap((0, 0, 10, 10), (20, 20, 30, 30)) == 0
    assert abs(tracker.overlap((0, 0, 10, 10), (5, 0, 15, 10)) - 50 / 150) < 1e-12
    assert tracker.overlap((0, 0, 0, 0), (0, 0, 0, 0)) == 0


def test_tracker_motion_and_coast(spark):
    f, _ = tracked(spark, [(1.0, [car(100, 200)]), (1.2, [car(110, 194)]), (1.4, []), (1.8, [car(120, 194)])])
    assert f[0][0].vx is None and f[0][0].detections == 1
    r = f[1][0]
    assert r.track_id == 1 and abs(r.vx - 50) < 1e-9 and abs(r.vy + 30) < 1e-9 and abs(r.mean_confidence - 0.9) < 1e-12
    r = f[2][0]
    assert not r.active and r.missed_frames == 1 and abs(r.missed - 0.2) < 1e-9 and abs(r.vx - 50) < 1e-9 and r.frame_index == 1
    r = f[3][0]
    assert r.track_id == 1 and abs(r.vx - 10 / 0.6) < 1e-9 and abs(r.persistence - 0.8) < 1e-9 and r.missed_frames == 0


def test_tracker_keeps_rates_between_equal_times(spark):
    rows = [("a", t, i, 0, *car(x)) for i, (t, x) in enumerate([(0.0, 100), (0.2, 110), (0.2, 112)])]
    got = {r.frame_index: r for r in tracker.track(spark.createDataFrame(rows, DETS)).filter("not ended").collect()}
    assert abs(got[2].vx - 50) < 1e-9 and got[2].cx == 112 and got[2].previous_cx == 100


def test_tracker_expiry_reset_and_labels(spark):
    f, ends = tracked(spark, [(0.0, [car(100)]), (0.5, []), (0.6, []), (0.7, [car(100)]), (0.1, [car(100)])], config.TrackSettings(max_missed=0.5))
    assert [[r.track_id for r in x] for x in f] == [[1], [1], [], [2], [3]]
    assert sorted((r.track_id, r.ts) for r in ends) == [(1, 0.6), (2, 0.7), (3, 0.1)]
    f, ends = tracked(spark, [(i / 10, [car(100, label=x)]) for i, x in enumerate(("dog", "person", "dog", "person"))])
    assert [len(x) for x in f] == [1] * 4 and f[3][0].class_name == "dog" and f[3][0].label_changes == 3
    assert [r.class_history for r in ends] == [["dog", "person", "dog", "person"]]
    f, ends = tracked(spark, [(0.0, [car(100)]), (0.1, []), (0.2, [])], config.TrackSettings(max_frames=1))
    assert [len(x) for x in f] == [1, 1, 0] and [r.ts for r in ends] == [0.2]
    with pytest.raises(ValueError):
        tracker.Matcher().frame([], float("nan"))


def test_tracker_greedy_order(spark):
    f, _ = tracked(spark, [(0.0, [car(100), car(125)]), (0.1, [car(123), car(101)])])
    assert [round(r.cx) for r in f[1]] == [101, 123]
    # Another class needs more overlap, and comes after the own class.
    f, _ = tracked(spark, [(0.0, [car(100)]), (0.1, [car(101, label="dog"), car(104)])])
    assert [(r.track_id, r.observed_class) for r in f[1]] == [(1, "car"), (2, "dog")]
    f, _ = tracked(spark, [(0.0, [car(100)]), (0.1, [car(115, label="dog")]), (0.2, [car(116, label="dog")])])
    assert [(r.track_id, r.active) for r in f[1]] == [(1, False), (2, True)]


def test_track_table(spark):
    rows = [("a", 0.1 * i, i, 0, "car", 0.9, 10.0 + i, 10.0, 50.0 + i, 50.0) for i in range(5)] + [("a", 0.5, 5, 0, None, None, None, None, None, None), ("b", 0.0, 0, 0, "dog", 0.5, 0.0, 0.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "session_id string, ts double, frame_index int, det_ix int, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double")
    got = tracker.track(df).collect()
    a = [r for r in got if r.session_id == "a"]
    assert len([r for r in a if not r.ended]) == 6 and sum(r.ended for r in got) == 2
    assert {r.track_id for r in got} == {1} and max(r.detections for r in a) == 5
    assert [r.active for r in a if not r.ended][-1] is False
    assert tracker.track(df.limit(0)).count() == 0


# ---------------------------------------------------------------- risk


WANT = {
    "empty_road": ("SAFE", 0, "NONE"), "static_far_car": ("SAFE", 12, "NONE"), "approaching_car": ("HIGH", 49, "APPROACHING_VEHICLE"), "pedestrian_to_centre": ("CAUTION", 36, "PEDESTRIAN_CONFLICT"), "pedestrian_far_side": ("SAFE", 10, "NONE"),
    "dog_central": ("CAUTION", 34, "ANIMAL_HAZARD"), "drowsy_high": ("CAUTION", 30, "DRIVER_DROWSINESS"), "hands_off": ("CAUTION", 25, "HANDS_OFF_WHEEL"), "approach_hands_off": ("CRITICAL", 89, "COMBINED_DRIVER_HAZARD"),
    "approach_drowsy": ("CRITICAL", 94, "COMBINED_DRIVER_HAZARD"), "pedestrian_hands_off": ("CRITICAL", 76, "COMBINED_DRIVER_HAZARD"), "dog_hands_off": ("CRITICAL", 74, "COMBINED_DRIVER_HAZARD"),
}


def test_scenarios(spark):
    rows = simulate.run(spark, variants=1).cache()
    got = {r.scenario: (r.final_level, round(r.final_score), r.final_hazard) for r in simulate.verdicts(rows).collect()}
    assert {k: v for k, v in got.items() if k != "static_far_car"} == {k: v for k, v in WANT.items() if k != "static_far_car"}
    assert got["static_far_car"][0] == "SAFE"
    off = rows.withColumn("s", risk.points_of("factors")).filter((F.abs(F.col("s") - F.col("raw_score")) > 1e-9) | (F.col("raw_score") < 0) | (F.col("raw_score") > 100))
    assert off.count() == 0
    assert rows.filter(F.col("reason").isNull()).count() == 0
    rows.unpersist()


def test_ramp_and_gates(spark):
    d = spark.createDataFrame([(0.0,), (0.5,), (2.0,), (-1.0,)], "x double")
    assert rows_of(d.select(columns.ramp("x", 0.0, 1.0).alias("r")), "r") == [(0.0,), (0.5,), (1.0,), (0.0,)]
    assert rows_of(d.select(columns.ramp("x", 1.0, 1.0).alias("r")), "r") == [(0.0,), (0.0,), (1.0,), (0.0,)]
    assert rows_of(spark.createDataFrame([(19.9,), (20.0,), (45.0,), (70.0,)], "x double").select(columns.level_for_score("x").alias("r")), "r") == [(0,), (1,), (2,), (3,)]


def test_hysteresis_rules():
    def run(raws, dt=0.1):
        m = machines.Hysteresis()
        return [m.update(i * dt, r) for i, r in enumerate(raws)]

    assert run([1]) == [1] and run([2, 2]) == [1, 2] and run([3, 3, 3]) == [1, 2, 3] and run([3, 0, 3, 0, 0]) == [1, 1, 1, 1, 0]
    assert run([3, 3, 3, 0, 0, 0, 0, 0, 0])[-6:] == [3, 2, 2, 1, 1, 0]
    m = machines.Hysteresis()
    for i in range(3):
        m.update(i * 0.1, 3)
    assert m.level == 3 and m.update(5.0, 0) == 0
    m.update(5.1, 1)
    assert m.update(4.0, 0) == 0


def test_decay_equals_recursion(spark):
    rng = random.Random(3)
    t, rows, score, last, want = 0.0, [], None, None, []
    for i in range(300):
        t += rng.choice([0.1, 0.1, 0.3, 2.5])
        x = rng.uniform(0, 100)
        if last is not None and t - last > 2:
            score = None
        score = x if score is None or x >= score else max(x, score - 40 * (t - last))
        last = t
        rows.append(("s", i, t, x))
        want.append(score)
    df = spark.createDataFrame(rows, "session_id string, i int, t double, x double")
    got = [r.smoothed for r in folds.decayed_score(df, S, ["t", "i"], "t", "x").orderBy("i").collect()]
    assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 1e-9


# ---------------------------------------------------------------- driver and recorder


def test_debounce_table_equals_machine(spark):
    rng = random.Random(5)
    rows = [(s, i, rng.choice(["A", "B", "B", "UNKNOWN", None, "A", "A"])) for s in range(6) for i in range(120)]
    want = []
    for s in range(6):
        m = machines.Debounce(3)
        for x in rows:
            if x[0] == s and (c := m.update(x[2])):
                want.append((s, x[1], *c))
    df = spark.createDataFrame(rows, "session_id int, i int, v string")
    got = rows_of(folds.debounced(df, S, ["i"], "v", 3), "session_id", "i", "previous", "v")
    assert sorted(got) == sorted(want) and want


def test_eye_features_equal_recomputation(spark):
    rng = random.Random(8)
    t, rows = 0.0, []
    for i in range(250):
        t += rng.choice([0.1, 0.2, 0.4, 0.9])
        rows.append(("s", i, t, rng.choice([True, True, False, None])))
    cfg = config.DriverSettings(window=5.0)
    df = spark.createDataFrame(rows, "session_id string, i int, t double, closed boolean")
    got = driver.eye_features(df, S, ["t", "i"], "t", "closed", cfg).orderBy("i").collect()
    m, ends = machines.Closures(0.5, 0.5, 1.0), []
    for k, (_, _, t, c) in enumerate(rows):
        if e := m.update(t, c):
            ends.append(e)
        lo = t - 5.0
        spans = [(b[2] - max(a[2], lo), a[3]) for a, b in zip(rows[:k], rows[1 : k + 1], strict=True) if a[3] is not None and 0 < b[2] - a[2] <= 0.5 and b[2] > lo]
        obs = sum(x for x, _ in spans)
        assert abs(got[k].observed_seconds - obs) < 1e-9
        assert abs(got[k].positive_seconds - sum(x for x, y in spans if y)) < 1e-9
        assert (got[k].blinks, got[k].long_closures) == tuple(sum(1 for e in ends if e[0] >= lo and e[2] == kind) for kind in ("blink", "long"))
        assert got[k].closed_seconds is None if c is None else abs(got[k].closed_seconds - (t - m.began if c else 0.0)) < 1e-9


def test_cooldown_and_sampler():
    c = machines.Cooldown(10)
    assert [c.update(t) for t in (0, 5, 9.9, 10, 15, 20, 31)] == [True, False, False, True, False, True, True]
    g = machines.GridSampler(10)
    assert [g.update(t) for t in (0.0, 0.05, 0.1, 0.15, 0.21, 1.0, 1.05, 1.1)] == [True, False, True, False, True, True, False, True]
    assert machines.GridSampler(0).update(1)
    p = machines.Printer(5)
    assert [p.update(*x) for x in ((0, "a"), (1, "a"), (2, "b"), (6, "b"), (7, "b"))] == [True, False, True, False, True]


def test_persistent_hazards(spark):
    rows = [("s", i, 0.5 * i, "V", 1, "HIGH") for i in range(30) if i not in (12,)] + [("s", i, 0.5 * i, "V", 2, "SAFE") for i in range(30)]
    df = spark.createDataFrame(rows, "session_id string, step int, t double, kind string, track int, level string")
    got = recorder.persistent_hazards(df, S, ["kind", "track"], "step", "t", "level")
    assert sorted(rows_of(got, "track", "t", "hazard_persistence")) == [(1, 2.0, 2.0), (1, 12.0, 5.5)]
    a = recorder.alerts(spark.createDataFrame([("s", 0, "SAFE"), ("s", 1, "HIGH"), ("s", 2, "HIGH"), ("s", 3, "CAUTION")], "session_id string, t int, level string"), S, ["t"], "t")
    assert rows_of(a.orderBy("t"), "alert_id", "severity", "escalation") == [("alert_0001", "MEDIUM", True), ("alert_0002", "LOW", False)]


def test_nearest_prefers_the_earlier(spark):
    left = spark.createDataFrame([("s", 1, 10.0), ("s", 2, 50.0)], "session_id string, e int, t double")
    right = spark.createDataFrame([("s", 9.0, 1), ("s", 11.0, 2), ("s", 56.0, 3)], "session_id string, ft double, fix int")
    assert sorted(rows_of(asof.nearest(left, right, S, "t", "ft", 5.0, ["fix"]), "e", "fix"), key=str) == [(1, 1), (2, None)]
    assert sorted(rows_of(asof.backward(left, right, S, "t", "ft", ["fix"], max_age=3.0), "e", "fix"), key=str) == [(1, 1), (2, None)]


def test_nearest_of_rows_that_share_an_id_or_a_time(spark):
    left = spark.createDataFrame([("s", 1, 0.0), ("s", 1, 100.0), ("s", 2, 100.0), ("s", 2, 100.0), ("z", 1, 0.0)], "session_id string, e int, t double")
    right = spark.createDataFrame([("s", 0.1, 1), ("s", 99.5, 2), ("s", 100.5, 3)], "session_id string, ft double, fix int")
    got = rows_of(asof.nearest(left, right, S, "t", "ft", 1.0, ["fix"]), "session_id", "e", "t", "fix")
    assert sorted(got, key=str) == [("s", 1, 0.0, 1), ("s", 1, 100.0, 2), ("s", 2, 100.0, 2), ("s", 2, 100.0, 2), ("z", 1, 0.0, None)]


# ---------------------------------------------------------------- files, evaluation, config


def test_apportionment(spark):
    c = spark.createDataFrame([("a", 10), ("b", 3), ("c", 100), ("d", 1)], "k string, n long")
    got = {}
    for r in files.apportioned(c, "k", "n", {"train": 0.7, "val": 0.15, "test": 0.15}).collect():
        got.setdefault(r.k, {})[r.split] = r["size"]
    assert got["a"] == {"train": 7, "val": 2, "test": 1} and got["b"] == {"train": 1, "val": 1, "test": 1} and got["c"] == {"train": 70, "val": 15, "test": 15}
    assert all(sum(v.values()) == n for (k, n), v in zip((("a", 10), ("b", 3), ("c", 100), ("d", 1)), (got[k] for k in "abcd"), strict=True))


def test_metrics_and_columns(spark):
    d = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), ("z", "x")], "t string, p string")
    m = {r["class"]: (r.precision, r.recall) for r in mleval.class_metrics(d, "t", "p").collect()}
    assert m == {"x": (0.5, 0.5), "y": (0.5, 1.0), "z": (0.0, 0.0)}
    one = spark.createDataFrame([(1920, 1080, 0x34363248, 75.26)], "w int, h int, code long, t double")
    assert one.select(columns.aspect_label("w", "h"), columns.orientation("w", "h"), columns.fourcc("code"), columns.clock("t")).first()[:] == ("16:9", "landscape", "H264", "01:15.3")


def test_settings():
    assert config.from_env(config.RiskSettings(), env={"EVENTLOOM_CAUTION": "25"}).caution == 25.0
    for wrong in ({"EVENTLOOM_CAUTION": "x"}, {"EVENTLOOM_CAUTION": "80"}):
        with pytest.raises(ValueError):
            config.from_env(config.RiskSettings(), env=wrong)


def test_sources(spark, tmp_path):
    (tmp_path / "gps.csv").write_text("timestamp,lat,lon,accuracy_m\n1.0,10.0,20.0,\n2.0,99.0,0.0,3\n")
    assert rows_of(readers.read_gps(spark, f"{tmp_path}/gps.csv", "LOG"), "timestamp", "accuracy_m", "source") == [(1.0, None, "LOG")]
    for p in ("cam/Front/on/a.jpg", "cam/Front/on/driver/b.jpg", ".x/front/c.jpg", "driver/d.mp4"):
        (tmp_path / "t" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / p).write_bytes(p.encode())
    f = readers.list_files(spark, f"{tmp_path}/t")
    assert sorted(rows_of(readers.camera_folders(f, ["front", "driver"]), "camera", "folder")) == [("driver", "driver"), ("front", "cam/Front")]
    assert readers.read_strict(spark, f"{tmp_path}/no.jsonl", schemas.EVENT_SCHEMA).count() == 0


# ---------------------------------------------------------------- streaming


def test_summary_text(spark, events):
    text = stats.summary_text(events)
    assert text.startswith("8 events in 3 session(s).") and "pedestrian hazards (3 in 1 session(s))" in text
    assert stats.summary_text(events, lambda p: 1 / 0) == text and stats.summary_text(events, lambda p: "worded") == "worded"
    assert stats.summary_text(events.limit(0)) == "No events were recorded."
    assert stats.without_preroll(spark.createDataFrame([(-1.0,), (0.0,)], "t double"), "t").count() == 1
