"""The driver's pipeline, detection rules, positions and class folders on small fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from eventloom.config import DriverSettings
from eventloom.operators import files, perception

OBS = "s string, i int, t double, face_status string, left_open double, right_open double, yaw double, pitch double, hand_state string, hand_activity string"
S = ["s"]


def row(i, t, hand="BOTH_HANDS", face="OK", left=0.3, right=0.3, yaw=0.0, act=None, s="a"):
    return (s, i, float(t), face, left, right, yaw, 0.0, hand, act)


def states(spark, rows, **cfg):
    d = spark.createDataFrame(rows, OBS)
    return {(r.s, r.i): r for r in perception.driver_states(d, S, "i", "t", DriverSettings(**cfg)).collect()}


def test_longest_times_and_changes(spark):
    got = states(spark, [row(0, 0), row(1, 2, "ONE_HAND"), row(2, 5, "NO_HANDS"), row(3, 8), row(4, 9, "NO_HANDS"), row(5, 10, "NO_HANDS")])
    assert [got["a", i].longest_one_hand for i in range(6)] == [0, 0, 3, 3, 3, 3]
    assert [got["a", i].longest_no_hands for i in range(6)] == [0, 0, 0, 3, 3, 3]
    assert [got["a", i].state_changes for i in range(6)] == [0, 1, 2, 3, 4, 4]
    assert [got["a", i].state_seconds for i in range(6)] == [0, 0, 0, 0, 0, 1]


def test_distraction_runs_over_states_and_ends_at_unknown(spark):
    """Both hands at 0, none from 1 on, a phone from 3: at 6 five seconds of distraction, three of the phone."""
    got = states(spark, [row(0, 0), row(1, 1, "NO_HANDS"), row(2, 3, act="PHONE"), row(3, 6, act="PHONE"), row(4, 7, None), row(5, 8, "NO_HANDS"), row(6, 11, "NO_HANDS")])
    assert (got["a", 3].distraction_seconds, got["a", 3].state_seconds, got["a", 3].driver_activity) == (5.0, 3.0, "PHONE")
    assert (got["a", 4].manual_state, got["a", 4].driver_activity, got["a", 4].distraction_seconds) == ("UNKNOWN", "UNKNOWN", None)
    assert (got["a", 5].driver_activity, got["a", 5].distraction_seconds) == ("NORMAL", 0.0)
    assert (got["a", 6].driver_activity, got["a", 6].distraction_seconds) == ("HANDS_OFF_WHEEL", 3.0)


def test_a_step_back_starts_anew_and_says_so(spark):
    rows = [row(i, i * 0.1, left=0.1, right=0.1) for i in range(30)] + [row(30 + i, i * 0.1, left=0.1, right=0.1) for i in range(5)] + [row(0, 5, s="b")]
    got = states(spark, rows)
    assert [k for k, r in got.items() if r.timeline_reset] == [("a", 30)]
    assert abs(got["a", 29].closed_seconds - 2.9) < 1e-9 and got["a", 29].drowsiness_level == "CRITICAL"
    assert got["a", 30].closed_seconds == 0.0 and abs(got["a", 34].closed_seconds - 0.4) < 1e-9


def test_a_failed_provider_leaves_an_unknown_row(spark):
    rows = [row(0, 0.0), row(1, 0.1, None, face=None), row(2, 0.2, face="NO_FACE"), row(3, 0.3, left=None), row(4, 0.4, left=None, right=None, yaw=None)]
    got = states(spark, rows)
    assert [got["a", i].face_status for i in range(5)] == ["OK", "PROVIDER_ERROR", "NO_FACE", "OK", "OK"]
    assert [got["a", i].observation_quality for i in range(5)] == [1.0, 0.0, 0.0, 0.75, 0.25]
    assert (got["a", 1].hand_state, got["a", 1].driver_activity, got["a", 1].closed, got["a", 1].yaw) == ("UNKNOWN", "UNKNOWN", None, None)
    assert got["a", 3].mean_open == 0.3 and got["a", 3].closed is False and got["a", 4].closed is None
    assert abs(got["a", 2].missing_seconds - 0.2) < 1e-9 and got["a", 3].missing_seconds == 0.0
    assert perception.driver_states(spark.createDataFrame([], OBS), S, "i", "t").count() == 0


def test_detection_rules(spark):
    good = (1.0, "dog", 0, 0.5, 0.0, 0.0, 1.0, 1.0, "m")
    bad = [(float("inf"), *good[1:]), (1.0, " ", *good[2:]), (1.0, "dog", -1, *good[3:]), (1.0, "dog", None, *good[3:]), (*good[:3], 1.5, *good[4:]), (*good[:3], float("nan"), *good[4:]), (*good[:4], None, *good[5:]), (*good[:6], -1.0, *good[7:]), (*good[:8], "")]
    d = spark.createDataFrame([good, (None, *good[1:]), *bad], "ts double, class_name string, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double, source string")
    rules = perception.detection_problems()
    got = d.select(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])).alias("p")).collect()
    assert [r.p for r in got] == [[], [], ["timestamp"], ["class_name"], ["class_id"], ["class_id"], ["confidence"], ["confidence"], ["bbox: not finite"], ["bbox: order"], ["source"]]


def test_positions(spark):
    e = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 5.0), ("a", 3, 0.5), ("b", 4, 0.0)], "s string, i int, t double")
    log = spark.createDataFrame([("a", 0.0, 26.1878, 91.6916, 4.5), ("a", 1.0, 26.18785, 91.69171, None), ("a", 5.0, 99.0, 0.0, 1.0)], "s string, timestamp double, lat double, lon double, accuracy_m double")
    got = {r.i: (r.gps_lat, r.gps_timestamp, r.gps_accuracy_m, r.gps_source) for r in perception.with_position(e, log, S, "t", 0.5).collect()}
    assert got == {1: (26.18785, 1.0, None, "GPS_LOG"), 2: (None, None, None, "UNAVAILABLE"), 3: (26.1878, 0.0, 4.5, "GPS_LOG"), 4: (None, None, None, "UNAVAILABLE")}
    assert {r.gps_source for r in perception.with_position(e, None, S, "t").collect()} == {"UNAVAILABLE"}


def test_class_files(spark):
    rows = [("x/b/B.jpg", "b"), ("x/b/a.JPG", "b"), ("x/b/a.jpg", "b"), ("x/a/1.png", "a"), ("x/a/.hidden.jpg", "a"), ("x/a/Thumbs.db", "a"), ("x/a/n.txt", "a"), ("x/z/1.jpg", "z")]
    d = spark.createDataFrame(rows, "path string, label string")
    got = {r.path: (r.class_index, r.ignored, r.place) for r in files.class_files(d, ["b", "a"]).collect()}
    assert got == {"x/b/a.JPG": (0, False, 0), "x/b/a.jpg": (0, False, 1), "x/b/B.jpg": (0, False, 2), "x/a/1.png": (1, False, 3), "x/a/n.txt": (1, True, None)}
    with pytest.raises(ValueError, match="c"):
        files.class_files(d, ["b", "c"])
    assert [(r.label, r.class_index) for r in files.class_files(d, ["b", "c"], strict=False).filter("path IS NULL").collect()] == [("c", 1)]


def test_missing_files_and_shares(spark):
    named, found = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "path string"), spark.createDataFrame([("a",), ("c",)], "path string")
    assert [r.path for r in files.missing_files(named, found).collect()] == ["b"]
    t = files.cross_table(spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("y", 9)], "k string, v int"), "k", "v", [1, 2, 3])
    assert {r.k: (r.n_1, r.n_2, r.n_3, r.n, r.pct_1) for r in t.collect()} == {"x": (1, 1, 0, 2, 50.0), "y": (1, 0, 0, 2, 50.0), None: (2, 1, 0, 4, 50.0)}
