"""Pools, parents, early stops, layouts and helpers on small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import columns
from eventloom.operators import files, mleval, reference

FIELDS = "event_id string, run_id string, data_source string, camera string, hazard_class string, hazard_type string, image_width int, image_height int, bbox_area double, center_x double, drowsiness_level string, drowsiness_score double, hazard_confidence double, box_growth_per_second double, lateral_toward_center_fw_per_s double"


def event(i, run="r1", source="PUBLIC", camera="front", cls="car", kind="APPROACHING_VEHICLE", w=100, area=100.0, level=None, score=None):
    return (i, run, source, camera, cls, kind, w, 100, area, 50.0, level, score, 0.5, None, None)


def test_pools_ranges_and_parents(spark):
    rows = [event("a"), event("b", cls="person", area=10.0), event("c", run="r2"), event("d", source="SYNTHETIC", run="r0"), event("e", camera="driver", level="HIGH", score=0.9), event("f", w=0), event("g", cls=""), event("h", cls=None)]
    c = reference.pools(reference.first_run(spark.createDataFrame(rows, FIELDS)))
    assert sorted((r["pool"], r["event_id"]) for r in c.collect()) == [("drowsy", "e"), ("person_distant", "b"), ("vehicle", "a"), ("vehicle_presence", "a")]
    got = {(r["pool"], r["field"]): (r["n"], r["median"]) for r in reference.pool_ranges(c).collect()}
    assert got["vehicle", "area_fraction"] == (1, 0.01) and got["drowsy", "drowsiness_score"] == (1, 0.9) and ("vehicle", "box_growth_per_second") not in got
    linked = reference.linked(spark.createDataFrame([(1, "vehicle"), (2, "animal"), (3, None)], "i int, pool string"), "i", "pool", c, "1")
    assert sorted((r["i"], r["parent_event_id"]) for r in linked.collect()) == [(1, "a"), (2, None), (3, None)]
    assert {r["pool"]: (r["rows"], r["linked"], r["parents"]) for r in reference.coverage(linked, "pool").collect()}["vehicle"] == (1, 1, 1)
    present = reference.pools(spark.createDataFrame([event("a"), event("b", kind="ROAD_USER_PRESENT")], FIELDS))
    assert sorted((r["pool"], r["event_id"]) for r in present.collect()) == [("vehicle", "a"), ("vehicle_presence", "b")]
    assert reference.pools(present.drop("pool", "area_fraction", "center_x_norm").limit(0)).count() == 0


def test_early_stop(spark):
    e = spark.createDataFrame([(1, 0.5, 1.0), (2, 0.5, 0.9), (3, 0.5, 0.9), (4, 0.4, 0.1), (5, 0.9, 0.1)], "epoch int, f1 double, loss double").withColumn("run", F.lit(1))
    got = mleval.early_stopped(e, ["run"], "epoch", "f1", "loss", 2).orderBy("epoch").collect()
    assert [(r["epoch"], r["is_best"], r["since_best"]) for r in got] == [(1, True, 0), (2, True, 0), (3, False, 1), (4, False, 2)]
    assert mleval.early_stopped(e, ["run"], "epoch", "f1", "loss", 0).count() == 5


def test_layout_trace_and_columns(spark):
    found = spark.createDataFrame([("front", "car"), ("front", "car"), ("rear", "bus")], "camera string, label string")
    known = spark.createDataFrame([("x", "front", "car", 0), ("y", "front", "car", 1), ("y", "rear", "bus", 1), ("z", "rear", "bus", 2)], "layout string, camera string, label string, place int")
    assert files.layout_of(found, known, "d").head() == ("y", 2)
    assert files.layout_of(found, known.filter("layout <> 'y'"), "d").head() == ("x", 1)
    assert files.layout_of(found.limit(0), known, "d").head() == ("d", 0)
    lat, lon = reference.trace(F.lit(0.0), F.lit(10.0), F.lit(90.0), F.lit(111_320.0 / 8))
    one = spark.range(1).select(lat, lon, columns.frame_at(F.lit(0.5), F.lit(4)), columns.frame_at(F.lit(0.5), F.lit(0)), columns.iso_after("2026-01-01T00:00:00", F.lit(1.5))).head()
    assert tuple(one) == (0.0, 11.0, 2, None, "2026-01-01T00:00:01.500000")
