"""Scores, slopes and orders that lie exactly on a threshold or a tie."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import geometry, ordered, risk
from eventloom.streaming.sessions import slope

FACTOR = "array<struct<name:string,points:double,source:string,detail:string,track_id:bigint>>"
FRAME = f"frame int, n_qualifying int, p_track_id long, p_class_name string, p_hazard_type string, p_qualifies boolean, p_points double, p_quality double, p_factors {FACTOR}, p_groups array<string>, p_phrases array<string>"


def test_a_capped_track_and_a_driver_reach_the_level_of_their_sum(spark):
    """20 points of a capped track and 25 of the driver are 45, though the factors add up to 44.99999999999999."""
    factors = [("f", x, "road", "", 1) for x in (4.041, 5.963, 5.596, 15.0, -10.600000000000001)]
    frames = spark.createDataFrame([(1, 0, 1, "dog", "ROAD_USER_PRESENT", False, 20.0, 1.0, factors, [], ["seen"])], FRAME)
    frames = frames.withColumns({"drowsiness_level": F.lit("LOW"), "driver_activity": F.lit("HANDS_OFF_WHEEL"), "head_away_seconds": F.lit(0.0), "driver_age": F.lit(0.2), "observation_quality": F.lit(1.0)})
    r = risk.assess(frames).head()
    assert r.raw_score == 45.0 and r.gates == [risk.GATE_HIGH] and r.raw_rank == 1
    assert "score_clamp" not in [f.name for f in r.factors] and abs(sum(f.points for f in r.factors) - 45.0) < 1e-9
    counts = {(c.category, c.key): c.n for c in risk.risk_counts(risk.assess(frames)).collect()}
    assert counts["gate", risk.GATE_HIGH] == 1


#: A track whose sideways slope is a twentieth of a frame a second, no more and no less, as SQL adds it up.
EDGE = [(0.1 * f, x / 550.0) for f, x in ((22, 88.5), (24, 102.0), (29, 74.0))]


def test_a_slope_on_the_threshold_counts(spark):
    rows = [(1, 0.1 * f, x / 550.0) for f, x in ((5, 117.0), (7, 118.0), (12, 104.5), (15, 89.0), (22, 88.5), (24, 102.0), (29, 74.0))] + [(2, t, None) for t in (0.0, 0.3, 0.6)]
    d = ordered.trailing_slope(spark.createDataFrame(rows, "k int, t double, y double"), ["k"], "t", {"slope": "y"}, 1.0, 3, 0.3)
    got = {(r.k, round(r.t, 1)): r.slope for r in d.collect()}
    assert got[1, 2.9] == -0.05 and got[1, 0.5] is None and got[2, 0.6] == 0.0


def test_the_stream_has_the_slope_of_the_batch():
    assert slope(EDGE) == -0.05 and slope([(1.0, 2.0)]) == 0.0 and slope([(1.0, 2.0), (1.0, 3.0)]) == 0.0


def test_equal_boxes_are_numbered_alike_in_every_run(spark):
    rows = [(1, i, "dog", 0.5, 0.0, 0.0, 400.0 + i, 10.0) for i in range(40)]
    told = []
    for order in (rows, rows[::-1], rows[20:] + rows[:20]):
        d = spark.createDataFrame(order, "f int, i int, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double").coalesce(1)
        told.append(sorted((r.i, r.det_ix) for r in geometry.clean_detections(d, ["f"], None, 0.35, 300.0, 250.0, ("i",)).collect()))
    assert told[0] == told[1] == told[2] == [(i, i) for i in range(40)]


#: Tracks on the threshold whose slope, with every product rounded, ends on the other side of it: (frames, centres, regr_slope of the SQL).
BESIDE = [((24, 26, 28), (169.5, 162.0, 180.5), 0.049999999999999996), ((14, 17, 20), (468.5, 494.5, 485.0), 0.05), ((24, 26, 28), (153.5, 134.5, 142.5), -0.049999999999999996), ((15, 19, 24), (108.0, 79.5, 82.0), -0.05)]


def test_slopes_on_the_threshold_fall_as_in_sql(spark):
    import duckdb

    points = [[(0.1 * f, x / 550.0) for f, x in zip(fs, xs, strict=True)] for fs, xs, _ in BESIDE]
    rows = [(k, *p) for k, ps in enumerate(points) for p in ps]
    d = ordered.trailing_slope(spark.createDataFrame(rows, "k int, t double, y double"), ["k"], "t", {"slope": "y"}, 1.0, 3, 0.3)
    got = {r.k: r.slope for r in d.collect() if r.slope is not None}
    sql = [duckdb.execute("SELECT regr_slope(y, t) FROM (SELECT unnest(?::DOUBLE[]) AS t, unnest(?::DOUBLE[]) AS y)", [list(c) for c in zip(*ps, strict=True)]).fetchone()[0] for ps in points]
    assert [got[k] for k in range(len(BESIDE))] == [slope(ps) for ps in points] == sql == [want for *_, want in BESIDE]


def test_a_fused_product_and_sum_is_rounded_once(spark):
    import math
    import random

    from eventloom.functions.columns import fused

    r = random.Random(7)
    rows = [tuple(r.uniform(-1, 1) * 10.0 ** r.randrange(-6, 3) for _ in "abc") for _ in range(2000)] + [(0.1, 0.1, -0.01), (1e-9, 3.0, 1.0), (0.0, 2.0, 5.0)]
    d = spark.createDataFrame(rows, "a double, b double, c double").select("a", "b", "c", fused(*map(F.col, "abc")).alias("x"))
    assert all(x.x == math.fma(x.a, x.b, x.c) for x in d.collect())
