"""Synthetic scenarios: scripted objects and drivers, stepped at 10 Hz, run through the same operators.

Scripts are closed forms over ``sequence`` and ``explode``; noise is a seeded hash,
so a run repeats whatever the partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators import folds, ordered, risk, stats, tracker

WIDTH, HEIGHT, HZ = 1920.0, 1080.0, 10


@dataclass(frozen=True)
class Scenario:
    """An object's motion (box centre, size, growth and drift per step) and the driver's signals."""

    name: str
    label: str | None
    x: float = 960.0
    y: float = 700.0
    w: float = 200.0
    h: float = 150.0
    grow: float = 0.0
    drift: float = 0.0
    drowsiness: str = "LOW"
    activity: str = "NORMAL"
    expected: tuple = ("SAFE",)
    steps: int = 30


SCENARIOS = (
    Scenario("empty_road", None),
    Scenario("static_far_car", "car", 1400, 450, 80, 60),
    Scenario("approaching_car", "car", grow=0.08, expected=("HIGH",)),
    Scenario("pedestrian_to_centre", "person", 480, 750, 90, 260, drift=22, expected=("CAUTION",)),
    Scenario("pedestrian_far_side", "person", 1800, 500, 40, 110),
    Scenario("dog_central", "dog", 820, 900, 160, 110, drift=15, expected=("CAUTION",)),
    Scenario("drowsy_high", None, drowsiness="HIGH", expected=("CAUTION",)),
    Scenario("hands_off", None, activity="HANDS_OFF_WHEEL", expected=("CAUTION",)),
    Scenario("approach_hands_off", "car", grow=0.08, activity="HANDS_OFF_WHEEL", expected=("CRITICAL",)),
    Scenario("approach_drowsy", "car", grow=0.08, drowsiness="HIGH", expected=("CRITICAL",)),
    Scenario("pedestrian_hands_off", "person", 480, 750, 90, 260, drift=22, activity="HANDS_OFF_WHEEL", expected=("CRITICAL",)),
    Scenario("dog_hands_off", "dog", 820, 900, 160, 110, drift=15, activity="HANDS_OFF_WHEEL", expected=("CRITICAL",)),
)


def noise(seed: int, *cols: Column) -> Column:
    """Seeded noise in [-0.5, 0.5)."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 20)) / F.lit(float(1 << 20)) - 0.5


def steps(spark: SparkSession, specs=SCENARIOS, variants: int = 2, seed: int = 42, jitter: float = 0.0) -> DataFrame:
    """One row per step of every scenario and variant, with the object's box (null without an object)."""
    fields = [(s.name, s.label, s.x, s.y, s.w, s.h, s.grow, s.drift, s.drowsiness, s.activity, list(s.expected), s.steps) for s in [Scenario(**{**x.__dict__, **{k: float(getattr(x, k)) for k in ("x", "y", "w", "h", "grow", "drift")}}) for x in specs]]
    d = spark.createDataFrame(fields, "scenario string, class_name string, x double, y double, w double, h double, grow double, drift double, drowsiness_level string, driver_activity string, expected array<string>, n int")
    d = d.crossJoin(F.broadcast(spark.range(variants).withColumnRenamed("id", "variant"))) if variants > 1 else d.withColumn("variant", F.lit(0).cast("long"))
    d = d.withColumn("frame_index", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    d = d.withColumn("session_id", F.concat_ws("-", "scenario", "variant")).withColumn("ts", F.col("frame_index") / float(HZ))
    scale = 1 + F.col("grow") * F.col("frame_index")
    shake = lambda k: jitter * noise(seed + k, F.col("session_id"), F.col("frame_index"))
    cx, cy = F.col("x") + F.col("drift") * F.col("frame_index") + shake(1), F.col("y") + shake(2)
    half_w, half_h = F.col("w") * scale / 2, F.col("h") * scale / 2
    box = {"x1": F.greatest(F.lit(0.0), cx - half_w), "y1": F.greatest(F.lit(0.0), cy - half_h), "x2": F.least(F.lit(WIDTH), cx + half_w), "y2": F.least(F.lit(HEIGHT), cy + half_h)}
    return d.withColumns({k: F.when(F.col("class_name").isNotNull(), v) for k, v in box.items()}).withColumn("confidence", F.lit(0.85)).withColumn("det_ix", F.lit(0)).drop("x", "y", "w", "h", "grow", "drift", "n")


def run(spark: SparkSession, specs=SCENARIOS, variants: int = 2, seed: int = 42, jitter: float = 0.0) -> DataFrame:
    """Scenario steps through tracking, scoring and smoothing: one row per step with its level."""
    s = steps(spark, specs, variants, seed, jitter)
    t = tracker.track(s).filter("not ended").withColumns({"width": F.lit(WIDTH), "height": F.lit(HEIGHT)})
    seen = risk.motion_features(t.filter("active"), ["session_id", "track_id"]).select("session_id", "track_id", "last_seen", "growth", "lateral")
    h = risk.track_hazards(t.join(seen, ["session_id", "track_id", "last_seen"], "left").withColumn("confidence", F.col("mean_confidence")))
    p = risk.frame_hazards(h, ["session_id", "ts"])
    f = s.select("session_id", "scenario", "expected", "ts", "drowsiness_level", "driver_activity").join(p, ["session_id", "ts"], "left")
    f = f.withColumns({"head_away_seconds": F.lit(0.0), "driver_age": F.lit(0.0), "observation_quality": F.lit(1.0)})
    a = risk.assess(f).select("session_id", "scenario", "expected", "ts", "raw_rank", "raw_score", "hazard", "reason", "factors", "gates")
    return folds.hysteresis(a, ["session_id"], ["ts"], "ts", "raw_rank")


def verdicts(rows: DataFrame) -> DataFrame:
    """Peak and final level of each instance and whether the peak is one that was expected."""
    from eventloom.functions.columns import level_name

    d = stats.peak(rows.withColumn("level", level_name("level")), ["session_id", "scenario", "expected"], "level", "ts")
    last = rows.groupBy("session_id").agg(F.round(F.max_by("raw_score", "ts"), 6).alias("final_score"), F.max_by("hazard", "ts").alias("final_hazard"))
    return d.join(last, "session_id").withColumn("met", F.array_contains("expected", F.col("peak"))).select("session_id", "scenario", "peak", "final_level", "final_score", "final_hazard", "met")


def presence(rows: DataFrame) -> DataFrame:
    """Steps of each instance at or above a level, by level."""
    return rows.groupBy("scenario").pivot("level", [0, 1, 2, 3]).count().fillna(0)


def episodes_of(rows: DataFrame) -> DataFrame:
    from eventloom.functions.columns import level_name

    return ordered.level_transitions(rows.withColumn("level", level_name("level")), ["session_id"], ["ts"], "level")
