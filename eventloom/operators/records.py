"""Event records out of assessments, events behind alerts, and what the peak of an instance looked like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.columns import fixed, rank
from eventloom.operators.risk import optional
from eventloom.operators.stats import peak
from eventloom.schemas import EVENT_SCHEMA, VERSION

#: Record column -> (column of the assessment, places); fixed values: places of the stored numbers.
NUMBERS = {
    "raw_risk_score": ("raw_score", 3), "smoothed_risk_score": ("smoothed_score", 3), "evidence_quality": ("evidence_quality", 4), "hazard_confidence": ("confidence", 4), "track_persistence_seconds": ("persistence", 4), "center_x": ("cx", 2), "center_y": ("cy", 2),
    "bbox_width": ("box_w", 2), "bbox_height": ("box_h", 2), "bbox_area": ("area", 1), "velocity_x_pixels_per_second": ("vx", 2), "velocity_y_pixels_per_second": ("vy", 2), "area_change_rate": ("area_rate", 1), "box_growth_per_second": ("growth", 4),
    "lateral_toward_center_fw_per_s": ("toward", 4), "driver_hand_confidence": ("hand_confidence", 4), "drowsiness_score": ("drowsiness_score", 4), "hazard_persistence": ("hazard_persistence", 4),
}
#: Record column -> column of the assessment, where the names differ.
NAMES = {
    "risk_level": "level", "hazard_type": "hazard", "primary_track_id": "primary_track", "risk_reason": "reason", "hazard_class": "observed_class", "hazard_track_class": "class_name", "hazard_class_changes": "label_changes", "track_detection_count": "detections",
    "driver_hand_state": "hand_state", "image_width": "width", "image_height": "height",
}


#: Places to which the stored form of each kind of row is rounded, by the columns' names here.
PLACES = {
    "track": {"confidence": 4, "mean_confidence": 4, **dict.fromkeys(("first_seen", "last_seen", "ts", "age", "missed", "persistence"), 3), **dict.fromkeys(("x1", "y1", "x2", "y2", "cx", "cy", "box_w", "box_h", "previous_cx", "previous_cy"), 2), **dict.fromkeys(("area", "previous_area", "vx", "vy", "speed", "area_rate"), 1), "relative_area_rate": 4},
    "hazard": {"points": 1, **dict.fromkeys(("growth", "toward", "x_norm", "bottom", "quality"), 3), "area_share": 4},
    "assessment": {"ts": 3, **dict.fromkeys(("raw_score", "smoothed_score", "driver_points", "road_points"), 1), "evidence_quality": 3},
    "detection": {"confidence": 4, **dict.fromkeys(("x1", "y1", "x2", "y2", "cx", "cy", "box_w", "box_h"), 2)},
    "alert": {"t": 3, "score": 1},
}


def rounded(df: DataFrame, kind: str) -> DataFrame:
    """Rows of a kind as they are stored: numbers to their places (half-even), factors' points to one place; the other columns as they are."""
    d = df.withColumns({c: F.bround(F.col(c).cast("double"), n) for c, n in PLACES[kind].items() if c in df.columns})
    if "factors" in df.columns:
        d = d.withColumn("factors", F.transform("factors", lambda f: f.withField("points", F.bround(f["points"], 1))))
    return d


def factors_json(factors: str) -> Column:
    """Factors as JSON, points to one place."""
    named = F.transform(factors, lambda f: F.struct(f["name"].alias("name"), F.bround(f["points"], 1).alias("points"), f["source"].alias("source"), f["detail"].alias("detail"), f["track_id"].alias("track_id")))
    return F.to_json(named, {"ignoreNullFields": "false"})


def event_records(rows: DataFrame, **fixed_values) -> DataFrame:
    """The 60 columns of the event table, one row for each event of ``rows``.

    ``rows`` carry what is known: the assessment, its track, the driver, a position.
    A column that is unknown is null; ``fixed_values`` hold for every row (run_id,
    camera, data_source, ...).  Numbers are rounded as the table stores them.
    """
    plain = {"schema_version": VERSION, "alarm_triggered": False, "evidence_kind": "NONE"} | fixed_values
    made = {c: F.lit(v) for c, v in plain.items()}
    made |= {c: F.bround(F.col(src).cast("double"), places) for c, (src, places) in NUMBERS.items() if src in rows.columns}
    made |= {c: F.col(src) for c, src in NAMES.items() if src in rows.columns}
    if "factors" in rows.columns:
        made["risk_factors"] = factors_json("factors")
    made |= {c: F.to_json(src) for c, src in (("risk_gates", "gates"), ("notes", "risk_notes")) if src in rows.columns}
    # No width or height is none at all.
    made |= {c: F.when(made[c] > 0, made[c]) for c in ("image_width", "image_height") if c in made}
    made["gps_source"] = F.when(optional(rows, "gps_lat", "double").isNotNull(), F.coalesce(optional(rows, "gps_source", "string"), F.lit("UNAVAILABLE"))).otherwise("UNAVAILABLE")
    return rows.select(*[made.get(f.name, optional(rows, f.name, "string")).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA])


def alert_events(alerts: DataFrame, events: DataFrame, keys: list[str], alert_t: str, event_t: str, event_id: str = "event_id") -> DataFrame:
    """Adds ``event_ids``: the events of the alert's own step, in order; empty where there are none."""
    at = events.groupBy(*keys, F.col(event_t).alias(alert_t)).agg(F.array_sort(F.collect_list(event_id)).alias("event_ids"))
    kind = at.schema["event_ids"].dataType.simpleString()
    return alerts.join(at, [*keys, alert_t], "left").withColumn("event_ids", F.coalesce("event_ids", F.array().cast(kind)))


def instance_summary(rows: DataFrame, keys: list[str], level: str, t: str, alarm: str, events: str) -> DataFrame:
    """Per instance: steps, duration, peak, first and final level, steps by level, steps with an alarm, events (a count a step)."""
    p = peak(rows, keys, level, t)
    return p.join(rows.groupBy(*keys).agg(F.count("*").alias("steps"), (F.max(t) - F.min(t)).alias("duration"), F.count_if(alarm).alias("alarms"), F.sum(events).alias("events")), keys)


def _short(x: Column) -> Column:
    """A signed number without trailing zeros."""
    return F.regexp_replace(fixed(x, 4, "+"), r"\.?0+$", "")


def peak_notes(rows: DataFrame, keys: list[str], t: str = "ts") -> DataFrame:
    """(note, above, first_above): the peak step of each instance in words, and the steps whose raw level was above the confirmed peak.

    ``rows``: level, raw_level, raw_score, hazard, factors (name, points), gates, reason of every step.
    """
    cols = ["level", "raw_level", "raw_score", "hazard", "factors", "gates", "reason", t]
    best = F.max_by(F.struct(*cols), F.struct(rank("level").alias("r"), "raw_score", (-F.col(t)).alias("t")))
    p = rows.groupBy(*keys).agg(best.alias("p"), F.max(t).alias("last"), F.max(rank("level")).alias("peak"))
    above = rows.select(*keys, t, rank("raw_level").alias("raw")).groupBy(*keys, "raw").agg(F.count("*").alias("n"), F.min(t).alias("since"))
    over = above.join(p.select(*keys, "peak"), keys).filter("raw > peak").groupBy(*keys).agg(F.sum("n").alias("above"), F.min("since").alias("first_above"))
    factors = F.array_join(F.transform("p.factors", lambda f: F.concat(f["name"], F.lit(" "), _short(f["points"]))), ", ")
    gates = F.when(F.size("p.gates") > 0, F.concat(F.lit(", gates ["), F.array_join("p.gates", "; "), F.lit("]"))).otherwise("")
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    note = text("At the peak step (t = ", fixed(f"p.{t}", 2), " s of ", fixed("last", 2), " s): level ", F.col("p.level"), " (raw level ", F.col("p.raw_level"), "), raw score ", fixed("p.raw_score", 1), ", hazard ", F.coalesce("p.hazard", F.lit("None")), ", factors [", factors, "]", gates, ".")
    return p.join(over, keys, "left").select(*keys, note.alias("note"), F.col("p.reason").alias("reason"), F.coalesce("above", F.lit(0)).alias("above"), "first_above")
