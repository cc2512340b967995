"""Driver states out of what the providers said of each frame: closures, drowsiness, hands, activity, quality, in one composition.

A step back in time begins another timeline: everything temporal starts anew and
the row says so.  A provider that failed leaves a row whose signals are unknown,
never a missing row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.config import DriverSettings
from eventloom.operators.asof import nearest
from eventloom.operators.driver import activity, drowsiness, eye_features, hand_label, observation_quality
from eventloom.operators.folds import timelines
from eventloom.operators.ordered import islands, ordered

#: Activities that distract, and hand states without distraction.
DISTRACTING = ("NO_HANDS", "PHONE", "OTHER_MANUAL_DISTRACTION")
DISTRACTION_ACTIVITIES = ("PHONE", "OTHER_MANUAL_DISTRACTION", "HANDS_OFF_WHEEL")


def measured(rows: DataFrame, s: DriverSettings = DriverSettings()) -> DataFrame:
    """Adds face_status (a failed provider's is PROVIDER_ERROR), mean_open and closed; without a face all its signals are null."""
    status = F.coalesce("face_status", F.lit("PROVIDER_ERROR"))
    seen = status == "OK"
    kept = {c: F.when(seen, F.col(c)) for c in ("left_open", "right_open", "yaw", "pitch")}
    d = rows.withColumns({"face_status": status, **kept})
    mean = F.when(F.col("left_open").isNotNull() & F.col("right_open").isNotNull(), (F.col("left_open") + F.col("right_open")) / 2).otherwise(F.coalesce("left_open", "right_open"))
    return d.withColumn("mean_open", mean).withColumn("closed", F.col("mean_open") < s.ear_closed)


def manual_runs(d: DataFrame, keys: list[str], order: list[str], t: str, state: str, longest: dict[str, str]) -> DataFrame:
    """Adds state_seconds, state_changes, distraction_seconds (null while unknown) and the longest time so far in named states.

    A run ends where the next one begins; the one in progress counts up to the row.
    """
    w = ordered(keys, order)
    fresh = ~F.col(state).eqNullSafe(F.lag(state).over(w)) | F.lag(t).over(w).isNull()
    d = islands(d, keys, order, fresh, "_run").withColumn("_began", F.min(t).over(Window.partitionBy(*keys, "_run")))
    d = d.withColumns({"_last_began": F.lag("_began").over(w), "_last_state": F.lag(state).over(w), "_fresh": F.coalesce(F.lag("_run").over(w) != F.col("_run"), F.lit(False))})
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    now = F.col(t) - F.col("_began")
    of = lambda x: F.greatest(F.when(F.col(state) == x, now), F.when(F.col("_fresh") & (F.col("_last_state") == x), F.col(t) - F.col("_last_began")), F.lit(0.0))
    away = F.col(state).isin(*DISTRACTING)
    d = d.withColumns({"state_seconds": now, "state_changes": F.sum(F.col("_fresh").cast("int")).over(so_far).cast("int"), **{name: F.max(of(x)).over(so_far) for name, x in longest.items()}})
    d = d.withColumn("_away", away)
    d = islands(d, keys, order, F.col("_away") & ~F.coalesce(F.lag("_away").over(w), F.lit(False)), "_turn")
    since = F.min(F.when(F.col("_away"), F.col(t))).over(Window.partitionBy(*keys, "_turn"))
    d = d.withColumn("distraction_seconds", F.when(F.col(state) == "UNKNOWN", None).when(F.col("_away"), F.col(t) - since).otherwise(0.0))
    return d.drop("_run", "_began", "_last_began", "_last_state", "_fresh", "_away", "_turn")


def driver_states(rows: DataFrame, session: list[str], index: str, t: str, s: DriverSettings = DriverSettings()) -> DataFrame:
    """The driver's state at every frame.

    ``rows``: session, ``index`` (the order in which frames came), ``t``, face_status,
    left_open, right_open, yaw, pitch, hand_state, hand_activity; what a provider could
    not say is null.
    """
    d = timelines(measured(rows, s), session, [index], t)
    keys, order = [*session, "timeline"], [t, index]
    first = F.col(index) == F.min(index).over(Window.partitionBy(*keys))
    d = d.withColumn("timeline_reset", first & (F.col("timeline") > F.min("timeline").over(Window.partitionBy(*session))))
    d = eye_features(d, keys, order, t, "closed", s)
    score, level = drowsiness("closure_ratio", "closed_seconds", "long_closures", "observed_seconds", s)
    d = d.withColumns({"drowsiness_score": score, "drowsiness_level": level, "hand_state": F.coalesce("hand_state", F.lit("UNKNOWN"))})
    d = d.withColumn("manual_state", hand_label("hand_activity", "hand_state"))
    d = manual_runs(d, keys, order, t, "manual_state", {"longest_one_hand": "ONE_HAND", "longest_no_hands": "NO_HANDS"})
    d = d.withColumn("driver_activity", activity("hand_activity", "hand_state", "state_seconds", s))
    d = d.withColumn("distraction_seconds", F.when(F.col("driver_activity").isin(*DISTRACTION_ACTIVITIES), F.col("distraction_seconds")).when(F.col("driver_activity") != "UNKNOWN", 0.0))
    there: list[Column] = [F.col("face_status") == "OK", F.col("yaw").isNotNull(), F.col("left_open").isNotNull(), F.col("right_open").isNotNull()]
    return d.withColumn("observation_quality", observation_quality(*there))


def detection_problems() -> dict[str, Column]:
    """Problem -> condition under which a detection has it."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    out = {"timestamp": F.col("ts").isNotNull() & ~finite("ts"), "class_name": F.trim(F.coalesce("class_name", F.lit(""))) == "", "class_id": F.coalesce(F.col("class_id") < 0, F.lit(True)), "confidence": ~F.coalesce(finite("confidence") & F.col("confidence").between(0.0, 1.0), F.lit(False))}
    corners = [F.coalesce(finite(c), F.lit(False)) for c in ("x1", "y1", "x2", "y2")]
    whole = corners[0] & corners[1] & corners[2] & corners[3]
    out |= {"bbox: not finite": ~whole, "bbox: order": whole & ((F.col("x2") < F.col("x1")) | (F.col("y2") < F.col("y1"))), "source": F.coalesce("source", F.lit("")) == ""}
    return out


def with_position(rows: DataFrame, fixes: DataFrame | None, keys: list[str], t: str, max_age: float = 2.0, source: str = "GPS_LOG") -> DataFrame:
    """Adds gps_lat, gps_lon, gps_timestamp, gps_accuracy_m and gps_source: the nearest fix within ``max_age``, else (or without a log) none and UNAVAILABLE.

    ``fixes``: keys, timestamp, lat, lon, accuracy_m.  Of two fixes as near the earlier one counts.
    """
    names = {"lat": "gps_lat", "lon": "gps_lon", "accuracy_m": "gps_accuracy_m"}
    if fixes is None:
        return rows.withColumns({**{c: F.lit(None).cast("double") for c in ("gps_lat", "gps_lon", "gps_timestamp", "gps_accuracy_m")}, "gps_source": F.lit("UNAVAILABLE")})
    f = fixes.filter((F.abs("lat") <= 90) & (F.abs("lon") <= 180)).select(*keys, F.col("timestamp").alias("gps_timestamp"), *[F.col(c).alias(n) for c, n in names.items()])
    d = nearest(rows, f, keys, t, "gps_timestamp", max_age, list(names.values()))
    return d.withColumn("gps_source", F.when(F.col("gps_timestamp").isNotNull(), source).otherwise("UNAVAILABLE"))
