"""Driver-state features: eye closure windows, drowsiness, activity, observation quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.config import DriverSettings
from eventloom.functions.columns import col
from eventloom.operators.folds import marked_closures
from eventloom.operators.ordered import islands, ordered, run_duration, trailing, trailing_ratio


def eye_features(df: DataFrame, keys: list[str], order: list[str], t: str, closed: str, s: DriverSettings = DriverSettings()) -> DataFrame:
    """Windowed closure features of each row: ratio, closed and missing time, blinks and long closures.

    ``closed`` is true, false or null (not observed).
    """
    w = ordered(keys, order)
    d = marked_closures(df, keys, order, t, closed, s.max_gap, s.blink, s.long).withColumnRenamed("kind", "_kind").drop("duration")
    d = trailing_ratio(d, keys, order, t, closed, s.window, s.max_gap)
    d = d.withColumn("blinks", trailing("count_if(_kind = 'blink')", keys, t, s.window)).withColumn("long_closures", trailing("count_if(_kind = 'long')", keys, t, s.window))
    # A run of closed rows: unknown rows neither extend nor end it, a gap in observation does.
    seen = F.last(F.when(F.col(closed).isNotNull(), F.col(t)), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    state = F.last(closed, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col(closed) & (F.coalesce(~state, F.lit(True)) | (F.col(t) - seen > s.max_gap))
    d = d.withColumn("_seen", seen)
    d = islands(d, keys, order, F.coalesce(fresh, F.lit(False)), "_run")
    began = F.min(F.when(F.col(closed), F.col(t))).over(Window.partitionBy(*keys, "_run"))
    first = F.min(t).over(Window.partitionBy(*keys))
    return d.withColumns(
        {
            "closed_seconds": F.when(F.col(closed), F.col(t) - began).when(~F.col(closed), 0.0), "missing_seconds": F.when(F.col(closed).isNull(), F.col(t) - F.coalesce("_seen", first)).otherwise(0.0),
            "closure_ratio": F.when(F.col("observed_seconds") > 0, F.round(F.col("positive_seconds") / F.col("observed_seconds"), 4)),
        }
    ).drop("_kind", "_seen", "_run")


def drowsiness(ratio, closed_seconds, long_closures, observed, s: DriverSettings = DriverSettings()) -> tuple[Column, Column]:
    """(score, level): the larger of the present closure and the window's share; UNKNOWN without enough evidence."""
    now = F.least(F.lit(1.0), F.coalesce(col(closed_seconds), F.lit(0.0)) / s.sustained)
    part = s.ratio_weight * F.least(F.lit(1.0), col(ratio) / s.ratio_max) + (1 - s.ratio_weight) * F.least(F.lit(1.0), col(long_closures) / float(s.long_max))
    window = F.when((col(observed) >= s.min_observed) & col(ratio).isNotNull(), part)
    score = F.round(F.when(window.isNotNull(), F.greatest(now, window)).when(now > 0, now), 4)
    level = F.when(score.isNull(), "UNKNOWN").when(score >= s.critical, "CRITICAL").when(score >= s.high, "HIGH").when(window.isNull(), "UNKNOWN").otherwise("LOW")
    return score, level


def hand_label(activity, hand) -> Column:
    """An observed distracting activity wins over the hand state."""
    return F.when(col(activity).isin("PHONE", "OTHER_MANUAL_DISTRACTION"), col(activity)).otherwise(col(hand))


def activity(observed, hand, seconds, s: DriverSettings = DriverSettings()) -> Column:
    """Inferred activity; hands off only after ``no_hands`` seconds in that state."""
    off = (col(hand) == "NO_HANDS") & (F.coalesce(col(seconds), F.lit(0.0)) >= s.no_hands)
    return F.when(col(observed).isin("PHONE", "OTHER_MANUAL_DISTRACTION"), col(observed)).when(col(hand) == "UNKNOWN", "UNKNOWN").when(off, "HANDS_OFF_WHEEL").otherwise("NORMAL")


def observation_quality(*available) -> Column:
    """Share of the signals that are there."""
    return sum((F.coalesce(col(a), F.lit(False)).cast("int") for a in available), F.lit(0)) / F.lit(float(len(available)))


def distraction_seconds(df: DataFrame, keys: list[str], order: list[str], t: str, state: str, distracting: list[str]) -> DataFrame:
    """Unbroken time in any distracting state; 0 outside, null while the state is unknown."""
    return run_duration(df, keys, order, t, F.upper(F.col(state)).isin(*distracting), F.col(state).isNull() | (F.upper(F.col(state)) == "UNKNOWN"), "distraction_seconds")
