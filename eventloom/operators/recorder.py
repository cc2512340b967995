"""Events out of assessments: level changes, persistent hazards, driver-state changes, alerts, evidence windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.config import EPS, LEVELS, EventSettings
from eventloom.functions.columns import rank
from eventloom.operators.asof import band
from eventloom.operators.folds import cooldown, debounced
from eventloom.operators.ordered import level_transitions, numbered, presence_start

#: Severities and channels of alerts by level.
SEVERITY = {"SAFE": "INFO", "CAUTION": "LOW", "HIGH": "MEDIUM", "CRITICAL": "HIGH"}


def lookup(table: dict, key) -> Column:
    """A small dimension as a map literal."""
    c = F.col(key) if isinstance(key, str) else key
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def persistent_hazards(hazards: DataFrame, session: list[str], key: list[str], step: str, t: str, level: str, s: EventSettings = EventSettings()) -> DataFrame:
    """Hazards present without a break for ``persistent_seconds`` at ``persistent_level`` or above, thinned by the cooldown of their key.

    ``hazards``: one row per step and qualifying hazard, with dense step numbers.
    """
    d = presence_start(hazards, session, key, step, t).withColumn("hazard_persistence", F.col(t) - F.col("present_since"))
    least = LEVELS.index(s.persistent_level)
    due = d.filter((rank(level) >= least) & (F.col("hazard_persistence") + EPS >= s.persistent_seconds))
    return cooldown(due, [*session, *key], [t, step], t, s.hazard_cooldown).withColumn("event_type", F.lit("PERSISTENT_HAZARD"))


def driver_changes(rows: DataFrame, session: list[str], order: list[str], t: str, kinds: list[str], s: EventSettings = EventSettings()) -> DataFrame:
    """Debounced changes of several driver states, each (kind, from, to) thinned by its cooldown.

    The cooldown suppresses the event, never the change of state.
    """
    out = None
    for kind in kinds:
        c = debounced(rows, session, order, kind, s.change_observations)
        c = c.select(*session, *order, *([t] if t not in order else []), F.lit(kind).alias("change_kind"), "previous", F.col(kind).alias("value"))
        out = c if out is None else out.unionByName(c)
    kept = cooldown(out, [*session, "change_kind", "previous", "value"], order, t, s.change_cooldown)
    return kept.withColumn("transition", F.concat("previous", F.lit("->"), "value")).withColumn("event_type", F.lit("DRIVER_STATE_CHANGE"))


def hazard_age_at_change(changes: DataFrame, hazards: DataFrame, session: list[str], key: list[str], step: str, t: str) -> DataFrame:
    """Adds ``hazard_persistence``: how long the primary hazard of a level change had been present up to the step before."""
    p = presence_start(hazards, session, key, step, t).select(*session, *key, (F.col(step) + 1).alias(step), "present_since")
    return changes.join(p, [*session, *key, step], "left").withColumn("hazard_persistence", F.round(F.col(t) - F.col("present_since"), 4)).drop("present_since")


def alerts(levels: DataFrame, session: list[str], order: list[str], t: str, level: str = "level") -> DataFrame:
    """One alert per level change: id, direction, severity, channels, headline."""
    d = level_transitions(levels, session, order, level)
    d = d.withColumn("severity", lookup(SEVERITY, level)).withColumn("escalation", F.col("event_type") == "RISK_ESCALATED")
    loud = F.col("escalation") & (rank(level) >= 2)
    d = d.withColumn("channels", F.when(loud, F.array(F.lit("console"), F.lit("sound"))).otherwise(F.array(F.lit("console"))))
    d = d.withColumn("headline", F.concat(F.when(F.col("escalation"), "Risk up: ").otherwise("Risk down: "), "previous", F.lit(" to "), F.col(level)))
    return numbered(d, session, [t, *[c for c in order if c != t]], "alert_id", "alert_%04d")


def alert_summary(a: DataFrame) -> DataFrame:
    """Counts by severity, with zeros for the severities that did not occur."""
    cols = [F.count_if(F.col("severity") == x).alias(x.lower()) for x in dict.fromkeys(SEVERITY.values())]
    return a.agg(F.count("*").alias("alerts"), F.count_if("escalation").alias("escalations"), *cols, F.count_if(F.array_contains("channels", "sound")).alias("alarms"))


def replayed(events: DataFrame, t: str = "timestamp") -> DataFrame:
    """Alerts for recorded level events: always emitted, trusting the recorded previous level."""
    e = events.filter(F.col("event_type").isin("RISK_ESCALATED", "RISK_DEESCALATED") & rank("risk_level").isNotNull())
    return e.select("session_id", t, F.col("previous_risk_level").alias("previous"), F.col("risk_level").alias("level"), lookup(SEVERITY, "risk_level").alias("severity"), (rank("risk_level") > rank("previous_risk_level")).alias("escalation"))


def evidence_windows(events: DataFrame, frames: DataFrame, keys: list[str], event_id: str, et: str, ft: str, s: EventSettings = EventSettings()) -> DataFrame:
    """Frames around each event, and whether the stream ended before the window did."""
    last = frames.groupBy(*keys).agg(F.max(ft).alias("_last"))
    w = band(events.select(*keys, event_id, et), frames.select(*keys, ft), keys, et, ft, s.evidence_before, s.evidence_after)
    g = w.groupBy(*keys, event_id, et).agg(F.count("*").alias("frames"), F.min(ft).alias("from_t"), F.max(ft).alias("to_t"))
    return g.join(last, keys).withColumn("truncated", F.col("_last") < F.col(et) + s.evidence_after).drop("_last")


def with_event_ids(events: DataFrame, run: list[str], order: list[str]) -> DataFrame:
    return numbered(events, run, order, "event_id", "event_%06d")
