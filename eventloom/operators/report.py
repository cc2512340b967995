"""The report of an event table: readable entries, statistics in long form, a Markdown summary and its files.

Only totals reach the driver.  Entries, and the events behind each recommendation,
are tables of any size and are written as such.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.config import LEVELS
from eventloom.functions.columns import fixed, or_else
from eventloom.operators import audit
from eventloom.operators.ordered import elevated_episodes
from eventloom.operators.risk import optional
from eventloom.operators.stats import advice_text, aggregate_recommendations, by_level, describe_patterns, event_overview, find_patterns, five_by, is_significant, long_counts, real_positions, recommendation, summary_text, time_bins, tri_state
from eventloom.sources.storage import stored
from eventloom.sources.writers import markdown_table, write_long, write_text

#: What stands for a missing path, and the label of a persistent hazard's reason.
NO_EVIDENCE = "none recorded"
PERSISTENT_REASON = "Reason (engine's overall assessment at this time)"
NOTE = "Safety-oriented review suggestions derived from recorded events; not medical diagnoses and not claims of fault."


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def event_entries(e: DataFrame, prefix: str = "") -> DataFrame:
    """One readable entry per event; null and empty texts read "not recorded"."""
    driver = F.col("event_type") == "DRIVER_STATE_CHANGE"
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    level = F.concat(or_else("risk_level"), _or_empty(F.concat(F.lit(" (score "), fixed("smoothed_risk_score", 1), F.lit(")"))), _or_empty(F.concat(F.lit(", "), given("transition"))))
    hazard = F.concat(or_else("hazard_type"), _or_empty(F.concat(F.lit(" ("), given("hazard_class"), F.lit(")"))))
    changed = F.concat(F.coalesce("change_kind", F.lit("None")), F.lit(" changed "), F.coalesce("transition", F.lit("None")), F.lit(" (held for the configured observations)"))
    time = F.concat(fixed("timestamp", 2), F.lit(" s into "), F.coalesce(given("source_file"), or_else("session_id")))
    key = recommendation()
    return e.select(
        "event_id", "run_id", "event_type", or_else(time).alias("time"), or_else("camera").alias("camera"), F.when(driver, F.coalesce("risk_level", F.lit("not recorded"))).otherwise(level).alias("risk"),
        F.when(driver, F.concat(or_else("change_kind"), F.lit(": "), or_else("transition"))).otherwise(hazard).alias("hazard"), F.when(driver, F.coalesce(given("risk_reason"), changed)).otherwise(or_else("risk_reason")).alias("reason"),
        F.coalesce(F.concat(F.lit(prefix), given("evidence_path")), F.lit(NO_EVIDENCE)).alias("evidence_path"), key.alias("recommendation_key"), advice_text(key).alias("recommendation"), or_else("observation_type").alias("observation_type"),
        or_else("data_source").alias("data_source"),
    )


def entry_lines(entries: DataFrame) -> DataFrame:
    """Each entry as a Markdown block."""
    label = F.when(F.col("event_type") == "PERSISTENT_HAZARD", PERSISTENT_REASON).otherwise("Reason")
    row = lambda name, c: F.concat(F.lit("\n- **"), name if isinstance(name, Column) else F.lit(name), F.lit(":** "), c)
    head = F.concat(F.lit("**"), "event_id", F.lit("** ("), "event_type", F.lit(", "), "observation_type", F.lit("):"))
    path = F.concat(F.lit("`"), "evidence_path", F.lit("`"))
    return entries.select(F.concat(head, *[row(n, F.col(c)) for n, c in (("Time", "time"), ("Camera", "camera"), ("Risk", "risk"), ("Hazard", "hazard"))], row(label, F.col("reason")), row("Evidence", path), row("Recommended review/action", F.col("recommendation")), F.lit("\n")).alias("value"))


def recommended_events(e: DataFrame) -> DataFrame:
    """(key, event_id, recommendation, informational): the events behind each recommendation, one row an event."""
    from eventloom.operators.stats import INFORMATIONAL

    key = recommendation()
    return e.select(key.alias("key"), "event_id", advice_text(key).alias("recommendation"), key.isin(*INFORMATIONAL).alias("informational"))


def _numbers(row: DataFrame, category: str) -> DataFrame:
    """(category, key, value) of a one-row table of numbers; nulls have no row."""
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in row.columns])
    return row.select(F.lit(category).alias("category"), F.inline(pairs)).filter("value is not null")


def _figures(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(category, key, value) of the five figures of columns."""
    pairs = F.array(*[F.struct(F.lit(k).alias("category"), F.col(c).cast("double").alias("x")) for k, c in columns.items()])
    f = five_by(df.select(F.inline(pairs)), ["category"], "x")
    return f.select("category", F.inline(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in ("n", "mean", "median", "max", "min")])))


def statistics(e: DataFrame, scope: str = "REAL") -> DataFrame:
    """(scope, category, key, value): every count and figure of the report in long form; the events are worked out once, into the shared folder."""
    e = stored(e, "events")
    return _statistics(e, scope)


def _statistics(e: DataFrame, scope: str = "REAL") -> DataFrame:
    sessions = F.countDistinct(F.struct(F.coalesce("run_id", F.lit("None")), F.coalesce(F.col("session_id").cast("string"), F.lit("None"))))
    change = F.when(F.col("event_type") == "DRIVER_STATE_CHANGE", F.concat_ws(": ", "change_kind", "transition"))
    level_change = F.when(F.col("event_type").isin("RISK_ESCALATED", "RISK_DEESCALATED"), F.col("transition"))
    kinds = {"events_by_type": F.col("event_type"), "events_by_camera": or_else("camera"), "events_by_hazard_type": or_else("hazard_type"), "risk_transitions": level_change, "alarm_recommended": tri_state("alarm_recommended"), "driver_state_events": change}
    counts = long_counts(e, kinds).select("category", "key", F.col("n").cast("double").alias("value"))
    lv = by_level(e)
    total = e.agg(F.count("*").alias("events"), sessions.alias("sessions"))
    ep = elevated_episodes(e, ["run_id", "session_id"], tie=["event_id"])
    closed = F.col("end").isNotNull()
    spans = ep.agg(F.count("*").alias("count"), F.count_if(closed).alias("closed"), F.count_if(~closed).alias("open_at_end_of_clip"))
    parts = [
        _numbers(total, "total"), counts, _numbers(lv.select(*[F.col(x.lower()).alias(x) for x in LEVELS]), "events_by_risk_level"),
        _numbers(e.agg(F.count_if(F.col("event_type") == "PERSISTENT_HAZARD").alias("count")), "persistent_hazards"),
        _figures(e, {c: c for c in ("smoothed_risk_score", "raw_risk_score")}),
        _numbers(spans, "elevated_risk_episodes"), _figures(ep.filter(closed), {"elevated_risk_episode_seconds": "duration_seconds"}),
        find_patterns(e).select(F.lit("pattern_events"), F.col("label"), F.col("events").cast("double")),
        aggregate_recommendations(e).select(F.lit("recommendation_events"), F.col("key"), F.col("events").cast("double")),
    ]
    if "gps_source" in e.columns:
        parts.append(_numbers(real_positions(e).agg(F.count("*").alias("real_gps_points")), "gps"))
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out.select(F.lit(scope).alias("scope"), "category", "key", "value")


def event_totals(e: DataFrame, order: str = "ordinal") -> DataFrame:
    """(category, key, n, place): every counter of the summary, in one pass; most frequent first, of equals the one seen first.

    Levels are there with zeros.  ``order`` tells how events follow each other.
    """
    at = lambda kind, c: F.when(F.col("event_type") == kind, c)
    level_change = F.when(F.col("event_type").isin("RISK_ESCALATED", "RISK_DEESCALATED"), F.nullif("transition", F.lit("")))
    own = lambda c: optional(e, c, "string")
    said = lambda c: F.coalesce(F.nullif(own(c).cast("string"), F.lit("")), F.lit("not recorded"))
    kinds = {
        "events_by_type": F.coalesce("event_type", F.lit("None")), "events_by_camera": said("camera"), "events_by_risk_level": F.col("risk_level"), "events_by_hazard_type": said("hazard_type"), "events_by_hazard_class": F.nullif(own("hazard_class"), F.lit("")), "risk_transitions": level_change,
        "alarm_recommended": tri_state("alarm_recommended"), "persistent_by_hazard_type": at("PERSISTENT_HAZARD", said("hazard_type")), "persistent_by_risk_level": at("PERSISTENT_HAZARD", said("risk_level")),
        "driver_by_change_kind": at("DRIVER_STATE_CHANGE", said("change_kind")), "driver_by_transition": at("DRIVER_STATE_CHANGE", F.concat_ws(": ", F.coalesce(own("change_kind"), F.lit("None")), F.coalesce("transition", F.lit("None")))),
        "data_sources": F.coalesce(own("data_source"), F.lit("None")), "observation_types": said("observation_type"), "evidence_kinds": said("evidence_kind"),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("category"), v.cast("string").alias("key")) for k, v in kinds.items()])
    got = e.select(F.col(order).alias("o"), F.inline(pairs)).filter("key IS NOT NULL").groupBy("category", "key").agg(F.count("*").alias("n"), F.min("o").alias("first"))
    none = e.sparkSession.createDataFrame([("events_by_risk_level", x) for x in LEVELS], "category string, key string")
    got = got.unionByName(none.join(got, ["category", "key"], "left_anti").withColumns({"n": F.lit(0).cast("long"), "first": F.lit(None).cast(got.schema["first"].dataType)}))
    # Per category as many rows as it has values.
    w = Window.partitionBy("category").orderBy(F.desc("n"), F.asc_nulls_last("first"), "key")
    return got.select("category", "key", "n", F.row_number().over(w).alias("place"))


def render(e: DataFrame, figures: DataFrame | None = None) -> str:
    """The summary as Markdown, from totals alone."""
    o = event_overview(e).first()
    out = ["# Post-event safety summary", "", "## 1. Event summary", ""]
    if not o["total_events"]:
        return "\n".join([*out, "No events found.", ""])
    out += [f"- Total events: {o['total_events']} (runs {', '.join(o['runs'])}; {o['sessions']} sessions).", f"- Persistent hazards: {o['persistent']}.", f"- Driver-state events: {o['driver_changes']}.", "", markdown_table((_statistics(e) if figures is None else figures).orderBy("category", "key").drop("scope")), ""]
    out += ["## 2. Hazard patterns (descriptive)", "", *[f"- {r['text']}" for r in describe_patterns(find_patterns(e)).orderBy("pattern").collect()], ""]
    busiest = time_bins(e, "timestamp").groupBy("lo").agg(F.sum("n").alias("events")).orderBy(F.desc("events"), "lo")
    out += ["## 3. Busiest stream-time bins", "", markdown_table(busiest, limit=20), ""]
    advice = aggregate_recommendations(e).select(advice_text(F.col("key")).alias("recommendation"), "events", F.when(F.col("informational"), "informational").otherwise("review").alias("type"))
    out += ["## 4. Recommendations", "", f"_{NOTE}_", "", markdown_table(advice), "", "## 5. Summary", "", summary_text(e), ""]
    return "\n".join(out)


def write_report(e: DataFrame, folder: str, prefix: str = "") -> dict[str, str]:
    """Writes the summary (Markdown, JSON), the statistics (CSV), the significant entries (Markdown, JSON lines) and the events of each recommendation."""
    spark = e.sparkSession
    paths = {k: f"{folder.rstrip('/')}/{k}" for k in ("summary_md", "summary_json", "statistics_csv", "entries_md", "entries_json", "recommended_events")}
    # Worked out once for all files.
    e = stored(e, "events")
    stats = _statistics(e)
    stats.coalesce(1).write.mode("overwrite").option("header", True).csv(paths["statistics_csv"])
    figures = spark.read.schema(stats.schema).option("header", True).csv(paths["statistics_csv"])
    write_text(spark, render(e, figures), paths["summary_md"])
    values = [r.asDict() for r in figures.orderBy("category", "key").collect()]
    write_text(spark, json.dumps({"statistics": values, "patterns": [r.asDict() for r in find_patterns(e).collect()], "recommendations": [r.asDict() for r in aggregate_recommendations(e).collect()], "note": NOTE}), paths["summary_json"])
    entries = event_entries(e.filter(is_significant()), prefix)
    entries.write.mode("overwrite").option("ignoreNullFields", False).json(paths["entries_json"])
    entry_lines(entries).write.mode("overwrite").text(paths["entries_md"])
    recommended_events(e).write.mode("overwrite").partitionBy("key").parquet(paths["recommended_events"])
    return paths


def write_audit(files: DataFrame, expected: DataFrame, folder: str) -> dict[str, str]:
    """Writes an audit: counts of every folder, shares and figures as CSV, and the issues as Markdown and JSON.

    The listing is worked out once; only issues and totals reach the driver.
    """
    spark, f = files.sparkSession, stored(files, "listing")
    paths = {k: f"{folder.rstrip('/')}/{k}" for k in ("folders_csv", "shares_csv", "numbers_csv", "issues_md", "issues_json")}
    named = lambda kind, d: d.select(F.lit(kind).alias("kind"), "*")
    write_long(audit.folder_counts(f, ["camera", "label"]).orderBy(F.desc("level"), "camera", "label"), paths["folders_csv"])
    write_long(named("image", audit.image_shares(f)).unionByName(named("video", audit.video_shares(f))).orderBy("kind", "category", F.desc("n"), "first_seen"), paths["shares_csv"])
    write_long(named("image", audit.image_numbers(f)).unionByName(named("video", audit.video_numbers(f))).orderBy("kind", "name"), paths["numbers_csv"])
    issues = stored(audit.audit_issues(f, expected), "issues").orderBy("issue", "place")
    totals = {**audit.image_figures(f).first().asDict(), **{f"video_{k}": v for k, v in audit.video_figures(f).first().asDict().items()}, **audit.duplicate_figures(f).first().asDict()}
    write_text(spark, json.dumps({"totals": totals, "issues": [r.asDict() for r in issues.collect()]}), paths["issues_json"])
    lines = ["# Audit", "", *[f"- {k.replace('_', ' ')}: {'not recorded' if v is None else v}" for k, v in totals.items()], "", "## Issues", "", markdown_table(issues), "", "Labels are folder names; contents were not looked at.", ""]
    write_text(spark, "\n".join(lines), paths["issues_md"])
    return paths
