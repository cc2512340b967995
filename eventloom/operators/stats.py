"""Event-log analytics: counts, statistics, patterns, hotspots, recommendations, reports' tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from eventloom.config import LEVELS
from eventloom.functions.columns import finite, or_else, rank
from eventloom.operators.ordered import placed
from eventloom.sources.storage import stored

RISING, FALLING = "RISK_ESCALATED", "RISK_DEESCALATED"


def counted(df: DataFrame, key: Column, ordinal: str, where: Column | None = None) -> DataFrame:
    """Count per key, most first; equal counts in order of first appearance."""
    d = df if where is None else df.filter(where)
    return d.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(ordinal).alias("first_seen")).orderBy(F.desc("n"), "first_seen")


def tri_state(flag: str) -> Column:
    return F.when(F.col(flag), "true").when(~F.col(flag), "false").otherwise("not recorded")


def long_counts(df: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """Several counts in one pass: each row makes one (category, key) pair per kind, counted together."""
    pairs = F.array(*[F.struct(F.lit(k).alias("category"), v.cast("string").alias("key")) for k, v in kinds.items()])
    return df.select(F.explode(pairs).alias("p")).filter("p.key is not null").groupBy("p.category", "p.key").agg(F.count("*").alias("n"))


def by_level(df: DataFrame, level: str = "risk_level") -> DataFrame:
    """Counts over the fixed levels, zeros included, and rows without one."""
    return df.agg(*[F.count_if(F.col(level) == x).alias(x.lower()) for x in LEVELS], F.count_if(F.col(level).isNull()).alias("no_level"))


def five_of(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row: for each name n, mean, median, max, min of its column's finite values, all of them in one pass; null without a finite value."""
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), F.col(c).cast("double").alias("x")) for k, c in columns.items()])
    f = five_by(df.select(F.inline(pairs)), ["name"], "x")
    s = F.struct("n", "mean", "median", "max", "min")
    return f.agg(*[F.max(F.when(F.col("name") == k, s)).alias(k) for k in columns])


def event_overview(e: DataFrame) -> DataFrame:
    """One row of totals of an event table."""
    one = F.lit(0).alias("_one")
    totals = e.agg(
        F.count("*").alias("total_events"), *[F.count_if(F.col("risk_level") == x).alias(f"level_{x.lower()}") for x in LEVELS], F.count_if(F.col("risk_level").isNull()).alias("without_level"),
        F.count_if(F.col("alarm_recommended")).alias("alarm_true"), F.count_if(~F.col("alarm_recommended")).alias("alarm_false"), F.count_if("alarm_triggered").alias("alarm_triggered_true"),
        F.count_if(F.col("event_type") == "PERSISTENT_HAZARD").alias("persistent"), F.count_if(F.col("event_type") == "DRIVER_STATE_CHANGE").alias("driver_changes"),
        F.countDistinct(F.struct(F.coalesce("run_id", F.lit("None")), F.coalesce("session_id", F.lit("None")))).alias("sessions"), F.sort_array(F.collect_set(F.coalesce("run_id", F.lit("None")))).alias("runs"),
        F.count_if(F.coalesce(F.col("evidence_path") != "", F.lit(False))).alias("with_evidence"),
    )
    figures = five_of(e, {"smoothed": "smoothed_risk_score", "raw": "raw_risk_score", "hazard_persistence": "hazard_persistence", "track_persistence": "track_persistence_seconds"})
    # Both sides are one row.
    return totals.select(one, "*").join(figures.select(one, "*"), "_one").drop("_one")


def _hazard(name: str) -> Column:
    return (F.col("hazard_type") == name) & F.col("event_type").isin(RISING, "PERSISTENT_HAZARD")


def _rise(*levels: str) -> Column:
    return (F.col("event_type") == RISING) & F.col("risk_level").isin(*levels)


#: Named patterns: key -> (label, predicate).  Add entries to extend the report.
PATTERNS = {
    "pedestrian_hazard": ("Pedestrian hazards", lambda: _hazard("PEDESTRIAN_CONFLICT")),
    "approaching_vehicle_hazard": ("Approaching-vehicle hazards", lambda: _hazard("APPROACHING_VEHICLE")),
    "animal_hazard": ("Animal hazards", lambda: _hazard("ANIMAL_HAZARD")),
    "driver_state_change": ("Driver-state changes", lambda: F.col("event_type") == "DRIVER_STATE_CHANGE"),
    "risk_escalation": ("Risk escalations", lambda: _rise("CAUTION", "HIGH", "CRITICAL")),
    "high_or_critical_escalation": ("Escalations to HIGH or CRITICAL", lambda: _rise("HIGH", "CRITICAL")),
}


def find_patterns(e: DataFrame, patterns: dict | None = None, ids: bool = False) -> DataFrame:
    """Per pattern: events, sessions, sessions with two or more, most in one session, repeated; zero rows included."""
    patterns = PATTERNS if patterns is None else patterns
    tags = F.array_compact(F.array(*[F.when(p(), F.lit(k)) for k, (_, p) in patterns.items()]))
    tagged = e.select("session_id", "event_id", *(["ordinal"] if ids else []), F.explode(tags).alias("pattern"))
    more = [F.collect_list(F.struct("ordinal", "event_id")).alias("ids")] if ids else []
    per = tagged.groupBy("pattern", F.coalesce(F.col("session_id").cast("string"), F.lit("None")).alias("session")).agg(F.count("*").alias("n"), *more)
    lists = [F.transform(F.array_sort(F.flatten(F.collect_list("ids"))), lambda x: x["event_id"]).alias("event_ids")] if ids else []
    got = per.groupBy("pattern").agg(F.sum("n").alias("events"), F.count("*").alias("sessions"), F.count_if(F.col("n") >= 2).alias("sessions_with_repeats"), F.max("n").alias("max_in_one_session"), *lists)
    names = e.sparkSession.createDataFrame([(k, v[0]) for k, v in patterns.items()], "pattern string, label string")
    out = names.join(got, "pattern", "left").fillna(0, ["events", "sessions", "sessions_with_repeats", "max_in_one_session"])
    return out.withColumn("repeated", (F.col("sessions_with_repeats") > 0) | (F.col("sessions") >= 2))


def describe_patterns(p: DataFrame) -> DataFrame:
    """A neutral sentence for each pattern."""
    again = F.when(F.col("sessions_with_repeats") > 0, F.format_string("repeated within %d session(s), up to %d in one", "sessions_with_repeats", "max_in_one_session")).otherwise("no session had more than one")
    return p.select("pattern", F.when(F.col("events") == 0, F.concat("label", F.lit(": none recorded."))).otherwise(F.concat(F.format_string("%s: %d event(s) across %d session(s); ", "label", "events", "sessions"), again, F.lit("."))).alias("text"))


def real_positions(e: DataFrame) -> DataFrame:
    ok = F.col("gps_source").isNotNull() & ~F.col("gps_source").isin("UNAVAILABLE", "SYNTHETIC") & F.col("data_source").isin("LOCAL_REAL", "PUBLIC")
    return e.filter(ok & (F.abs("gps_lat") <= 90) & (F.abs("gps_lon") <= 180))


def grid_cells(e: DataFrame, lat: str, lon: str, ordinal: str, cell: float = 0.001, top: int = 20) -> DataFrame:
    """Fullest grid cells (half-even rounding); the limit is the report's own."""
    at = lambda c: F.rint(F.col(c) / cell)
    g = e.groupBy(at(lat).cast("long").alias("ix"), at(lon).cast("long").alias("iy")).agg(F.count("*").alias("events"), F.min(ordinal).alias("first_seen"))
    g = g.orderBy(F.desc("events"), "first_seen").limit(top)
    return g.select(F.round(F.col("ix") * cell, 6).alias("lat"), F.round(F.col("iy") * cell, 6).alias("lon"), "events")


def time_bins(e: DataFrame, t: str, width: float = 2.0, kind: str = "event_type") -> DataFrame:
    lo = F.floor(F.col(t) / width) * F.lit(float(width))
    return e.filter(F.col(t).isNotNull()).groupBy(lo.cast("double").alias("lo"), kind).agg(F.count("*").alias("n")).withColumn("hi", F.col("lo") + width)


#: Recommendation keys by hazard, their texts, and those that only inform.
HAZARD_ADVICE = {
    "PEDESTRIAN_CONFLICT": "pedestrian", "APPROACHING_VEHICLE": "vehicle", "ANIMAL_HAZARD": "animal", "DRIVER_DROWSINESS": "drowsiness", "HANDS_OFF_WHEEL": "hands_off", "DRIVER_HEAD_AWAY": "head_away",
    "COMBINED_DRIVER_HAZARD": "combined", "ROAD_USER_PRESENT": "road_user_present",
}
ADVICE = {
    "pedestrian": "Review pedestrian interaction and maintain additional visual attention in similar situations.",
    "vehicle": "Review following/approach context and maintain additional observation of closing traffic.",
    "animal": "Review the animal's position relative to the road and maintain additional attention and readiness to slow in similar situations.",
    "drowsiness": "Treat prolonged eye closure as a driver-attention warning; review rest/alertness before continued driving.",
    "hands_off": "Review the driving segment and maintain both hands on the steering wheel when appropriate.",
    "head_away": "Review the segment for sustained looking away from the road and keep attention on the road ahead.",
    "combined": "Review both the driver state and the road situation in this segment; the combination was rated higher than either alone.",
    "road_user_present": "Informational: a road user was present without approach/conflict evidence; no specific action beyond normal observation.",
    "hand_info": "Informational: hand-position change recorded; no action implied on its own.",
    "drowsiness_info": "Informational: drowsiness level decreased to a non-elevated state; continue normal monitoring.",
    "deescalation": "Informational: risk level decreased; no additional action.",
    "none": "No specific action: no hazard recorded for this event.",
}
INFORMATIONAL = ("road_user_present", "hand_info", "drowsiness_info", "deescalation", "none")


def recommendation() -> Column:
    """Recommendation key of an event."""
    to = F.element_at(F.split(F.coalesce("transition", F.lit("")), "->"), -1)
    kind = F.col("change_kind")
    change = F.when(kind == "drowsiness_level", F.when(to.isin("HIGH", "CRITICAL"), "drowsiness").otherwise("drowsiness_info"))
    change = change.when(kind == "hand_state", F.when(to == "NO_HANDS", "hands_off").otherwise("hand_info")).when(kind == "driver_activity", F.when(to == "HANDS_OFF_WHEEL", "hands_off").otherwise("hand_info")).otherwise("none")
    table = F.create_map(*[F.lit(x) for kv in HAZARD_ADVICE.items() for x in kv])
    return F.when(F.col("event_type") == "DRIVER_STATE_CHANGE", change).when(F.col("event_type") == FALLING, "deescalation").otherwise(F.coalesce(F.try_element_at(table, F.coalesce("hazard_type", F.lit(""))), F.lit("none")))


def advice_text(key) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv]), key)


def aggregate_recommendations(e: DataFrame) -> DataFrame:
    g = e.groupBy(recommendation().alias("key")).agg(F.count("*").alias("events")).withColumn("informational", F.col("key").isin(*INFORMATIONAL))
    return g.orderBy("informational", F.desc("events"), "key")


def is_significant() -> Column:
    return F.col("event_type").isin("PERSISTENT_HAZARD", "DRIVER_STATE_CHANGE") | _rise("HIGH", "CRITICAL")


def unpivot(wide: DataFrame, scope: str) -> DataFrame:
    """(scope, key, value) rows of a one-row table of numbers."""
    cols = wide.columns
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in cols])).alias("x")).select(F.lit(scope).alias("scope"), "x.key", "x.value")


def ranked_values(df: DataFrame, keys: list[str], value: str, places: dict[str, Column], buckets: int = 4096) -> DataFrame:
    """(keys, _name, value, n): the value at each of the named places (0-based, from ``n``) of a key's sorted values.

    Values are counted in buckets between a key's least and greatest; only the
    buckets that the places fall into are sorted, by distinct value, so a key of any
    number of rows never meets in one task.  Null values do not count; rows with a
    null key belong to none.
    """
    # The input is worked out once, into its distinct values; everything else reads those.
    own = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("value")).groupBy(*keys, "value").agg(F.count("*").alias("_c"))
    return places_of(stored(own, "values"), keys, places, buckets)


def places_of(own: DataFrame, keys: list[str], places: dict[str, Column], buckets: int = 4096) -> DataFrame:
    """``ranked_values`` of a stored table (keys, value, _c) of distinct values and their counts."""
    ends = own.groupBy(*keys).agg(F.min("value").cast("double").alias("_lo"), F.max("value").cast("double").alias("_hi"), F.sum("_c").alias("n"))
    place = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("value").cast("double") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets)).otherwise(0)
    counts = own.join(ends, keys).withColumn("_b", F.least(place, F.lit(buckets - 1))).select(*keys, "_b", "value", "_c", "n")
    upto = lambda *part: Window.partitionBy(*part).rowsBetween(Window.unboundedPreceding, 0)
    hist = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_m"), F.first("n").alias("n")).withColumn("_at", F.sum("_m").over(upto(*keys).orderBy("_b")))
    wanted = F.array(*[F.struct(F.lit(k).alias("_name"), c.cast("double").alias("_t")) for k, c in places.items()])
    hit = hist.withColumn("_before", F.col("_at") - F.col("_m")).select(*keys, "_b", "_before", "_at", F.inline(wanted)).filter((F.col("_t") < F.col("_at")) & (F.col("_t") >= F.col("_before")))
    upto_here = counts.join(hit.select(*keys, "_b", "_before").distinct(), [*keys, "_b"]).withColumn("_upto", F.col("_before") + F.sum("_c").over(upto(*keys, "_b").orderBy("value"))).drop("_before")
    near = upto_here.join(hit.select(*keys, "_b", "_name", "_t"), [*keys, "_b"])
    return near.filter((F.col("_t") < F.col("_upto")) & (F.col("_t") >= F.col("_upto") - F.col("_c"))).select(*keys, "_name", "value", "n")


def nearest_rank(df: DataFrame, keys: list[str], value: str, q: float = 0.95) -> DataFrame:
    """Value at index round(q (n-1)) of the sorted values (half-even)."""
    return ranked_values(df, keys, value, {"q": F.rint(q * (F.col("n") - 1))}).drop("_name")


def five_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, median, max, min of each key's finite values, rounded to 3; the median by ``ranked_values``.  Keys without a finite value have no row."""
    d = df.select(*keys, finite(value).alias("value")).filter(F.col("value").isNotNull())
    own = stored(d.groupBy(*keys, "value").agg(F.count("*").alias("_c")), "values")
    half = (F.col("n") - 1) / 2
    mid = places_of(own, keys, {"low": F.floor(half), "high": F.ceil(half)}).groupBy(*keys).agg(F.round(F.avg("value"), 3).alias("median"))
    rest = own.groupBy(*keys).agg(F.sum("_c").alias("n"), F.round(F.sum(F.col("value") * F.col("_c")) / F.sum("_c"), 3).alias("mean"), F.round(F.max("value"), 3).alias("max"), F.round(F.min("value"), 3).alias("min"))
    return rest.join(mid, keys).select(*keys, "n", "mean", "median", "max", "min")


def mode_first(df: DataFrame, keys: list[str], value: str, ordinal: str) -> DataFrame:
    """Most frequent value; of equals the one seen first."""
    per = df.groupBy(*keys, value).agg(F.count("*").alias("c"), F.min(ordinal).alias("f"))
    return per.groupBy(*keys).agg(F.max_by(value, F.struct("c", (-F.col("f")).alias("m"))).alias("mode"), F.max("c").alias("n"))


def peak(df: DataFrame, keys: list[str], level: str, t: str) -> DataFrame:
    """Peak, first and final level of each group, and rows by level."""
    return df.groupBy(*keys).agg(
        F.max_by(level, F.struct(rank(level), (-F.col(t)).alias("m"))).alias("peak"), F.min_by(level, t).alias("first_level"), F.max_by(level, t).alias("final_level"), *[F.count_if(F.col(level) == x).alias(f"n_{x.lower()}") for x in LEVELS]
    )


def class_summary(dets: DataFrame, frame: list[str]) -> DataFrame:
    """Per class: boxes, frames with it, least, mean and greatest confidence."""
    return dets.groupBy("class_name").agg(F.count("*").alias("boxes"), F.countDistinct(*frame).alias("frames"), F.min("confidence").alias("low"), F.avg("confidence").alias("mean"), F.max("confidence").alias("high"))


def track_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per track: persistence, first and last area and their ratio, label changes (counted up to 3), top speed."""
    g = rows.groupBy(*keys).agg(
        F.max("persistence").alias("persistence"), F.max("detections").alias("detections"), F.min_by("area", "ts").alias("first_area"), F.max_by("area", "ts").alias("last_area"), F.least(F.max("label_changes"), F.lit(3)).alias("changes"), F.max("speed").alias("top_speed")
    )
    return g.withColumn("growth_ratio", F.when((F.col("detections") >= 3) & (F.col("first_area") > 0), F.col("last_area") / F.col("first_area")))


def top_examples(df: DataFrame, keys: list[str], score: str, tie: list[str], k: int) -> DataFrame:
    """The k best rows, one per key."""
    d = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), *tie))).filter("_n = 1").drop("_n")
    return d.orderBy(F.desc(score), *tie).limit(k)


def evenly_spaced(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """At most n rows of each group at positions round(i (N-1) / (n-1)), half-even.

    Where the first of ``order`` is a number, a group is placed bucket by bucket
    of its range; else each group is sorted in one task.
    """
    plain = F.lit(0)
    d = df
    if isinstance(df.schema[order[0]].dataType, NumericType):
        x = F.col(order[0]).cast("double")
        ends = df.groupBy(*[F.col(k).alias(f"_e{i}") for i, k in enumerate(keys)]).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
        d = df.join(ends, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_e{i}")) for i, k in enumerate(keys)])).drop(*[f"_e{i}" for i in range(len(keys))])
        plain = F.coalesce(F.when(F.col("_hi") > F.col("_lo"), F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 4096)), F.lit(-1))
    d = placed(d.withColumn("_b", plain), keys, order, "_b").withColumn("_i", F.col("_r") - 1)
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(i * (F.col("_n") - 1) / float(max(1, n - 1))).cast("long"))
    return d.filter((F.col("_n") <= n) | F.array_contains(at, F.col("_i"))).select(*df.columns)


def without_preroll(df: DataFrame, t: str) -> DataFrame:
    """Rows from time 0 on: warm-up rows before it feed the state of earlier operators only."""
    return df.filter(F.col(t) >= 0)


def summary_text(e: DataFrame, backend=None) -> str:
    """A few sentences about an event table; ``backend(prompt)`` may word them, and its failure falls back to these.

    Collects single-row aggregates only.
    """
    o = event_overview(e).first()
    if not o["total_events"]:
        return "No events were recorded."
    levels = ", ".join(f"{x} {o[f'level_{x.lower()}']}" for x in LEVELS)
    out = [f"{o['total_events']} events in {o['sessions']} session(s).", f"Levels: {levels}."]
    top = find_patterns(e).filter("events > 0 and pattern <> 'risk_escalation'").orderBy(F.desc("events"), "pattern").first()
    if top:
        out.append(f"Most frequent pattern: {top['label'].lower()} ({top['events']} in {top['sessions']} session(s)).")
    advice = aggregate_recommendations(e).filter("not informational").limit(3).collect()
    if advice:
        out.append("Review first: " + ", ".join(r["key"] for r in advice) + ".")
    text = " ".join(out)
    if backend is not None:
        try:
            return str(backend(text)) or text
        except Exception:  # the summary must not depend on an outside service
            return text
    return text
