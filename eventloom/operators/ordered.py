"""Ordered analytics per session: changes, runs, islands, slopes and trailing windows.

All of them use ``Window.partitionBy(keys).orderBy(t, tie)``, so one exchange and
one sort serve a whole chain.  Ties are broken by the columns in ``order``.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.config import EPS, LEVELS
from eventloom.functions.columns import col, fused, let, level_name, rank
from eventloom.sources.storage import stored


def ordered(keys: list[str], order: list) -> "Window":
    return Window.partitionBy(*keys).orderBy(*order)


def so_far(keys: list[str], order: list) -> "Window":
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def islands(df: DataFrame, keys: list[str], order: list, starts: Column, name: str = "island") -> DataFrame:
    """Number the runs that begin where ``starts`` holds (a running sum of the flag)."""
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(so_far(keys, order)))


def changes(df: DataFrame, keys: list[str], order: list, state: str, initial=None) -> DataFrame:
    """Rows whose ``state`` differs from the row before (``initial`` before the first), with ``previous``."""
    before = F.lag(state, 1, initial).over(ordered(keys, order))
    return df.withColumn("previous", before).filter(~F.col(state).eqNullSafe(F.col("previous")))


def level_transitions(df: DataFrame, keys: list[str], order: list, level: str = "level") -> DataFrame:
    """Level changes with transition text and event type; a session begins at SAFE."""
    out = changes(df, keys, order, level, LEVELS[0])
    kind = F.when(rank(level) > rank("previous"), "RISK_ESCALATED").otherwise("RISK_DEESCALATED")
    return out.withColumn("transition", F.concat("previous", F.lit("->"), F.col(level))).withColumn("event_type", kind)


def state_runs(df: DataFrame, keys: list[str], order: list, state: str, t: str) -> DataFrame:
    """Run-length segments: state, start, end (where the next begins, or the last time seen), duration, open."""
    w = ordered(keys, order)
    flag = ~F.col(state).eqNullSafe(F.lag(state).over(w)) | F.lag(t).over(w).isNull()
    runs = islands(df, keys, order, flag).groupBy(*keys, "island").agg(F.first(state).alias("state"), F.min(t).alias("start"), F.max(t).alias("last"), F.count("*").alias("n"))
    after = F.lead("start").over(Window.partitionBy(*keys).orderBy("island"))
    return runs.withColumn("end", F.coalesce(after, "last")).withColumn("open", after.isNull()).withColumn("duration", F.col("end") - F.col("start"))


def totals_by_state(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Total and longest time in each state, the open segment included, and how often it was entered."""
    return runs.groupBy(*keys, "state").agg(F.sum("duration").alias("total"), F.max("duration").alias("longest"), F.count("*").alias("runs"))


def run_duration(df: DataFrame, keys: list[str], order: list, t: str, inside: Column, unknown: Column | None = None, name: str = "run_seconds") -> DataFrame:
    """Time since the current unbroken run of ``inside`` rows began; 0 outside, null where ``unknown``."""
    w = ordered(keys, order)
    df = df.withColumn("_in", F.coalesce(inside, F.lit(False)))
    df = islands(df, keys, order, F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False)), "_run")
    began = F.min(F.when(F.col("_in"), F.col(t))).over(Window.partitionBy(*keys, "_run"))
    seconds = F.when(F.col("_in"), F.col(t) - began).otherwise(0.0)
    if unknown is not None:
        seconds = F.when(~F.coalesce(unknown, F.lit(False)), seconds)
    return df.withColumn(name, seconds).drop("_in", "_run")


def presence_start(df: DataFrame, session: list[str], key: list[str], step: str, t: str) -> DataFrame:
    """When a key's unbroken presence began: it must appear in every step of its session (dense ``step`` numbers)."""
    w = Window.partitionBy(*session, *key).orderBy(step)
    df = df.withColumn("_g", F.col(step) - F.row_number().over(w))
    return df.withColumn("present_since", F.min(t).over(Window.partitionBy(*session, *key, "_g"))).drop("_g")


def elevated_episodes(events: DataFrame, keys: list[str], t: str = "timestamp", tie: list[str] | None = None) -> DataFrame:
    """Spans from a SAFE escalation to the next return to SAFE.

    A second SAFE escalation while one is open starts anew and drops the open one;
    only a session's last episode may stay open (null end and duration).
    """
    order = [t, *(tie or [])]
    e = events.filter(F.col("event_type").isin("RISK_ESCALATED", "RISK_DEESCALATED") & F.col(t).isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf")))
    starts = (F.col("previous_risk_level") == "SAFE") & (F.col("event_type") == "RISK_ESCALATED")
    e = islands(e, keys, order, F.coalesce(starts, F.lit(False)), "episode").filter("episode > 0")
    part = Window.partitionBy(*keys, "episode")
    place = F.row_number().over(part.orderBy(*order))
    e = e.withColumn("_n", place).withColumn("_end", F.min(F.when((F.col("risk_level") == "SAFE") & (F.col("_n") > 1), F.col("_n"))).over(part))
    inside = e.filter(F.col("_end").isNull() | (F.col("_n") <= F.col("_end")))
    at_end = F.col("_n") == F.col("_end")
    got = inside.groupBy(*keys, "episode").agg(
        F.min(t).alias("start"), F.max(F.when(at_end, F.col(t))).alias("end"), F.min_by("event_id", "_n").alias("start_event"), F.max(F.when(at_end, F.col("event_id"))).alias("end_event"),
        F.max(F.greatest(F.coalesce(rank("risk_level"), F.lit(0)), F.lit(0))).alias("_peak"),
    )
    last = F.max("episode").over(Window.partitionBy(*keys))
    got = got.withColumn("_last", last).filter(F.col("end").isNotNull() | (F.col("episode") == F.col("_last")))
    return got.withColumn("peak_level", level_name("_peak")).withColumn("duration_seconds", F.round(F.col("end") - F.col("start"), 3)).drop("_peak", "_last")


def lag_rates(df: DataFrame, keys: list[str], order: list, t: str, x: str = "cx", y: str = "cy", area: str = "area") -> DataFrame:
    """Velocity and area change against the previous observation; null where no time has passed."""
    w = ordered(keys, order)
    dt = F.col(t) - F.lag(t).over(w)
    ok = dt > EPS
    old = F.lag(area).over(w)
    return df.withColumns(
        {
            "vx": F.when(ok, (F.col(x) - F.lag(x).over(w)) / dt), "vy": F.when(ok, (F.col(y) - F.lag(y).over(w)) / dt), "area_rate": F.when(ok, (F.col(area) - old) / dt),
            "relative_area_rate": F.when(ok & (old > 0), (F.col(area) - old) / dt / old),
        }
    )


def trailing(agg: str, keys: list[str], t: str, width: float, last: str = "CURRENT ROW") -> Column:
    """An aggregate (SQL) over the rows of the last ``width`` units of ``t``; a frame on doubles needs SQL."""
    return F.expr(f"{agg} OVER (PARTITION BY {', '.join(keys)} ORDER BY {t} RANGE BETWEEN {width!r}D PRECEDING AND {last})")


def slope_of(points: Column) -> Column:
    """Least-squares slope of an array of (t, y), taken in its order; null without spread."""

    def step(m: Column, p: Column) -> Column:
        n, dt = m["n"] + 1, p["t"] - m["t"]
        return let(F.struct((m["t"] + dt / n).alias("t"), (m["y"] + (p["y"] - m["y"]) / n).alias("y")), lambda k: F.struct(
            n.alias("n"), k["t"].alias("t"), k["y"].alias("y"), fused(dt, p["y"] - k["y"], m["joint"]).alias("joint"), (m["spread"] + dt * (p["t"] - k["t"])).alias("spread"),
        ))

    zero = F.struct(F.lit(0.0).alias("n"), *[F.lit(0.0).alias(c) for c in ("t", "y", "joint", "spread")])
    return F.aggregate(points, zero, step, lambda m: F.when(m["spread"] > 0, (m["joint"] / m["n"]) / (m["spread"] / m["n"])))


def trailing_slope(df: DataFrame, keys: list[str], t: str, values: dict[str, str], window: float, min_samples: int, min_span: float) -> DataFrame:
    """Least-squares slopes of ``values`` (name -> column) over the trailing ``window``; null with too few samples or too short a span.

    Moments are added up bit by bit as in SQL's regr_slope, which rounds a step of the joint one once: any other sum ends beside some slopes that lie on a threshold.
    """
    d = df.withColumns({f"_y{i}": col(c).cast("double") for i, c in enumerate(values.values())})
    w = lambda agg: trailing(agg, keys, t, window + EPS)
    ok = (w(f"count({t})") >= min_samples) & (w(f"max({t})") - w(f"min({t})") >= min_span - EPS)
    d = d.withColumns({"_ok": ok, **{f"_p{i}": w(f"collect_list(if(_y{i} is null, null, struct({t} as t, _y{i} as y)))") for i in range(len(values))}})
    d = d.withColumns({name: F.when(F.col("_ok"), F.coalesce(slope_of(F.col(f"_p{i}")), F.lit(0.0))) for i, name in enumerate(values)})
    return d.drop("_ok", *[f"_{c}{i}" for c in "yp" for i in range(len(values))])


def trailing_ratio(df: DataFrame, keys: list[str], order: list, t: str, state: str, window: float, max_gap: float) -> DataFrame:
    """Observed and positive time in the trailing window.

    The time since the previous row counts for that row's state if it was known
    and the gap is at most ``max_gap``; an interval that reaches out of the window
    is clipped.  As intervals do not overlap only the oldest can be, so its
    clipped part comes off the window's sum.
    """
    w = ordered(keys, order)
    d = df.withColumn("_a", F.lag(t).over(w)).withColumn("_s", F.lag(state).over(w))
    ok = F.col("_s").isNotNull() & (F.col(t) > F.col("_a")) & (F.col(t) - F.col("_a") <= max_gap)
    d = d.withColumn("_len", F.when(ok, F.col(t) - F.col("_a")).otherwise(0.0)).withColumn("_a", F.when(ok, F.col("_a")))
    # Rows whose interval ends inside the window; the first of them may begin before it.
    low = F.col(t) - window
    d = d.withColumn("_len1", F.when(F.col("_s"), F.col("_len")).otherwise(0.0))
    d = d.withColumn("_first", trailing(f"min_by(struct(_a, {t}, _s), if(_len > 0, {t}, null))", keys, t, window))
    over = F.when(F.col(f"_first.{t}") > low, F.greatest(F.lit(0.0), low - F.col("_first._a"))).otherwise(F.coalesce(F.col(f"_first.{t}") - F.col("_first._a"), F.lit(0.0)))
    observed = trailing("sum(_len)", keys, t, window) - F.coalesce(over, F.lit(0.0))
    positive = trailing("sum(_len1)", keys, t, window) - F.when(F.col("_first._s"), F.coalesce(over, F.lit(0.0))).otherwise(0.0)
    return d.withColumn("observed_seconds", observed).withColumn("positive_seconds", positive).drop("_a", "_s", "_len", "_len1", "_first")


def numbered(df: DataFrame, keys: list[str], order: list, name: str, pattern: str) -> DataFrame:
    """Sequential ids such as ``event_000001`` per group."""
    return df.withColumn(name, F.format_string(pattern, F.row_number().over(ordered(keys, order))))


def rising_edges(df: DataFrame, keys: list[str], order: list, flag: str) -> DataFrame:
    """How often ``flag`` turns true in each group (a first true row counts)."""
    up = F.col(flag) & ~F.coalesce(F.lag(flag).over(ordered(keys, order)), F.lit(False))
    return df.withColumn("_up", F.coalesce(up, F.lit(False))).groupBy(*keys).agg(F.count_if("_up").alias("edges"))


def within_first(df: DataFrame, keys: list[str], t: str, seconds: float) -> DataFrame:
    """Rows of the first ``seconds`` of each group."""
    return df.withColumn("_t0", F.min(t).over(Window.partitionBy(*keys))).filter(F.col(t) - F.col("_t0") <= seconds).drop("_t0")


def placed(df: DataFrame, keys: list[str], order: list, bucket: str) -> DataFrame:
    """Adds ``_r``, the 1-based place of a row in its group, and ``_n``, the group's size.

    ``bucket`` rises with ``order``: a bucket of a group is sorted in one task, the
    places before it come from the buckets' counts, so no whole group has to.
    """
    own = [*keys, bucket]
    sizes = df.groupBy(*own).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_c").over(w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    o = sizes.select(*[F.col(k).alias(f"_p{i}") for i, k in enumerate(own)], before.alias("_o"), F.sum("_c").over(w).alias("_n"))
    inner = F.row_number().over(Window.partitionBy(*own).orderBy(*order))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_p{i}")) for i, k in enumerate(own)])
    return df.withColumn("_i", inner).join(o, same).withColumn("_r", F.col("_i") + F.col("_o")).drop("_i", "_o", bucket, *[f"_p{i}" for i in range(len(own))])


def numbered_places(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """Adds the 0-based place of each row in its group, whatever the group's size.

    Rows are range-sorted by group and order; a place is the one within a range plus
    the counts of the group's earlier ranges.  ``order`` should tell rows apart.
    """
    d = stored(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = d.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_in")).agg(F.count("*").alias("_n"))
    own = [f"_k{i}" for i in range(len(keys))]
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*own).orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    o = sizes.select(*own, "_in", before.alias("_before"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_range") == F.col("_in"))
    inner = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    return d.withColumn(name, inner).join(o, same).withColumn(name, F.col(name) + F.col("_before")).drop(*own, "_in", "_before", "_range")
