"""Ordered and stateful queries over the sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.config import DriverSettings, EventSettings
from eventloom.functions.columns import level_name
from eventloom.operators import driver, folds, ordered, recorder
from eventloom.plans.adapter import HOURS, LEVEL, LOG_SQL, STEPS_SQL, log, steps
from eventloom.plans.registry import query

S, O = ["session_id"], ["t", "event_id"]
ORD = "PARTITION BY session_id ORDER BY t, event_id"
RUNS_SQL = """
flags AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY session_id ORDER BY t, event_id) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS f FROM steps),
marked AS (SELECT *, sum(f) OVER (PARTITION BY session_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM flags)"""


@query("level_transitions", f"""WITH {STEPS_SQL}, {LOG_SQL}
SELECT previous_risk_level || '->' || risk_level AS transition, count(*) AS n, min(event_id) AS first_seen FROM log GROUP BY 1""")
def level_transitions(spark, d):
    return log(spark, d).groupBy("transition").agg(F.count("*").alias("n"), F.min("event_id").alias("first_seen")).orderBy(F.desc("n"), "first_seen")


HYST_SQL = f"""WITH RECURSIVE {STEPS_SQL},
o AS (SELECT *, row_number() OVER ({ORD}) AS rn, t - lag(t) OVER ({ORD}) AS dt FROM steps),
h AS (
  SELECT session_id, event_id, rn, raw, CASE WHEN raw >= 1 THEN 1 ELSE 0 END AS level, CASE WHEN raw >= 1 THEN 1 ELSE 0 END AS c1, CASE WHEN raw >= 2 THEN 1 ELSE 0 END AS c2, CASE WHEN raw >= 3 THEN 1 ELSE 0 END AS c3, 0 AS below
  FROM o WHERE rn = 1
  UNION ALL
  SELECT session_id, event_id, rn, raw, CASE WHEN target > lv THEN target WHEN raw < lv AND bl + 1 >= 2 THEN lv - 1 ELSE lv END, k1, k2, k3, CASE WHEN target > lv THEN 0 WHEN raw < lv THEN (bl + 1) % 2 ELSE 0 END
  FROM (
    SELECT *, CASE WHEN lv < 3 AND k3 >= 3 THEN 3 WHEN lv < 2 AND k2 >= 2 THEN 2 WHEN lv < 1 AND k1 >= 1 THEN 1 ELSE lv END AS target
    FROM (
      SELECT o.session_id, o.event_id, o.rn, o.raw, CASE WHEN o.dt > 48 THEN 0 ELSE h.level END AS lv, CASE WHEN o.dt > 48 THEN 0 ELSE h.below END AS bl,
             CASE WHEN o.raw >= 1 THEN CASE WHEN o.dt > 48 THEN 0 ELSE h.c1 END + 1 ELSE 0 END AS k1, CASE WHEN o.raw >= 2 THEN CASE WHEN o.dt > 48 THEN 0 ELSE h.c2 END + 1 ELSE 0 END AS k2,
             CASE WHEN o.raw >= 3 THEN CASE WHEN o.dt > 48 THEN 0 ELSE h.c3 END + 1 ELSE 0 END AS k3
      FROM h JOIN o ON o.session_id = h.session_id AND o.rn = h.rn + 1))
)
SELECT session_id, event_id, raw, level FROM h"""


@query("hysteresis", HYST_SQL)
def hysteresis(spark, d):
    return folds.hysteresis(steps(spark, d).select("session_id", "event_id", "t", "raw"), S, O, "t", "raw", HOURS).select("session_id", "event_id", "raw", "level")


@query("score_decay", f"""WITH {STEPS_SQL},
g AS (SELECT *, CASE WHEN t - lag(t) OVER ({ORD}) > 48 THEN 1 ELSE 0 END AS f FROM steps),
p AS (SELECT *, sum(f) OVER ({ORD} ROWS UNBOUNDED PRECEDING) AS part FROM g)
SELECT session_id, event_id, round(max(x + t) OVER (PARTITION BY session_id, part ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) - t, 6) AS smoothed FROM p""")
def score_decay(spark, d):
    return folds.decayed_score(steps(spark, d), S, O, "t", "x", HOURS).select("session_id", "event_id", F.round("smoothed", 6).alias("smoothed"))


@query("episodes", f"""WITH {STEPS_SQL}, {LOG_SQL},
s AS (SELECT *, sum(CASE WHEN previous_risk_level = 'SAFE' AND event_type = 'RISK_ESCALATED' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING) AS ep FROM log),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id, ep ORDER BY timestamp, event_id) AS k FROM s WHERE ep > 0),
e AS (SELECT *, min(CASE WHEN risk_level = 'SAFE' AND k > 1 THEN k END) OVER (PARTITION BY session_id, ep) AS ke FROM n),
g AS (SELECT session_id, ep, min(timestamp) AS s0, max(CASE WHEN k = ke THEN timestamp END) AS e0, min(CASE WHEN k = 1 THEN event_id END) AS start_event, max(CASE WHEN k = ke THEN event_id END) AS end_event,
      max(CASE risk_level WHEN 'CAUTION' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'CRITICAL' THEN 3 ELSE 0 END) AS pk FROM e WHERE ke IS NULL OR k <= ke GROUP BY 1, 2)
SELECT session_id, start_event, end_event, {LEVEL.format('pk')} AS peak_level, round(e0 - s0, 3) AS duration_seconds
FROM (SELECT *, max(ep) OVER (PARTITION BY session_id) AS last FROM g) WHERE e0 IS NOT NULL OR ep = last""")
def episodes(spark, d):
    return ordered.elevated_episodes(log(spark, d), S, "timestamp", ["event_id"]).select("session_id", "start_event", "end_event", "peak_level", "duration_seconds")


@query("driver_debounce", f"""WITH {STEPS_SQL}, s2 AS (SELECT * FROM steps WHERE event_type <> 'error'),
f AS (SELECT *, CASE WHEN lag(event_type) OVER ({ORD}) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS f FROM s2),
m AS (SELECT *, sum(f) OVER ({ORD} ROWS UNBOUNDED PRECEDING) AS island FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id, island ORDER BY t, event_id) AS k FROM m),
b AS (SELECT *, lag(event_type) OVER ({ORD}) AS previous FROM k WHERE k = 2)
SELECT session_id, event_id, previous, event_type AS value FROM b WHERE previous IS NOT NULL AND previous <> event_type""")
def driver_debounce(spark, d):
    return folds.debounced(steps(spark, d), S, O, "event_type", 2, unknown="error").select("session_id", "event_id", "previous", F.col("event_type").alias("value"))


COOL_SQL = """WITH RECURSIVE {steps}, c AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, event_id) AS rn FROM steps WHERE raw >= 1),
k AS (SELECT session_id, event_id, rn, t AS last, true AS kept FROM c WHERE rn = 1
  UNION ALL SELECT c.session_id, c.event_id, c.rn, CASE WHEN c.t - k.last < 72 - 1e-9 THEN k.last ELSE c.t END, NOT (c.t - k.last < 72 - 1e-9) FROM k JOIN c ON c.session_id = k.session_id AND c.rn = k.rn + 1)
SELECT session_id, event_id FROM k WHERE kept"""


@query("cooldown", COOL_SQL.format(steps=STEPS_SQL))
def cooldown(spark, d):
    return folds.cooldown(steps(spark, d).filter("raw >= 1").select("session_id", "event_id", "t"), S, O, "t", 72.0).select("session_id", "event_id")


PRESENT_SQL = f"""numbered AS (SELECT *, row_number() OVER ({ORD}) AS step FROM steps),
isl AS (SELECT *, step - row_number() OVER (PARTITION BY session_id, raw ORDER BY step) AS g FROM numbered),
pres AS (SELECT *, min(t) OVER (PARTITION BY session_id, raw, g) AS since FROM isl)"""


@query("presence_islands", f"WITH {STEPS_SQL}, {PRESENT_SQL} SELECT session_id, event_id, round(t - since, 6) AS present FROM pres")
def presence_islands(spark, d):
    n = steps(spark, d).withColumn("step", F.row_number().over(ordered.ordered(S, O)))
    return ordered.presence_start(n, S, ["raw"], "step", "t").select("session_id", "event_id", F.round(F.col("t") - F.col("present_since"), 6).alias("present"))


@query("persistent_hazards", f"""WITH RECURSIVE {STEPS_SQL}, {PRESENT_SQL},
c AS (SELECT *, row_number() OVER (PARTITION BY session_id, raw ORDER BY t, step) AS rn FROM pres WHERE raw >= 1 AND t - since + 1e-9 >= 10),
k AS (SELECT session_id, raw, event_id, rn, t AS last, true AS kept FROM c WHERE rn = 1
  UNION ALL SELECT c.session_id, c.raw, c.event_id, c.rn, CASE WHEN c.t - k.last < 72 - 1e-9 THEN k.last ELSE c.t END, NOT (c.t - k.last < 72 - 1e-9) FROM k JOIN c ON c.session_id = k.session_id AND c.raw = k.raw AND c.rn = k.rn + 1)
SELECT session_id, event_id, {LEVEL.format('raw')} AS level FROM k WHERE kept""")
def persistent_hazards(spark, d):
    n = steps(spark, d).withColumn("step", F.row_number().over(ordered.ordered(S, O))).withColumn("level", level_name("raw")).drop("event_type")
    h = recorder.persistent_hazards(n, S, ["raw"], "step", "t", "level", EventSettings(persistent_seconds=10.0, hazard_cooldown=72.0))
    return h.select("session_id", "event_id", "level")


STATE_RUNS_SQL = f"""WITH {STEPS_SQL}, {RUNS_SQL},
r AS (SELECT session_id, island, min(event_type) AS state, min(t) AS s0, max(t) AS l0, count(*) AS n FROM marked GROUP BY 1, 2),
e AS (SELECT *, lead(s0) OVER (PARTITION BY session_id ORDER BY island) AS nx FROM r)"""


@query("state_runs", f"""{STATE_RUNS_SQL} SELECT session_id, island::BIGINT AS island, state, n, round(coalesce(nx, l0) - s0, 6) AS duration, nx IS NULL AS open FROM e""")
def state_runs(spark, d):
    return ordered.state_runs(steps(spark, d), S, O, "event_type", "t").select("session_id", "island", "state", "n", F.round("duration", 6).alias("duration"), "open")


@query("state_totals", f"""{STATE_RUNS_SQL} SELECT session_id, state, round(sum(coalesce(nx, l0) - s0), 5) AS total, round(max(coalesce(nx, l0) - s0), 6) AS longest, count(*) AS runs FROM e GROUP BY 1, 2""")
def state_totals(spark, d):
    r = ordered.totals_by_state(ordered.state_runs(steps(spark, d), S, O, "event_type", "t"), S)
    return r.select("session_id", "state", F.round("total", 5).alias("total"), F.round("longest", 6).alias("longest"), "runs")


@query("distraction_runs", f"""WITH {STEPS_SQL}, i AS (SELECT *, event_type IN ('VIEW', 'view', 'click') AS ins FROM steps),
f AS (SELECT *, CASE WHEN ins AND NOT coalesce(lag(ins) OVER ({ORD}), false) THEN 1 ELSE 0 END AS f FROM i), m AS (SELECT *, sum(f) OVER ({ORD} ROWS UNBOUNDED PRECEDING) AS r FROM f)
SELECT session_id, event_id, CASE WHEN event_type = 'error' THEN NULL WHEN ins THEN round(t - min(CASE WHEN ins THEN t END) OVER (PARTITION BY session_id, r), 6) ELSE 0.0 END AS seconds FROM m""")
def distraction_runs(spark, d):
    s = steps(spark, d).withColumn("state", F.when(F.col("event_type") == "error", "UNKNOWN").otherwise(F.upper("event_type")))
    return driver.distraction_seconds(s, S, O, "t", "state", ["VIEW", "CLICK"]).select("session_id", "event_id", F.round("distraction_seconds", 6).alias("seconds"))


@query("rising_edges", f"""WITH {STEPS_SQL}, i AS (SELECT session_id, raw >= 2 AS up, coalesce(lag(raw >= 2) OVER ({ORD}), false) AS was FROM steps) SELECT session_id, count(*) FILTER (up AND NOT was) AS edges FROM i GROUP BY 1""")
def rising_edges(spark, d):
    return ordered.rising_edges(steps(spark, d).withColumn("up", F.col("raw") >= 2), S, O, "up")


@query("track_slope", f"""WITH {STEPS_SQL}
SELECT session_id, event_id, CASE WHEN count(*) OVER w >= 3 AND max(t) OVER w - min(t) OVER w >= 6 - 1e-9 THEN round(regr_slope(x, t) OVER w, 5) END AS slope FROM steps
WINDOW w AS (PARTITION BY session_id ORDER BY t RANGE BETWEEN 24.000000001 PRECEDING AND CURRENT ROW)""")
def track_slope(spark, d):
    s = ordered.trailing_slope(steps(spark, d), S, "t", {"slope": "x"}, 24.0, 3, 6.0)
    return s.select("session_id", "event_id", F.round("slope", 5).alias("slope"))


@query("lag_rates", f"""WITH {STEPS_SQL}, l AS (SELECT session_id, event_id, x, t - lag(t) OVER ({ORD}) AS dt, lag(x) OVER ({ORD}) AS px FROM steps)
SELECT session_id, event_id, CASE WHEN dt > 1e-9 THEN round((x - px) / dt, 6) END AS rate, CASE WHEN dt > 1e-9 AND px > 0 THEN round((x - px) / dt / px, 6) END AS relative FROM l""")
def lag_rates(spark, d):
    s = steps(spark, d).withColumns({"cx": F.col("x"), "cy": F.col("x"), "area": F.col("x")})
    return ordered.lag_rates(s, S, O, "t").select("session_id", "event_id", F.round("vx", 6).alias("rate"), F.round("relative_area_rate", 6).alias("relative"))


RATIO_SQL = f"""WITH {STEPS_SQL}, s AS (SELECT *, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN true WHEN 'click' THEN true ELSE false END AS closed FROM steps),
i AS (SELECT session_id, event_id, t, lag(t) OVER ({ORD}) AS a, lag(closed) OVER ({ORD}) AS st FROM s),
v AS (SELECT session_id, a, t AS b, st FROM i WHERE st IS NOT NULL AND t > a AND t - a <= 16),
j AS (SELECT s.session_id, s.event_id, sum(v.b - greatest(v.a, s.t - 72)) AS obs, sum(CASE WHEN v.st THEN v.b - greatest(v.a, s.t - 72) ELSE 0 END) AS pos
      FROM s LEFT JOIN v ON v.session_id = s.session_id AND v.b <= s.t AND v.b > s.t - 72 GROUP BY 1, 2)
SELECT session_id, event_id, round(coalesce(obs, 0), 5) AS observed, round(coalesce(pos, 0), 5) AS positive FROM j"""


@query("window_ratio", RATIO_SQL)
def window_ratio(spark, d):
    s = steps(spark, d).withColumn("closed", F.when(F.col("event_type") == "error", None).otherwise(F.col("event_type").isin("view", "click")))
    r = ordered.trailing_ratio(s, S, O, "t", "closed", 72.0, 16.0)
    return r.select("session_id", "event_id", F.round("observed_seconds", 5).alias("observed"), F.round("positive_seconds", 5).alias("positive"))


@query("alerts", f"""WITH {STEPS_SQL}, {LOG_SQL} SELECT session_id, event_id, 'alert_' || lpad((row_number() OVER (PARTITION BY session_id ORDER BY timestamp, event_id))::VARCHAR, 4, '0') AS alert_id,
CASE risk_level WHEN 'SAFE' THEN 'INFO' WHEN 'CAUTION' THEN 'LOW' WHEN 'HIGH' THEN 'MEDIUM' ELSE 'HIGH' END AS severity, event_type = 'RISK_ESCALATED' AS escalation,
CASE WHEN event_type = 'RISK_ESCALATED' AND risk_level IN ('HIGH', 'CRITICAL') THEN 2 ELSE 1 END AS channels,
CASE WHEN event_type = 'RISK_ESCALATED' THEN 'Risk up: ' ELSE 'Risk down: ' END || previous_risk_level || ' to ' || risk_level AS headline FROM log""")
def alerts(spark, d):
    a = recorder.alerts(steps(spark, d).withColumn("level", level_name("raw")), S, O, "t")
    return a.select("session_id", "event_id", "alert_id", "severity", "escalation", F.size("channels").alias("channels"), "headline")


@query("alert_summary", f"""WITH {STEPS_SQL}, {LOG_SQL} SELECT count(*) AS alerts, count(*) FILTER (event_type = 'RISK_ESCALATED') AS escalations, count(*) FILTER (risk_level = 'SAFE') AS info, count(*) FILTER (risk_level = 'CAUTION') AS low,
count(*) FILTER (risk_level = 'HIGH') AS medium, count(*) FILTER (risk_level = 'CRITICAL') AS high, count(*) FILTER (event_type = 'RISK_ESCALATED' AND risk_level IN ('HIGH', 'CRITICAL')) AS alarms FROM log""")
def alert_summary(spark, d):
    return recorder.alert_summary(recorder.alerts(steps(spark, d).withColumn("level", level_name("raw")), S, O, "t"))


@query("clip_windows", f"""WITH {STEPS_SQL}, l AS (SELECT session_id, max(t) AS last FROM steps GROUP BY 1), e AS (SELECT session_id, event_id, t FROM steps WHERE raw = 3)
SELECT e.session_id, e.event_id, count(*) AS frames, min(l.last) < e.t + 5 AS truncated FROM e JOIN steps f ON f.session_id = e.session_id AND f.t BETWEEN e.t - 5 AND e.t + 5 JOIN l ON l.session_id = e.session_id GROUP BY 1, 2, e.t""")
def clip_windows(spark, d):
    s = steps(spark, d)
    w = recorder.evidence_windows(s.filter("raw = 3").select("session_id", "event_id", F.col("t").alias("et")), s.select("session_id", F.col("t").alias("ft")), S, "event_id", "et", "ft")
    return w.select("session_id", "event_id", "frames", "truncated")


@query("grid_sampler", f"""WITH RECURSIVE {STEPS_SQL}, c AS (SELECT *, row_number() OVER ({ORD}) AS rn FROM steps),
k AS (SELECT session_id, event_id, rn, t + 12.0 AS due, true AS kept FROM c WHERE rn = 1
  UNION ALL SELECT c.session_id, c.event_id, c.rn, CASE WHEN c.t < k.due - 1e-6 THEN k.due WHEN k.due + 12.0 > c.t THEN k.due + 12.0 ELSE c.t + 12.0 END, c.t >= k.due - 1e-6 FROM k JOIN c ON c.session_id = k.session_id AND c.rn = k.rn + 1)
SELECT session_id, event_id FROM k WHERE kept""")
def grid_sampler(spark, d):
    return folds.sampled(steps(spark, d).select("session_id", "event_id", "t"), S, O, "t", 1 / 12).select("session_id", "event_id")


@query("print_on_change", f"""WITH RECURSIVE {STEPS_SQL}, c AS (SELECT *, row_number() OVER ({ORD}) AS rn FROM steps),
k AS (SELECT session_id, event_id, rn, t AS last, raw AS state, true AS kept FROM c WHERE rn = 1
  UNION ALL SELECT session_id, event_id, rn, CASE WHEN new THEN t ELSE last END, CASE WHEN new THEN raw ELSE state END, new
  FROM (SELECT c.session_id, c.event_id, c.rn, c.t, c.raw, k.last, k.state, c.raw <> k.state OR c.t - k.last >= 48 AS new FROM k JOIN c ON c.session_id = k.session_id AND c.rn = k.rn + 1))
SELECT session_id, event_id FROM k WHERE kept""")
def print_on_change(spark, d):
    return folds.emitted_on_change(steps(spark, d).select("session_id", "event_id", "t", "raw"), S, O, "t", "raw", 48.0).select("session_id", "event_id")


@query("stream_clock", f"""WITH c AS (SELECT event_id, user_id AS session_id, CASE WHEN event_id % 3 <> 0 THEN value END AS container FROM events)
SELECT session_id, event_id, round(max(coalesce(container, event_id / 10.0)) OVER (PARTITION BY session_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS t FROM c""")
def stream_clock(spark, d):
    c = steps(spark, d).select("session_id", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("container"))
    return folds.stream_clock(c, S, "event_id", "container", 10.0).select("session_id", "event_id", F.round("t", 6).alias("t"))


@query("timelines", f"""WITH {STEPS_SQL}, b AS (SELECT session_id, event_id, CASE WHEN x < lag(x) OVER ({ORD}) THEN 1 ELSE 0 END AS f, t FROM steps)
SELECT session_id, event_id, sum(f) OVER ({ORD} ROWS UNBOUNDED PRECEDING)::BIGINT AS timeline FROM b""")
def timelines(spark, d):
    return folds.timelines(steps(spark, d), S, O, "x").select("session_id", "event_id", "timeline")


@query("within_first", f"WITH {STEPS_SQL} SELECT session_id, count(*) AS n FROM steps WHERE t <= 48 GROUP BY 1")
def within_first(spark, d):
    return ordered.within_first(steps(spark, d), S, "t", 48.0).groupBy("session_id").agg(F.count("*").alias("n"))


@query("closure_runs", f"""WITH RECURSIVE {STEPS_SQL}, c AS (SELECT *, row_number() OVER ({ORD}) AS rn, CASE WHEN event_type <> 'error' THEN event_type IN ('view', 'click') END AS closed FROM steps),
k AS (SELECT session_id, event_id, rn, CASE WHEN closed THEN t END AS began, CASE WHEN closed IS NOT NULL THEN t END AS seen, NULL::DOUBLE AS duration FROM c WHERE rn = 1
  UNION ALL SELECT session_id, event_id, rn, CASE WHEN closed IS NULL THEN b WHEN closed THEN coalesce(b, t) END, CASE WHEN closed IS NULL THEN seen ELSE t END, CASE WHEN NOT closed THEN t - b END
  FROM (SELECT c.session_id, c.event_id, c.rn, c.t, c.closed, k.seen, CASE WHEN c.t - k.seen > 30 THEN NULL ELSE k.began END AS b FROM k JOIN c ON c.session_id = k.session_id AND c.rn = k.rn + 1))
SELECT session_id, event_id, round(duration, 6) AS duration, CASE WHEN duration < 12 THEN 'blink' WHEN duration >= 24 THEN 'long' ELSE 'intermediate' END AS kind FROM k WHERE duration IS NOT NULL""")
def closure_runs(spark, d):
    s = steps(spark, d).withColumn("closed", F.when(F.col("event_type") == "error", None).otherwise(F.col("event_type").isin("view", "click")))
    return folds.closures(s.select("session_id", "event_id", "t", "closed"), S, O, "t", "closed", 30.0, 12.0, 24.0).select("session_id", "event_id", F.round("duration", 6).alias("duration"), "kind")


EYE_SQL = f"""WITH {STEPS_SQL}, s AS (SELECT session_id, event_id, t, CASE WHEN event_type <> 'error' THEN event_type IN ('view', 'click') END AS closed FROM steps),
a AS (SELECT *, lag(t) OVER ({ORD}) AS a, lag(closed) OVER ({ORD}) AS st, min(t) OVER (PARTITION BY session_id) AS t0, last_value(CASE WHEN closed IS NOT NULL THEN t END IGNORE NULLS) OVER ({ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen,
  last_value(closed IGNORE NULLS) OVER ({ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM s),
b AS (SELECT *, CASE WHEN st IS NOT NULL AND t > a AND t - a <= 16 THEN t - a ELSE 0 END AS len, coalesce(closed AND (coalesce(NOT known, true) OR t - seen > 16), false) AS fresh FROM a),
c AS (SELECT *, sum(fresh::INT) OVER ({ORD} ROWS UNBOUNDED PRECEDING) AS run FROM b), d AS (SELECT *, min(CASE WHEN closed THEN t END) OVER (PARTITION BY session_id, run) AS began FROM c),
e AS (SELECT *, CASE WHEN NOT closed AND known AND t - seen <= 16 THEN CASE WHEN t - began < 8 THEN 'blink' WHEN t - began >= 16 THEN 'long' END END AS kind FROM d),
f AS (SELECT *, sum(len) OVER w AS len_all, sum(CASE WHEN st THEN len ELSE 0 END) OVER w AS len_closed, arg_min({{'a': a, 't': t, 's': st}}, CASE WHEN len > 0 THEN t END) OVER w AS o, count(*) FILTER (kind = 'blink') OVER w AS blinks, count(*) FILTER (kind = 'long') OVER w AS long_closures
  FROM e WINDOW w AS (PARTITION BY session_id ORDER BY t RANGE BETWEEN 72 PRECEDING AND CURRENT ROW)),
g AS (SELECT *, coalesce(CASE WHEN o.t > t - 72 THEN greatest(0, t - 72 - o.a) ELSE o.t - o.a END, 0) AS over FROM f),
h AS (SELECT *, len_all - over AS observed, len_closed - CASE WHEN o.s THEN over ELSE 0 END AS positive FROM g),
i AS (SELECT *, CASE WHEN observed > 0 THEN round(positive / observed, 4) END AS closure_ratio, CASE WHEN closed THEN t - began WHEN NOT closed THEN 0 END AS closed_seconds FROM h),
j AS (SELECT *, least(1.0, coalesce(closed_seconds, 0) / 24.0) AS now, CASE WHEN observed >= 12 AND closure_ratio IS NOT NULL THEN 0.6::DOUBLE * least(1.0, closure_ratio / 0.3::DOUBLE) + (1 - 0.6::DOUBLE) * least(1.0, long_closures / 3.0) END AS win FROM i),
k AS (SELECT *, round(CASE WHEN win IS NOT NULL THEN greatest(now, win) WHEN now > 0 THEN now END, 4) AS score FROM j)
SELECT session_id, event_id, closure_ratio, round(closed_seconds, 6) AS closed_seconds, blinks, long_closures, round(CASE WHEN closed IS NULL THEN t - coalesce(seen, t0) ELSE 0 END, 6) AS missing_seconds, score,
  CASE WHEN score IS NULL THEN 'UNKNOWN' WHEN score >= 0.8 THEN 'CRITICAL' WHEN score >= 0.5 THEN 'HIGH' WHEN win IS NULL THEN 'UNKNOWN' ELSE 'LOW' END AS level FROM k"""
#: The driver's seconds as hours.
EYES = DriverSettings(window=72.0, max_gap=16.0, blink=8.0, long=16.0, sustained=24.0, min_observed=12.0)


@query("eye_features", EYE_SQL)
def eye_features(spark, d):
    s = steps(spark, d).withColumn("closed", F.when(F.col("event_type") == "error", None).otherwise(F.col("event_type").isin("view", "click")))
    f = driver.eye_features(s.select("session_id", "event_id", "t", "closed"), S, O, "t", "closed", EYES)
    score, level = driver.drowsiness("closure_ratio", "closed_seconds", "long_closures", "observed_seconds", EYES)
    return f.select("session_id", "event_id", "closure_ratio", F.round("closed_seconds", 6).alias("closed_seconds"), "blinks", "long_closures", F.round("missing_seconds", 6).alias("missing_seconds"), score.alias("score"), level.alias("level"))


CHANGES_SQL = f"""WITH RECURSIVE {STEPS_SQL},
s AS (SELECT session_id, event_id, t, 'hand_state' AS kind, event_type AS v FROM steps UNION ALL SELECT session_id, event_id, t, 'activity', {LEVEL.format("raw")} FROM steps),
f AS (SELECT *, (lag(v) OVER w IS DISTINCT FROM v)::INT AS f FROM s WINDOW w AS (PARTITION BY session_id, kind ORDER BY t, event_id)), r AS (SELECT *, sum(f) OVER (PARTITION BY session_id, kind ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id, kind, run ORDER BY t, event_id) AS k FROM r), st AS (SELECT *, lag(v) OVER (PARTITION BY session_id, kind ORDER BY t, event_id) AS previous FROM n WHERE k = 2),
c AS (SELECT *, row_number() OVER (PARTITION BY session_id, kind, previous, v ORDER BY t, event_id) AS rn FROM st WHERE previous <> v),
kept AS (SELECT session_id, kind, previous, v, event_id, rn, t AS last, true AS keep FROM c WHERE rn = 1
  UNION ALL SELECT c.session_id, c.kind, c.previous, c.v, c.event_id, c.rn, CASE WHEN c.t - kept.last >= 48 - 1e-9 THEN c.t ELSE kept.last END, c.t - kept.last >= 48 - 1e-9 FROM kept JOIN c ON c.session_id = kept.session_id AND c.kind = kept.kind AND c.previous = kept.previous AND c.v = kept.v AND c.rn = kept.rn + 1)
SELECT session_id, event_id, kind AS change_kind, previous || '->' || v AS transition FROM kept WHERE keep"""


@query("driver_changes", CHANGES_SQL)
def driver_changes(spark, d):
    s = steps(spark, d).withColumn("activity", level_name("raw")).withColumnRenamed("event_type", "hand_state")
    return recorder.driver_changes(s, S, O, "t", ["hand_state", "activity"], EventSettings(change_observations=2, change_cooldown=48.0)).select("session_id", "event_id", "change_kind", "transition")
