"""Analytics, joins, files, evaluation and validation queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.columns import level_name, or_else
from eventloom.operators import asof, files, geometry, mleval, stats
from eventloom.plans.adapter import BOXES_SQL, LEVEL, LOG_SQL, STEPS_SQL, boxes, full_log, log, steps, table
from eventloom.plans.registry import query

S = ["session_id"]
FULL_SQL = f"""{STEPS_SQL}, {LOG_SQL},
flog AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN NULL ELSE risk_level IN ('HIGH', 'CRITICAL') END AS alarm, previous_risk_level || '->' || risk_level AS transition FROM log)"""


@query("summary_stats", """SELECT event_type, count(value) AS n, round(avg(value), 3) AS mean, round(median(value), 3) AS median, round(max(value), 3) AS max, round(min(value), 3) AS min FROM events GROUP BY 1""")
def summary_stats(spark, d):
    return stats.five_by(table(spark, d, "events"), ["event_type"], "value")


@query("event_counts", f"""WITH {FULL_SQL},
p AS (SELECT 'event_type' AS category, event_type AS key FROM flog UNION ALL SELECT 'hazard_type', coalesce(hazard_type, 'not recorded') FROM flog UNION ALL SELECT 'transition', transition FROM flog
UNION ALL SELECT 'alarm', CASE WHEN alarm THEN 'true' WHEN NOT alarm THEN 'false' ELSE 'not recorded' END FROM flog UNION ALL SELECT 'risk_level', risk_level FROM flog)
SELECT category, key, count(*) AS n FROM p GROUP BY 1, 2""")
def event_counts(spark, d):
    e = full_log(spark, d)
    return stats.long_counts(e, {"event_type": F.col("event_type"), "hazard_type": or_else("hazard_type"), "transition": F.col("transition"), "alarm": stats.tri_state("alarm_recommended"), "risk_level": F.col("risk_level")})


@query("most_common", """SELECT event_type AS key, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY 1""")
def most_common(spark, d):
    return stats.counted(table(spark, d, "events"), F.col("event_type"), "event_id")


@query("zero_filled_levels", f"""WITH {STEPS_SQL}, k AS (SELECT unnest(['view', 'click', 'purchase', 'error', 'signup']) AS event_type)
SELECT event_type, count(*) FILTER (raw = 0 AND value < 40) AS safe, count(*) FILTER (raw = 1 AND value < 40) AS caution, count(*) FILTER (raw = 2 AND value < 40) AS high, count(*) FILTER (raw = 3 AND value < 40) AS critical, count(*) FILTER (value >= 40) AS no_level FROM k LEFT JOIN steps USING (event_type) GROUP BY 1""")
def zero_filled_levels(spark, d):
    """Levels of each kind of event; values of 40 and more have none, so two levels stay empty."""
    s = steps(spark, d).withColumn("risk_level", F.when(F.col("value") < 40, level_name("raw")))
    out = [stats.by_level(s.filter(F.col("event_type") == k)).select(F.lit(k).alias("event_type"), "*") for k in ("view", "click", "purchase", "error", "signup")]
    return reduce(DataFrame.unionByName, out)


@query("event_overview", f"""WITH {FULL_SQL}
SELECT count(*) AS total_events, count(*) FILTER (risk_level = 'SAFE') AS level_safe, count(*) FILTER (risk_level = 'CRITICAL') AS level_critical, count(*) FILTER (alarm) AS alarm_true, count(*) FILTER (NOT alarm) AS alarm_false,
count(DISTINCT session_id) AS sessions, count(smoothed_risk_score) AS score_n, round(avg(smoothed_risk_score), 3) AS score_mean, round(median(smoothed_risk_score), 3) AS score_median FROM flog""")
def event_overview(spark, d):
    o = stats.event_overview(full_log(spark, d).withColumn("session_id", F.col("session_id").cast("string")))
    return o.select("total_events", "level_safe", "level_critical", "alarm_true", "alarm_false", "sessions", F.col("smoothed.n").alias("score_n"), F.col("smoothed.mean").alias("score_mean"), F.col("smoothed.median").alias("score_median"))


@query("patterns", f"""WITH {FULL_SQL},
t AS (SELECT 'pedestrian_hazard' AS pattern, session_id FROM flog WHERE hazard_type = 'PEDESTRIAN_CONFLICT' AND event_type = 'RISK_ESCALATED'
UNION ALL SELECT 'approaching_vehicle_hazard', session_id FROM flog WHERE hazard_type = 'APPROACHING_VEHICLE' AND event_type = 'RISK_ESCALATED' UNION ALL SELECT 'animal_hazard', session_id FROM flog WHERE hazard_type = 'ANIMAL_HAZARD' AND event_type = 'RISK_ESCALATED'
UNION ALL SELECT 'risk_escalation', session_id FROM flog WHERE event_type = 'RISK_ESCALATED' AND risk_level <> 'SAFE' UNION ALL SELECT 'high_or_critical_escalation', session_id FROM flog WHERE event_type = 'RISK_ESCALATED' AND risk_level IN ('HIGH', 'CRITICAL')),
s AS (SELECT pattern, session_id, count(*) AS n FROM t GROUP BY 1, 2), g AS (SELECT pattern, sum(n) AS events, count(*) AS sessions, count(*) FILTER (n >= 2) AS rep, max(n) AS mx FROM s GROUP BY 1),
k AS (SELECT unnest(['pedestrian_hazard', 'approaching_vehicle_hazard', 'animal_hazard', 'driver_state_change', 'risk_escalation', 'high_or_critical_escalation']) AS pattern)
SELECT pattern, coalesce(events, 0)::BIGINT AS events, coalesce(sessions, 0) AS sessions, coalesce(rep, 0) AS sessions_with_repeats, coalesce(mx, 0) AS max_in_one_session, coalesce(rep, 0) > 0 OR coalesce(sessions, 0) >= 2 AS repeated FROM k LEFT JOIN g USING (pattern)""")
def patterns(spark, d):
    return stats.find_patterns(full_log(spark, d)).drop("label")


@query("time_bins", f"""WITH {STEPS_SQL} SELECT floor(t / 24) * 24.0 AS lo, floor(t / 24) * 24.0 + 24 AS hi, event_type, count(*) AS n FROM steps GROUP BY ALL""")
def time_bins(spark, d):
    return stats.time_bins(steps(spark, d), "t", 24.0)


@query("geo_cells", """WITH p AS (SELECT c_custkey AS k, (c_acctbal % 90) / 100 AS lat, (c_custkey % 170) / 1000.0::DOUBLE AS lon FROM customer), g AS (SELECT round_even(lat / 0.1, 0)::BIGINT AS ix, round_even(lon / 0.1, 0)::BIGINT AS iy, count(*) AS events, min(k) AS f FROM p GROUP BY 1, 2)
SELECT round(ix * 0.1, 6) AS lat, round(iy * 0.1, 6) AS lon, events FROM g ORDER BY events DESC, f LIMIT 20""")
def geo_cells(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") % 90 / 100).alias("lat"), ((F.col("c_custkey") % 170) / F.lit(1000.0)).alias("lon"))
    return stats.grid_cells(p, "lat", "lon", "k", 0.1)


@query("bounding_box", f"""WITH {STEPS_SQL}, {BOXES_SQL} SELECT session_id, count(*) AS points, min((x1 + x2) / 2) AS west, max((x1 + x2) / 2) AS east, min((y1 + y2) / 2) AS north, max((y1 + y2) / 2) AS south FROM boxes GROUP BY 1""")
def bounding_box(spark, d):
    """The extent of each session's box centres."""
    b = geometry.with_shape(boxes(spark, d))
    return b.groupBy("session_id").agg(F.count("*").alias("points"), *[f(c).alias(n) for n, f, c in (("west", F.min, "cx"), ("east", F.max, "cx"), ("north", F.min, "cy"), ("south", F.max, "cy"))])


@query("recommendations", f"""WITH {FULL_SQL}, k AS (SELECT CASE WHEN event_type = 'RISK_DEESCALATED' THEN 'deescalation' ELSE CASE hazard_type WHEN 'PEDESTRIAN_CONFLICT' THEN 'pedestrian' WHEN 'APPROACHING_VEHICLE' THEN 'vehicle' WHEN 'ANIMAL_HAZARD' THEN 'animal' WHEN 'DRIVER_DROWSINESS' THEN 'drowsiness' ELSE 'none' END END AS key FROM flog)
SELECT key, count(*) AS events, key IN ('deescalation', 'none') AS informational FROM k GROUP BY 1""")
def recommendations(spark, d):
    return stats.aggregate_recommendations(full_log(spark, d))


@query("long_statistics", """WITH w AS (SELECT count(*) AS events, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean FROM events) SELECT 'events' AS scope, key, value::DOUBLE AS value FROM (SELECT events::DOUBLE AS events, users::DOUBLE AS users, mean FROM w) UNPIVOT (value FOR key IN (events, users, mean))""")
def long_statistics(spark, d):
    return stats.unpivot(table(spark, d, "events").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean")), "events")


@query("significant_events", f"""WITH {FULL_SQL} SELECT event_id FROM flog WHERE event_type = 'RISK_ESCALATED' AND risk_level IN ('HIGH', 'CRITICAL')""")
def significant_events(spark, d):
    return full_log(spark, d).filter(stats.is_significant()).select("event_id")


@query("peak_levels", f"""WITH {STEPS_SQL}, l AS (SELECT *, {LEVEL.format('raw')} AS level FROM steps)
SELECT session_id, arg_max(level, raw * 1e6 - t) AS peak, arg_min(level, t) AS first_level, arg_max(level, t) AS final_level, count(*) FILTER (raw = 0) AS n_safe, count(*) FILTER (raw = 1) AS n_caution, count(*) FILTER (raw = 2) AS n_high, count(*) FILTER (raw = 3) AS n_critical FROM l GROUP BY 1""")
def peak_levels(spark, d):
    return stats.peak(steps(spark, d).withColumn("level", level_name("raw")), S, "level", "t")


@query("nearest_rank_p95", """WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT l_returnflag, v AS value, n FROM r WHERE i = round_even(0.95::DOUBLE * (n - 1), 0)""")
def nearest_rank_p95(spark, d):
    return stats.nearest_rank(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")


@query("mode_first_seen", """WITH g AS (SELECT user_id, event_type, count(*) AS c, min(event_id) AS f FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, f) AS k FROM g) SELECT user_id, event_type AS mode, c AS n FROM r WHERE k = 1""")
def mode_first_seen(spark, d):
    return stats.mode_first(table(spark, d, "events"), ["user_id"], "event_type", "event_id")


@query("evenly_spaced", """WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, doc_id FROM r WHERE n <= 6 OR i IN (SELECT round_even(k * (n - 1) / 5.0::DOUBLE, 0) FROM range(6) t(k))""")
def evenly_spaced(spark, d):
    return stats.evenly_spaced(table(spark, d, "documents").select("lang", "doc_id"), ["lang"], ["doc_id"], 6)


@query("top_examples", """WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) SELECT user_id, event_id, value FROM r WHERE k = 1 ORDER BY value DESC, event_id LIMIT 10""")
def top_examples(spark, d):
    return stats.top_examples(table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], "value", ["event_id"], 10)


@query("json_properties", """SELECT event_id, CAST(props::JSON->>'$.k' AS BIGINT) AS k FROM events WHERE json_valid(props)""")
def json_properties(spark, d):
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("first_wins", """WITH e AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) SELECT user_id, event_type, event_id FROM e WHERE k = 1""")
def first_wins(spark, d):
    from eventloom.sources.readers import first_wins as f

    return f(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@query("asof_nearest", f"""WITH {STEPS_SQL}, p AS (SELECT session_id, event_id, t FROM steps WHERE event_type = 'purchase'), f AS (SELECT session_id, t AS ft, event_id AS fix FROM steps WHERE event_type = 'view'),
j AS (SELECT p.event_id, f.fix, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.t - f.ft), f.ft, f.fix) AS k FROM p JOIN f ON p.session_id = f.session_id AND abs(p.t - f.ft) <= 12 + 1e-9)
SELECT p.session_id, p.event_id, j.fix FROM p LEFT JOIN j ON p.event_id = j.event_id AND k = 1""")
def asof_nearest(spark, d):
    s = steps(spark, d)
    p, f = s.filter("event_type = 'purchase'").select("session_id", "event_id", "t"), s.filter("event_type = 'view'").select("session_id", F.col("t").alias("ft"), F.col("event_id").alias("fix"))
    return asof.nearest(p, f, S, "t", "ft", 12.0, ["fix"]).select("session_id", "event_id", "fix")


ASOF_SQL = f"""WITH {STEPS_SQL}, p AS (SELECT session_id, event_id, t FROM steps WHERE event_type = 'purchase'), f AS (SELECT session_id, t AS ft, event_id AS fix FROM steps WHERE event_type = 'view')"""


@query("asof_backward", f"""{ASOF_SQL}, l AS (SELECT session_id, max(ft) AS last FROM f GROUP BY 1), j AS (SELECT p.session_id, p.event_id, p.t, f.fix FROM p ASOF LEFT JOIN f ON p.session_id = f.session_id AND p.t + 1e-9 >= f.ft)
SELECT j.session_id, j.event_id, CASE WHEN j.t <= l.last + 24 THEN j.fix END AS fix FROM j LEFT JOIN l USING (session_id)""")
def asof_backward(spark, d):
    s = steps(spark, d)
    p, f = s.filter("event_type = 'purchase'").select("session_id", "event_id", "t"), s.filter("event_type = 'view'").select("session_id", F.col("t").alias("ft"), F.col("event_id").alias("fix"))
    return asof.backward(p, f, S, "t", "ft", ["fix"], tail=24.0).select("session_id", "event_id", "fix")


@query("asof_staleness", f"""{ASOF_SQL} SELECT p.session_id, p.event_id, CASE WHEN p.t - f.ft <= 24 THEN f.fix END AS fix FROM p ASOF LEFT JOIN f ON p.session_id = f.session_id AND p.t + 1e-9 >= f.ft""")
def asof_staleness(spark, d):
    s = steps(spark, d)
    p, f = s.filter("event_type = 'purchase'").select("session_id", "event_id", "t"), s.filter("event_type = 'view'").select("session_id", F.col("t").alias("ft"), F.col("event_id").alias("fix"))
    return asof.backward(p, f, S, "t", "ft", ["fix"], max_age=24.0).select("session_id", "event_id", "fix")


IOU_SQL = """greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS areas"""


@query("overlap_pairs", f"""WITH {STEPS_SQL}, {BOXES_SQL}, j AS (SELECT a.session_id, a.frame + 1 AS frame, a.event_id AS a_id, b.event_id AS b_id, a.class_name = b.class_name AS same_class, {IOU_SQL} FROM boxes a JOIN boxes b ON a.session_id = b.session_id AND b.frame = a.frame + 1)
SELECT session_id, frame, a_id, b_id, same_class, round(inter / (areas - inter), 9) AS iou FROM j WHERE inter / (areas - inter) >= CASE WHEN same_class THEN 0.1 ELSE 0.2 END - 1e-9""")
def overlap_pairs(spark, d):
    b = boxes(spark, d)
    p = geometry.overlap_pairs(b.withColumn("frame", F.col("frame") + 1), b, ["session_id", "frame"], "event_id", "event_id", 0.1, 0.2)
    return p.withColumn("iou", F.round("iou", 9))


@query("duplicate_boxes", f"""WITH {STEPS_SQL}, {BOXES_SQL}, j AS (SELECT a.class_name, a.event_id AS a_id, b.event_id AS b_id, {IOU_SQL} FROM boxes a JOIN boxes b ON a.session_id = b.session_id AND a.frame = b.frame AND a.event_id < b.event_id) SELECT a_id, b_id, round(inter / (areas - inter), 9) AS iou FROM j WHERE inter / (areas - inter) >= 0.5""")
def duplicate_boxes(spark, d):
    p = geometry.duplicate_pairs(boxes(spark, d), ["session_id", "frame"], "event_id", 0.5)
    return p.select("a_id", "b_id", F.round("iou", 9).alias("iou"))


@query("clean_detections", f"""WITH {STEPS_SQL}, {BOXES_SQL}, c AS (SELECT b.session_id, b.event_id, (b.event_id % 100) / 100.0::DOUBLE AS conf, b.class_name, frame, greatest(0, least(x1, 300.0)) AS x1, greatest(0, least(x2, 300.0)) AS x2, greatest(0, least(y1, 250.0)) AS y1, greatest(0, least(y2, 250.0)) AS y2 FROM boxes b),
k AS (SELECT * FROM c WHERE conf >= 0.35 - 1e-6 AND class_name IN ('view', 'click', 'error') AND x2 > x1 AND y2 > y1) SELECT event_id, row_number() OVER (PARTITION BY session_id, frame ORDER BY conf DESC, x1, y1, x2, y2, class_name) - 1 AS det_ix FROM k""")
def clean_detections(spark, d):
    b = boxes(spark, d).withColumn("confidence", (F.col("event_id") % 100) / F.lit(100.0))
    return geometry.clean_detections(b, ["session_id", "frame"], ["view", "click", "error"], 0.35, 300.0, 250.0, ("event_id",)).select("event_id", "det_ix")


@query("split_comparison", """WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders), b AS (SELECT l_orderkey AS k, max(l_linestatus) AS v FROM lineitem GROUP BY 1)
SELECT k, a.v AS left_value, b.v AS right_value, CASE WHEN b.k IS NULL THEN 'only_left' WHEN a.k IS NULL THEN 'only_right' WHEN a.v = b.v THEN 'common' ELSE 'moved' END AS status FROM a FULL JOIN b USING (k)""")
def split_comparison(spark, d):
    """Orders by their own status and by that of their lines."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linestatus").alias("v"))
    return asof.outer_diff(o, lines, "k", "v")


@query("expected_found", """SELECT c_custkey AS k, 'missing' AS status FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events) UNION ALL SELECT DISTINCT user_id, 'unexpected' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)""")
def expected_found(spark, d):
    """Customers without an event, and events' users that are no customers."""
    want = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return asof.expected_found(want, table(spark, d, "events").select(F.col("user_id").alias("k")), ["k"])


@query("set_operations", """SELECT 'both' AS kind, n FROM (SELECT count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)) UNION ALL SELECT 'only_customers', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)""")
def set_operations(spark, d):
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    one = lambda kind, x: x.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return one("both", c.intersect(s)).unionAll(one("only_customers", c.exceptAll(s).distinct().join(s, "k", "left_anti")))


@query("content_groups", """SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_path FROM documents GROUP BY 1 HAVING count(*) > 1""")
def content_groups(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text", F.length("text").alias("size"))
    return files.content_groups(t, "doc_id", "size", "text")


@query("conflict_aware_dedup", """WITH d AS (SELECT doc_id, lang, sha256(text) AS h FROM documents), l AS (SELECT h, count(DISTINCT lang) AS labels FROM d GROUP BY 1), r AS (SELECT d.*, labels, row_number() OVER (PARTITION BY d.h ORDER BY length(doc_id::VARCHAR), doc_id) AS k FROM d JOIN l USING (h))
SELECT doc_id, CASE WHEN labels > 1 THEN 'conflict' WHEN k = 1 THEN 'kept' ELSE 'duplicate' END AS verdict FROM r""")
def conflict_aware_dedup(spark, d):
    t = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    return files.conflict_aware(t, "h", "lang", "doc_id").select("doc_id", "verdict")


SPLIT_SQL = """c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), p AS (SELECT * FROM (VALUES (0, 'train', 0.7::DOUBLE), (1, 'val', 0.15::DOUBLE), (2, 'test', 0.15::DOUBLE)) t(i, split, ratio)),
e AS (SELECT lang, n, i, split, n * ratio AS exact, floor(n * ratio + 1e-9)::BIGINT AS base FROM c, p), s AS (SELECT *, n - sum(base) OVER (PARTITION BY lang) AS rest, row_number() OVER (PARTITION BY lang ORDER BY round(exact - base, 9) DESC, i) AS k FROM e),
z AS (SELECT lang, i, split, base + CASE WHEN k <= rest THEN 1 ELSE 0 END AS size FROM s)"""


@query("split_sizes", f"WITH {SPLIT_SQL} SELECT lang, split, size::BIGINT AS size FROM z")
def split_sizes(spark, d):
    c = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return files.apportioned(c, "lang", "n", {"train": 0.7, "val": 0.15, "test": 0.15}).select("lang", "split", "size")


@query("stratified_split", f"""WITH {SPLIT_SQL}, u AS (SELECT *, sum(size) OVER (PARTITION BY lang ORDER BY i) AS hi FROM z), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('s42' || doc_id::VARCHAR), doc_id) AS k FROM documents)
SELECT r.doc_id, r.lang, u.split FROM r JOIN u ON r.lang = u.lang AND r.k > u.hi - u.size AND r.k <= u.hi""")
def stratified_split(spark, d):
    t = table(spark, d, "documents").select("doc_id", "lang")
    return files.stratified_split(t, "lang", "doc_id", {"train": 0.7, "val": 0.15, "test": 0.15}, "s42").select("doc_id", "lang", "split")


@query("audit_rollup", """SELECT lang, source, grouping_id(lang, source)::INTEGER AS level, count(*) AS files, sum(n_chars) AS bytes, min(n_chars) AS smallest, max(n_chars) AS largest, count(DISTINCT n_chars) AS sizes FROM documents GROUP BY ROLLUP (lang, source)""")
def audit_rollup(spark, d):
    return files.rollup(table(spark, d, "documents").select("lang", "source", "n_chars"), ["lang", "source"], "n_chars")


@query("path_parts", """WITH p AS (SELECT page_id, 'root/' || CASE WHEN page_id % 3 = 0 THEN 'Front' WHEN page_id % 3 = 1 THEN 'driver' ELSE 'other' END || '/class' || (page_id % 4) || '/sub/' || page_id || CASE WHEN page_id % 2 = 0 THEN '.JPG' ELSE '.mp4' END AS path FROM pages)
SELECT page_id, CASE WHEN page_id % 3 = 2 THEN NULL ELSE lower(split_part(path, '/', 2)) END AS camera, CASE WHEN page_id % 3 = 2 THEN NULL ELSE split_part(path, '/', 3) END AS label, CASE WHEN page_id % 3 = 2 THEN NULL ELSE 'sub' END AS subfolder, CASE WHEN page_id % 2 = 0 THEN 'image' ELSE 'video' END AS kind FROM p""")
def path_parts(spark, d):
    n = F.col("page_id")
    path = F.concat(F.lit("root/"), F.when(n % 3 == 0, "Front").when(n % 3 == 1, "driver").otherwise("other"), F.lit("/class"), (n % 4).cast("string"), F.lit("/sub/"), n.cast("string"), F.when(n % 2 == 0, ".JPG").otherwise(".mp4"))
    p = files.located(table(spark, d, "pages").select("page_id", path.alias("path")), "path", ["front", "driver"])
    return p.select("page_id", "camera", "label", "subfolder", files.kind_of("path").alias("kind"))


@query("confusion", """SELECT k.quality, count(l.quality) FILTER (toxic = 0) AS pred_0, count(l.quality) FILTER (toxic = 1) AS pred_1 FROM (VALUES (0), (1)) k(quality) LEFT JOIN labels l ON l.quality = k.quality GROUP BY 1""")
def confusion(spark, d):
    return mleval.confusion(table(spark, d, "labels"), "quality", "toxic", [0, 1])


@query("class_metrics", """WITH c AS (SELECT * FROM (VALUES (0), (1)) t(class)), s AS (SELECT class, count(*) FILTER (quality = class) AS support, count(*) FILTER (toxic = class) AS predicted, count(*) FILTER (quality = class AND toxic = class) AS hits FROM c, labels GROUP BY 1)
SELECT class, support, predicted, hits, round(hits / predicted, 9) AS precision, round(hits / support, 9) AS recall, round(CASE WHEN hits = 0 THEN 0 ELSE 2.0 * hits / (support + predicted) END, 9) AS f1 FROM s""")
def class_metrics(spark, d):
    m = mleval.class_metrics(table(spark, d, "labels"), "quality", "toxic")
    return m.select("class", "support", "predicted", "hits", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("class_weights", """SELECT lang, count(*) AS n, round((SELECT count(*) FROM documents) / ((SELECT count(DISTINCT lang) FROM documents) * count(*)), 9) AS weight FROM documents GROUP BY 1""")
def class_weights(spark, d):
    return mleval.class_weights(table(spark, d, "documents"), "lang").withColumn("weight", F.round("weight", 9))


@query("threshold_analysis", f"""WITH {STEPS_SQL}, t AS (SELECT unnest([0.2, 0.5, 0.9])::DOUBLE AS threshold), c AS (SELECT x / 100 AS conf, event_type = 'view' AS ok FROM steps) SELECT threshold, count(*) FILTER (conf < threshold) AS unknown, round(avg(CASE WHEN conf >= threshold THEN 1.0::DOUBLE ELSE 0 END), 9) AS coverage, round(avg(CASE WHEN conf >= threshold THEN ok::INTEGER END), 9) AS accuracy FROM c, t GROUP BY 1""")
def threshold_analysis(spark, d):
    c = steps(spark, d).select((F.col("x") / 100).alias("conf"), (F.col("event_type") == "view").cast("int").alias("ok"))
    return mleval.threshold_analysis(c, "conf", "ok", [0.2, 0.5, 0.9]).select("threshold", "unknown", F.round("coverage", 9).alias("coverage"), F.round("accuracy", 9).alias("accuracy"))


@query("class_prediction", """WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS p FROM embeddings), s AS (SELECT vec_id, list_transform(p, lambda x: x / list_sum(p)) AS s FROM p)
SELECT vec_id, CASE WHEN list_max(s) >= 0.05 THEN 'c' || list_position(s, list_max(s)) ELSE 'UNKNOWN' END AS label, round(list_max(s), 9) AS confidence FROM s""")
def class_prediction(spark, d):
    p = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("p"))
    name, top = mleval.predict("p", [f"c{i + 1}" for i in range(DIM)], 0.05)
    return p.select("vec_id", name.alias("label"), F.round(top, 9).alias("confidence"))


DIM = 64
CENTRES = [[0.1 * ((i * 7 + j) % 5 - 2) for j in range(DIM)] for i in range(4)]


@query("kmeans_assign", "WITH c AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {c}::DOUBLE[])" for i, c in enumerate(CENTRES)) + f""") t(i, c)), d AS (SELECT vec_id, i, list_sum(list_transform(range(1, {DIM + 1}), lambda k: (embedding[k]::DOUBLE - c[k]) * (embedding[k]::DOUBLE - c[k]))) AS dist FROM embeddings, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, i) AS k FROM d) SELECT vec_id, i AS cluster, round(dist, 6) AS distance FROM r WHERE k = 1""")
def kmeans_assign(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return mleval.assigned(v, "v", CENTRES).select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


@query("luma_stats", """SELECT vec_id, round(list_avg(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS mean, round(list_stddev_pop(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS dev FROM embeddings""")
def luma_stats(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    mean, dev = mleval.luma("v")
    return v.select("vec_id", F.round(mean, 6).alias("mean"), F.round(dev, 6).alias("dev"))


@query("score_deciles", f"""WITH {STEPS_SQL}, r AS (SELECT event_type, x, row_number() OVER (PARTITION BY event_type ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM steps), k AS (SELECT unnest(range(1, 10)) AS decile)
SELECT event_type, decile::INT AS decile, x AS value, n FROM r JOIN k ON r.i = round_even(decile / 10.0::DOUBLE * (n - 1), 0)""")
def score_deciles(spark, d):
    """The nine deciles of each kind's scores, by nearest rank."""
    places = {str(i): F.rint(i / 10 * (F.col("n") - 1)) for i in range(1, 10)}
    return stats.ranked_values(steps(spark, d), ["event_type"], "x", places).select("event_type", F.col("_name").cast("int").alias("decile"), "value", "n")


@query("source_exclusion", """WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'LOCAL_REAL' WHEN 1 THEN 'PUBLIC' WHEN 2 THEN 'SYNTHETIC' END AS src FROM events) SELECT coalesce(src, 'None') AS data_source, count(*) AS n FROM e WHERE src IS NULL OR src NOT IN ('LOCAL_REAL', 'PUBLIC') GROUP BY 1""")
def source_exclusion(spark, d):
    src = F.when(F.col("event_id") % 4 == 0, "LOCAL_REAL").when(F.col("event_id") % 4 == 1, "PUBLIC").when(F.col("event_id") % 4 == 2, "SYNTHETIC")
    e = table(spark, d, "events").select(src.alias("src"))
    return e.filter(~F.coalesce(F.col("src").isin("LOCAL_REAL", "PUBLIC"), F.lit(False))).groupBy(F.coalesce("src", F.lit("None")).alias("data_source")).agg(F.count("*").alias("n"))


@query("previous_rows", """SELECT o_custkey, o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders""")
def previous_rows(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.lag("o_totalprice").over(w).alias("before"))
