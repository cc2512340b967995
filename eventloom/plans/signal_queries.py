"""Small rules over whole tables, the file audit, and the summary's counters, each with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventloom.config import DriverSettings
from eventloom.functions import columns
from eventloom.operators import audit, driver, files, geometry, ordered, perception, records, report, risk, stats, tracker
from eventloom.plans.adapter import BOXES_SQL, LEVEL, LOG_SQL, STEPS_SQL, boxes, full_log, steps, table
from eventloom.plans.registry import query
from eventloom.plans.risk_queries import ASSESS_SQL, FRAMES_SQL, _detections, assessed, tracks_sql
from eventloom.plans.sequence_queries import EYE_SQL
from eventloom.schemas import event_rules, field_checks
from eventloom.sources import progress
from eventloom.sources.readers import event_order

S, O = ["session_id"], ["t", "event_id"]


# ---------------------------------------------------------------- driver rules

_HANDS = "CASE WHEN value < 15 THEN 'BOTH_HANDS' WHEN value < 35 THEN 'ONE_HAND' WHEN value < 80 THEN 'NO_HANDS' ELSE 'UNKNOWN' END"


def _hands(spark, d):
    hand = F.when(F.col("value") < 15, "BOTH_HANDS").when(F.col("value") < 35, "ONE_HAND").when(F.col("value") < 80, "NO_HANDS").otherwise("UNKNOWN")
    return steps(spark, d).withColumn("hand", hand).withColumn("seen", F.when(F.col("event_type") == "error", "PHONE").when(F.col("event_type") == "signup", "OTHER_MANUAL_DISTRACTION"))


@query("driver_activity", f"""WITH {STEPS_SQL}, h AS (SELECT *, {_HANDS} AS hand, CASE event_type WHEN 'error' THEN 'PHONE' WHEN 'signup' THEN 'OTHER_MANUAL_DISTRACTION' END AS seen FROM steps),
l AS (SELECT *, coalesce(seen, hand) AS label FROM h), f AS (SELECT *, (lag(hand) OVER w IS DISTINCT FROM hand)::INT AS f FROM l WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id)),
r AS (SELECT *, sum(f) OVER (PARTITION BY session_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f), b AS (SELECT *, t - min(t) OVER (PARTITION BY session_id, run) AS held FROM r)
SELECT session_id, event_id, label, CASE WHEN seen IS NOT NULL THEN seen WHEN hand = 'UNKNOWN' THEN 'UNKNOWN' WHEN hand = 'NO_HANDS' AND held >= 12 THEN 'HANDS_OFF_WHEEL' ELSE 'NORMAL' END AS activity FROM b""")
def driver_activity(spark, d):
    """The label of the hands and the activity inferred from it; hands are off after half a day."""
    s = ordered.run_duration(_hands(spark, d), S, O, "t", F.col("hand") == "NO_HANDS", F.col("hand") == "UNKNOWN", "held")
    return s.select("session_id", "event_id", driver.hand_label("seen", "hand").alias("label"), driver.activity("seen", "hand", "held", DriverSettings(no_hands=12.0)).alias("activity"))


@query("observation_quality", f"""WITH {STEPS_SQL} SELECT event_id, round(((value > 10)::INT + (event_type <> 'error')::INT + (x > 30)::INT + 1) / 4, 6) AS quality FROM steps""")
def observation_quality(spark, d):
    s = steps(spark, d).withColumns({"face": F.when(F.col("value") > 10, True), "eyes": F.col("event_type") != "error", "hands": F.col("x") > 30, "frame": F.lit(True)})
    return s.select("event_id", F.round(driver.observation_quality("face", "eyes", "hands", "frame"), 6).alias("quality"))


@query("head_away", f"""WITH {STEPS_SQL}, h AS (SELECT *, CASE WHEN event_type <> 'error' THEN abs(value - 30) > 30 OR coalesce(x > 75, false) END AS away FROM steps),
g AS (SELECT *, (coalesce(away, false) AND NOT coalesce(lag(away) OVER w, false))::INT AS fresh FROM h WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT session_id, event_id, CASE WHEN away IS NULL THEN NULL WHEN NOT away THEN 0 ELSE round(t - min(CASE WHEN away THEN t END) OVER (PARTITION BY session_id, run), 6) END AS away_hours FROM r""")
def head_away(spark, d):
    """How long the head has been turned away; unknown rows end a turn."""
    s = steps(spark, d).withColumns({"yaw": F.col("value") - 30, "pitch": F.col("x") - 50})
    away = F.when(F.col("event_type") != "error", risk.head_is_away("yaw", "pitch"))
    s = ordered.run_duration(s.withColumn("away", away), S, O, "t", F.coalesce("away", F.lit(False)), F.col("away").isNull(), "away_hours")
    return s.select("session_id", "event_id", F.round("away_hours", 6).alias("away_hours"))


# ---------------------------------------------------------------- shapes and formats


@query("box_shapes", f"""WITH {STEPS_SQL}, {BOXES_SQL} SELECT event_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS box_w, y2 - y1 AS box_h, (x2 - x1) * (y2 - y1) AS area,
CASE WHEN x2 - x1 > y2 - y1 THEN 'landscape' WHEN x2 - x1 < y2 - y1 THEN 'portrait' ELSE 'square' END AS orientation,
CASE WHEN abs(r - 1) < 0.02 THEN '1:1' WHEN abs(r - 4 / 3.0::DOUBLE) < 0.02 THEN '4:3' WHEN abs(r - 3 / 4.0::DOUBLE) < 0.02 THEN '3:4' WHEN abs(r - 16 / 9.0::DOUBLE) < 0.02 THEN '16:9' WHEN abs(r - 9 / 16.0::DOUBLE) < 0.02 THEN '9:16' WHEN abs(r - 1.5) < 0.02 THEN '3:2' WHEN abs(r - 2 / 3.0::DOUBLE) < 0.02 THEN '2:3'
  ELSE 'other (' || printf('%.2f', round_even(r, 2)) || ')' END AS aspect FROM (SELECT *, (x2 - x1)::DOUBLE / (y2 - y1) AS r FROM boxes)""")
def box_shapes(spark, d):
    b = geometry.with_shape(boxes(spark, d))
    return b.select("event_id", "cx", "cy", "box_w", "box_h", "area", columns.orientation("box_w", "box_h").alias("orientation"), columns.aspect_label("box_w", "box_h").alias("aspect"))


_POINTS = "list_transform(range(6), lambda i: {'x': embedding[2 * i + 1]::DOUBLE, 'y': embedding[2 * i + 2]::DOUBLE})"


@query("eye_openness", f"""WITH p AS (SELECT vec_id, {_POINTS} AS p FROM embeddings), g AS (SELECT vec_id, sqrt(pow(p[1].x - p[4].x, 2) + pow(p[1].y - p[4].y, 2)) AS w, sqrt(pow(p[2].x - p[6].x, 2) + pow(p[2].y - p[6].y, 2)) + sqrt(pow(p[3].x - p[5].x, 2) + pow(p[3].y - p[5].y, 2)) AS lids,
list_bool_and(list_transform(p, lambda q: q.x BETWEEN 0 AND 1 AND q.y BETWEEN 0 AND 1)) AS inside FROM p) SELECT vec_id, CASE WHEN w >= 1e-6 THEN round(lids / (2 * w), 6) END AS openness, inside FROM g""")
def eye_openness(spark, d):
    """Openness of the eye that a vector's first twelve numbers outline, and whether all its points lie inside the picture."""
    point = lambda i: F.struct(F.col("embedding")[2 * i].cast("double").alias("x"), F.col("embedding")[2 * i + 1].cast("double").alias("y"))
    p = table(spark, d, "embeddings").select("vec_id", F.array(*[point(i) for i in range(6)]).alias("p"))
    eye = columns.eye_openness([F.col("p")[i] for i in range(6)])
    return p.select("vec_id", F.round(eye, 6).alias("openness"), geometry.landmarks_in_frame("p").alias("inside"))


@query("codec_names", """WITH c AS (SELECT doc_id, (ascii(substr(source, 1, 1)) + ascii(substr(source, 2, 1)) * 256 + ascii(substr(source, 4, 1)) * 65536 + CASE WHEN length(source) > 4 THEN ascii(substr(source, 5, 1)) ELSE 32 END * 16777216)::BIGINT AS code FROM documents)
SELECT doc_id, trim(chr((code & 255)::INT) || chr(((code >> 8) & 255)::INT) || chr(((code >> 16) & 255)::INT) || chr(((code >> 24) & 255)::INT)) AS name FROM c""")
def codec_names(spark, d):
    """Codec numbers packed from characters of each document's source, unpacked again."""
    at = lambda i: F.ascii(F.substring("source", i, 1)).cast("long")
    code = at(1) + at(2) * 256 + at(4) * 65536 + F.when(F.length("source") > 4, at(5)).otherwise(32) * 16777216
    return table(spark, d, "documents").select("doc_id", columns.fourcc(code).alias("name"))


@query("event_times", f"""WITH {STEPS_SQL} SELECT event_id, strftime(TIMESTAMP '2026-01-01 00:00:00' + to_microseconds(round(value * 1e6)::BIGINT), '%Y-%m-%dT%H:%M:%S.%f') AS iso, printf('%02d:%04.1f', floor(round(value, 1) / 60)::INT, round(value, 1) - floor(round(value, 1) / 60) * 60) AS clock FROM steps""")
def event_times(spark, d):
    return steps(spark, d).select("event_id", columns.iso_after("2026-01-01T00:00:00", F.col("value")).alias("iso"), columns.clock("value").alias("clock"))


@query("class_summary", f"""WITH {STEPS_SQL}, {BOXES_SQL}, b AS (SELECT boxes.*, (boxes.event_id % 100) / 100.0::DOUBLE AS confidence FROM boxes) SELECT class_name, count(*) AS boxes, count(DISTINCT (session_id, frame)) AS frames, min(confidence) AS low, round(avg(confidence), 9) AS mean, max(confidence) AS high FROM b GROUP BY 1""")
def class_summary(spark, d):
    b = boxes(spark, d).withColumn("confidence", (F.col("event_id") % 100) / F.lit(100.0))
    return stats.class_summary(b, ["session_id", "frame"]).withColumn("mean", F.round("mean", 9))


# ---------------------------------------------------------------- summaries


@query("event_order", f"""WITH {STEPS_SQL}, {LOG_SQL} SELECT event_id, row_number() OVER (ORDER BY 'run_001', session_id::VARCHAR, timestamp, event_id::VARCHAR) AS place FROM log""")
def event_order_query(spark, d):
    """The place of every event in the loader's order; ids and sessions compare as text."""
    e = full_log(spark, d).withColumns({"session_id": F.col("session_id").cast("string"), "text_id": F.col("event_id").cast("string")})
    # One place for all events: each session is numbered by itself, behind the sessions before it.
    per = e.groupBy("session_id").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy().orderBy("session_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    keys = event_order()
    w = Window.partitionBy("session_id").orderBy(*keys[:3], "text_id")
    return e.withColumn("i", F.row_number().over(w)).join(per.select("session_id", "before"), "session_id").select("event_id", (F.col("before") + F.col("i")).alias("place"))


_TOTALS = f"""WITH {STEPS_SQL}, {LOG_SQL}, e AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN 'not recorded' WHEN risk_level IN ('HIGH', 'CRITICAL') THEN 'true' ELSE 'false' END AS alarm FROM log),
p AS (SELECT 'events_by_type' AS category, event_type AS key, event_id FROM e UNION ALL SELECT 'events_by_camera', 'not recorded', event_id FROM e UNION ALL SELECT 'events_by_risk_level', risk_level, event_id FROM e UNION ALL SELECT 'events_by_hazard_type', coalesce(hazard_type, 'not recorded'), event_id FROM e
UNION ALL SELECT 'risk_transitions', previous_risk_level || '->' || risk_level, event_id FROM e UNION ALL SELECT 'alarm_recommended', alarm, event_id FROM e UNION ALL SELECT 'data_sources', 'LOCAL_REAL', event_id FROM e UNION ALL SELECT 'observation_types', 'not recorded', event_id FROM e UNION ALL SELECT 'evidence_kinds', 'not recorded', event_id FROM e),
g AS (SELECT category, key, count(*) AS n, min(event_id) AS f FROM p GROUP BY 1, 2 UNION ALL SELECT 'events_by_risk_level', k, 0, NULL FROM (SELECT unnest(['SAFE', 'CAUTION', 'HIGH', 'CRITICAL']) AS k) WHERE k NOT IN (SELECT risk_level FROM e))
SELECT category, key, n, row_number() OVER (PARTITION BY category ORDER BY n DESC, f NULLS LAST, key)::INT AS place FROM g"""


@query("event_totals", _TOTALS)
def event_totals(spark, d):
    return report.event_totals(full_log(spark, d))


@query("observed_problems", f"""WITH {STEPS_SQL}, {LOG_SQL}, r AS (SELECT event_id AS n FROM log) SELECT 'camera: null' AS problem, count(*) AS n FROM r WHERE n % 29 = 0 HAVING count(*) > 0 UNION ALL SELECT 'version', count(*) FROM r WHERE n % 31 = 0 HAVING count(*) > 0 UNION ALL SELECT 'inferred', count(*) FROM r WHERE n % 23 = 0 HAVING count(*) > 0
UNION ALL SELECT 'data_source: not allowed', count(*) FROM r WHERE n % 37 = 0 HAVING count(*) > 0 UNION ALL SELECT 'timestamp: not finite', count(*) FROM r WHERE n % 47 = 0 HAVING count(*) > 0 UNION ALL SELECT 'notes: not JSON', count(*) FROM r WHERE n % 43 = 0 HAVING count(*) > 0""")
def observed_problems(spark, d):
    """Rows that break each rule, counted while the table is written elsewhere: no scan of their own."""
    from eventloom.plans.risk_queries import _event_table

    rules = {k: c for k, c in {**field_checks(), **event_rules()}.items() if k in ("camera: null", "version", "inferred", "data_source: not allowed", "timestamp: not finite", "notes: not JSON")}
    checked = progress.Checked(_event_table(spark, d), rules)
    checked.df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(k, n) for k, (n, _) in checked.problems().items()], "problem string, n long")


# ---------------------------------------------------------------- the audit, documents as files


_FILES = """f AS (SELECT doc_id, lang || '/' || source || '/' || doc_id AS path, lang AS camera, CASE WHEN source <> 'src7' THEN source END AS label, CASE WHEN source IN ('src1', 'src2') THEN 'video' WHEN source = 'src3' THEN 'unsupported' WHEN source = 'src4' THEN 'ignored' ELSE 'image' END AS kind, source AS extension,
  CASE WHEN n_chars < 20 THEN 0 ELSE n_chars END AS size_bytes, contains(text, 'e') AND n_chars >= 20 AS readable, (ascii(text) % 5 + 1) * 160 AS width, (n_chars % 4 + 1) * 120 AS height, lang AS format, CASE WHEN n_chars % 9 = 0 THEN 6 ELSE 1 END AS exif_orientation,
  CASE WHEN n_chars % 6 <> 0 THEN n_chars / 25.0::DOUBLE END AS duration_s, 25.0::DOUBLE AS fps, CASE WHEN n_chars % 2 = 0 THEN 'H264' END AS codec, CASE WHEN n_chars % 8 = 0 THEN 90 ELSE 0 END AS rotation_meta, n_chars AS frame_count, sha256(text) AS sha256 FROM documents)"""


def listing(spark, d):
    """Documents as files: languages are cameras, sources class folders, characters bytes."""
    n, s = F.col("n_chars"), F.col("source")
    return table(spark, d, "documents").select(
        F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("camera"), F.when(s != "src7", s).alias("label"), F.when(s.isin("src1", "src2"), "video").when(s == "src3", "unsupported").when(s == "src4", "ignored").otherwise("image").alias("kind"), s.alias("extension"),
        F.when(n < 20, 0).otherwise(n).alias("size_bytes"), (F.contains("text", F.lit("e")) & (n >= 20)).alias("readable"), ((F.ascii("text") % 5 + 1) * 160).alias("width"), ((n % 4 + 1) * 120).alias("height"), F.col("lang").alias("format"), F.when(n % 9 == 0, 6).otherwise(1).alias("exif_orientation"),
        F.when(n % 6 != 0, n / F.lit(25.0)).alias("duration_s"), F.lit(25.0).alias("fps"), F.when(n % 2 == 0, "H264").alias("codec"), F.when(n % 8 == 0, 90).otherwise(0).alias("rotation_meta"), n.alias("frame_count"), F.sha2("text", 256).alias("sha256"),
    )


_NINE = """count(*) AS files, count(*) FILTER (kind = 'image') AS images, count(*) FILTER (kind = 'video') AS videos, count(*) FILTER (kind = 'unsupported') AS unsupported, count(*) FILTER (kind = 'ignored') AS ignored_system_files, count(*) FILTER (size_bytes = 0) AS empty,
count(*) FILTER (NOT readable AND size_bytes <> 0) AS corrupt, count(*) FILTER (kind = 'image' AND readable) AS readable_images, count(*) FILTER (kind = 'video' AND readable) AS readable_videos"""


@query("audit_folders", f"WITH {_FILES} SELECT camera, label, grouping_id(camera, label)::INTEGER AS level, {_NINE} FROM f GROUP BY ROLLUP (camera, label)")
def audit_folders(spark, d):
    return audit.folder_counts(listing(spark, d), ["camera", "label"])


@query("audit_figures", f"""WITH {_FILES}, i AS (SELECT *, width || 'x' || height AS dim FROM f WHERE kind = 'image'), g AS (SELECT * FROM i WHERE readable), v AS (SELECT * FROM f WHERE kind = 'video')
SELECT 'images' AS kind, (SELECT count(*) FROM i) AS total, count(*) AS readable, arg_min(dim, (width * height, path)) AS min_dimensions, arg_min(dim, (-width * height, path)) AS max_dimensions, count(DISTINCT dim) AS several, count(*) FILTER (exif_orientation <> 1) AS turned, NULL::DOUBLE AS seconds FROM g
UNION ALL SELECT 'videos', count(*), count(*) FILTER (readable), NULL, NULL, count(*) FILTER (readable AND duration_s IS NULL), NULL, round(sum(duration_s) FILTER (readable), 3) FROM v""")
def audit_figures(spark, d):
    f = listing(spark, d)
    text, none = F.lit(None).cast("string"), F.lit(None).cast("long")
    i = audit.image_figures(f).select(F.lit("images").alias("kind"), "total", "readable", "min_dimensions", "max_dimensions", F.col("distinct_dimensions").alias("several"), F.col("exif_rotated").alias("turned"), F.lit(None).cast("double").alias("seconds"))
    v = audit.video_figures(f).select(F.lit("videos").alias("kind"), "total", "readable", text.alias("min_dimensions"), text.alias("max_dimensions"), F.col("without_duration").alias("several"), none.alias("turned"), F.col("total_duration_s").alias("seconds"))
    return i.unionByName(v)


@query("audit_shares", f"""WITH {_FILES}, g AS (SELECT *, width::DOUBLE / height AS r FROM f WHERE kind = 'image' AND readable), v AS (SELECT * FROM f WHERE kind = 'video' AND readable),
p AS (SELECT 'formats' AS category, format AS key FROM g UNION ALL SELECT 'dimensions', width || 'x' || height FROM g UNION ALL SELECT 'orientation', CASE WHEN width > height THEN 'landscape' WHEN width < height THEN 'portrait' ELSE 'square' END FROM g UNION ALL SELECT 'extensions', extension FROM f WHERE kind = 'image'
UNION ALL SELECT 'aspect_ratios', CASE WHEN abs(r - 1) < 0.02 THEN '1:1' WHEN abs(r - 4 / 3.0::DOUBLE) < 0.02 THEN '4:3' WHEN abs(r - 0.75) < 0.02 THEN '3:4' WHEN abs(r - 16 / 9.0::DOUBLE) < 0.02 THEN '16:9' WHEN abs(r - 0.5625) < 0.02 THEN '9:16' WHEN abs(r - 1.5) < 0.02 THEN '3:2' WHEN abs(r - 2 / 3.0::DOUBLE) < 0.02 THEN '2:3' ELSE 'other (' || printf('%.2f', round_even(r, 2)) || ')' END FROM g
UNION ALL SELECT 'resolutions', width || 'x' || height FROM v UNION ALL SELECT 'fps', '25.0' FROM v UNION ALL SELECT 'codecs', coalesce(codec, 'None') FROM v UNION ALL SELECT 'rotation_meta', rotation_meta::VARCHAR FROM v)
SELECT category, key, count(*) AS n FROM p GROUP BY 1, 2""")
def audit_shares(spark, d):
    f = listing(spark, d)
    return audit.image_shares(f).unionByName(audit.video_shares(f)).drop("first_seen")


@query("audit_numbers", f"""WITH {_FILES}, p AS (SELECT 'image width' AS name, width::DOUBLE AS x FROM f WHERE kind = 'image' AND readable UNION ALL SELECT 'image height', height FROM f WHERE kind = 'image' AND readable UNION ALL SELECT 'image file_size_bytes', size_bytes FROM f WHERE kind = 'image' AND readable
UNION ALL SELECT 'video duration_s', duration_s FROM f WHERE kind = 'video' AND readable AND duration_s > 0 UNION ALL SELECT 'video frame_count', frame_count FROM f WHERE kind = 'video' AND readable UNION ALL SELECT 'video file_size_bytes', size_bytes FROM f WHERE kind = 'video' AND readable)
SELECT name, min(x) AS low, max(x) AS high, round(avg(x), 3) AS mean FROM p GROUP BY 1""")
def audit_numbers(spark, d):
    f = listing(spark, d)
    named = lambda kind, rows: rows.withColumn("name", F.concat(F.lit(f"{kind} "), "name"))
    return named("image", audit.image_numbers(f)).unionByName(named("video", audit.video_numbers(f)))


@query("audit_issues", f"""WITH {_FILES}, t AS (SELECT camera, label, {_NINE} FROM f WHERE label IS NOT NULL GROUP BY 1, 2), e AS (SELECT DISTINCT lang AS camera, 'src' || k AS label FROM documents, range(0, 18) r(k)),
g AS (SELECT count(*) AS n, count(DISTINCT (camera, coalesce(label, ''))) AS places FROM f GROUP BY sha256 HAVING count(*) > 1), i AS (SELECT *, width || 'x' || height AS dim FROM f WHERE kind = 'image' AND readable), v AS (SELECT *, width || 'x' || height AS dim FROM f WHERE kind = 'video' AND readable),
a AS (SELECT 'missing folder' AS issue, camera || '/' || label AS place, 1 AS n FROM e WHERE (camera, label) NOT IN (SELECT camera, label FROM t) UNION ALL SELECT 'unexpected folder', camera || '/' || label, 1 FROM t WHERE (camera, label) NOT IN (SELECT camera, label FROM e)
UNION ALL SELECT 'outside class folders', NULL, count(*) FROM f WHERE label IS NULL UNION ALL SELECT 'unsupported', NULL, count(*) FROM f WHERE kind = 'unsupported' UNION ALL SELECT 'empty', NULL, count(*) FROM f WHERE size_bytes = 0 UNION ALL SELECT 'corrupt', NULL, count(*) FROM f WHERE NOT readable AND size_bytes <> 0
UNION ALL SELECT 'duplicate groups', NULL, count(*) FROM g UNION ALL SELECT 'duplicate files', NULL, sum(n - 1) FROM g UNION ALL SELECT 'duplicates across labels', NULL, count(*) FROM g WHERE places > 1
UNION ALL SELECT 'several dimensions', NULL, CASE WHEN count(DISTINCT dim) > 1 THEN count(DISTINCT dim) END FROM i UNION ALL SELECT 'mixed orientation', NULL, CASE WHEN count(DISTINCT sign(width - height)) > 1 THEN count(DISTINCT sign(width - height)) END FROM i UNION ALL SELECT 'turned pictures', NULL, count(*) FILTER (exif_orientation <> 1) FROM i
UNION ALL SELECT 'several resolutions', NULL, CASE WHEN count(DISTINCT dim) > 1 THEN count(DISTINCT dim) END FROM v UNION ALL SELECT 'turned films', NULL, count(DISTINCT rotation_meta) FILTER (rotation_meta <> 0) FROM v UNION ALL SELECT 'films without duration', NULL, count(*) FILTER (duration_s IS NULL) FROM v)
SELECT issue, place, n::BIGINT AS n FROM a WHERE n > 0""")
def audit_issues(spark, d):
    """Issues of the listing; expected are the sources 0 to 17 of every language."""
    want = table(spark, d, "documents").select(F.col("lang").alias("camera")).distinct().withColumn("label", F.explode(F.array(*[F.lit(f"src{k}") for k in range(18)])))
    return audit.audit_issues(listing(spark, d), want)


# ---------------------------------------------------------------- split plans

_PLAN = """p AS (SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN NULL WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'val' ELSE 'test' END AS split, CASE WHEN doc_id % 89 = 0 THEN '' ELSE lang END AS label, CASE WHEN doc_id % 83 = 0 THEN 'x' ELSE sha256(text) END AS h FROM documents)"""


@query("split_plan_problems", f"""WITH {_PLAN}, a AS (SELECT 'other content' AS problem, doc_id::VARCHAR AS item, 1 AS n FROM p WHERE doc_id % 83 = 0 UNION ALL SELECT 'unknown split', doc_id::VARCHAR, 1 FROM p WHERE split IS NULL UNION ALL SELECT 'no label', doc_id::VARCHAR, 1 FROM p WHERE label = ''),
c AS (SELECT h, count(DISTINCT split) AS s, count(DISTINCT label) AS l, min(doc_id)::VARCHAR AS item FROM p GROUP BY h), f AS (SELECT s.split, l.label, count(p.doc_id) AS n FROM (SELECT unnest(['train', 'val', 'test']) AS split) s CROSS JOIN (SELECT DISTINCT label FROM p WHERE label <> '') l LEFT JOIN p ON p.split = s.split AND p.label = l.label GROUP BY 1, 2)
SELECT problem, item, n::BIGINT AS n FROM a UNION ALL SELECT 'content in several splits', item, s FROM c WHERE s > 1 UNION ALL SELECT 'content under several labels', item, l FROM c WHERE l > 1 UNION ALL SELECT 'too few', split || '/' || label, n FROM f WHERE n < 60""")
def split_plan_problems(spark, d):
    """A plan over all documents in which some rows are broken, held against the documents."""
    n, docs = F.col("doc_id"), table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    plan = docs.select("doc_id", F.when(n % 97 == 0, None).when(n % 10 < 7, "train").when(n % 10 < 9, "val").otherwise("test").alias("split"), F.when(n % 89 == 0, "").otherwise(F.col("lang")).alias("label"), F.when(n % 83 == 0, "x").otherwise(F.col("h")).alias("h"))
    return files.plan_problems(plan, docs, "doc_id", "h", "split", "label", ["train", "val", "test"], 60)


@query("table_fingerprints", """WITH t AS (SELECT lang, sha256('{"doc_id":' || doc_id || ',"source":"' || source || '"}') AS h FROM documents), s AS (SELECT lang, count(*) AS rows, sum(('0x' || substr(h, 1, 15))::BIGINT::HUGEINT) AS a, sum(('0x' || substr(h, 16, 15))::BIGINT::HUGEINT) AS b, sum(('0x' || substr(h, 31, 15))::BIGINT::HUGEINT) AS c, sum(('0x' || substr(h, 46, 15))::BIGINT::HUGEINT) AS d FROM t GROUP BY lang)
SELECT lang, rows, sha256(a || ':' || b || ':' || c || ':' || d) AS fingerprint FROM s""")
def table_fingerprints(spark, d):
    """The fingerprint of each language's ids and sources."""
    return files.fingerprint(table(spark, d, "documents"), ["doc_id", "source"], ["lang"])


# ---------------------------------------------------------------- the driver's pipeline

_STATES_ROWS = f"""{STEPS_SQL}, obs AS (SELECT session_id, event_id, t - 240 * floor(t / 240) AS t, floor(t / 240) AS part, CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN 'NO_FACE' ELSE 'OK' END AS face, value / 100 AS lo, CASE WHEN event_id % 11 <> 0 THEN x / 100 END AS ro,
  CASE WHEN event_id % 6 <> 0 THEN value END AS yaw, {_HANDS} AS hand0, CASE WHEN event_id % 17 = 0 THEN 'PHONE' END AS act, event_id % 13 = 0 AS broken FROM steps),
m AS (SELECT session_id, event_id, part, t, coalesce(face, 'PROVIDER_ERROR') AS face, CASE WHEN face = 'OK' THEN lo END AS lo, CASE WHEN face = 'OK' THEN ro END AS ro, CASE WHEN face = 'OK' THEN yaw END AS yaw, CASE WHEN broken THEN 'UNKNOWN' ELSE hand0 END AS hand, act FROM obs),
steps2 AS (SELECT *, CASE WHEN lo IS NOT NULL AND ro IS NOT NULL THEN (lo + ro) / 2 ELSE coalesce(lo, ro) END < 0.2 AS closed, coalesce(act, hand) AS manual, dense_rank() OVER (PARTITION BY session_id ORDER BY part) AS nth FROM m)"""
_EYES_TAIL = EYE_SQL[EYE_SQL.index("\na AS (SELECT *, lag(t)") :].replace("PARTITION BY session_id", "PARTITION BY session_id, part").replace("FROM s)", "FROM steps2)")
_EYES_TAIL = _EYES_TAIL[: _EYES_TAIL.rindex("SELECT session_id, event_id, closure_ratio")]


@query("driver_states", f"""WITH {_STATES_ROWS}, {_EYES_TAIL},
lv AS (SELECT *, CASE WHEN score IS NULL THEN 'UNKNOWN' WHEN score >= 0.8 THEN 'CRITICAL' WHEN score >= 0.5 THEN 'HIGH' WHEN win IS NULL THEN 'UNKNOWN' ELSE 'LOW' END AS level FROM k),
r1 AS (SELECT *, (lag(manual) OVER q IS DISTINCT FROM manual)::INT AS fresh2, manual IN ('NO_HANDS', 'PHONE', 'OTHER_MANUAL_DISTRACTION') AS away FROM lv WINDOW q AS (PARTITION BY session_id, part ORDER BY t, event_id)),
r2 AS (SELECT *, sum(fresh2) OVER (PARTITION BY session_id, part ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run2, (away AND NOT coalesce(lag(away) OVER (PARTITION BY session_id, part ORDER BY t, event_id), false))::INT AS turn0 FROM r1),
r3 AS (SELECT *, min(t) OVER (PARTITION BY session_id, part, run2) AS began2, sum(turn0) OVER (PARTITION BY session_id, part ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS turn FROM r2),
r4 AS (SELECT *, t - began2 AS held, lag(began2) OVER (PARTITION BY session_id, part ORDER BY t, event_id) AS lb, lag(manual) OVER (PARTITION BY session_id, part ORDER BY t, event_id) AS lm, min(CASE WHEN away THEN t END) OVER (PARTITION BY session_id, part, turn) AS since FROM r3),
r5 AS (SELECT *, max(greatest(CASE WHEN manual = 'ONE_HAND' THEN held END, CASE WHEN fresh2 = 1 AND lm = 'ONE_HAND' THEN t - lb END, 0)) OVER (PARTITION BY session_id, part ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS long_one, run2 - 1 AS changes,
  CASE WHEN act IS NOT NULL THEN act WHEN hand = 'UNKNOWN' THEN 'UNKNOWN' WHEN hand = 'NO_HANDS' AND held >= 12 THEN 'HANDS_OFF_WHEEL' ELSE 'NORMAL' END AS activity FROM r4)
SELECT session_id, event_id, nth::INT AS timeline, nth > 1 AND event_id = min(event_id) OVER (PARTITION BY session_id, part) AS timeline_reset, face AS face_status, closure_ratio, blinks, level AS drowsiness_level, manual AS manual_state, round(held, 6) AS state_seconds, changes::INT AS state_changes, round(long_one, 6) AS longest_one_hand,
  activity AS driver_activity, CASE WHEN activity IN ('PHONE', 'OTHER_MANUAL_DISTRACTION', 'HANDS_OFF_WHEEL') THEN round(t - since, 6) WHEN activity <> 'UNKNOWN' THEN 0 END AS distraction_seconds, ((face = 'OK')::INT + (yaw IS NOT NULL)::INT + (lo IS NOT NULL)::INT + (ro IS NOT NULL)::INT) / 4 AS observation_quality FROM r5""")
def driver_states(spark, d):
    """States of a clock that goes back every ten days; some providers fail, some rows have no face."""
    n, kind = F.col("event_id"), F.col("event_type")
    hand = F.when(F.col("value") < 15, "BOTH_HANDS").when(F.col("value") < 35, "ONE_HAND").when(F.col("value") < 80, "NO_HANDS").otherwise("UNKNOWN")
    obs = steps(spark, d).select(
        "session_id", "event_id", (F.col("t") - 240 * F.floor(F.col("t") / 240)).alias("t"), F.when(kind == "error", None).when(kind == "signup", "NO_FACE").otherwise("OK").alias("face_status"), (F.col("value") / 100).alias("left_open"), F.when(n % 11 != 0, F.col("x") / 100).alias("right_open"),
        F.when(n % 6 != 0, F.col("value")).alias("yaw"), F.lit(0.0).alias("pitch"), F.when(n % 13 != 0, hand).alias("hand_state"), F.when(n % 17 == 0, "PHONE").alias("hand_activity"),
    )
    cfg = DriverSettings(window=72.0, max_gap=16.0, blink=8.0, long=16.0, sustained=24.0, min_observed=12.0, no_hands=12.0)
    out = perception.driver_states(obs, S, "event_id", "t", cfg)
    six = lambda c: F.round(c, 6).alias(c)
    first = F.min("timeline").over(Window.partitionBy("session_id"))
    return out.select("session_id", "event_id", (F.col("timeline") - first + 1).cast("int").alias("timeline"), "timeline_reset", "face_status", "closure_ratio", "blinks", "drowsiness_level", "manual_state", six("state_seconds"), "state_changes", six("longest_one_hand"), "driver_activity", six("distraction_seconds"), "observation_quality")


@query("detection_checks", f"""WITH {STEPS_SQL}, {BOXES_SQL}, p AS (SELECT CASE WHEN event_id % 19 = 0 THEN 'timestamp' END AS a, CASE WHEN event_id % 23 = 0 THEN 'class_name' END AS b, CASE WHEN event_id % 29 = 0 THEN 'class_id' END AS c, CASE WHEN (event_id % 113) / 100.0 > 1 THEN 'confidence' END AS d, CASE WHEN event_id % 31 = 0 THEN 'bbox: not finite' END AS e,
CASE WHEN event_id % 31 <> 0 AND x2 - 100 < x1 THEN 'bbox: order' END AS f, CASE WHEN event_id % 37 = 0 THEN 'source' END AS g FROM boxes) SELECT problem, count(*) AS n FROM (SELECT unnest([a, b, c, d, e, f, g]) AS problem FROM p) WHERE problem IS NOT NULL GROUP BY 1""")
def detection_checks(spark, d):
    """Rules of a detection, some rows broken."""
    n, nan = F.col("event_id"), F.lit(float("nan"))
    b = boxes(spark, d).withColumns({"ts": F.when(n % 19 == 0, nan).otherwise(F.col("t")), "class_name": F.when(n % 23 == 0, " ").otherwise(F.col("class_name")), "class_id": F.when(n % 29 == 0, -1).otherwise(1), "confidence": n % 113 / F.lit(100.0), "x1": F.when(n % 31 == 0, nan).otherwise(F.col("x1")), "x2": F.col("x2") - 100, "source": F.when(n % 37 != 0, "model")})
    checked = progress.Checked(b, perception.detection_problems())
    checked.df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(k, c) for k, (c, _) in checked.problems().items()], "problem string, n long")


@query("gps_positions", f"""WITH {STEPS_SQL}, f AS (SELECT session_id, t AS ft, event_id, (value % 80) AS lat, (value % 170) AS lon FROM steps WHERE event_type = 'view'), p AS (SELECT * FROM steps WHERE event_type <> 'view'),
c AS (SELECT p.session_id, p.event_id, p.t, f.ft, f.lat, f.lon, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.t - f.ft), f.ft) AS k FROM p LEFT JOIN f ON f.session_id = p.session_id AND abs(p.t - f.ft) <= 6 + 1e-9)
SELECT session_id, event_id, lat AS gps_lat, lon AS gps_lon, CASE WHEN ft IS NULL THEN 'UNAVAILABLE' ELSE 'GPS_LOG' END AS gps_source FROM c WHERE k = 1""")
def gps_positions(spark, d):
    """The nearest position within six hours of every other event, the views being fixes."""
    s = steps(spark, d)
    fixes = s.filter("event_type = 'view'").select("session_id", F.col("t").alias("timestamp"), (F.col("value") % 80).alias("lat"), (F.col("value") % 170).alias("lon"), F.lit(None).cast("double").alias("accuracy_m"))
    return perception.with_position(s.filter("event_type <> 'view'").select("session_id", "event_id", "t"), fixes, S, "t", 6.0).select("session_id", "event_id", "gps_lat", "gps_lon", "gps_source")


@query("class_files", """WITH f AS (SELECT lang || '/' || CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE source END || '/' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.txt' ELSE '.JPG' END AS path, source AS label FROM documents WHERE source IN ('src1', 'src12', 'src0')), k AS (SELECT * FROM (VALUES ('src12', 0), ('src0', 1), ('src1', 2)) t(label, class_index)),
g AS (SELECT path, row_number() OVER (ORDER BY class_index, lower(path), path) - 1 AS place FROM f JOIN k USING (label) WHERE path NOT LIKE '%.txt')
SELECT f.path, label, class_index, place IS NULL AS ignored, place FROM f JOIN k USING (label) LEFT JOIN g USING (path) UNION ALL SELECT NULL, 'none', 3, false, NULL""")
def class_files(spark, d):
    """Files of the named sources in class order; a class that is not there is reported."""
    n = F.col("doc_id")
    path = F.concat("lang", F.lit("/"), F.when(n % 3 == 0, F.upper("source")).otherwise(F.col("source")), F.lit("/"), n.cast("string"), F.when(n % 5 == 0, ".txt").otherwise(".JPG"))
    listing = table(spark, d, "documents").select(path.alias("path"), F.col("source").alias("label"))
    return files.class_files(listing, ["src12", "src0", "src1", "none"], strict=False)


@query("missing_files", """SELECT 'doc/' || doc_id AS path FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 200)""")
def missing_files(spark, d):
    """Labelled documents that a listing without the short ones does not have."""
    path = lambda t: t.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"))
    return files.missing_files(path(table(spark, d, "labels")), path(table(spark, d, "documents").filter("n_chars > 200")))


@query("cross_table", f"""WITH {STEPS_SQL} SELECT event_type, count(*) FILTER (raw = 0) AS n_0, count(*) FILTER (raw = 1) AS n_1, count(*) FILTER (raw = 2) AS n_2, count(*) FILTER (raw = 3) AS n_3, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (raw = 0) / count(*), 1) AS pct_0, round(100.0::DOUBLE * count(*) FILTER (raw = 1) / count(*), 1) AS pct_1,
round(100.0::DOUBLE * count(*) FILTER (raw = 2) / count(*), 1) AS pct_2, round(100.0::DOUBLE * count(*) FILTER (raw = 3) / count(*), 1) AS pct_3 FROM steps GROUP BY ROLLUP (event_type)""")
def cross_table(spark, d):
    return files.cross_table(steps(spark, d), "event_type", "raw", [0, 1, 2, 3])


# ---------------------------------------------------------------- assessments and tracks as they are stored

_G = ASSESS_SQL[: ASSESS_SQL.rindex("SELECT session_id, frame, round(score, 9)")]
_GATES = [risk.GATE_CRITICAL, risk.GATE_HIGH]


@query("risk_counts", _G + f""", pg AS (SELECT g.*, h.off, h.approaching, h.moving_in, h.share, h.quality, h.total, h.qualifies AS q, CASE WHEN r1 >= 2 AND groups < 2 THEN 1 ELSE r1 END AS shown_level FROM g LEFT JOIN rk h ON h.session_id = g.session_id AND h.frame = g.frame AND h.k = 1),
cnt AS (SELECT 'raw_level' AS category, {LEVEL.format("shown_level")} AS key FROM pg UNION ALL SELECT 'gate', '{_GATES[0]}' FROM pg WHERE r0 = 3 AND r1 = 2 UNION ALL SELECT 'gate', '{_GATES[1]}' FROM pg WHERE r1 >= 2 AND groups < 2
UNION ALL SELECT 'hazard', CASE WHEN nd > 0 AND rq THEN 'COMBINED_DRIVER_HAZARD' WHEN rq THEN hazard_type WHEN nd > 0 THEN CASE WHEN d1 > 0 THEN 'DRIVER_DROWSINESS' WHEN d2 > 0 THEN 'HANDS_OFF_WHEEL' ELSE 'DRIVER_HEAD_AWAY' END WHEN pp >= 20 THEN 'ROAD_USER_PRESENT' ELSE 'NONE' END FROM pg
UNION ALL SELECT 'factor', unnest(list_filter([CASE WHEN d1 > 0 THEN 'drowsiness' END, CASE WHEN d2 > 0 THEN 'hands_off_wheel' END, CASE WHEN d3 > 0 THEN 'head_away' END, CASE WHEN total IS NOT NULL THEN 'persistence' END, CASE WHEN off <= 0.35 THEN 'centrality' END, CASE WHEN approaching THEN 'approach' END, CASE WHEN moving_in THEN 'trajectory' END,
  CASE WHEN share > 0.01 THEN 'image_size' END, CASE WHEN quality < 1 AND total > 0 THEN 'evidence_quality' END, CASE WHEN NOT q AND total * least(1, quality) > 20 THEN 'presence_cap' END, CASE WHEN nq >= 2 AND pp IS NOT NULL THEN 'multiple_hazards' END, CASE WHEN coalesce(pp, 0) + CASE WHEN nq >= 2 THEN 5 ELSE 0 END > 70 THEN 'road_cap' END,
  CASE WHEN d1 + d2 + d3 > 60 THEN 'driver_cap' END, CASE WHEN nd > 0 AND rq THEN 'driver_road_combination' END, CASE WHEN road + drv + CASE WHEN nd > 0 AND rq THEN 15 * least(1, road / 30.0::DOUBLE) ELSE 0 END > 100 THEN 'score_clamp' END], lambda x: x IS NOT NULL)) FROM pg)
SELECT category, key, count(*) AS n FROM cnt GROUP BY 1, 2""")
def risk_counts(spark, d):
    """Every frame's assessment by level, hazard, factor and gate."""
    return risk.risk_counts(assessed(spark, d))


@query("stored_tracks", tracks_sql(FRAMES_SQL, """SELECT session_id, a.id AS track_id, round_even(ts, 3) AS ts, round_even(a.conf / len(a.cs), 4) AS mean_confidence, round_even(a.seen - a.first, 3) AS persistence, round_even(ts - a.seen, 3) AS missed, round_even((a.x1 + a.x2) / 2, 2) AS cx, round_even((a.y1 + a.y2) / 2, 2) AS cy,
  round_even(a.x2 - a.x1, 2) AS box_w, round_even((a.x2 - a.x1) * (a.y2 - a.y1), 1) AS area FROM (SELECT session_id, ts, unnest(tracks) AS a FROM k)"""))
def stored_tracks(spark, d):
    """Track rows rounded as they are stored."""
    t = records.rounded(tracker.track(_detections(spark, d)).filter("not ended"), "track")
    return t.select("session_id", "track_id", "ts", "mean_confidence", "persistence", "missed", "cx", "cy", "box_w", "area")
