"""Reference pools, parents, traces, early stops and layouts over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.columns import frame_at
from eventloom.operators import files, mleval, reference
from eventloom.plans.adapter import STEPS_SQL, steps, table
from eventloom.plans.registry import query

#: Every event as a real row of one of two runs, every seventh as a synthetic one.
REAL_SQL = """
real AS (
  SELECT event_id, 'run_' || user_id % 2 AS run_id, CASE WHEN event_id % 7 = 0 THEN 'SYNTHETIC' ELSE 'LOCAL_REAL' END AS data_source, CASE WHEN event_id % 5 = 0 THEN 'driver' ELSE 'front' END AS camera,
         CASE event_id % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'car' WHEN 2 THEN 'dog' END AS hazard_class, CASE event_type WHEN 'click' THEN 'APPROACHING_VEHICLE' WHEN 'purchase' THEN 'ANIMAL_HAZARD' ELSE 'PEDESTRIAN_CONFLICT' END AS hazard_type,
         value * 400 AS bbox_area, (event_id * 37) % 1920 / 1.0 AS center_x, CASE WHEN event_id % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS drowsiness_level, value AS drowsiness_score,
         CASE WHEN event_id % 3 > 0 THEN value / 100 END AS hazard_confidence
  FROM events
),
sized AS (SELECT *, bbox_area / (1920.0 * 1080.0) AS area_fraction, center_x / 1920.0 AS center_x_norm FROM real WHERE data_source = 'LOCAL_REAL' AND run_id = (SELECT min(run_id) FROM real WHERE data_source = 'LOCAL_REAL')),
road AS (SELECT * FROM sized WHERE camera = 'front' AND hazard_class IS NOT NULL),
pools AS (
  SELECT unnest(['vehicle', 'vehicle_presence']) AS pool, * FROM road WHERE hazard_type = 'APPROACHING_VEHICLE' AND hazard_class = 'car'
  UNION ALL SELECT CASE WHEN area_fraction >= 0.005 THEN 'person' ELSE 'person_distant' END, * FROM road WHERE hazard_class = 'person'
  UNION ALL SELECT 'animal', * FROM road WHERE hazard_type = 'ANIMAL_HAZARD'
  UNION ALL SELECT 'drowsy', * FROM sized WHERE camera = 'driver' AND drowsiness_level = 'HIGH' AND drowsiness_score IS NOT NULL
)"""


def candidates(spark, d) -> DataFrame:
    e, kind = table(spark, d, "events"), F.col("event_type")
    i = F.col("event_id")
    real = e.select(
        "event_id", F.concat(F.lit("run_"), (F.col("user_id") % 2).cast("string")).alias("run_id"), F.when(i % 7 == 0, "SYNTHETIC").otherwise("LOCAL_REAL").alias("data_source"), F.when(i % 5 == 0, "driver").otherwise("front").alias("camera"),
        F.when(i % 4 == 0, "person").when(i % 4 == 1, "car").when(i % 4 == 2, "dog").alias("hazard_class"), F.when(kind == "click", "APPROACHING_VEHICLE").when(kind == "purchase", "ANIMAL_HAZARD").otherwise("PEDESTRIAN_CONFLICT").alias("hazard_type"),
        (F.col("value") * 400).alias("bbox_area"), ((i * 37) % 1920).cast("double").alias("center_x"), F.when(i % 2 == 0, "HIGH").otherwise("LOW").alias("drowsiness_level"), F.col("value").alias("drowsiness_score"),
        F.when(i % 3 > 0, F.col("value") / 100).alias("hazard_confidence"), F.lit(1920).alias("image_width"), F.lit(1080).alias("image_height"),
        F.lit(None).cast("double").alias("box_growth_per_second"), F.lit(None).cast("double").alias("lateral_toward_center_fw_per_s"),
    )
    return reference.pools(reference.first_run(real))


@query("pool_ranges", f"""WITH {REAL_SQL},
v AS (SELECT pool, 'drowsiness_score' AS field, drowsiness_score AS value FROM pools WHERE pool = 'drowsy' UNION ALL SELECT pool, 'area_fraction', area_fraction FROM pools WHERE pool <> 'drowsy'
UNION ALL SELECT pool, 'center_x_norm', center_x_norm FROM pools WHERE pool <> 'drowsy' UNION ALL SELECT pool, 'hazard_confidence', hazard_confidence FROM pools WHERE pool <> 'drowsy')
SELECT pool, field, count(*) AS n, round(min(value), 4) AS min, round(median(value), 4) AS median, round(max(value), 4) AS max FROM v WHERE value IS NOT NULL GROUP BY 1, 2""")
def pool_ranges(spark, d):
    return reference.pool_ranges(candidates(spark, d))


@query("parent_links", f"""WITH {REAL_SQL}, c AS (SELECT pool, event_id AS parent_event_id, row_number() OVER (PARTITION BY pool ORDER BY event_id) - 1 AS at, count(*) OVER (PARTITION BY pool) AS n FROM pools),
r AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'vehicle' WHEN 1 THEN 'animal' ELSE 'none' END AS pool FROM orders)
SELECT r.o_orderkey, r.pool, c.parent_event_id FROM r LEFT JOIN c ON c.pool = r.pool AND c.at = CAST('0x' || substr(md5('42:' || r.o_orderkey), 1, 8) AS BIGINT) % c.n""")
def parent_links(spark, d):
    k = F.col("o_orderkey") % 3
    rows = table(spark, d, "orders").select("o_orderkey", F.when(k == 0, "vehicle").when(k == 1, "animal").otherwise("none").alias("pool"))
    return reference.linked(rows, "o_orderkey", "pool", candidates(spark, d), "42")


@query("gps_trace", f"""WITH {STEPS_SQL}, g AS (SELECT session_id, event_id, t, 28.6139 + (session_id * 37 % 100 - 50) / 5000.0 AS lat0, 77.209 + (session_id * 53 % 100 - 50) / 5000.0 AS lon0, radians((session_id * 71 % 360)::DOUBLE) AS way FROM steps)
SELECT session_id, event_id, round(lat0 + 8.0 * t * cos(way) / 111320.0, 7) AS lat, round(lon0 + 8.0 * t * sin(way) / (111320.0 * cos(radians(lat0))), 7) AS lon FROM g""")
def gps_trace(spark, d):
    near = lambda base, k: F.lit(base) + (F.col("session_id") * k % 100 - 50) / F.lit(5000.0)
    lat, lon = reference.trace(near(28.6139, 37), near(77.209, 53), (F.col("session_id") * 71 % 360).cast("double"), "t")
    return steps(spark, d).select("session_id", "event_id", lat.alias("lat"), lon.alias("lon"))


@query("early_stop", """WITH e AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS epoch, (o_orderkey * 7919 % 20) / 20.0 AS f1, (o_orderkey * 104729 % 30) / 10.0 AS loss FROM orders),
b AS (SELECT *, NOT EXISTS (SELECT 1 FROM e p WHERE p.run = e.run AND p.epoch < e.epoch AND (p.f1 > e.f1 OR p.f1 = e.f1 AND p.loss <= e.loss)) AS is_best FROM e),
s AS (SELECT *, epoch - max(CASE WHEN is_best THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS since_best FROM b),
z AS (SELECT *, min(CASE WHEN since_best >= 3 THEN epoch END) OVER (PARTITION BY run) AS last FROM s)
SELECT run, epoch::BIGINT AS epoch, is_best, since_best::BIGINT AS since_best FROM z WHERE last IS NULL OR epoch <= last""")
def early_stop(spark, d):
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("run"), at.cast("long").alias("epoch"), ((k * 7919 % 20) / 20.0).alias("f1"), ((k * 104729 % 30) / 10.0).alias("loss"))
    return mleval.early_stopped(e, ["run"], "epoch", "f1", "loss", 3).select("run", "epoch", "is_best", F.col("since_best").cast("long").alias("since_best"))


@query("layout_scores", """WITH f AS (SELECT DISTINCT c_mktsegment AS camera, n_name AS label FROM customer JOIN nation ON c_nationkey = n_nationkey), l AS (SELECT r_name AS layout, r_regionkey AS place, n_name AS label FROM region JOIN nation ON n_regionkey = r_regionkey),
g AS (SELECT layout, place, count(*) AS score FROM l JOIN f USING (label) GROUP BY 1, 2) SELECT coalesce(arg_max(layout, score * 1000 - place), 'default') AS layout, coalesce(max(score), 0) AS score FROM g""")
def layout_scores(spark, d):
    """The region that most (segment, nation) pairs of the customers belong to, regions as layouts of every segment's nations."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    found = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("camera"), F.col("n_name").alias("label"))
    places = n.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("layout"), F.col("n_name").alias("label"), F.col("r_regionkey").alias("place"))
    return files.layout_of(found, places.join(found.distinct(), "label"), "default")


@query("frame_targets", """SELECT doc_id, f.f AS fraction, greatest(0, least(n_chars - 1, round_even(f.f::DOUBLE * (n_chars - 1), 0)::BIGINT)) AS frame FROM documents, (SELECT unnest([0.0, 0.25, 0.5, 1.0]::DOUBLE[]) AS f) f WHERE n_chars > 0""")
def frame_targets(spark, d):
    at = table(spark, d, "documents").filter("n_chars > 0").select("doc_id", "n_chars", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 1.0)])).alias("fraction"))
    return at.select("doc_id", "fraction", frame_at("fraction", "n_chars").alias("frame"))
