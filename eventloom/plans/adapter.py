"""The provided tables seen as sensor sessions; the same arithmetic in Spark and in SQL.

``steps``: one row per event; session = user, t = hours since the session began,
x = value up to 100 as a score, raw = its level.  ``boxes``: one box per event in
frames of a day.  ``log``: steps as an event table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.config import RiskSettings
from eventloom.functions.columns import level_for_score, level_name
from eventloom.operators.ordered import level_transitions

#: Seconds become hours: a day's window, two days' gap, a point an hour.
HOURS = RiskSettings(window=24.0, min_span=6.0, decay=1.0, reset_gap=48.0)

STEPS_SQL = """
steps AS (
  SELECT user_id AS session_id, event_id, event_type, value, props, t, x,
         CASE WHEN x >= 70 THEN 3 WHEN x >= 45 THEN 2 WHEN x >= 20 THEN 1 ELSE 0 END AS raw
  FROM (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3.6e9 AS t, least(value, 100.0) AS x FROM events)
)"""
LEVEL = "CASE {0} WHEN 0 THEN 'SAFE' WHEN 1 THEN 'CAUTION' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    t = (us - F.min(us).over(Window.partitionBy("user_id"))) / F.lit(3.6e9)
    e = e.select(F.col("user_id").alias("session_id"), "event_id", "event_type", "value", "props", t.alias("t"), F.least("value", F.lit(100.0)).alias("x"))
    return e.withColumn("raw", level_for_score("x"))


BOXES_SQL = """
boxes AS (
  SELECT session_id, event_id, event_type AS class_name, t, CAST(floor(t / 24) AS BIGINT) AS frame, (event_id * 37) % 400 / 1.0 AS x1, (event_id * 53) % 300 / 1.0 AS y1,
         (event_id * 37) % 400 + 60.0 + (event_id * 7) % 90 AS x2, (event_id * 53) % 300 + 50.0 + (event_id * 11) % 80 AS y2
  FROM steps
)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lambda k, n: ((F.col("event_id") * k) % n).cast("double")
    s = steps(spark, sf_dir).select("session_id", "event_id", F.col("event_type").alias("class_name"), "t", F.floor(F.col("t") / 24).cast("long").alias("frame"))
    return s.withColumns({"x1": m(37, 400), "y1": m(53, 300), "x2": m(37, 400) + 60.0 + m(7, 90), "y2": m(53, 300) + 50.0 + m(11, 80)})


LOG_SQL = """
changes AS (
  SELECT session_id, event_id, event_type AS src, t, x, raw, lag(raw, 1, 0) OVER (PARTITION BY session_id ORDER BY t, event_id) AS prev FROM steps
),
log AS (
  SELECT session_id, event_id, src, t AS timestamp, x AS smoothed_risk_score,
         CASE raw WHEN 0 THEN 'SAFE' WHEN 1 THEN 'CAUTION' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level,
         CASE prev WHEN 0 THEN 'SAFE' WHEN 1 THEN 'CAUTION' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS previous_risk_level,
         CASE WHEN raw > prev THEN 'RISK_ESCALATED' ELSE 'RISK_DEESCALATED' END AS event_type,
         CASE src WHEN 'view' THEN 'PEDESTRIAN_CONFLICT' WHEN 'click' THEN 'APPROACHING_VEHICLE' WHEN 'purchase' THEN 'ANIMAL_HAZARD' WHEN 'error' THEN 'DRIVER_DROWSINESS' END AS hazard_type
  FROM changes WHERE raw <> prev
)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level changes of the steps as an event table."""
    s = steps(spark, sf_dir).withColumn("level", level_name("raw")).withColumnRenamed("event_type", "src")
    e = level_transitions(s, ["session_id"], ["t", "event_id"], "level")
    names = {"view": "PEDESTRIAN_CONFLICT", "click": "APPROACHING_VEHICLE", "purchase": "ANIMAL_HAZARD", "error": "DRIVER_DROWSINESS"}
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("src"))
    return e.select("session_id", "event_id", F.col("t").alias("timestamp"), F.col("x").alias("smoothed_risk_score"), F.col("level").alias("risk_level"), F.col("previous").alias("previous_risk_level"), "event_type", "transition", kind.alias("hazard_type"), "src")


def full_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with the report's other columns."""
    return log(spark, sf_dir).withColumns(
        {
            "run_id": F.lit("run_001"), "data_source": F.lit("LOCAL_REAL"), "raw_risk_score": F.col("smoothed_risk_score"), "alarm_recommended": F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("risk_level").isin("HIGH", "CRITICAL")), "alarm_triggered": F.lit(False),
            "change_kind": F.lit(None).cast("string"), "evidence_path": F.lit(None).cast("string"), "hazard_persistence": F.lit(None).cast("double"), "track_persistence_seconds": F.lit(None).cast("double"), "ordinal": F.col("event_id"),
        }
    )
