"""Imports every module that registers queries; holds the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.columns import level_name
from eventloom.operators import folds, ordered
from eventloom.plans import model_queries, record_queries, reference_queries, report_queries, risk_queries, sequence_queries, signal_queries, stream_queries, table_queries  # noqa: F401
from eventloom.plans.adapter import HOURS, STEPS_SQL, steps
from eventloom.plans.registry import query
from eventloom.plans.sequence_queries import HYST_SQL

FLAGSHIP_SQL = (
    HYST_SQL.rsplit("SELECT session_id, event_id, raw, level FROM h", 1)[0]
    + """, l AS (SELECT h.session_id, h.event_id, h.level, s.t, lag(h.level, 1, 0) OVER (PARTITION BY h.session_id ORDER BY s.t, h.event_id) AS prev FROM h JOIN steps s USING (event_id))
SELECT session_id, count(*) AS steps, max(level) AS peak, count(*) FILTER (level > prev) AS escalations, count(*) FILTER (level < prev) AS deescalations, count(*) FILTER (level >= 2) AS elevated_steps FROM l GROUP BY 1"""
)


@query("session_risk_report", FLAGSHIP_SQL)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per session: score -> level -> hysteresis -> changes -> counts."""
    s = steps(spark, sf_dir).select("session_id", "event_id", "t", "raw")
    h = folds.hysteresis(s, ["session_id"], ["t", "event_id"], "t", "raw", HOURS)
    h = h.withColumn("prev", F.lag("level", 1, 0).over(ordered.ordered(["session_id"], ["t", "event_id"])))
    return h.groupBy("session_id").agg(
        F.count("*").alias("steps"), F.max("level").alias("peak"), F.count_if(F.col("level") > F.col("prev")).alias("escalations"), F.count_if(F.col("level") < F.col("prev")).alias("deescalations"), F.count_if(F.col("level") >= 2).alias("elevated_steps")
    )
