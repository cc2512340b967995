"""Sinks: validated append, columnar rebuild, synthetic tables, schema documents, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventloom.schemas import EVENT_SCHEMA, REAL_SOURCES, SIM_SCHEMA, VERSION, event_rules, field_checks, schema_diff, sim_validated
from eventloom.sources import commits
from eventloom.sources.progress import Checked


class Rejected(ValueError):
    """Rows or fields that the table does not take."""


def append_events(df: DataFrame, path: str, sources: tuple = REAL_SOURCES, attempts: int = 20) -> int:
    """Append valid events whose (run_id, event_id) is new, as JSON lines; all or nothing.

    The input is worked out once, into a staged folder, and its rules are counted in
    that pass; keys are looked up in what was staged.  Rows count for readers
    (``read_events``) from the commit on, which at most one of two writers with the
    same number gets: the other looks at the keys that came in between first.
    """
    spark = df.sparkSession
    if any(diff := schema_diff(df)):
        raise Rejected(f"missing, unknown, wrong type: {diff}")
    checked = Checked(df.select(*EVENT_SCHEMA.names), {**field_checks(), **event_rules(), "wrong kind of data": ~F.coalesce(F.col("data_source").isin(*sources), F.lit(False))}, "event_id")
    name, folder = commits.stage(spark, path)
    try:
        checked.df.write.option("ignoreNullFields", False).json(folder)
        if bad := checked.problems():
            raise Rejected(str(bad))
        if not checked.rows:
            commits.discard(spark, folder)
            return 0
        keys = spark.read.schema(EVENT_SCHEMA).json(folder).select("run_id", "event_id")
        if keys.groupBy("run_id", "event_id").count().filter("count > 1").limit(1).count():
            raise Rejected("a key occurs twice")
        since = 0
        for _ in range(attempts):
            number = len(commits.commits(spark, path))
            old = commits.read_json(spark, path, EVENT_SCHEMA, since).select("run_id", "event_id")
            if keys.join(old, ["run_id", "event_id"], "left_semi").limit(1).count():
                raise Rejected("a key is in the table already")
            try:
                commits.commit(spark, path, number, [name], rows=checked.rows)
                return checked.rows
            except commits.Conflict:
                since = number
        raise commits.Conflict(f"no commit in {attempts} attempts")
    except BaseException:
        commits.discard(spark, folder)
        raise


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The committed events of a table."""
    return commits.read_json(spark, path, EVENT_SCHEMA)


def replace_events(df: DataFrame, path: str, sources: tuple = REAL_SOURCES) -> int:
    """Put valid events in place of all that a table holds; readers see the old or the new rows, never some of both."""
    spark = df.sparkSession
    if any(diff := schema_diff(df)):
        raise Rejected(f"missing, unknown, wrong type: {diff}")
    checked = Checked(df.select(*EVENT_SCHEMA.names), {**field_checks(), **event_rules(), "wrong kind of data": ~F.coalesce(F.col("data_source").isin(*sources), F.lit(False))}, "event_id")
    name, folder = commits.stage(spark, path)
    try:
        checked.df.write.option("ignoreNullFields", False).json(folder)
        if bad := checked.problems():
            raise Rejected(str(bad))
        past = commits.commits(spark, path)
        commits.commit(spark, path, len(past), [name], [x.rsplit("/", 1)[-1] for x in commits.folders(spark, path)], rows=checked.rows)
    except BaseException:
        commits.discard(spark, folder)
        raise
    return checked.rows


def finalise(spark: SparkSession, jsonl: str, parquet: str) -> None:
    """Rebuild the columnar copy from the committed JSON lines, by source and run, with its schema document beside it."""
    read_events(spark, jsonl).repartition("data_source", "run_id").write.mode("overwrite").partitionBy("data_source", "run_id").parquet(parquet)
    write_text(spark, schema_document(EVENT_SCHEMA), f"{parquet.rstrip('/')}_schema")


def write_synthetic(df: DataFrame, path: str, real_root: str) -> None:
    """Synthetic rows only, and never inside the real tables' folder."""
    _guard(df, path, real_root)
    df.write.mode("overwrite").parquet(path)


def write_synthetic_table(df: DataFrame, path: str, real_root: str, manifest: dict | None = None) -> dict[str, str]:
    """A full synthetic table: JSON lines, Parquet, schema document and manifest; a stale copy is replaced.

    Takes rows of ``SIM_SCHEMA`` that break no rule; all or nothing.
    """
    _guard(df, path, real_root)
    if any(diff := schema_diff(df, SIM_SCHEMA)):
        raise Rejected(f"missing, unknown, wrong type: {diff}")
    bad = sim_validated(df).filter(F.size("problems") > 0).select("event_id", "problems").limit(5).collect()
    if bad:
        raise Rejected(str([(r["event_id"], r["problems"]) for r in bad]))
    spark, paths = df.sparkSession, {k: f"{path.rstrip('/')}/{k}" for k in ("jsonl", "parquet", "schema", "manifest")}
    df.select(*SIM_SCHEMA.names).write.mode("overwrite").option("ignoreNullFields", False).json(paths["jsonl"])
    back = spark.read.schema(SIM_SCHEMA).json(paths["jsonl"])
    back.write.mode("overwrite").parquet(paths["parquet"])
    write_text(spark, schema_document(SIM_SCHEMA), paths["schema"])
    write_text(spark, json.dumps({"schema_version": VERSION, "rows": back.count(), **(manifest or {})}), paths["manifest"])
    return paths


def _guard(df: DataFrame, path: str, real_root: str) -> None:
    if (path.rstrip("/") + "/").startswith(real_root.rstrip("/") + "/"):
        raise Rejected("synthetic rows do not go under the real root")
    if df.filter(~F.coalesce(F.col("data_source").startswith("SYNTHETIC"), F.lit(False))).limit(1).count():
        raise Rejected("real rows do not go into a synthetic table")


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small text as one file, by Spark's own file system."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_session(alerts: DataFrame, timeline: DataFrame, summary: dict, folder: str) -> dict[str, str]:
    """The outcome of a session: alerts as JSON lines, the timeline as CSV (nulls empty), the summary as JSON."""
    paths = {k: f"{folder.rstrip('/')}/{k}" for k in ("alerts", "timeline", "summary")}
    alerts.write.mode("overwrite").option("ignoreNullFields", False).json(paths["alerts"])
    timeline.write.mode("overwrite").option("header", True).csv(paths["timeline"])
    write_text(alerts.sparkSession, json.dumps(summary), paths["summary"])
    return paths


def schema_document(schema: StructType = EVENT_SCHEMA) -> str:
    fields = [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable, **f.metadata} for f in schema]
    return json.dumps({"schema_version": VERSION, "fields": fields}, indent=2)


def write_long(df: DataFrame, path: str) -> None:
    """A report's small long table as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def cell(text) -> str:
    """Text safe inside a Markdown table."""
    return str("not recorded" if text is None or text == "" else text).replace("|", "/").replace("\n", " ")


def markdown_table(df: DataFrame, limit: int | None = None) -> str:
    """A small result as a Markdown table, its rows in order; with a limit the last line says how many are left out."""
    rows = (df if limit is None else df.limit(limit + 1)).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    lines = ["| " + " | ".join(cell(v) for v in r) + " |" for r in (rows if limit is None else rows[:limit])]
    if limit is not None and len(rows) > limit:
        lines.append(f"\n{df.count() - limit} more rows are not shown.")
    return "\n".join([head, *lines])
