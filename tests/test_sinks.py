"""Appends that are all or nothing, counts of the same pass, exact line order, and alert sinks across crashes."""

from __future__ import annotations

import io
import json

import pytest
from pyspark.sql import functions as F

from eventloom import schemas
from eventloom.sources import commits, progress, readers, writers
from eventloom.streaming import sinks
from tests.test_operators import EVENTS, record


def events(spark, rows=None):
    return spark.createDataFrame([record(e) for e in (EVENTS if rows is None else rows)], schemas.EVENT_SCHEMA)


def renamed(df, tag):
    return df.withColumn("event_id", F.concat(F.lit(tag), "event_id"))


# ---------------------------------------------------------------- appends


def test_append_that_fails_leaves_the_table_as_it_was(spark, tmp_path):
    path, df = f"{tmp_path}/events", events(spark)
    assert writers.append_events(df, path) == 8
    boom = F.udf(lambda x: 1 / 0, "string")
    for wrong, why in ((renamed(df, "b").withColumn("source_file", boom("run_id")), Exception), (renamed(df, "c").withColumn("camera", F.lit(None).cast("string")), writers.Rejected), (df, writers.Rejected), (renamed(df, "x").unionAll(renamed(df, "x")), writers.Rejected)):
        with pytest.raises(why):
            writers.append_events(wrong, path)
        assert writers.read_events(spark, path).count() == 8 and len(commits.commits(spark, path)) == 1
    # What a lost writer staged without a commit is not read.
    events(spark).write.json(commits.stage(spark, path)[1])
    assert writers.read_events(spark, path).count() == 8
    assert writers.append_events(renamed(df, "d"), path) == 8
    assert writers.read_events(spark, path).select("run_id", "event_id").distinct().count() == 16
    assert writers.append_events(df.limit(0), path) == 0 and len(commits.commits(spark, path)) == 2


def test_append_reads_its_input_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = events(spark)
    assert writers.append_events(df.mapInArrow(look, df.schema), f"{tmp_path}/e") == 8
    assert seen.value == 8


def test_of_two_writers_one_gets_the_number(spark, tmp_path, monkeypatch):
    """While one writer is between its check and its commit another commits: with new keys it goes on, with the same keys it is refused."""
    path, df = f"{tmp_path}/events", events(spark)
    writers.append_events(df, path)
    real, other = commits.commit, {"rows": renamed(df, "o")}

    def late(spark_, table, number, adds, drops=None, **facts):
        if other:
            rows = other.pop("rows")
            monkeypatch.setattr(commits, "commit", real)
            writers.append_events(rows, path)
        return real(spark_, table, number, adds, drops, **facts)

    monkeypatch.setattr(commits, "commit", late)
    assert writers.append_events(renamed(df, "m"), path) == 8
    assert writers.read_events(spark, path).count() == 24
    other["rows"] = renamed(df, "p")
    monkeypatch.setattr(commits, "commit", late)
    with pytest.raises(writers.Rejected):
        writers.append_events(renamed(df, "p"), path)
    assert writers.read_events(spark, path).count() == 32
    with pytest.raises(commits.Conflict):
        commits.commit(spark, path, 0, ["x"])


def test_replace_and_columns(spark, tmp_path):
    path, df = f"{tmp_path}/events", events(spark)
    writers.append_events(df, path)
    writers.append_events(renamed(df, "a"), path)
    assert writers.replace_events(renamed(df, "b"), path) == 8
    assert {r[0][0] for r in writers.read_events(spark, path).select("event_id").collect()} == {"b"}
    writers.finalise(spark, path, f"{tmp_path}/columns")
    assert spark.read.parquet(f"{tmp_path}/columns").count() == 8
    assert len(json.loads("\n".join(r.value for r in spark.read.text(f"{tmp_path}/columns_schema").collect()))["fields"]) == 60


def test_markdown_says_what_it_leaves_out(spark):
    d = spark.range(300).orderBy("id")
    assert writers.markdown_table(d).count("\n") == 301
    assert writers.markdown_table(d, 200).endswith("100 more rows are not shown.")


# ---------------------------------------------------------------- counts in the same pass


def test_counts_equal_those_of_a_scan_of_their_own(spark):
    d = events(spark).withColumn("camera", F.when(F.col("event_id") > "4", F.col("camera"))).withColumn("notes", F.lit("{"))
    rules = {**schemas.field_checks(), **schemas.event_rules()}
    want = {r.problem: r.n for r in schemas.validated(d).select(F.explode("problems").alias("problem")).groupBy("problem").agg(F.count("*").alias("n")).collect()}
    checked = progress.Checked(d, rules, "event_id")
    checked.df.write.format("noop").mode("overwrite").save()
    assert checked.rows == 8 and {k: n for k, (n, _) in checked.problems().items()} == want and want
    assert checked.problems()["camera: null"][1] == "1"


def test_progress_of_streams(spark, tmp_path):
    p = progress.Progress()
    spark.streams.addListener(p)
    try:
        for i in range(3):
            spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").observe("o", F.count_if(F.col("id") % 2 == 0).alias("even"))
        q = s.writeStream.format("noop").queryName("counted").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(50):
            if p.rows["counted"] == 30:
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(p)
    assert (p.batches["counted"], p.rows["counted"], p.observed["counted"]["even"]) == (3, 30, 15)


# ---------------------------------------------------------------- line order


@pytest.mark.parametrize("size", ["64", "300", "1m"])
def test_first_wins_whatever_the_split(spark, tmp_path, size):
    """Repeated events in two files, cut into ranges of any size: the first line of the first file wins, as for a plain reader."""
    lines, first = [], {}
    for f in range(2):
        rows = [record(EVENTS[0]) | {"event_id": f"e{(i * 7 + f) % 40}", "source_file": f"{f}-{i}", "notes": "[]"} for i in range(120)]
        text = "".join(json.dumps(r) + "\n" for r in rows)
        (tmp_path / f"{f}.jsonl").write_text(text)
        lines += rows
        for r in rows:
            first.setdefault(r["event_id"], r["source_file"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        loaded = readers.load_events(spark, [f"{tmp_path}/0.jsonl", f"{tmp_path}/1.jsonl"])
        assert {r.event_id: r.source_file for r in loaded.events.collect()} == first
        assert loaded.duplicates.head()[0] == len(lines) - len(first)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


# ---------------------------------------------------------------- alert sinks


def level_stream(spark, tmp_path):
    rows = [(s, float(i), ["SAFE", "CAUTION", "HIGH", "CRITICAL"][(i + s) % 4], ["SAFE", "CAUTION", "HIGH", "CRITICAL"][(i + s + 1) % 4]) for s in range(2) for i in range(12)]
    d = spark.createDataFrame(rows, "session_id int, t double, previous string, level string")
    for i in range(4):
        d.filter((F.col("t") >= 3 * i) & (F.col("t") < 3 * i + 3)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/levels")
    return d, sinks.alert_rows(spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/levels"), "session_id", "t")


@pytest.mark.parametrize("crash", ["before", "after"])
def test_no_alert_is_lost_or_doubled_by_a_crash(spark, tmp_path, crash):
    """A sink dies in the third batch, before or after it wrote; started again, every sink has every alert once."""
    d, stream = level_stream(spark, tmp_path)
    write, bell, dead = sinks.json_sink(f"{tmp_path}/alerts"), sinks.Bell(), []

    def dies(rows, batch):
        if crash == "after":
            write(rows, batch)
        if batch == 2 and not dead:
            dead.append(batch)
            raise RuntimeError("lost")
        if crash == "before":
            write(rows, batch)

    own = {"bell": bell, "csv": sinks.csv_sink(f"{tmp_path}/timeline"), "json": dies}
    with pytest.raises(Exception):
        sinks.fan_out(stream, own, f"{tmp_path}/ledger", f"{tmp_path}/check").awaitTermination()
    assert dead == [2]
    sinks.fan_out(stream, own, f"{tmp_path}/ledger", f"{tmp_path}/check").awaitTermination()
    sinks.fan_out(stream, own, f"{tmp_path}/ledger", f"{tmp_path}/check").awaitTermination()
    want = sorted((r.session_id, r.t) for r in d.collect())
    alerts = spark.read.json(f"{tmp_path}/alerts")
    assert sorted((r.session_id, r.t) for r in alerts.collect()) == want
    assert sorted((int(r.session_id), float(r.t)) for r in spark.read.option("header", True).csv(f"{tmp_path}/timeline").collect()) == want
    # CAUTION -> HIGH rings once, HIGH -> CRITICAL three times, in both sessions and all rounds; the bell had noted the batch that died.
    loud = alerts.filter(F.array_contains("channels", "sound"))
    assert bell.rings == loud.filter("severity = 'MEDIUM'").count() + 3 * loud.filter("severity = 'HIGH'").count() > 0


def test_console_says_what_it_leaves_out(spark, tmp_path):
    _, stream = level_stream(spark, tmp_path)
    out = io.StringIO()
    sinks.fan_out(stream, {"console": sinks.console_sink(4, out)}, f"{tmp_path}/ledger", f"{tmp_path}/check").awaitTermination()
    text = out.getvalue()
    assert text.count("Risk up") + text.count("Risk down") == 16 and text.count("... and 2 more") == 4
