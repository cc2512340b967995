"""Streams against their batch forms: any cut into micro-batches, late rows, silence, restarts, and what state is left."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from eventloom.config import DriverSettings, TrackSettings
from eventloom.operators import driver, folds, tracker
from eventloom.streaming import stateful
from eventloom.streaming.evidence import release_evidence
from eventloom.streaming.eyes import eye_stream
from eventloom.streaming.joins import backward_tail, backward_within
from eventloom.streaming.replay import END, replay, run_to_table
from eventloom.streaming.tracks import match_stream

S = 1_000_000


def at(seconds):
    return F.timestamp_micros((F.lit(1_700_000_000 * S) + F.round(F.col(seconds) * S)).cast("long"))


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def play(spark, tmp_path, name, parts, schema):
    """A stream of one micro-batch a part."""
    folder = str(tmp_path / name)
    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(folder)




FRAMES = "session_id long, frame_id long, t double, event boolean"


def frames(seed=1, sessions=4, n=60):
    rng, rows = random.Random(seed), []
    for s in range(sessions):
        t = rng.random()
        for i in range(n):
            t = round(t + rng.choice([0.1, 0.2, 0.5, 1.0, 1.0, 25.0 if rng.random() < 0.2 else 0.3]), 3)
            rows.append((s, s * 1000 + i, t, rng.random() < 0.2))
            if rng.random() < 0.1:
                rows.append((s, s * 1000 + i + 500, t, rng.random() < 0.5))
    return rows


def plain_evidence(rows, before, after, timeout):
    out = []
    for s in {r[0] for r in rows}:
        own, parts = sorted((round(r[2] * S), r[1], r[3]) for r in rows if r[0] == s), []
        for r in own:
            if not parts or r[0] - parts[-1][-1][0] > timeout:
                parts.append([])
            parts[-1].append(r)
        for part in parts:
            for us, i, event in part:
                if event:
                    got = [x[1] for x in part if us - before <= x[0] <= us + after]
                    later = [x[0] for x in part if x[0] > us + after]
                    out.append((s, i, sorted(got), later[0] if later else part[-1][0] + timeout, part[-1][0] < us + after))
    return sorted(out)


@pytest.mark.parametrize("slices", [1, 5])
def test_evidence_is_released_alike_for_any_cut(spark, slices):
    rows = frames()
    d = spark.createDataFrame(rows, FRAMES).withColumn("ts", at("t"))
    s, late = replay(d, "ts", "session_id", slices, "1 minute")
    out = run_to_table(release_evidence(s, "session_id", "ts", "frame_id", F.col("event"), 2 * S, 2 * S, 20 * S, late), "ev").filter(F.col("session_id") != END)
    got = sorted((r.session_id, r.event_id, sorted(r.frames), r.released_us - 1_700_000_000 * S, r.truncated) for r in out.collect())
    assert got == plain_evidence(rows, 2 * S, 2 * S, 20 * S)
    assert any(r[4] for r in got) and any(not r[4] for r in got)


def test_evidence_waits_and_keeps_no_state_after_silence(spark, tmp_path):
    """Nothing is told before the window is over; a row behind the watermark is dropped; a silent session leaves no state."""
    mk = lambda *rows: [(1, i, t, e) for i, t, e in rows]
    parts = [mk((1, 0.0, False), (2, 1.0, True)), mk((3, 2.0, False), (4, 2.5, False)), mk((5, 9.0, False)), mk((6, 1.5, False), (7, 9.5, False)), [(2, 8, 500.0, False)], [(2, 9, 900.0, False)]]
    folder, sink, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    spark.createDataFrame(parts[0], FRAMES).withColumn("ts", at("t")).write.parquet(folder)
    schema = spark.read.parquet(folder).schema
    told = []
    for i, p in enumerate(parts):
        if i:
            spark.createDataFrame(p, FRAMES).withColumn("ts", at("t")).coalesce(1).write.mode("append").parquet(folder)
        s = spark.readStream.schema(schema).parquet(folder)
        out = run_to_table(release_evidence(s, "session_id", "ts", "frame_id", F.col("event"), 2 * S, 2 * S, 20 * S, "0 seconds"), "ev", check, sink)
        told.append([(r.event_id, r.frames, r.truncated) for r in out.collect()])
    # Each call above goes on from the checkpoint of the one before, as after a restart.
    assert told[0] == told[1] == []
    assert told[-1] == [(2, [1, 2, 3, 4], False)]
    left = spark.read.format("statestore").option("stateVarName", "ring").load(check)
    assert {r.key[0] for r in left.select("key").collect()} <= {2}


def test_asof_streams_match_and_drop_late_rows(spark, tmp_path):
    rng = random.Random(3)
    left = [(s, s * 1000 + i, round(rng.uniform(0, 100), 3)) for s in range(3) for i in range(30)]
    right = [(s, s * 1000 + i, round(rng.uniform(0, 60), 3)) for s in range(2) for i in range(20)]
    a = spark.createDataFrame(left, "session_id long, id long, t double").withColumn("ts", at("t"))
    b = spark.createDataFrame(right, "session_id long, fix long, t double").withColumn("rts", at("t"))
    best = lambda s, t, ok: max(((u, f) for k, f, u in right if k == s and u <= t and ok(u, t)), default=(None, None))[1]
    sa, la = replay(a, "ts", "session_id", 3, "1 hour")
    sb, lb = replay(b, "rts", "session_id", 4, "1 hour")
    late = max(la, lb, key=lambda x: int(x.split()[0]))
    got = run_to_table(backward_within(sa, sb, ["session_id"], "id", "ts", "rts", ["fix"], "5 SECONDS", late), "asof").filter(F.col("session_id") != END)
    assert {(r.session_id, r.id): r.fix for r in got.collect()} == {(s, i): best(s, t, lambda u, t: t - u <= 5) for s, i, t in left}
    both = a.select("session_id", "id", F.lit(None).cast("long").alias("fix"), "ts").unionByName(b.select("session_id", F.lit(None).cast("long").alias("id"), "fix", F.col("rts").alias("ts")))
    s, late = replay(both, "ts", "session_id", 4, "1 hour")
    tail = backward_tail(s.filter("id IS NOT NULL"), s.filter("fix IS NOT NULL OR id IS NULL"), ["session_id"], "id", "ts", "ts", ["fix"], 10 * S, 3000 * S, late)
    got = run_to_table(tail, "tail").filter(F.col("session_id") != END)
    end = {s: max(u for k, _, u in right if k == s) for s in range(2)}
    assert {(r.session_id, r.left_id): r.fix for r in got.collect()} == {(s, i): best(s, t, lambda u, t: t <= end.get(s, -99) + 10) for s, i, t in left}


def test_interval_join_drops_rows_behind_the_watermark(spark, tmp_path):
    """A fix that comes after its side's watermark has passed it is not taken."""
    schema = "session_id long, id long, t double"
    early, late = [(1, 1, 100.0), (1, 2, 200.0)], [(1, 3, 99.0)]
    s = play(spark, tmp_path, "r", [early, late, [(1, 4, 9999.0)]], schema).withColumn("ts", at("t"))
    a = play(spark, tmp_path, "l", [[(1, 10, 101.0)], [(1, 11, 199.0)], [(1, 12, 9999.0)]], schema).withColumn("ts", at("t"))
    right = s.select("session_id", F.col("id").alias("fix"), "ts")
    got = run_to_table(backward_within(a, right, ["session_id"], "id", "ts", "ts", ["fix"], "30 SECONDS", "5 seconds"), "drop")
    got = {r.id: r.fix for r in got.collect()}
    assert got.get(10) == 1 and 3 not in got.values()


DETS = "session_id long, ts double, frame_index int, det_ix int, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double"


def detections(seed=2, sessions=3, n=40):
    rng, rows = random.Random(seed), []
    for s in range(sessions):
        boxes, t = [[rng.uniform(0, 300), rng.uniform(0, 300), "dog"] for _ in range(3)], 0.0
        for i in range(n):
            t = round(t + (0.1 if rng.random() < 0.95 else 1.4), 1)
            if rng.random() < 0.1:
                rows.append((s, t, i, 0, None, None, None, None, None, None))
                continue
            for j, b in enumerate(boxes):
                b[0], b[1] = b[0] + rng.uniform(-9, 12), b[1] + rng.uniform(-9, 12)
                if rng.random() < 0.8:
                    rows.append((s, t, i, j, rng.choice(["dog", "dog", "person"]), round(rng.random(), 2), b[0], b[1], b[0] + 40, b[1] + 60))
            if rng.random() < 0.1:
                boxes[rng.randrange(3)] = [rng.uniform(0, 300), rng.uniform(0, 300), "dog"]
    return rows


@pytest.mark.parametrize("slices", [2, 6])
def test_tracks_are_those_of_the_batch_for_any_cut(spark, slices):
    d = spark.createDataFrame(detections(), DETS)
    want = rows_of(tracker.track(d))
    s, late = replay(d.withColumn("time", at("ts")), "time", "session_id", slices, "1 hour")
    steps = run_to_table(match_stream(s, "session_id", "time", 1000 * S, late), "steps").filter(F.col("session_id") != END)
    assert rows_of(tracker.described(steps)) == want
    assert steps.filter("ended").count() == steps.select("session_id", "track_id").distinct().count()


def test_track_state_is_that_of_the_live_tracks(spark, tmp_path):
    """After many frames of boxes that come and go only the live ones are held; the session's end holds none."""
    rows = [(1, round(i * 0.5, 1), i, 0, "dog", 0.5, 100.0 * i, 0.0, 100.0 * i + 50, 50.0) for i in range(40)]
    check, sink, folder = (str(tmp_path / x) for x in ("check", "sink", "in"))
    d = spark.createDataFrame(rows, DETS).withColumn("time", at("ts"))
    d.coalesce(1).write.parquet(folder)

    def go():
        s = spark.readStream.schema(d.schema).parquet(folder)
        run_to_table(match_stream(s, "session_id", "time", 60 * S, "0 seconds", TrackSettings(max_missed=1.0)), "t", check, sink)
        return spark.read.format("statestore").option("stateVarName", "live").load(check).count()

    assert 1 <= go() <= 4
    spark.createDataFrame([(2, 500.0, 0, 0, "cat", 0.5, 0.0, 0.0, 9.0, 9.0)], DETS).withColumn("time", at("ts")).coalesce(1).write.mode("append").parquet(folder)
    assert go() <= 1
    assert spark.read.parquet(sink).filter("session_id = 1 AND ended").count() == 40


@pytest.mark.parametrize("slices", [1, 5])
def test_eye_windows_are_those_of_the_batch(spark, slices):
    rng, rows = random.Random(5), []
    for s in range(3):
        t = 0.0
        for i in range(150):
            t = round(t + rng.choice([0.1, 0.1, 0.1, 0.3, 0.9]), 3)
            rows.append((s, i, t, rng.choice([True, True, False, None])))
    cfg = DriverSettings(window=6.00037, max_gap=0.50013, blink=0.25017, long=0.50011)
    d = spark.createDataFrame(rows, "session_id long, event_id long, t double, closed boolean")
    want = driver.eye_features(d, ["session_id"], ["t", "event_id"], "t", "closed", cfg)
    s, late = replay(d.withColumn("ts", at("t")), "ts", "session_id", slices, "1 hour")
    got = run_to_table(eye_stream(s, "session_id", "ts", "event_id", "closed", S, 1000 * S, late, cfg), "eyes").filter(F.col("session_id") != END)
    cols = ["session_id", "event_id", "blinks", "long_closures", *[F.round(c, 6) for c in ("observed_seconds", "positive_seconds", "closed_seconds", "missing_seconds")]]
    assert rows_of(got.select(*cols)) == rows_of(want.select(*cols))
    assert got.agg(F.sum("blinks")).head()[0] > 0 and got.agg(F.sum("long_closures")).head()[0] > 0


@pytest.mark.parametrize("slices", [1, 4])
def test_folds_are_those_of_the_batch(spark, slices):
    """Hysteresis, cooldown, sampling, printing and debounce for any cut; unknown, null and empty states among the values."""
    rng = random.Random(4)
    rows, t = [], 0.0
    for s in range(3):
        for i in range(60):
            t = round(t + rng.choice([0.25, 0.5, 1.0, 3.0]), 3)
            rows.append((s, i, t, rng.randrange(4), rng.choice(["A", "A", "B", "B", "", None, "UNKNOWN"])))
    d = spark.createDataFrame(rows, "session_id long, i long, t double, raw int, v string").withColumn("ts", at("t"))
    keys, order, far = ["session_id"], ["t", "i"], 10_000 * S
    stream, late = replay(d, "ts", "session_id", slices, "4 hours")
    live = stream.fillna({"raw": 0, "t": 0.0})
    done = lambda x, name: run_to_table(x, name).filter(F.col("session_id") != END)
    pairs = [
        (stateful.hysteresis_stream(live, keys, "ts", "t", "raw", "i", far, late), folds.hysteresis(d.select("session_id", "i", "t", "raw"), keys, order, "t", "raw"), ["session_id", "i", "level"]),
        (stateful.cooldown_stream(live, keys, "ts", "t", "i", 7.0, far, late), folds.cooldown(d.select("session_id", "i", "t"), keys, order, "t", 7.0), ["session_id", "i"]),
        (stateful.sampled_stream(live, keys, "ts", "t", "i", 0.4, far, late), folds.sampled(d.select("session_id", "i", "t"), keys, order, "t", 0.4), ["session_id", "i"]),
        (stateful.emitted_stream(live, keys, "ts", "t", "v", "i", 4.0, far, late), folds.emitted_on_change(d.select("session_id", "i", "t", "v"), keys, order, "t", "v", 4.0), ["session_id", "i"]),
        (stateful.debounce_stream(live, keys, "ts", "v", "i", far, late), folds.debounced(d, keys, order, "v", 3).withColumn("value", F.col("v")), ["session_id", "i", "previous", "value"]),
    ]
    for k, (got, want, cols) in enumerate(pairs):
        assert rows_of(done(got, f"fold{k}").select(*cols)) == rows_of(want.select(*cols)) and want.count()
