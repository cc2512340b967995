"""Plans, fingerprints, places in groups, and the file audit on small fixtures."""

from __future__ import annotations

import hashlib
import json
import random

from pyspark.sql import functions as F

from eventloom.functions import columns
from eventloom.operators import audit, files, ordered, records, reference, report
from eventloom.sources import readers


def test_plan_problems(spark):
    have = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "3"), ("e", "5")], "item string, h string")
    plan = [("a", "1", "train", "x"), ("b", "9", "train", "x"), ("c", "3", "train", "y"), ("d", "3", "test", "x"), ("e", "5", "other", ""), ("e", "5", "test", "y"), ("z", "7", None, "y")]
    got = files.plan_problems(spark.createDataFrame(plan, "item string, h string, split string, label string"), have, "item", "h", "split", "label", ["train", "test"])
    assert sorted((r.problem, r.item, r.n) for r in got.collect()) == [
        ("content in several splits", "c", 2), ("content in several splits", "e", 2), ("content under several labels", "c", 2), ("content under several labels", "e", 2), ("no file", "z", 1), ("no label", "e", 1),
        ("other content", "b", 1), ("twice", "e", 2), ("unknown split", "e", 1), ("unknown split", "z", 1),
    ]
    sound = spark.createDataFrame([("a", "1", "train", "x"), ("b", "2", "test", "x")], "item string, h string, split string, label string")
    assert files.plan_problems(sound, have, "item", "h", "split", "label", ["train", "test"]).count() == 0
    assert [(r.problem, r.item, r.n) for r in files.plan_problems(sound, have, "item", "h", "split", "label", ["train", "test"], 2).orderBy("item").collect()] == [("too few", "test/x", 1), ("too few", "train/x", 1)]


def test_fingerprints_tell_tables_apart(spark):
    rows = [(i, None if i % 7 == 0 else f"t{i}") for i in range(200)] + [(1, "t1")]
    of = lambda r: spark.createDataFrame(r, "a int, b string")
    mark = lambda d: tuple(files.fingerprint(d, ["a", "b"]).head())
    shuffled = random.Random(1).sample(rows, len(rows))
    assert mark(of(rows)) == mark(of(shuffled).repartition(7))
    for other in (rows[:-1], [*rows, rows[3]], [*rows[:-1], (1, None)], [*rows[:-1], (1, "")], [*rows[:-1], (2, "t1")]):
        assert mark(of(other)) != mark(of(rows))
    assert files.fingerprint(of([]), ["a"]).head()[0] == 0


def test_places_in_a_group_of_any_size(spark):
    rng = random.Random(2)
    rows = [("big", i) for i in rng.sample(range(100_000), 3000)] + [("s", 5), ("s", 1), (None, 3), (None, 2)]
    got = {(r.g, r.x): r.at for r in ordered.numbered_places(spark.createDataFrame(rows, "g string, x int").repartition(6), ["g"], ["x"], "at").collect()}
    want = {}
    for g in ("big", "s", None):
        want |= {(g, x): i for i, x in enumerate(sorted(x for k, x in rows if k == g))}
    assert got == want


def test_pool_ranges_have_exact_medians(spark):
    rows = [("vehicle", float(i), 0.1 * i, None, 1.0, None, None) for i in range(4)] + [("drowsy", None, None, None, None, None, 0.25), ("drowsy", None, None, None, None, None, 0.75)]
    d = spark.createDataFrame(rows, "pool string, area_fraction double, center_x_norm double, hazard_confidence double, box_growth_per_second double, lateral_toward_center_fw_per_s double, drowsiness_score double")
    got = {(r.pool, r.field): (r.n, r["min"], r["median"], r["max"]) for r in reference.pool_ranges(d).collect()}
    assert got == {("vehicle", "area_fraction"): (4, 0.0, 1.5, 3.0), ("vehicle", "center_x_norm"): (4, 0.0, 0.15, 0.3), ("vehicle", "box_growth_per_second"): (4, 1.0, 1.0, 1.0), ("drowsy", "drowsiness_score"): (2, 0.25, 0.5, 0.75)}


FILE = "path string, camera string, label string, kind string, extension string, size_bytes long, readable boolean, width int, height int, format string, exif_orientation int, duration_s double, fps double, codec string, rotation_meta int, frame_count long, sha256 string"


def test_audit(spark, tmp_path):
    image = lambda path, label, w, h, sha, readable=True, exif=1, size=10, camera="driver_cam": (path, camera, label, "image", ".jpg", size, readable, w, h, "JPEG", exif, None, None, None, None, None, sha)
    film = lambda path, label, secs, rot=0, w=640: (path, "driver_cam", label, "video", ".mp4", 99, True, w, 480, None, None, secs, 25.0, "H264", rot, 10, path)
    rows = [
        image("a", "both_hands", 1920, 1080, "s1"), image("b", "no_hands", 1080, 1920, "s1"), image("c", "no_hands", 800, 600, "s2", exif=6), image("d", "no_hands", None, None, "s3", readable=False), image("e", "no_hands", None, None, None, readable=False, size=0),
        film("f", "drowsy", 2.5), film("g", "both_hands", None, rot=90, w=1280), ("h", "driver_cam", "drowsy", "image", ".png", 5, True, 10, 10, "PNG", 1, None, None, None, None, None, "s9"),
        ("x.txt", None, None, "unsupported", ".txt", 3, None, None, None, None, None, None, None, None, None, None, "s8"), ("y", "front_cam", "odd", "ignored", "", 0, None, None, None, None, None, None, None, None, None, None, None),
    ]
    f = spark.createDataFrame(rows, FILE)
    top = audit.folder_counts(f, ["camera", "label"]).filter("level = 3").head().asDict()
    assert {k: top[k] for k in audit.file_counts()} == {"files": 10, "images": 6, "videos": 2, "unsupported": 1, "ignored_system_files": 1, "empty": 2, "corrupt": 1, "readable_images": 4, "readable_videos": 2}
    assert audit.folder_counts(f, ["camera", "label"]).filter("label = 'no_hands'").head()["corrupt"] == 1
    assert audit.image_figures(f).head().asDict() == {"total": 6, "readable": 4, "min_dimensions": "10x10", "max_dimensions": "1920x1080", "distinct_dimensions": 4, "exif_rotated": 1}
    shares = {(r.category, r.key): r.n for r in audit.image_shares(f).collect()}
    assert shares["aspect_ratios", "16:9"] == shares["aspect_ratios", "9:16"] == shares["aspect_ratios", "4:3"] == shares["orientation", "square"] == 1 and shares["extensions", ".jpg"] == 5
    assert audit.video_figures(f).head().asDict() == {"total": 2, "readable": 2, "total_duration_s": 2.5, "without_duration": 1}
    want = spark.createDataFrame([("driver_cam", x) for x in ("both_hands", "one_hand", "no_hands", "drowsy")], "camera string, label string")
    got = {(r.issue, r.place): r.n for r in audit.audit_issues(f, want).collect()}
    assert got == {
        ("missing folder", "driver_cam/one_hand"): 1, ("unexpected folder", "front_cam/odd"): 1, ("outside class folders", None): 1, ("unsupported", None): 1, ("empty", None): 2, ("corrupt", None): 1, ("duplicate groups", None): 1, ("duplicate files", None): 1,
        ("duplicates across labels", None): 1, ("films among pictures", "driver_cam/both_hands"): 1, ("pictures among films", "driver_cam/drowsy"): 1, ("several dimensions", None): 4, ("mixed orientation", None): 3, ("turned pictures", None): 1,
        ("several resolutions", None): 2, ("turned films", None): 1, ("films without duration", None): 1,
    }
    assert audit.audit_issues(f.limit(0), want.limit(0)).count() == 0
    paths = report.write_audit(f, want, str(tmp_path))
    text = "\n".join(r.value for r in spark.read.text(paths["issues_md"]).collect())
    assert "| missing folder | driver_cam/one_hand | 1 |" in text and "- max dimensions: 1920x1080" in text
    assert len(json.loads(spark.read.text(paths["issues_json"]).first().value)["issues"]) == len(got)
    assert spark.read.option("header", True).csv(paths["folders_csv"]).filter("level = 3").first()["files"] == "10"


def test_file_digests(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, data in (("a/x.bin", b"1" * 10_000), ("y.bin", b"2")):
        (tmp_path / name).write_bytes(data)
    got = {r.path: (r.length, r.sha256) for r in readers.file_digests(spark, str(tmp_path)).collect()}
    assert got == {"a/x.bin": (10_000, hashlib.sha256(b"1" * 10_000).hexdigest()), "y.bin": (1, hashlib.sha256(b"2").hexdigest())}


def test_rounding_of_stored_rows(spark):
    d = spark.createDataFrame([(0.12345, 1.0005, 2.675, "k"), (None, 0.5, 0.125, "k")], "mean_confidence double, ts double, cx double, other string")
    assert [tuple(r) for r in records.rounded(d, "track").collect()] == [(0.1234, 1.0, 2.68, "k"), (None, 0.5, 0.12, "k")]


def test_codes_and_aspects(spark):
    one = spark.range(1).select(*[columns.fourcc(F.lit(x)) for x in (0x34363248, 0, 0x00003832)], columns.fourcc(F.lit(None).cast("long")), columns.aspect_label(F.lit(700), F.lit(500)), columns.aspect_label(F.lit(1), F.lit(0)))
    assert one.first()[:] == ("H264", None, "28", None, "other (1.40)", None)
