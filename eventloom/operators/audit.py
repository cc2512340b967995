"""Audit of a dataset's files: conditional counts by folder, figures of images and films, and the issues they raise.

``files``: path, camera, label, kind (image, video, unsupported, ignored), extension,
size_bytes, readable, and where known width, height, format, exif_orientation,
duration_s, fps, codec, rotation_meta, frame_count, sha256.  Every figure is an
aggregate; issues are read off totals, never off files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.columns import aspect_label, orientation

#: Classes of pictures and classes of films of the driver's camera.
PICTURE_CLASSES, FILM_CLASSES = ("both_hands", "one_hand", "no_hands"), ("normal", "drowsy")


def file_counts() -> dict[str, Column]:
    """The nine counts of a group of files."""
    kind, readable, empty = F.col("kind"), F.coalesce("readable", F.lit(False)), F.col("size_bytes") == 0
    return {
        "files": F.count("*"), "images": F.count_if(kind == "image"), "videos": F.count_if(kind == "video"), "unsupported": F.count_if(kind == "unsupported"), "ignored_system_files": F.count_if(kind == "ignored"), "empty": F.count_if(empty),
        "corrupt": F.count_if((F.col("readable") == False) & ~empty), "readable_images": F.count_if((kind == "image") & readable), "readable_videos": F.count_if((kind == "video") & readable),  # noqa: E712
    }


def folder_counts(files: DataFrame, keys: list[str]) -> DataFrame:
    """The nine counts of every folder, of every first key, and of all (``level`` as grouping id)."""
    return files.rollup(*keys).agg(F.grouping_id().cast("int").alias("level"), *[c.alias(n) for n, c in file_counts().items()])


def _figures(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(name, low, high, mean) of columns, mean to 3 places; columns without a value have no row."""
    each = F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("x")) for n, c in columns.items()])
    return rows.select(F.inline(each)).filter("x is not null").groupBy("name").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.round(F.avg("x"), 3).alias("mean"))


def _shares(rows: DataFrame, kinds: dict[str, Column], order: str) -> DataFrame:
    """(category, key, n, first_seen): how often each value of several columns occurs, nulls as 'None'."""
    each = F.array(*[F.struct(F.lit(n).alias("category"), F.coalesce(c.cast("string"), F.lit("None")).alias("key")) for n, c in kinds.items()])
    return rows.select(order, F.inline(each)).groupBy("category", "key").agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))


def _size() -> Column:
    return F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))


def image_shares(files: DataFrame) -> DataFrame:
    """Formats, extensions, dimensions, aspect ratios and orientations of the images; all but the extensions of readable ones."""
    images = files.filter("kind = 'image'")
    ok = images.filter("readable AND width > 0 AND height > 0")
    own = _shares(ok, {"formats": F.col("format"), "dimensions": _size(), "aspect_ratios": aspect_label("width", "height"), "orientation": orientation("width", "height")}, "path")
    return own.unionByName(_shares(images, {"extensions": F.col("extension")}, "path"))


def image_figures(files: DataFrame) -> DataFrame:
    """One row: totals of images, the dimensions of least and greatest area (of equals the first path's), how many dimensions there are, turned pictures."""
    image, ok = F.col("kind") == "image", F.coalesce("readable", F.lit(False))
    good = image & ok & (F.col("width") > 0) & (F.col("height") > 0)
    area = F.when(good, F.col("width").cast("long") * F.col("height"))
    return files.agg(
        F.count_if(image).alias("total"), F.count_if(image & ok).alias("readable"), F.min_by(_size(), F.when(good, F.struct(area.alias("a"), F.col("path").alias("p")))).alias("min_dimensions"),
        F.min_by(_size(), F.when(good, F.struct((-area).alias("a"), F.col("path").alias("p")))).alias("max_dimensions"), F.countDistinct(F.when(good, _size())).alias("distinct_dimensions"), F.count_if(image & ok & (F.col("exif_orientation") != 1)).alias("exif_rotated"),
    )


def image_numbers(files: DataFrame) -> DataFrame:
    ok = files.filter("kind = 'image' AND readable")
    return _figures(ok, {"width": F.col("width"), "height": F.col("height"), "file_size_bytes": F.col("size_bytes")})


def video_shares(files: DataFrame) -> DataFrame:
    ok = files.filter("kind = 'video' AND readable")
    return _shares(ok, {"resolutions": _size(), "fps": F.col("fps"), "codecs": F.col("codec"), "rotation_meta": F.col("rotation_meta")}, "path")


def video_figures(files: DataFrame) -> DataFrame:
    """One row: films, readable ones, their summed duration (3 places), those without one."""
    ok = (F.col("kind") == "video") & F.coalesce("readable", F.lit(False))
    known = ok & F.coalesce(F.col("duration_s") > 0, F.lit(False))
    return files.agg(F.count_if(F.col("kind") == "video").alias("total"), F.count_if(ok).alias("readable"), F.round(F.sum(F.when(known, F.col("duration_s"))), 3).alias("total_duration_s"), F.count_if(ok & ~known).alias("without_duration"))


def video_numbers(files: DataFrame) -> DataFrame:
    ok = files.filter("kind = 'video' AND readable")
    return _figures(ok, {"duration_s": F.when(F.col("duration_s") > 0, F.col("duration_s")), "frame_count": F.when(F.col("frame_count") > 0, F.col("frame_count")), "file_size_bytes": F.col("size_bytes")})


def duplicate_figures(files: DataFrame) -> DataFrame:
    """One row: groups of equal content, files beyond the first of each, groups under several labels."""
    g = files.filter("sha256 IS NOT NULL").groupBy("sha256").agg(F.count("*").alias("n"), F.min(F.struct("camera", "label")).alias("a"), F.max(F.struct("camera", "label")).alias("z")).filter("n > 1")
    return g.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundant"), F.count_if(F.col("a") != F.col("z")).alias("cross_label"))


def audit_issues(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(issue, place, n): what stands out, with how many files, folders or groups; ``expected`` has the folders (camera, label) that should be there.

    A missing label means a file outside any class folder.  Totals alone are
    compared, each worked out once.
    """
    folders = files.filter("label IS NOT NULL").groupBy("camera", "label").agg(*[c.alias(n) for n, c in file_counts().items()])
    place = F.concat_ws("/", "camera", "label").alias("place")
    one = lambda issue, rows, where, n: rows.filter(where).select(F.lit(issue).alias("issue"), place if "camera" in rows.columns else F.lit(None).cast("string").alias("place"), F.col(n).cast("long").alias("n") if isinstance(n, str) else n.cast("long").alias("n"))
    missing = expected.join(folders, ["camera", "label"], "left_anti").select("camera", "label", F.lit(1).alias("n"))
    odd = folders.join(expected, ["camera", "label"], "left_anti").select("camera", "label", F.lit(1).alias("n"))
    totals = files.agg(F.count_if(F.col("label").isNull()).alias("outside"), *[c.alias(n) for n, c in file_counts().items() if n in ("unsupported", "empty", "corrupt")])
    images, films, twice = image_figures(files), video_figures(files), duplicate_figures(files)
    kinds = image_shares(files).filter("category = 'orientation'").agg(F.count("*").alias("n"))
    clips = video_shares(files).groupBy("category").agg(F.count("*").alias("n"), F.count_if(~F.col("key").isin("0", "None")).alias("turned"))
    parts = [
        one("missing folder", missing, F.lit(True), "n"), one("unexpected folder", odd, F.lit(True), "n"), *[one(name, totals, F.col(c) > 0, c) for name, c in (("outside class folders", "outside"), ("unsupported", "unsupported"), ("empty", "empty"), ("corrupt", "corrupt"))],
        one("duplicate groups", twice, F.col("groups") > 0, "groups"), one("duplicate files", twice, F.col("redundant") > 0, "redundant"), one("duplicates across labels", twice, F.col("cross_label") > 0, "cross_label"),
        one("films among pictures", folders, F.col("label").isin(*PICTURE_CLASSES) & (F.col("videos") > 0), "videos"), one("pictures among films", folders, F.col("label").isin(*FILM_CLASSES) & (F.col("images") > 0), "images"),
        one("several dimensions", images, F.col("distinct_dimensions") > 1, "distinct_dimensions"), one("mixed orientation", kinds, F.col("n") > 1, "n"), one("turned pictures", images, F.col("exif_rotated") > 0, "exif_rotated"),
        one("several resolutions", clips, (F.col("category") == "resolutions") & (F.col("n") > 1), "n"), one("turned films", clips, (F.col("category") == "rotation_meta") & (F.col("turned") > 0), "turned"), one("films without duration", films, F.col("without_duration") > 0, "without_duration"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
