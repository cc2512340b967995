"""Boxes: detection clean-up, overlap pairs and duplicates within a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.config import EPS
from eventloom.functions.columns import finite, iou

BOX = ("x1", "y1", "x2", "y2")


def clean_detections(df: DataFrame, frame: list[str], classes: list[str] | None, threshold: float, width: float, height: float, tie: tuple[str, ...] = ()) -> DataFrame:
    """Confident boxes of allowed classes, clipped to the image, without degenerate ones, numbered by falling confidence.

    ``tie`` names columns that tell equal boxes apart, so that a rerun numbers them alike.
    """
    d = df.filter(F.col("confidence") >= threshold - 1e-6)
    if classes is not None:
        d = d.filter(F.col("class_name").isin(classes))
    for c in BOX:
        d = d.withColumn(c, F.greatest(F.lit(0.0), F.least(finite(c), F.lit(float(width if c[0] == "x" else height)))))
    d = d.filter("x2 > x1 and y2 > y1")
    return d.withColumn("det_ix", F.row_number().over(Window.partitionBy(*frame).orderBy(F.desc("confidence"), *BOX, "class_name", *tie)) - 1)


def with_shape(df: DataFrame) -> DataFrame:
    """Centre, width, height and area of a box."""
    return df.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2, "box_w": F.col("x2") - F.col("x1"), "box_h": F.col("y2") - F.col("y1")}).withColumn("area", F.col("box_w") * F.col("box_h"))


def meeting(a: DataFrame, b: DataFrame, frame: list[str], pitch: float) -> DataFrame:
    """Rows a_*, b_* of boxes of one frame that lie over a common cell of a grid: every pair that overlaps, once.

    A frame of many boxes never meets in all its pairs, only those of a cell; a
    pair counts in the cell that holds the near corner of its common part.
    """
    cell = lambda c: F.floor(F.col(c) / pitch)

    def dealt(d: DataFrame) -> DataFrame:
        d = d.withColumn("_gx", F.explode(F.sequence(cell("x1"), cell("x2"))))
        return d.withColumn("_gy", F.explode(F.sequence(cell("y1"), cell("y2"))))

    side = lambda d, s: dealt(d).select(*frame, "_gx", "_gy", *[F.col(c).alias(f"{s}_{c}") for c in d.columns if c not in frame])
    j = side(a, "a").join(side(b, "b"), [*frame, "_gx", "_gy"])
    corner = lambda c: F.floor(F.greatest(f"a_{c}", f"b_{c}") / pitch)
    return j.filter((F.col("_gx") == corner("x1")) & (F.col("_gy") == corner("y1"))).drop("_gx", "_gy")


def overlap_pairs(a: DataFrame, b: DataFrame, frame: list[str], a_id: str, b_id: str, same: float, switch: float, pitch: float = 256.0) -> DataFrame:
    """Pairs of one frame that may match: overlap at least ``same`` (above 0) within a class, ``switch`` across classes."""
    left = a.select(*frame, F.col(a_id).alias("id"), F.col("class_name").alias("class"), *BOX)
    right = b.select(*frame, F.col(b_id).alias("id"), F.col("class_name").alias("class"), *BOX)
    j = meeting(left, right, frame, pitch).withColumn("iou", iou([f"a_{c}" for c in BOX], [f"b_{c}" for c in BOX])).withColumn("same_class", F.col("a_class") == F.col("b_class"))
    return j.filter(F.col("iou") >= F.when(F.col("same_class"), same).otherwise(switch) - EPS).select(*frame, "a_id", "b_id", "same_class", "iou")


def duplicate_pairs(df: DataFrame, frame: list[str], box_id: str, threshold: float = 0.7, pitch: float = 256.0) -> DataFrame:
    """Pairs (smaller id first) of one frame that overlap by at least ``threshold`` (above 0)."""
    d = df.select(*frame, F.col(box_id).alias("id"), *BOX)
    j = meeting(d, d, frame, pitch).filter("a_id < b_id").withColumn("iou", iou([f"a_{c}" for c in BOX], [f"b_{c}" for c in BOX]))
    return j.filter(F.col("iou") >= threshold).select(*frame, "a_id", "b_id", "iou")


def landmarks_in_frame(points: str):
    """Whether every landmark (structs x, y) lies within the unit square."""
    return F.forall(points, lambda p: (p["x"] >= 0) & (p["x"] <= 1) & (p["y"] >= 0) & (p["y"] <= 1))
