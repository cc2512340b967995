"""Real reference events behind synthetic rows: pools of candidates, their ranges, parents, and traces of positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.config import RiskSettings
from eventloom.functions.columns import col
from eventloom.operators.ordered import numbered_places
from eventloom.operators.stats import places_of
from eventloom.schemas import REAL_SOURCES
from eventloom.sources.storage import stored

#: A person below this share of the image is distant; metres a degree of latitude.
DISTANT, METRES = 0.005, 111_320.0
RANGES = ("area_fraction", "center_x_norm", "hazard_confidence", "box_growth_per_second", "lateral_toward_center_fw_per_s")


def first_run(events: DataFrame, sources: tuple = REAL_SOURCES) -> DataFrame:
    """Real events of the least run_id alone: ids are unique within a run."""
    real = events.filter(F.col("data_source").isin(*sources))
    return real.join(F.broadcast(real.agg(F.min("run_id").alias("run_id"))), "run_id", "left_semi")


def pools(events: DataFrame, vehicles: tuple = RiskSettings().vehicles) -> DataFrame:
    """One row per event and pool it is a candidate of, with the box as shares of the image.

    Vehicles that are merely present fall back on approaching ones where there are none.
    """
    sized = (F.col("image_width") > 0) & (F.col("image_height") > 0) & F.col("bbox_area").isNotNull() & F.col("center_x").isNotNull()
    e = events.withColumn("area_fraction", F.when(sized, F.col("bbox_area") / (F.col("image_width") * F.col("image_height")))).withColumn("center_x_norm", F.when(sized, F.col("center_x") / F.col("image_width")))
    road = (F.col("camera") == "front") & F.col("area_fraction").isNotNull() & (F.coalesce("hazard_class", F.lit("")) != "")
    vehicle, person = F.col("hazard_class").isin(*vehicles), F.col("hazard_class") == "person"
    rules = {
        "vehicle": road & vehicle & (F.col("hazard_type") == "APPROACHING_VEHICLE"),
        "vehicle_presence": road & vehicle & (F.col("hazard_type") == "ROAD_USER_PRESENT"),
        "person": road & person & (F.col("area_fraction") >= DISTANT),
        "person_distant": road & person & (F.col("area_fraction") < DISTANT),
        "animal": road & (F.col("hazard_type") == "ANIMAL_HAZARD"),
        "drowsy": (F.col("camera") == "driver") & F.col("drowsiness_level").isin("HIGH", "CRITICAL") & F.col("drowsiness_score").isNotNull(),
    }
    inside = e.withColumn("pool", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))))
    present = inside.agg(F.coalesce(F.bool_or(F.col("pool") == "vehicle_presence"), F.lit(False))).scalar()
    stands_in = F.when((F.col("pool") == "vehicle") & ~present, F.array(F.lit("vehicle"), F.lit("vehicle_presence"))).otherwise(F.array("pool"))
    return inside.withColumn("pool", F.explode(stands_in))


def pool_ranges(candidates: DataFrame) -> DataFrame:
    """(pool, field, n, min, median, max) of the values that seed parameters; fields without a value have no row."""
    values = F.when(F.col("pool") == "drowsy", F.array(_named("drowsiness_score"))).otherwise(F.array(*[_named(c) for c in RANGES]))
    v = candidates.select("pool", F.inline(values)).filter("value is not null")
    own = stored(v.groupBy("pool", "field", "value").agg(F.count("*").alias("_c")), "values")
    half = (F.col("n") - 1) / 2
    mid = places_of(own, ["pool", "field"], {"low": F.floor(half), "high": F.ceil(half)}).groupBy("pool", "field").agg(F.round(F.avg("value"), 4).alias("median"))
    rest = own.groupBy("pool", "field").agg(F.sum("_c").alias("n"), F.round(F.min("value"), 4).alias("min"), F.round(F.max("value"), 4).alias("max"))
    return rest.join(mid, ["pool", "field"]).select("pool", "field", "n", "min", "median", "max")


def _named(c: str) -> Column:
    return F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value"))


def draw(seed: str, item, n) -> Column:
    """A seeded number in [0, n) from the digest of an item."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), col(item).cast("string"))), 1, 8), 16, 10).cast("long"), col(n))


def linked(rows: DataFrame, item: str, pool: str, candidates: DataFrame, seed: str) -> DataFrame:
    """Adds ``parent_event_id``: a seeded choice among the candidates of each row's pool, null for pools without any.

    Candidates are one run's events; they are numbered in the order of their ids.
    """
    c = candidates.select(F.col("pool").alias("_pool"), F.col("event_id").alias("parent_event_id"))
    c = numbered_places(c, ["_pool"], ["parent_event_id"], "_at")
    sizes = F.broadcast(c.groupBy("_pool").agg(F.count("*").alias("_n")))
    r = rows.join(sizes, F.col(pool) == F.col("_pool"), "left").drop("_pool").withColumn("_pick", draw(seed, item, "_n"))
    return r.join(c, (F.col(pool) == F.col("_pool")) & (F.col("_pick") == F.col("_at")), "left").drop("_pool", "_at", "_n", "_pick")


def coverage(linked_rows: DataFrame, pool: str) -> DataFrame:
    """Rows, rows with a parent, and distinct parents of each pool."""
    return linked_rows.groupBy(pool).agg(F.count("*").alias("rows"), F.count("parent_event_id").alias("linked"), F.countDistinct("parent_event_id").alias("parents"))


def trace(lat, lon, heading, t, speed: float = 8.0) -> tuple[Column, Column]:
    """Position after ``t`` seconds on a straight line from (lat, lon); heading in degrees, speed in metres a second."""
    lat, lon, way, far = col(lat), col(lon), F.radians(col(heading)), speed * col(t)
    return F.round(lat + far * F.cos(way) / METRES, 7), F.round(lon + far * F.sin(way) / (METRES * F.cos(F.radians(lat))), 7)
