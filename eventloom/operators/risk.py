"""Contextual risk scoring as column expressions.

``track_hazards`` scores tracks, ``assess`` folds a frame's tracks and the
driver's state into one assessment.  The factor list of an assessment always
sums to its raw score, but for the last bits of a sum of doubles: caps and clamps
appear as negative factors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.config import EPS, RiskSettings
from eventloom.functions.columns import fixed, level_for_score, level_name, ramp
from eventloom.operators.ordered import trailing_slope

FACTOR = "struct<name:string,points:double,source:string,detail:string,track_id:bigint>"
#: Texts of the gates, of the bounds, and of an assessment without any signal.
GATE_CRITICAL = "CRITICAL needs a driver factor with a moving road hazard, or a very strong road hazard"
GATE_HIGH = "HIGH needs at least 2 independent evidence groups"
COMBINATION = "driver factor coincides with a road hazard with approach/conflict evidence"
CLAMPED = "score clamped to 0-100"
IMAGE_ONLY = "image-space road signals only: no calibration, distance, physical speed or TTC; camera motion is included in image motion"
NO_SIGNAL = "No persistent road hazard and no driver impairment signal."
#: Hazard names by kind of object and by driver factor.
ROAD_HAZARD = {"vehicle": "APPROACHING_VEHICLE", "person": "PEDESTRIAN_CONFLICT", "animal": "ANIMAL_HAZARD"}
DRIVER_HAZARD = {"drowsiness": "DRIVER_DROWSINESS", "hands_off_wheel": "HANDS_OFF_WHEEL", "head_away": "DRIVER_HEAD_AWAY"}


def factor(name: str, points: Column, source: str, detail: Column | str | None = None, track: Column | None = None) -> Column:
    text = detail if isinstance(detail, Column) else F.lit(detail)
    return F.struct(F.lit(name).alias("name"), F.lit(points).cast("double").alias("points"), F.lit(source).alias("source"), text.cast("string").alias("detail"), (F.lit(None) if track is None else track).cast("long").alias("track_id"))


def optional(df: DataFrame, name: str, kind: str) -> Column:
    """The column, or a null of its type where the table has none."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def present(*pairs: tuple[Column, Column]) -> Column:
    """The factors whose condition holds, in the given order."""
    return F.filter(F.array(*[F.when(c, f) for c, f in pairs]), lambda x: x.isNotNull())


def points_of(factors: Column | str) -> Column:
    return F.aggregate(factors, F.lit(0.0), lambda n, x: n + x["points"])


def object_kind(name: str, s: RiskSettings) -> Column:
    c = F.lower(F.col(name))
    return F.when(c.isin(*s.vehicles), "vehicle").when(c.isin(*s.persons), "person").when(c.isin(*s.animals), "animal")


def motion_features(tracks: DataFrame, keys: list[str], s: RiskSettings = RiskSettings()) -> DataFrame:
    """``growth`` of ln(area) and ``lateral`` of cx / width per second over the trailing window of matched observations."""
    return trailing_slope(tracks, keys, "last_seen", {"growth": F.log("area"), "lateral": F.col("cx") / F.col("width")}, s.window, s.min_samples, s.min_span)


def toward_centre(x: Column, lateral: Column, s: RiskSettings) -> Column:
    """Sideways motion toward the central band (its size inside the band); null where unknown."""
    off = x - 0.5
    return F.when(F.abs(off) <= s.central, F.abs(lateral)).when(off > 0, -lateral).otherwise(lateral)


def _weight(kind: str, part: str, s: RiskSettings) -> Column:
    return F.when(F.col(kind) == "vehicle", getattr(s.vehicle, part)).when(F.col(kind) == "person", getattr(s.person, part)).otherwise(getattr(s.animal, part))


def track_hazards(tracks: DataFrame, s: RiskSettings = RiskSettings(), keep: bool = False) -> DataFrame:
    """Adds the road rules to tracks with class_name, persistence, detections, missed, cx, y2, area, width, height, growth, lateral, confidence, label_changes.

    Tracks without a hazard class or enough evidence are dropped, or with ``keep``
    marked by ``evident`` being false, their other new columns meaning nothing.  Every factor
    names its track (``track_id``, where the table has it) and says in ``detail``
    what was seen; ``phrases`` are the parts of a reason.
    """
    d = tracks.withColumn("kind", object_kind("class_name", s))
    evident = (
        F.col("kind").isNotNull() & (F.col("width") > 0) & (F.col("height") > 0) & (F.col("persistence") >= s.min_persistence - EPS) & (F.col("detections") >= s.min_detections) & (F.col("missed") <= s.max_missed + EPS)
    )
    d = d.withColumn("evident", F.coalesce(evident, F.lit(False))) if keep else d.filter(evident)
    d = d.withColumns({"x_norm": F.col("cx") / F.col("width"), "bottom": F.col("y2") / F.col("height"), "area_share": F.col("area") / (F.col("width") * F.col("height"))})
    d = d.withColumn("toward", toward_centre(F.col("x_norm"), F.col("lateral"), s))
    off = F.abs(F.col("x_norm") - 0.5)
    d = d.withColumns(
        {
            "is_central": off <= s.central, "is_near": off <= s.near, "is_lower": F.col("bottom") >= s.lower,
            "approaching": F.coalesce(F.col("growth") >= s.growth_min, F.lit(False)), "moving_in": F.coalesce(F.col("toward") >= s.lateral_min, F.lit(False)),
            "sideways": F.coalesce(F.abs("lateral") >= s.lateral_min, F.lit(False)),
        }
    )
    place = F.when(F.col("is_central"), 1.0).when(F.col("is_near"), 0.5).otherwise(0.0) * F.when(F.col("is_lower"), 1.0).otherwise(0.5)
    size = _weight("kind", "size", s) * ramp("area_share", s.size_min, s.size_full)
    track = optional(tracks, "track_id", "long")
    label = F.concat("class_name", F.coalesce(F.concat(F.lit(" #"), track.cast("string")), F.lit("")), F.lit(" "))
    seen = F.concat(fixed("persistence", 1), F.lit(" s, "), F.col("detections").cast("string"), F.lit(" detections"))
    band = F.when(F.col("is_central"), "in the central image band").otherwise("near the central image band")
    half = F.when(F.col("is_lower"), ", lower image region (x=").otherwise(", upper image region (x=")
    grows = F.concat(F.lit("image-space box area growing "), fixed(100 * (F.exp("growth") - 1), 0), F.lit("%/s"))
    moves = F.concat(F.when(F.col("is_central"), "moving across").otherwise("moving toward"), F.lit(" the central band at "), fixed("toward", 2), F.lit(" frame-widths/s"))
    told = lambda *parts: F.concat(label, *[F.lit(x) if isinstance(x, str) else x for x in parts])
    placed = F.col("is_near") | F.col("is_central")
    road = present(
        (F.lit(True), factor("persistence", _weight("kind", "persistence", s) * ramp("persistence", 0.0, s.persistence_full), "road", told("observed for ", fixed("persistence", 1), " s (", F.col("detections").cast("string"), " detections)"), track)),
        (placed, factor("centrality", _weight("kind", "centrality", s) * place, "road", told(band, half, fixed("x_norm", 2), ", bottom=", fixed("bottom", 2), " of frame)"), track)),
        (F.col("approaching"), factor("approach", _weight("kind", "approach", s) * (0.4 + 0.6 * ramp("growth", s.growth_min, s.growth_full)), "road", told(grows), track)),
        (F.col("moving_in"), factor("trajectory", _weight("kind", "trajectory", s) * (0.4 + 0.6 * ramp("toward", s.lateral_min, s.lateral_full)), "road", told(moves), track)),
        (size > 0, factor("image_size", size, "road", told("covers ", fixed(100 * F.col("area_share"), 1), "% of the frame"), track)),
    )
    says = F.array(F.concat(F.lit("observed "), seen), F.when(F.col("approaching"), grows), F.when(F.col("moving_in"), F.concat(moves, F.lit(" (image space)"))), F.when(placed, band))
    d = d.withColumn("phrases", F.array_compact(says)).withColumn("factors", road).withColumn("points", points_of("factors"))
    qualifies = F.when(F.col("kind") == "vehicle", F.col("approaching")).when(F.col("kind") == "person", F.col("is_near") & (F.col("moving_in") | F.col("approaching"))).otherwise((F.col("is_near") | F.col("is_lower")) & (F.col("approaching") | F.col("sideways")))
    steady = F.greatest(F.lit(s.min_stability), 1.0 - s.label_penalty * F.col("label_changes"))
    d = d.withColumn("qualifies", qualifies).withColumn("quality", F.greatest(F.lit(s.min_confidence), F.least(F.lit(1.0), F.col("confidence") / s.confidence_reference)) * steady)
    less = (F.col("quality") < 1.0) & (F.col("points") > 0)
    shaky = F.when(F.col("confidence") < s.confidence_reference, F.concat(F.lit("mean detector confidence "), fixed("confidence", 2), F.lit(f" < {s.confidence_reference:.2f}")))
    names = F.array_join(F.array_sort(F.array_distinct(F.coalesce(optional(tracks, "class_history", "array<string>"), F.array("class_name")))), "/")
    relabelled = F.when(F.col("label_changes") > 0, F.concat(F.col("label_changes").cast("string"), F.lit(" detector label change(s) ("), names, F.lit(")")))
    why = told("points x", fixed("quality", 2), ": ", F.concat_ws("; ", shaky, relabelled))
    d = d.withColumn("factors", F.concat("factors", present((less, factor("evidence_quality", F.col("points") * F.col("quality") - F.col("points"), "quality", why, track)))))
    d = d.withColumn("points", F.when(less, F.col("points") * F.col("quality")).otherwise(F.col("points")))
    over = ~F.col("qualifies") & (F.col("points") > s.presence_cap)
    d = d.withColumn("factors", F.concat("factors", present((over, factor("presence_cap", s.presence_cap - F.col("points"), "road", told(f"has no approach/conflict evidence: capped at {s.presence_cap:g} points"), track))))).withColumn("points", F.when(over, s.presence_cap).otherwise(F.col("points")))
    groups = F.array_compact(F.array(F.when(F.col("is_central") & F.col("is_lower"), "position"), F.when(F.col("approaching") | F.col("moving_in"), "motion")))
    named = reduce(lambda c, k: c.when(F.col("kind") == k, ROAD_HAZARD[k]), ROAD_HAZARD, F.when(~F.col("qualifies"), "ROAD_USER_PRESENT"))
    return d.withColumn("groups", F.when(F.col("qualifies"), groups).otherwise(F.array().cast("array<string>"))).withColumn("hazard_type", named)


def frame_hazards(hazards: DataFrame, frame: list[str], track_id: str = "track_id") -> DataFrame:
    """One row per frame: its primary hazard (qualifying first, then points, then id) and how many qualify."""
    cols = [track_id, "class_name", "hazard_type", "qualifies", "points", "quality", "factors", "groups", "phrases"]
    first = F.max_by(F.struct(*cols), F.struct("qualifies", "points", (-F.col(track_id)).alias("least")))
    d = hazards.groupBy(*frame).agg(F.count_if("qualifies").cast("int").alias("n_qualifying"), first.alias("p"))
    return d.select(*frame, "n_qualifying", *[F.col(f"p.{c}").alias(f"p_{c}") for c in cols])


def driver_factors(df: DataFrame, s: RiskSettings = RiskSettings()) -> Column:
    """Driver factors from drowsiness_level, driver_activity, head_away_seconds and driver_age (null: no driver).

    Their details use drowsiness_score, distraction_seconds, head_yaw and head_pitch where the table has them.
    """
    fresh = F.coalesce(F.col("driver_age") <= s.driver_age, F.lit(False))
    level = F.col("drowsiness_level")
    drowsy = F.when(level == "CRITICAL", s.drowsy_critical).when(level == "HIGH", s.drowsy_high)
    score = F.concat(F.lit(", score "), fixed(optional(df, "drowsiness_score", "double"), 2))
    held = F.concat(F.lit("NO_HANDS observed continuously "), fixed(optional(df, "distraction_seconds", "double"), 1), F.lit(" s"))
    angle = lambda c: F.coalesce(F.concat(F.lit(f"{c[5:]} "), fixed(optional(df, c, "double"), 0, "+"), F.lit("°")), F.lit(f"{c[5:]} n/a"))
    turned = F.concat(F.lit("head turned away for "), fixed("head_away_seconds", 1), F.lit(" s ("), angle("head_yaw"), F.lit(", "), angle("head_pitch"), F.lit("; relative head-pose signal)"))
    return present(
        (fresh & drowsy.isNotNull(), factor("drowsiness", drowsy, "driver", F.concat(F.lit("drowsiness level "), level, F.coalesce(score, F.lit(""))))),
        (fresh & (F.col("driver_activity") == "HANDS_OFF_WHEEL"), factor("hands_off_wheel", F.lit(s.hands_off), "driver", F.concat(F.lit("inferred HANDS_OFF_WHEEL ("), F.coalesce(held, F.lit("sustained NO_HANDS")), F.lit(")")))),
        (fresh & (F.col("head_away_seconds") >= s.head_seconds), factor("head_away", F.lit(s.head_away), "driver", turned)),
    )


def driver_notes(df: DataFrame, s: RiskSettings = RiskSettings()) -> Column:
    """What was not scored, and why: no driver, an old observation, or parts of one that are unknown."""
    age = F.col("driver_age")
    old = F.concat(F.lit("driver observation is "), fixed(age, 1), F.lit(f" s old (> {s.driver_age:g} s): driver factors not evaluated"))
    status = optional(df, "face_status", "string")
    parts = F.array(
        F.when(F.col("drowsiness_level") == "UNKNOWN", "drowsiness UNKNOWN (not enough observed face time)"),
        F.when(optional(df, "hand_state", "string") == "ONE_HAND", "ONE_HAND observed: not scored (one hand on the wheel is not treated as distraction)"),
        F.when(status != "OK", F.concat(F.lit("face status "), status, F.lit(": eye/head evidence unavailable this frame"))),
    )
    return F.when(age.isNull(), F.array(F.lit("no driver observation: driver factors not evaluated"))).when(age > s.driver_age, F.array(old)).otherwise(F.array_compact(parts))


def head_is_away(yaw: str, pitch: str, s: RiskSettings = RiskSettings()) -> Column:
    return F.coalesce(F.abs(yaw) > s.head_yaw, F.lit(False)) | F.coalesce(F.col(pitch) > s.head_pitch, F.lit(False))


def gated(rank: Column, driver_names: Column, qualifies: Column, groups: Column, road: Column, s: RiskSettings) -> tuple[Column, Column]:
    """(rank, gate texts): CRITICAL and HIGH need the evidence that their definitions name."""
    road_groups = F.when(F.coalesce(qualifies, F.lit(False)), groups).otherwise(F.array().cast("array<string>"))
    both = F.size(F.array_except(F.array(F.lit("motion"), F.lit("position")), road_groups)) == 0
    combined = (F.size(driver_names) > 0) & F.array_contains(road_groups, "motion")
    drop = (rank >= 3) & ~(combined | ((road >= s.strong_road) & both))
    first = F.when(drop, 2).otherwise(rank)
    kinds = F.size(F.array_union(driver_names, F.transform(road_groups, lambda g: F.concat(F.lit("road_"), g))))
    low = (first >= 2) & (kinds < 2)
    texts = F.array_compact(F.array(F.when(drop, GATE_CRITICAL), F.when(low, GATE_HIGH)))
    return F.when(low, 1).otherwise(first), texts


def assess(frames: DataFrame, s: RiskSettings = RiskSettings()) -> DataFrame:
    """Adds the assessment to frames that carry ``frame_hazards`` columns (null without a track) and the driver's columns."""
    d = frames.withColumn("driver_list", driver_factors(frames, s)).withColumn("risk_notes", driver_notes(frames, s))
    d = d.withColumn("has_road", F.col("p_points").isNotNull()).withColumn("road_q", F.coalesce("p_qualifies", F.lit(False)))
    multi = F.coalesce(F.col("n_qualifying"), F.lit(0)) >= 2
    raw_road = F.coalesce("p_points", F.lit(0.0)) + F.when(multi, s.multi_bonus).otherwise(0.0)
    d = d.withColumn("_road", raw_road).withColumn("road_points", F.least(F.col("_road"), F.lit(s.road_cap)))
    d = d.withColumn("_driver", points_of("driver_list")).withColumn("driver_points", F.least(F.col("_driver"), F.lit(s.driver_cap)))
    combined = (F.size("driver_list") > 0) & F.col("road_q")
    d = d.withColumn("combined", combined)
    bonus = s.combined_bonus * F.least(F.lit(1.0), F.col("road_points") / s.combined_reference)
    all_of = F.concat(
        "driver_list", F.coalesce("p_factors", F.array().cast(f"array<{FACTOR}>")),
        present(
            (multi & F.col("has_road"), factor("multiple_hazards", F.lit(s.multi_bonus), "road", F.concat(F.col("n_qualifying").cast("string"), F.lit(" road hazards with approach/conflict evidence at once")))), (F.col("_road") > s.road_cap, factor("road_cap", s.road_cap - F.col("_road"), "road", f"road contribution capped at {s.road_cap:g}")),
            (F.col("_driver") > s.driver_cap, factor("driver_cap", s.driver_cap - F.col("_driver"), "driver", f"driver contribution capped at {s.driver_cap:g}")), (F.col("combined"), factor("driver_road_combination", bonus, "combined", COMBINATION)),
        ),
    )
    # Of the bounded parts, so that a cap leaves a whole number: the factors' own sum may end a little beside it.
    total = F.col("road_points") + F.col("driver_points") + F.when(F.col("combined"), bonus).otherwise(0.0)
    d = d.withColumn("factors", all_of).withColumn("_sum", total)
    d = d.withColumn("raw_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("_sum"))))
    d = d.withColumn("factors", F.concat("factors", present((F.col("raw_score") != F.col("_sum"), factor("score_clamp", F.col("raw_score") - F.col("_sum"), "quality", CLAMPED)))))
    names = F.transform("driver_list", lambda f: f["name"])
    rank, gates = gated(level_for_score("raw_score", s), names, F.col("road_q"), F.col("p_groups"), F.col("road_points"), s)
    d = d.withColumn("raw_rank", rank.cast("int")).withColumn("gates", gates)
    # The first of the strongest driver factors names a driver hazard.
    top = F.element_at(F.filter("driver_list", lambda f: f["points"] == F.array_max(F.transform("driver_list", lambda g: g["points"]))), 1)["name"]
    named = reduce(lambda c, k: c.when(top == k, DRIVER_HAZARD[k]), list(DRIVER_HAZARD)[1:], F.when(top == "drowsiness", DRIVER_HAZARD["drowsiness"]))
    hazard = F.when(F.col("combined"), "COMBINED_DRIVER_HAZARD").when(F.col("road_q"), F.col("p_hazard_type")).when(F.size("driver_list") > 0, named)
    hazard = hazard.when(F.col("has_road") & (F.col("p_points") >= s.caution), "ROAD_USER_PRESENT").otherwise("NONE")
    d = d.withColumn("hazard", hazard)
    shown = F.col("road_q") | (F.col("has_road") & (F.col("hazard") == "ROAD_USER_PRESENT"))
    parts = F.array_compact(F.array(F.when(F.size("driver_list") > 0, F.col("observation_quality")), F.when(shown, F.col("p_quality"))))
    quality = F.when(F.size(parts) > 0, F.array_min(parts)).otherwise(1.0)
    seen = F.coalesce(F.col("driver_age") <= s.driver_age, F.lit(False))
    d = d.withColumn("evidence_quality", F.when(seen, quality).otherwise(F.least(quality, F.lit(0.5)))).withColumn("primary_track", F.when(shown, F.col("p_track_id")))
    track_note = F.concat(F.lit("track #"), F.col("p_track_id").cast("string"), F.lit(" evidence multiplier "), fixed("p_quality", 2))
    d = d.withColumn("risk_notes", F.array_compact(F.concat("risk_notes", F.array(F.when(F.col("p_quality") < 1.0, track_note), F.lit(IMAGE_ONLY)))))
    return d.withColumn("reason", reason_text()).drop("_road", "_driver", "_sum", "has_road")


def _capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def reason_text() -> Column:
    """One sentence made from the structured factors and the phrases of the primary track."""
    driver = F.array_join(F.transform("driver_list", lambda f: f["detail"]), " and ")
    name = F.concat(F.col("p_class_name"), F.lit(" #"), F.col("p_track_id").cast("string"))
    bits = F.array_join(F.slice("p_phrases", 2, F.greatest(F.size("p_phrases") - 1, F.lit(0))), ", ")
    road = F.concat(F.lit("persistent "), name, F.lit(" ("), F.element_at("p_phrases", 1), F.lit(")"), F.when(bits != "", F.concat(F.lit(": "), bits)).otherwise(""))
    others = F.col("n_qualifying") - 1
    more = F.when(others > 0, F.concat(F.lit(" (+"), others.cast("string"), F.lit(" other road hazard"), F.when(others > 1, "s").otherwise(""), F.lit(")"))).otherwise("")
    shown = F.col("primary_track").isNotNull()
    idle = F.when(shown, F.concat(F.lit("; "), name, F.lit(" visible without approach/conflict evidence"))).otherwise("")
    return (
        F.when(F.col("combined"), F.concat(_capital(driver), F.lit(" coincides with a "), road, more, F.lit(".")))
        .when(F.col("road_q"), F.concat(_capital(road), more, F.lit(".")))
        .when(F.size("driver_list") > 0, F.concat(_capital(driver), F.lit("; no road hazard with approach/conflict evidence"), idle, F.lit(".")))
        .when(shown, F.concat(F.lit("Persistent "), name, F.lit(" is visible but shows no approach or conflict evidence in image space.")))
        .otherwise(NO_SIGNAL)
    )


def risk_counts(assessed: DataFrame) -> DataFrame:
    """(category, key, n): assessments by raw level, by level where they have been smoothed, by hazard, by factor and by gate, in one pass."""
    pair = lambda k, c: F.struct(F.lit(k).alias("category"), c.cast("string").alias("key"))
    one = [pair("raw_level", level_name("raw_rank")), pair("hazard", F.col("hazard"))]
    if "level" in assessed.columns:
        one.append(pair("level", F.col("level")))
    # A factor counts once an assessment however often it occurs there.
    many = [F.transform(F.array_distinct(F.transform("factors", lambda f: f["name"])), lambda x: pair("factor", x)), F.transform("gates", lambda x: pair("gate", x))]
    return assessed.select(F.inline(F.concat(F.array(*one), *many))).filter("key IS NOT NULL").groupBy("category", "key").agg(F.count("*").alias("n"))
