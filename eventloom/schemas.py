"""The event table: 60 typed columns, their rules, and the checks generated from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from eventloom.config import LEVELS
from eventloom.functions.columns import rank

VERSION = "1.0"
#: name, type, nullable, group — fixed values: names and order of the stored table.
_TABLE = """
schema_version string - identity
event_id string - identity
run_id string - identity
session_id string - identity
source_file string ? identity
camera string - identity
data_source string - identity
observation_type string - identity
timestamp double - time
frame_index bigint ? time
event_type string - event
transition string ? event
previous_risk_level string ? event
change_kind string ? event
gps_lat double ? gps
gps_lon double ? gps
gps_source string - gps
gps_timestamp double ? gps
gps_accuracy_m double ? gps
risk_level string ? risk
raw_risk_score double ? risk
smoothed_risk_score double ? risk
hazard_type string ? risk
primary_track_id bigint ? risk
image_width bigint ? track
image_height bigint ? track
hazard_class string ? track
hazard_track_class string ? track
hazard_class_changes bigint ? track
hazard_confidence double ? track
track_persistence_seconds double ? track
track_detection_count bigint ? track
center_x double ? track
center_y double ? track
bbox_width double ? track
bbox_height double ? track
bbox_area double ? track
velocity_x_pixels_per_second double ? track
velocity_y_pixels_per_second double ? track
area_change_rate double ? track
box_growth_per_second double ? track
lateral_toward_center_fw_per_s double ? track
trajectory_overlap double ? track
hazard_persistence double ? track
driver_hand_state string ? driver
driver_hand_confidence double ? driver
driver_activity string ? driver
drowsiness_level string ? driver
drowsiness_score double ? driver
face_status string ? driver
risk_reason string ? explanation
risk_factors string ? explanation
risk_gates string ? explanation
evidence_quality double ? explanation
alarm_recommended boolean ? explanation
alarm_triggered boolean - explanation
evidence_kind string - evidence
evidence_path string ? evidence
evidence_files string ? evidence
notes string ? evidence
"""
_TYPES = {"string": StringType(), "double": DoubleType(), "bigint": LongType(), "boolean": BooleanType()}
_ROWS = [x.split() for x in _TABLE.strip().splitlines()]
EVENT_SCHEMA = StructType([StructField(n, _TYPES[t], q == "?", {"group": g}) for n, t, q, g in _ROWS])
JSON_COLUMNS = ("risk_factors", "risk_gates", "evidence_files", "notes")
#: Allowed values of the enumerated columns.
ALLOWED = {
    "data_source": ("LOCAL_REAL", "PUBLIC", "SYNTHETIC", "SYNTHETIC_COMBINATION"),
    "observation_type": ("OBSERVED", "INFERRED"),
    "event_type": ("RISK_ESCALATED", "RISK_DEESCALATED", "PERSISTENT_HAZARD", "DRIVER_STATE_CHANGE"),
    "risk_level": LEVELS,
    "previous_risk_level": LEVELS,
    "change_kind": ("hand_state", "driver_activity", "drowsiness_level"),
    "evidence_kind": ("NONE", "FRAME", "CLIP"),
}
REAL_SOURCES = ("LOCAL_REAL", "PUBLIC")


#: name, type, nullable — fixed values: names and order of the synthetic table; "=" takes type (and nullability) of the event table.
_SIM_TABLE = """
schema_version string -
event_id = =
synthetic_id string -
run_id = =
session_id = =
scenario_name string -
scenario_variant bigint -
scenario_description string -
synthetic_generation_reason string -
parent_real_event_id string ?
parent_real_driver_event_id string ?
parent_real_run_id string ?
data_source = =
observation_type string -
camera = =
timestamp = =
timestamp_source string -
synthetic_datetime string -
frame_index = -
gps_lat = -
gps_lon = -
gps_source = =
location_source string -
driver_hand_state = =
driver_hand_confidence = =
face_status = =
head_yaw double ?
head_pitch double ?
eye_closure_ratio double ?
eye_closed_duration double ?
drowsiness_score = =
drowsiness_level = =
driver_activity = =
distraction_duration double ?
manual_state_duration double ?
head_away_duration double -
image_width = -
image_height = -
hazard_class = =
hazard_confidence = =
center_x = =
center_y = =
bbox_width = =
bbox_height = =
bbox_area = =
primary_track_id = =
hazard_track_class = =
track_persistence_seconds = =
box_growth_per_second = =
lateral_toward_center_fw_per_s = =
trajectory_overlap = =
hazard_persistence = =
risk_level = =
raw_risk_level string ?
raw_risk_score = =
smoothed_risk_score = =
risk_score double ?
hazard_type = =
risk_reason = =
risk_factors = =
risk_gates = =
evidence_quality = =
alarm_recommended = =
alarm_triggered = =
event_type string ?
transition = =
events_emitted string -
expected_behavior string -
expected_peak_levels string -
actual_risk_level string ?
instance_peak_risk_level string -
expectation_met boolean -
notes = -
"""


def derived_schema(table: str, base: StructType = EVENT_SCHEMA) -> StructType:
    """A schema of lines "name type nullable"; "=" inherits that part from the base's field of the name."""

    def field(name: str, kind: str, null: str) -> StructField:
        old = base[name] if "=" in (kind, null) else None
        return StructField(name, old.dataType if kind == "=" else _TYPES[kind], old.nullable if null == "=" else null == "?", {"inherited": old is not None})

    return StructType([field(*x.split()) for x in table.strip().splitlines()])


SIM_SCHEMA = derived_schema(_SIM_TABLE)
SIM_JSON_COLUMNS = ("risk_factors", "risk_gates", "notes", "events_emitted", "expected_peak_levels")
#: Allowed values of the synthetic table, its name for the location's origin, the form of a real event's id, and other names of columns.
SIM_ALLOWED = {"camera": ("front+driver",), "event_type": ALLOWED["event_type"], **{c: LEVELS for c in ("risk_level", "raw_risk_level", "actual_risk_level", "instance_peak_risk_level")}}
LOCATION_SOURCE = "SYNTHETIC_REFERENCE"
REAL_ID = r"^event_\d{6,}$"
OTHER_NAMES = {"object_id": "primary_track_id", "approach_rate": "box_growth_per_second"}


def resolved(name: str) -> str:
    """The column that a requested name stands for."""
    return OTHER_NAMES.get(name, name)


def sim_rules() -> dict[str, Column]:
    """Cross-field rules of the synthetic table: name -> condition under which a row breaks it; a null breaks none of them but its own."""
    no = lambda c: F.coalesce(c, F.lit(False))
    parents = [F.col("parent_real_event_id"), F.col("parent_real_driver_event_id")]
    named = parents[0].isNotNull() | parents[1].isNotNull()
    return {
        **{f"{c}: not synthetic": no(F.col(c) != "SYNTHETIC") for c in ("data_source", "observation_type", "timestamp_source", "gps_source")},
        "location source": no(F.col("location_source") != LOCATION_SOURCE),
        "gps range": no((F.abs("gps_lat") > 90) | (F.abs("gps_lon") > 180)),
        "looks real": no(F.col("event_id").rlike(REAL_ID)),
        "parent id": no(~parents[0].rlike(REAL_ID)) | no(~parents[1].rlike(REAL_ID)),
        "parent run": named & F.col("parent_real_run_id").isNull(),
        "alarm triggered": no(F.col("alarm_triggered")),
        "actual level": ~F.col("actual_risk_level").eqNullSafe(F.col("risk_level")),
        "overlap": no((F.col("trajectory_overlap") < 0) | (F.col("trajectory_overlap") > 1)),
    }


def sim_validated(df: DataFrame) -> DataFrame:
    """Adds ``problems`` to a synthetic table: the cross-field rules count only where every field is well formed."""
    fields = problems(field_checks(SIM_SCHEMA, SIM_ALLOWED, SIM_JSON_COLUMNS))
    return df.withColumn("problems", fields).withColumn("problems", F.when(F.size("problems") > 0, F.col("problems")).otherwise(problems(sim_rules())))


def schema_diff(df: DataFrame, schema: StructType = EVENT_SCHEMA) -> tuple[list[str], list[str], list[str]]:
    """(missing, unknown, wrongly typed) fields of a table, on the driver."""
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in schema}
    return [n for n in want if n not in have], [n for n in have if n not in want], [n for n in want if n in have and have[n] != want[n]]


def field_checks(schema: StructType = EVENT_SCHEMA, allowed: dict = ALLOWED, json_columns: tuple = JSON_COLUMNS) -> dict[str, Column]:
    """Problem name -> condition under which a row has it: nulls, non-finite numbers, values not allowed, text that is no JSON."""
    out: dict[str, Column] = {}
    for f in schema:
        c = F.col(f.name)
        if not f.nullable:
            out[f"{f.name}: null"] = c.isNull()
        if f.dataType.typeName() == "double":
            out[f"{f.name}: not finite"] = F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
        if f.name in allowed:
            out[f"{f.name}: not allowed"] = F.coalesce(~c.isin(*allowed[f.name]), F.lit(False))
        if f.name in json_columns:
            out[f"{f.name}: not JSON"] = c.isNotNull() & F.try_parse_json(c).isNull()
    return out


def event_rules() -> dict[str, Column]:
    """Cross-field rules of the event table: name -> condition under which a row breaks it."""
    t, kind = F.col("event_type"), F.col("change_kind")
    driver = t == "DRIVER_STATE_CHANGE"
    level = t.isin("RISK_ESCALATED", "RISK_DEESCALATED")
    no = lambda c: F.coalesce(c, F.lit(False))
    here = F.col("gps_lat").isNotNull()
    files = F.from_json("evidence_files", "array<string>")
    none = F.col("evidence_kind") == "NONE"
    empty = F.col("evidence_path").isNull() & F.col("evidence_files").isNull()
    bad_path = lambda p: p.rlike(r"^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)")
    return {
        "version": no(F.col("schema_version") != VERSION),
        "inferred": no(~driver & (F.col("observation_type") != "INFERRED")),
        "driver observation": no(driver & (F.col("observation_type") != F.when(kind == "hand_state", "OBSERVED").otherwise("INFERRED"))),
        "driver fields": no(driver & (kind.isNull() | F.col("transition").isNull())),
        "level fields": no(level & (F.col("risk_level").isNull() | F.col("previous_risk_level").isNull() | F.col("transition").isNull())),
        "direction": no(level & ((t == "RISK_ESCALATED") != (rank("risk_level") > rank("previous_risk_level")))),
        "coordinates": here != F.col("gps_lon").isNotNull(),
        "gps source": no(here == (F.col("gps_source") == "UNAVAILABLE")),
        "gps range": no((F.abs("gps_lat") > 90) | (F.abs("gps_lon") > 180)),
        "reserved": F.col("trajectory_overlap").isNotNull(),
        "alarm triggered": no(F.col("alarm_triggered")),
        "evidence": no(none != empty),
        "evidence paths": no(bad_path(F.col("evidence_path"))) | no(F.exists(files, bad_path)),
    }


def problems(checks: dict[str, Column]) -> Column:
    """Names of the checks that a row fails."""
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))


def validated(df: DataFrame, checks: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``problems`` to an event table."""
    return df.withColumn("problems", problems({**field_checks(), **event_rules()} if checks is None else checks))
