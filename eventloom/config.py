"""Settings as frozen dataclasses; their values become literals that Catalyst folds.

Every field can be overridden from the environment as ``EVENTLOOM_<FIELD>``.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

LEVELS = ("SAFE", "CAUTION", "HIGH", "CRITICAL")
EPS = 1e-9


@dataclass(frozen=True)
class Points:
    """Most points of each road factor for one kind of object (fixed values)."""

    persistence: float
    centrality: float
    approach: float
    size: float
    trajectory: float


@dataclass(frozen=True)
class RiskSettings:
    # Thresholds, windows and weights of the scoring rules.
    caution: float = 20.0
    high: float = 45.0
    critical: float = 70.0
    vehicles: tuple = ("car", "truck", "bus", "motorcycle", "bicycle", "train")
    persons: tuple = ("person",)
    animals: tuple = ("dog", "cat", "cow", "horse", "sheep", "elephant")
    min_persistence: float = 0.5
    min_detections: int = 3
    max_missed: float = 0.3
    window: float = 1.0
    min_span: float = 0.3
    min_samples: int = 3
    central: float = 0.20
    near: float = 0.35
    lower: float = 0.45
    growth_min: float = 0.15
    growth_full: float = 0.80
    lateral_min: float = 0.05
    lateral_full: float = 0.30
    size_min: float = 0.01
    size_full: float = 0.12
    persistence_full: float = 2.0
    vehicle: Points = Points(10, 10, 25, 10, 5)
    person: Points = Points(10, 15, 15, 5, 20)
    animal: Points = Points(10, 15, 15, 5, 20)
    presence_cap: float = 20.0
    multi_bonus: float = 5.0
    road_cap: float = 70.0
    confidence_reference: float = 0.60
    min_confidence: float = 0.50
    label_penalty: float = 0.15
    min_stability: float = 0.50
    drowsy_high: float = 30.0
    drowsy_critical: float = 45.0
    hands_off: float = 25.0
    head_away: float = 10.0
    head_yaw: float = 30.0
    head_pitch: float = 25.0
    head_seconds: float = 1.0
    driver_cap: float = 60.0
    driver_age: float = 1.0
    combined_bonus: float = 15.0
    combined_reference: float = 30.0
    strong_road: float = 60.0
    up: tuple = (1, 2, 3)
    down: int = 2
    decay: float = 40.0
    reset_gap: float = 2.0
    alarm_level: str = "HIGH"


@dataclass(frozen=True)
class TrackSettings:
    iou_same: float = 0.3
    iou_switch: float = 0.6
    max_missed: float = 1.0
    max_frames: int = 0


@dataclass(frozen=True)
class EventSettings:
    persistent_seconds: float = 2.0
    persistent_level: str = "CAUTION"
    hazard_cooldown: float = 10.0
    change_observations: int = 3
    change_cooldown: float = 5.0
    evidence_before: float = 5.0
    evidence_after: float = 5.0


@dataclass(frozen=True)
class DriverSettings:
    ear_closed: float = 0.20
    window: float = 60.0
    min_observed: float = 5.0
    max_gap: float = 0.5
    blink: float = 0.5
    long: float = 1.0
    sustained: float = 2.0
    ratio_max: float = 0.30
    long_max: int = 3
    ratio_weight: float = 0.6
    high: float = 0.5
    critical: float = 0.8
    hand_confidence: float = 0.60
    no_hands: float = 2.0


def from_env(settings, prefix: str = "EVENTLOOM_", env: dict | None = None):
    """``settings`` with scalar fields replaced from the environment, cast to the field's own type."""
    env = os.environ if env is None else env
    new = {}
    for f in fields(settings):
        raw, now = env.get(prefix + f.name.upper()), getattr(settings, f.name)
        if raw is None or not isinstance(now, (int, float, str)):
            continue
        try:
            new[f.name] = type(now)(raw)
        except ValueError as e:
            raise ValueError(f"{prefix}{f.name.upper()}: {raw!r} is no {type(now).__name__}") from e
    return check(replace(settings, **new))


def check(settings):
    """Reject settings that no run could mean."""
    if isinstance(settings, RiskSettings):
        if not 0 < settings.caution < settings.high < settings.critical <= 100:
            raise ValueError("level thresholds must ascend within 0-100")
        if settings.alarm_level not in LEVELS or min(settings.up) < 1 or settings.down < 1 or settings.decay <= 0 or settings.reset_gap <= 0:
            raise ValueError("smoothing settings must be positive")
    if isinstance(settings, TrackSettings) and (not 0 < settings.iou_same <= 1 or settings.max_missed < 0 or settings.max_frames < 0):
        raise ValueError("tracker settings out of range")
    if isinstance(settings, DriverSettings) and (settings.window <= 0 or not settings.blink <= settings.long or not settings.high < settings.critical):
        raise ValueError("driver settings out of range")
    if isinstance(settings, EventSettings) and (settings.change_observations < 1 or settings.persistent_level not in LEVELS or min(settings.hazard_cooldown, settings.change_cooldown) < 0):
        raise ValueError("event settings out of range")
    return settings
