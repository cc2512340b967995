"""State machines of one session; the batch folds and the streaming operators drive the same objects."""

from __future__ import annotations

from dataclasses import dataclass, field

from eventloom.config import EPS, RiskSettings


@dataclass
class Hysteresis:
    """Smoothed level from raw ranks 0-3.

    A level is entered after its number of rows in a row at or above it (the
    highest such level wins); ``down`` rows in a row below step down by one.  A gap
    beyond ``reset_gap`` or a step back in time starts anew, then takes the row.
    """

    settings: RiskSettings = RiskSettings()
    last: float | None = None
    level: int = 0
    below: int = 0
    streaks: list[int] = field(default_factory=lambda: [0, 0, 0])

    def update(self, t: float, raw: int) -> int:
        s = self.settings
        if self.last is not None and (t - self.last > s.reset_gap or t < self.last):
            self.level, self.below, self.streaks = 0, 0, [0, 0, 0]
        self.last = t
        self.streaks = [n + 1 if raw > i else 0 for i, n in enumerate(self.streaks)]
        reached = [i + 1 for i, n in enumerate(self.streaks) if i + 1 > self.level and n >= s.up[i]]
        if reached:
            self.level, self.below = reached[-1], 0
        elif raw < self.level:
            self.below += 1
            if self.below == s.down:
                self.level, self.below = self.level - 1, 0
        else:
            self.below = 0
        return self.level


@dataclass
class Cooldown:
    """Thins rows: each kept one at least ``seconds`` after the last kept one."""

    seconds: float
    last: float | None = None

    def update(self, t: float) -> bool:
        if self.last is not None and t - self.last < self.seconds - EPS:
            return False
        self.last = t
        return True


@dataclass
class GridSampler:
    """Keeps frames on a grid of ``fps``; re-anchors when the stream has left the grid behind.  0 keeps all."""

    fps: float
    next: float | None = None

    def update(self, t: float) -> bool:
        if self.fps <= 0:
            return True
        if self.next is not None and t < self.next - 1e-6:
            return False
        step = 1.0 / self.fps
        due = t if self.next is None else self.next
        self.next = due + step if due + step > t else t + step
        return True


@dataclass
class Printer:
    """Keeps rows whose state is new or that come ``every`` seconds after the last kept one."""

    every: float
    at: float | None = None
    state: object = None

    def update(self, t: float, state) -> bool:
        if self.at is not None and state == self.state and t - self.at < self.every:
            return False
        self.at, self.state = t, state
        return True


@dataclass
class Debounce:
    """Stable value of a noisy state; reports (previous, new) on a change, never for the first."""

    need: int
    unknown: str = "UNKNOWN"
    stable: object = None
    candidate: object = None
    count: int = 0

    def update(self, value) -> tuple | None:
        if value is None or value == self.unknown:
            return None
        if value == self.stable:
            self.candidate, self.count = None, 0
            return None
        self.count = self.count + 1 if value == self.candidate else 1
        self.candidate = value
        if self.count < self.need:
            return None
        before, self.stable, self.candidate, self.count = self.stable, value, None, 0
        return None if before is None else (before, value)


@dataclass
class Closures:
    """Runs of closed eyes: (end, duration, kind) when one ends; an observation gap drops it unseen."""

    max_gap: float = 0.5
    blink: float = 0.5
    long: float = 1.0
    began: float | None = None
    seen: float | None = None

    def update(self, t: float, closed: bool | None) -> tuple | None:
        out = None
        if self.seen is not None and t - self.seen > self.max_gap:
            self.began = None
        if closed is None:
            return None
        if closed:
            self.began = t if self.began is None else self.began
        elif self.began is not None:
            d = t - self.began
            out = (t, d, "blink" if d < self.blink else "long" if d >= self.long else "intermediate")
            self.began = None
        self.seen = t
        return out
