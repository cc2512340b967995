"""Column functions shared by the operators; all stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.config import LEVELS, RiskSettings


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """A number, or null where it is NaN or infinite."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def or_else(c, label: str = "not recorded") -> Column:
    """Null and empty text both count as missing."""
    return F.coalesce(F.nullif(col(c).cast("string"), F.lit("")), F.lit(label))


def fixed(c, digits: int, sign: str = "") -> Column:
    """A number with ``digits`` places, ties to even as the shortest decimal text has them; null stays null."""
    c = F.bround(col(c).cast("double"), digits)
    return F.when(c.isNotNull(), F.format_string(f"%{sign}.{digits}f", c))


def rank(level) -> Column:
    """0 for SAFE .. 3 for CRITICAL; null for anything else."""
    at = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), col(level))
    return F.when(at > 0, (at - 1).cast("int"))


def level_name(r) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.greatest(F.lit(0), F.least(F.lit(3), col(r))).cast("int") + 1)


def level_for_score(score, s: RiskSettings = RiskSettings()) -> Column:
    c = col(score)
    return F.when(c >= s.critical, 3).when(c >= s.high, 2).when(c >= s.caution, 1).otherwise(0)


def ramp(x, lo: float, hi: float) -> Column:
    """0 at lo, 1 at hi, straight between, clamped; a step where hi <= lo."""
    x = col(x)
    if hi <= lo:
        return F.when(x >= hi, 1.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / (hi - lo)))


def iou(a: tuple, b: tuple) -> Column:
    """Intersection over union of boxes given as (x1, y1, x2, y2) columns; 0 without a union."""
    a, b = tuple(map(col, a)), tuple(map(col, b))
    side = lambda i: F.greatest(F.lit(0.0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]))
    inter = side(0) * side(1)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def eye_openness(p: list) -> Column:
    """Eye aspect ratio from six landmarks (structs x, y): mean lid gap over eye width; null for a width near 0."""
    d = lambda i, j: F.hypot(p[i]["x"] - p[j]["x"], p[i]["y"] - p[j]["y"])
    return F.when(d(0, 3) >= 1e-6, (d(1, 5) + d(2, 4)) / (2.0 * d(0, 3)))


#: Named aspect ratios (width over height), in the order in which they are tried.
ASPECTS = (("1:1", 1.0), ("4:3", 4 / 3), ("3:4", 3 / 4), ("16:9", 16 / 9), ("9:16", 9 / 16), ("3:2", 1.5), ("2:3", 2 / 3))


def aspect_label(w, h) -> Column:
    """Name of the first usual aspect ratio within 0.02, else ``other`` with the ratio; null without a height."""
    r = F.try_divide(col(w).cast("double"), col(h).cast("double"))
    out = F.when(r.isNull(), F.lit(None).cast("string"))
    for name, value in ASPECTS:
        out = out.when(F.abs(r - value) < 0.02, name)
    return out.otherwise(F.concat(F.lit("other ("), fixed(r, 2), F.lit(")")))


def orientation(w, h) -> Column:
    w, h = col(w), col(h)
    return F.when(w > h, "landscape").when(w < h, "portrait").when(w == h, "square")


def fourcc(code) -> Column:
    """The four characters packed in a codec number, without blanks and zeros around them; null where nothing is left."""
    c = F.coalesce(col(code).cast("long"), F.lit(0))
    text = F.concat(*[F.chr(F.shiftright(c, 8 * i).bitwiseAND(0xFF)) for i in range(4)])
    return F.nullif(F.btrim(text, F.lit("\x00 ")), F.lit(""))


def clock(t) -> Column:
    """Seconds as mm:ss.s."""
    t = F.round(col(t), 1)
    return F.format_string("%02d:%04.1f", F.floor(t / 60).cast("int"), t - F.floor(t / 60) * 60)


def frame_at(fraction, n) -> Column:
    """Index of the frame at a fraction of n frames: half-even rounding, within the film; null without frames."""
    n = col(n)
    return F.when(n > 0, F.greatest(F.lit(0), F.least(n - 1, F.rint(col(fraction) * (n - 1)).cast("long"))))


def iso_after(base: str, seconds) -> Column:
    """Base time plus seconds, in ISO form to the microsecond."""
    return F.date_format(F.timestamp_micros(F.unix_micros(F.to_timestamp(F.lit(base))) + F.round(col(seconds) * 1e6).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c, rounded once: product and sum with their rounding errors (Dekker, Knuth)."""

    def parts(x: Column) -> Column:
        return let(x * 134217729.0, lambda big: let(big - (big - x), lambda hi: F.struct(hi.alias("hi"), (x - hi).alias("lo"))))

    def added(v: Column) -> Column:
        p, x, y = v["p"], v["x"], v["y"]
        lost = ((x["hi"] * y["hi"] - p) + x["hi"] * y["lo"] + x["lo"] * y["hi"]) + x["lo"] * y["lo"]
        return let(p + c, lambda s: let(s - p, lambda r: s + (((p - (s - r)) + (c - r)) + lost)))

    return let(F.struct((a * b).alias("p"), parts(a).alias("x"), parts(b).alias("y")), added)
