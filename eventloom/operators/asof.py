"""As-of and band joins.

``nearest`` and ``band`` deal both sides into time buckets as wide as the
tolerance, so a row meets its own and the two neighbouring buckets by equality:
a plain shuffle join, never a nested loop.  ``backward`` needs no join at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.config import EPS


def _bucket(t: str, width: float) -> Column:
    return F.floor(F.col(t) / F.lit(float(width))).cast("long")


def band(left: DataFrame, right: DataFrame, keys: list[str], lt: str, rt: str, before: float, after: float) -> DataFrame:
    """Pairs with ``lt - before <= rt <= lt + after``; only the left side is repeated, at most three times."""
    width = max(before, after, 1e-6) + EPS
    near = left.withColumn("_b", F.explode(F.array(*[_bucket(lt, width) + i for i in (-1, 0, 1)])))
    pairs = near.join(right.withColumn("_b", _bucket(rt, width)), [*keys, "_b"])
    return pairs.filter((F.col(rt) >= F.col(lt) - before) & (F.col(rt) <= F.col(lt) + after)).drop("_b")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], lt: str, rt: str, max_age: float, take: list[str]) -> DataFrame:
    """Each left row with its nearest right row within ``max_age`` (ties: the earlier one), or nulls.

    Matches are found for each time that a session's left rows have, so rows may
    share an id, a time or everything and each keeps its own match.
    """
    times = left.select(*keys, lt).distinct()
    pairs = band(times, right.select(*keys, rt, *take), keys, lt, rt, max_age + EPS, max_age + EPS)
    best = pairs.groupBy(*keys, lt).agg(F.min(F.struct(F.abs(F.col(lt) - F.col(rt)).alias("d"), F.col(rt).alias("_rt"), *take)).alias("_m"))
    got = best.select(*keys, lt, F.col("_m._rt").alias(rt), *[F.col(f"_m.{c}").alias(c) for c in take])
    return left.join(got, [*keys, lt], "left").select(*left.columns, rt, *take)


def backward(left: DataFrame, right: DataFrame, keys: list[str], lt: str, rt: str, take: list[str], tail: float | None = None, max_age: float | None = None) -> DataFrame:
    """Each left row with the latest right row at or before it, in one exchange: union, sort, carry forward.

    ``tail``: nothing once the right side ended that long ago; ``max_age``: nothing older than that.
    """
    lcols = [c for c in left.columns if c not in keys]
    packed = F.struct(F.col(rt).alias("_rt"), *[F.col(c).alias(f"_{c}") for c in take])
    a = left.select(*keys, F.col(lt).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType).alias("_r"), F.struct(*lcols).alias("_l"))
    b = right.select(*keys, (F.col(rt) - EPS).alias("_t"), F.lit(0).alias("_side"), packed.alias("_r"), F.lit(None).cast(left.select(F.struct(*lcols).alias("x")).schema["x"].dataType).alias("_l"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    u = a.unionByName(b).withColumn("_m", F.last("_r", True).over(w))
    if tail is not None:
        u = u.withColumn("_end", F.max("_r._rt").over(Window.partitionBy(*keys)))
    out = u.filter("_side = 1")
    ok = F.lit(True)
    if tail is not None:
        ok = ok & (F.col("_t") <= F.col("_end") + tail)
    if max_age is not None:
        ok = ok & (F.col("_t") - F.col("_m._rt") <= max_age)
    return out.select(*keys, *[F.col(f"_l.{c}").alias(c) for c in lcols], *[F.when(ok, F.col(f"_m._{c}")).alias(c) for c in take])


def outer_diff(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Full-outer comparison of two assignments: common, moved, only_left, only_right."""
    j = left.select(key, F.col(value).alias("_a"), F.lit(True).alias("_l")).join(right.select(key, F.col(value).alias("_b"), F.lit(True).alias("_r")), key, "full_outer")
    kind = F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right").when(F.col("_a").eqNullSafe(F.col("_b")), "common").otherwise("moved")
    return j.select(key, F.col("_a").alias("left_value"), F.col("_b").alias("right_value"), kind.alias("status"))


def expected_found(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are missing or unexpected."""
    missing = expected.select(*keys).distinct().join(found, keys, "left_anti").withColumn("status", F.lit("missing"))
    extra = found.select(*keys).distinct().join(expected, keys, "left_anti").withColumn("status", F.lit("unexpected"))
    return missing.unionByName(extra)
