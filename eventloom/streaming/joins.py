"""As-of joins of two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventloom.streaming.in_order import InOrder, in_order


def backward_within(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, lt: str, rt: str, take: list[str], max_age: str, lateness: str) -> DataFrame:
    """Each left row with the latest right row at or before it and no older than ``max_age``, or nulls.

    Built in: an interval join bounded on both sides by watermarks, whose state Spark
    drops as they pass, then the latest match of each left row once nothing can be added.
    A row behind its side's watermark is dropped, as in every stream.
    """
    a = left.select(*keys, left_id, F.col(lt).cast("timestamp").alias("lt")).withWatermark("lt", lateness)
    b = right.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col(rt).cast("timestamp").alias("rt"), F.struct(*[F.col(c) for c in take]).alias("m")).withWatermark("rt", lateness)
    met = (F.col("rt") <= F.col("lt")) & (F.col("rt") >= F.col("lt") - F.expr(f"INTERVAL {max_age}"))
    for k in keys:
        met = met & (F.col(k) == F.col(f"r_{k}"))
    j = a.join(b, met, "left_outer")
    best = j.groupBy(*keys, left_id, "lt").agg(F.max_by("m", "rt").alias("m"))
    return best.select(*keys, left_id, "lt", *[F.col(f"m.{c}").alias(c) for c in take])


class Backward(InOrder):
    """Carries the latest right row to the left rows; past ``tail`` after it a left row waits until the right side goes on.

    Input rows are of both sides: ``left_id`` is null on right rows.
    """

    def __init__(self, schema: StructType, take: list[str], tail: int, timeout: int):
        super().__init__(schema, "us", "tie", timeout)
        self.take, self.tail = take, tail

    def run(self, key, rows):
        right, held = self.own or (None, [])
        out = []
        none = (None,) * len(self.take)
        for r in rows:
            if r.left_id is None:
                # The right side goes on, so what waited was inside it.
                out += [(i, us, *right[1:]) for i, us in held]
                right, held = (r.us, *(r[c] for c in self.take)), []
            elif right is None:
                out.append((r.left_id, r.us, *none))
            elif r.us <= right[0] + self.tail:
                out.append((r.left_id, r.us, *right[1:]))
            else:
                held.append((r.left_id, r.us))
        self.own = right, held
        return out

    def close_session(self, key, last):
        return [(i, us, *(None,) * len(self.take)) for i, us in (self.own or (None, []))[1]]


def backward_tail(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, lt: str, rt: str, take: list[str], tail: int, timeout: int, lateness: str = "1 second") -> DataFrame:
    """Each left row with the latest right row at or before it; none once the right side has ended ``tail`` microseconds ago."""
    side = lambda d, t, i, cols: d.select(*keys, F.col(t).cast("timestamp").alias("ts"), F.unix_micros(F.col(t).cast("timestamp")).alias("us"), i.cast("long").alias("left_id"), *cols)
    a = side(left, lt, F.col(left_id), [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in take])
    b = side(right, rt, F.lit(None), [F.col(c) for c in take])
    both = b.unionByName(a).withColumn("tie", F.coalesce("left_id", F.lit(-1)))
    schema = both.select("us", "tie", "left_id", *take).schema
    adds = ", ".join(["left_id long", "us long", *[f"`{c}` {right.schema[c].dataType.simpleString()}" for c in take]])
    return in_order(both, keys, "ts", Backward(schema, take, tail, timeout), adds, lateness)
