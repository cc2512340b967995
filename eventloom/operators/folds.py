"""Sequential operators: closed forms where one exists, else a streaming fold per session.

``folded`` deals rows by key, sorts within partitions and streams Arrow batches
through one small state machine at a time: linear in rows, constant in memory,
whatever a session's length.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from eventloom.config import RiskSettings
from eventloom.operators.machines import Closures, Cooldown, GridSampler, Hysteresis, Printer
from eventloom.operators.ordered import islands, ordered


def folded(df: DataFrame, keys: list[str], order: list[str], machine: Callable, step: Callable, adds: str = "", reads: list[str] | None = None) -> DataFrame:
    """Rows that ``step(machine, row)`` keeps, in order within each key.

    ``step`` returns None to drop a row or a tuple of values for the columns ``adds``;
    ``reads`` names the columns that it looks at (all, if None).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    more = _parse_datatype_string(adds).fields if adds else []
    names = df.columns
    kind = StructType([*df.schema.fields, *[StructField(f.name, f.dataType) for f in more]])
    extra = to_arrow_schema(StructType(more))

    read = list(dict.fromkeys([*keys, *reads])) if reads is not None else names

    def run(batches):
        key, state = None, None
        for b in batches:
            keep, values = [], []
            # Only what the machine reads becomes Python objects; the other columns are taken as they are.
            for i, row in enumerate(zip(*(b.column(c).to_pylist() for c in read), strict=True)):
                r = dict(zip(read, row, strict=True))
                k = tuple(r[c] for c in keys)
                if k != key:
                    key, state = k, machine()
                out = step(state, r)
                if out is not None:
                    keep.append(i)
                    values.append(out)
            at = pa.array(keep, pa.int64())
            new = {f.name: pa.array([v[j] for v in values], f.type) for j, f in enumerate(extra)}
            yield pa.record_batch({**{c: b.column(c).take(at) for c in names}, **new})

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, kind)


def hysteresis(df: DataFrame, keys: list[str], order: list[str], t: str, raw: str, s: RiskSettings = RiskSettings()) -> DataFrame:
    """Adds ``level``: the smoothed rank of each row (see machines.Hysteresis)."""
    return folded(df, keys, order, lambda: Hysteresis(s), lambda m, r: (m.update(r[t], r[raw]),), "level int", [t, raw])


def decayed_score(df: DataFrame, keys: list[str], order: list[str], t: str, raw: str, s: RiskSettings = RiskSettings()) -> DataFrame:
    """Adds ``smoothed``: rises at once, falls by at most ``decay`` a second, never below the raw score.

    ``max over j <= i of raw_j - decay (t_i - t_j)`` within stretches without a reset gap: a running maximum.
    """
    gap = F.col(t) - F.lag(t).over(ordered(keys, order))
    d = islands(df, keys, order, F.coalesce((gap > s.reset_gap) | (gap < 0), F.lit(False)), "_part")
    run = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("smoothed", F.max(F.col(raw) + s.decay * F.col(t)).over(run) - s.decay * F.col(t)).drop("_part")


def cooldown(df: DataFrame, keys: list[str], order: list[str], t: str, seconds: float) -> DataFrame:
    """Rows at least ``seconds`` after the last kept row of their key."""
    return folded(df, keys, order, lambda: Cooldown(seconds), lambda m, r: () if m.update(r[t]) else None, reads=[t])


def sampled(df: DataFrame, keys: list[str], order: list[str], t: str, fps: float) -> DataFrame:
    """Frames on a grid of ``fps`` (see machines.GridSampler)."""
    return folded(df, keys, order, lambda: GridSampler(fps), lambda m, r: () if m.update(r[t]) else None, reads=[t])


def emitted_on_change(df: DataFrame, keys: list[str], order: list[str], t: str, state: str, every: float) -> DataFrame:
    """Rows worth printing (see machines.Printer)."""
    return folded(df, keys, order, lambda: Printer(every), lambda m, r: () if m.update(r[t], r[state]) else None, reads=[t, state])


def closures(df: DataFrame, keys: list[str], order: list[str], t: str, closed: str, max_gap: float, blink: float, long: float) -> DataFrame:
    """Rows that end a run of closed eyes, with ``duration`` and ``kind`` (see machines.Closures)."""
    return marked_closures(df, keys, order, t, closed, max_gap, blink, long).filter("kind IS NOT NULL")


def marked_closures(df: DataFrame, keys: list[str], order: list[str], t: str, closed: str, max_gap: float, blink: float, long: float) -> DataFrame:
    """Every row, with ``duration`` and ``kind`` where it ends a run of closed eyes."""
    return folded(df, keys, order, lambda: Closures(max_gap, blink, long), lambda m, r: e[1:] if (e := m.update(r[t], r[closed])) else (None, None), "duration double, kind string", [t, closed])


def debounced(df: DataFrame, keys: list[str], order: list[str], state: str, need: int, unknown: str = "UNKNOWN") -> DataFrame:
    """Changes of the stable state, natively.

    Unknown rows are invisible; the first stable value is a baseline.  A run shorter
    than ``need`` leaves no trace, so only the ``need``-th row of a run can change
    the stable state, and it does when it differs from the last such row.
    """
    w = ordered(keys, order)
    d = df.filter(F.col(state).isNotNull() & (F.col(state) != unknown))
    d = islands(d, keys, order, ~F.col(state).eqNullSafe(F.lag(state).over(w)), "_run")
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(*order))).filter(F.col("_k") == need)
    d = d.withColumn("previous", F.lag(state).over(w))
    return d.filter(F.col("previous").isNotNull() & (F.col("previous") != F.col(state))).drop("_run", "_k")


def stream_clock(df: DataFrame, keys: list[str], index: str, container: str, fps: float) -> DataFrame:
    """Frame time: the container's where it has one, else index / fps; never going back."""
    own = F.coalesce(F.col(container), F.col(index) / F.lit(float(fps)))
    w = Window.partitionBy(*keys).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("t", F.max(own).over(w)).withColumn("clock", F.when(F.col(container).isNotNull(), "container").otherwise("index"))


def timelines(df: DataFrame, keys: list[str], order: list[str], t: str) -> DataFrame:
    """Number of the timeline each row belongs to: a step back in time begins another."""
    back = F.col(t) < F.lag(t).over(ordered(keys, order))
    return islands(df, keys, order, F.coalesce(back, F.lit(False)), "timeline")
