"""Greedy one-to-one assignment as a relation, in rounds of pairs that are best for both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.sources.storage import stored


def greedy_matches(pairs: DataFrame, frame: list[str], a: str, b: str, order: list) -> DataFrame:
    """The pairs that a sweep over each frame's pairs in ``order`` would take: each side at most once, the first that finds both free.

    A pair that comes first for both its sides is taken by the sweep whatever else
    there is, so all such pairs are taken at once, what they touch goes, and the rest
    is looked at again.  Every round takes a pair of each frame that has one left;
    as frames and separate groups of boxes go side by side, rounds are few.  ``order``
    should tell pairs of a frame apart; a and b break what ties it leaves.
    """
    names = [f"_o{i}" for i in range(len(order))]
    key = F.struct(*names, a, b)
    left = stored(pairs.select(*pairs.columns, *[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(order, names, strict=True)]), "pairs")
    taken = None
    while left.limit(1).count():
        best = lambda side, name: left.groupBy(*frame, side).agg(F.min(key).alias(name))
        hit = left.join(best(a, "_a"), [*frame, a]).join(best(b, "_b"), [*frame, b])
        hit = stored(hit.filter((F.col("_a") == key) & (F.col("_b") == key)).drop("_a", "_b").select(left.columns), "matches")
        taken = hit if taken is None else taken.unionByName(hit)
        left = stored(left.join(hit.select(*frame, a), [*frame, a], "left_anti").join(hit.select(*frame, b), [*frame, b], "left_anti"), "pairs")
    return (left if taken is None else taken).select(pairs.columns)
