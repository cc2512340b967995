"""Seeded k-means: D-squared starts by prefix sums over ranges, Lloyd rounds of one job each, the items nearest to the centres."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from eventloom.operators.mleval import squared_distance
from eventloom.sources.storage import stored


def uniform(seed: int, i: int) -> float:
    """The i-th number of a seed, in [0, 1)."""
    return int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16) / 4294967296


def _literal(centre: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in centre])


def _distances(centres: list[list[float]]) -> list[Column]:
    return [squared_distance("v", _literal(c)) for c in centres]


def nearest(centres: list[list[float]]) -> Column:
    """Number of the nearest centre, of equals the first."""
    d = F.array(*_distances(centres))
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def _pick(ranged: DataFrame, weight: Column, u: float) -> tuple[list[float], float]:
    """(vector, total): the first item, in order, at which the running sum of weights exceeds ``u`` times the total.

    Ranges are summed first; only the range in which the sum passes is then walked.
    """
    d = ranged.withColumn("w", weight)
    totals = [(r["pid"], r["w"]) for r in d.groupBy("pid").agg(F.sum("w").alias("w")).orderBy("pid").collect()]
    total, before, at = sum(w for _, w in totals), 0.0, None
    for pid, w in totals:
        if w > 0:
            at, start = pid, before
        if w > 0 and before + w > u * total:
            break
        before += w
    if at is None:
        return [], 0.0
    inside = d.filter((F.col("pid") == at) & (F.col("w") > 0)).withColumn("s", F.sum("w").over(Window.orderBy("item").rowsBetween(Window.unboundedPreceding, 0)))
    # Rounding may leave the last sum at the mark: then the last item is it.
    best = inside.agg(F.min_by("v", F.when(F.col("s") + start > u * total, F.col("item"))).alias("v"), F.max_by("v", "item").alias("last")).head()
    return list(best["v"] if best["v"] is not None else best["last"]), total


def starts(ranged: DataFrame, k: int, seed: int) -> list[list[float]]:
    """k centres: one at random, each further one in proportion to the squared distance to those before; where all distances are 0, at random."""
    first, _ = _pick(ranged, F.lit(1.0), uniform(seed, 0))
    centres = [first]
    for i in range(1, k):
        c, total = _pick(ranged, F.least(*_distances(centres)) if len(centres) > 1 else _distances(centres)[0], uniform(seed, i))
        centres.append(c if total > 0 else _pick(ranged, F.lit(1.0), uniform(seed, i))[0])
    return centres


def lloyd(rows: DataFrame, centres: list[list[float]], rounds: int) -> list[list[float]]:
    """Centres after at most ``rounds`` rounds, or when no item changes; a centre without items stays.  A round is one job with partial sums."""
    size, old = len(centres[0]), None
    for _ in range(rounds):
        d = rows.withColumn("c", nearest(centres)).withColumn("moved", F.lit(True) if old is None else F.col("c") != nearest(old))
        got = d.groupBy("c").agg(F.count_if("moved").alias("moved"), *[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(size)]).collect()
        if old is not None and not sum(r["moved"] for r in got):
            break
        old, centres = centres, [list(c) for c in centres]
        for r in got:
            centres[r["c"]] = [r[f"m{i}"] for i in range(size)]
    return centres


def representatives(df: DataFrame, item: str, vector: str, k: int, seed: int, rounds: int = 50) -> DataFrame:
    """(cluster, n, item): the item nearest to each centre and its cluster's size, large clusters first; of at most k items every one.

    Only centres and range totals reach the driver.  Items should be unique; rows whose vector is null are left out.
    """
    d = df.filter(F.col(vector).isNotNull()).select(F.col(item).alias("item"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    ranged = stored(d.repartitionByRange("item").sortWithinPartitions("item").withColumn("pid", F.spark_partition_id()), "ranged")
    n = ranged.count()
    if n <= k or k <= 0:
        return ranged.select(F.lit(0).alias("cluster"), F.lit(1).cast("long").alias("n"), "item").orderBy("item").limit(max(k, 0))
    centres = lloyd(ranged, starts(ranged, k, seed), rounds)
    a = ranged.withColumn("cluster", nearest(centres)).withColumn("d", F.array_min(F.array(*_distances(centres))))
    g = a.groupBy("cluster").agg(F.count("*").alias("n"), F.min_by("item", F.struct("d", "item")).alias("item"))
    return g.orderBy(F.desc("n"), "item")
