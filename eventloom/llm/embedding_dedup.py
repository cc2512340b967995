"""Embedding near-duplicates by a random-projection tree forest.

Trees are fitted on a bounded sample (SAMPLE_ROWS rows by hash of the id): each
inner node projects on a random direction, cuts where fewest points lie near
the cut, and sends points within a margin of it to both sides (spill).  Every
vector is routed through every tree; vectors meet in leaves and are compared in
double precision.  A pair counts in the first tree that brings it together, so
links are counted once without shipping pairs.  A node as narrow as the linking
distance stays a leaf, and leaves of more than BLOCK rows are compared block
against block, so no task holds an unbounded leaf.

Equal vectors fold into one class first; a class's size is its weight.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different lengths never link; a null
vec_id links with nothing and has a null component; repeated rows each count
as a vector; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize

TREES = 8
SAMPLE_ROWS = 32_768
LEAF_ROWS = 192
BLOCK = 2048
MAX_SPILL = 0.15


class Tree:
    """One fitted tree: arrays of directions, cuts and children; leaves are negative numbers."""

    def __init__(self, rng, sample: np.ndarray, margin: float, scale: float, leaf_rows: int):
        self.dirs, self.lo, self.hi, self.left, self.right = [], [], [], [], []
        self.leaves = 0
        self.rng, self.margin, self.scale, self.leaf_rows = rng, margin, scale, leaf_rows
        self.root = self._grow(sample)
        self.D = np.array(self.dirs) if self.dirs else np.zeros((0, sample.shape[1]))
        del self.rng

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, x: np.ndarray) -> int:
        if len(x) <= self.leaf_rows:
            return self._leaf()
        r = self.rng.standard_normal(x.shape[1])
        r /= np.linalg.norm(r)
        p = np.sort(x @ r)
        if p.std() < self.scale:
            return self._leaf()
        cuts = np.quantile(p, np.linspace(0.35, 0.65, 31))
        near = np.searchsorted(p, cuts + self.margin, "right") - np.searchsorted(p, cuts - self.margin)
        cut = cuts[int(np.argmin(near))]
        at = np.searchsorted(p, cut) / len(p)
        lo = max(cut - self.margin, np.quantile(p, max(0.0, at - MAX_SPILL)))
        hi = min(cut + self.margin, np.quantile(p, min(1.0, at + MAX_SPILL)))
        p = x @ r
        a, b = x[p <= hi], x[p >= lo]
        if len(a) > 0.9 * len(x) or len(b) > 0.9 * len(x):
            return self._leaf()
        i = len(self.dirs)
        for held, v in ((self.dirs, r), (self.lo, lo), (self.hi, hi), (self.left, 0), (self.right, 0)):
            held.append(v)
        self.left[i], self.right[i] = self._grow(a), self._grow(b)
        return i

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf from 0) of every place that the rows of x reach."""
        rows, leaves, todo = [], [], [(self.root, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                leaves.append(np.full(len(at), -node - 1))
                continue
            p = x[at] @ self.D[node]
            todo += [(self.left[node], at[p <= self.hi[node]]), (self.right[node], at[p >= self.lo[node]])]
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def fit_forest(sample: np.ndarray, threshold: float, trees: int = TREES, seed: int = 11, leaf_rows: int = LEAF_ROWS) -> list[Tree]:
    """Trees over unit vectors; the spill margin is half the typical projection of a linking distance."""
    dim = sample.shape[1]
    scale = math.sqrt(2 * (1 - threshold) / dim)
    return [Tree(np.random.default_rng((seed, t)), sample, scale / 2, scale, leaf_rows) for t in range(trees)]


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _local_roots(ids: np.ndarray, link: np.ndarray) -> np.ndarray:
    """Smallest id reachable within a boolean link matrix."""
    label = ids.copy()
    while True:
        new = label.copy()
        a, b = np.nonzero(link)
        np.minimum.at(new, a, label[b])
        if (new == label).all():
            return label
        label = new


def _link_classes(classes: DataFrame, dim: int, threshold: float, trees: int, sample_rows: int, leaf_rows: int) -> DataFrame:
    """(id, w, root) rows from every leaf: links of class ``id`` counted there and the smallest id it reaches there."""
    spark = classes.sparkSession
    drawn = classes.select("rep", "embedding").orderBy(F.xxhash64("rep"), "rep", "embedding").limit(sample_rows).toArrow()
    if not drawn.num_rows:
        return spark.createDataFrame([], "id long, w long, root long")
    sample = _unit(drawn.column("embedding").combine_chunks(), dim)
    forest = spark.sparkContext.broadcast(fit_forest(sample, threshold, trees, leaf_rows=leaf_rows))
    first = np.cumsum([0] + [t.leaves for t in forest.value]).tolist()

    def sizes(batches):
        total = np.zeros(first[-1], np.int64)
        for b in batches:
            x = _unit(b.column("embedding"), dim)
            for t, base in zip(forest.value, first, strict=False):
                total += np.bincount(t.route(x)[1] + base, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch({"leaf": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    # As many rows as the forest has leaves, which the sample bounds.
    counted = classes.select("embedding").mapInArrow(sizes, "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n")).filter(F.col("n") > BLOCK).collect()
    blocks = {r["leaf"]: -(-r["n"] // BLOCK) for r in counted}

    def deal(batches):
        for b in batches:
            x = _unit(b.column("embedding"), dim)
            ids = b.column("id").to_numpy()
            places: list[list[int]] = [[] for _ in ids]
            routed = []
            for t, base in zip(forest.value, first, strict=False):
                rows, leaves = t.route(x)
                routed.append((rows, leaves + base))
                for r, leaf in zip(rows.tolist(), (leaves + base).tolist(), strict=True):
                    places[r].append(leaf)
            packed = [np.array(sorted(p), "<i4").tobytes() for p in places]
            keys, own, at = [], [], []
            for rows, leaves in routed:
                for r, leaf in zip(rows.tolist(), leaves.tolist(), strict=True):
                    n = blocks.get(leaf, 1)
                    mine = (int(ids[r]) * 0x9E3779B1 >> 7) % n
                    for other in range(n):
                        keys.append((leaf, min(mine, other), max(mine, other)))
                        own.append(mine)
                        at.append(r)
            for lo in range(0, len(keys), 4000):
                take = pa.array(at[lo : lo + 4000])
                k = list(zip(*keys[lo : lo + 4000], strict=True))
                yield pa.record_batch(
                    {
                        "leaf": pa.array(k[0], pa.int32()), "i": pa.array(k[1], pa.int32()), "j": pa.array(k[2], pa.int32()), "own": pa.array(own[lo : lo + 4000], pa.int32()),
                        "id": b.column("id").take(take), "c": b.column("c").take(take), "embedding": b.column("embedding").take(take), "places": pa.array([packed[r] for r in at[lo : lo + 4000]], pa.binary()),
                    }
                )

    kind = classes.schema["embedding"].dataType.simpleString()
    dealt = classes.select("id", "c", "embedding").mapInArrow(deal, f"leaf int, i int, j int, own int, id long, c long, embedding {kind}, places binary")

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        leaf, i, j = (t.column(c)[0].as_py() for c in ("leaf", "i", "j"))
        x = _unit(t.column("embedding").combine_chunks(), dim)
        ids, c, own = (t.column(n).to_numpy() for n in ("id", "c", "own"))
        link = x @ x.T >= threshold
        np.fill_diagonal(link, False)
        if i != j:
            link &= own[:, None] != own[None, :]
        hit = np.flatnonzero(link.any(1))
        link, ids, c = link[np.ix_(hit, hit)], ids[hit], c[hit]
        # Leave out pairs that an earlier leaf has: earlier trees' leaves, then this tree's smaller leaves.
        met: dict[int, list[int]] = {}
        for r, p in enumerate(t.column("places").take(pa.array(hit)).to_pylist()):
            for x in np.frombuffer(p, "<i4").tolist():
                if x < leaf:
                    met.setdefault(x, []).append(r)
        count = link.copy()
        for rows in met.values():
            if len(rows) > 1:
                count[np.ix_(rows, rows)] = False
        return pa.table({"id": pa.array(ids, pa.int64()), "w": pa.array(count @ c, pa.int64()), "root": pa.array(_local_roots(ids, link), pa.int64())})

    return materialize(dealt.groupBy("leaf", "i", "j").applyInArrow(compare, "id long, w long, root long"), "leaf-links")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, trees: int = TREES, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors(vec_id, embedding)``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    sound = F.expr("vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x != 0)")
    good = rows.filter(sound)
    # A class is a vector, whatever ids its rows have: it gets a number of its own, as two vectors may share their least id.
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("c"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    found = None
    for r in classes.select(F.size("embedding").alias("d")).distinct().collect():
        part = _link_classes(classes.filter(F.size("embedding") == r["d"]), r["d"], threshold, trees, sample_rows, leaf_rows)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], "id long, w long, root long")
    counts = found.groupBy("id").agg(F.sum("w").alias("w"))
    comp = connected_components(found.filter("id != root").select(F.col("id").alias("src"), F.col("root").alias("dst")).distinct())
    joined = classes.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    least = joined.groupBy("comp").agg(F.min("rep").alias("least"))
    known = joined.join(least, "comp").join(counts, "id", "left").select("embedding", (F.coalesce("w", F.lit(0)) + F.col("c") - 1).alias("n"), F.col("least").alias("comp"))
    out = good.join(known, "embedding").select("vec_id", F.col("n").alias("n_links"), F.col("comp").alias("component_id"))
    lone = rows.filter(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionAll(lone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
