"""Benchmark decontamination in DataFrame and SQL expressions alone.

A document is contaminated by an item when one of its windows, as long in words
as the item, has a multiplicity-weighted Jaccard similarity of word shingles of
at least ``t`` with it (a document shorter than the item is one window).

* Where to look: a similarity of t leaves at most ``y = m (1-t)`` of an item's m
  shingles out.  Inner words at least ``k`` places apart, more than y / k of them
  and as long as can be had, serve as anchors: one of them must stand in the
  window with one of its shingles whole, at any place, as a moved block costs
  only the shingles at its seams.  So every window over such a place is looked
  at.  Of these, windows with too few shingles that are the item's at all (a
  bound on the similarity, from running sums) go; none that reaches t is lost.
* Each window and item gets a 64-bit SimHash of its shingles.  A fingerprint
  within RADIUS of another agrees with it on at least one of RADIUS + 1 blocks,
  so an equality join on (item text, block, bits) finds every pair within RADIUS;
  a window meets the items alone whose anchor it lies over.
* What remains is verified by exact similarity.

At a similarity of exactly 0.8 fingerprints differ in about 10 of 64 bits
(deviation 3); RADIUS 20 misses about one such window in 5,000, and fewer above.

Anchors are broadcast in slices of at most ANCHOR_ROWS rows, one scan a slice.

Defined results: null texts and texts without words match nothing; null ids
match nothing; items that share a text each match; repeated rows of a document
give one result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, unused

RADIUS = 20
ANCHOR_ROWS = 100_000
_SPLIT = r"[\\x20\\x09-\\x0D]+"


def _words(col: str) -> str:
    return f"filter(split(lower({col}), '{_SPLIT}'), x -> x != '')"


def _shingles(words: str, k: int | str) -> str:
    """Hashes of the k-word shingles of an array; a shorter array is one shingle."""
    return f"transform(sequence(1, greatest(1, size({words}) - {k} + 1)), i -> xxhash64(concat_ws(' ', slice({words}, i, {k}))))"


def _simhash(hashes: str) -> str:
    ones = f"transform(sequence(0, 63), b -> 2 * aggregate({hashes}, 0, (n, h) -> n + cast(shiftright(h, b) & 1L as int)) > size({hashes}))"
    return f"aggregate(transform({ones}, (up, b) -> if(up, shiftleft(1L, b), 0L)), 0L, (n, x) -> n | x)"


def _blocks() -> list[tuple[int, int]]:
    """(first bit, bits) of RADIUS + 1 blocks that make up the 64 bits."""
    cuts = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _block_keys(fp: str) -> str:
    return "array(" + ", ".join(f"struct({i} as k, shiftrightunsigned({fp}, {a}) & {(1 << n) - 1}L as v)" for i, (a, n) in enumerate(_blocks())) + ")"


def items_of(benchmark: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(item_id, words, len, sh, m, ih, y, fp) of every item with words; ih names the text."""
    items = benchmark.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.expr(_words("text")).alias("words")).filter("size(words) > 0")
    items = items.withColumn("len", F.size("words")).withColumn("sh", F.expr(_shingles("words", k))).withColumn("m", F.size("sh")).withColumn("ih", F.xxhash64("len", "sh"))
    # Written out: an array of hashes that an expression walks 64 times must not be worked out 64 times.
    items = materialize(items, "bench-items")
    # Most item shingles that a window or a shorter document may lack.
    items = items.withColumn("y", F.expr(f"cast((m * {den - num}L) div {den}L as int)"))
    return items.withColumn("fp", F.expr(_simhash("sh")))


def anchors_of(items: DataFrame, k: int) -> DataFrame:
    """(word, ih, o, len, y, near): anchor words, their places, and the hashes of the item's shingles that hold them."""
    a = items.dropDuplicates(["ih"]).withColumn("a", F.expr(f"y div {k} + 1"))
    # Inner places 4 .. len - 5 cost k shingles each; where there are none any word serves, as y is 0 then.
    a = a.withColumn("from", F.expr(f"if(len >= {2 * k - 1}, {k - 1}, 0)")).withColumn("room", F.expr(f"if(len >= {2 * k - 1}, len - {2 * k - 2}, len)"))
    a = a.withColumn("tight", F.expr(f"a > 1 and room div a < {k} or (y > 0 and len < {2 * k - 1})"))
    a = a.withColumn("from", F.expr("if(tight, 0, from)")).withColumn("a", F.expr("if(tight, len, a)")).withColumn("seg", F.expr("if(tight, 1, cast(room div a as int))"))
    p = a.select("ih", "len", "y", "a", "from", "seg", "tight", "sh", "m", F.posexplode("words").alias("o", "word"))
    p = p.withColumn("s", F.expr("if(o >= from, cast((o - from) div seg as int), -1)")).filter(f"s >= 0 and s < a and (a = 1 or tight or (o - from) - s * seg <= seg - {k})")
    best = p.groupBy("ih", "s").agg(F.max_by(F.struct("word", "o", "len", "y", "sh", "m"), F.struct(F.length("word"), -F.col("o"))).alias("z"))
    near = F.expr(f"slice(sh, greatest(0, o - {k - 1}) + 1, least(o, m - 1) - greatest(0, o - {k - 1}) + 1)")
    return best.select("ih", "z.*").select("word", "ih", "o", "len", "y", near.alias("near"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity, distance): each document's best window for each item it leaks."""
    items = items_of(benchmark, k, num, den)
    anchors = anchors_of(items, k)
    slices = -(-anchors.count() // ANCHOR_ROWS) or 1
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(_words("text")).alias("words"))

    # Words a shingle: an item of fewer than k words is one shingle.
    width = f"least(len, {k})"

    def regions(part: DataFrame) -> DataFrame:
        # Only documents that hold an anchor word go on, once for each id.
        held = materialize(texts.filter(F.arrays_overlap("words", part.agg(F.collect_set("word")).scalar())).dropDuplicates(["doc_id", "words"]), "anchored")
        at = held.select("doc_id", F.size("words").alias("n"), F.xxhash64("words").alias("h"), F.posexplode("words").alias("pos", "word")).join(F.broadcast(part), "word").filter("n >= len - y")
        at = at.withColumn("lo", F.expr("greatest(0, least(pos - len + 1, n - len))")).withColumn("hi", F.expr("greatest(0, least(pos, n - len))"))
        at = at.join(held.withColumn("h", F.xxhash64("words")), ["doc_id", "h"])
        around = _shingles(f"slice(words, greatest(0, pos - {width} + 1) + 1, pos + {width} - greatest(0, pos - {width} + 1))", width)
        at = at.filter(F.expr(f"n < len or arrays_overlap({around}, near)"))
        return at.select("doc_id", "h", "ih", "len", "lo", "hi", F.expr("slice(words, lo + 1, hi - lo + len)").alias("part"))

    slice_of = lambda i: anchors.filter(F.pmod(F.xxhash64("word"), F.lit(slices)) == i) if slices > 1 else anchors
    shingled = reduce(DataFrame.unionAll, [regions(slice_of(i)) for i in range(slices)]).withColumn("rs", F.expr(_shingles("part", width)))
    # before[i]: how many of the first i shingles are the item's; bound outside the lambda so that it is worked out once.
    before = "aggregate(transform(rs, r -> if(array_contains(ish, r), 1, 0)), array(0), (c, f) -> concat(c, array(element_at(c, -1) + f)))"
    size = f"greatest(1, least(len, size(part)) - {width} + 1)"
    enough = f"{num + den}L * (get(c, s - lo + {size}) - get(c, s - lo)) >= {num}L * (size(ish) + {size})"
    starts = F.expr(f"flatten(transform(array({before}), c -> filter(sequence(lo, hi), s -> {enough})))")
    shingled = shingled.join(items.dropDuplicates(["ih"]).select("ih", F.col("sh").alias("ish")), "ih")
    windows = shingled.select("doc_id", "h", "ih", "len", F.explode(starts).alias("start"), "lo", "rs", F.expr(size).alias("size"))
    windows = windows.select("doc_id", "h", "ih", "len", "start", F.expr("slice(rs, start - lo + 1, size)").alias("sh")).dropDuplicates(["doc_id", "h", "ih", "start"])
    windows = materialize(windows.drop("h"), "windows").withColumn("fp", F.expr(_simhash("sh")))

    # Fingerprints alone are listed under their blocks; shingles join the pairs within the radius, not the blocks.
    w = windows.select("doc_id", "ih", "start", "fp", F.explode(F.expr(_block_keys("fp"))).alias("b")).select("doc_id", "ih", "start", "fp", "b.k", "b.v")
    i = items.select("item_id", "ih", F.col("fp").alias("ifp"), F.explode(F.expr(_block_keys("fp"))).alias("b")).select("item_id", "ih", "ifp", "b.k", "b.v")
    met = w.join(i, ["ih", "k", "v"]).withColumn("distance", F.expr("bit_count(fp ^ ifp)")).filter(F.col("distance") <= RADIUS)
    met = met.groupBy("doc_id", "ih", "start", "item_id").agg(F.min("distance").alias("distance"))
    near = met.join(windows.select("doc_id", "ih", "start", "len", "sh"), ["doc_id", "ih", "start"]).join(items.select("item_id", "ih", F.col("sh").alias("ish")), ["item_id", "ih"])
    # Sum over distinct shingles of the smaller and of the larger multiplicity.
    count = lambda a: f"size(filter({a}, y -> y = s))"
    same = F.expr(f"aggregate(array_intersect(sh, ish), 0, (n, s) -> n + least({count('sh')}, {count('ish')}))")
    near = near.withColumn("same", same).withColumn("both", F.expr("size(sh) + size(ish) - same")).filter(F.expr(f"{den}L * same >= {num}L * both"))
    near = near.withColumn("similarity", F.expr("same / both"))
    best = near.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("start", F.size("sh").alias("n"), "len", "similarity", "distance"), F.struct("similarity", -F.col("start"))).alias("z"))
    return best.select("doc_id", "item_id", F.col("z.start").alias("start"), F.col("z.len").alias("n_words"), F.col("z.similarity").alias("similarity"), F.col("z.distance").cast("int").alias("distance"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without the documents that leak an item."""
    own = unused("id", docs)
    leaks = find_leaks(docs, benchmark, k, num, den).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(leaks, docs["doc_id"] == leaks[own], "left_anti")
