"""N-gram Jaccard join: exact set-similarity classes by filtering under several global token orders.

Tokens are 64-bit hashes of k-word shingles.  Two sets with Jaccard >= t share a
token in the first ``n - ceil(t n) + 1`` places under *every* global order, so
a pair has to pass all of them before its sets are compared:

1. A fixed-size count sketch of all shingles of all documents ranks tokens: order A
   goes by the count itself, orders B and C by hash within coarse frequency
   levels (any total order is correct, so the sketch only decides how few
   candidates there are).
2. Exact copies (equal sets) fold into one class before any posting is shipped.
3. Postings of order A meet by token, and only those stay whose token has another
   class of a size that fits.  A lossless bound thins the pairs: both sizes say how
   much a pair has to share, so its first shared token stands at most so far from
   the start of either set, and so many prefix tokens agree.
4. The survivors must also share a prefix token under orders B and C, and their
   parity bits (a 32nd of a set at most) must not differ in more places than two
   linked sets in tokens; both are tested natively before any set travels.
5. Sets are compared in full.  A first pass compares each class with the likeliest
   of its buckets' smallest and of their largest classes; the second takes *all*
   remaining pairs whose members are not yet in one component.  In a bucket the
   classes outside its leading component meet all others, those inside never meet
   each other: no link between components is lost while a group of near copies
   does not expand into its pairs.

Defined results: null or word-free text has an empty set and links with nothing;
a null doc_id is returned with a null component; repeated rows are returned as
often as they came in; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import (
    chain,
    connected_components,
    forget,
    hash_words,
    id_filter,
    lean,
    materialize,
    mix,
    row_bounds,
    shingle_sets,
    small_batches,
    text_chunks,
    trim,
)

SKETCH_BITS = 22
SKETCH_BLOCK = 1 << 16
_SHIFT = np.uint64(64 - SKETCH_BITS)
_ORDERS = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))


def _sets(batch: pa.RecordBatch, k: int):
    """Row number and sorted distinct shingle hashes of every row."""
    for lo, n, data, off in text_chunks(batch.column("text")):
        h, rows, _, _ = hash_words(data, off, lower=True)
        for i, s in enumerate(shingle_sets(h, row_bounds(rows, n), k)):
            yield lo + i, s


def token_counts(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(fine, coarse) frequency level of every sketch cell over all documents: 2 * 2**SKETCH_BITS bytes."""

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in batches:
            for _, s in _sets(b, k):
                total[(s >> _SHIFT).astype(np.int64)] += 1  # two shingles of a text in one cell count once
        blocks = total.reshape(-1, SKETCH_BLOCK)
        full = np.flatnonzero(blocks.any(1))
        if len(full):
            yield pa.record_batch({"block": pa.array(full, pa.int32()), "counts": pa.array([zlib.compress(blocks[i].tobytes(), 1) for i in full], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH_BLOCK, np.int64)
        for x in t.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
        most = np.minimum(total, (1 << 32) - 1).astype(np.uint32)
        return pa.table({"block": t.column("block")[:1].combine_chunks(), "counts": pa.array([zlib.compress(most.tobytes(), 1)], pa.binary())})

    parts = docs.mapInArrow(lean(count), "block int, counts binary")
    cells = np.zeros((1 << SKETCH_BITS) // SKETCH_BLOCK * SKETCH_BLOCK, np.uint32).reshape(-1, SKETCH_BLOCK)
    for r in parts.groupBy("block").applyInArrow(add, "block int, counts binary").toLocalIterator():
        cells[r["block"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    mean = cells.mean()
    noise = mean + 6 * np.sqrt(mean) + 4
    level = lambda x: np.minimum(x, 255).astype(np.uint8)
    fine = np.stack([level(np.rint(8 * np.log2(1 + c / max(mean, 1.0)))) for c in cells])
    coarse = np.stack([level(np.ceil(2 * np.log2(1 + np.maximum(c - noise, 0)))) for c in cells])
    return fine.ravel(), coarse.ravel()


def _prefixes(s: np.ndarray, sketch: tuple[np.ndarray, np.ndarray], num: int, den: int, others: bool = True) -> tuple[np.ndarray, list[np.ndarray]]:
    """Prefix tokens under order A (whole hashes, in that order) and under the other orders (32 bits: only false positives)."""
    n = len(s)
    p = n - -(-num * n // den) + 1
    if not n:
        return s, [s.astype(np.int32) for _ in _ORDERS]
    cell = (s >> _SHIFT).astype(np.int64)

    def first(rank: np.ndarray, high: np.ndarray) -> np.ndarray:
        key = (high.astype(np.uint64) << np.uint64(56)) | (rank >> np.uint64(8))
        if p == n:
            return s[np.argsort(key, kind="stable")]
        # Equal keys rank by token, as s ascends.
        cut = np.partition(key, p - 1)[p - 1]
        at = np.flatnonzero(key <= cut)
        return s[at[np.argsort(key[at], kind="stable")][:p]]

    if not others:
        return first(mix(s), sketch[0][cell]), []
    rest = [first(mix(s * c), sketch[1][cell]) for c in _ORDERS]
    return first(mix(s), sketch[0][cell]), [np.unique((x & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)) for x in rest]


def _parity(s: np.ndarray) -> np.ndarray:
    """Words of m bits, m the power of two from twice the set's size on: bit i tells whether an odd number of tokens is i modulo m.

    Two sets' bits differ in at most as many places as the sets in tokens, also after the longer one's halves are laid over each other.
    """
    m = max(64, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _need(num: int, den: int, na: str, nb: str) -> str:
    """Fewest tokens that a linked pair shares, given both sizes."""
    return f"(({num}L * ({na} + {nb}) + {num + den - 1}L) div {num + den}L)"


def _near(num: int, den: int) -> str:
    """Whether the parity bits `ap` and `bp` of sets of `an` and `bn` tokens leave a link possible; lengths of more than 2 : 1 are let pass."""

    def half(x: str, y: str) -> str:
        return f"if(size({x}) > size({y}), zip_with(slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y})), (p, q) -> p ^ q), {x})"

    differ = f"aggregate(zip_with({half('ap', 'bp')}, {half('bp', 'ap')}, (p, q) -> bit_count(p ^ q)), 0L, (s, x) -> s + x)"
    return f"(greatest(size(ap), size(bp)) > 2 * least(size(ap), size(bp)) or {differ} <= an + bn - 2L * {_need(num, den, 'an', 'bn')})"


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    off = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=off[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat, kind))


#: Names from here on are numbers of classes; no number of a row reaches it.
BEYOND = 1 << 62


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        return int(mix(s).sum(dtype=np.uint64).astype(np.int64)), int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64))


def profiles(docs: DataFrame, k: int, num: int, den: int, level) -> DataFrame:
    """(doc_id, n, s1, s2, toks): set size, 128-bit set hash, order-A prefix."""

    def run(batches):
        lv = level.value
        for b in batches:
            ids = b.column("doc_id")
            n, s1, s2, toks, at = [], [], [], [], []
            for i, s in _sets(b, k):
                at.append(i)
                n.append(len(s))
                h1, h2 = _set_hash(s)
                s1.append(h1)
                s2.append(h2)
                toks.append(_prefixes(s, lv, num, den, others=False)[0].view(np.int64))
            if at:
                yield pa.record_batch(
                    {"doc_id": ids, "n": pa.array(n, pa.int64()), "s1": pa.array(s1, pa.int64()), "s2": pa.array(s2, pa.int64()), "toks": _lists(toks, pa.int64())}
                )

    return docs.mapInArrow(lean(run), "doc_id long, n long, s1 long, s2 long, toks array<long>")


def _of_classes(docs: DataFrame, ids: DataFrame, k: int, describe, kinds: dict[str, tuple[str, pa.DataType]], name: str) -> DataFrame:
    """``id`` and the columns ``kinds`` that ``describe`` makes of the sets of the classes in ``ids(id, rep, s1)`` (one text scan behind a fixed-size filter).

    A class's set is that of the document ``rep`` whose set has the hash ``s1``: an id may have several texts.
    """
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(id_filter(ids, "rep"))
    size = len(bits.value) * 64

    def run(batches):
        words = bits.value
        for b in batches:
            bit = b.column("bit").to_numpy(zero_copy_only=False).astype(np.int64)
            keep = np.flatnonzero((words[bit >> 6] >> (bit & 63)) & 1)
            if not len(keep):
                continue
            b = b.take(pa.array(keep))
            hashes, out = [], []
            for _, s in _sets(b, k):
                hashes.append(_set_hash(s)[0])
                out.append(describe(s))
            columns = {c: pa.array(x, kind) for (c, (_, kind)), x in zip(kinds.items(), zip(*out, strict=True), strict=True)}
            yield pa.record_batch({"rep": b.column("doc_id"), "s1": pa.array(hashes, pa.int64()), **columns})

    tagged = docs.filter("doc_id is not null").withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(size)))
    found = tagged.mapInArrow(lean(run), ", ".join(["rep long", "s1 long", *(f"{c} {kind}" for c, (kind, _) in kinds.items())]))
    # Repeated rows go where the join has brought them.
    out = materialize(found.join(ids, ["rep", "s1"]).dropDuplicates(["rep", "s1", "id"]).drop("rep", "s1"), name)
    bits.destroy()
    return out


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, num: int, den: int, level) -> DataFrame:
    """Links (src, dst) among candidate ``pairs(a, b)`` of classes: other orders' and parity filters, then exact comparison of what they leave."""
    spark = pairs.sparkSession

    def named(by: DataFrame, pairs: DataFrame) -> DataFrame:
        return materialize(by.select("id", "rep", "s1").join(pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct(), "id", "left_semi"), "ids")

    ids = named(classes, pairs)
    orders = [f"o{i}" for i in range(len(_ORDERS))]
    kinds = {"n": ("long", pa.int64()), **{o: ("array<int>", pa.list_(pa.int32())) for o in orders}, "p": ("array<long>", pa.list_(pa.int64()))}
    filters = _of_classes(docs, ids, k, lambda s: (len(s), *_prefixes(s, level.value, num, den)[1], _parity(s)), kinds, "filters")
    meets = [*(f"arrays_overlap(a{o}, b{o})" for o in orders), _near(num, den)]
    side = lambda c: filters.select(F.col("id").alias(c), *[F.col(x).alias(f"{c}{x}") for x in ("n", *orders, "p")])
    kept = materialize(pairs.join(side("a"), "a").join(side("b"), "b").filter(" and ".join(meets)).select("a", "b"), "kept")
    left = named(ids, kept)
    sets = _of_classes(docs, left, k, lambda s: (s.tobytes(),), {"items": ("binary", pa.binary())}, "sets")
    forget(ids, filters, left)

    # One row for the set of `a` in each of its groups, then the sets it is compared with: groups of at most about 512 members.
    per = kept.groupBy("a").count().select("a", F.ceil(F.col("count") / 512).cast("int").alias("salts"))
    salted = kept.join(per, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    rows = (
        per.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .join(sets.select(F.col("id").alias("a"), "items"), "a")
        .select("a", "salt", F.col("a").alias("b"), F.lit(0).alias("rank"), "items")
        .unionAll(salted.join(sets.select(F.col("id").alias("b"), "items"), "b").select("a", "salt", "b", F.lit(1).alias("rank"), "items"))
    )

    def compare(batches):
        head, key = None, None
        for b in batches:
            src, dst = [], []
            for a, salt, other, rank, items in zip(*(b.column(c).to_pylist() for c in ("a", "salt", "b", "rank", "items")), strict=True):
                x = np.frombuffer(items, np.uint64)
                if not rank:
                    head, key = x, (a, salt)
                elif key == (a, salt):
                    same = len(np.intersect1d(head, x, assume_unique=True))
                    if same and den * same >= num * (len(head) + len(x) - same):
                        src.append(a)
                        dst.append(other)
            yield pa.record_batch({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "rank")
    links = materialize(dealt.mapInArrow(lean(compare), "src long, dst long"), "links")
    forget(sets, kept)
    return links


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs(doc_id, text)``.

    Sets with ``den * |A & B| >= num * |A | B|`` are linked; component_id is the
    smallest doc_id reachable by links.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    level = spark.sparkContext.broadcast(token_counts(docs, k))
    prof = materialize(profiles(docs, k, num, den, level), "profiles")
    rows = materialize(prof.select("doc_id", "n", "s1", "s2"), "rows")

    # A class is a set, whatever ids its documents have.  It is named by its least id, so that pivots are the documents
    # that came first; of sets that share their least id all but one get numbers beyond all such names.
    classes = rows.filter("doc_id is not null and n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")).withColumn("nr", F.monotonically_increasing_id())
    classes = materialize(classes, "classes")
    first = classes.groupBy(F.col("rep").alias("r")).agg(F.min("nr").alias("first"), F.count("*").alias("c")).filter("c > 1")
    own = F.col("first").isNull() | (F.col("first") == F.col("nr"))
    named = classes.join(first, F.col("rep") == F.col("r"), "left").withColumn("id", F.when(own & (F.col("rep") < BEYOND), F.col("rep")).otherwise(F.col("nr") + BEYOND))
    last, classes = classes, materialize(named.select("s1", "s2", "n", "rep", "id"), "classes")
    forget(last)
    # Ids with several sets, few or none: only their rows have to be told apart by their sets.
    several = rows.filter("doc_id is not null and n > 0").groupBy(F.col("doc_id").alias("r")).agg(F.min("s1").alias("a"), F.max("s1").alias("z")).filter("a != z").select("r")
    several = materialize(several, "several")
    own = prof.filter("n > 0").select("doc_id", "s1", "s2", "n", "toks")
    plain = own.filter(F.col("doc_id") < BEYOND).join(several, F.col("doc_id") == F.col("r"), "left_anti").join(classes.select(F.col("rep").alias("r")), F.col("doc_id") == F.col("r"), "left_semi")
    odd = own.join(several, F.col("doc_id") == F.col("r"), "left_semi").unionAll(own.filter(F.col("doc_id") >= BEYOND).join(several, F.col("doc_id") == F.col("r"), "left_anti"))
    odd = odd.join(classes.select(F.col("rep").alias("doc_id"), "s1", "s2", "n", "id"), ["doc_id", "s1", "s2", "n"])
    reps = plain.dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "n", "toks").unionAll(odd.select("id", "n", "toks").dropDuplicates(["id"]))
    post = reps.select("id", "n", F.posexplode("toks").alias("pos", "tok"))

    # A posting meets something only if the next smaller or larger class of its token has a size that fits; of those that do
    # the smallest and the largest class are pivots.  All that in one shuffle.
    of, by_size = Window.partitionBy("tok"), Window.partitionBy("tok").orderBy("n")
    post = post.withColumn("smaller", F.lag("n").over(by_size)).withColumn("larger", F.lead("n").over(by_size))
    met = post.filter(f"{den}L * smaller >= {num}L * n or {den}L * n >= {num}L * larger")
    met = met.select("tok", "id", "n", "pos", F.min(F.struct("id", "n")).over(of).alias("p"), F.max(F.struct("id", "n")).over(of).alias("q"))
    met = materialize(met, "met")
    forget(prof)
    need = functools.partial(_need, num, den)

    def fit(na: str, nb: str) -> str:
        return f"{den}L * least({na}, {nb}) >= {num}L * greatest({na}, {nb})"

    def likeliest(pivot: str) -> DataFrame:
        """For each class the pivot that shares most of its prefix tokens, if they are enough for a link at both sizes."""
        most = f"greatest(({num}L * pn + {den - 1}L) div {den}L, ({num}L * n + {den - 1}L) div {den}L) - 1"
        pairs = met.select("id", "n", F.col(f"{pivot}.id").alias("pid"), F.col(f"{pivot}.n").alias("pn")).filter("id != pid").filter(fit("pn", "n"))
        pairs = pairs.groupBy("pid", "id", "pn", "n").agg(F.count("*").alias("c")).filter(F.expr(f"c >= greatest(1L, {need('pn', 'n')} - ({most}))"))
        best = pairs.groupBy("id").agg(F.max(F.struct("c", (-F.col("pid")).alias("m"))).alias("x"))
        return best.select(F.least("id", -F.col("x.m")).alias("a"), F.greatest("id", -F.col("x.m")).alias("b"))

    first = materialize(likeliest("p").unionAll(likeliest("q")).distinct(), "pairs1")
    links = _verify(first, classes, docs, k, num, den, level)
    comp = connected_components(links)

    at = met.select("tok", "id", "n", "pos").join(comp, "id", "left").select("tok", "id", "n", "pos", F.coalesce("comp", "id").alias("comp"))
    held = at.groupBy("tok", "comp").agg(F.count("*").alias("c")).groupBy("tok").agg(F.max(F.struct("c", "comp")).alias("lead"), F.count("*").alias("comps"))
    at = materialize(at.join(held.filter("comps > 1").select("tok", "lead"), "tok").select("tok", "id", "n", "pos", "comp", (F.col("comp") != F.col("lead.comp")).alias("aside")), "mixed")
    a = at.filter("aside").select("tok", F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("comp").alias("ca"))
    b = at.select("tok", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("comp").alias("cb"), "aside")
    meets = f"ca != cb and (ca < cb or not aside) and {fit('na', 'nb')} and pa <= na - {need('na', 'nb')} and pb <= nb - {need('na', 'nb')}"
    second = a.join(b, "tok").filter(F.expr(meets)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).distinct()
    second = materialize(second.join(first, ["a", "b"], "left_anti"), "pairs2")
    joined = classes.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    if not second.isEmpty():
        # What the second pass links are whole components of the first, each named by its least class.
        more = _verify(second, classes, docs, k, num, den, level)
        met_again = more.join(second, (F.col("src") == F.col("a")) & (F.col("dst") == F.col("b")))
        grown = connected_components(met_again.select(F.col("ca").alias("src"), F.col("cb").alias("dst"))).select(F.col("id").alias("was"), F.col("comp").alias("now"))
        joined = joined.join(grown, F.col("comp") == F.col("was"), "left").withColumn("comp", F.coalesce("now", "comp")).drop("was", "now")
        forget(more)
    joined = materialize(joined, "members")
    forget(met, first, at, second, links, several, classes)
    level.destroy()
    trim()

    least = joined.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = joined.join(least, "comp").select("s1", "s2", "n", "component_id")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.join(named, ["s1", "s2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
