"""Filter interaction audit: what each filter removes, after any others, in every order, from one pass over the texts.

A document fails some of the five filters; its failures are a mask of five bits.
Documents are counted by (part, mask, labels) first.  Each such cell then
contributes to the 80 edges of the subset lattice, (filters already applied,
next filter); an order of the filters is a path along five edges, so the 600
steps of 120 orders are a join with the aggregated edges.

Defined results: a null text is empty; an empty text fails A and nothing else
of A to D; a null source is the part '' like an empty one.  E asks for a smaller
doc_id: of rows that share the least id and the text, none fails; rows without
an id never fail E and make no other row fail it.  Repeated rows count each.  A
document has a label if any of its label rows says 1.  An empty table has no
parts and so no rows.  Further columns are not read.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

FILTERS = "ABCDE"
#: Fewest words, least share of distinct words and greatest share of capitals (percent), signs that no text may hold.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SIGNS = 200, 50, 2, "[#$%&*|]"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def failures(text: Column) -> Column:
    """Bits 1, 2, 4, 8 for the filters A to D of a text without nulls."""
    bare = F.btrim(text, F.lit(" \t\n\v\f\r"))
    words = F.split(bare, r"[\x20\x09-\x0D]+")
    n, distinct = (F.when(bare == "", 0).otherwise(F.size(w)) for w in (words, F.array_distinct(words)))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [n < MIN_WORDS, 100 * distinct < MIN_DISTINCT * n, 100 * capitals > MAX_CAPITALS * F.length(text), text.rlike(SIGNS)]
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by failed filters, labels and part.

    Equal rows are counted together before anything is dealt by a text's hash or
    an id, so neither a group of copies nor a repeated id gathers in a task.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("part"), failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = rows.groupBy("id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    own = rows.filter(F.col("id").isNotNull())
    own = own.join(known, own["id"] == known["label_id"], "left").select("id", "part", "mask", "digest", "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    # Of copies within a part two counts do: all, and those of the least id.  So a text has at most four rows a part from here on.
    groups = own.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("first"))
    low = F.min("least").over(Window.partitionBy("digest"))
    groups = groups.withColumn("stay", F.when(F.col("least") == low, F.col("first")).otherwise(0))
    e = 1 << FILTERS.index("E")
    split = groups.select("part", "good", "toxic", F.inline(F.array(F.struct("mask", F.col("stay").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(e)).alias("mask"), (F.col("n") - F.col("stay")).alias("n")))))
    bare = rows.filter(F.col("id").isNull()).select("part", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "mask", "n")
    return split.unionAll(bare).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).filter("n > 0")


def edges(cells: DataFrame) -> DataFrame:
    """(part, applied, filter, counts): the 80 edges of the lattice in each part; ``applied`` is a mask, ``filter`` a place in FILTERS."""
    pairs = [(s, f) for f in range(len(FILTERS)) for s in range(1 << len(FILTERS)) if not s >> f & 1]
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter")) for s, f in pairs]))
    d = cells.withColumn("edge", each).select("part", "mask", "good", "toxic", "n", "edge.*")
    bit = F.expr("shiftleft(1, filter)")
    gone, fails = F.col("mask").bitwiseAND(F.col("applied")) != 0, F.col("mask").bitwiseAND(bit) != 0
    here = fails & ~gone
    of = {"kept": ~gone & ~fails, "removed": here, "redundant": fails & gone, "unique_fails": F.col("mask") == bit, "good_lost": here & (F.col("good") == 1), "toxic_lost": here & (F.col("toxic") == 1)}
    return d.groupBy("part", "applied", "filter").agg(*[F.sum(F.when(of[c], F.col("n")).otherwise(0)).alias(c) for c in COUNTS])


def order_steps(spark: SparkSession) -> DataFrame:
    """(filter_order, step, applied, filter): the edges along the path of each order."""
    rows = []
    for p in itertools.permutations(range(len(FILTERS))):
        name = "".join(FILTERS[f] for f in p)
        rows += [(name, i + 1, sum(1 << f for f in p[:i]), f) for i, f in enumerate(p)]
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, filter int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step: the step's counts, and its filter's removals summed over all orders (``shapley``)."""
    e = materialize(edges(document_masks(docs, labels)), "filter-edges")
    k = len(FILTERS)
    orders = F.array(*[F.lit(math.factorial(i) * math.factorial(k - 1 - i)) for i in range(k)])
    paths = F.element_at(orders, F.bit_count("applied") + 1)
    value = e.groupBy(F.col("part").alias("p"), F.col("filter").alias("f")).agg(F.sum(F.col("removed") * paths).alias("shapley"))
    e = e.join(value, (F.col("part") == F.col("p")) & (F.col("filter") == F.col("f"))).drop("p", "f")
    steps = order_steps(docs.sparkSession)
    return e.join(F.broadcast(steps), ["applied", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")
