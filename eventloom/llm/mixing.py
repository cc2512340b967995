"""Mixing sources to target weights by weighted fair queueing.

Every source serves its documents in a shuffled order, again in a new order
while its target asks for repeats.  A document's virtual finish time is the
words its source has served with it, divided by the source's target: at time 1
every source has served its target.  All are sorted by that time over all
workers and the mix ends where the total budget does.  A document during which
its source meets its target is cut there, so sources end within a word of it.

Running totals are exact and in no single task: rows are range-sorted, summed
within each range, and the totals of the ranges before are added.

Defined results: a null text has size 0; rows without a source are a source of
their own, last in order; repeated rows are documents each; without any words
nothing is taken and targets are 0; an empty table gives no rows.  Reruns agree:
the shuffle is a hash of seed, round and doc_id, ties go by size.  Further
columns are not read.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, running_total


def word_count(text):
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\v\f\r"))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """(source, source_size, weight, target) of ``sizes(source, size)``.

    Sources, ordered by code point, take the weights in turn and share ``share``
    of all words.  No target is above ``cap`` times its source: what is too much
    goes to the others by weight, in rounds of one aggregate, until none is above.
    """
    per = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    one = per.select("source", "source_size", F.col("source").isNull().alias("last"), F.lit(1).cast("long").alias("one"))
    nth = running_total(one, [], ["last", "source"], "one", "nth")
    s = nth.select("source", "source_size", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("nth") - 1) % len(weights) + 1).cast("int")).alias("weight"))
    total, w = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).head()
    budget, fixed, most = share * total, 0, F.col("source_size") * cap
    level = (budget, w)
    while level[1]:
        # Sources above their cap at the level so far; their number only grows.
        held, out = s.filter(F.lit(float(level[0])) * F.col("weight") / level[1] > most).agg(F.coalesce(F.sum(most), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).head()
        if out == fixed:
            break
        fixed, level = out, (budget - held, w - out)
    fair = F.lit(float(level[0])) * F.col("weight") / level[1] if level[1] else most.cast("double")
    return s.select("source", "source_size", "weight", F.least(fair, most.cast("double")).alias("target"))


def queue(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: str = "mix") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, targets, mix).

    ``documents(row, doc_id, source, size)``; ``targets`` as above;
    ``mix(row, round, words, finish, total)``: what is served, one row a serving, in order of
    ``total``, the words of the mix up to and including it.  A serving with fewer words than
    its document is its first ``words`` words.
    """
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    targets = materialize(source_targets(sized, weights, share, cap), "mix-targets")
    budget = targets.agg(F.coalesce(F.sum(F.floor("target")), F.lit(0))).head()[0]
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    d = sized.filter("size > 0").join(t, F.col("source").eqNullSafe(F.col("s"))).filter("target >= 1")
    rounds = F.ceil(F.col("target") / F.col("source_size")).cast("int")
    d = d.withColumn("round", F.explode(F.sequence(F.lit(0), rounds - 1)))
    d = d.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.col("round").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    served = running_total(d, ["source"], ["round", "key", "doc_id", "size", "row"], "size", "served")
    # A serving that crosses its source's target is two pieces, the second after time 1.
    end = F.floor("target")
    before = F.greatest(F.lit(0), F.least(F.col("size"), end - F.col("served") + F.col("size")))
    piece = lambda words, at: F.struct(words.cast("long").alias("words"), at.cast("long").alias("at"))
    parts = served.withColumn("before", before).select("row", "round", "key", "target", F.inline(F.array(piece(F.col("before"), F.least("served", end)), piece(F.col("size") - F.col("before"), F.col("served")))))
    parts = parts.filter("words > 0").select("row", "round", "key", "words", (F.col("at") / F.col("target")).alias("finish"))
    mix = running_total(parts, [], ["finish", "key", "row"], "words", "total")
    return sized, targets, mix.filter(F.col("total") <= budget).select("row", "round", "words", "finish", "total")


def taken_words(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: str = "mix") -> DataFrame:
    """(doc_id, size, source_size, target, taken): one row per document with the words that the mix takes of it."""
    sized, targets, mix = queue(docs, weights, share, cap, seed)
    got = mix.groupBy(F.col("row").alias("r")).agg(F.sum("words").alias("taken"))
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    out = sized.join(t, F.col("source").eqNullSafe(F.col("s")))
    return out.join(got, F.col("row") == F.col("r"), "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
