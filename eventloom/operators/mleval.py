"""Classifier evaluation and small vector operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, predicted: str, classes: list) -> DataFrame:
    """One row per true class with a count per predicted class, zeros included."""
    names = df.sparkSession.createDataFrame([(c,) for c in classes], f"{truth} {dict(df.dtypes)[truth]}")
    got = df.groupBy(truth).agg(*[F.count_if(F.col(predicted) == c).alias(f"pred_{c}") for c in classes])
    return names.join(got, truth, "left").fillna(0)


def class_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of every class; 0 where a denominator is."""
    each = df.select(F.explode(F.array(F.struct(F.col(truth).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("x"), (F.col(truth) == F.col(predicted)).alias("hit"))
    g = each.groupBy(F.col("x.c").alias("class")).agg(F.sum("x.t").alias("support"), F.sum("x.p").alias("predicted"), F.sum(F.when(F.col("hit") & (F.col("x.t") == 1), 1).otherwise(0)).alias("hits"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    g = g.withColumn("precision", ratio("hits", "predicted")).withColumn("recall", ratio("hits", "support"))
    return g.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """N / (K n_c) of each class."""
    g = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    w = Window.partitionBy()
    return g.withColumn("weight", F.sum("n").over(w) / (F.count("*").over(w) * F.col("n")))


def threshold_analysis(df: DataFrame, confidence: str, correct: str, thresholds: list[float]) -> DataFrame:
    """Unknown, coverage and accuracy of accepted rows at each threshold."""
    d = df.select(confidence, correct, F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold"))
    ok = F.col(confidence) >= F.col("threshold")
    return d.groupBy("threshold").agg(F.count_if(~ok).alias("unknown"), F.avg(ok.cast("double")).alias("coverage"), F.avg(F.when(ok, F.col(correct).cast("double"))).alias("accuracy"))


def predict(probabilities: str, classes: list[str], threshold: float, unknown: str = "UNKNOWN") -> tuple[Column, Column]:
    """(class, confidence): the first largest share after normalising, unknown below the threshold."""
    total = F.aggregate(probabilities, F.lit(0.0), lambda n, x: n + x)
    share = F.transform(probabilities, lambda x: x / total)
    top = F.array_max(share)
    name = F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(share, top).cast("int"))
    return F.when((total > 0) & (top >= threshold), name).otherwise(unknown), top


def squared_distance(a: str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda n, x: n + x)


def assigned(df: DataFrame, vector: str, centres: list[list[float]]) -> DataFrame:
    """Nearest of a few fixed centres (ties: the first)."""
    d = [squared_distance(vector, F.array(*[F.lit(float(x)) for x in c])) for c in centres]
    return df.withColumn("distance", F.least(*d) if len(d) > 1 else d[0]).withColumn("cluster", (F.array_position(F.array(*d), F.col("distance")) - 1).cast("int"))


def luma(pixels: str) -> tuple[Column, Column]:
    """(mean, population standard deviation) of an array."""
    n = F.size(pixels)
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x) / n
    return mean, F.sqrt(F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x * x) / n - mean * mean)


def early_stopped(epochs: DataFrame, keys: list[str], order: str, score: str, loss: str, patience: int) -> DataFrame:
    """Epochs up to the early stop, with ``is_best`` and ``since_best``: a higher score is better, of equal ones the lower loss.

    Training ends with the epoch that is the ``patience``-th in a row without a better one; 0 never ends it.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(F.struct(F.col(score), -F.col(loss))).over(before)
    d = epochs.withColumn("is_best", F.coalesce(F.struct(F.col(score), -F.col(loss)) > best, F.lit(True))).withColumn("_i", F.row_number().over(w))
    d = d.withColumn("since_best", F.col("_i") - F.max(F.when(F.col("is_best"), F.col("_i"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ended = F.max(F.col("since_best") >= patience).over(before)
    return (d if patience <= 0 else d.withColumn("_ended", F.coalesce(ended, F.lit(False))).filter("not _ended").drop("_ended")).drop("_i")
