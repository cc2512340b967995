"""A training loop whose passes are Spark jobs: softmax regression by full gradients, class weights, early stop on held-out rows."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators.mleval import class_metrics, class_weights


@dataclass
class Softmax:
    """Weights (classes x (features + 1)) of a linear classifier."""

    classes: list[int]
    weights: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.hstack([x, np.ones((len(x), 1))]) @ self.weights.T
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(1, keepdims=True)

    def predict(self, df: DataFrame, vector: str, name: str = "predicted") -> DataFrame:
        """Adds the class with the highest score, of equals the first: a dot product a class, in the JVM."""
        one = lambda w: F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(a)) for a in w[:-1]]), lambda x, y: x * y), F.lit(float(w[-1])), lambda n, x: n + x)
        z = F.array(*[one(w) for w in self.weights])
        own = F.array(*[F.lit(c) for c in self.classes])
        return df.withColumn(name, F.element_at(own, F.array_position(z, F.array_max(z)).cast("int")))


@dataclass
class History:
    model: Softmax
    epochs: list[dict] = field(default_factory=list)
    stopped_at: int | None = None

    @property
    def best(self) -> dict:
        return [e for e in self.epochs if e["is_best"]][-1]


def _sums(rows: DataFrame, vector: str, label: str, model: Softmax, weights: dict[int, float], gradient: bool) -> tuple[float, float, np.ndarray | None]:
    """(weighted loss, weight, gradient) summed over the rows: each task adds up its own part, one number a weight leaves it."""
    place = {c: i for i, c in enumerate(model.classes)}
    own = np.array([weights[c] for c in model.classes])
    shape = model.weights.shape

    def part(batches):
        total = np.zeros(2 + (shape[0] * shape[1] if gradient else 0))
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column(0).to_pylist(), float)
            y = np.array([place[c] for c in b.column(1).to_pylist()])
            p, w = model.scores(x), own[y]
            total[0] += -(w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum()
            total[1] += w.sum()
            if gradient:
                p[np.arange(len(y)), y] -= 1
                total[2:] += ((p * w[:, None]).T @ np.hstack([x, np.ones((len(x), 1))])).ravel()
        yield pa.record_batch({"i": pa.array(np.arange(len(total)), pa.int32()), "x": pa.array(total)})

    got = rows.select(vector, label).mapInArrow(part, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    flat = np.array([r["x"] for r in got])
    return float(flat[0]), float(flat[1]), flat[2:].reshape(shape) if gradient else None


def fit(train: DataFrame, held_out: DataFrame, vector: str, label: str, epochs: int = 30, rate: float = 1.0, decay: float = 0.0, patience: int = 5) -> History:
    """Full-gradient softmax regression; the epoch with the best macro-F1 on held-out rows is kept, of equals the one with the lower loss.

    ``vector``: array<double> of one length; rows with a null vector or label are
    left out.  Classes count by N / (K n_c).  Training ends after ``patience`` epochs
    without a better one (0: never).  Per epoch one job for the gradient and two over
    the held-out rows; classes x features numbers reach the driver.
    """
    ok = F.col(vector).isNotNull() & F.col(label).isNotNull()
    train, held_out = train.filter(ok), held_out.filter(ok)
    w = {r[label]: r["weight"] for r in class_weights(train, label).collect()}
    size = train.select(F.size(vector)).head()[0]
    model = Softmax(sorted(w), np.zeros((len(w), size + 1)))
    held_out = held_out.filter(F.col(label).isin(model.classes))
    out, best, since = History(model), None, 0
    for epoch in range(1, epochs + 1):
        loss, weight, g = _sums(train, vector, label, model, w, True)
        model = Softmax(model.classes, model.weights - rate * (g / weight + decay * model.weights))
        held_loss, held_weight, _ = _sums(held_out, vector, label, model, w, False)
        f1 = class_metrics(model.predict(held_out, vector), label, "predicted").filter(F.col("class").isin(model.classes)).agg(F.sum("f1")).head()[0] or 0.0
        row = {"epoch": epoch, "train_loss": loss / weight, "held_out_loss": held_loss / held_weight if held_weight else 0.0, "macro_f1": f1 / len(model.classes)}
        row["is_best"] = best is None or (row["macro_f1"], -row["held_out_loss"]) > best
        out.epochs.append(row)
        if row["is_best"]:
            best, since, out.model = (row["macro_f1"], -row["held_out_loss"]), 0, model
        else:
            since += 1
        if patience and since >= patience:
            out.stopped_at = epoch
            break
    return out
