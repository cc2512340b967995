"""Counts that come with a job's own pass, in batch and in streams."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


class Checked:
    """A table that counts, while anything else is done with it, its rows and those that break each rule."""

    def __init__(self, df: DataFrame, rules: dict[str, Column], example: str | None = None):
        self.rules, self.example = list(rules), example
        metrics = [F.count("*").alias("rows")]
        for i, rule in enumerate(rules.values()):
            broken = F.coalesce(rule, F.lit(False))
            metrics.append(F.count_if(broken).alias(f"n{i}"))
            if example:
                metrics.append(F.min(F.when(broken, F.col(example).cast("string"))).alias(f"e{i}"))
        self.seen = Observation()
        self.df = df.observe(self.seen, *metrics)

    @property
    def rows(self) -> int:
        return self.seen.get["rows"]

    def problems(self) -> dict[str, tuple[int, str | None]]:
        """Rule -> (rows that break it, one of them), once the job is done; rules that hold are left out."""
        got = self.seen.get
        return {r: (got[f"n{i}"], got.get(f"e{i}")) for i, r in enumerate(self.rules) if got[f"n{i}"]}


class Progress(StreamingQueryListener):
    """Totals of a session's streams: batches, rows in, rows dropped behind the watermark, and sums of observed counts, by query name."""

    def __init__(self):
        self.batches, self.rows, self.dropped, self.failed = defaultdict(int), defaultdict(int), defaultdict(int), {}
        self.observed: dict = defaultdict(lambda: defaultdict(int))

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        name = p.name or str(p.id)
        self.batches[name] += 1
        self.rows[name] += p.numInputRows
        self.dropped[name] += sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        for metrics in p.observedMetrics.values():
            for k, v in metrics.asDict().items():
                if isinstance(v, int):
                    self.observed[name][k] += v

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.exception:
            self.failed[str(event.id)] = event.exception
