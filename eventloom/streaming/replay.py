"""A stored table played as a file stream, slice after slice of its time, and streams run into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.sources.storage import new_path

#: Key of the row that ends a replay; results leave it out.
END = -1


def replay(df: DataFrame, ts: str, key: str, slices: int, quiet: str = "1 second", files: int = 2) -> tuple[DataFrame, str]:
    """(stream, lateness): the rows of ``df`` in ``slices`` steps of equal time.

    Inside a slice rows come in any order, over several files, so the lateness is a
    slice's length.  A last row with key END, later than all by ``quiet`` and the
    lateness, lets the watermark pass everything.
    """
    spark = df.sparkSession
    d = df.withColumn(ts, F.col(ts).cast("timestamp"))
    us = F.unix_micros(ts)
    lo, hi = d.agg(F.min(us), F.max(us)).head()
    lo, hi = lo or 0, hi or 0
    step = (hi - lo) // slices + 1
    path = new_path(spark, "replay")
    for i in range(slices):
        d.filter((us >= lo + i * step) & (us < lo + (i + 1) * step)).repartition(files).write.mode("append").parquet(path)
    end = spark.range(1).select(F.expr(f"timestamp_micros({hi + 2 * step + 2_000_000}L) + INTERVAL {quiet}").alias(ts))
    end.select(*[F.lit(END).cast(f.dataType).alias(f.name) if f.name == key else F.col(ts) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in d.schema]).write.mode("append").parquet(path)
    return spark.readStream.schema(d.schema).option("maxFilesPerTrigger", files).parquet(path), f"{step + 1_000_000} microseconds"


def run_to_table(stream: DataFrame, name: str, checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """All that is there, appended to a table of the shared folder; rerun with the same places to go on where it stopped."""
    spark = stream.sparkSession
    path, checkpoint = path or new_path(spark, name), checkpoint or new_path(spark, f"{name}-checkpoint")
    q = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
