"""Sources: tolerant and strict JSON lines, documents, GPS logs, file listings, and the loader of real events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from eventloom.schemas import EVENT_SCHEMA, REAL_SOURCES


def _hadoop_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def lines_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_ord, ordinal, line): lines with a number that ascends within each file.

    Spark reads a file in byte ranges, several to a task, and packs them as it likes.
    The range a line comes from and its number in the task's own order tell lines of a
    file apart and in their order whatever the split size, without pulling a file into one task.
    """
    out = None
    for i, p in enumerate(paths):
        place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nr"))
        d = spark.read.text(p).select(F.lit(i).alias("file_ord"), place.alias("ordinal"), F.col("value").alias("line"))
        out = d if out is None else out.unionAll(d)
    return out if out is not None else spark.createDataFrame([], "file_ord int, ordinal struct<file: string, start: bigint, nr: bigint>, line string")


@dataclass
class Loaded:
    """A loaded event table with its audit: files read and missing, and counts as one-row tables."""

    events: DataFrame
    read: list[str]
    missing: list[str]
    malformed: DataFrame
    excluded: DataFrame
    duplicates: DataFrame


def parse_events(lines: DataFrame, schema: StructType = EVENT_SCHEMA) -> DataFrame:
    """Parsed lines with ``ok``: an object with a non-empty event_type and event_id.  Wrongly typed fields become null."""
    loose = StructType([StructField(f.name, f.dataType) for f in schema])
    v = F.try_parse_json("line")
    d = lines.filter(F.trim("line") != "").withColumn("_v", v)
    cols = []
    for f in loose:
        kind = f.dataType.simpleString()
        own = F.try_variant_get("_v", f"$.{f.name}", kind)
        if kind in ("double", "bigint"):
            # A number given as text or a flag is no number.
            own = F.when(F.schema_of_variant(F.try_variant_get("_v", f"$.{f.name}", "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), own)
        cols.append(own.alias(f.name))
    ok = F.col("_v").isNotNull() & F.schema_of_variant("_v").startswith("OBJECT")
    d = d.select("file_ord", "ordinal", "line", ok.alias("_obj"), *cols)
    return d.withColumn("ok", F.col("_obj") & (F.coalesce("event_type", F.lit("")) != "") & (F.coalesce("event_id", F.lit("")) != "")).drop("_obj")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, nulls being equal to each other."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def event_order() -> list:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    t = F.when(~F.isnan("timestamp") & (F.abs("timestamp") < float("inf")), F.col("timestamp"))
    return [text("run_id"), text("session_id"), F.coalesce(t, F.lit(0.0)), text("event_id")]


def load_events(spark: SparkSession, paths: list[str]) -> Loaded:
    """Real events of JSON-lines files: tolerant parse, source filter, first of each (run, event), in event order."""
    there = [p for p in paths if _hadoop_exists(spark, p)]
    parsed = parse_events(lines_of(spark, there))
    real = F.coalesce(F.col("data_source").isin(*REAL_SOURCES), F.lit(False))
    good = parsed.filter("ok").filter(real)
    kept = first_wins(good, ["run_id", "event_id"], ["file_ord", "ordinal"])
    return Loaded(
        events=kept.drop("line", "ok").orderBy(*event_order()), read=there, missing=[p for p in paths if p not in there], malformed=parsed.agg(F.count_if(~F.col("ok")).alias("malformed")),
        excluded=parsed.filter("ok").filter(~real).groupBy(F.coalesce("data_source", F.lit("None")).alias("data_source")).agg(F.count("*").alias("n")), duplicates=good.agg((F.count("*") - F.countDistinct(F.struct(F.coalesce("run_id", F.lit("")), "event_id"))).alias("duplicates")),
    )


def read_strict(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines that must all parse; a missing file is an empty table."""
    if not _hadoop_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: StructType, source: str) -> DataFrame:
    """Rows of one data source; lines that do not parse are dropped."""
    s = StructType([*schema.fields]).add("_corrupt", "string")
    return spark.read.schema(s).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).filter(F.col("_corrupt").isNull() & (F.col("data_source") == source)).drop("_corrupt")


def read_document(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema is not None else r).json(path)


def read_split(spark: SparkSession, path: str, classes: list[str]) -> DataFrame:
    """A split manifest whose labels must agree with their class numbers."""
    d = spark.read.schema("path string, label string, class_index int, split string, hand_state string, sha256 string, capture_format string").json(path)
    own = (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1).cast("int")
    bad = F.raise_error(F.concat(F.lit("label and class number differ: "), F.col("path")))
    return d.withColumn("class_index", F.when(own == F.col("class_index"), F.col("class_index")).otherwise(bad.cast("int")))


def read_gps(spark: SparkSession, path: str, source: str) -> DataFrame:
    """A GPS log with header; an empty accuracy is null; positions out of range are dropped."""
    d = spark.read.option("header", True).schema("timestamp double, lat double, lon double, accuracy_m double").csv(path)
    return d.filter((F.abs("lat") <= 90) & (F.abs("lon") <= 180) & F.col("timestamp").isNotNull()).withColumn("source", F.lit(source))


def list_files(spark: SparkSession, root: str, pattern: str | None = None, content: bool = False) -> DataFrame:
    """(path relative to root, length[, content]) of all files under a folder but empty ones, which Spark's source passes over; contents are read only if asked for."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    d = (r.option("pathGlobFilter", pattern) if pattern else r).load(root)
    base = root.rstrip("/").split("://")[-1] + "/"
    rel = F.substring_index(F.col("path"), base, -1)
    return d.select(rel.alias("path"), "length", *(["content"] if content else []))


def file_digests(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path, length, sha256) of the files under a folder; each file is read by one task and only its digest leaves it."""
    return list_files(spark, root, pattern, content=True).select("path", "length", F.sha2("content", 256).alias("sha256"))


def camera_folders(files: DataFrame, names: list[str], depth: int = 4) -> DataFrame:
    """First folders, down to ``depth`` and outside dot-folders, that have a camera's name."""
    parts = F.split("path", "/")
    p = files.select(parts.alias("p"), F.posexplode(F.slice(parts, 1, F.greatest(F.lit(0), F.least(F.lit(depth), F.size(parts) - 1)))).alias("d", "name"))
    p = p.filter(F.lower("name").isin(*names) & ~F.exists(F.slice("p", 1, F.col("d") + 1), lambda x: x.startswith(".")))
    p = p.withColumn("folder", F.array_join(F.slice("p", 1, F.col("d") + 1), "/"))
    inner = F.exists(F.slice("p", 1, F.col("d")), lambda x: F.lower(x).isin(*names))
    return p.filter(~inner).select(F.lower("name").alias("camera"), "folder").distinct()
