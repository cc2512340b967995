"""File audits and dataset splits over a listing (path, length, content)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.ordered import numbered_places, placed

#: Suffixes by kind.
IMAGE, VIDEO, TEXT = (".jpg", ".jpeg", ".png", ".bmp", ".webp"), (".mp4", ".avi", ".mov", ".mkv"), (".json", ".jsonl", ".csv", ".txt", ".md")


def kind_of(path) -> Column:
    """image, video, text or other, by suffix."""
    s = F.lower(F.concat(F.lit("."), F.element_at(F.split(path, r"\."), -1)))
    return F.when(s.isin(*IMAGE), "image").when(s.isin(*VIDEO), "video").when(s.isin(*TEXT), "text").otherwise("other")


def located(df: DataFrame, path: str, cameras: list[str]) -> DataFrame:
    """Camera, class folder and subfolder of a path: the first camera component, the one after it, the rest but the name."""
    d = df.withColumn("_p", F.split(path, "/")).withColumn("_low", F.transform("_p", F.lower))
    at = F.array_min(F.filter(F.transform(F.array(*[F.lit(c) for c in cameras]), lambda c: F.array_position("_low", c).cast("int")), lambda i: i > 0))
    d = d.withColumn("_at", at).withColumn("_n", F.size("_p"))
    has = lambda k: F.col("_at").isNotNull() & (F.col("_n") > F.col("_at") + k)
    return d.withColumns({"camera": F.when(F.col("_at").isNotNull(), F.element_at("_low", F.col("_at"))), "label": F.when(has(1), F.element_at("_p", F.when(has(1), F.col("_at") + 1).otherwise(1))), "subfolder": F.when(has(2), F.array_join(F.slice("_p", F.col("_at") + 2, F.greatest(F.lit(0), F.col("_n") - F.col("_at") - 2)), "/"))}).drop("_p", "_low", "_at", "_n")


def class_files(files: DataFrame, classes: list[str], suffixes: tuple = IMAGE, strict: bool = True) -> DataFrame:
    """Files of class folders (path, label), with their class's number and ``place``: by class, path without case, path.

    System files are passed over, other suffixes are kept with ``ignored`` true and no place.
    A class without a folder is an error, or with ``strict`` off a row of its own whose path is null.
    """
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    known = files.sparkSession.createDataFrame([(c, i) for i, c in enumerate(classes)], "label string, class_index int")
    d = files.select("path", "label").join(F.broadcast(known), "label").filter(~name.startswith(".") & ~name.isin("desktop.ini", "thumbs.db"))
    d = d.withColumn("ignored", ~F.lower(F.concat(F.lit("."), F.element_at(F.split("path", r"\."), -1))).isin(*suffixes))
    gone = known.join(files.select("label").distinct(), "label", "left_anti")
    if strict and (missing := [r["label"] for r in gone.orderBy("class_index").collect()]):
        raise ValueError(f"class folders that are not there: {', '.join(missing)}")
    good = numbered_places(d.filter("not ignored"), ["class_index", "label"], [F.lower("path"), "path"], "place")
    sizes = good.groupBy(F.col("class_index").alias("c")).agg(F.count("*").alias("n"))
    # As many rows as there are classes.
    before = sizes.select("c", F.coalesce(F.sum("n").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    good = good.join(before, F.col("class_index") == F.col("c")).select("path", "label", "class_index", "ignored", (F.col("place") + F.col("before")).alias("place"))
    out = good.unionByName(d.filter("ignored").withColumn("place", F.lit(None).cast("long")))
    return out if strict else out.unionByName(gone.withColumns({"path": F.lit(None).cast("string"), "ignored": F.lit(False), "place": F.lit(None).cast("long")}))


def missing_files(named: DataFrame, found: DataFrame, path: str = "path") -> DataFrame:
    """Paths that a table names (arrays or single ones are exploded before) and no listing has."""
    return named.select(path).filter(F.col(path).isNotNull()).distinct().join(found.select(F.col("path").alias(path)), path, "left_anti")


def cross_table(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of ``values`` of a column in each row group and in all (null group), zeros included, with their sum and each one's percentage."""
    counts = [F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values]
    d = df.rollup(row).agg(*counts, F.count("*").alias("n"))
    return d.select("*", *[F.round(F.try_divide(100.0 * F.col(f"n_{v}"), F.col("n")), 1).alias(f"pct_{v}") for v in values])


def content_groups(df: DataFrame, path: str, size: str, content: str) -> DataFrame:
    """Groups of equal content: only files that share a size are hashed."""
    same = df.groupBy(size).agg(F.count("*").alias("_c")).filter("_c > 1").select(size)
    h = df.join(same, size, "left_semi").withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))
    return h.groupBy("sha256").agg(F.count("*").alias("copies"), F.min(path).alias("first_path")).filter("copies > 1")


def conflict_aware(df: DataFrame, key: str, label: str, name: str) -> DataFrame:
    """Of equal contents under one label the shortest name stays; under several labels none does.  Adds ``verdict``.

    A content's labels and shortest name are aggregates, joined back; of rows that share content and name the first stays.
    """
    length = F.length(F.col(name).cast("string"))
    g = df.groupBy(F.col(key).alias("_k")).agg(F.min(label).alias("_a"), F.max(label).alias("_z"), F.min(F.struct(length.alias("l"), F.col(name).alias("n"))).alias("_best"))
    d = df.withColumn("_n", F.row_number().over(Window.partitionBy(key, name).orderBy(name))).join(g, F.col(key).eqNullSafe(F.col("_k")))
    first = (F.col("_n") == 1) & F.col(name).eqNullSafe(F.col("_best.n"))
    return d.withColumn("verdict", F.when(F.col("_a") != F.col("_z"), "conflict").when(first, "kept").otherwise("duplicate")).drop("_k", "_a", "_z", "_best", "_n")


def apportioned(counts: DataFrame, key: str, n: str, ratios: dict[str, float]) -> DataFrame:
    """Largest-remainder sizes of each part of each group, with at least one where the group allows."""
    parts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("split"), F.lit(float(r)).alias("ratio")) for i, (k, r) in enumerate(ratios.items())])
    d = counts.withColumn("_p", F.explode(parts)).select(key, n, "_p.*").withColumn("exact", F.col(n) * F.col("ratio"))
    d = d.withColumn("base", F.floor(F.col("exact") + 1e-9).cast("long"))
    w = Window.partitionBy(key)
    left = F.col(n) - F.sum("base").over(w)
    place = F.row_number().over(w.orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), "i"))
    d = d.withColumn("size", F.col("base") + F.when(place <= left, 1).otherwise(0))
    # A part without a row takes one from the largest part, if that can spare it.
    big = F.max(F.struct("size", (-F.col("i")).alias("m"))).over(w)
    d = d.withColumn("_big", big).withColumn("_need", F.count_if(F.col("size") == 0).over(w))
    can = (F.col("_big.size") > F.col("_need")) & (F.col(n) >= len(ratios))
    own = (F.col("size") == F.col("_big.size")) & (F.col("i") == -F.col("_big.m"))
    d = d.withColumn("size", F.when(can & (F.col("size") == 0), 1).when(can & own, F.col("size") - F.col("_need")).otherwise(F.col("size")))
    return d.select(key, "split", "i", "size")


def stratified_split(df: DataFrame, stratum: str, item: str, ratios: dict[str, float], seed: str) -> DataFrame:
    """Assign rows of each stratum by hash order, in the apportioned sizes; a stratum is placed by the hash's first digits."""
    sizes = apportioned(df.groupBy(stratum).agg(F.count("*").alias("_n")), stratum, "_n", ratios)
    w = Window.partitionBy(stratum).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    cuts = sizes.withColumn("hi", F.sum("size").over(w)).withColumn("lo", F.col("hi") - F.col("size")).select(F.col(stratum).alias("_s"), "split", "lo", "hi")
    key = F.sha2(F.concat(F.lit(seed), F.col(item).cast("string")), 256)
    ranked = placed(df.withColumn("_h", key).withColumn("_d", F.substring("_h", 1, 3)), [stratum], ["_h", item], "_d").drop("_h", "_n")
    return ranked.join(cuts, (F.col(stratum).eqNullSafe(F.col("_s"))) & (F.col("_r") > F.col("lo")) & (F.col("_r") <= F.col("hi"))).drop("_s", "_r", "lo", "hi")


def rollup(df: DataFrame, keys: list[str], size: str) -> DataFrame:
    """The same statistics in total, by the first key, and by both."""
    return df.rollup(*keys).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("files"), F.sum(size).alias("bytes"), F.min(size).alias("smallest"), F.max(size).alias("largest"), F.countDistinct(size).alias("sizes"))


def with_expected(counts: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Counts with zero rows for expected groups that have none."""
    return expected.select(*keys).join(counts, keys, "left").fillna(0)


def issues(row: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Names of the threshold rules that a table of totals breaks."""
    return row.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))).alias("issue"))


def plan_problems(plan: DataFrame, files: DataFrame, item: str, content: str, split: str, label: str, splits: list[str], least: int = 1) -> DataFrame:
    """(problem, item, n): what is wrong with a split plan (item, split, label, content) against the files (item, content) it was made for.

    An item twice or without a file, content that is not the file's, a split or label
    that is missing or unknown, content in several splits or under several labels,
    and labels with fewer than ``least`` items in a split.  An empty result is a sound plan.
    """
    p = plan.select(F.col(item).alias("item"), F.col(content).alias("content"), F.col(split).alias("split"), F.col(label).alias("label"))
    f = files.select(F.col(item).alias("item"), F.col(content).alias("found")).dropDuplicates(["item"])
    each = p.join(f.withColumn("there", F.lit(True)), "item", "left")
    rules = {"no file": F.col("there").isNull(), "other content": ~F.col("found").eqNullSafe(F.col("content")) & F.col("there").isNotNull(), "unknown split": ~F.coalesce(F.col("split").isin(*splits), F.lit(False)), "no label": F.coalesce("label", F.lit("")) == ""}
    named = each.select("item", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))).alias("problem")).groupBy("problem", "item").agg(F.count("*").alias("n"))
    twice = p.groupBy("item").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("twice").alias("problem"), "item", "n")
    shared = p.filter("content IS NOT NULL").groupBy("content").agg(F.countDistinct("split").alias("s"), F.countDistinct("label").alias("l"), F.min("item").alias("item"))
    across = [shared.filter(F.col(c) > 1).select(F.lit(k).alias("problem"), "item", F.col(c).alias("n")) for k, c in (("content in several splits", "s"), ("content under several labels", "l"))]
    wanted = p.filter(F.coalesce("label", F.lit("")) != "").select("label").distinct().withColumn("split", F.explode(F.array(*[F.lit(x) for x in splits])))
    few = wanted.join(p.groupBy("label", "split").agg(F.count("*").alias("n")), ["label", "split"], "left").fillna(0, ["n"]).filter(F.col("n") < least)
    few = few.select(F.lit("too few").alias("problem"), F.concat_ws("/", "split", "label").alias("item"), "n")
    kind = plan.schema[item].dataType
    text = lambda d: d.withColumn("item", F.col("item").cast("string")) if kind.typeName() != "string" else d
    return reduce(DataFrame.unionByName, [text(d) for d in (named, twice, *across, few)])


def fingerprint(df: DataFrame, columns: list[str], keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, rows, fingerprint): a table's, or each group's, rows told apart from any other multiset of rows, whatever their order and partitions.

    The sum of each row's digest, read as two numbers: one pass with partial sums.
    """
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    half = lambda i: F.conv(F.substring(F.sha2(text, 256), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    sums = [F.coalesce(F.sum(half(i)), F.lit(0).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(":", *sums), 256).alias("fingerprint"))


def layout_of(found: DataFrame, layouts: DataFrame, default: str) -> DataFrame:
    """The known layout (layout, camera, label, place) that shares most distinct folders with those found; of equal ones the first, without any the default."""
    shared = layouts.join(found.select("camera", "label").distinct(), ["camera", "label"], "left_semi").groupBy("layout", "place").agg(F.countDistinct("camera", "label").alias("score"))
    return shared.agg(F.coalesce(F.max_by("layout", F.struct("score", -F.col("place"))), F.lit(default)).alias("layout"), F.coalesce(F.max("score"), F.lit(0)).alias("score"))
