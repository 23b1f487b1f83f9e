"""Sets of images (path, score) and bags of objects (image_path, o, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import spread, written


def scored(objs: Column) -> Column:
    """Objects of an image with their confidence as score."""
    return F.transform(objs, lambda o: o.withField("score", o["confidence"].cast("float")))


def explode_objects(rows: DataFrame) -> DataFrame:
    out = rows.select(F.col("path").alias("image_path"), F.explode("objects").alias("o"))
    return out.withColumn("score", F.col("o.confidence").cast("float"))


def to_images(objects: DataFrame) -> DataFrame:
    """Images of a bag of objects, each with its best score."""
    rank = F.when(F.col("score") > 0, F.col("score")).otherwise(F.col("o.confidence").cast("float"))
    return objects.groupBy(F.col("image_path").alias("path")).agg(F.max(rank).alias("score"))


def _dealt(df: DataFrame, tasks: int) -> DataFrame:
    """Dealt by path to a number of tasks where one is given. In a join the other side follows, unless it lies that way already."""
    return spread(df, tasks, "path") if tasks else df


def union_images(a: DataFrame, b: DataFrame, tasks: int = 0) -> DataFrame:
    return _dealt(a.unionByName(b), tasks).groupBy("path").agg(F.max("score").alias("score"))


def intersect_images(a: DataFrame, b: DataFrame, tasks: int = 0) -> DataFrame:
    return a.alias("a").join(_dealt(b, tasks).alias("b"), "path").select("path", F.least("a.score", "b.score").alias("score"))


def subtract_images(a: DataFrame, b: DataFrame, tasks: int = 0) -> DataFrame:
    return a.join(_dealt(b.select("path"), tasks), "path", "left_anti")


def place(o: Column) -> Column:
    """What makes two objects of an image the same: class and centre to six places."""
    return F.concat_ws(":", o["class"], F.format_string("%.6f", o["x"]), F.format_string("%.6f", o["y"]))


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("_key", F.concat_ws(":", "image_path", place(F.col("o"))))


def _keys_only(df: DataFrame, tasks: int) -> DataFrame:
    """Keys dealt to a number of tasks where one is given. The bag they meet follows; dealt itself, it would move again after the join."""
    keys = _keyed(df).select("_key")
    return spread(keys, tasks, "_key") if tasks else keys


def union_objects(a: DataFrame, b: DataFrame, tasks: int = 0) -> DataFrame:
    """All of the left, and the right's first of each key that the left lacks."""
    new = _keyed(b).join(_keys_only(a, tasks), "_key", "left_anti")
    first = Window.partitionBy("_key").orderBy(F.col("o.obj_id"), F.desc("score"))
    new = new.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return a.unionByName(new.select(*a.columns))


def intersect_objects(a: DataFrame, b: DataFrame, tasks: int = 0) -> DataFrame:
    return _keyed(a).join(_keys_only(b, tasks), "_key", "left_semi").drop("_key")


def subtract_objects(a: DataFrame, b: DataFrame, tasks: int = 0) -> DataFrame:
    return _keyed(a).join(_keys_only(b, tasks), "_key", "left_anti").drop("_key")


def _keys(a: Column) -> Column:
    return F.transform(a, place)


def intersect_arrays(a: Column, b: Column) -> Column:
    return F.filter(a, lambda o: F.array_contains(_keys(b), place(o)))


def subtract_arrays(a: Column, b: Column) -> Column:
    return F.filter(a, lambda o: ~F.array_contains(_keys(b), place(o)))


def union_arrays(a: Column, b: Column) -> Column:
    keys = _keys(b)
    fresh = F.filter(b, lambda o, i: ~F.array_contains(_keys(a), place(o)) & (F.array_position(keys, place(o)) == i + 1))
    return F.concat(a, fresh)


def ranked(df: DataFrame, least: float | None = None, descending: bool = False) -> DataFrame:
    """Results in order of score, ties by path; optionally from a least score on."""
    if least is not None:
        df = df.where(F.col("score") >= F.lit(least))
    return df.orderBy(F.desc("score") if descending else F.asc("score"), "path")


def numbered(df: DataFrame, *order: Column, out: str = "place", first: int = 1, tasks: int = 0) -> DataFrame:
    """Rows with their place in an order, from ``first``: ranges are numbered apart, and only their counts meet.

    Ranges are written before they are counted, so the count and the numbers are those of the same ranges. There are as many
    as ``tasks``, where given.
    """
    ranges = df.repartitionByRange(tasks, *order) if tasks else df.repartitionByRange(*order)
    d = written(ranges.withColumn("_p", F.spark_partition_id()), "ordered")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return d.join(F.broadcast(starts), "_p").withColumn(out, F.col("_s") + within + F.lit(first - 1)).select(*df.columns, out)
