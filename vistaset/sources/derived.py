"""A library made of the star-schema tables: orders are images, line items are objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fuzzy import once
from ..storage import spread
from .library import Library, Pack
from .schema import ATTR, IMAGE_ATTRS, OBJECT, SCENES, empty

CLASSES = (
    ("economy", "basic"), ("standard", "basic"), ("small", "sized"), ("medium", "sized"), ("large", "sized"),
    ("promo", "root"), ("basic", "goods"), ("sized", "goods"), ("goods", "root"),
)
LABELS = tuple(f"scene-{i % 350} {chr(97 + i % 26)}" if i % 5 else f"place {i}" for i in range(SCENES))
COLOURS = ("red", "blue", "gray", "brown")
PACKS = {"details": Pack("details", "promo", ("lid", "label"), conf_threshold=0.5)}


def _hist(key, n: int, m: int):
    """Bins (key + i * i) % 17 / m as single floats: they repeat with 17, so keys look one of 17 arrays up; keys below zero are worked out."""
    known = F.array(*[F.split(F.lit(",".join(repr((r + i * i) % 17 / m) for i in range(n))), ",").cast("array<float>") for r in range(17)])
    plain = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: ((key + i * i) % 17 / m).cast("float"))
    return F.when(key >= 0, F.get(known, (key % 17).cast("int"))).otherwise(plain)


#: What an object is made of, in the order of an image's objects: what stands further back cannot tell two apart.
ITEM = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")


#: Line items of a task on average, at most: what it sorts and lists (about 170 bytes each) stays in memory however large the tables are.
#: Not fewer either: beyond 200 tasks rows are sorted before they are sent, which takes memory there.
ITEMS = 3 << 16
#: Parts that every task holds at most; beyond, line items move to their parts.
PARTS = 1 << 21


def tasks(df: DataFrame) -> int:
    """How many tasks the rows are dealt to; 0: as many as the session has it.

    Of the session's partitions adaptive execution may leave no more than the cores, so these count too.
    """
    spark, many = df.sparkSession, -(-df.count() // ITEMS)
    return many if many > min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism) else 0


def items(spark: SparkSession, sf_dir: str, n: int = 0) -> DataFrame:
    """One row per order key: its line items with their classes, in order.

    Line items move with the few columns that objects are made of, to ``n`` tasks; objects are made where they are read.
    """
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.lower("p_type").alias("class"))
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", *ITEM)
    if part.count() <= PARTS:
        part = F.broadcast(part)
    else:
        item, part = spread(item, n, "l_partkey"), spread(part, n, "p_partkey")
    rows = item.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", *ITEM, "class")
    # they come together before they are listed: lists would be built, sent and merged again
    return spread(rows, n, "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*ITEM, "class"))).alias("l"))


def an_object(t, i):
    """The object of an order's line item ``t`` at a position from 0."""
    key, class_ = t["l_partkey"], t["class"]
    parent = F.when(class_.isin("economy", "standard"), "basic").when(class_.isin("small", "medium", "large"), "sized").otherwise("root")
    w, h = t["l_quantity"] / 100, t["l_linenumber"] / 14
    f = lambda c: c.cast("float")
    attr = empty(
        ATTR, h=f(key % 360), s=f((key % 100) / 100), v=f((key * 7 % 100) / 100), color_temperature=f(2000 + key * 13 % 8000),
        dominant_color_name=F.element_at(F.array(*map(F.lit, COLOURS)), (key % 4 + 1).cast("int")),
        hue_hist=_hist(key, 32, 200), lbp=f((key % 10) / 10), local_blur_score=f((key % 7) / 7),
    )
    return empty(
        OBJECT, **{"class": class_}, x=(key % 1000) / 1000, y=(t["l_suppkey"] * 7 % 100) / 100, w=w, h=h, area=w * h,
        confidence=1 - 5 * t["l_discount"], original_class=class_, super_class=parent,
        obj_id=F.col("l_orderkey") * 1000 + i + 1, img_id=F.col("l_orderkey"), attr=attr,
        cluster_ids=F.create_map(F.lit("lot"), F.concat(F.lit("lot_"), (key % 5).cast("string"))),
    )


def image_attrs():
    """Invented measurements of an image, from an order's key and customer."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    f = lambda v: v.cast("float")
    hist = lambda n, m: _hist(k, n, m)
    return empty(
        IMAGE_ATTRS, color_temperature=f(2000 + k % 8000), avg_hue=f(c % 360), avg_saturation=f((k % 100) / 100), avg_value=f((k * 7 % 100) / 100),
        dominant_color=F.element_at(F.array(*map(F.lit, COLOURS)), (k % 4 + 1).cast("int")), global_hue_hist=hist(32, 200), luma_hist=hist(64, 400),
        overexposure_score=f((k % 11) / 10), underexposure_score=f((k % 13) / 13), exposure_goodness=f(1 - (k % 5) / 10), global_blur_score=f((k % 9) / 9),
        camera_make=F.when(k % 3 == 0, "Acme").otherwise(""), camera_model=F.when(k % 2 == 0, "M1").otherwise(""), iso=f(100 * (k % 32)),
        shutter_speed=f(1 / (1 + k % 500)), aperture=f(1 + (k % 20)), focal_length=f(20 + k % 80), datetime_original=F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"),
        width=F.lit(640), height=F.lit(480), user_tags=F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus")),
        scene_vector=hist(SCENES, 1000), dominant_scene=F.concat(F.lit("scene-"), (k % 7).cast("string")), indoor_score=f((k % 21) / 20),
    )


def path(key):
    return F.concat(F.lit("img_"), F.lpad(key.cast("string"), 8, "0"), F.lit(".jpg"))


def library(spark: SparkSession, sf_dir: str) -> Library:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = tasks(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    made = once(F.coalesce(F.transform("l", an_object), F.array().cast(f"array<{OBJECT}>")))
    rows = orders.join(items(spark, sf_dir, n), F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("objects", made)
    images = rows.select(
        path(F.col("o_orderkey")).alias("path"), F.unix_timestamp("o_orderdate").alias("mtime"), F.col("o_custkey").alias("size"), F.col("o_orderkey").alias("img_id"),
        image_attrs().alias("img_attrs"), "objects",
    )
    albums = orders.where("o_orderkey % 10 = 0").select(F.lit("tens").alias("name"), F.lit(0).alias("pos"), path(F.col("o_orderkey")).alias("path"))
    urgent = orders.where("o_orderpriority = '1-URGENT'").select(F.lit("urgent").alias("name"), F.lit(0).alias("pos"), path(F.col("o_orderkey")).alias("path"))
    return Library(images, albums.union(urgent), CLASSES, LABELS, PACKS, n)
