"""The golden mini-library: four images."""

from pyspark.sql import functions as F

from vistaset.sources.library import Library, normal_objects
from vistaset.sources.schema import IMAGE_ATTRS, empty

CLASSES = (("cat", "animal"), ("dog", "animal"), ("animal", "root"), ("apple", "fruit"), ("banana", "fruit"), ("fruit", "food"), ("food", "root"), ("person", "root"))
OBJECTS = {
    "a.jpg": [("cat", "animal", 0.9, 0.2, 0.5, 0.2, 0.3, 0.06), ("dog", "animal", 0.8, 0.7, 0.5, 0.25, 0.4, 0.1)],
    "b.jpg": [("apple", "fruit", 0.6, 0.5, 0.5, 0.1, 0.1, 0.01), ("banana", "fruit", 0.7, 0.3, 0.6, 0.2, 0.1, 0.02), ("apple", "fruit", 0.5, 0.8, 0.2, 0.1, 0.1, 0.01)],
    "c.jpg": [],
    "d.jpg": [("person", "root", 0.95, 0.5, 0.5, 0.6, 0.6, 0.36)],
}
_FIELDS = "array<struct<class:string,super_class:string,confidence:double,x:double,y:double,w:double,h:double,area:double,obj_id:bigint>>"


def library(spark) -> Library:
    rows = [(p, i, [(*o, i * 10 + j) for j, o in enumerate(objs)]) for i, (p, objs) in enumerate(OBJECTS.items())]
    df = spark.createDataFrame(rows, f"path string, img_id bigint, o {_FIELDS}")
    tags = F.when(F.col("path") == "a.jpg", F.create_map(F.lit("place"), F.lit("home"))).otherwise(F.create_map().cast("map<string,string>"))
    objs = F.from_json(F.to_json("o"), "array<" + __import__("vistaset.sources.schema", fromlist=["OBJECT"]).OBJECT + ">")
    images = df.select("path", F.lit(0).cast("bigint").alias("mtime"), F.lit(0).cast("bigint").alias("size"), "img_id", empty(IMAGE_ATTRS, user_tags=tags).alias("img_attrs"), normal_objects(objs).alias("objects"))
    albums = spark.createDataFrame([("trip", 0, "a.jpg"), ("trip", 1, "gone.jpg")], "name string, pos int, path string")
    return Library(images.cache(), albums, CLASSES, ("beach", "dining room", "beach"))
