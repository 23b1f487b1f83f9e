"""The image library as DataFrames, and its readers and writers."""

from __future__ import annotations

import configparser
import io
import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError
from . import pages, pieces, versions
from .schema import COLLECTIONS, IMAGE_ATTRS, OBJECT, filled

VERSION = "1.2"


@dataclass(frozen=True)
class Pack:
    """An extension pack: a model that finds children within objects of its parent class."""

    name: str
    parent_class: str = ""
    children: tuple[str, ...] = ()
    model_path: str = ""
    input_size: int = 224
    conf_threshold: float = 0.3
    crop_padding: float = 0.1
    is_classifier: bool = False
    input_normalize: bool = False
    can_extract_embedding: bool = False
    embedding_name: str = ""
    can_cluster: bool = False
    cluster_name: str = ""
    cluster_threshold: float = 0.55
    active: bool = True


@dataclass(frozen=True)
class Library:
    """Images (one row each, objects nested), albums, the class tree, scene labels and packs.

    The class tree, labels and packs are vocabularies of a model, known when a query is compiled. ``tasks`` says to how many
    tasks sets of its images and bags of its objects are dealt (0: as the session has it).
    """

    images: DataFrame
    collections: DataFrame
    classes: tuple[tuple[str, str], ...] = ()
    labels: tuple[str, ...] = ()
    packs: dict[str, Pack] = field(default_factory=dict)
    tasks: int = 0

    def with_images(self, images: DataFrame) -> Library:
        return replace(self, images=images)

    def ancestors(self, name: str) -> list[str]:
        """Parents of a class, nearest first, up to but without the root; cycles end the walk."""
        parent = {}
        for c, p in self.classes:
            parent.setdefault(c, p)
        out: list[str] = []
        while (name := parent.get(name, "root")) not in ("", "root") and name not in out:
            out.append(name)
        return out

    def is_a(self, name: str, of: str) -> bool:
        return name == of or of == "root" or of in self.ancestors(name)

    def descendants(self, of: str) -> list[str]:
        return [c for c, _ in self.classes if c != of and self.is_a(c, of)]

    def known_class(self, name: str) -> bool:
        return any(name in (c, p) for c, p in self.classes)


def empty_collections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], COLLECTIONS)


def normal_objects(objects):
    """Objects with sentinels for all that is missing; no objects is an empty array."""
    return F.coalesce(F.transform(objects, lambda o: filled(o, OBJECT)), F.array().cast(f"array<{OBJECT}>"))


def read_index(spark: SparkSession, path: str, chunk: int = pieces.CHUNK) -> tuple[DataFrame, DataFrame]:
    """Images and collections of a JSON index (one document or several), read in chunks: entries by path, checked version."""
    entry = f"mtime bigint, size bigint, img_id bigint, objects array<{OBJECT}>, img_attrs {IMAGE_ATTRS}"
    doc = pieces.Document(spark, path, chunk)
    versions = sorted(set(doc.values("version")))
    if versions != [VERSION]:
        raise QueryError(f"index version {versions} is not {VERSION}")
    e = doc.section("entries").select(F.col("key").alias("path"), F.from_json("value", entry, {"mode": "FAILFAST"}).alias("e"))
    images = e.select(
        "path", F.coalesce("e.mtime", F.lit(0)).alias("mtime"), F.coalesce("e.size", F.lit(0)).alias("size"), F.coalesce("e.img_id", F.lit(-1)).alias("img_id"),
        filled(F.col("e.img_attrs"), IMAGE_ATTRS).alias("img_attrs"), normal_objects(F.col("e.objects")).alias("objects"),
    )
    paths = F.from_json("value", "array<string>", {"mode": "FAILFAST"})
    albums = doc.section("collections").select(F.col("key").alias("name"), F.posexplode(paths).alias("pos", "path"))
    return images, albums


def write_index(images: DataFrame, folder: str, packed: bool = False) -> None:
    """Images as a JSON index in parts: every partition is a whole document, in force together when all are written.

    ``packed`` parts are gzip files whose frames can be found, so that they are read in chunks too.
    """
    entry = F.concat(F.get_json_object(F.to_json(F.struct(F.array("path").alias("k"))), "$.k").alias("k"), F.lit(""))
    key = F.substring(entry, F.lit(2), F.length(entry) - 2)  # the path as JSON text
    rows = images.select(F.concat(key, F.lit(":"), F.to_json(F.struct("mtime", "size", "img_id", "objects", "img_attrs"))).alias("text"))
    pages.write(rows, folder, pages.Form(f'{{"version":"{VERSION}","entries":{{\n', ",\n", "\n}}", ".json.gz" if packed else ".json"))


def read_legacy(spark: SparkSession, path: str, chunk: int = pieces.CHUNK) -> DataFrame:
    """Images of the older format: a list of images, numbered by position; size 0 compares with none."""
    image = f"path string, mtime bigint, objects array<{OBJECT}>, img_attrs {IMAGE_ATTRS}"
    i = pieces.Document(spark, path, chunk).numbered("images").select("pos", F.from_json("value", image, {"mode": "FAILFAST"}).alias("i"))
    return i.select(
        "i.path", F.coalesce("i.mtime", F.lit(0)).alias("mtime"), F.lit(0).cast("bigint").alias("size"), F.col("pos").cast("bigint").alias("img_id"),
        filled(F.col("i.img_attrs"), IMAGE_ATTRS).alias("img_attrs"), normal_objects(F.col("i.objects")).alias("objects"),
    )


def read_classes(spark: SparkSession, path: str) -> tuple[tuple[str, str], ...]:
    """(name, parent) in output order; a missing parent is the root. A model's vocabulary is small."""
    doc = spark.read.schema("classes array<struct<name:string,parent:string>>").json(path, multiLine=True)
    rows = doc.select(F.posexplode("classes").alias("i", "c")).select("i", "c.name", F.coalesce("c.parent", F.lit("root"))).orderBy("i")
    return tuple((r[1], r[2]) for r in rows.collect())


def read_labels(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Scene labels in file order: the trailing number goes, and all but the last part of the path."""
    t = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("i")).where(F.trim("value") != "")
    name = F.substring_index(F.regexp_replace(F.trim("value"), r"\s+[0-9]+$", ""), "/", -1)
    return tuple(r[0] for r in t.orderBy("i").select(name).collect())


def read_settings(text: str) -> dict[str, float]:
    """Inference thresholds of an ini text."""
    ini = configparser.ConfigParser()
    ini.read_file(io.StringIO(text))
    get = lambda k, d: ini.getfloat("inference", k, fallback=d)
    return {"fallback_threshold": get("fallback_threshold", 0.0), "base_conf": get("base_conf", 0.25), "iou_threshold": get("iou_threshold", 0.45)}


def read_registry(text: str) -> dict:
    """Active base model and extensions of a registry document."""
    doc = json.loads(text)
    return {"base": doc.get("active_base", ""), "extensions": tuple(doc.get("active_extensions", ())), "bases": tuple(doc.get("bases", ()))}


def list_models(spark: SparkSession, registry: dict) -> DataFrame:
    return spark.createDataFrame([(b, b == registry["base"]) for b in registry["bases"]], "name string, active boolean").orderBy("name")


def _pictures(files: DataFrame, *endings: str) -> DataFrame:
    """Files by ending, in any case; contents are not read unless selected."""
    return files.where(F.lower(F.substring_index("path", ".", -1)).isin(*endings))


def scan_directory(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, mtime, size, uri) of the pictures directly in the roots, by name.

    With several roots the name of the root's own folder stands before the file's.
    """
    files = _pictures(spark.read.format("binaryFile").load([r.rstrip("/") for r in roots]), "jpg", "jpeg", "png")
    parts = F.split("path", "/")
    name = F.element_at(parts, -1) if len(roots) == 1 else F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))
    out = files.select(name.alias("path"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size"), F.col("path").alias("uri"))
    return out.orderBy("path")


def count_pictures(spark: SparkSession, root: str) -> DataFrame:
    """The number of pictures anywhere below a root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return _pictures(files, "jpg", "jpeg", "png", "bmp", "webp").agg(F.count("path").alias("images"))


def write_snapshot(images: DataFrame, folder: str, model: str) -> str:
    """Write images as a new version of a model's library; it comes into force in one step."""
    return versions.replace(images, folder, model).tables[-1]


def read_snapshot(spark: SparkSession, folder: str, model: str) -> DataFrame:
    """The images in force."""
    return versions.read(spark, folder, model)


def smart_album(text: str, session) -> DataFrame:
    """A saved query, run again each time it is opened."""
    return session.run(text).table()
