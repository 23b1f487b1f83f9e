"""Keeping a library up to date: what changed, stable ids, inference on changed files only."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.library import Library
from ..sources.schema import IMAGE_ATTRS, OBJECT, filled
from ..storage import written
from . import pixels
from .sets import numbered


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and change of two listings (path, mtime, size): added, modified, deleted or same.

    A size of 0 in the old listing is unknown and not compared.
    """
    o, n = old.select("path", "mtime", "size").alias("o"), new.select("path", "mtime", "size").alias("n")
    differs = (F.col("o.mtime") != F.col("n.mtime")) | ((F.col("o.size") != 0) & (F.col("o.size") != F.col("n.size")))
    change = F.when(F.col("o.mtime").isNull(), "added").when(F.col("n.mtime").isNull(), "deleted").when(differs, "modified").otherwise("same")
    return o.join(n, F.col("o.path") == F.col("n.path"), "full_outer").select(F.coalesce("n.path", "o.path").alias("path"), change.alias("change"))


def next_ids(images: DataFrame) -> DataFrame:
    """One row: the next free image id and object id."""
    obj = F.array_max(F.transform("objects", lambda o: o["obj_id"]))
    return images.agg((F.coalesce(F.max("img_id"), F.lit(-1)) + 1).alias("next_img_id"), (F.coalesce(F.max(obj), F.lit(-1)) + 1).alias("next_obj_id"))


def with_ids(fresh: DataFrame, old: DataFrame, first: int) -> DataFrame:
    """``fresh`` images with img_id: a known path keeps its own, new ones follow from ``first`` in order of path.

    New images are numbered by ranges: only their counts are summed globally.
    """
    joined = fresh.drop("img_id").join(old.select("path", "img_id"), "path", "left")
    new = numbered(joined.where("img_id is null").drop("img_id"), F.asc("path"), out="img_id", first=first)
    known = joined.where("img_id is not null")
    return known.unionByName(new.select(*known.columns))


def with_object_ids(images: DataFrame, first: int) -> DataFrame:
    """``images`` whose objects are numbered from ``first`` in order of (path, position), and carry their image's id.

    Ranges of paths are written once and numbered apart; only their counts of objects meet.
    """
    d = written(images.repartitionByRange("path").withColumn("_p", F.spark_partition_id()), "objects")
    size = F.size("objects").cast("long")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy("_p").agg(F.sum(size).alias("_c")).select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))
    within = F.sum(size).over(Window.partitionBy("_p").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)) - size
    d = d.join(F.broadcast(starts), "_p").withColumn("_at", F.col("_s") + within + F.lit(first))
    named = F.transform("objects", lambda o, i: o.withField("obj_id", F.col("_at") + i).withField("img_id", F.col("img_id")))
    return d.withColumn("objects", named).select(*images.columns)


def completed(images: DataFrame, library: Library, threshold: float = 0.0) -> DataFrame:
    """Inferred images with what follows from model outputs: fallback classes, and scene and indoor score of scene vectors."""
    v = F.col("img_attrs.scene_vector")
    seen = F.exists(v, lambda x: x > 0)
    scene = F.when(seen, dominant_scene(v, library.labels)).otherwise(F.col("img_attrs.dominant_scene"))
    room = F.when(seen, indoor(v)).otherwise(F.col("img_attrs.indoor_score"))
    attrs = F.col("img_attrs").withField("dominant_scene", scene).withField("indoor_score", room)
    return images.withColumn("img_attrs", attrs).withColumn("objects", F.transform("objects", lambda o: fallback(o, library, threshold)))


def fallback(o: Column, library: Library, threshold: float) -> Column:
    """An unsure object takes its parent's class, if it has one below the root; the own class is kept aside."""
    first = dict(reversed(library.classes))  # the first entry of a class counts
    parents = F.create_map(*[F.lit(x) for cp in first.items() for x in cp]) if first else F.create_map().cast("map<string,string>")
    parent = F.coalesce(F.try_element_at(parents, o["class"]), F.lit("root"))
    unsure = (o["confidence"] < threshold) & ~parent.isin("", "root")
    fields = {"class": F.when(unsure, parent).otherwise(o["class"]), "super_class": parent, "original_class": F.when(unsure, o["class"]).otherwise(""), "is_fallback": unsure}
    for k, v in fields.items():
        o = o.withField(k, v)
    return o


def indoor(scene_vector: Column) -> Column:
    """Sum of the first 205 scene probabilities."""
    return F.aggregate(F.slice(scene_vector, 1, 205), F.lit(0.0), lambda t, v: t + v).cast("float")


def dominant_scene(scene_vector: Column, labels: tuple[str, ...]) -> Column:
    """The label of the first greatest probability."""
    at = F.array_position(scene_vector, F.array_max(scene_vector)).cast("int")
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, labels)), F.when(at > 0, at)), F.lit(""))


def top_scenes(scene_vector: Column, labels: tuple[str, ...], k: int = 5, least: float = -1.0) -> Column:
    """The ``k`` likeliest scenes as (p, label), likeliest first, ties by position."""
    names = F.array(*map(F.lit, labels))
    full = F.transform(scene_vector, lambda v, i: F.struct((-v).alias("n"), i.alias("i"), v.alias("p"), F.get(names, i).alias("label")))
    return F.transform(F.slice(F.array_sort(F.filter(full, lambda t: t["p"] > F.lit(least).cast("float"))), 1, k), lambda t: F.struct(t["p"].alias("p"), t["label"].alias("label")))


def unit(v: Column) -> Column:
    """A vector of length one; shorter than eight components, or zero: empty."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    return F.when((F.size(v) >= 8) & (n > 0), F.transform(v, lambda x: (x / n).cast("float"))).otherwise(F.array().cast("array<float>"))


def infer(files: DataFrame, detect: Callable, classes: tuple[str, ...], base_conf: float = 0.25, iou: float = 0.45, size: int = 640, scenes: Callable | None = None) -> DataFrame:
    """Images from decoded pictures (path, mtime, size, height, width, data: BGR bytes, exif).

    ``detect`` maps a batch of letterboxed pictures to raw outputs of shape (4 + classes, anchors);
    ``scenes`` maps a batch of pictures in its input form (``pixels.scene_input``) to logits. Both run once per Arrow batch.
    """
    import numpy as np

    schema = f"path string, mtime bigint, size bigint, attrs {IMAGE_ATTRS}, objs array<{OBJECT}>"

    def run(frames):
        for f in frames:
            pictures = [np.frombuffer(d, np.uint8).reshape(h, w, 3) for d, h, w in zip(f.data, f.height, f.width, strict=True)]
            boxed = [pixels.letterbox(p, size) for p in pictures]
            raw = detect(np.stack([b[0] for b in boxed])) if boxed else []
            rooms = pixels.softmax(np.asarray(scenes(np.stack([pixels.scene_input(p) for p in pictures])))) if scenes and boxed else [None] * len(boxed)
            out = []
            for r, p, b, y, v in zip(f.itertuples(index=False), pictures, boxed, raw, rooms, strict=True):
                attrs = pixels.image_attrs(p) | dict(r.exif or {})
                if v is not None:
                    attrs["scene_vector"] = list(map(float, v))
                found = pixels.suppress(pixels.decode(y, base_conf, *b[1:], p.shape[1], p.shape[0]), iou)
                objs = [{"class": classes[k], "confidence": c, "x": x, "y": yy, "w": w, "h": h, "area": w * h, "attr": pixels.object_attr(p, (x, yy, w, h))} for k, c, x, yy, w, h in found if k < len(classes)]
                out.append((r.path, r.mtime, r.size, attrs, objs))
            yield pd.DataFrame(out, columns=["path", "mtime", "size", "attrs", "objs"])

    got = files.mapInPandas(run, schema)
    objs = F.transform("objs", lambda o: filled(o, OBJECT))
    return got.select("path", "mtime", "size", F.lit(-1).cast("bigint").alias("img_id"), filled(F.col("attrs"), IMAGE_ATTRS).alias("img_attrs"), objs.alias("objects"))


def rebuilt(library: Library, listing: DataFrame, build: Callable[[DataFrame], DataFrame], first_id: int | None = None, whole: bool = True, again: bool = False) -> tuple[DataFrame, DataFrame]:
    """Images built from the new and changed files of a listing, and the paths that are gone.

    ``build`` sees each such file once: what it makes is written before ids are given. A listing that is not
    ``whole`` shows only some files, so none is gone; with ``again``, known files are built too.
    """
    old = library.images
    change = changes(old, listing)
    work = listing.join(change.where(F.col("change").isin("added", "modified", *(["same"] if again else []))).select("path"), "path")
    fresh = written(build(work), "built")
    start = next_ids(old).first()
    fresh = with_ids(fresh, old, start["next_img_id"] if first_id is None else first_id)
    fresh = with_object_ids(fresh, start["next_obj_id"])
    tags = old.select("path", F.col("img_attrs.user_tags").alias("_tags"))
    fresh = fresh.join(tags, "path", "left").withColumn("img_attrs", F.col("img_attrs").withField("user_tags", F.coalesce("_tags", F.col("img_attrs.user_tags")))).drop("_tags")
    gone = change.where("change = 'deleted'").select("path")
    return fresh.select(*old.columns), gone if whole else gone.limit(0)


def refresh(library: Library, listing: DataFrame, build: Callable[[DataFrame], DataFrame], first_id: int | None = None, again: bool = False) -> Library:
    """The library after a new listing: files that are new or changed are built, lost ones go.

    ``build`` maps listing rows to images (``completed`` of ``infer``, say); a file that it gives no image for
    keeps its old one. Objects of built images get new ids. User tags of rebuilt images stay, and albums lose
    paths that are gone. With ``again``, all files are built, as after a change of model.
    """
    old = library.images
    fresh, gone = rebuilt(library, listing, build, first_id, again=again)
    kept = old.join(gone, "path", "left_anti").join(fresh.select("path"), "path", "left_anti")
    images = kept.select(*old.columns).unionByName(fresh)
    albums = library.collections.join(gone, "path", "left_anti").select(*library.collections.columns)
    return Library(images, albums, library.classes, library.labels, library.packs, library.tasks)
