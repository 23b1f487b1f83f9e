"""Embeddings of objects: inputs of a pack's model, vectors of unit length, kept with the objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..errors import QueryError
from ..sources.library import Library, Pack
from ..storage import written
from . import cluster, pixels
from .expand import padded


def parents(library: Library, pack: Pack) -> DataFrame:
    """(path, o): objects whose class, or the class above it, is the pack's parent class."""
    if not pack.active or not pack.can_extract_embedding:
        raise QueryError(f"extension pack {pack.name!r} is not active or gives no embeddings")
    o = F.col("o")
    return library.images.select("path", F.explode("objects").alias("o")).where((o["class"] == pack.parent_class) | (o["super_class"] == pack.parent_class))


def crops(objects: DataFrame, pictures: DataFrame, pack: Pack) -> DataFrame:
    """(path, obj_id, input) of objects (path, o) from decoded pictures (path, height, width, data): padded crops in the model's form."""
    flat = objects.select("path", *[F.col("o")[c].alias(c) for c in ("obj_id", "x", "y", "w", "h")])
    # a picture's boxes travel to it: its pixels are sent once
    boxes = flat.groupBy("path").agg(F.collect_list(F.struct("obj_id", "x", "y", "w", "h")).alias("boxes"))
    rows = pictures.where("data is not null").select("path", "height", "width", "data").join(boxes, "path")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                p = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)
                for b in r.boxes:
                    x1, y1, x2, y2 = padded(b["x"], b["y"], b["w"], b["h"], pack.crop_padding)
                    part = p[int(y1 * r.height) : int(np.ceil(y2 * r.height)), int(x1 * r.width) : int(np.ceil(x2 * r.width))]
                    if part.size:
                        x = pixels.resample(part, pack.input_size, pack.input_size)
                        made = pixels.normal(x) if pack.input_normalize else (x[..., ::-1].astype(np.float32) / 255).transpose(2, 0, 1)
                        out.append((r.path, b["obj_id"], made.ravel().tolist()))
            yield pd.DataFrame(out, columns=["path", "obj_id", "input"])

    return rows.mapInPandas(run, "path string, obj_id bigint, input array<float>")


def vectors(inputs: DataFrame, model: Callable[[], Callable[[np.ndarray], np.ndarray]], shape: list[int], batch: int = 64) -> DataFrame:
    """(path, obj_id, vec) of unit length. ``model`` makes the function from a batch of inputs to vectors, once in each worker.

    Vectors of less than eight components, and zero ones, are left out.
    """

    def unit():
        raw = model()

        def run(x: np.ndarray) -> np.ndarray:
            v = np.asarray(raw(x), np.float64)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            return np.divide(v, n, out=np.zeros_like(v), where=n > 0).astype(np.float32)

        return run

    predict = predict_batch_udf(unit, return_type=ArrayType(FloatType()), batch_size=batch, input_tensor_shapes=[shape])
    out = inputs.where("input is not null").select("path", "obj_id", predict("input").alias("vec"))
    return out.where((F.size("vec") >= 8) & ((F.array_max("vec") != 0) | (F.array_min("vec") != 0)))


def with_embeddings(images: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """Images whose objects carry the vectors under a name; objects without one keep what they have."""
    per = found.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("obj_id", "vec"))).alias("_vecs"))

    def put(o: Column) -> Column:
        v = F.try_element_at("_vecs", o["obj_id"])
        others = F.map_filter(F.coalesce(o["embeddings"], F.create_map().cast("map<string,array<float>>")), lambda k, _: k != name)
        return o.withField("embeddings", F.when(v.isNull(), o["embeddings"]).otherwise(F.map_concat(others, F.create_map(F.lit(name), v))))

    return images.join(per, "path", "left").withColumn("objects", F.transform("objects", put)).drop("_vecs")


def clustered(library: Library, pack: Pack, inputs: Callable[[DataFrame], DataFrame], model: Callable, shape: list[int]) -> Library:
    """The library with embeddings of a pack and the clusters that they form. ``inputs`` maps parents (path, o) to (path, obj_id, input)."""
    found = vectors(inputs(parents(library, pack)), model, shape)
    if not pack.can_cluster:
        return library.with_images(with_embeddings(library.images, found, pack.embedding_name))
    # vectors are clustered as they were found: only where objects are read do they move to their images
    found = written(found, "vectors")
    had = cluster.embedded(library.images, pack.embedding_name).join(found.select("path", "obj_id"), ["path", "obj_id"], "left_anti")
    items = found.unionByName(written(had, "vectors"))
    images = with_embeddings(library.images, found, pack.embedding_name)
    return library.with_images(cluster.cluster_images(images, pack.embedding_name, pack.cluster_name, pack.cluster_threshold, pack.parent_class, items))
