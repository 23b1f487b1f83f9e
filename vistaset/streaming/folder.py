"""A library that follows a folder of pictures: new and changed files go through the models once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import etl
from ..sources import pictures, versions
from ..sources.library import Library, empty_collections
from ..sources.schema import IMAGES
from .refresh import newest_by_window


def opened(spark: SparkSession, folder: str, model: str, vocabulary: Library | None = None) -> Library:
    """The library in force, empty where there is none; its vocabulary is that of ``vocabulary``."""
    images = versions.read(spark, folder, model) if versions.version(spark, folder, model) else spark.createDataFrame([], IMAGES)
    v = vocabulary or Library(images, empty_collections(spark))
    return Library(images, v.collections, v.classes, v.labels, v.packs)


def absorb(rows: DataFrame, folder: str, model: str, build: Callable[[DataFrame], DataFrame], vocabulary: Library | None = None, fingerprint: str = "", batch: int = -1) -> versions.Version:
    """A new version with the pictures of ``rows`` that are new or changed; files that cannot be decoded are left out.

    Data and the batch's number come into force together, so a batch that is repeated changes nothing and is not
    built again. Images that another model built (by fingerprint) are built again when their files come.
    """
    spark = rows.sparkSession
    last = versions.version(spark, folder, model)
    if last and 0 <= batch <= last.batch:
        return last
    library = opened(spark, folder, model, vocabulary)
    listing = newest_by_window(pictures.decodable(rows), "path", ["mtime", "size"])
    fresh, _ = etl.rebuilt(library, listing, build, whole=False, again=bool(last) and last.fingerprint != fingerprint)
    return versions.change(fresh, None, folder, model, fingerprint, batch)


def follow_folder(spark: SparkSession, root: str, folder: str, model: str, build: Callable[[DataFrame], DataFrame], checkpoint: str, vocabulary: Library | None = None, fingerprint: str = "", files: int = 1000):
    """Start a query that builds the library of a folder from its pictures as they come."""

    def step(batch: DataFrame, number: int) -> None:
        absorb(batch, folder, model, build, vocabulary, fingerprint, number)

    stream = pictures.follow_pictures(spark, root, files)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
