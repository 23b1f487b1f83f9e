"""Pictures decoded by Spark's image source, as the rows that inference takes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROWS = "path string, mtime bigint, size bigint, height int, width int, data binary, exif map<string,string>"
_IMAGE = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def bgr(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Pixels as blue, green, red: grey is repeated, transparency dropped."""
    p = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.ascontiguousarray(np.repeat(p, 3, 2) if channels == 1 else p[..., :3])


def picture_rows(images: DataFrame) -> DataFrame:
    """(path, mtime, size, height, width, data, exif) of rows of the image source; what cannot be decoded has null data."""
    i, m = F.col("image"), F.col("_metadata")
    flat = images.select(
        F.element_at(F.split(i["origin"], "/"), -1).alias("path"), F.unix_timestamp(m["file_modification_time"]).alias("mtime"), m["file_size"].alias("size"),
        i["height"].alias("height"), i["width"].alias("width"), i["nChannels"].alias("n"), i["data"].alias("data"),
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            data = [bgr(d, h, w, n).tobytes() if h > 0 and w > 0 and n in (1, 3, 4) else None for d, h, w, n in zip(f.data, f.height, f.width, f.n, strict=True)]
            yield f.drop(columns="n").assign(data=data, exif=None)

    return flat.mapInPandas(run, _ROWS)


def read_pictures(spark: SparkSession, root: str) -> DataFrame:
    """The pictures of a folder; undecodable files keep their rows, without data."""
    return picture_rows(spark.read.format("image").option("dropInvalid", False).load(root))


def follow_pictures(spark: SparkSession, root: str, files: int = 1000) -> DataFrame:
    """The same as a stream of new files, at most ``files`` to a batch."""
    return picture_rows(spark.readStream.format("image").schema(_IMAGE).option("dropInvalid", False).option("maxFilesPerTrigger", files).load(root))


def decodable(rows: DataFrame) -> DataFrame:
    return rows.where("data is not null")


def undecodable(rows: DataFrame) -> DataFrame:
    """Files that are no pictures, to be looked at."""
    return rows.where("data is null").select("path", "mtime", "size")
