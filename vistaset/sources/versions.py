"""Versions of a library's images in a shared folder.

A version is a manifest: the tables that make it up (a base and changes on top of it), the fingerprint of the
model that built them, its parent, and the number of the micro-batch that it came from, if any. Data is written
first; the manifest then gets its name by one rename that fails where the name is taken. A crash leaves the last
version in force, a reader keeps the version that it opened, and of two writers one has to start again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError
from .schema import IMAGES

#: Changes on top of a base until they are merged with it.
CHANGES = 8
_CHANGED = f"{IMAGES}, gone boolean"


@dataclass(frozen=True)
class Version:
    number: int
    tables: tuple[str, ...]  # the base, then changes, oldest first
    fingerprint: str = ""
    batch: int = -1


def _path(spark: SparkSession, at: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)


def _files(spark: SparkSession, at: str):
    return _path(spark, at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _home(folder: str, model: str) -> str:
    return f"{folder.rstrip('/')}/versions/{model}"


def numbers(spark: SparkSession, folder: str, model: str) -> list[int]:
    """Versions in force or still kept, oldest first."""
    at = _home(folder, model)
    fs = _files(spark, at)
    if not fs.exists(_path(spark, at)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(_path(spark, at))]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def version(spark: SparkSession, folder: str, model: str, number: int | None = None) -> Version | None:
    """A version, the last one if no number is given; None where there is none yet."""
    known = numbers(spark, folder, model)
    if not known:
        return None
    number = known[-1] if number is None else number
    if number not in known:
        raise QueryError(f"no version {number} of {model!r}")
    doc = json.loads(spark.read.text(f"{_home(folder, model)}/{number:020d}.json", wholetext=True).first()[0])
    return Version(doc["number"], tuple(doc["tables"]), doc["fingerprint"], doc["batch"])


def _publish(spark: SparkSession, folder: str, model: str, new: Version) -> None:
    home = _home(folder, model)
    jvm = spark.sparkContext._jvm
    fs, draft = _files(spark, home), _path(spark, f"{home}/.{uuid.uuid4().hex}")
    fs.mkdirs(_path(spark, home))
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(asdict(new)).encode()))
    finally:
        out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    to = _path(spark, f"{home}/{new.number:020d}.json")
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), fs.makeQualified(to), options)
    except Exception as e:
        fs.delete(draft, False)
        raise QueryError(f"version {new.number} of {model!r} was written by another") from e


def _stored(images: DataFrame, folder: str, model: str) -> str:
    path = f"{folder.rstrip('/')}/data/{model}/{uuid.uuid4().hex}"
    images.write.mode("errorifexists").parquet(path)
    return path


def replace(images: DataFrame, folder: str, model: str, fingerprint: str = "", batch: int = -1) -> Version:
    """A new version that holds exactly these images."""
    spark = images.sparkSession
    last = version(spark, folder, model)
    rows = images.select(*_columns(images)).withColumn("gone", F.lit(False))
    new = Version(last.number + 1 if last else 0, (_stored(rows, folder, model),), fingerprint, batch)
    _publish(spark, folder, model, new)
    return new


def change(changed: DataFrame, gone: DataFrame | None, folder: str, model: str, fingerprint: str = "", batch: int = -1) -> Version:
    """A new version: images of known paths replaced, others added, paths of ``gone`` removed.

    Only the changes are written. A batch that is in force already changes nothing. After ``CHANGES`` changes
    the version is merged into a new base.
    """
    spark = changed.sparkSession
    last = version(spark, folder, model)
    if last and 0 <= batch <= last.batch:
        return last
    rows = changed.select(*_columns(changed)).withColumn("gone", F.lit(False))
    if gone is not None:
        rows = rows.unionByName(gone.select("path").join(rows.select("path"), "path", "left_anti").withColumn("gone", F.lit(True)), allowMissingColumns=True)
    tables = (*(last.tables if last else ()), _stored(rows, folder, model))
    if len(tables) > CHANGES + 1:
        tables = (_stored(_merged(spark, tables).withColumn("gone", F.lit(False)), folder, model),)
    new = Version(last.number + 1 if last else 0, tables, fingerprint, batch)
    _publish(spark, folder, model, new)
    return new


def _columns(images: DataFrame) -> list[str]:
    return [c for c in images.columns if c in ("path", "mtime", "size", "img_id", "img_attrs", "objects")]


def _merged(spark: SparkSession, tables: tuple[str, ...]) -> DataFrame:
    out, seen = None, None
    for t in reversed(tables):
        rows = spark.read.schema(_CHANGED).parquet(t)
        fresh = rows if seen is None else rows.join(seen, "path", "left_anti").select(*rows.columns)
        out = fresh if out is None else out.unionByName(fresh)
        seen = rows.select("path") if seen is None else seen.union(rows.select("path"))
    return out.where("not gone").drop("gone")


def read(spark: SparkSession, folder: str, model: str, number: int | None = None) -> DataFrame:
    """The images of a version."""
    found = version(spark, folder, model, number)
    if found is None:
        raise QueryError(f"no version of {model!r}")
    return _merged(spark, found.tables)


def expire(spark: SparkSession, folder: str, model: str, keep: int = 2) -> int:
    """Forget all but the last versions, and delete tables that no kept one holds; the number of deleted tables."""
    known = numbers(spark, folder, model)
    old = known[: max(0, len(known) - max(1, keep))]
    held = {t for n in known[len(old) :] for t in version(spark, folder, model, n).tables}
    lost = {t for n in old for t in version(spark, folder, model, n).tables} - held
    fs = _files(spark, folder)
    for n in old:
        fs.delete(_path(spark, f"{_home(folder, model)}/{n:020d}.json"), False)
    for t in lost:
        fs.delete(_path(spark, t), True)
    return len(lost)
