"""What the operators of this subpackage share: input tables, shared storage, Arrow helpers."""

from __future__ import annotations

import ctypes
import os
import pickle
import shutil
import tempfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import forget, new_path, shared_dir, written

__all__ = ["WORD", "crc_mod", "first_of", "forget", "new_path", "own_columns", "packed", "released", "shared_dir", "ship", "table", "unpacked", "whole_groups", "written"]

#: Whitespace of the word rules: the ASCII space and tab to carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator reads; extra columns, whatever their names, stay out."""
    at = [df.columns.index(n) for n in names]
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names, strict=True)])


def first_of(df: DataFrame, keys: list[str], order: list[Column], n: int, spread: int = 64) -> DataFrame:
    """The first ``n`` rows of each key in an order, with their ``rank`` from 1.

    Ranks are cut within tasks, then within ``spread`` parts of a key, then over the key, so one task never
    gets more than ``n * spread`` rows of a frequent key at the end.
    """
    rank = lambda *by: F.row_number().over(Window.partitionBy(*keys, *by).orderBy(*order))
    parts = df.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(spread)))
    parts = parts.withColumn("rank", rank("_part")).where(F.col("rank") <= n).drop("_part")
    return parts.withColumn("rank", rank()).where(F.col("rank") <= n)


def whole_groups(batches, *keys: str):
    """Tables of a partition that is sorted by ``keys``: no group of equal keys is cut."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if held and any(held[-1].column(k)[-1] != b.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        cols = [b.column(k).to_numpy() for k in keys]
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols]))
        cut = int(new[-1]) + 1 if len(new) else 0
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def packed(batches, size: int):
    """(chunk, block): the other columns of a chunk's rows, about ``size`` bytes of texts (the last column) together, compressed."""
    z, held, bytes_ = zstandard.ZstdCompressor(level=3), {}, {}

    def out(chunks):
        data = []
        for c in chunks:
            bytes_.pop(c)
            data.append(z.compress(pickle.dumps(tuple(zip(*held.pop(c), strict=True)), protocol=5)))
        return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(data, pa.binary())], ["chunk", "block"])

    for b in batches:
        for c, *row in zip(*(x.to_pylist() for x in b.columns), strict=True):
            held.setdefault(c, []).append(row)
            bytes_[c] = bytes_.get(c, 0) + len(row[-1] or b"") + 16
        if full := [c for c, n in bytes_.items() if n > size]:
            yield out(full)
        if sum(bytes_.values()) > 32 * size:
            yield out(list(held))
    if held:
        yield out(list(held))
    released()


def unpacked(blocks: list[bytes]) -> list[list]:
    """The columns of the rows of ``packed`` blocks."""
    z, out = zstandard.ZstdDecompressor(), []
    for x in blocks:
        for k, column in enumerate(pickle.loads(z.decompress(x))):
            if k == len(out):
                out.append([])
            out[k] += column
    return out


def released() -> None:
    """Give freed memory back to the system: workers wait for further tasks with what they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Bytes of an Arrow batch sent to a Python worker, where the session leaves Spark's default of 64 MiB.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that do not have it on their path, and bound their batches by bytes."""
    if spark.conf.get(_BATCH_SETTING, "64m") in ("64m", "64MB", f"{64 << 20}", f"{64 << 20}b"):
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    package = Path(__file__).resolve().parents[1]
    root = package.parent
    known = [Path(p or ".").resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    sc = spark.sparkContext
    if root in known or getattr(sc, "_vistaset_shipped", False):
        return
    # the driver's file server hands the archive to the executors
    home = tempfile.mkdtemp(prefix="vistaset-code-")
    sc.addPyFile(shutil.make_archive(f"{home}/{package.name}", "zip", root, package.name))
    sc._vistaset_shipped = True
