"""Results as files written by the tasks that hold them.

A data source writer puts the texts of a partition into one file, between a head and a foot, so that each file is a
whole document. Tasks write under a hidden folder; when all of them have ended, the files that the commit names get
their places, in the order of partitions, and ``_SUCCESS`` says so. Files of failed or repeated attempts stay in the
hidden folder, which goes at the end either way.
"""

from __future__ import annotations

import bisect
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


@dataclass(frozen=True)
class Form:
    """What stands before, between and after the texts of a file, and the ending of its name."""

    head: str
    between: str
    foot: str
    ending: str


#: Bytes of a packed file's frame before packing, at least; texts are joined up to as many, so most frames hold nearly twice that.
FRAME = 4 << 20
_HEAD = struct.Struct("<10sHccHQQ")
_MAGIC = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff"


class PackedOut:
    """A gzip file of many members (frames): an extra field of each tells its length, packed and unpacked."""

    def __init__(self, f):
        self.f, self.held, self.n = f, [], 0

    def write(self, data: bytes) -> None:
        self.held.append(data)
        self.n += len(data)
        if self.n >= FRAME:
            self.flush()

    def flush(self) -> None:
        data = b"".join(self.held)
        z = zlib.compressobj(3, zlib.DEFLATED, -15)
        body = z.compress(data) + z.flush()
        self.f.write(_HEAD.pack(_MAGIC, 20, b"v", b"s", 16, _HEAD.size + len(body) + 8, len(data)) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))
        self.held, self.n = [], 0


class PackedIn:
    """Reads such a file at any place: frames are found by their headers, as far as is read, and one is held unpacked.

    It may be opened at a frame: ``place`` is where that stands in the file, ``start`` where in what is packed.
    """

    def __init__(self, f, start: int = 0, place: int = 0):
        self.f, self.starts, self.places, self.next, self.end, self.held = f, [start], [], place, f.size(), (-1, b"")

    def _find(self, stop: int | None = None) -> None:
        while self.next < self.end and (stop is None or self.starts[-1] < stop):
            magic, _, a, b, _, packed, plain = _HEAD.unpack(self.f.read_at(_HEAD.size, self.next))
            if (magic, a, b) != (_MAGIC, b"v", b"s"):
                raise ValueError("not a packed file of this library")
            self.places.append((self.next, packed))
            self.starts.append(self.starts[-1] + plain)
            self.next += packed

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.f.close()

    def size(self) -> int:
        self._find()
        return self.starts[-1]

    def cuts(self, least: int) -> list[tuple[int, int, int]]:
        """(start, stop, place) of runs of whole frames, each ended as it holds so many bytes."""
        self._find()
        out, k = [], 0
        for j in range(1, len(self.starts)):
            if self.starts[j] - self.starts[k] >= least or j == len(self.places):
                out.append((self.starts[k], self.starts[j], self.places[k][0]))
                k = j
        return [c for c in out if c[0] < c[1]]

    def _unpacked(self, k: int, n: int) -> bytes:
        """A frame, or its first bytes where few are wanted."""
        (place, packed), plain = self.places[k], self.starts[k + 1] - self.starts[k]
        if 2 * n < plain:
            head = zlib.decompressobj(31).decompress(self.f.read_at(min(packed, n + (1 << 16)), place), n)
            if len(head) == n:
                return head
        return zlib.decompress(self.f.read_at(packed, place), 31, max(plain, 1))

    def read_at(self, n: int, at: int) -> bytes:
        if at < self.starts[0]:  # before the frame that it was opened at
            self.starts, self.places, self.next, self.held = [0], [], 0, (-1, b"")
        self._find(at + n)
        out, stop = [], min(at + n, self.starts[-1])
        while at < stop:
            k = bisect.bisect_right(self.starts, at) - 1
            first, last = at - self.starts[k], min(stop, self.starts[k + 1]) - self.starts[k]
            if self.held[0] != k or len(self.held[1]) < last:
                self.held = (k, self._unpacked(k, last))
            out.append(self.held[1][first:last])
            at += last - first
        return b"".join(out)


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    rows: int


def _at(folder: str):
    if re.match("file:|/", folder):
        return pafs.LocalFileSystem(), re.sub("^file:/+", "/", folder).rstrip("/")
    fs, path = pafs.FileSystem.from_uri(folder)
    return fs, path.rstrip("/")


def _joined(texts: pa.Array, between: str):
    """(number, bytes) of texts that follow each other, a frame of them or one at a time; a null is an empty text."""
    texts, between = pc.fill_null(texts, ""), pa.scalar(between, texts.type)
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + len(between.as_buffer())), 0
    while at < len(texts):
        n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + FRAME, "right")) - at)
        row = pa.LargeListArray.from_arrays(pa.array([0, n], pa.int64()), texts.slice(at, n))
        yield n, pc.binary_join(row, between)[0].as_buffer()
        at += n


class PagesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, form: Form):
        self.folder, self.form, self.run = folder, form, uuid.uuid4().hex

    def write(self, iterator) -> Written:
        fs, at = _at(self.folder)
        part, rows = TaskContext.get().partitionId(), 0
        name = f"{at}/_writing-{self.run}/{part}-{uuid.uuid4().hex}"
        fs.create_dir(f"{at}/_writing-{self.run}", recursive=True)
        with fs.open_output_stream(name, compression=None) as to:
            f = PackedOut(to) if self.form.ending.endswith(".gz") else to
            f.write(self.form.head.encode())
            for b in iterator:
                for n, texts in _joined(b.column(0), self.form.between):
                    if rows:
                        f.write(self.form.between.encode())
                    f.write(texts)
                    rows += n
            f.write(self.form.foot.encode())
            f.flush()
        return Written(part, name, rows)

    def commit(self, messages) -> None:
        """Only files with rows stay, or one without where there are none at all."""
        fs, at = _at(self.folder)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        for m in [m for m in done if m.rows] or done[:1]:
            fs.move(m.name, f"{at}/part-{m.part:06d}{self.form.ending}")
        self.abort(messages)
        with fs.open_output_stream(f"{at}/_SUCCESS") as f:
            f.write(b"")

    def abort(self, messages) -> None:
        fs, at = _at(self.folder)
        if fs.get_file_info(f"{at}/_writing-{self.run}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{at}/_writing-{self.run}")


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vistaset_pages"

    def writer(self, schema, overwrite: bool) -> PagesWriter:
        o = self.options
        return PagesWriter(o["path"], Form(o["head"], o["between"], o["foot"], o["ending"]))


def write(texts: DataFrame, folder: str, form: Form) -> None:
    """Write a column of texts to an empty or new folder; an order of partitions becomes one of file names."""
    fs, at = _at(folder)
    if fs.get_file_info(f"{at}/_SUCCESS").type != pafs.FileType.NotFound:
        raise FileExistsError(folder)
    texts.sparkSession.dataSource.register(Pages)
    texts.write.format("vistaset_pages").mode("append").options(path=folder, head=form.head, between=form.between, foot=form.foot, ending=form.ending).save()
