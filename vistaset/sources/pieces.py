"""Large JSON documents, read by many tasks.

A document is cut into chunks of bytes. Where a chunk starts, inside a text or not and how deep, depends on all bytes
before it; so a first pass tells of each chunk how it changes both states, whichever it starts in (a few numbers a
chunk), which put together give every chunk its start. A second pass lists the few members of the document's top
level, from the chunks whose least depth lets one begin there; from then on each task yields the members of a section
that begin in its chunks and reads on to the end of the last one. No task holds more than a chunk and a member, and
values stay JSON text for ``from_json``. Packed files (``pages.PackedOut``) are read alike, in chunks of whole frames.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import QueryError
from .pages import PackedIn

#: Bytes of a chunk; of the first step and of the longest where a member goes on beyond it; of a task's chunks, about.
CHUNK, STEP, STEPS, TASK = 16 << 20, 4 << 10, 1 << 20, 32 << 20
#: A chunk: ``at`` to ``stop`` of a file of this length; ``place``: where to find it there (in a packed file, its first frame).
_CUTS = "file string, at long, stop long, place long, length long"
_STARTS = f"{_CUTS}, inside boolean, depth int"
_LOCAL = re.compile("^file:/+")
_KEY = re.compile(rb'\s*("(?:[^"\\]|\\.)*+")\s*:', re.DOTALL)
#: Quotes and brackets, all other bytes, and how brackets change the depth.
_MARKS = bytes(c in b'"{}[]' for c in range(256))
_OTHERS = bytes(c for c in range(256) if c not in b'"{}[]')
_DEPTH = np.array([(c in b"{[") - (c in b"}]") for c in range(256)], np.int32)


def opened(uri: str, start: int = 0, place: int = 0):
    """A file of any file system that pyarrow knows, for reading at any place; packed ones from a frame on."""
    fs, path = (pafs.LocalFileSystem(), _LOCAL.sub("/", uri)) if uri.startswith("file:") else pafs.FileSystem.from_uri(uri)
    f = fs.open_input_file(path)
    return PackedIn(f, start, place) if uri.endswith(".gz") else f


def _batch(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(kinds.items())})


def _cut(chunk: int):
    """Chunks of files; those of packed files are whole frames, so that each is unpacked once."""

    def cuts(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for uri, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if uri.endswith(".gz"):
                    with opened(uri) as f:
                        out += [(uri, *c, f.size()) for c in f.cuts(chunk)]
                else:
                    out += [(uri, at, min(at + chunk, length), at, length) for at in range(0, length, chunk)]
            yield _batch(out, file=pa.string(), at=pa.int64(), stop=pa.int64(), place=pa.int64(), length=pa.int64())

    return cuts


def _escaped(f, at: int, data: bytes) -> bool:
    """Whether an odd number of backslashes stands before ``data``; looked up where it matters, as a quote follows."""
    if not data.lstrip(b"\\").startswith(b'"'):
        return False
    n, size = 0, 64
    while n < at:
        back = f.read_at(min(size, at - n), max(0, at - n - size))
        tail = len(back) - len(back.rstrip(b"\\"))
        n += tail
        if tail < len(back):
            break
        size *= 2
    return n % 2 == 1


def _marks(data: bytes, escaped: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and bytes of quotes and brackets, and whether an even number of quotes ends before each."""
    a = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(np.frombuffer(data.translate(_MARKS), np.bool_))
    marks = a[at]
    quote = marks == 34
    if escaped or b"\\" in data:
        q = at[quote]
        slash = np.flatnonzero(a == 92)
        first = np.diff(slash, prepend=-2) > 1  # of a run of backslashes
        run = np.arange(len(slash)) - np.maximum.accumulate(np.where(first, np.arange(len(slash)), 0)) + 1
        run += (slash - run == -1) * int(escaped)
        odd = np.zeros(len(data) + 1, np.bool_)  # of places behind backslashes
        odd[slash + 1] = run % 2 == 1
        odd[0] = escaped
        keep = np.ones(len(at), np.bool_)
        keep[np.flatnonzero(quote)[odd[q]]] = False
        at, marks, quote = at[keep], marks[keep], quote[keep]
    return at, marks, (np.cumsum(quote) - quote) & 1 == 0


def _told(batches) -> Iterator[pa.RecordBatch]:
    """How each chunk changes quoting and depth, and its least depth, should it start outside of a text or within."""
    for b in batches:
        out = []
        for uri, at, stop, place, _ in zip(*(c.to_pylist() for c in b.columns), strict=True):
            with opened(uri, at, place) as f:
                data = f.read_at(stop - at, at)
                escaped = _escaped(f, at, data)
            plain = not escaped and b"\\" not in data
            marks = np.frombuffer(data.translate(None, _OTHERS), np.uint8) if plain else _marks(data, escaped)[1]
            brackets, quotes = marks != 34, np.cumsum(marks == 34) & 1
            row = [uri, at, bool(len(quotes) and quotes[-1])]
            for odd in (0, 1):
                depth = np.cumsum(_DEPTH[marks[brackets & (quotes == odd)]])
                row += [int(depth[-1]), min(0, int(depth.min()))] if len(depth) else [0, 0]
            out.append(tuple(row))
        yield _batch(out, file=pa.string(), at=pa.int64(), flips=pa.bool_(), outside=pa.int32(), low=pa.int32(), within=pa.int32(), low_within=pa.int32())


def _begun(data: bytes, escaped: bool, inside: bool, depth: int, level: int) -> tuple[np.ndarray, np.ndarray, bool, int]:
    """Where members of a level begin in a chunk, where one ends (at a comma, or the bracket that closes the level), and the state at its end."""
    at, marks, even = _marks(data, escaped)
    out, quote = even != inside, marks == 34
    step = np.where(out, _DEPTH[marks], 0)
    after = depth + np.cumsum(step)
    # commas count where the level's own text stands
    own = np.concatenate(([not inside and depth == level], (out != quote) & (after == level)))
    own = np.repeat(own, np.diff(np.concatenate(([0], at, [len(data)]))))
    commas = np.flatnonzero(own & (np.frombuffer(data, np.uint8) == 44))
    begin = np.sort(np.concatenate((commas, at[(step > 0) & (after == level)]))) + 1
    end = np.sort(np.concatenate((commas, at[(step < 0) & (after == level - 1)])))
    return begin, end, inside ^ (int(quote.sum()) % 2 == 1), int(after[-1]) if len(after) else depth


def _members(level: int):
    """(file, chunk, at, key, value) of the members of a level that begin in each chunk and between two places; keys are JSON text or null."""

    def found(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, at, stop, place, length, inside, depth, first, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with opened(uri, at, place) as f:
                    data = f.read_at(stop - at, at)
                    begin, end, inside, depth = _begun(data, _escaped(f, at, data), inside, depth, level)
                    begin, end = begin[(begin > first - at) & (begin < last - at)].tolist(), end.tolist()
                    if begin and (not end or end[-1] < begin[-1]):  # the last one goes on
                        more, here, ends, step = [data], stop, (), STEP
                        while not len(ends) and here < length:
                            part = f.read_at(min(step, length - here), here)
                            _, ends, inside, depth = _begun(part, _escaped(f, here, part), inside, depth, level)
                            more.append(part)
                            here += len(part)
                            step = min(2 * step, STEPS)
                        if not len(ends):
                            raise QueryError(f"{uri} ends within a value")
                        end.append(here - len(part) + int(ends[0]) - at)
                        data = b"".join(more)
                stops = np.asarray(end)[np.searchsorted(end, begin)].tolist() if begin else []
                rows = []
                for s, e in zip(begin, stops, strict=True):
                    named = _KEY.match(data, s, e)
                    value = data[named.end() : e] if named else data[s:e].lstrip()
                    if named or value:
                        rows.append((at + s, named and named[1], value))
                for i in range(0, len(rows), 4096):
                    at_, key, value = zip(*rows[i : i + 4096], strict=True)
                    text = lambda c: pa.array(c, pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_pydict({"file": pa.array([uri] * len(at_), pa.string()), "chunk": pa.array([at] * len(at_), pa.int64()), "at": pa.array(at_, pa.int64()), "key": text(key), "value": text(value)})

    return found


def _heads(batches) -> Iterator[pa.RecordBatch]:
    """Of the top level's members: where their values begin and end, name, and the value where it is no list or object."""
    decoder = json.JSONDecoder()
    for b in batches:
        out = []
        for uri, at, stop, place, length, inside, depth in zip(*(c.to_pylist() for c in b.columns), strict=True):
            with opened(uri, at, place) as f:
                data = f.read_at(stop - at, at)
                for s in _begun(data, _escaped(f, at, data), inside, depth, 1)[0].tolist():
                    text = f.read_at(min(1 << 16, length - at - s), at + s).decode(errors="ignore").lstrip()
                    if not text.startswith('"'):
                        continue
                    name, k = decoder.raw_decode(text)
                    value = text[k:].lstrip().removeprefix(":").lstrip()
                    out.append((uri, at + s, name, None if value[:1] in ("{", "[") else json.dumps(decoder.raw_decode(value)[0])))
        yield _batch(out, file=pa.string(), at=pa.int64(), name=pa.string(), value=pa.string())


class Document:
    """JSON documents of a path (a file, a folder or a pattern), each an object at its top."""

    def __init__(self, spark: SparkSession, path: str, chunk: int = CHUNK):
        self.spark = spark
        files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length")
        cuts = sorted(tuple(r) for r in files.mapInArrow(_cut(chunk), _CUTS).collect())
        # all chunks at once: one by one, their tasks would run one after the other
        told = {(r["file"], r["at"]): r for r in self._spread(cuts, _CUTS).mapInArrow(_told, "file string, at long, flips boolean, outside int, low int, within int, low_within int").collect()}
        self.parts, self.starts, tops = len(cuts), [], []
        file, inside, depth = None, False, 0
        for cut in [*cuts, (None,)]:
            if cut[0] != file:
                if inside or depth:
                    raise QueryError(f"{file} is not a whole JSON document")
                file, inside, depth = cut[0], False, 0
            if file is not None:
                t = told[cut[:2]]
                self.starts.append((*cut, inside, depth))
                if depth + (t["low_within"] if inside else t["low"]) <= 1:  # only there can members of the top level begin
                    tops.append(self.starts[-1])
                depth += t["within"] if inside else t["outside"]
                inside ^= t["flips"]
        heads = self._spread(tops, _STARTS).mapInArrow(_heads, "file string, at long, name string, value string").collect()
        self.heads = sorted((r["file"], r["at"], r["name"], r["value"]) for r in heads)

    def _spread(self, chunks: list[tuple], schema: str) -> DataFrame:
        """Chunks dealt to tasks that read a few of them each, one at a time."""
        size = sum(c[2] - c[1] for c in chunks)
        n = max(4 * self.spark.sparkContext.defaultParallelism, -(-size // TASK))
        return self.spark.createDataFrame(chunks, schema).repartition(max(1, min(n, len(chunks), 10_000)))

    def values(self, name: str) -> list:
        """A plain value of the top level, one of each document that has it."""
        return [json.loads(v) for _, _, n, v in self.heads if n == name and v is not None]

    def section(self, name: str) -> DataFrame:
        """(file, at, key, value, chunk) of a section's members; values are JSON text, keys are null in lists."""
        ends = {a[:2]: b[1] if b[0] == a[0] else 1 << 62 for a, b in pairwise([*self.heads, ("", 0, "", None)])}
        own: dict[str, list] = {}
        for f, at, n, v in self.heads:
            if n == name and v is None:
                own.setdefault(f, []).append((at, ends[f, at]))
        chunks = [(*c, first, last) for c in self.starts for first, last in own.get(c[0], ()) if c[1] < last and first < c[2]]
        rows = self._spread(chunks, f"{_STARTS}, first long, last long").mapInArrow(_members(2), "file string, chunk long, at long, key string, value string")
        key = F.when(F.col("key").isNotNull(), F.from_json(F.concat(F.lit('{"k":'), "key", F.lit("}")), "k string")["k"])
        return rows.select("file", "at", key.alias("key"), "value", "chunk")

    def numbered(self, name: str) -> DataFrame:
        """A section's members with their place ``pos`` from 0; only the number of members of each chunk passes through the driver."""
        rows = self.section(name)
        n: dict[str, int] = {}
        first = []
        for r in sorted(rows.groupBy("file", "chunk").count().collect()):
            first.append((r["file"], r["chunk"], n.get(r["file"], 0)))
            n[r["file"]] = n.get(r["file"], 0) + r["count"]
        first = F.broadcast(self.spark.createDataFrame(first, "file string, chunk long, first long"))
        place = F.row_number().over(Window.partitionBy("file", "chunk").orderBy("at")) - 1
        return rows.withColumn("place", place).join(first, ["file", "chunk"]).withColumn("pos", F.col("first") + F.col("place")).drop("first", "place")
