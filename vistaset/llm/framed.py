"""Token-id files: independent zstandard frames, one per document, with a trailing seek table.

A file holds a frame of little-endian unsigned 32-bit ids for each document, then an index frame (the
documents' ids as int64, then their id counts as uint64), then a skippable frame with the seek table:
for each frame its compressed size, its size and the low 32 bits of the xxh64 of its content. The
table's footer gives the frame count, so a reader fetches the tail, then the index, then only the
frames it is asked for, and checks each against its checksum.

Files are written by tasks through ``pyarrow.fs`` (local, HDFS, S3, GCS URIs) to a name of the
attempt and then moved, so a repeated task leaves one whole file. Documents are range-partitioned by
ascending doc_id. Defined results: null text is empty text (its document holds the end id alone);
null ids come first and are written as the smallest int64; rows with equal ids are ordered by text;
very long texts are one frame each, like any other; extra columns, whatever their names, take no part; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, own_columns, table, written

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
END_ID = 1
NULL_ID = -(2**63)
#: Words of the younger of a Python worker's two memos; beyond it the younger becomes the older.
MEMO_WORDS = 150_000
#: Bytes of text whose words are looked up together, about.
RUN_BYTES = 8 << 20

_SAFE = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_ALL_SAFE = re.compile("[\x01!-~À-ÖØ-öø-ÿ]*")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\x01|[^a-zß-öø-ÿ0-9\x01]+")


class WordIds:
    """Ids (as bytes) of blank-separated words, those of recent words kept.

    The tokenizer never merges across ASCII blanks, so words can be encoded alone. Words of plain
    Latin letters and ASCII signs go through a byte-pair table built from the tokenizer's own
    vocabulary, many in one call: in it the byte 0 stands for the end of a piece and the byte 1 parts
    words (such words hold neither). All other words go through the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        ranks = {}
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            if token in special:
                continue
            body, end = (token[:-4], b"\0") if token.endswith("</w>") and token != "</w>" else (token, b"")
            body = bytes(of[c] for c in body)
            if len(body) == 1 or b"\0" not in body:
                ranks[body + end] = i
        self.table = tiktoken.Encoding("words", pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks, special_tokens={})
        self.gap = self.table.encode_ordinary("\1\0")
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def learned(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of all ``words``, beside others."""
        if len(self.young) > MEMO_WORDS:
            self.young, self.old = {}, self.young
        new = words - self.young.keys()
        for w in new & self.old.keys():
            self.young[w] = self.old[w]
            new.discard(w)
        known = list(new)
        text = b"\1".join(known).decode("utf-8", "replace")
        if text.count("\1") != len(known) - 1 or not _ALL_SAFE.fullmatch(text) or self.special.search(text):
            known, texts = [], []
            for w in new:
                t = w.decode("utf-8", "replace")
                if _SAFE.fullmatch(t) and not self.special.search(t):
                    known.append(w)
                    texts.append(t)
                else:
                    self.young[w] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            text = "\1".join(texts)
        if known:
            ids = np.array(self.table.encode_ordinary(_PIECES.sub("\\g<0>\0", text.lower())), "<u4")
            at = np.flatnonzero(ids == self.gap[0])
            data, step = ids.tobytes(), 4 * len(self.gap)
            ends = [*(4 * at).tolist(), len(data)]
            for w, s, e in zip(known, [0, *(4 * at + step).tolist()], ends, strict=True):
                self.young[w] = data[s:e]
        return self.young

    def encoded(self, texts: pa.Array):
        """The ids of each text (as bytes): its words are numbered in Arrow, and each distinct one is looked up once."""
        split = pc.ascii_split_whitespace(texts.view(pa.string()).fill_null(""))
        places = split.flatten().dictionary_encode()
        words = places.dictionary.view(pa.binary()).to_pylist()
        # blanks at either end leave empty words
        get = self.learned(set(words) - {b""}).get
        found = [get(w, b"") for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts, ids = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(found), "<u4")
        at = places.indices.to_numpy(zero_copy_only=False)
        size = sizes[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        of = np.arange(ends[-1])
        of += np.repeat(starts[at] - ends[:-1], size)
        out = ids[of]
        cuts = ends[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        for s, e in zip(cuts, cuts[1:]):
            yield out[s:e].tobytes()


_MEMO: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _MEMO:
        _MEMO[path] = WordIds(path)
    return _MEMO[path]


class FrameWriter:
    """Writes one file; frames are compressed one by one."""

    def __init__(self, out, level: int = 1):
        self.out, self.zstd, self.table, self.ids, self.sizes = out, zstandard.ZstdCompressor(level=level), [], [], []

    def _frame(self, data: bytes) -> None:
        packed = self.zstd.compress(data)
        self.out.write(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def add(self, doc_id: int, ids: bytes) -> None:
        self._frame(ids)
        self.ids.append(doc_id)
        self.sizes.append(len(ids) // 4)

    def finish(self) -> None:
        self._frame(np.array(self.ids, "<i8").tobytes() + np.array(self.sizes, "<u8").tobytes())
        entries = b"".join(struct.pack("<III", *e) for e in self.table)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries)
        self.out.write(struct.pack("<IBI", len(self.table), 0x80, SEEKABLE))


class FrameReader:
    """Random access to one file: only the frames asked for are read and decompressed."""

    def __init__(self, source):
        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("not a seekable file with checksums")
        table = np.frombuffer(source.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3)
        self.lengths, self.sizes, self.sums = (table[:, i].astype(np.int64) for i in range(3))
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        index = self._frame(n - 1)
        self.doc_ids = np.frombuffer(index[: 8 * (n - 1)], "<i8")
        self.counts = np.frombuffer(index[8 * (n - 1) :], "<u8").astype(np.int64)

    def _checked(self, k: int, packed: bytes) -> bytes:
        data = self.zstd.decompress(packed, max_output_size=int(self.sizes[k]))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} fails its checksum")
        return data

    def _frame(self, k: int) -> bytes:
        return self._checked(k, self.source.read_at(int(self.lengths[k]), int(self.offsets[k])))

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document of the file."""
        return np.frombuffer(self._frame(k), "<u4")

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of all documents with this doc_id."""
        return [self.document(int(k)) for k in np.flatnonzero(self.doc_ids == doc_id)]

    def scan(self, ahead: int = 4 << 20):
        """All documents' bytes in order, read in runs of about ``ahead`` bytes."""
        n, k = len(self.doc_ids), 0
        while k < n:
            stop = max(k + 1, min(n, int(np.searchsorted(self.offsets, self.offsets[k] + ahead, "right")) - 1))
            run = self.source.read_at(int(self.offsets[stop] - self.offsets[k]), int(self.offsets[k]))
            for i in range(k, stop):
                at = int(self.offsets[i] - self.offsets[k])
                yield self._checked(i, run[at : at + int(self.lengths[i])])
            k = stop


def open_reader(uri: str) -> FrameReader:
    where, path = fs.FileSystem.from_uri(uri)
    return FrameReader(where.open_input_file(path))


def _runs(batches):
    """(doc_ids, texts) of consecutive rows, of about RUN_BYTES."""
    held, size = [], 0
    run = lambda: (pa.concat_arrays([b.column("doc_id") for b in held]).to_pylist(), pa.concat_arrays([b.column("text") for b in held]))
    for b in batches:
        total, k = np.cumsum(pc.binary_length(b.column("text")).fill_null(0).to_numpy().astype(np.int64)), 0
        while k < b.num_rows:
            before = total[k - 1] if k else 0
            stop = min(b.num_rows, int(np.searchsorted(total, before + RUN_BYTES - size)) + 1)
            held.append(b.slice(k, stop - k))
            size, k = size + total[stop - 1] - before, stop
            if size >= RUN_BYTES:
                yield run()
                held, size = [], 0
    if held:
        yield run()


def write_files(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Encode ``docs`` into files under ``folder``; returns the manifest (file, part, n_docs, n_ids)."""

    def wrote(batches):
        words, end = encoder(tokenizer), np.array([END_ID], "<u4").tobytes()
        where, root = fs.FileSystem.from_uri(folder)
        part, writer, stream = TaskContext.get().partitionId(), None, None
        name = f"{root}/ids-{part:06d}.tzst"
        own = f"{name}.{uuid.uuid4().hex}"
        for ids, texts in _runs(batches):
            if writer is None:
                where.create_dir(root, recursive=True)
                stream = where.open_output_stream(own)
                writer = FrameWriter(stream)
            for i, own_ids in zip(ids, words.encoded(texts), strict=True):
                writer.add(NULL_ID if i is None else i, own_ids + end)
        if writer is not None:
            writer.finish()
            stream.close()
            where.move(own, name)
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/ids-{part:06d}.tzst"], "part": [part], "n_docs": [len(writer.ids)], "n_ids": [sum(writer.sizes)]})

    own = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    dealt = own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(dealt.mapInArrow(wrote, "file string, part long, n_docs long, n_ids long"), "manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids before it), n_tokens, ids_crc32."""
    # one row per file: the running sum is over files, not documents
    starts = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def read(batches):
        for b in batches:
            for uri, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                r = open_reader(uri)
                begin = start + np.concatenate([[0], np.cumsum(r.counts)])[:-1].astype(np.int64)
                crc = np.fromiter((zlib.crc32(d) for d in r.scan()), np.int64, len(r.doc_ids))
                yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids, mask=r.doc_ids == NULL_ID), pa.array(begin), pa.array(r.counts), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism * 2)
    return starts.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "token-ids")
    return read_files(write_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json")))
