"""BPE encoding and decoding over a table of distinct words.

Texts are cut into words at places where the tokenizer cannot merge, so words encode alone, each
distinct word once. The most frequent words, a fixed number of bounded length, are encoded first and
broadcast. Documents are dealt by a hash of id and text into chunks of bounded size; each chunk
reports its other distinct words; these meet by hash, are encoded, and their ids return to the chunks
that hold them. There the ids are joined to every position of every document, and decoding joins each
id with its piece (the vocabulary, of fixed size). Texts travel as compressed blocks of many documents.

Defined results: null text is empty text with no ids; repeated rows are encoded row by row; very long texts
are encoded whole; words of equal frequency are listed in byte order; extra columns, whatever their names,
take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_columns, released, table

#: Bytes of text in a chunk, about; bytes of a block of texts in transit and of texts decoded together, about.
CHUNK_BYTES, BLOCK_BYTES = 12 << 20, 1 << 20
#: Words broadcast, their length at most, and how often a task must see a word to name it for the list.
FREQUENT, WORD_BYTES, LOCAL_LEAST = 200_000, 64, 4
#: Words whose ids a worker keeps between blocks, about.
MEMO_WORDS = 200_000

# Bytes that cannot be or begin white space other than blank and newline.
_PLAIN = bytes(b for b in range(256) if b in (10, *range(32, 127)) or b >= 128 and b not in (0xC2, 0xE1, 0xE2, 0xE3))
_PAIRS = (b"  ", b" \n", b"\n ", b"\n\n")
# A single blank or newline between visible ASCII signs is always cut the same way.
_SURE = re.compile(rb"(?<=[!-~])(?= [!-~])|(?<=[!-~])(?=\n[!-~])|(?<=[!-~]\n)(?=[!-~])")


def words(text: bytes) -> list[bytes]:
    """Parts whose encodings, one after the other, are the encoding of the text.

    The pattern of the tokenizer keeps a blank with the word after it and never joins across it when
    it stands alone between visible signs; a lone newline is a piece of its own. Texts with other or
    repeated white space are cut only between visible ASCII signs.
    """
    if not text.translate(None, _PLAIN) and not any(p in text for p in _PAIRS):
        return text.replace(b" ", b"\xff ").replace(b"\n", b"\xff\n\xff").split(b"\xff")
    return _SURE.split(text)


class Ids(dict):
    """The ids of a chunk's own words; all others are among the common ones."""

    common: dict[bytes, bytes]

    def __missing__(self, word: bytes) -> bytes:
        found = self[word] = self.common[word]
        return found


def load(path: str):
    """The tokenizer without truncation and padding, and its id-to-piece column."""
    # a task has one core; threads of its own would each keep a cache
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    vocab = t.get_vocab(with_added_tokens=True)
    pieces = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        pieces[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    return t, pa.array(pieces, pa.large_binary())


class Listed:
    """Words and their ids in one Arrow message, which becomes a dictionary where it is received: the driver makes no objects of them."""

    def __init__(self, words_: pa.Table):
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, words_.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(words_)
        self.message = out.getvalue().to_pybytes()

    def __reduce__(self):
        return _listed, (self.message,)


def _listed(message: bytes) -> dict[bytes, bytes]:
    t = pa.ipc.open_stream(message).read_all()
    return dict(zip(t.column("word").to_pylist(), t.column("ids").to_pylist(), strict=True)) | {b"": b""}


def _joined(column: pa.Array, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The column's values at ``ids``, end to end, and where each begins."""
    got = column.take(pa.array(ids))
    at = np.frombuffer(got.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    return (got.buffers()[2].to_pybytes() if len(ids) and got.buffers()[2] else b""), at


def _counted(batches):
    n: Counter = Counter()

    def out():
        kept = {w: c for w, c in n.items() if c >= LOCAL_LEAST and 0 < len(w) <= WORD_BYTES}
        return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], ["word", "n"])

    for b in batches:
        for t in b.column("text").to_pylist():
            if t:
                n.update(words(t))
        if len(n) > 1_000_000:
            yield out()
            n.clear()
    yield out()
    n.clear()
    released()


def _ids(tokenizer, memo: dict[bytes, bytes], words_: list[bytes]) -> list[bytes]:
    """The words' ids (little-endian 32-bit); those that ``memo`` lacks are encoded, once each."""
    new = list({x for x in words_ if x not in memo})
    for x, e in zip(new, tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in new], add_special_tokens=False), strict=True):
        memo[x] = np.array(e.ids, "<u4").tobytes()
    return [memo[x] for x in words_]


def _common(path: str):
    def encoded(batches):
        tokenizer, _ = load(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(_ids(tokenizer, {}, b.column("word").to_pylist()), pa.binary())], ["word", "ids"])

    return encoded


def _pieces(path: str):
    def made(batches):
        # the batches hold the one row that starts the task
        for _ in batches:
            yield pa.RecordBatch.from_arrays([load(path)[1].cast(pa.binary())], ["piece"])

    return made


def _answered(path: str):
    """Each block of words becomes a block of the words with their ids; a word's blocks are all in one partition."""

    def encoded(batches):
        tokenizer, _ = load(path)
        z, u, memo = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor(), {}
        for b in batches:
            out = []
            for x in b.column("block").to_pylist():
                joined = u.decompress(x)
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                ids = _ids(tokenizer, memo, joined.split(b"\xff"))
                sizes = np.array([len(i) // 4 for i in ids], "<u4")
                flat = np.frombuffer(b"".join(ids), "<u4")
                narrow = not len(flat) or flat.max() < 1 << 16
                out.append(z.compress(pickle.dumps((joined, sizes.tobytes(), flat.astype("<u2" if narrow else "<u4").tobytes(), narrow), protocol=5)))
            yield pa.RecordBatch.from_arrays([b.column("chunk"), pa.array(out, pa.binary())], ["chunk", "block"])
        memo.clear()
        released()

    return encoded


def _answers(blocks: list[bytes]):
    """(word, ids) of all blocks."""
    u = zstandard.ZstdDecompressor()
    for x in blocks:
        joined, sizes, flat, narrow = pickle.loads(u.decompress(x))
        ends = np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64) * 4).tolist()
        data = np.frombuffer(flat, "<u2" if narrow else "<u4").astype("<u4").tobytes()
        begin = 0
        for w, e in zip(joined.split(b"\xff"), ends, strict=True):
            yield w, data[begin:e]
            begin = e


def _blocks(batches):
    """(chunk, block): the documents of a chunk, packed together and compressed."""
    z, held, size = zstandard.ZstdCompressor(level=3), {}, {}

    def out(chunks):
        data = []
        for c in chunks:
            ids, texts = zip(*held.pop(c))
            size.pop(c)
            data.append(z.compress(pickle.dumps((ids, texts), protocol=5)))
        return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(data, pa.binary())], ["chunk", "block"])

    for b in batches:
        for c, i, t in zip(*(b.column(k).to_pylist() for k in ("chunk", "doc_id", "text")), strict=True):
            held.setdefault(c, []).append((i, t or b""))
            size[c] = size.get(c, 0) + len(t or b"") + 16
        if full := [c for c, n in size.items() if n > BLOCK_BYTES]:
            yield out(full)
        if sum(size.values()) > 64 * BLOCK_BYTES:
            yield out(list(held))
    if held:
        yield out(list(held))


def _unpacked(blocks: list[bytes]) -> tuple[list, list[bytes]]:
    z, ids, texts = zstandard.ZstdDecompressor(), [], []
    for x in blocks:
        i, t = pickle.loads(z.decompress(x))
        ids += i
        texts += t
    return ids, texts


def encode(docs: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, columns: str = "digests") -> DataFrame:
    """Per row: doc_id, n_tokens and, for ``digests``, ids_sha256 and decoded_sha256, else ``ids`` and ``decoded``."""
    spark = docs.sparkSession
    own = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism * 2, -(-total // chunk_bytes))
    buckets = 4 * n
    counts = own.select("text").mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).select("word").repartition(spark.sparkContext.defaultParallelism)
    frequent = spark.sparkContext.broadcast(Listed(top.mapInArrow(_common(path), "word binary, ids binary").toArrow()))

    # equal rows of different input partitions go to different chunks
    dealt = own.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n)).cast("int"))
    dealt = dealt.mapInArrow(_blocks, "chunk int, block binary").repartition(n, "chunk")

    def found(batches):
        seen: dict[int, set[bytes]] = {}
        known = frequent.value.keys()
        for b in batches:
            for c, x in zip(b.column("chunk").to_pylist(), b.column("block").to_pylist(), strict=True):
                here = set()
                for t in _unpacked([x])[1]:
                    here.update(words(t))
                seen.setdefault(c, set()).update(here - known)
        z = zstandard.ZstdCompressor(level=3)
        for c, s in seen.items():
            dealt_: dict[int, list[bytes]] = {}
            for w in s:
                dealt_.setdefault(zlib.crc32(w) % buckets, []).append(w)
            # sorted words share beginnings, which the compressor finds
            data = [z.compress(b"\xff".join(sorted(w))) for w in dealt_.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(dealt_), pa.int32()), pa.array([c] * len(data), pa.int32()), pa.array(data, pa.binary())], ["bucket", "chunk", "block"])
        seen.clear()
        released()

    asked = dealt.mapInArrow(found, "bucket int, chunk int, block binary").repartition(n, "bucket")
    rest = asked.mapInArrow(_answered(path), "chunk int, block binary")
    digests = columns == "digests"
    last = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]

    # a task loads the tokenizer, which takes more memory than its pieces; they come in order, as one partition made them
    made = spark.range(0, 1, 1, 1).mapInArrow(_pieces(path), "piece binary").toArrow()
    pieces = spark.sparkContext.broadcast(made.column("piece").combine_chunks().cast(pa.large_binary()))
    del made
    released()

    def assembled(left: pa.Table, right: pa.Table) -> pa.Table:
        doc_ids, texts = _unpacked(left.column("block").to_pylist())
        of = Ids(_answers(right.column("block").to_pylist()))
        of.common = frequent.value
        decimals = pa.array([b"%d," % i for i in range(len(pieces.value))], pa.large_binary()) if digests else None
        kinds = [pa.string(), pa.string()] if digests else [pa.list_(pa.int32()), pa.string()]
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *zip(last, kinds, strict=True)])
        done, begun = [], 0
        while begun < len(texts):
            size, end = 0, begun
            while end < len(texts) and (end == begun or size < BLOCK_BYTES):
                size += len(texts[end])
                end += 1
            flat = [b"".join(map(of.__getitem__, words(t))) for t in texts[begun:end]]
            sizes = np.array([len(x) // 4 for x in flat], np.int64)
            ids = np.frombuffer(b"".join(flat), "<u4")
            bytes_, at = _joined(pieces.value, ids)
            text, begin = _joined(decimals, ids) if digests else (b"", None)
            out: list[list] = [[], []]
            for e, s in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
                decoded = bytes_[at[e - s] : at[e]].decode("utf-8", "replace")
                if digests:
                    out[0].append(hashlib.sha256(text[begin[e - s] : max(begin[e] - 1, begin[e - s])]).hexdigest())
                    out[1].append(hashlib.sha256(decoded.encode()).hexdigest())
                else:
                    out[0].append(ids[e - s : e].astype(np.int32))
                    out[1].append(decoded)
            done.append(pa.record_batch([pa.array(doc_ids[begun:end], pa.int64()), pa.array(sizes), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], schema=schema))
            begun = end
        of.clear()
        del doc_ids, texts
        released()
        return pa.Table.from_batches(done, schema)

    kind = "string" if digests else "array<int>"
    schema = f"doc_id long, n_tokens long, {last[0]} {kind}, {last[1]} string"
    return dealt.groupBy("chunk").cogroup(rest.groupBy("chunk")).applyInArrow(assembled, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
