"""Operator 13: lines that many documents hold stay in one of them, found by a sharded minimal perfect hash.

Lines are told by 128-bit hashes of their keys (stripped of ASCII whitespace at both ends, A-Z lower-cased).
Tasks count their documents per hash before the shuffle. The hashes found often enough are cut into shards of
bounded size, and each shard becomes a minimal perfect hash (levels of bits; a hash that is alone at its place
in a level has the rank of its bit) that indexes three arrays: a 64-bit fingerprint, the number of documents
and the largest id. Documents probe the arrays; line texts are never sent. An index of up to ``LOCAL`` bytes
is given to every task, and documents stay where they are. A larger one is probed shard by shard: a shard's
arrays and the hashes asked of it meet sorted, the arrays first, in as many parts as its counts call for, and
only hashes of lines to drop return. Both ways give the same rows.

Defined cases: a null or empty text is one empty line; rows of equal id are documents of their own, and all
rows with the largest id keep a line; a null id is smaller than any other; a line repeated within the document
that keeps it stays repeated. No rows give no rows. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, own_columns, released, table, whole_groups, written

#: Code points of a key, documents that hold it.
LENGTH, DOCUMENTS = 40, 5
#: Hashes of a shard; bytes of an index that every task may hold; rows asked of one part of a shard.
SHARD, LOCAL, ASKED = 1 << 17, 64 << 20, 1 << 20
#: Hashes that a task counts before it sends them on.
HELD = 1 << 18
_SPACE = " \t\n\x0b\x0c\r"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class Places:
    """A minimal perfect hash: each of the pairs that it was made of has a place of its own, from 0 on."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels, left = [], np.arange(len(a))
        while len(left):
            size = 64 * (len(left) // 48 + 1)
            at = self._at(a[left], b[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]

    @staticmethod
    def _at(a, b, level, size):
        odd, step = (np.uint64(c & 0xFFFFFFFFFFFFFFFF) for c in (0x9E3779B97F4A7C15 * (2 * level + 3), 0xC2B2AE3D27D4EB4F * (level + 1)))
        x = (a ^ (a >> np.uint64(32))) * odd
        y = (b + step) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) + (y ^ (y >> np.uint64(32)))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(27))) % np.uint64(size)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of pairs; -1 or any place for pairs that it was not made of."""
        out, left, base = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
        for level, words in enumerate(self.levels):
            at = self._at(a[left], b[left], level, 64 * len(words))
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = word >> bit & np.uint64(1) > 0
            ones = np.bitwise_count(words).astype(np.int64)
            before = np.cumsum(ones) - ones
            out[left[hit]] = base + before[at[hit] >> 6] + np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            base += int(ones.sum())
            left = left[~hit]
        return out


class Shard:
    """Fingerprints, numbers of documents and largest ids, by the places of their hashes."""

    def __init__(self, a, b, n, last, lost):
        a, b = a.view(np.uint64), b.view(np.uint64)
        self.places = Places(a, b)
        self.prints, self.n, self.last, self.lost = np.empty_like(b), np.empty_like(n), np.empty_like(last), np.empty_like(lost)
        at = self.places(a, b)
        self.prints[at], self.n[at], self.last[at], self.lost[at] = b, n, last, lost

    def drops(self, a, b, doc, none, least: int) -> np.ndarray:
        """Whether documents ``doc`` (``none``: a null id) lose the lines of these hashes."""
        a, b = a.view(np.uint64), b.view(np.uint64)
        at = self.places(a, b)
        known = at >= 0
        at = np.where(known, at, 0)
        keeps = (self.lost[at] & none) | (~self.lost[at] & ~none & (self.last[at] == doc))
        return known & (self.prints[at] == b) & (self.n[at] >= least) & ~keeps


def hashes(text: str | None, length: int) -> tuple[list[str], list[int], bytes]:
    """A text's lines, the places of those whose keys have ``length`` code points, and the keys' hashes."""
    lines = (text or "").split("\n")
    at, out = [], []
    for i, line in enumerate(lines):
        if len(line) >= length and len(key := line.strip(_SPACE)) >= length:
            at.append(i)
            out.append(xxhash.xxh3_128_digest(key.encode().translate(_LOWER)))
    return lines, at, b"".join(out)


def _pairs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(data, np.int64).reshape(-1, 2)
    return np.ascontiguousarray(x[:, 0]), np.ascontiguousarray(x[:, 1])


def counted(docs: DataFrame, length: int = LENGTH, least: int = DOCUMENTS) -> DataFrame:
    """(a, b, n, last): hashes of lines found in at least ``least`` documents, how many, and the largest id."""

    def run(batches):
        held: dict[bytes, list] = {}

        def out():
            a, b = _pairs(b"".join(held))
            n, last = zip(*held.values(), strict=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n, pa.int64()), pa.array(last, pa.int64())], ["a", "b", "n", "last"])

        for b in batches:
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                data = hashes(text, length)[2]
                for h in {data[i : i + 16] for i in range(0, len(data), 16)}:
                    if (x := held.get(h)) is None:
                        held[h] = [1, doc]
                    else:
                        x[0] += 1
                        if doc is not None and (x[1] is None or doc > x[1]):
                            x[1] = doc
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()
        released()

    sums = docs.mapInArrow(run, "a long, b long, n long, last long").groupBy("a", "b")
    return sums.agg(F.sum("n").alias("n"), F.max("last").alias("last")).where(F.col("n") >= least)


def index(frequent: DataFrame, count: int) -> tuple[DataFrame, int]:
    """(shard, arrays, n, bytes): the shards, each made by one task from its hashes, and their number."""
    shards = count // SHARD + 1

    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        for several in whole_groups(batches, "shard"):
            shard = several["shard"].to_numpy()
            for s in np.unique(shard):
                t = several.filter(pa.array(shard == s))
                n, last = t["n"].to_numpy(), t["last"]
                made = Shard(t["a"].to_numpy(), t["b"].to_numpy(), n, last.fill_null(0).to_numpy(), last.is_null().to_numpy().astype(bool))
                data = pickle.dumps(made, protocol=5)
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([z.compress(data)], pa.binary()), pa.array([int(n.sum())]), pa.array([len(data)])], ["shard", "arrays", "n", "bytes"])

    parts = frequent.withColumn("shard", F.pmod("a", F.lit(shards)).cast("int")).repartition("shard").sortWithinPartitions("shard")
    return parts.mapInArrow(run, "shard int, arrays binary, n long, bytes long"), shards


def _loaded(data: bytes) -> Shard:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


_KEPT = "doc_id long, text string, n_lines long, n_dropped long"


def _kept(rows) -> pa.RecordBatch:
    """Rows of (id, lines, places to drop) as documents."""
    out = [(doc, "\n".join([x for i, x in enumerate(lines) if i not in gone] if gone else lines), len(lines), len(gone)) for doc, lines, gone in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "text", "n_lines", "n_dropped"])


def _probe_here(docs: DataFrame, shards: DataFrame, number: int, length: int, least: int) -> DataFrame:
    """Every task holds the whole index, of a checked size; nothing is shuffled."""
    told = docs.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["arrays"]) for r in shards.select("shard", "arrays").collect()})

    def run(batches):
        known = {s: _loaded(x) for s, x in told.value.items()}
        for b in batches:
            ids = b["doc_id"].to_pylist()
            found = [hashes(t, length) for t in b["text"].to_pylist()]
            a, h = _pairs(b"".join(f[2] for f in found))
            owner = np.repeat(np.arange(len(found)), [len(f[1]) for f in found])
            doc, none = np.array([0 if i is None else i for i in ids], np.int64)[owner], np.array([i is None for i in ids], bool)[owner]
            drop, shard = np.zeros(len(a), bool), a % number
            for s in np.unique(shard):
                if (x := known.get(int(s))) is not None:
                    at = np.flatnonzero(shard == s)
                    drop[at] = x.drops(a[at], h[at], doc[at], none[at], least)
            line = np.array([p for f in found for p in f[1]], np.int64)
            gone: list[set] = [set() for _ in found]
            for o, p in zip(owner[drop].tolist(), line[drop].tolist(), strict=True):
                gone[o].add(p)
            if found:
                yield _kept(zip(ids, (f[0] for f in found), gone, strict=True))
        released()

    return docs.mapInArrow(run, _KEPT)


def _probe_shards(docs: DataFrame, shards: DataFrame, number: int, length: int, least: int) -> DataFrame:
    """Hashes of lines go to their shards, those to drop come back; rows are told by id and text."""
    parts = np.ones(number, np.int32)
    for r in shards.select("shard", "n").collect():  # two numbers for each shard
        parts[r["shard"]] += r["n"] // ASKED
    row_key = lambda doc, text: xxhash.xxh3_128_digest(f"{doc}\n{text or ''}".encode())

    def ask(batches):
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                data = hashes(text, length)[2]
                k = np.frombuffer(row_key(doc, text), np.int64)
                rows += [(doc, k[0], k[1], *np.frombuffer(data[i : i + 16], np.int64)) for i in range(0, len(data), 16)]
            if rows:
                doc, k, q, a, h = (np.array(c) if i else c for i, c in enumerate(zip(*rows, strict=True)))
                s = a % number
                part = np.abs(k ^ q) % parts[s]
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(part, pa.int32()), pa.array(doc, pa.int64()), *map(pa.array, (k, q, a, h))], ["shard", "part", "doc", "k", "q", "a", "b"])

    asked = docs.mapInArrow(ask, "shard int, part int, doc long, k long, q long, a long, b long").withColumn("arrays", F.lit(None).cast("binary"))
    sizes = F.element_at(F.lit(parts.tolist()), F.col("shard") + 1) if number <= 1 << 16 else F.lit(int(parts.max()))
    sent = shards.select("shard", F.explode(F.sequence(F.lit(0), sizes - 1)).alias("part"), *[F.lit(None).cast("long").alias(c) for c in ("doc", "k", "q", "a", "b")], "arrays")
    both = sent.unionByName(asked).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("arrays").isNull())

    def answer(batches):
        known, of = None, None
        for b in batches:
            keys = np.column_stack([b["shard"].to_numpy(), b["part"].to_numpy()])
            cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for s, e in zip(cut, cut[1:], strict=False):
                if e == s:
                    continue
                rows = b.slice(s, e - s)
                if tuple(keys[s]) != of:
                    known, of = None, tuple(keys[s])
                if rows["arrays"][0].is_valid:
                    known, rows = _loaded(rows["arrays"][0].as_py()), rows.slice(1)
                if known is None or not rows.num_rows:
                    continue
                a, h = rows["a"].to_numpy(), rows["b"].to_numpy()
                none = np.array(rows["doc"].is_null().to_numpy(zero_copy_only=False), bool)
                drop = pa.array(known.drops(a, h, rows["doc"].fill_null(0).to_numpy(), none, least))
                yield rows.select(["k", "q", "a", "b"]).filter(drop)

    dropped = both.mapInArrow(answer, "k long, q long, a long, b long").groupBy("k", "q").agg(F.collect_set(F.struct("a", "b")).alias("gone"))

    def named(batches):
        for b in batches:
            k = [row_key(d, t) for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True)]
            x, y = _pairs(b"".join(k))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(x), pa.array(y)], [*b.schema.names, "k", "q"])

    rows = docs.mapInArrow(named, "doc_id long, text string, k long, q long").join(dropped, ["k", "q"], "left").select("doc_id", "text", "gone")

    def cut_out(batches):
        for b in batches:
            out = []
            for doc, text, gone in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["gone"].to_pylist(), strict=True):
                lines, at, data = hashes(text, length)
                bad = {(g["a"], g["b"]) for g in gone or ()}
                x, y = _pairs(data)
                out.append((doc, lines, {p for p, u, v in zip(at, x.tolist(), y.tolist(), strict=True) if (u, v) in bad}))
            if out:
                yield _kept(out)

    return rows.mapInArrow(cut_out, _KEPT)


def without_common_lines(docs: DataFrame, length: int = LENGTH, least: int = DOCUMENTS, local: int = LOCAL) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of every document, its text without lines that others keep."""
    texts = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent = written(counted(texts, length, least), "lines")
    made, number = index(frequent, frequent.count())
    shards = written(made, "shards")
    forget(frequent)
    size = shards.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    probe = _probe_here if size <= local else _probe_shards
    return probe(texts, shards, number, length, least)


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_common_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
  l AS (SELECT r, doc_id, unnest(x) AS line, unnest(range(len(x))) AS i FROM d),
  k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
  f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {LENGTH} GROUP BY key HAVING count(DISTINCT r) >= {DOCUMENTS}),
  m AS (SELECT k.*, f.key IS NOT NULL AND last IS DISTINCT FROM doc_id AS gone FROM k LEFT JOIN f ON f.key = k.key)
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r, doc_id"""
