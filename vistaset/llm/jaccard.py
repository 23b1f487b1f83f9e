"""N-gram Jaccard join by rare-first prefix filtering.

A document's set is its distinct word n-grams as 64-bit hashes. The length of grams (``n``) and the least
similarity (``percent``) are parameters; N and PERCENT are those of op8. Equal sets collapse first into one
class.Grams are ordered rare first, by the number of documents that hold them: texts are dealt into chunks,
each chunk tells its distinct grams (CELL_BITS bits of each) to the range that holds them, ranges add them up
and answer with counts in one byte, ties go by hash. It is one fixed order for all sets, so two sets of
similarity t share a gram within their prefixes, even where cut bits let grams be counted as one. A gram of one
document gives no posting. Chunks and ranges grow in number with the input, not in size.

Prefix grams are joined under the length filter, the positional filter and a suffix filter (grams counted in
hash ranges bound the overlap). Lists longer than LIST_BLOCK are dealt into blocks, and each pair of blocks is
a group of its own, so no task holds a whole hot list. What passes is reduced to candidate components, by
edges that span them: every link lies within one. There each pair is verified once, on exact sets made from
the texts again: a component's sets are dealt into blocks of bounded size, a task intersects all sets of two
blocks at once (products of incidence matrices), and gives one row per set: the documents it links with, and
an edge that spans the links. Pairs are never written, so moved data grow with the members, not their square.

Defined results: null texts and texts without words have the empty set, are linked with nothing and
are components of their own; rows with equal ids are rows of their own; very long texts are read whole; extra
columns are carried, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import forget, own_columns, packed, released, table, unpacked, whole_groups, written

N, PERCENT = 3, 90
#: Bits of a gram that are counted: grams that agree in them are counted as one, which costs candidates, no links.
CELL_BITS = 40
#: Bytes of text in a chunk, and in a block of texts in transit, about.
CHUNK_BYTES, BLOCK_BYTES = 8 << 20, 1 << 20
#: Hash ranges of the suffix filter: of every set, and of those with more than LONG grams.
CELLS, FINE, LONG = 64, 1024, 2048
#: Members of a block of a posting list; sets, and grams about, of a block of a component.
LIST_BLOCK, SET_BLOCK, GRAM_BLOCK = 512, 512, 2_000_000
#: Lists up to this length are compared many at once.
SHORT = 16
#: Rows broadcast at most; larger lists are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Word hashes that a worker keeps for reuse, at most.
MEMO = 100_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


class _Words(dict):
    """Hashes of recent words, MEMO at most."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def grams(text: bytes | None, memo: dict, n: int = N) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k))
    with np.errstate(over="ignore"):
        for j in range(k):
            out = _mixed(out * _M1 + h[j : len(h) - k + 1 + j])
    return np.unique(out)


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text as bytes, and a hash of the text that tells rows of one id apart."""
    own = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return own.withColumn("mark", F.xxhash64("text"))


# -- the order of grams ----------------------------------------------------------------------------


def _levels(count: np.ndarray) -> np.ndarray:
    """Counts in one byte: exact to 128, then eight steps to each doubling."""
    high = 128 + np.floor(8 * np.log2(np.maximum(count, 128) / 128))
    return np.where(count <= 128, count, np.minimum(high, 255)).astype(np.uint8)


#: The smallest count of each level.
_COUNTS = np.where(np.arange(256) <= 128, np.arange(256), np.ceil(128 * 2 ** ((np.arange(256) - 128) / 8))).astype(np.int64)


def _cells(g: np.ndarray) -> np.ndarray:
    return g >> np.uint64(64 - CELL_BITS)


def _bounds(ranges: int) -> np.ndarray:
    """Where the ranges of cells begin, and the end."""
    return np.array([-(-(r << CELL_BITS) // ranges) for r in range(ranges + 1)], np.uint64)


def _told(batches, n: int, ranges: int):
    """Each chunk's distinct cells and in how many of its documents they are, range by range."""
    memo, z, held = _Words(), zstandard.ZstdCompressor(level=1), {}
    for b in batches:
        for chunk, block in zip(b.column("chunk").to_pylist(), b.column("block"), strict=True):
            held.setdefault(chunk, []).extend(_cells(grams(t, memo, n)) for t in unpacked([block.as_py()])[-1])
    for chunk in list(held):
        cells, count = np.unique(np.concatenate(held.pop(chunk)), return_counts=True)
        cut = np.searchsorted(cells, _bounds(ranges))
        at = [r for r in range(ranges) if cut[r] < cut[r + 1]]
        # differences of sorted cells, byte by byte: high bytes are nearly all zero
        data = [np.diff(cells[cut[r] : cut[r + 1]], prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for r in at]
        more = [_levels(count[cut[r] : cut[r + 1]]).tobytes() for r in at]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([chunk] * len(at), pa.int32()), pa.array([z.compress(d) for d in data], pa.binary()), pa.array([z.compress(c) for c in more], pa.binary())], ["range", "chunk", "cells", "counts"])
    released()


def _answered(batches):
    """For each block of cells the number of documents that hold them in all chunks, in levels."""
    z, u = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
    for t in whole_groups(batches, "range"):
        planes = [np.frombuffer(u.decompress(x.as_py()), np.uint8).reshape(8, -1) for x in t.column("cells")]
        cells = np.concatenate([np.cumsum(np.ascontiguousarray(p.T).view("<u8")[:, 0]) for p in planes])
        count = _COUNTS[np.concatenate([np.frombuffer(u.decompress(x.as_py()), np.uint8) for x in t.column("counts")])]
        _, inverse = np.unique(cells, return_inverse=True)
        level = _levels(np.bincount(inverse, count))[inverse]
        ends = np.cumsum([p.shape[1] for p in planes])
        levels = [z.compress(x.tobytes()) for x in np.split(level, ends[:-1])]
        yield pa.RecordBatch.from_arrays([t.column("range").combine_chunks(), t.column("chunk").combine_chunks(), pa.array(levels, pa.binary())], ["range", "chunk", "levels"])
    released()


def _ordered(left: pa.Table, right: pa.Table, n: int, percent: int) -> pa.Table:
    """The sets of a chunk's documents with their prefixes."""
    memo, u = _Words(), zstandard.ZstdDecompressor()
    ids, marks, texts = unpacked(left.column("block").to_pylist())
    answers = right.sort_by("range").column("levels")
    level = np.frombuffer(b"".join(u.decompress(x.as_py()) for x in answers), np.uint8)
    sets = [grams(t, memo, n) for t in texts]
    cells, inverse = np.unique(_cells(np.concatenate([np.zeros(0, np.uint64), *sets])), return_inverse=True)
    if len(cells) != len(level):
        raise ValueError("the answers are not those of this chunk: its input changed while it was read")
    weights = np.split(level[inverse], np.cumsum([len(s) for s in sets])[:-1])
    keys, firsts, places, cells, fine = [], [], [], [], []
    for s, weight in zip(sets, weights, strict=True):
        size = len(s)
        keys.append(xxhash.xxh3_128_digest(s.tobytes()) if size else None)
        # capped counts differ by no more than the true ones
        cells.append(np.minimum(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes())
        fine.append(np.minimum(np.bincount((s >> np.uint64(54)).astype(np.int64), minlength=FINE), 255).astype(np.uint8).tobytes() if size > LONG else None)
        p = size - -(-percent * size // 100) + 1 if size else 0
        order = np.argsort(weight, kind="stable")[:p]  # the set is sorted: ties go by hash
        place = np.flatnonzero(weight[order] > 1)
        firsts.append(s[order[place]].view(np.int64))
        places.append(place)
    chunk = left.column("chunk")[0].as_py()
    out = pa.table({
        "uid": pa.array(range(chunk << 40, (chunk << 40) + len(sets)), pa.int64()), "doc_id": pa.array(ids, pa.int64()), "mark": pa.array(marks, pa.int64()),
        "n": pa.array([len(s) for s in sets], pa.int64()), "key": pa.array(keys, pa.binary()), "prefix": pa.array(firsts, pa.list_(pa.int64())),
        "pos": pa.array(places, pa.list_(pa.int64())), "cells": pa.array(cells, pa.binary()), "fine": pa.array(fine, pa.binary()),
    })
    del sets, texts, weights, level, inverse
    released()
    return out


def prefixes(docs: DataFrame, n: int = N, percent: int = PERCENT, chunk_bytes: int | None = None) -> DataFrame:
    """uid, doc_id, mark, n (set size), key (the set's 128-bit hash), prefix grams that may be shared, their places in the order, cells, fine cells."""
    hashed = _hashed(docs)
    total = hashed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-total // (chunk_bytes or CHUNK_BYTES)))
    # equal rows of different input partitions go to different chunks
    dealt = hashed.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "mark", F.spark_partition_id()), F.lit(chunks)).cast("int"))
    dealt = dealt.select("chunk", "doc_id", "mark", "text").mapInArrow(lambda batches: packed(batches, BLOCK_BYTES), "chunk int, block binary").repartition(chunks, "chunk")
    told = dealt.mapInArrow(lambda batches: _told(batches, n, chunks), "range int, chunk int, cells binary, counts binary")
    answers = told.repartition(chunks, "range").sortWithinPartitions("range").mapInArrow(_answered, "range int, chunk int, levels binary")
    sets = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        lambda left, right: _ordered(left, right, n, percent), "uid long, doc_id long, mark long, n long, key binary, prefix array<long>, pos array<long>, cells binary, fine binary"
    )
    return written(sets, "sets")


def classes(sets: DataFrame) -> DataFrame:
    """One row per distinct set: key, uid of a member, its size, number of its documents, and of the row of the smallest doc_id: low, mark."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    per = sets.where("n > 0").groupBy("key").agg(F.min("uid").alias("uid"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"), first)
    return per.select("key", "uid", "n", "copies", F.col("first.doc_id").alias("low"), F.col("first.mark").alias("mark"))


# -- candidates ------------------------------------------------------------------------------------


def _dealt(rows: DataFrame, blocks: Column) -> DataFrame:
    """Each row once for every pair of blocks (i, j) that holds its own block; side: whether that is j."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("uid"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": F.col("own") > F.col("other")}).drop("own", "other")


def postings(sets: DataFrame, distinct: DataFrame) -> DataFrame:
    """gram, i, j, side, uid, n, pos, cells, fine of the classes' prefixes, for grams that two classes share."""
    own = sets.join(distinct.select("uid"), "uid", "left_semi")
    flat = own.select("uid", "n", F.explode(F.arrays_zip("prefix", "pos")).alias("p")).select("uid", "n", F.col("p.prefix").alias("gram"), F.col("p.pos").alias("pos"))
    shared = flat.groupBy("gram").agg(F.count(F.lit(1)).alias("g")).where("g > 1")
    dealt = _dealt(flat.join(shared, "gram"), F.ceil(F.col("g") / LIST_BLOCK)).drop("g")
    return dealt.join(sets.select("uid", "cells", "fine"), "uid")


def _near(a: np.ndarray, b: np.ndarray, n: np.ndarray, pos: np.ndarray, cells: np.ndarray, fine: list, percent: int) -> np.ndarray:
    """Which pairs of places (a, b) pass the length, positional and suffix filters."""
    na, nb = n[a], n[b]
    need = -(-percent * (na + nb) // (100 + percent))
    ok = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (np.minimum(na - pos[a], nb - pos[b]) >= need)
    for at in np.array_split(np.flatnonzero(ok), 1 + ok.sum() // 100_000):
        apart = np.abs(cells[a[at]] - cells[b[at]]).sum(1)
        ok[at] = (na[at] + nb[at] - apart) // 2 >= need[at]
    for p in np.flatnonzero(ok & (na > LONG) & (nb > LONG)):
        x, y = (np.frombuffer(fine[k], np.uint8).astype(np.int64) for k in (a[p], b[p]))
        ok[p] = (na[p] + nb[p] - np.abs(x - y).sum()) // 2 >= need[p]
    return ok


def spanning(a: np.ndarray, b: np.ndarray, m: int) -> np.ndarray:
    """The smallest place that each of ``m`` places reaches over the edges (a, b)."""
    label = np.arange(m)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = new[new]
        if (new == label).all():
            return label
        label = new[label]


def _candidates(batches, percent: int):
    """Edges (a, b) that span the pairs which pass the filters, list by list."""
    for t in whole_groups(batches, "gram", "i", "j"):
        uid, n, pos, i, j, gram = (t.column(c).to_numpy() for c in ("uid", "n", "pos", "i", "j", "gram"))
        side = t.column("side").to_numpy(zero_copy_only=False)
        cells = np.frombuffer(b"".join(t.column("cells").to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16)
        fine = t.column("fine").to_pylist()
        begin = np.concatenate([[0], np.flatnonzero((gram[1:] != gram[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1, [len(gram)]])
        size = np.diff(begin)
        ends = np.repeat(begin[1:], size)
        short = np.repeat((size <= SHORT) & (i[begin[:-1]] == j[begin[:-1]]), size)
        found = []
        for d in range(1, SHORT):
            a = np.flatnonzero(short & (np.arange(len(gram)) + d < ends))
            if not len(a):
                break
            ok = _near(a, a + d, n, pos, cells, fine, percent)
            found.append((a[ok], a[ok] + d))
        for s, e in zip(begin[:-1], begin[1:], strict=True):
            if e - s < 2 or short[s]:
                continue
            if i[s] == j[s]:
                a, b = np.triu_indices(e - s, 1)
            else:
                a, b = (x.ravel() for x in np.meshgrid(np.flatnonzero(~side[s:e]), np.flatnonzero(side[s:e]), indexing="ij"))
            ok = _near(a + s, b + s, n, pos, cells, fine, percent)
            root = spanning(a[ok], b[ok], e - s)
            far = np.flatnonzero(root != np.arange(e - s))
            found.append((root[far] + s, far + s))
        if found:
            a, b = (uid[np.concatenate(x)] for x in zip(*found, strict=True))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def candidates(sets: DataFrame, distinct: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, comp) of the classes that may link with another one: no link leaves a component."""
    lists = postings(sets, distinct).repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j")
    return components(lists.mapInArrow(lambda batches: _candidates(batches, percent), "a long, b long"))


# -- verification ----------------------------------------------------------------------------------


def overlaps(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """The sizes of all intersections, by products of incidence matrices over grams that two sets hold."""
    m, flat = len(sets), np.concatenate(sets)
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    keep = count[inverse] > 1
    col, row = number[inverse[keep]], np.repeat(np.arange(m), [len(s) for s in sets])[keep]
    by = np.argsort(col, kind="stable")
    col, row = col[by], row[by]
    out = np.zeros((m, m))
    for s in range(0, int((count > 1).sum()), width):
        i, j = np.searchsorted(col, [s, s + width])
        holds = np.zeros((m, width), np.float32)
        holds[row[i:j], col[i:j] - s] = 1
        out += holds @ holds.T
    return out.astype(np.int64)


def _verified(t: pa.Table, n: int, percent: int) -> pa.Table:
    """uid, near (documents of the sets it links with), root (a set that its links reach, the same for all that they reach)."""
    memo, uid, copies = _Words(), t.column("uid").to_numpy(), t.column("copies").to_numpy()
    sets = [grams(x.as_py(), memo, n) for x in t.column("text")]
    size, both = np.array([len(s) for s in sets]), overlaps(sets)
    linked = 100 * both >= percent * (size[:, None] + size - both)
    np.fill_diagonal(linked, False)
    if t.column("i")[0].as_py() != t.column("j")[0].as_py():
        side = t.column("side").to_numpy()
        linked &= side[:, None] != side
    root = spanning(*np.nonzero(linked), len(sets))
    return pa.table({"uid": uid, "near": linked @ copies, "root": uid[root], "whole": t.column("whole")})


def verified(docs: DataFrame, distinct: DataFrame, may: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(uid, near, root, whole) per block pair of each candidate component; whole: the component is one block."""
    per = may.join(distinct, may["id"] == distinct["uid"])
    size = per.groupBy("comp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / SET_BLOCK), F.ceil(F.sum("n") / GRAM_BLOCK)).alias("blocks"))
    need = written(per.join(size, "comp").select("comp", "blocks", "uid", "copies", "low", "mark"), "need")
    few = F.broadcast(need) if need.count() <= BROADCAST_ROWS else need
    d = _hashed(docs)
    texts = d.join(few, d["doc_id"].eqNullSafe(few["low"]) & (d["mark"] == few["mark"])).select("comp", "blocks", "uid", "copies", "text")
    dealt = _dealt(texts.dropDuplicates(["uid"]).withColumn("whole", F.col("blocks") == 1), F.col("blocks"))
    found = dealt.groupBy("comp", "i", "j").applyInArrow(lambda t: _verified(t, n, percent), "uid long, near long, root long, whole boolean")
    found = written(found, "links")
    forget(need)
    return found


class Join:
    """The join of ``docs`` with itself: sets (a row per document), classes, and what each class links with."""

    def __init__(self, docs: DataFrame, n: int = N, percent: int = PERCENT):
        self.sets = prefixes(docs, n, percent)
        self.distinct = written(classes(self.sets), "classes")
        may = candidates(self.sets, self.distinct, percent)
        found = verified(docs, self.distinct, may, n, percent)
        comp = found.where("whole").select(F.col("uid").alias("id"), F.col("root").alias("comp"))
        parts = found.where("not whole and uid <> root").select(F.col("uid").alias("a"), F.col("root").alias("b"))
        if not parts.isEmpty():
            comp = comp.union(components(parts))
        near = found.groupBy("uid").agg(F.sum("near").alias("near"))
        c = self.distinct.join(near, "uid", "left").join(comp, self.distinct["uid"] == comp["id"], "left").select(self.distinct["*"], "near", F.coalesce("comp", "uid").alias("comp"))
        self.linked = written(c, "linked")
        forget(may, found, self.distinct)

    def reached(self) -> DataFrame:
        """Per class: key, n_links (documents it links with, copies included), component (smallest doc_id in reach), and the mark of that id's row."""
        c = self.linked
        first = F.min(F.struct(F.col("low").isNull().alias("none"), "low", "mark", "key")).alias("first")
        some = c.where("near > 0")
        least = some.groupBy("comp").agg(first).select(F.col("comp").alias("of"), "first")
        found = c.join(least, (c["comp"] == least["of"]) & (c["near"] > 0), "left")
        return found.select(
            "key", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.when(F.col("first").isNull(), F.col("low")).otherwise(F.col("first.low")).alias("component"),
            F.when(F.col("first").isNull(), F.col("mark")).otherwise(F.col("first.mark")).alias("first_mark"),
            (F.col("first").isNull() | (F.col("first.key") == F.col("key"))).alias("leads"),
        )


def joined(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (documents linked with this one, its copies included)."""
    j = Join(docs, n, percent)
    per = j.reached().select("key", "component", "n_links")
    return j.sets.select("doc_id", "n", "key").join(per, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


def keep_first(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` per component: of its smallest doc_id; rows with the empty set all stay."""
    j = Join(docs, n, percent)
    keep = written(j.reached().where("leads").select(F.col("component").alias("kept_id"), F.col("first_mark").alias("kept_mark")), "kept")
    repeated = not j.sets.where("n > 0").groupBy("doc_id", "mark").count().where("count > 1").isEmpty()
    forget(j.linked, j.sets)
    names, at = docs.columns, {c: f"c{i}" for i, c in enumerate(docs.columns)}
    d = docs.toDF(*at.values())
    text = F.col(at["text"]).cast("binary")
    d = d.withColumns({"kept_id": F.col(at["doc_id"]).cast("long"), "kept_mark": F.xxhash64(text), "words": F.coalesce(F.col(at["text"]).rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))})
    full = d.where("words").alias("d").join(keep.alias("k"), F.col("d.kept_id").eqNullSafe(F.col("k.kept_id")) & (F.col("d.kept_mark") == F.col("k.kept_mark")), "left_semi")
    if repeated:
        full = full.dropDuplicates(["kept_id", "kept_mark"])
    return full.union(d.where("not words")).select(*at.values()).toDF(*names)
