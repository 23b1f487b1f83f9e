"""Operator 11: vectors compressed to four codebook indexes each, by Lloyd rounds with kd-tree filtering.

Rows are used as they lie: every task cuts the vectors of its partition into blocks, and builds a kd-tree
over each of the four parts of a block once, with the sums and counts of its nodes; the trees are written.
In a round a task walks its trees with the codebook. At a node, an entry goes when the node's bounding box
holds no point to which it is nearest, ties to lower indexes; where one entry is left, the whole subtree is
its, by the cached sum and count, and only leaves that several entries reach compare points. Tasks send one
sum per entry and component, so what meets is bounded by the codebook and not by the rows.

Integers are exact: comparisons run in double precision where all products fit into its 53 bits, else in
64-bit integers.

Defined cases: rows whose vector is null, or holds null or non-finite components, go; an empty vector stays
(code 00000000, error 0). Vectors of different lengths share no codebook: each length has its own, and a
length that four does not divide is cut at floor(i * length / 4). Components are cut off at +-2^k, the
greatest power with which no squared distance passes 64 bits (k = 27 for 64 components). Rows of equal id
all count; among them the smaller vector comes first into the codebook, and null ids come last. Rows
without a label form one group. Fewer rows than entries give a smaller codebook, no rows give no rows.
Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import first_of, forget, own_columns, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of a block, points of a leaf.
BLOCK, LEAF = 8192, 24
#: Rows of label sums that are broadcast at most.
LABELS = 1 << 16


@dataclass
class Tree:
    """A kd-tree over integer points: nodes by level, a node's points are points[start:end]."""

    points: np.ndarray  # in the order of the leaves
    order: np.ndarray  # their places in the block
    lo: np.ndarray
    hi: np.ndarray
    sums: np.ndarray
    start: np.ndarray
    end: np.ndarray
    child: np.ndarray  # the first of two children, -1: a leaf


def limit(length: int) -> int:
    """Where components are cut off: 4 * length * limit^2 fits into 62 bits."""
    return 1 << ((60 - max(length - 1, 0).bit_length()) // 2)


def cuts(length: int) -> list[int]:
    return [i * length // PARTS for i in range(PARTS + 1)]


def scaled(flat: np.ndarray, rows: int, length: int) -> np.ndarray:
    """Rows of integers floor(1024 x), cut off at the limit."""
    most = float(limit(length))
    return np.clip(np.floor(SCALE * flat.astype(np.float64)), -most, most).astype(np.int64).reshape(rows, length)


def tree(points: np.ndarray) -> Tree:
    """Nodes are split at the median of their widest side until a leaf's number of points is left."""
    n = len(points)
    order, spans, child, at = np.arange(n), [(0, n)], [], 0
    lo, hi, sums = [], [], []
    while at < len(spans):
        s, e = spans[at]
        p = points[order[s:e]]
        lo.append(p.min(0))
        hi.append(p.max(0))
        sums.append(p.sum(0))
        side = hi[-1] - lo[-1]
        if e - s > LEAF and side.size and side.max() > 0:
            half = (e - s) // 2
            order[s:e] = order[s:e][np.argpartition(p[:, side.argmax()], half)]
            child.append(len(spans))
            spans += [(s, s + half), (s + half, e)]
        else:
            child.append(-1)
        at += 1
    start, end = np.array(spans).T
    return Tree(points[order], order, np.array(lo), np.array(hi), np.array(sums), start, end, np.array(child))


def filtered(t: Tree, book: np.ndarray, entries: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) of the points nearest to each entry of the codebook; ``entries`` gets each point's entry."""
    k, d = book.shape
    most = max(np.abs(t.lo).max(initial=0), np.abs(t.hi).max(initial=0), np.abs(book).max(initial=0))
    kind, far = (np.float64, np.inf) if 8 * int(most) ** 2 * max(d, 1) < 1 << 53 else (np.int64, np.iinfo(np.int64).max)
    c = book.astype(kind)
    square, index = (c * c).sum(1), np.arange(k)
    sums, counts = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
    nodes, left = np.array([0]), np.ones((1, k), bool)

    def take(starts, ends, to):
        if entries is not None:
            for s, e, x in zip(starts, ends, to, strict=True):
                entries[t.order[s:e]] = x

    while len(nodes):
        lo, hi = t.lo[nodes].astype(kind), t.hi[nodes].astype(kind)
        # the entry nearest to the middle of the box; distances to it decide which others can win
        best = np.where(left, square - (lo + hi) @ c.T, far).argmin(1)
        for b in np.unique(best):
            at = np.flatnonzero(best == b)
            u = c - c[b]
            gap = (square - square[b])[:, None] - 2 * (np.maximum(u, 0) @ hi[at].T + np.minimum(u, 0) @ lo[at].T)
            left[at] &= ((gap < 0) | ((gap == 0) & (index <= b)[:, None])).T
        alone = left.sum(1) == 1
        whole = nodes[alone]
        np.add.at(sums, best[alone], t.sums[whole])
        np.add.at(counts, best[alone], (t.end - t.start)[whole])
        take(t.start[whole], t.end[whole], best[alone])
        leaf = ~alone & (t.child[nodes] < 0)
        if leaf.any():
            size = (t.end - t.start)[nodes[leaf]]
            at = np.repeat(t.start[nodes[leaf]] - np.cumsum(size) + size, size) + np.arange(size.sum())
            some = left[leaf].any(0)
            p, q = t.points[at], c[some]
            near = np.where(np.repeat(left[leaf][:, some], size, 0), square[some] - 2 * (p.astype(kind) @ q.T), far)
            to = index[some][near.argmin(1)]
            np.add.at(sums, to, p)
            counts += np.bincount(to, minlength=k)
            if entries is not None:
                entries[t.order[at]] = to
        inner = ~alone & (t.child[nodes] >= 0)
        first = t.child[nodes[inner]]
        nodes, left = np.stack([first, first + 1], 1).ravel(), np.repeat(left[inner], 2, 0)
    return sums, counts


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v, length) of the rows that take part."""
    r = own_columns(rows, "vec_id", "embedding", "label").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return r.where("v is not null").where(fine).withColumn("length", F.size("v"))


def blocks(rows: DataFrame) -> DataFrame:
    """(length, trees, ids, labels): blocks of vectors, each with its four trees."""
    schema = f"length int, trees binary, ids array<{rows.schema['vec_id'].dataType.simpleString()}>, labels array<{rows.schema['label'].dataType.simpleString()}>"

    def build(batches):
        z, held = zstandard.ZstdCompressor(level=1), {}

        def out(length):
            ids, labels, rows_ = zip(*held.pop(length), strict=True)
            x = np.concatenate(rows_)
            small = np.int16 if np.abs(x).max(initial=0) < 1 << 15 else np.int64
            made = []
            for a, b in zip(cuts(length), cuts(length)[1:], strict=False):
                t = tree(x[:, a:b])
                t.points, t.lo, t.hi, t.order = t.points.astype(small), t.lo.astype(small), t.hi.astype(small), t.order.astype(np.int32)
                made.append(t)
            lists = [pa.ListArray.from_arrays([0, len(x)], pa.concat_arrays(a)) for a in (ids, labels)]
            data = pa.array([z.compress(pickle.dumps(made, protocol=5))], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([length], pa.int32()), data, *lists], ["length", "trees", "ids", "labels"])

        for b in batches:
            lengths = b["length"].to_numpy()
            for length in map(int, np.unique(lengths)):
                part = b.take(pa.array(np.flatnonzero(lengths == length)))
                x = scaled(part["v"].flatten().to_numpy(zero_copy_only=False), part.num_rows, length)
                for i in range(0, len(x), BLOCK):
                    held.setdefault(length, []).append((part["vec_id"][i : i + BLOCK], part["label"][i : i + BLOCK], x[i : i + BLOCK]))
                    if sum(len(h[2]) for h in held[length]) >= BLOCK:
                        yield out(length)
            # partitions of very many lengths keep no more rows than this
            if sum(len(h[2]) for hs in held.values() for h in hs) > 4 * BLOCK:
                yield from [out(length) for length in list(held)]
        yield from [out(length) for length in list(held)]

    return rows.select("length", "vec_id", "label", "v").mapInArrow(build, schema)


def first_books(rows: DataFrame) -> dict[int, list[np.ndarray]]:
    """Codebooks by length: the parts of the vectors of the smallest ids."""
    books: dict[int, list] = {}
    top = first_of(rows.select("length", "vec_id", "v"), ["length"], [F.asc_nulls_last("vec_id"), F.asc("v")], ENTRIES)
    for r in top.collect():  # 256 vectors for each length
        books.setdefault(r["length"], []).append((r["vec_id"] is None, r["vec_id"], r["v"]))
    out = {}
    for length, found in books.items():
        found.sort(key=lambda f: (f[0], 0 if f[0] else f[1], f[2]))
        x = scaled(np.array([f[2] for f in found]), len(found), length)
        out[length] = [x[:, a:b] for a, b in zip(cuts(length), cuts(length)[1:], strict=False)]
    return out


def _trees(data: bytes) -> list[Tree]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def renewed(trees: DataFrame, books: dict[int, list[np.ndarray]]) -> dict[int, list[np.ndarray]]:
    """The codebooks after one round: entries become the floors of their means, unused ones stay."""

    def totals(batches):
        total: dict[int, list] = {}
        for b in batches:
            for length, data in zip(b["length"].to_pylist(), b["trees"].to_pylist(), strict=True):
                mine = total.setdefault(length, [np.zeros((len(c), c.shape[1] + 1), np.int64) for c in books[length]])
                for t, c, sum_ in zip(_trees(data), books[length], mine, strict=True):
                    s, n = filtered(t, c)
                    sum_ += np.column_stack([s, n])
        for length, mine in total.items():
            for part, x in enumerate(mine):
                entry, at = np.nonzero(x)
                cols = [np.full(len(at), length, np.int32), np.full(len(at), part, np.int32), entry.astype(np.int32), at.astype(np.int32), x[entry, at]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["length", "part", "entry", "at", "v"])

    sums = trees.select("length", "trees").mapInArrow(totals, "length int, part int, entry int, at int, v long")
    out = {length: [c.copy() for c in b] for length, b in books.items()}
    got: dict[tuple, dict] = {}
    for r in sums.groupBy("length", "part", "entry", "at").agg(F.sum("v").alias("v")).collect():  # at most one row per entry and component
        got.setdefault((r["length"], r["part"], r["entry"]), {})[r["at"]] = r["v"]
    for (length, part, entry), x in got.items():
        c = out[length][part]
        c[entry] = [x.get(j, 0) // x[c.shape[1]] for j in range(c.shape[1])]
    return out


def digest(book: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for c in book for x in c.ravel().tolist()).encode()).hexdigest()


def encoded(trees: DataFrame, books: dict[int, list[np.ndarray]]) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of every vector."""
    kind = {f.name: f.dataType.elementType.simpleString() for f in trees.schema if f.name in ("ids", "labels")}
    signs = {length: digest(b) for length, b in books.items()}

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                length, ids, labels = b["length"][i].as_py(), b["ids"][i].values, b["labels"][i].values
                codes, error = np.empty((len(ids), PARTS), np.uint8), np.zeros(len(ids), np.int64)
                for k, (t, c) in enumerate(zip(_trees(b["trees"][i].as_py()), books[length], strict=True)):
                    to = np.empty(len(ids), np.int64)
                    filtered(t, c, to)
                    codes[:, k] = to
                    error[t.order] += ((t.points.astype(np.int64) - c[to[t.order]]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([bytes(x).hex() for x in codes]), pa.array(error), pa.array([signs[length]] * len(ids))], ["vec_id", "label", "code", "error", "codebooks_sha256"])

    return trees.mapInArrow(run, f"vec_id {kind['ids']}, label {kind['labels']}, code string, error long, codebooks_sha256 string")


def compress(rows: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """Codes of all vectors (written), and the final codebooks by length."""
    use = usable(rows)
    books = first_books(use)
    trees = written(blocks(use), "trees")
    for _ in range(rounds):
        books = renewed(trees, books)
    out = written(encoded(trees, books), "codes")
    forget(trees)
    return out, books


def with_label_error(codes: DataFrame) -> DataFrame:
    """Errors summed over equal labels, nulls together; a sum beyond 64 bits is the greatest long."""
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = codes.groupBy("label").agg(F.least(total, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias("label_error"))
    sums = sums.withColumnRenamed("label", "_l")
    few = sums.limit(LABELS + 1).count() <= LABELS
    # beyond the bound Spark's sorted join splits the rows of a frequent label
    right = F.broadcast(sums) if few else sums.hint("merge")
    return codes.join(right, F.col("label").eqNullSafe(F.col("_l"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_label_error(compress(table(spark, sf_dir, "embeddings"))[0])


def _sql() -> str:
    """Four rounds and the last assignment, unrolled."""
    dot = "list_dot_product(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"
    out = [f"""v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
    f"p AS (SELECT vec_id, label, k, e[k * len(e) // {PARTS} + 1:(k + 1) * len(e) // {PARTS}] AS p FROM v, range({PARTS}) r(k))",
    f"c0 AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS j, p AS c FROM p QUALIFY j < {ENTRIES})"]
    for i in range(ROUNDS + 1):
        d = f"{dot.format('p', 'p')} - 2 * {dot.format('p', 'c')} + {dot.format('c', 'c')}"
        out.append(f"a{i} AS MATERIALIZED (SELECT vec_id, label, k, p, min({{'d': {d}, 'j': j}}) AS m FROM p JOIN c{i} USING (k) GROUP BY vec_id, label, k, p)")
        if i < ROUNDS:
            out.append(f"""s{i} AS (SELECT k, j, list(CAST(floor(x / n) AS BIGINT) ORDER BY i) AS c FROM
    (SELECT k, m.j AS j, i, CAST(sum(p[i]) AS DOUBLE) AS x, count(*) AS n FROM a{i}, range(1, len(p) + 1) r(i) GROUP BY ALL) GROUP BY k, j)""")
            out.append(f"c{i + 1} AS MATERIALIZED (SELECT k, j, coalesce(s{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN s{i} USING (k, j))")
    return f"""WITH {", ".join(out)},
  h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, j)) AS codebooks_sha256 FROM c{ROUNDS}),
  r AS (SELECT vec_id, label, string_agg(printf('%02x', m.j), '' ORDER BY k) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id, label)
  SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, h"""


SQL = _sql()
