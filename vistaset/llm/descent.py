"""Approximate nearest neighbours: an NN-descent graph and greedy search on it.

Equal vectors collapse into one node first; a node carries its MEMBERS smallest ids, all that a result
of TOP ids can need. The graph starts from leaves of seeded random projections and is refined by
local joins: every node meets its neighbours and a hashed sample of those that point at it, with their
vectors, and each of them learns of the others that are nearer than its worst neighbour. Joins are by
node; rows carry vectors as one byte per component with a scale of their own; the graph is written to
the shared folder after each round.

Queries start from their own node's neighbours. Each step sends a query to its nearest unvisited nodes;
a node holds its neighbours' vectors, so it answers with those nearer than the query's worst. At the
end the pool is scored on the original vectors in double precision.

Defined results: vectors that are null, all zero, of another length than most, or hold null or
non-finite components take no part; rows of equal id and vector are one row; an id with several vectors
asks with each of them, gets ranks for each, and is a candidate with each; rows of the query's own id are
no candidates; ties go to the smaller id; with fewer candidates all are returned. Extra columns are not read.
"""

from __future__ import annotations

import gc
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import own_columns, table, written

TOP, MEMBERS = 20, 21
#: Neighbours kept, reverse neighbours drawn about, nearest told to each member of a local join, rounds.
KEPT, DRAWN, TOLD, ROUNDS = 32, 32, 10, 5
#: Starting leaves: trees, nodes of a leaf about. Search: pool size, nodes visited per step, steps.
TREES, LEAF = 2, 128
POOL, BEAM, STEPS = 300, 64, 5
SEED = 11


def _packed(x: np.ndarray) -> list[bytes]:
    """One byte per component after a 4-byte scale."""
    scale = np.maximum(np.abs(x).max(1), 1e-30).astype(np.float32) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return [s.tobytes() + v.tobytes() for s, v in zip(scale, q, strict=True)]


def _matrix(col: pa.Array) -> np.ndarray:
    raw = np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), -1)
    return raw[:, 4:].view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view(np.float32)


def _keyed(batches, key: str):
    """Whole groups of a partition sorted by ``key``: tables in which no group is cut."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1], "left"))
        if held and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _bounds(k: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])


def _best(ids: np.ndarray, sims: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` nearest distinct ids, ties to the smaller id."""
    u, at = np.unique(ids, return_index=True)
    s = sims[at]
    o = np.lexsort((u, -s))[:n]
    return u[o], s[o]


def nodes(vectors: DataFrame) -> DataFrame:
    """node (smallest id, see below), members (smallest ids), vec (float32 bytes) of each distinct usable vector."""
    v = own_columns(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("x"))
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    v = v.where("id is not null and x is not null and size(x) > 0").where(~bad & F.exists("x", lambda e: e != 0))
    usual = v.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    v = v.where(F.size("x") == (usual["n"] if usual else 0))

    def raw(batches):
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([r.tobytes() for r in x + np.float32(0)], pa.binary())], ["id", "vec"])

    v = v.mapInArrow(raw, "id long, vec binary").distinct()
    # members of one vector in hashed parts first, so that a hot vector is not gathered whole
    least = lambda c: F.slice(F.sort_array(c), 1, MEMBERS)
    part = v.groupBy("vec", F.pmod(F.xxhash64("id"), F.lit(64)).alias("p")).agg(least(F.collect_set("id")).alias("m"))
    found = part.groupBy("vec").agg(least(F.flatten(F.collect_list("m"))).alias("members"))
    # an id with several vectors leads one node under its own number, others under a hash
    first = found.withColumn("id", F.element_at("members", 1)).withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("vec")))
    return first.select(F.when(F.col("k") == 1, F.col("id")).otherwise(F.xxhash64("id", "vec")).alias("node"), "members", "vec")


def _start(v: DataFrame, n: int) -> DataFrame:
    """(x, ids, sims): near ones within leaves of seeded random projections."""
    depth = max(0, math.ceil(math.log2(max(1, n) / LEAF)))

    def leaves(batches):
        for b in batches:
            x, parts = _matrix(b.column("vec")), []
            for t in range(TREES):
                r = np.random.default_rng([SEED, t])
                bits = (x @ r.normal(size=(x.shape[1], depth)) > 0) if depth else np.zeros((len(x), 0), bool)
                leaf = (bits * (1 << np.arange(depth, dtype=np.int64))).sum(1) * TREES + t
                # crowded cells split further by a hash of the node, into runs of about a leaf
                parts.append(pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int64)), b.column("node"), b.column("vec")], ["leaf", "x", "vec"]))
            yield from parts

    def near(batches):
        for t in _keyed(batches, "leaf"):
            k, ids, vec = t.column("leaf").to_numpy(), t.column("x").to_numpy(), t.column("vec")
            out = []
            b = _bounds(k)
            for i, j in zip(b[:-1], b[1:], strict=True):
                for s in range(i, j, 2 * LEAF):
                    e = min(j, s + 2 * LEAF)
                    m = _matrix(vec.slice(s, e - s))
                    sim = m @ m.T
                    np.fill_diagonal(sim, -np.inf)
                    p = np.argsort(-sim, 1)[:, : min(KEPT, e - s - 1)]
                    for a in range(e - s):
                        out.append((ids[s + a], ids[s + p[a]].tobytes(), sim[a, p[a]].astype(np.float32).tobytes()))
            yield _told(out)

    flat = v.select("node", "vec").mapInArrow(leaves, "leaf long, x long, vec binary")
    return flat.repartition("leaf").sortWithinPartitions("leaf", F.xxhash64("x")).mapInArrow(near, "x long, ids binary, sims binary")


def _told(out: list) -> pa.RecordBatch:
    x, i, s = zip(*out) if out else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(i, pa.binary()), pa.array(s, pa.binary())], ["x", "ids", "sims"])


def _merged(parts: DataFrame, keep: int) -> DataFrame:
    """One row per x with the ``keep`` nearest of all its rows."""

    def done(batches):
        for t in _keyed(batches, "x"):
            k, out = t.column("x").to_numpy(), []
            ids, sims = t.column("ids").to_pylist(), t.column("sims").to_pylist()
            b = _bounds(k)
            for i, j in zip(b[:-1], b[1:], strict=True):
                u, s = _best(np.frombuffer(b"".join(ids[i:j]), np.int64), np.frombuffer(b"".join(sims[i:j]), np.float32), keep)
                out.append((k[i], u.tobytes(), s.tobytes()))
            yield _told(out)

    return parts.repartition("x").sortWithinPartitions("x").mapInArrow(done, "x long, ids binary, sims binary")


def _edges(graph: DataFrame, turn: int) -> DataFrame:
    """(m, x): x is m itself, a neighbour of m, or one of about DRAWN hashed nodes that point at m."""

    def pairs(batches):
        for b in batches:
            i = b.column("ids").to_pylist()
            n = np.array([len(v) // 8 for v in i])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("x").to_numpy(), n)), pa.array(np.frombuffer(b"".join(i), np.int64))], ["m", "x"])

    f = graph.select("x", "ids").mapInArrow(pairs, "m long, x long")
    degree = f.groupBy("x").agg(F.count(F.lit(1)).alias("d"))
    lot = F.pmod(F.xxhash64("m", "x", F.lit(turn)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    back = f.join(degree, "x").where(lot * F.col("d") < DRAWN).select(F.col("x").alias("m"), F.col("m").alias("x"))
    return f.union(back).union(graph.select(F.col("x").alias("m"), "x")).distinct()


def _met(edges: DataFrame, v: DataFrame, graph: DataFrame) -> DataFrame:
    """(m, x, vec, worst) sorted by m within partitions."""

    def worst(batches):
        for b in batches:
            w = [np.frombuffer(s[-4:], np.float32)[0] if len(s) >= 4 * KEPT else -np.inf for s in b.column("sims").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("x"), pa.array(w, pa.float32())], ["x", "worst"])

    known = v.select(F.col("node").alias("x"), "vec").join(graph.select("x", "sims").mapInArrow(worst, "x long, worst float"), "x", "left")
    return edges.join(known, "x").select("m", "x", "vec", F.coalesce("worst", F.lit(float("-inf"))).alias("worst")).repartition("m").sortWithinPartitions("m")


def _round(met: DataFrame) -> DataFrame:
    def local(batches):
        for t in _keyed(batches, "m"):
            k, ids, w = t.column("m").to_numpy(), t.column("x").to_numpy(), t.column("worst").to_numpy()
            x, out = _matrix(t.column("vec")), []
            b = _bounds(k)
            for i, j in zip(b[:-1], b[1:], strict=True):
                if j - i < 2:
                    continue
                own = ids[i:j]
                sim = x[i:j] @ x[i:j].T
                np.fill_diagonal(sim, -np.inf)
                n = min(TOLD, j - i - 1)
                p = np.argpartition(-sim, n - 1, 1)[:, :n]
                s = np.take_along_axis(sim, p, 1)
                good = s > w[i:j, None]
                for a in np.flatnonzero(good.any(1)):
                    g = good[a]
                    out.append((own[a], own[p[a][g]].tobytes(), s[a][g].astype(np.float32).tobytes()))
            yield _told(out)

    return met.mapInArrow(local, "x long, ids binary, sims binary")


def _swept(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished rounds."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def build(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The coded vectors (node, vec) and the graph (x, ids, sims) over ``nodes``."""
    spark = found.sparkSession

    def coded(batches):
        for b in batches:
            raw = b.column("vec").to_pylist()
            x = np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1) if raw else np.zeros((0, 1), np.float32)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(_packed(x), pa.binary())], ["node", "vec"])

    v = written(found.select("node", "vec").mapInArrow(coded, "node long, vec binary"), "coded")
    graph = written(_merged(_start(v, v.count()), KEPT), "graph")
    for turn in range(ROUNDS):
        told = _round(_met(_edges(graph, turn), v, graph))
        graph = written(_merged(graph.union(told), KEPT), "graph")
        _swept(spark)
    return v, graph


def search(queries: DataFrame, found: DataFrame, v: DataFrame, graph: DataFrame) -> DataFrame:
    """(q, ids, sims): the pool of each query node (column ``q``) after greedy search."""
    spark = found.sparkSession

    def held(batches):
        for t in _keyed(batches, "m"):
            k, ids, vec, out = t.column("m").to_numpy(), t.column("x").to_numpy(), t.column("vec").to_pylist(), []
            b = _bounds(k)
            for i, j in zip(b[:-1], b[1:], strict=True):
                out.append((k[i], ids[i:j].tobytes(), b"".join(vec[i:j])))
            m, i, x = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(i, pa.binary()), pa.array(x, pa.binary())], ["m", "near", "vecs"])

    local = written(_met(_edges(graph, ROUNDS), v, graph).select("m", "x", "vec").mapInArrow(held, "m long, near binary, vecs binary"), "local")
    own = v.join(queries, v["node"] == queries["q"]).select("q", "vec")
    pool = own.join(graph, own["q"] == graph["x"], "left").select("q", "vec", F.coalesce("ids", F.lit(b"")).alias("ids"), F.coalesce("sims", F.lit(b"")).alias("sims"), F.lit(b"").alias("seen"))
    pool = written(pool, "pool")
    for _ in range(STEPS):

        def ask(batches):
            for b in batches:
                out = []
                for q, x, i, s, d in zip(*(b.column(c).to_pylist() for c in ("q", "vec", "ids", "sims", "seen")), strict=True):
                    ids, done = np.frombuffer(i, np.int64), np.frombuffer(d, np.int64)
                    worst = float(np.frombuffer(s[-4:], np.float32)[0]) if len(ids) >= POOL else -math.inf
                    out += [(int(m), q, x, worst) for m in ids[~np.isin(ids, done)][:BEAM]]
                m, q, x, w = zip(*out) if out else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(q, pa.int64()), pa.array(x, pa.binary()), pa.array(w, pa.float32())], ["m", "q", "x", "worst"])

        def answer(batches):
            for b in batches:
                out = []
                x = _matrix(b.column("x")) if b.num_rows else []
                for k, (q, w, i, vs) in enumerate(zip(*(b.column(c).to_pylist() for c in ("q", "worst", "near", "vecs")), strict=True)):
                    ids = np.frombuffer(i, np.int64)
                    raw = np.frombuffer(vs, np.uint8).reshape(len(ids), -1)
                    s = (raw[:, 4:].view(np.int8).astype(np.float32) @ x[k]) * np.ascontiguousarray(raw[:, :4]).view(np.float32)[:, 0]
                    g = (s > w) & (ids != q)
                    if g.any():
                        out.append((q, ids[g].tobytes(), s[g].tobytes()))
                yield _told(out)

        asked = pool.mapInArrow(ask, "m long, q long, x binary, worst float")
        told = asked.join(local, "m").select("q", "x", "worst", "near", "vecs").mapInArrow(answer, "x long, ids binary, sims binary")
        best = _merged(pool.select(F.col("q").alias("x"), "ids", "sims").union(told), POOL).withColumnsRenamed({"ids": "new_ids", "sims": "new_sims"})

        def mark(batches):
            for b in batches:
                seen = []
                for i, d in zip(b.column("ids").to_pylist(), b.column("seen").to_pylist(), strict=True):
                    ids, done = np.frombuffer(i, np.int64), np.frombuffer(d, np.int64)
                    seen.append(d + ids[~np.isin(ids, done)][:BEAM].tobytes())
                yield pa.RecordBatch.from_arrays([b.column("q"), b.column("vec"), pa.array(seen, pa.binary())], ["q", "vec", "seen"])

        marked = pool.mapInArrow(mark, "q long, vec binary, seen binary")
        pool = written(marked.join(best, marked["q"] == best["x"]).select("q", "vec", F.col("new_ids").alias("ids"), F.col("new_sims").alias("sims"), "seen"), "pool")
        _swept(spark)
    return pool.select("q", "ids", "sims")


def nearest(vectors: DataFrame, every: int = 20, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    found = written(nodes(vectors), "nodes")
    v, graph = build(found)
    # a query is any row: members beyond the smallest share the node's pool
    wide = own_columns(vectors, "vec_id", "embedding").where(F.col("vec_id") % every == 0).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<float>").alias("x"))

    def raw(batches):
        for b in batches:
            out = [np.array(r, np.float32) + np.float32(0) if r is not None and None not in r else np.zeros(0, np.float32) for r in b.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("query_id"), pa.array([r.tobytes() for r in out], pa.binary())], ["query_id", "vec"])

    # unusable vectors meet no node
    who = wide.mapInArrow(raw, "query_id long, vec binary").distinct().join(found.select("node", "vec"), "vec").select("query_id", F.col("node").alias("q"))
    who = written(who, "queries")
    pools = search(who.select("q").distinct(), found, v, graph)

    def flat(batches):
        for b in batches:
            i = b.column("ids").to_pylist()
            n = np.array([len(x) // 8 for x in i], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("q").to_numpy(), n)), pa.array(np.frombuffer(b"".join(i), np.int64))], ["q", "node"])

    pairs = pools.mapInArrow(flat, "q long, node long").union(who.select("q", F.col("q").alias("node")).distinct())
    full = pairs.join(found.select("node", "members", "vec"), "node").join(found.select(F.col("node").alias("q"), F.col("vec").alias("qvec")), "q")

    def exact(batches):
        for b in batches:
            n = b.num_rows
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.float32).reshape(n, -1).astype(np.float64) if n else np.zeros((0, 1)) for c in ("vec", "qvec"))
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("members"), pa.array((x * y).sum(1))], ["q", "members", "score"])

    scored = full.select("q", "members", "vec", "qvec").mapInArrow(exact, "q long, members array<long>, score double")
    # per query node the nearest ids serve all its rows: as many more than ``top`` as an id that asks has vectors
    mine = who.groupBy("query_id").agg(F.count(F.lit(1)).alias("own"))
    more = who.join(mine, "query_id").groupBy("q").agg(F.max("own").cast("int").alias("own"))
    flat_ids = scored.select("q", "score", F.explode("members").alias("vec_id"))
    near = flat_ids.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("near"))
    near = near.join(more, "q").select("q", F.slice("near", F.lit(1), F.col("own") + top).alias("near"))
    out = who.join(near, "q").select("query_id", F.posexplode(F.slice(F.filter("near", lambda z: z["vec_id"] != F.col("query_id")), 1, top)).alias("pos", "z"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("z.vec_id").alias("vec_id"), (-F.col("z.s")).alias("score"))


def op4_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
