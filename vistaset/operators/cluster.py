"""Clusters of objects by embedding: connected groups of similar vectors, and density clusters.

Similar pairs are found by cells around pivots. Vectors are lifted onto the unit sphere (unit vectors stay as
they are), where a dot product that reaches the threshold bounds the angle between two vectors. A vector lives
in the cell of its nearest pivot and visits those earlier cells that can hold a partner by the triangle
inequality: pivots whose angle exceeds that of its own by no more than twice the bound, and whose cell reaches
into the bound. Neighbouring cells are dealt to few blocks, and pairs of blocks meet: a vector is sent once to a
block of which it visits any cell, however many they are, and the cells are told apart within the meeting. So a
vector is copied as often as there are blocks at most. Groups are found by contraction: equal vectors become
one first, and a meeting sends the edges of a spanning forest, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import forget, written
from . import sets
from .graph import components

#: Vectors of a block at least and at most, blocks between those; pivots at most (they are broadcast; beyond, cells grow).
BLOCK, MOST, BLOCKS, PIVOTS = 2048, 1 << 16, 24, 4096
#: Vectors of one side of a product, and numbers of a step's angles: what a worker holds beside its block.
TILE, ANGLES = 2048, 1 << 22
#: Slack for single-precision products and for angles in radians: angles only rule cells out, products near the threshold are made again in double precision.
ROUNDING, SLACK = 2e-6, 1e-5
_VECTOR = "id long, vec array<float>, mark long"
#: The mark of an item without a cluster.
_NONE = -(1 << 63)


@dataclass(frozen=True)
class Cells:
    """Vectors in their cells and blocks (``housed``), and what says which of them meet."""

    housed: DataFrame
    threshold: float
    pivots: np.ndarray
    most: float
    bound: float
    count: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray
    spread: object = field(repr=False)

    @property
    def compared(self) -> int:
        """How many pairs are compared."""
        reach = self._reach()

        def visits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                total = sum((reach(x, h, r).sum(0) for _, x, h, r in _steps(f)), np.zeros(1, np.int64))
                yield pd.DataFrame({"cell": np.arange(len(total), dtype=np.int32), "n": total})

        guests = np.zeros(len(self.count), np.int64)
        for r in self.housed.mapInPandas(visits, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            guests[r["cell"]] = r["n"]
        return int((self.count * (self.count - 1) // 2 + self.count * guests).sum())

    def _reach(self):
        """A function of vectors, homes and distances that tells the earlier cells (from ``a`` to before ``b``) that they visit."""
        spread, radius, most, bound = self.spread, self.radius, self.most, self.bound

        def reach(x: np.ndarray, home: np.ndarray, far: np.ndarray, a: int = 0, b: int | None = None) -> np.ndarray:
            angle = _angles(_lifted(x, most), spread.value[a:b])
            near = (angle - far[:, None] <= 2 * bound) & (angle <= bound + radius[None, a:b])
            return near & (np.arange(a, a + angle.shape[1])[None] < home[:, None])

        return reach

    def meetings(self, housed: DataFrame | None = None) -> DataFrame:
        """Rows of the meetings (p, q), p <= q: the residents of block p, and the guests that come from q."""
        housed, reach, low, high = self.housed if housed is None else housed, self._reach(), self.low, self.high

        def goes(x, home, far, block) -> np.ndarray:
            """The earlier blocks that each vector visits; parts of one cell visit each other."""
            cells_ = reach(x, home, far)
            cells_[np.arange(len(x)), home] = True
            past = np.concatenate([np.zeros((len(x), 1), np.int32), np.cumsum(cells_, 1, dtype=np.int32)], 1)
            return (past[:, high + 1] > past[:, low]) & (np.arange(len(low))[None] < block[:, None])

        def met(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen = np.zeros((len(low), len(low)), bool)
            for f in frames:
                for i, x, h, r in _steps(f):
                    at, to = np.nonzero(goes(x, h, r, f.block.to_numpy()[i]))
                    seen[to, f.block.to_numpy()[i][at]] = True
            p, q = np.nonzero(seen)
            yield pd.DataFrame({"p": p.astype(np.int32), "q": q.astype(np.int32)})

        meet = np.zeros((len(low), len(low)), bool)
        for r in housed.mapInPandas(met, "p int, q int").distinct().toLocalIterator():  # a row per two blocks
            meet[r["p"], r["q"]] = True

        def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for i, x, h, r in _steps(f):
                    g, block = f.iloc[i], f.block.to_numpy()[i]
                    at, to = np.nonzero(goes(x, h, r, block))
                    own, other = np.nonzero(meet[block])
                    who = np.concatenate([np.arange(len(g)), own, at])
                    p, q = np.concatenate([block, block[own], to]), np.concatenate([block, other, block[at]])
                    guest = np.arange(len(who)) >= len(g) + len(own)
                    for k in range(0, len(who), 1 << 14):
                        w = slice(k, k + (1 << 14))
                        yield g.iloc[who[w]].drop(columns="block").assign(p=p[w].astype(np.int32), q=q[w].astype(np.int32), guest=guest[w])

        return housed.mapInPandas(deal, f"{_VECTOR}, home int, far double, p int, q int, guest boolean")

    def each(self, make, schema: str, housed: DataFrame | None = None) -> DataFrame:
        """What ``make`` yields, as tuples of arrays, of the similar pairs of each meeting.

        ``make`` gets an iterator of (a, b, i, j, sim): ids, and marks, of the sides of a tile, and its pairs' places, each pair of rows once.
        """
        reach, threshold, most = self._reach(), self.threshold, self.most

        def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = pa.schema([(n, {"long": pa.int64(), "float": pa.float32()}[k]) for n, k in (c.split() for c in schema.split(", "))])
            t = pa.Table.from_batches(list(batches))
            for cols in make(_tiles(t, reach, threshold, most)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

        return self.meetings(housed).groupBy("p", "q").applyInArrow(meeting, schema)


def _matrix(vec: pa.ChunkedArray | pa.Array) -> np.ndarray:
    a = vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec
    flat = a.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    return flat.reshape(len(a), -1) if len(a) else np.zeros((0, 1), np.float32)


def _steps(f: pd.DataFrame) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a frame, few enough for angles with all pivots: places, vectors, homes, distances."""
    n = max(1, ANGLES // PIVOTS)
    for k in range(0, len(f), n):
        g = f.iloc[k : k + n]
        yield slice(k, k + n), np.stack(g.vec.to_list()), g.home.to_numpy(), g.far.to_numpy()


def _lifted(x, most: float) -> np.ndarray:
    """Points of the unit sphere: their dot products are at least those of the vectors over ``most``, the greatest squared length."""
    x = np.asarray(x, np.float64)
    rest = np.sqrt(np.maximum(most - (x * x).sum(1), 0))
    return np.column_stack([x, rest]) / np.sqrt(most)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def _chain(pivots: np.ndarray) -> np.ndarray:
    """An order in which each pivot is followed by the nearest that is left: neighbours get into one block."""
    left, order, at = np.ones(len(pivots), bool), [], 0
    for _ in range(len(pivots)):
        order.append(at)
        left[at] = False
        at = int(np.where(left, pivots @ pivots[at], -np.inf).argmax())
    return np.array(order)


def _blocks(count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of cells in blocks (their first and last cell), and of each cell its first block and how many it has to itself."""
    low, high, first, parts, held = [], [], [], [], most + 1
    for c, n in enumerate(count.tolist()):
        own = max(1, -(-n // most))
        if own > 1 or held + n > most:
            first.append(len(low))
            low += [c] * own
            high += [c] * own
            held = n if own == 1 else most + 1
        else:
            first.append(len(low) - 1)
            high[-1] = c
            held += n
        parts.append(own)
    return np.array(low), np.array(high), np.array(first), np.array(parts)


def cells(items: DataFrame, threshold: float) -> Cells:
    """The meetings of items (id, vec) that cover every pair whose dot product reaches the threshold."""
    v = items.where("vec is not null").select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec"))
    square = F.aggregate("vec", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    n, most = v.agg(F.count(F.lit(1)), F.max(square)).first()
    most = max(most or 0.0, 1e-30)
    bound = float(np.arccos(np.clip(threshold / most - ROUNDING, -1, 1))) + SLACK
    # as many pivots as vectors of a mean cell: assigning and comparing cost about the same
    chosen = v.select("vec", F.xxhash64("id").alias("h")).orderBy("h", "vec").limit(min(PIVOTS, int(np.sqrt(n)) + 1)).select("vec").toPandas()
    pivots = _lifted(np.stack(chosen.vec.to_list()), most) if len(chosen) else np.zeros((1, 1))
    pivots = pivots[_chain(pivots)]
    spread = items.sparkSession.sparkContext.broadcast(pivots)

    def home(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = max(1, ANGLES // PIVOTS)
        for f in frames:
            for k in range(0, len(f), n):
                g = f.iloc[k : k + n]
                a = _angles(_lifted(np.stack(g.vec.to_list()), most), spread.value)
                yield g.assign(mark=np.int64(0), home=a.argmin(1).astype(np.int32), far=a.min(1))

    housed = written(v.mapInPandas(home, f"{_VECTOR}, home int, far double"), "cells")
    count, radius = np.zeros(len(pivots), np.int64), np.full(len(pivots), -np.inf)
    for r in housed.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("r")).collect():  # a row per pivot
        count[r["home"]], radius[r["home"]] = r["n"], r["r"]
    low, high, first, parts = _blocks(count, max(BLOCK, min(MOST, -(-n // BLOCKS))))

    def block(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            # a multiplied id: its high bits deal rows evenly whatever the ids are
            mixed = (f.id.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            h = f.home.to_numpy()
            yield f.assign(block=(first[h] + (mixed % parts[h].astype(np.uint64)).astype(np.int64)).astype(np.int32))

    # as many tasks as blocks at least: a file of a few thousand vectors is work for many
    dealt = housed.repartition(max(len(low), 1), "id").mapInPandas(block, f"{_VECTOR}, home int, far double, block int")
    return Cells(written(dealt, "blocks"), threshold, pivots, most, bound, count, radius, low, high, spread)


def _tiles(t: pa.Table, reach, threshold: float, most: float) -> Iterator[tuple]:
    """Of a meeting: (ids and marks of the left, of the right, places i, j, sim) of similar pairs, a tile at a time."""
    x, guest = _matrix(t["vec"]), t["guest"].to_numpy()
    ids, mark, home, far = (t[n].to_numpy() for n in ("id", "mark", "home", "far"))
    inner = t["p"][0].as_py() == t["q"][0].as_py()
    here = np.flatnonzero(~guest)
    there = here if inner else np.flatnonzero(guest)
    if not len(here) or not len(there):
        return
    here = here[np.argsort(home[here], kind="stable")]
    a, b = int(home[here[0]]), int(home[here[-1]]) + 1
    edge = np.searchsorted(home[here], np.arange(a, b + 1))
    step, near = max(1, ANGLES // (b - a)), max(x.shape[1], 32) * 6e-8 * most

    def tile(left: np.ndarray, right: np.ndarray, same: bool):
        s = x[left] @ x[right].T
        i, j = np.nonzero(s >= np.float32(threshold - near))
        sim = s[i, j]
        close = np.flatnonzero(np.abs(sim - np.float32(threshold)) <= 2 * near)
        for k in range(0, len(close), 1 << 16):
            c = close[k : k + (1 << 16)]
            exact = np.einsum("ij,ij->i", x[left[i[c]]].astype(np.float64), x[right[j[c]]].astype(np.float64))
            sim[c] = np.where(exact >= threshold, np.maximum(exact, threshold), -np.inf)
        p, q = ids[left[i]], ids[right[j]]
        keep = (p < q if same else p != q) & (sim > -np.inf)
        if keep.any():
            return (ids[left], mark[left]), (ids[right], mark[right]), i[keep], j[keep], sim[keep]

    for k in range(0, len(there), step):
        g = there[k : k + step]
        visit = reach(x[g], home[g], far[g], a, b)
        for c in range(a, b):
            mine = here[edge[c - a] : edge[c - a + 1]]
            # a cell of several blocks: its parts meet as guests
            come = g[visit[:, c - a] | (home[g] == c)] if not inner else g[visit[:, c - a]]
            for u in range(0, len(mine), TILE):
                for w in range(0, len(come), TILE):
                    if (got := tile(come[w : w + TILE], mine[u : u + TILE], False)) is not None:
                        yield got
    if inner:
        for c in range(a, b):
            mine = here[edge[c - a] : edge[c - a + 1]]
            for u in range(0, len(mine), TILE):
                for w in range(u, len(mine), TILE):
                    if (got := tile(mine[u : u + TILE], mine[w : w + TILE], u == w)) is not None:
                        yield got


def similar(items: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim), a < b, of all items (id, vec) whose dot product reaches the threshold. Null vectors have no partners."""

    def pairs(tiles):
        for (p, _), (q, _), i, j, s in tiles:
            yield np.minimum(p[i], q[j]), np.maximum(p[i], q[j]), s

    return cells(items, threshold).each(pairs, "a long, b long, sim float")


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of edges that connect what all edges connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, top = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    kept, open_ = [], np.arange(len(a))
    while len(open_):
        # every root takes its first open edge to a smaller root, then chains are followed to their ends
        u, v = top[x[open_]], top[y[open_]]
        open_, u, v = open_[u != v], u[u != v], v[u != v]
        high, first = np.unique(np.maximum(u, v), return_index=True)
        top[high] = np.minimum(u, v)[first]
        kept.append(open_[first])
        while (top[top] != top).any():
            top = top[top]
    return np.concatenate(kept) if kept else np.empty(0, np.int64)


def _spanning(tiles) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of a meeting's pairs, thinned as they come."""
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for (p, _), (q, _), i, j, _ in tiles:
        at = forest(p[i], q[j])
        a, b = np.concatenate([a, p[i[at]]]), np.concatenate([b, q[j[at]]])
        if len(a) > 1 << 18:
            at = forest(a, b)
            a, b = a[at], b[at]
    at = forest(a, b)
    yield np.minimum(a[at], b[at]), np.maximum(a[at], b[at])


def linked(items: DataFrame, threshold: float) -> DataFrame:
    """(a, b): edges that connect the items which chains of similar pairs connect, at most one per member of a meeting."""
    return cells(items, threshold).each(_spanning, "a long, b long")


def groups(items: DataFrame, threshold: float) -> DataFrame:
    """(id, comp): items connected by similar pairs; comp is the smallest id. Lone items are their own.

    Items of equal vectors that reach the threshold with themselves count as one; the rest are compared.
    """
    v = items.select("id", F.col("vec").cast("array<float>").alias("vec"))
    square = F.aggregate("vec", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    # a margin for single precision: vectors near the threshold stay apart until they are compared
    same = F.when(square >= threshold + 1e-4 * abs(threshold) + 1e-6, F.lit(None)).otherwise(F.col("id"))
    one = v.groupBy("vec", same.alias("_own")).agg(F.min("id").alias("rep")).where("vec is not null")
    reps = written(one.select(F.col("rep").alias("id"), "vec", "_own"), "representatives")
    comp = components(linked(reps.select("id", "vec"), threshold))
    comp = reps.join(comp, "id", "left").select(F.col("vec").alias("_v"), F.col("_own").alias("_o"), F.coalesce("comp", "id").alias("comp"))
    named = v.withColumn("_own", same).join(comp, (F.col("vec") == F.col("_v")) & F.col("_own").eqNullSafe(F.col("_o")), "left")
    return named.select("id", F.coalesce("comp", "id").alias("comp"))


def density(items: DataFrame, threshold: float, least: int) -> DataFrame:
    """(id, comp): density clusters; core items have ``least`` - 1 similar others. Noise has a null comp.

    An item that is not core joins the cluster, among those of its core neighbours, with the smallest id.
    """
    c = cells(items, threshold)

    def partners(tiles):
        """How many similar others each item has in the meeting."""
        for (p, _), (q, _), i, j, _ in tiles:
            for ids, at in ((p, i), (q, j)):
                n = np.bincount(at, minlength=len(ids))
                yield ids[n > 0], n[n > 0]

    def nearest(tiles):
        """Of items that are not core (marked as of none): the least cluster of their core neighbours."""
        for (p, one), (q, two), i, j, _ in tiles:
            for ids, mine, at, other in ((p, one, i, two[j]), (q, two, j, one[i])):
                way = np.flatnonzero((mine[at] == _NONE) & (other != _NONE))
                if len(way):
                    least = np.full(len(ids), np.iinfo(np.int64).max)
                    np.minimum.at(least, at[way], other[way])
                    found = np.unique(at[way])
                    yield ids[found], least[found]

    # pairs are never written: they are counted, thinned to forests and looked up meeting by meeting
    degree = c.each(partners, "a long, d long").groupBy("a").agg(F.sum("d").alias("d"))
    all_ = items.select("id").join(degree, F.col("id") == F.col("a"), "left").select("id", F.coalesce("d", F.lit(0)).alias("d"))
    core = written(all_.where(F.col("d") >= max(1, least) - 1).select("id"), "core")
    comp = components(c.each(_spanning, "a long, b long", c.housed.join(core, "id", "left_semi")))
    cores = written(core.join(comp, "id", "left").select("id", F.coalesce("comp", "id").alias("comp")), "clusters")
    marked = c.housed.join(cores, "id", "left").withColumn("mark", F.coalesce("comp", F.lit(_NONE))).select(*c.housed.columns)
    border = c.each(nearest, "id long, comp long", marked).groupBy("id").agg(F.min("comp").alias("comp"))
    return items.select("id").join(cores.union(border), "id", "left")


def numbered(members: DataFrame, cluster: str, parent: str = "") -> DataFrame:
    """Adds ``cluster_id``: clusters are numbered by their first member in order of (path, obj_id)."""
    first = members.groupBy("comp").agg(F.min(F.struct("path", "obj_id")).alias("first"))
    # one row per cluster is numbered, not one per object
    ranked = sets.numbered(first.select("comp", "first.path", "first.obj_id"), F.asc("path"), F.asc("obj_id"), out="n")
    text = F.concat(F.lit(f"{cluster}_{parent or 'item'}_"), F.when(F.length(F.col("n").cast("string")) < 3, F.lpad(F.col("n").cast("string"), 3, "0")).otherwise(F.col("n").cast("string")))
    return members.join(ranked.select("comp", text.alias("cluster_id")), "comp").drop("comp")


def embedded(images: DataFrame, embedding: str) -> DataFrame:
    """(path, obj_id, vec): objects that have an embedding."""
    items = images.select("path", F.explode("objects").alias("o")).select("path", F.col("o.obj_id").alias("obj_id"), F.try_element_at("o.embeddings", F.lit(embedding)).alias("vec"))
    return items.where("vec is not null")


def cluster_images(images: DataFrame, embedding: str, cluster: str, threshold: float, parent: str = "", items: DataFrame | None = None) -> DataFrame:
    """The images with cluster_ids of their objects and cluster_groups of their attributes renewed. ``items``: what ``embedded`` gives, where it is stored."""
    items = written(embedded(images, embedding), "items") if items is None else items
    items = items.withColumn("id", F.col("obj_id"))
    named = numbered(items.drop("vec").join(groups(items.select("id", "vec"), threshold), "id"), cluster, parent)
    per = named.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("obj_id", "cluster_id"))).alias("_ids"))
    rows = images.join(per, "path", "left")
    other = lambda m: F.map_filter(m, lambda k, v: k != cluster)

    def renew(o):
        mine = F.try_element_at("_ids", o["obj_id"])
        kept = F.when(mine.isNull(), o["cluster_ids"]).otherwise(F.map_concat(other(o["cluster_ids"]), F.create_map(F.lit(cluster), mine)))
        return o.withField("cluster_ids", kept)

    groups_ = F.coalesce(F.array_sort(F.array_distinct(F.map_values("_ids"))), F.array().cast("array<string>"))
    attrs = F.col("img_attrs").withField("cluster_groups", F.map_concat(other(F.col("img_attrs.cluster_groups")), F.create_map(F.lit(cluster), groups_)))
    return rows.withColumn("objects", F.transform("objects", renew)).withColumn("img_attrs", attrs).drop("_ids")


def cluster_members(images: DataFrame, cluster: str, cluster_id: str) -> DataFrame:
    """Images that hold an object of a cluster."""
    has = F.array_contains(F.coalesce(F.try_element_at("img_attrs.cluster_groups", F.lit(cluster)), F.array().cast("array<string>")), cluster_id)
    return images.where(has).select("path", F.lit(1.0).cast("float").alias("score"))


def cluster_counts(images: DataFrame, cluster: str) -> DataFrame:
    """Images per cluster, most first, ties by id."""
    ids = images.select("path", F.explode(F.array_distinct(F.try_element_at("img_attrs.cluster_groups", F.lit(cluster)))).alias("cluster_id"))
    return ids.groupBy("cluster_id").agg(F.countDistinct("path").alias("images")).orderBy(F.desc("images"), "cluster_id")


def display_names(ids: DataFrame, names: DataFrame, cluster: str) -> DataFrame:
    """cluster_id and its display name: as mapped, else without the cluster's prefix, else without its first part."""
    own = F.when(F.col("cluster_id").startswith(f"{cluster}_"), F.substring("cluster_id", len(cluster) + 2, 1 << 20)).otherwise(F.regexp_replace("cluster_id", "^[^_]*_", ""))
    return ids.join(names, "cluster_id", "left").select("cluster_id", F.coalesce("display", own).alias("display"))
