"""Nearest-neighbour joins of located points.

``knn`` gives edges ``target_id, source_id, rank, dist``; ties go to the
smaller source id.  In a self join each point is its own first neighbour
(rank 0, distance 0) and counts in k.

Two physical ways give the same edges.  Sources whose coordinates fit
``BROADCAST_BYTES`` go to every task, where targets are searched cell by cell.
Above that, sources and targets meet in the boxes of a k-d tree that a sample
of the points shapes; targets whose k-th neighbour may lie in other boxes are
sent on to just those.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BROADCAST_BYTES = 64 << 20
EDGE = "target_id bigint, source_id bigint, rank int, dist double"
#: Mean radius of the earth in metres, a fixed value.
EARTH = 6371008.8


class CellIndex:
    """Points sorted by grid cell of their first two coordinates."""

    def __init__(self, ids: np.ndarray, xy: np.ndarray, k: int):
        n = len(ids)
        self.dims = min(2, xy.shape[1])
        low, high = xy[:, : self.dims].min(0), xy[:, : self.dims].max(0)
        cells = max(1, int(np.sqrt(max(1.0, n / max(4.0, k / 2)))))
        self.low, self.side = low, max(float((high - low).max()) / cells, 1e-300)
        grid = self.cell(xy)
        self.shape = grid.max(0) + 1
        key = self.flat(grid)
        order = np.lexsort((ids, key))
        self.ids, self.xy, key = ids[order], xy[order], key[order]
        self.heads = np.searchsorted(key, np.arange(int(np.prod(self.shape)) + 1))

    def cell(self, xy: np.ndarray) -> np.ndarray:
        return np.floor((xy[:, : self.dims] - self.low) / self.side).astype(np.int64)

    def flat(self, grid: np.ndarray) -> np.ndarray:
        return grid[:, 0] if self.dims == 1 else grid[:, 0] * self.shape[1] + grid[:, 1]

    def near(self, cell: np.ndarray, ring: int) -> np.ndarray:
        """Rows of the points in cells at most ``ring`` away."""
        lo, hi = np.maximum(cell - ring, 0), np.minimum(cell + ring, self.shape - 1)
        if (lo > hi).any():
            return np.empty(0, np.int64)
        if self.dims == 1:
            return np.arange(self.heads[lo[0]], self.heads[hi[0] + 1])
        runs = [np.arange(self.heads[x * self.shape[1] + lo[1]], self.heads[x * self.shape[1] + hi[1] + 1]) for x in range(lo[0], hi[0] + 1)]
        return np.concatenate(runs)

    def search(self, xy: np.ndarray, k: int, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of the k nearest of each point; ``own`` ids come first."""
        rows, dist = np.empty((len(xy), k), np.int64), np.empty((len(xy), k))
        grid = self.nearest_cell(xy)
        _, which = np.unique(grid, axis=0, return_inverse=True)
        which = which.reshape(-1)
        order = np.argsort(which, kind="stable")
        for members in np.split(order, np.flatnonzero(np.diff(which[order])) + 1):
            ring, todo = 1, members
            while len(todo):
                found = self.near(grid[todo[0]], ring)
                everything = len(found) == len(self.ids)
                if len(found) >= k:
                    d = np.sqrt(sum((xy[todo, c][:, None] - self.xy[found, c][None, :]) ** 2 for c in range(xy.shape[1])))
                    first = np.where(self.ids[found][None, :] == own[todo][:, None], -1.0, d) if own is not None else d
                    if len(found) > 4 * k:
                        edge = np.partition(first, k - 1, axis=1)[:, k - 1]
                        keep = np.flatnonzero((first <= edge[:, None]).any(0))
                        found, d, first = found[keep], d[:, keep], first[:, keep]
                    order_ = np.lexsort((np.broadcast_to(self.ids[found], d.shape), first), axis=1)[:, :k]
                    got = np.take_along_axis(d, order_, 1)
                    # nothing nearer than the ring's border can be missing
                    sure = self.border(xy[todo], grid[todo[0]], ring)
                    done = (got[:, -1] < sure) | everything
                    rows[todo[done]], dist[todo[done]] = found[order_[done]], got[done]
                    todo = todo[~done]
                ring = ring * 2
        return rows, dist

    def nearest_cell(self, xy: np.ndarray) -> np.ndarray:
        """The cell of a point, or the nearest one of a point beside the grid."""
        with np.errstate(over="ignore"):
            at = np.floor((xy[:, : self.dims] - self.low) / self.side)
        return np.clip(at, 0, self.shape - 1).astype(np.int64)

    def border(self, xy: np.ndarray, cell: np.ndarray, ring: int) -> np.ndarray:
        """How near a point outside the ring can be; beyond the grid's own ends there is none."""
        x = xy[:, : self.dims]
        lo = np.where(cell - ring <= 0, -np.inf, self.low + (cell - ring) * self.side)
        hi = np.where(cell + ring >= self.shape - 1, np.inf, self.low + (cell + ring + 1) * self.side)
        return np.minimum((x - lo).min(1), (hi - x).min(1)) * (1 - 1e-9)


def _coords(df: DataFrame, key: str, coords: list[str]) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(coords)])


def check_coords(points: DataFrame, key: str, coords: list[str]) -> int:
    """The number of rows; null, NaN or infinite coordinates are an error."""
    bad = F.lit(False)
    for c in coords:
        v = F.col(c).cast("double")
        bad = bad | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    n, wrong = points.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(bad | F.col(key).isNull(), 1).otherwise(0)), F.lit(0))).first()
    if wrong:
        raise ValueError(f"{wrong} rows have no id or coordinates that aren't finite")
    return n


def knn(points: DataFrame, k: int, coords: list[str], key: str = "id", targets: DataFrame | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """k nearest points of each point, or of each row of ``targets``."""
    n = check_coords(points, key, coords)
    if targets is not None:
        check_coords(targets, key, coords)
    if not 1 <= k <= max(n, 1):
        raise ValueError(f"k must be from 1 to {n}")
    src = _coords(points, key, coords)
    tgt = src if targets is None else _coords(targets, key, coords)
    if n * 8 * (len(coords) + 1) <= broadcast_bytes:
        return _knn_broadcast(src, tgt, k, targets is None, len(coords))
    return _knn_boxes(src, tgt, k, n, targets is None, len(coords))


def _knn_broadcast(src: DataFrame, tgt: DataFrame, k: int, self_join: bool, dims: int) -> DataFrame:
    got = src.toArrow()
    ids = np.asarray(got.column(0))
    index = CellIndex(ids, np.stack([np.asarray(got.column(i + 1)) for i in range(dims)], axis=1), k) if len(ids) else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                b = whole.slice(lo, 4096)
                own = np.asarray(b.column(0))
                xy = np.stack([np.asarray(b.column(i + 1)) for i in range(dims)], axis=1)
                rows, dist = index.search(xy, k, own if self_join else None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(own, k)), pa.array(index.ids[rows].reshape(-1)), pa.array(np.tile(np.arange(k, dtype=np.int32), len(own))), pa.array(dist.reshape(-1))],
                    names=["target_id", "source_id", "rank", "dist"],
                )

    # a small scan is one task; spread the search
    width = tgt.sparkSession.sparkContext.defaultParallelism
    return tgt.repartition(width).mapInArrow(run, EDGE)


@dataclass(frozen=True)
class Boxes:
    """A k-d tree of boxes that hold about equally many points; leaves are numbered from 0."""

    axis: np.ndarray
    value: np.ndarray
    child: np.ndarray
    leaf: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def split(cls, sample: np.ndarray, most: int) -> Boxes:
        """Halve the sample along its widest side until a box has at most so many of its points."""
        dims = sample.shape[1]
        axis, value, child, leaf, low, high = [], [], [], [], [], []

        def grow(own: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> int:
            k = len(axis)
            for column, v in ((axis, -1), (value, 0.0), (child, [-1, -1]), (leaf, -1), (low, lo), (high, hi)):
                column.append(v)
            wide = np.ptp(own, axis=0) if len(own) else np.zeros(dims)
            d = int(wide.argmax())
            if len(own) > most and wide[d] > 0:
                at = np.sort(own[:, d])
                cut = at[len(at) // 2]
                cut = cut if cut > at[0] else at[np.searchsorted(at, at[0], "right")]
                axis[k], value[k] = d, float(cut)
                below, above = hi.copy(), lo.copy()
                below[d] = above[d] = cut
                child[k] = [grow(own[own[:, d] < cut], lo, below), grow(own[own[:, d] >= cut], above, hi)]
            return k

        grow(sample, np.full(dims, -np.inf), np.full(dims, np.inf))
        ends = [k for k, a in enumerate(axis) if a < 0]
        for n, k in enumerate(ends):
            leaf[k] = n
        return cls(np.array(axis), np.array(value), np.array(child), np.array(leaf), np.array(low), np.array(high))

    def home(self, xy: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        at = np.zeros(len(xy), int)
        open_ = np.flatnonzero(self.axis[at] >= 0)
        while len(open_):
            d = self.axis[at[open_]]
            at[open_] = self.child[at[open_], (xy[open_, d] >= self.value[at[open_]]).astype(int)]
            open_ = open_[self.axis[at[open_]] >= 0]
        return self.leaf[at]

    def touched(self, xy: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) for every leaf no farther from a point than its reach."""
        point, node, out = np.arange(len(xy)), np.zeros(len(xy), int), []
        while len(point):
            gap = np.maximum(np.maximum(self.low[node] - xy[point], xy[point] - self.high[node]), 0)
            near = np.sqrt((gap * gap).sum(1)) <= reach[point] * (1 + 1e-12)
            point, node = point[near], node[near]
            ends = self.axis[node] < 0
            out.append((point[ends], self.leaf[node[ends]]))
            point, node = point[~ends], node[~ends]
            point, node = np.repeat(point, 2), self.child[node].reshape(-1)
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


#: Points that shape the boxes, and points of a box: enough for a task, few enough for its memory.
SHAPE_POINTS, BOX_POINTS = 65_536, 50_000


def _boxes(src: DataFrame, n: int, dims: int, points: int) -> Boxes:
    """Boxes of about so many of the n points, shaped by a sample."""
    rate = min(1.0, SHAPE_POINTS / max(n, 1))
    shape = src.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < max(1, int(rate * (1 << 20)))).select(*[f"c{i}" for i in range(dims)]).toArrow()
    sample = np.stack([np.asarray(shape.column(i)) for i in range(dims)], axis=1) if shape.num_rows else np.zeros((1, dims))
    return Boxes.split(sample, max(4, int(points * len(sample) / max(n, 1))))


def _knn_boxes(src: DataFrame, tgt: DataFrame, k: int, n: int, self_join: bool, dims: int) -> DataFrame:
    """Search by boxes of a k-d tree: each target in its own box, then in those its k-th distance reaches.

    Boxes follow the points, so crowded places have small ones.  Of equal
    locations only the ``k + 1`` least ids can be anyone's neighbour, and only
    those are searched: no box fills up with copies.
    """
    spark, xy = src.sparkSession, [f"c{i}" for i in range(dims)]
    width = spark.sparkContext.defaultParallelism
    tree = _boxes(src, n, dims, min(BOX_POINTS, max(8 * k, n // (4 * width))))
    place = Window.partitionBy(*xy).orderBy("id")
    few = src.withColumn("_r", F.row_number().over(place)).filter(F.col("_r") <= k + 1).drop("_r")
    names = ["box", "target", "id", *xy]
    kind = "box int, target boolean, id bigint, " + ", ".join(f"{c} double" for c in xy)

    def deal(target: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = tree.home(np.stack([np.asarray(b.column(i + 1)) for i in range(dims)], axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.full(b.num_rows, target)), *b.columns], names=names)

        return run

    def search(first: bool):
        """Up to k neighbours of each target of a box; in the first turn also the other boxes within reach."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            box, held, index = None, [], None
            for whole in batches:
                boxes, asks = np.asarray(whole.column(0)), np.asarray(whole.column(1))
                turn = np.flatnonzero((np.diff(boxes) != 0) | (asks[1:] != asks[:-1])) + 1
                for lo, hi in zip([0, *turn.tolist()], [*turn.tolist(), whole.num_rows]):
                    if lo == hi:
                        continue
                    part = whole.slice(lo, hi - lo)
                    if boxes[lo] != box:
                        box, held, index = boxes[lo], [], None
                    ids, at = np.asarray(part.column(2)), np.stack([np.asarray(part.column(3 + i)) for i in range(dims)], axis=1)
                    if not asks[lo]:
                        held.append((ids, at))
                        index = None
                        continue
                    if index is None and held:
                        index = CellIndex(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), k)
                    for s in range(0, len(ids), 4096):
                        yield one(index, ids[s : s + 4096], at[s : s + 4096], int(box))

        def one(index: CellIndex | None, ids: np.ndarray, at: np.ndarray, box: int) -> pa.RecordBatch:
            have = min(k, len(index.ids)) if index is not None else 0
            if have:
                rows, dist = index.search(at, have, None)
                found = index.ids[rows]
            else:
                found, dist = np.empty((len(ids), 0), np.int64), np.empty((len(ids), 0))
            cells = [pa.array(ids, pa.int64()), pa.array(list(found), pa.list_(pa.int64())), pa.array(list(dist), pa.list_(pa.float64()))]
            if first:
                reach = dist[:, -1] if have == k else np.full(len(ids), np.inf)
                point, other = tree.touched(at, reach)
                keep = other != box
                point, other = point[keep], other[keep]
                order = np.argsort(point, kind="stable")
                heads = np.concatenate(([0], np.cumsum(np.bincount(point, minlength=len(ids)))))
                cells += [pa.ListArray.from_arrays(pa.array(heads, pa.int32()), pa.array(other[order], pa.int32())), *[pa.array(at[:, i]) for i in range(dims)]]
            return pa.RecordBatch.from_arrays(cells, names=["id", "found", "dist", *(["others", *xy] if first else [])])

        return run

    def met(sources: DataFrame, targets: DataFrame) -> DataFrame:
        return sources.unionByName(targets).repartition("box").sortWithinPartitions("box", "target")

    dealt = few.select("id", *xy).mapInArrow(deal(False), kind)
    homes = tgt.select("id", *xy).mapInArrow(deal(True), kind)
    own = met(dealt, homes).mapInArrow(search(True), "id bigint, found array<bigint>, dist array<double>, others array<int>, " + ", ".join(f"{c} double" for c in xy)).persist()
    away = own.select(F.explode("others").alias("box"), F.lit(True).alias("target"), "id", *xy)
    more = met(dealt, away).mapInArrow(search(False), "id bigint, found array<bigint>, dist array<double>")
    near = own.select("id", "found", "dist").unionByName(more)
    pairs = F.arrays_zip(F.col("dist").alias("dist"), F.col("found").alias("source_id"))
    every = near.groupBy("id").agg(F.flatten(F.collect_list(pairs)).alias("_all"))
    if self_join:
        others = F.filter("_all", lambda p: p["source_id"] != F.col("id"))
        mine = F.array(F.struct(F.lit(0.0).alias("dist"), F.col("id").alias("source_id")))
        best = F.concat(mine, F.slice(F.array_sort(others), 1, k - 1)) if k > 1 else mine
    else:
        best = F.slice(F.array_sort("_all"), 1, k)
    out = every.select(F.col("id").alias("target_id"), F.posexplode(best).alias("rank", "_p"))
    return out.select("target_id", F.col("_p.source_id").alias("source_id"), F.col("rank").cast("int").alias("rank"), F.col("_p.dist").alias("dist"))


def prefix(edges: DataFrame, k: int) -> DataFrame:
    """The first k neighbours of stored edges, instead of a new search."""
    return edges.filter(F.col("rank") < k)


def radius_join(points: DataFrame, radius: float, coords: list[str], key: str = "id") -> DataFrame:
    """All pairs nearer than ``radius``: an equi-join on cells of that size, then the distance."""
    src = _coords(points, key, coords)
    dims = len(coords)
    cells = [F.floor(F.col(f"c{i}") / radius) for i in range(dims)]
    s = src.select(F.col("id").alias("source_id"), *[F.col(f"c{i}").alias(f"s{i}") for i in range(dims)], *[c.alias(f"g{i}") for i, c in enumerate(cells)])
    t = src.select(F.col("id").alias("target_id"), *[f"c{i}" for i in range(dims)], *[c.alias(f"t{i}") for i, c in enumerate(cells)])
    for i in range(dims):
        t = t.withColumn(f"g{i}", F.explode(F.sequence(F.col(f"t{i}") - 1, F.col(f"t{i}") + 1)))
    square = (F.col("c0") - F.col("s0")) ** 2
    for i in range(1, dims):
        square = square + (F.col(f"c{i}") - F.col(f"s{i}")) ** 2
    met = t.join(s, [f"g{i}" for i in range(dims)]).withColumn("dist", F.sqrt(square)).filter(F.col("dist") < radius)
    order = Window.partitionBy("target_id").orderBy(F.when(F.col("source_id") == F.col("target_id"), -1.0).otherwise(F.col("dist")), "source_id")
    return met.select("target_id", "source_id", (F.row_number().over(order) - 1).cast("int").alias("rank"), "dist")


class Halves:
    """A k-d tree of points halved to a few a leaf; node k has the children 2k + 1 and 2k + 2."""

    def __init__(self, xy: np.ndarray, leaf: int = 16):
        m, dims = xy.shape
        self.depth = max(0, int(np.floor(np.log2(max(1.0, m / leaf)))))
        order, low, high, start, end = np.arange(m), [], [], [], []
        for level in range(self.depth + 1):
            heads = (np.arange(1 << level) * m) >> level
            own = xy[order]
            lo, hi = np.minimum.reduceat(own, heads), np.maximum.reduceat(own, heads)
            ends = np.append(heads[1:], m)
            for column, v in ((low, lo), (high, hi), (start, heads), (end, ends)):
                column.append(v)
            if level < self.depth:
                node = np.repeat(np.arange(1 << level), ends - heads)
                wide = (hi - lo).argmax(1)
                order = order[np.lexsort((own[np.arange(m), wide[node]], node))]
        self.low, self.high, self.xy = (list(np.ascontiguousarray(a.T)) for a in (np.concatenate(low), np.concatenate(high), xy[order]))
        self.start, self.end = np.concatenate(start), np.concatenate(end)
        self.leaves = (1 << self.depth) - 1
        self.largest = int((self.end - self.start)[self.leaves :].max())

    def within(self, at: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """How many points are nearer than ``radius`` to each place, and the furthest of them (-1 for none)."""
        x = list(np.ascontiguousarray(at.T))
        n, best, floor = np.zeros(len(at), np.int64), np.full(len(at), -1.0), np.full(len(at), -1.0)
        inner, outer, whole = radius * radius * (1 - 1e-12), radius * radius * (1 + 1e-12), []
        place, node = np.arange(len(at)), np.zeros(len(at), int)
        while len(place):
            near, far, side = self.gaps(x, place, node)
            inside = far < inner
            p, k = place[inside], node[inside]
            n += np.bincount(p, self.end[k] - self.start[k], len(at)).astype(np.int64)
            np.maximum.at(floor, p, side[inside])
            whole.append((p, k, far[inside]))
            rest = ~inside & (near <= outer)
            place, node = self.down(x, place[rest], node[rest], radius, n, best)
        # nodes that lie wholly within are opened only if they may hold a furthest point
        place, node, far = (np.concatenate([w[c] for w in whole]) for c in range(3))
        while len(place):
            bound = np.maximum(floor, np.maximum(best, 0) ** 2)[place]
            open_ = far >= bound * (1 - 1e-12)
            place, node = self.down(x, place[open_], node[open_], radius, None, best)
            if len(place):
                _, far, side = self.gaps(x, place, node)
                np.maximum.at(floor, place, side)
        return n, best

    def gaps(self, x: list[np.ndarray], place: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Squares of the least and greatest distances to a node's box, and of a distance that its furthest point has at least."""
        near = far = side = 0.0
        for c, v in enumerate(x):
            below, above = v[place] - self.low[c][node], self.high[c][node] - v[place]
            gap = np.maximum(np.maximum(-below, -above), 0)
            reach = np.maximum(below, above)
            near, far, side = near + gap * gap, far + reach * reach, np.maximum(side, reach * reach)
        return near, far, side

    def down(self, x: list[np.ndarray], place: np.ndarray, node: np.ndarray, radius: float, n: np.ndarray | None, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children; the points of leaves are looked at one by one, counted in ``n`` if given and kept in ``best``."""
        ends = node >= self.leaves
        p, k = place[ends], node[ends]
        if len(p):
            most, hits = np.full(len(p), -1.0), np.zeros(len(p), np.int64)
            own, first, last = [v[p] for v in x], self.start[k], self.end[k]
            for j in range(self.largest):
                row = np.minimum(first + j, last - 1)
                square = 0.0
                for c, v in enumerate(own):
                    square = square + (v - self.xy[c][row]) ** 2
                dist = np.sqrt(square)
                hit = (dist < radius) & (first + j < last)
                hits += hit
                most = np.maximum(most, np.where(hit, dist, -1.0))
            if n is not None:
                n += np.bincount(p, hits, len(n)).astype(np.int64)
            np.maximum.at(best, p, most)
        place, node = place[~ends], node[~ends]
        return np.repeat(place, 2), (2 * node[:, None] + np.array([1, 2])).reshape(-1)


def radius_summary(points: DataFrame, radius: float, coords: list[str], key: str = "id") -> DataFrame:
    """``target_id, n, furthest``: what counting and taking the greatest distance of :func:`radius_join` gives.

    Pairs aren't listed.  Sources go to each box of a k-d tree that they are
    within the radius of, and there whole parts of a finer tree are counted at
    once; only points near the circle's edge are looked at.  A task holds the
    points within the radius of its box.
    """
    if not radius > 0:
        raise ValueError("the radius must be positive")
    dims = len(coords)
    xy = [f"c{i}" for i in range(dims)]
    finite = F.lit(True)
    for c in xy:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    src = _coords(points, key, coords).filter(finite)
    n = src.count()
    tree = _boxes(src, n, dims, min(BOX_POINTS, max(1000, n // (8 * src.sparkSession.sparkContext.defaultParallelism))))
    count = int(tree.leaf.max()) + 1

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.stack([np.asarray(b.column(i + 1)) for i in range(dims)], axis=1)
            point, box = tree.touched(at, np.full(len(at), float(radius)))
            for target, own, to in ((False, b.take(pa.array(point)), box), (True, b, tree.home(at))):
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(np.full(len(to), target)), *own.columns], names=["box", "target", "id", *xy])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box, held, index = None, [], None
        for whole in batches:
            boxes, asks = np.asarray(whole.column(0)), np.asarray(whole.column(1))
            turn = np.flatnonzero((np.diff(boxes) != 0) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *turn.tolist()], [*turn.tolist(), whole.num_rows]):
                if lo == hi:
                    continue
                if boxes[lo] != box:
                    box, held, index = boxes[lo], [], None
                part = whole.slice(lo, hi - lo)
                at = np.stack([np.asarray(part.column(3 + i)) for i in range(dims)], axis=1)
                if not asks[lo]:
                    held.append(at)
                    continue
                if index is None:
                    index, held = Halves(np.concatenate(held)), []
                for s in range(0, len(at), 1024):
                    got, far = index.within(at[s : s + 1024], float(radius))
                    yield pa.RecordBatch.from_arrays([part.column(2).slice(s, 1024), pa.array(got), pa.array(far)], names=["target_id", "n", "furthest"])

    kind = "box int, target boolean, id bigint, " + ", ".join(f"{c} double" for c in xy)
    met = src.mapInArrow(deal, kind).repartition(count, "box").sortWithinPartitions("box", "target")
    rows = met.mapInArrow(search, "target_id bigint, n bigint, furthest double")
    return rows.groupBy("target_id").agg(F.sum("n").alias("n"), F.max("furthest").alias("furthest"))


def unit_sphere(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """``ux, uy, uz`` of degrees, so that chords order like arcs."""
    a, b = F.radians(lon), F.radians(lat)
    return df.withColumns({"ux": F.cos(b) * F.cos(a), "uy": F.cos(b) * F.sin(a), "uz": F.sin(b)})


def arc_metres(chord):
    """Great-circle metres of a chord of the unit sphere."""
    return F.lit(2 * EARTH) * F.asin(F.least(F.greatest(chord / 2, F.lit(-1.0)), F.lit(1.0)))


def sparse_product(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """``i, v`` of a sparse matrix (i, j, v) times a vector (i, v)."""
    return matrix.join(vector.select(F.col("i").alias("j"), F.col("v").alias("_x")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("_x")).alias("v"))
