"""Exact similarity self-join of unit vectors, as a forest of links.

Vectors are dealt to pivots, each to its nearest one's cell. A vector visits another cell only if the triangle inequality
lets a member of that cell lie within the radius: its distance to the plane between the two pivots, and its distance to the
other pivot less the cell's reach, are at most the radius. So cells that can't hold a pair never meet. What lies within half
the radius of its pivot (the core) is near to all of the core: a star links it, and no pair of it is formed. Large cells are
dealt in chunks, and pairs of chunks are tasks' work. Where the radius is so large that a vector would visit more than COPIES
cells, all vectors are one cell instead, whose chunks grow with it, so that there are about COPIES copies of a vector up to
half a million vectors, and one more for every 32,768 beyond. A task gives links that join what it finds near, fewer than it
has vectors, however many pairs are near.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import storage
from tessera.operators import vectors

PIVOTS, CELL, CHUNK = 4096, 1024, 4096
COPIES, WIDEST = 16, 8  # of a vector; most chunks of the usual size in one
VALUES, PAIRS = 1 << 23, 1 << 22  # numbers that a task holds, pairs that it weighs at once
UNIT = vectors.UNIT
SLACK = 1e-6
DEALT = "id long, vec array<double>, home int, far double, core boolean"


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((v * v).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * v @ pivots.T, 0))


def apart(sample: np.ndarray, radius: float) -> np.ndarray:
    """Those of the sample that lie over the radius from all taken before them, so that a clump has one pivot."""
    taken = np.zeros(len(sample), bool)
    free = np.ones(len(sample), bool)
    for k in range(len(sample)):
        if free[k]:
            taken[k] = True
            free &= distances(sample, sample[k : k + 1])[:, 0] > radius
    return sample[taken]


def _homes(pivots: np.ndarray, radius: float):
    def run(batches):
        for b in batches:
            v = vectors.matrix(b.column("vec"))
            if not len(v):
                continue
            d = distances(v, pivots)
            home = d.argmin(1)
            far = d[np.arange(len(v)), home]
            core = (far <= 0.99 * radius / 2 - SLACK) & (1 - (v * v).sum(1) <= 1e-3 * radius * radius)
            yield pa.record_batch([b.column("id"), b.column("vec"), pa.array(home, pa.int32()), pa.array(far), pa.array(core)], names=["id", "vec", "home", "far", "core"])

    return run


def _guests(v: np.ndarray, home: np.ndarray, pivots: np.ndarray, between: np.ndarray, reach: np.ndarray, radius: float) -> np.ndarray:
    """Which cells, all of greater number than its own, each vector visits."""
    d = distances(v, pivots)
    own = d[np.arange(len(v)), home][:, None]
    plane = (d * d - own * own) / (2 * np.maximum(between[home], 1e-12))
    return (plane <= radius + SLACK) & (d <= reach + radius + SLACK) & (np.arange(len(pivots))[None, :] > home[:, None])


def _copies(pivots: np.ndarray, reach: np.ndarray, chunks: np.ndarray, radius: float):
    """How many rows _visits gives, in parts."""
    between = distances(pivots, pivots)

    def run(batches):
        for b in batches:
            v, home = vectors.matrix(b.column("vec")), np.asarray(b.column("home"))
            if len(v):
                n = (chunks[home] + 1).sum() + (_guests(v, home, pivots, between, reach, radius) * chunks[None, :]).sum()
                yield pa.record_batch([pa.array([int(n)], pa.int64())], names=["n"])

    return run


def _visits(pivots: np.ndarray, reach: np.ndarray, chunks: np.ndarray, radius: float):
    """Rows (cell, left, right, side, chunk, core, id, vec): who meets whom. Side 0 is held in a task, 1 and 2 stream past it.

    Members of a cell meet those of their own and later chunks; visitors, who come from cells of smaller number only, meet
    every chunk.
    """
    between = distances(pivots, pivots)

    def run(batches):
        for b in batches:
            v, ids = vectors.matrix(b.column("vec")), np.asarray(b.column("id"))
            home, core = np.asarray(b.column("home")), np.asarray(b.column("core"))
            if not len(v):
                continue
            goes = _guests(v, home, pivots, between, reach, radius)
            part = (vectors_hash(ids) % chunks[home].astype(np.uint64)).astype(np.int64)
            guests, cells = np.nonzero(goes)
            who = np.concatenate((np.arange(len(v)), guests))
            cell, guest, part = np.concatenate((home, cells)), np.arange(len(who)) >= len(v), np.concatenate((part, np.zeros(len(guests), np.int64)))
            many = np.where(guest, chunks[cell], chunks[cell] + 1)  # a member is held with its own and later chunks, and streams past its own and earlier ones
            row = np.repeat(np.arange(len(who)), many)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            mine, held = part[row], ~guest[row] & (nth < chunks[cell[row]] - part[row])
            left = np.where(guest[row], nth, np.where(held, mine, nth - (chunks[cell[row]] - mine)))
            right = np.where(guest[row], nth, np.where(held, mine + nth, mine))
            side = np.where(guest[row], 2, np.where(held, 0, 1))
            row, cell = who[row], cell[row]
            for lo in range(0, len(row), 8192):
                at = slice(lo, lo + 8192)
                yield pa.record_batch([pa.array(cell[at], pa.int32()), pa.array(left[at], pa.int32()), pa.array(right[at], pa.int32()), pa.array(side[at], pa.int32()), pa.array(core[row[at]] & (side[at] < 2)), pa.array(ids[row[at]]), b.column("vec").take(pa.array(row[at]))], names=["cell", "l", "r", "side", "core", "id", "vec"])

    return run


def vectors_hash(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Forest:
    """Held vectors with a label each, and links that join those of one label."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, core: np.ndarray):
        self.ids, self.v, self.core = ids, v, core
        self.label = np.arange(len(ids))
        if core.any():  # linked by the cell's star already
            self.label[core] = np.flatnonzero(core)[0]
        self.first = self.label.copy()

    def meet(self, ids: np.ndarray, v: np.ndarray, core: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """A link of each passing vector to the first held one near to it, after held ones near to the same one are joined."""
        near = np.rint(v @ self.v.T * UNIT) >= least
        near &= ids[:, None] != self.ids[None, :]
        hit = near.any(1)
        near, ids = near[hit], ids[hit]
        if not len(ids):
            return ids, ids
        while True:
            mine = np.where(near, self.label[None, :], len(self.ids)).min(1)
            lower = np.where(near, mine[:, None], len(self.ids)).min(0)
            root = np.arange(len(self.ids))
            np.minimum.at(root, self.label, np.minimum(lower, self.label))
            if (root == np.arange(len(root))).all():
                return ids, self.ids[mine]
            while (root[root] != root).any():
                root = root[root]
            self.label = root[self.label]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        moved = np.unique(np.stack((self.first, self.label))[:, self.first != self.label], axis=1)
        return self.ids[moved[0]], self.ids[moved[1]]


def _links(least: int):
    def run(batches):
        now, held, forest = None, [], None

        def out(pair):
            a, b = pair
            return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for b in batches:
            keys = np.stack([np.asarray(b.column(c)) for c in ("cell", "l", "r")], 1) if b.num_rows else np.zeros((0, 3), int)
            side, ids, core, v = np.asarray(b.column("side")), np.asarray(b.column("id")), np.asarray(b.column("core")), vectors.matrix(b.column("vec"))
            cut = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1) | (np.diff(side) != 0)) + 1 if b.num_rows else []
            for lo, hi in zip([0, *cut], [*cut, b.num_rows]):
                if lo == hi:
                    continue
                key = tuple(keys[lo])
                if key != now:
                    if forest is not None:
                        yield out(forest.links())
                    now, held, forest = key, [], None
                part = ids[lo:hi], v[lo:hi], core[lo:hi]
                if side[lo] == 0:
                    held.append(part)
                    continue
                if forest is None:
                    if not held:
                        continue
                    forest = Forest(*(np.concatenate(x) for x in zip(*held)))
                if not part[2].all() or not forest.core.all():
                    step = max(1, PAIRS // len(forest.ids))
                    for at in range(0, hi - lo, step):
                        yield out(forest.meet(*(x[at : at + step] for x in part), least))
        if forest is not None:
            yield out(forest.links())

    return run


def widest(n: int, dims: int) -> int:
    """Vectors of a chunk where all n are one cell."""
    return max(CHUNK, min(math.ceil(n / COPIES), WIDEST * CHUNK, VALUES // max(1, dims)))


def near_links(items: DataFrame, least: int, pivots: int = PIVOTS) -> DataFrame:
    """(a, b), a < b: links whose components are those of all pairs of items (id, vec: unit vectors) whose cosine is, in whole
    millionths, at least `least`. Ids are their own each. The driver gets the pivots, and a row a cell."""
    spark = items.sparkSession
    n = items.count()
    if n < 2:
        return spark.createDataFrame([], "a long, b long")
    radius = math.sqrt(max(0.0, 2 * (1 - (least - 0.5) / UNIT)))
    some = items.orderBy(F.xxhash64("id"), "id").limit(min(pivots, math.ceil(n / CELL))).select("vec").toArrow()
    centres = apart(vectors.matrix(some["vec"].combine_chunks()), radius)

    def dealt_to(centres, chunk):
        homes = storage.written(items.select("id", "vec").mapInArrow(_homes(centres, radius), DEALT), "homes")
        cells = homes.groupBy("home").agg(F.max("far").alias("reach"), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("core"), F.col("id"))).alias("star")).collect()
        reach, chunks = np.full(len(centres), -np.inf), np.ones(len(centres), np.int64)
        for c in cells:
            reach[c.home], chunks[c.home] = c.reach, max(1, math.ceil(c.n / chunk))
        return homes, cells, (centres, reach, chunks, radius)

    homes, cells, grid = dealt_to(centres, CHUNK)
    wide = widest(n, centres.shape[1])
    copies = homes.mapInArrow(_copies(*grid), "n long").agg(F.sum("n")).first()[0]
    if copies > max(COPIES, math.ceil(n / wide) + 1) * n:
        homes, cells, grid = dealt_to(centres[:1], wide)
    stars = F.broadcast(spark.createDataFrame([(c.home, c.star) for c in cells], "home int, star long"))  # a row a pivot
    core = homes.where("core").join(stars, "home").where("id > star").select(F.col("star").alias("a"), F.col("id").alias("b"))
    met = homes.mapInArrow(_visits(*grid), "cell int, l int, r int, side int, core boolean, id long, vec array<double>")
    dealt = met.repartition(storage.partitions(spark), "cell", "l", "r").sortWithinPartitions("cell", "l", "r", "side")
    return core.unionByName(dealt.mapInArrow(_links(least), "a long, b long"))
