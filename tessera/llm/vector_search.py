"""Exact top-k by inner product over a vector-approximation file.

Candidates are written in blocks twice: as cells, one byte a component on a uniform grid over the block's range, and as
exact vectors. Query blocks and cell blocks are dealt to tasks as rows of a grid, so every query meets every cell block
and nothing is broadcast. A scan of the cells bounds every inner product from both sides: the product with the cells'
middles, give or take half a cell's width times the size of the query's components and a bound on rounding. A candidate
survives if its upper bound reaches the k-th best lower bound. Exact vectors are then read in order of the upper bounds:
the FIRST of each query, then what can still reach the k-th score found, ties included. Where more than DENSE candidates of
a block survive for a query, the block is read whole for it and yields its k best, so a crowd of near-equal vectors makes
no long lists. Of equal vectors, only the k + 1 smallest ids can be in any result, so only those become candidates.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do null ids; rows with
the query's id are its own; an id that asks twice asks once, with its smallest vector; vectors only meet others of their
length; scores beyond 64 bits count as the largest or smallest of 64 bits; an empty table has no results; columns other
than vec_id and embedding are not read, whatever their names.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import textkit as tk

SCALE, K, BLOCK, QUERY_BLOCK, CELLS, FIRST, DENSE = 1024, 10, 8192, 512, 255, 64, 256
#: Queries that a task of the scan holds at most.
HELD = 32768
LIMIT = (1 << 63) - 1


def integers(batch: pa.RecordBatch, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, all components one after another as whole numbers in doubles, and where each vector begins."""
    lists = batch.column("embedding")
    with np.errstate(over="ignore"):
        flat = np.nan_to_num(np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(float) * scale))
    return np.asarray(batch.column("vec_id")), flat, np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))))


def packed(batches, most: int):
    """(ids, vectors) of up to `most` vectors of one length."""
    held: dict[int, list] = {}
    for b in batches:
        ids, flat, offs = integers(b)
        size = np.diff(offs)
        for d in np.unique(size).tolist():
            at = np.flatnonzero(size == d)
            mine = held.setdefault(d, [[], [], 0])
            mine[0].append(ids[at]), mine[1].append(flat[offs[at][:, None] + np.arange(d)])
            mine[2] += len(at)
            while mine[2] >= most:
                ids_, v = np.concatenate(mine[0]), np.concatenate(mine[1])
                yield ids_[:most], v[:most]
                held[d] = mine = [[ids_[most:]], [v[most:]], mine[2] - most]
    for ids_, v, n in held.values():
        if n:
            yield np.concatenate(ids_), np.concatenate(v)


def grid(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lowest value and width of a cell, by component, and the cells of all vectors."""
    low = v.min(0)
    with np.errstate(over="ignore", invalid="ignore"):
        step = np.maximum(v.max(0) - low, 1) / CELLS
        cells = np.minimum(np.nan_to_num((v - low) / step), CELLS - 1).astype(np.uint8)
    return low, step, cells


def _blocks(most: int):
    """Rows (d, n, ids, vectors, low, step, cells) of blocks of vectors."""

    def run(batches):
        for ids, v in packed(batches, most):
            low, step, cells = grid(v)
            cols = [[v.shape[1]], [len(ids)], [ids], [v.tobytes()], [low.tobytes()], [step.tobytes()], [cells.tobytes()]]
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), *(pa.binary(),) * 4)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["d", "n", "ids", "vectors", "low", "step", "cells"])

    return run


class Asking:
    """Queries of a task, with the k best lower bounds that each has met and the candidates that survive."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, dense: int):
        self.ids, self.q, self.k, self.dense = ids, vectors, k, dense
        self.by = np.argsort(ids, kind="stable")
        self.best = np.full((len(ids), k), -np.inf)
        self.found: list[tuple[np.ndarray, ...]] = []  # query, block, place (-1: all), upper, lower
        self.size = 0

    def meet(self, block: int, ids: np.ndarray, low: np.ndarray, step: np.ndarray, cells: np.ndarray) -> None:
        at = np.searchsorted(self.ids[self.by], ids)
        at = self.by[np.minimum(at, len(self.by) - 1)]
        own = np.flatnonzero(self.ids[at] == ids)
        cells = cells.astype(np.float32).T
        for lo in range(0, len(self.ids), QUERY_BLOCK):
            self._some(block, lo, self.q[lo : lo + QUERY_BLOCK], low, step, cells, [(at[o] - lo, o) for o in own.tolist() if lo <= at[o] < lo + QUERY_BLOCK])
        if self.size > 4_000_000:
            self.prune()

    def _some(self, block, lo, q, low, step, cells, own) -> None:
        n = cells.shape[1]
        with np.errstate(over="ignore", invalid="ignore"):
            scaled = q * step
            middle = q @ (low + step / 2)
            size = np.abs(scaled).sum(1)
            slack = size / 2 * (1 + 1e-9) + size * CELLS * q.shape[1] * 2.0**-22 + np.abs(q) @ (np.abs(low) + step) * q.shape[1] * 2.0**-50 + 1e-3
            fine = np.isfinite(middle) & np.isfinite(slack) & (size * CELLS < 1e37)
            product = np.where(fine[:, None], scaled, 0).astype(np.float32) @ cells
        for r, o in own:
            product[r, o] = -np.inf
        bad = np.flatnonzero(~fine)  # beyond what bounds can tell: read whole
        if len(bad):
            self._keep(bad + lo, block, np.full(len(bad), -1), np.full(len(bad), np.inf), np.full(len(bad), -np.inf))
        top = min(self.k, n)
        best = np.where(fine[:, None], np.partition(product, n - top, 1)[:, n - top :] + (middle - slack)[:, None], -np.inf)
        both = np.concatenate((self.best[lo : lo + len(q)], best), 1)
        self.best[lo : lo + len(q)] = np.partition(both, top, 1)[:, top:]
        kth = self.best[lo : lo + len(q)].min(1)
        with np.errstate(invalid="ignore"):
            mask = (product >= (np.where(fine, kth - middle - slack, np.inf))[:, None]) & (product > -np.inf)
        many = mask.sum(1)
        crowd = np.flatnonzero(many > self.dense)
        if len(crowd):
            self._keep(crowd + lo, block, np.full(len(crowd), -1), product[crowd].max(1) + (middle + slack)[crowd], np.full(len(crowd), -np.inf))
            mask[crowd] = False
        row, place = np.nonzero(mask)
        value = product[row, place] + middle[row]
        self._keep(row + lo, block, place, value + slack[row], value - slack[row])

    def _keep(self, query, block, place, upper, lower) -> None:
        self.found.append((query, np.full(len(query), block), place, upper, lower))
        self.size += len(query)

    def prune(self) -> None:
        if self.found:
            every = tuple(np.concatenate(x) for x in zip(*self.found))
            keep = every[3] >= self.best.min(1)[every[0]]
            self.found = [tuple(x[keep] for x in every)]
            self.size = int(keep.sum())


def _scan(k: int, dense: int):
    """Query rows and then cell rows of each cell of the grid, to the survivors."""

    def out(asking):
        if asking:
            asking.prune()
            for query, block, place, upper, lower in asking.found:
                yield pa.record_batch([pa.array(asking.ids[query]), pa.array(block), pa.array(place.astype(np.int32)), pa.array(upper.astype(float)), pa.array(lower.astype(float))], names=["query_id", "block", "place", "upper", "lower"])

    def run(batches):
        now, asking, parts = None, None, []
        for b in batches:
            key = list(zip(*(b.column(c).to_pylist() for c in ("d", "r", "c"))))
            for i in range(b.num_rows):
                if key[i] != now:
                    yield from out(asking)
                    now, asking, parts = key[i], None, []
                ids = b.column("ids")[i].values.to_numpy()
                raw = lambda c, t: np.frombuffer(b.column(c)[i].as_buffer(), t)  # noqa: B023, E731
                if b.column("kind")[i].as_py() == 0:
                    parts.append((ids.copy(), raw("vectors", float).reshape(len(ids), -1).copy()))
                    continue
                if asking is None and parts:
                    asking = Asking(*(np.concatenate(x) for x in zip(*parts)), k, dense)
                if asking:
                    asking.meet(b.column("block")[i].as_py(), ids, raw("low", float), raw("step", float), raw("cells", np.uint8).reshape(len(ids), -1))
        yield from out(asking)

    return run


def products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held in doubles, as 64-bit integers."""
    most = v.shape[1] * float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0))
    if most < 2**52:
        return (v @ q).astype(np.int64)
    if most < 2**62:
        return v.astype(np.int64) @ q.astype(np.int64)
    whole = [int(x) for x in q]
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, whole)), -LIMIT - 1), LIMIT) for row in v], np.int64)


def _read(k: int):
    """A block's exact vectors, then the places asked of it, to scores; of a block asked for whole, its k best."""

    def run(batches):
        now, ids, v = None, None, None
        for b in batches:
            block, kind = np.asarray(b.column("block")), np.asarray(b.column("kind"))
            place = np.asarray(b.column("place").fill_null(-1))
            asked, got, score = [], [], []
            for i in range(b.num_rows):
                if kind[i] == 0:
                    now, ids = block[i], b.column("ids")[i].values.to_numpy().copy()
                    v = np.frombuffer(b.column("vectors")[i].as_buffer(), float).reshape(len(ids), -1).copy()
                    continue
                if block[i] != now:
                    raise ValueError(f"no vectors of block {block[i]}")
                query, q = b.column("query_id")[i].as_py(), np.frombuffer(b.column("vectors")[i].as_buffer(), float)
                at = np.array([place[i]]) if place[i] >= 0 else np.flatnonzero(ids != query)
                s = products(v[at], q)
                if len(at) > k:
                    best = np.lexsort((ids[at], -s))[:k]
                    at, s = at[best], s[best]
                asked.append(np.full(len(at), query)), got.append(ids[at]), score.append(s)
            if got:
                yield pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in (asked, got, score)], names=["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding as doubles, of rows whose vectors take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad)


def top_k(vectors: DataFrame, is_query, k: int = K, block: int = BLOCK, first: int = FIRST, dense: int = DENSE, held: int = HELD) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. is_query: a condition on vec_id that says which rows ask."""
    spark = vectors.sparkSession
    good = usable(vectors)
    row = "d int, n int, ids array<long>, vectors binary, low binary, step binary, cells binary"
    copy = F.row_number().over(W.partitionBy(F.xxhash64("embedding"), "embedding").orderBy("vec_id"))
    some = good.withColumn("copy", copy).where(F.col("copy") <= k + 1).select("vec_id", "embedding")
    blocks = some.mapInArrow(_blocks(block), row).withColumn("block", F.monotonically_increasing_id())
    blocks = tk.written(blocks, "vector-blocks")  # a file of cells and one of exact vectors: each scan reads its own columns
    asking = tk.written(good.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    n_all, n_cells = blocks.agg(F.sum("n"), F.count(F.lit(1))).first()
    n_asking = asking.count()
    parts = tk.partitions(spark)
    across = math.ceil(min(n_asking, max(n_asking / held, math.sqrt(parts * 8 * n_asking / max(1, n_all or 0) ), 1))) if n_asking else 1
    down = max(1, min(n_cells, math.ceil(parts / across)))
    asks = asking.withColumn("c", F.pmod(F.xxhash64("vec_id"), F.lit(across)).cast("int")).repartition(min(parts, across), "c").sortWithinPartitions("c")
    queries = asks.mapInArrow(_grouped, "c int, d int, ids array<long>, vectors binary").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    none = lambda t: F.lit(None).cast(t)
    queries = queries.select("d", "r", "c", F.lit(0).alias("kind"), none("long").alias("block"), "ids", "vectors", *(none("binary").alias(x) for x in ("low", "step", "cells")))
    cells = blocks.select("d", F.pmod("block", F.lit(down)).cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("c"), F.lit(1).alias("kind"), "block", "ids", none("binary").alias("vectors"), "low", "step", "cells")
    dealt = queries.unionByName(cells).repartition(parts, "d", "r", "c").sortWithinPartitions("d", "r", "c", "kind")
    survivors = tk.written(dealt.mapInArrow(_scan(k, dense), "query_id long, block long, place int, upper double, lower double"), "survivors")
    by = W.partitionBy("query_id")
    least = survivors.withColumn("rank", F.row_number().over(by.orderBy(F.desc("lower")))).where(F.col("rank") <= k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("lower")).alias("least"))
    left = survivors.join(least, "query_id").where("least is null or upper >= least").drop("least", "lower")
    left = tk.written(left.withColumn("turn", F.row_number().over(by.orderBy(F.desc("upper"), "block", "place"))), "survivors")

    def read(rows: DataFrame) -> DataFrame:
        named = rows.join(queries_exact, "query_id").select("block", F.lit(1).alias("kind"), "query_id", "place", none("array<long>").alias("ids"), "vectors")
        held_ = blocks.join(rows.select("block").distinct().hint("merge"), "block").select("block", F.lit(0).alias("kind"), none("long").alias("query_id"), none("int").alias("place"), "ids", "vectors")
        return held_.unionByName(named).repartition(parts, "block").sortWithinPartitions("block", "kind").mapInArrow(_read(k), "query_id long, vec_id long, score long")

    queries_exact = tk.written(asking.mapInArrow(_single, "query_id long, vectors binary"), "queries")
    early = (F.col("turn") <= first) & (F.col("place") >= 0)
    one = tk.written(read(left.where(early)), "scores")
    best = one.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    kth = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("kth"))
    rest = left.where(~early).join(kth, "query_id", "left").where("kth is null or upper >= kth")
    every = one.unionByName(read(rest.select("query_id", "block", "place")))
    rank = F.row_number().over(by.orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _grouped(batches):
    """Query blocks of one column c of the grid and one length."""
    kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary())
    for b in batches:
        c = np.asarray(b.column("c"))
        for x in np.unique(c).tolist():
            for ids, v in packed([b.filter(pa.array(c == x))], QUERY_BLOCK):
                yield pa.record_batch([pa.array([y], t) for y, t in zip((x, v.shape[1], ids, v.tobytes()), kinds)], names=["c", "d", "ids", "vectors"])


def _single(batches):
    for b in batches:
        ids, flat, offs = integers(b)
        yield pa.record_batch([pa.array(ids), pa.array([flat[x:y].tobytes() for x, y in zip(offs, offs[1:])], pa.binary())], names=["query_id", "vectors"])
