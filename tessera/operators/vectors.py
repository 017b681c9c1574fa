"""Vectors by group and against each other: consensus, unit vectors, and a ranking of a bank for every query.

A ranking deals blocks of queries and blocks of the bank to tasks as rows of a grid: every query meets every candidate as
two matrices in numpy, and a task keeps a query's k best of the blocks it has seen. Only a bank whose size, once written
and measured, is SMALL bytes or less is broadcast instead. Scores are
whole millionths, so equal scores tie on every engine; ties go to the smaller candidate.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import storage

BLOCK, HELD, KEYS, UNIT = 1024, 65536, 20_000, 1e6
SMALL = 32 << 20


def matrix(column: pa.Array) -> np.ndarray:
    """Rows as doubles, a null component as NaN. Rows of different lengths are an error, never mixed."""
    size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), -1))
    if len(size) and (size != size[0]).any():
        raise ValueError(f"vectors of different lengths, among them {size[0]} and {size[size != size[0]][0]}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def norm(vec: str | Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0e0), lambda s, x: s + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0e0), lambda s, x: s + x)


def unit(vec: str, least: float = 1e-9) -> Column:
    """The vector over its length plus `least`; a zero vector stays zero."""
    n = norm(F.col(vec).cast("array<double>")) + least
    return F.transform(vec, lambda x: x.cast("double") / n)


def _summed(keys: pa.Array, v: np.ndarray, n: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """One row a key, in the order in which keys appear."""
    codes = pa.compute.dictionary_encode(keys)
    code = np.asarray(codes.indices)
    by = np.argsort(code, kind="stable")
    first = np.searchsorted(code[by], np.arange(len(codes.dictionary)))
    return codes.dictionary, np.add.reduceat(v[by], first, axis=0), np.add.reduceat(n[by], first)


def _sums(batches):
    """Partial sums of the whole vectors, of up to KEYS keys at once."""
    held: list = []

    def out(parts):
        if len({v.shape[1] for _, v, _ in parts}) > 1:
            raise ValueError(f"vectors of different lengths: {sorted({v.shape[1] for _, v, _ in parts})}")
        keys, v, n = _summed(pa.concat_arrays([k for k, *_ in parts]), np.concatenate([v for _, v, _ in parts]), np.concatenate([n for *_, n in parts]))
        return keys, v, n

    for b in batches:
        v = matrix(b.column("vec"))
        good = np.isfinite(v).all(1)
        if good.any():
            held.append(_summed(b.column("key").filter(pa.array(good)), v[good], np.ones(good.sum(), np.int64)))
        if sum(len(k) for k, *_ in held) > KEYS:
            held = [out(held)]
            if len(held[0][0]) > KEYS // 2:
                yield _rows(*held.pop())
    if held:
        yield _rows(*out(held))


def consensus(rows: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """(key, vec, n): the plain mean of each key's vectors and their number. Null keys take no part, nor do vectors that are
    null or hold a component that is null or not finite. Vectors of different lengths are an error.

    Sums are formed in the scan first, so a key with a third of the rows sends a row or a few a task.
    """
    good = rows.where(F.col(key).isNotNull() & F.col(vec).isNotNull()).select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("vec"))
    schema = T.StructType([T.StructField("key", good.schema["key"].dataType), T.StructField("vec", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])
    some = good.mapInArrow(_sums, schema).repartition(storage.partitions(rows.sparkSession), "key").sortWithinPartitions("key")
    return some.mapInArrow(_means, schema).toDF(key, vec, "n")


def _means(batches):
    """Partial sums in order of their key, to one mean a key. The last key of a batch waits for the next batch."""
    wait = None
    for b in batches:
        if not b.num_rows:
            continue
        part = b.column("key"), matrix(b.column("vec")), np.asarray(b.column("n"))
        if wait is not None:
            if wait[1].shape[1] != part[1].shape[1]:
                raise ValueError(f"vectors of different lengths: {wait[1].shape[1]} and {part[1].shape[1]}")
            part = pa.concat_arrays([wait[0], part[0]]), np.concatenate((wait[1], part[1])), np.concatenate((wait[2], part[2]))
        keys, v, n = _summed(*part)
        wait = keys[-1:], v[-1:], n[-1:]
        if len(keys) > 1:
            yield _rows(keys[:-1], v[:-1] / n[:-1, None], n[:-1])
    if wait is not None:
        yield _rows(wait[0], wait[1] / wait[2][:, None], wait[2])


def _rows(keys: pa.Array, v: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([keys, listed(v), pa.array(n)], names=["key", "vec", "n"])


def listed(v: np.ndarray) -> pa.ListArray:
    """A matrix's rows as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(np.ascontiguousarray(v).ravel()))


def _packed(batches):
    """(id, extra...) rows with vec, to blocks of BLOCK rows: ids, vectors, and truth scores as lists."""
    for b in batches:
        for lo in range(0, b.num_rows, BLOCK):
            part = b.slice(lo, BLOCK)
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c))  # noqa: B023, E731
            cols = [one(c) for c in part.schema.names if c != "vec"]
            yield pa.record_batch([*cols, pa.array([matrix(part.column("vec")).tobytes()], pa.binary())], names=[*(c for c in part.schema.names if c != "vec"), "vec"])


def blocks(rows: DataFrame) -> DataFrame:
    """rows in blocks: every column as a list, vec as the bytes of a matrix of doubles."""
    fields = [T.StructField(f.name, T.ArrayType(f.dataType)) for f in rows.schema if f.name != "vec"]
    cols = [f.name for f in rows.schema if f.name != "vec"]
    return rows.select(*cols, F.col("vec").cast("array<double>").alias("vec")).mapInArrow(_packed, T.StructType([*fields, T.StructField("vec", T.BinaryType())]))


def grid(queries: DataFrame, bank: DataFrame, work, schema: T.StructType | str, n_queries: int, n_bank: int) -> DataFrame:
    """work(query parts, stream of bank parts) for every cell of a grid of queries against the bank.

    A part is a dict of a block's columns. The grid is as square as both sides' sizes ask for, so that neither is copied
    more often than needed, and a task holds HELD queries at most.
    """
    parts = storage.partitions(queries.sparkSession)
    across = max(1, math.ceil(n_queries / HELD), min(math.ceil(n_queries / BLOCK), math.ceil(math.sqrt(parts * n_queries / max(1, n_bank)))))
    down = max(1, min(math.ceil(n_bank / BLOCK), math.ceil(parts / across)))
    return dealt(blocks(queries), blocks(bank), work, schema, across, down)


def dealt(queries: DataFrame, bank: DataFrame, work, schema: T.StructType | str, across: int, down: int) -> DataFrame:
    """work on the cells of a grid of so many parts of packed queries and so many of a packed bank (see grid)."""
    parts = storage.partitions(queries.sparkSession)
    deal = lambda df, name, n: df.withColumn(name, F.pmod(F.xxhash64("block"), F.lit(n)).cast("int"))
    each = lambda df, name, n: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    sides = []
    for kind, df in enumerate((queries, bank)):
        df = df.withColumn("block", F.monotonically_increasing_id())
        df = each(deal(df, "c", across), "r", down) if kind == 0 else each(deal(df, "r", down), "c", across)
        sides.append(df.select("r", "c", F.lit(kind).alias("kind"), *[F.col(c).alias(f"{'qb'[kind]}_{c}") for c in df.columns if c not in ("r", "c", "block")]))
    both = sides[0].unionByName(sides[1], allowMissingColumns=True).repartition(parts, "r", "c").sortWithinPartitions("r", "c", "kind")
    return both.mapInArrow(_cells(work), schema)


def _cells(work):
    def part(b, i, side):
        out = {c[2:]: b.column(c)[i].values for c in b.schema.names if c.startswith(f"{side}_") and c != f"{side}_vec"}
        n = len(next(iter(out.values())))
        return out | {"vec": np.frombuffer(b.column(f"{side}_vec")[i].as_buffer(), float).reshape(n, -1)}

    def run(batches):
        rows = ((b, i) for b in batches for i in range(b.num_rows))
        now, queries, ahead = None, [], next(rows, None)

        def bank():
            nonlocal ahead
            while ahead is not None:
                b, i = ahead
                if (b.column("r")[i].as_py(), b.column("c")[i].as_py()) != now or b.column("kind")[i].as_py() == 0:
                    return
                yield part(b, i, "b")
                ahead = next(rows, None)

        while ahead is not None:
            b, i = ahead
            now = (b.column("r")[i].as_py(), b.column("c")[i].as_py())
            if b.column("kind")[i].as_py() == 0:
                queries.append(part(b, i, "q"))
                ahead = next(rows, None)
                if ahead is not None and (ahead[0].column("r")[ahead[1]].as_py(), ahead[0].column("c")[ahead[1]].as_py()) != now:
                    queries = []
                continue
            if queries:
                yield from work(queries, bank())
            for _ in bank():
                pass
            queries = []

    return run


def _ranked(k: int, measure: str):
    """Of each query and cell: the k best candidates, and one row with the truth as cand and the number above its score."""

    def work(queries, bank):
        ids = pa.concat_arrays([q["id"] for q in queries])
        truth = pa.concat_arrays([q["truth"] for q in queries])
        own = np.concatenate([q["own"].to_numpy(zero_copy_only=False) for q in queries]).astype(float) if "own" in queries[0] else None
        v = np.concatenate([q["vec"] for q in queries])
        above, best = np.zeros(len(v), np.int64), None
        for b in bank:
            score = v @ b["vec"].T
            if measure == "tanimoto":
                score /= np.maximum(v.sum(1)[:, None] + b["vec"].sum(1) - score, 1)
            if "penalty" in b:
                score = 2 * score - b["penalty"].to_numpy(zero_copy_only=False)
            u = np.rint(score * UNIT)
            at = pa.compute.index_in(truth, value_set=b["id"]).to_numpy(zero_copy_only=False).astype(float)
            hit = np.flatnonzero(~np.isnan(at))
            if own is None:  # the block is the whole bank
                own = np.full(len(v), np.nan)
                own[hit] = u[hit, at[hit].astype(int)]
            known = ~np.isnan(own)
            more = (u > np.where(known, own, -np.inf)[:, None]).sum(1)
            more[hit] -= u[hit, at[hit].astype(int)] > np.where(known, own, -np.inf)[hit]
            above += more
            order = np.asarray(pa.compute.sort_indices(b["id"]))
            u, cand = u[:, order], b["id"].take(pa.array(order))
            top = min(k, u.shape[1])
            pick = np.argsort(-u, axis=1, kind="stable")[:, :top]
            here = np.take_along_axis(u, pick, 1)
            row = np.repeat(np.arange(len(v)), top)
            part = pa.table({"row": row, "cand": cand.take(pa.array(pick.ravel())), "u": here.ravel().astype(np.int64)})
            best = part if best is None else pa.concat_tables([best, part])
            if len(best) > 4 * k * len(v) + 1_000_000:
                best = _best(best, k)
        if best is not None:
            best = _best(best, k)
            yield from pa.table({"query": ids.take(best["row"].combine_chunks()), "cand": best["cand"], "u": best["u"], "above": pa.nulls(len(best), pa.int64())}).combine_chunks().to_batches()
        yield pa.record_batch([ids, truth, pa.nulls(len(ids), pa.int64()), pa.array(above)], names=["query", "cand", "u", "above"])

    return work


def _best(rows: pa.Table, k: int) -> pa.Table:
    rows = rows.take(pa.compute.sort_indices(rows, [("row", "ascending"), ("u", "descending"), ("cand", "ascending")]))
    row = rows["row"].to_numpy()
    first = np.searchsorted(row, row)
    return rows.filter(pa.array(np.arange(len(row)) - first < k))


def units(v: np.ndarray, least: float = 1e-9) -> np.ndarray:
    """What unit gives, of a matrix's rows."""
    return v / (np.sqrt((v * v).sum(1, keepdims=True)) + least) if v.size else v


def _ready(table, measure: str):
    """Rows of (id, ..., vec) whose vectors are finite throughout, as columns, and their vectors made ready for the measure."""
    v = matrix(table["vec"])
    good = np.isfinite(v).all(1)
    cols = {c: table[c].filter(pa.array(good)) for c in table.schema.names if c != "vec"}
    return cols | {"vec": units(v[good]) if measure == "cosine" else v[good]}


def _whole(bank, work, measure: str):
    """Every query against a bank that fits a task."""

    def run(rows):
        for b in rows:
            for lo in range(0, b.num_rows, BLOCK):
                yield from work([_ready(b.slice(lo, BLOCK), measure)], [bank.value])

    return run


def whole(vec: str) -> Column:
    """Whether a vector's length is a finite number, so that all its components are."""
    n = norm(F.col(vec).cast("array<double>"))
    return n.isNotNull() & ~F.isnan(n) & (n < float("inf"))


def real(df: DataFrame, *cols: str) -> DataFrame:
    """The columns and vec as doubles, of rows that have the first column and a vector."""
    return df.where(F.col(cols[0]).isNotNull() & F.col("vec").isNotNull()).select(*cols, F.col("vec").cast("array<double>").alias("vec"))


class Ranking:
    """topk (query, r from 1, cand, u) and ranks (query, truth, rank0) of a set of queries against a bank."""

    def __init__(self, topk: DataFrame, ranks: DataFrame, n_bank: int):
        self.topk, self.ranks, self.n_bank = topk, ranks, n_bank


def ranked(queries: DataFrame, bank: DataFrame, k: int = 50, penalty: bool = False, measure: str = "cosine", once: bool = False) -> Ranking:
    """Ranks bank (cand, vec; and penalty, if asked for) for queries (query, truth, vec) by the cosine.

    By the measure tanimoto, vec holds bits, 0 or 1; two empty sets score 0. rank0 counts the candidates whose score is above
    the truth's, which the bank may not hold: then all of it is above.
    A repeated id of a query or a candidate is an error, raised where the result is read. With a penalty, the score is twice the
    cosine less the candidate's penalty. Vectors that are null or not finite throughout take no part. No queries, or an empty
    bank, give empty tables; k may exceed the bank. once says that either topk or ranks is read, a single time, so what the
    tasks give need not be written.
    """
    if measure not in ("cosine", "tanimoto"):
        raise ValueError(f"unknown measure {measure!r}")
    bank = storage.written(real(bank, "cand", *(["penalty"] if penalty else [])), "bank")
    kind = bank.schema["cand"].dataType
    asks = real(queries.withColumn("truth", F.col("truth").cast(kind)), "query", "truth")
    schema = T.StructType([T.StructField("query", asks.schema["query"].dataType), T.StructField("cand", kind), T.StructField("u", T.LongType()), T.StructField("above", T.LongType())])
    n_bank, width = bank.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    asks = asks.withColumnRenamed("query", "id")
    small = n_bank and n_bank * width * 8 <= SMALL  # its size is checked; a larger bank is dealt in blocks
    if small:
        held = _ready(bank.withColumnRenamed("cand", "id").toArrow().combine_chunks().to_batches()[0], measure)
        n_bank = len(held["id"])
        if len(pa.compute.unique(held["id"])) < n_bank:
            raise ValueError("candidates with the same id")
        got = asks.mapInArrow(_whole(queries.sparkSession.sparkContext.broadcast(held), _ranked(k, measure), measure), schema)
    else:
        ready = unit("vec") if measure == "cosine" else F.col("vec")
        bank, asks = bank.where(whole("vec")).withColumn("vec", ready), asks.where(whole("vec")).withColumn("vec", ready)
        n_bank, names = bank.agg(F.count(F.lit(1)), F.count_distinct("cand")).first()
        if names < n_bank:
            raise ValueError("candidates with the same id")
        known = bank.select(F.col("cand").alias("truth"), F.col("vec").alias("theirs"), *(["penalty"] if penalty else []))
        score = dot(F.col("vec"), F.col("theirs"))
        if measure == "tanimoto":
            score = score / F.greatest(dot(F.col("vec"), F.col("vec")) + dot(F.col("theirs"), F.col("theirs")) - score, F.lit(1e0))
        score = 2 * score - F.col("penalty") if penalty else score
        asks = storage.written(asks.join(known, "truth", "left").select("id", "truth", F.rint(score * UNIT).alias("own"), "vec"), "queries")
        n_asks, names = asks.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
        if names < n_asks:
            raise ValueError("queries with the same id")
        got = grid(asks, bank.withColumnRenamed("cand", "id"), _ranked(k, measure), schema, n_asks, n_bank)
    got = got if once else storage.written(got, "ranking")
    by = W.partitionBy("query")
    topk, ranks = got.where("above is null"), got.where("above is not null")
    rank0 = F.sum("above")
    if small:  # a query gives as many rows as it has best candidates, and one count, but for one that stands there twice
        twice = F.raise_error(F.concat(F.lit("queries with the same id: "), F.col("query").cast("string")))
        topk = topk.withColumn("u", F.when(F.count(F.lit(1)).over(by) > min(k, n_bank), twice.cast("long")).otherwise(F.col("u")))
        rank0 = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.concat(F.lit("queries with the same id: "), F.max(F.col("query").cast("string")))).cast("long")).otherwise(rank0)
    topk = topk.withColumn("r", F.row_number().over(by.orderBy(F.desc("u"), "cand"))).where(F.col("r") <= k).select("query", "r", "cand", "u")
    ranks = ranks.groupBy("query").agg(F.max("cand").alias("truth"), rank0.alias("rank0"))
    return Ranking(topk, ranks, n_bank)


def from_scores(scores: DataFrame, truths: DataFrame, k: int = 50) -> Ranking:
    """The ranking that a ready table of scores (query, cand, score) gives, with truths (query, truth), one for each query.

    Scores count in whole millionths; null and NaN ones stand for a candidate that wasn't scored, and take no part. A truth
    without a score has all scored candidates of its query above it. A pair that stands there twice is an error, raised
    where the result is read. Queries without any score have rank 0 and no best candidates, as with an empty bank.
    """
    good = scores.where("query is not null and cand is not null and score is not null and not isnan(score)").select("query", "cand", F.rint(F.col("score").cast("double") * UNIT).cast("long").alias("u"), F.col("score").cast("double").alias("s"))
    by = W.partitionBy("query").orderBy(F.desc("u"), "cand")
    twice = F.raise_error(F.concat(F.lit("scored twice: "), F.col("query").cast("string"))).cast("long")
    top = good.withColumn("u", F.when(F.lag("cand").over(W.partitionBy("query").orderBy("cand")) == F.col("cand"), twice).otherwise(F.col("u")))
    topk = top.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k).select("query", "r", "cand", "u")
    asked = truths.where("query is not null").select("query", F.col("truth").cast(good.schema["cand"].dataType).alias("truth"))
    own = asked.join(good.select("query", F.col("cand").alias("truth"), F.col("u").alias("own")), ["query", "truth"], "left")
    above = own.join(good.select("query", "u"), "query", "left").groupBy("query", "truth").agg(F.count_if(F.col("u").isNotNull() & (F.col("own").isNull() | (F.col("u") > F.col("own")))).alias("rank0"))
    return Ranking(topk, above, good.select("cand").distinct().count())


def hub_penalty(queries: DataFrame, bank: DataFrame, r: int = 10) -> DataFrame:
    """bank with penalty: each candidate's mean cosine, in whole millionths before the mean, to its r nearest queries."""
    bank = storage.written(bank.select("cand", "vec"), "bank")  # read as queries and again with the penalty: aggregated once
    asked = bank.select(F.col("cand").alias("query"), F.lit(None).cast(queries.schema["query"].dataType).alias("truth"), "vec")
    near = ranked(asked, queries.select(F.col("query").alias("cand"), "vec"), r, once=True).topk
    mean = near.groupBy(F.col("query").alias("cand")).agg((F.sum("u") / F.count("u") / UNIT).alias("penalty"))
    return bank.join(mean, "cand", "left").select("cand", "vec", F.coalesce("penalty", F.lit(0e0)).alias("penalty"))
