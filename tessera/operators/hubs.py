"""Rankings with and without a correction for hubs, from one pass over all scores.

The correction takes from twice the cosine a candidate's penalty, its mean cosine to its r nearest queries. A task keeps bounded
heaps on both sides of what it sees: a query's `keep` best candidates and a candidate's r best queries. The one side gives the
plain ranking and what the corrected one is chosen from, the other the penalties. What stands outside of a query's heap scores at
most twice its lowest cosine less the smallest penalty; only queries that this bound leaves open are ranked again.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import storage
from tessera.operators import vectors
from tessera.operators.vectors import UNIT

BEST, ASKED, NEAR = range(3)
KEEP = 256


def _heaps(keep: int, r: int):
    """Rows (kind, query, cand, u, c, above): a query's best candidates, its truth with the count above it, and the cosines
    nearest to a candidate."""

    def work(queries, bank):
        ids, truth = pa.concat_arrays([q["id"] for q in queries]), pa.concat_arrays([q["truth"] for q in queries])
        v = np.concatenate([q["vec"] for q in queries])
        own = np.concatenate([q["own"].to_numpy(zero_copy_only=False) for q in queries]).astype(float) if "own" in queries[0] else None
        above, best, rows = np.zeros(len(v), np.int64), None, np.arange(len(v))

        def out(kind, query, cand, u, c, above):
            n = len(cand)
            return pa.record_batch([pa.array(np.full(n, kind, np.int32)), query, cand, u, c, above], names=["kind", "query", "cand", "u", "c", "above"])

        for b in bank:
            score = v @ b["vec"].T
            at = pa.compute.index_in(truth, value_set=b["id"]).to_numpy(zero_copy_only=False).astype(float)
            hit = np.flatnonzero(~np.isnan(at))
            if own is None:  # the block is the whole bank
                own = np.full(len(v), np.nan)
                own[hit] = score[hit, at[hit].astype(int)]
            u = np.rint(score * UNIT)
            mine = np.where(np.isnan(own), -np.inf, np.rint(own * UNIT))
            higher = u > mine[:, None]
            higher[hit, at[hit].astype(int)] = False
            above += higher.sum(1)
            near = np.partition(u, len(v) - r, axis=0)[len(v) - r :] if len(v) > r else u
            yield out(NEAR, pa.nulls(near.size, ids.type), b["id"].take(pa.array(np.tile(np.arange(u.shape[1]), len(near)))), pa.array(near.ravel().astype(np.int64)), pa.nulls(near.size, pa.float64()), pa.nulls(near.size, pa.int64()))
            order = np.asarray(pa.compute.sort_indices(b["id"]))
            top = min(keep, u.shape[1])
            pick = order[np.argsort(-u[:, order], axis=1, kind="stable")[:, :top]]
            part = pa.table({"row": np.repeat(rows, top), "cand": b["id"].take(pa.array(pick.ravel())), "u": np.take_along_axis(u, pick, 1).ravel().astype(np.int64), "c": np.take_along_axis(score, pick, 1).ravel()})
            best = part if best is None else pa.concat_tables([best, part])
            if len(best) > 4 * keep * len(v) + 1_000_000:
                best = vectors._best(best, keep)
        if best is not None:
            best = vectors._best(best, keep).combine_chunks()
            for t in best.to_batches():
                yield out(BEST, ids.take(t["row"]), t["cand"], t["u"], t["c"], pa.nulls(t.num_rows, pa.int64()))
        yield out(ASKED, ids, truth, pa.nulls(len(ids), pa.int64()), pa.array(own if own is not None else np.full(len(v), np.nan)), pa.array(above))

    return work


class Both:
    """plain and corrected: rankings as vectors.ranked gives them; penalty (cand, penalty); open: how many queries had to be
    ranked again."""

    def __init__(self, plain: vectors.Ranking, corrected: vectors.Ranking, penalty: DataFrame, again: int):
        self.plain, self.corrected, self.penalty, self.open = plain, corrected, penalty, again


def ranked(queries: DataFrame, bank: DataFrame, k: int = 50, r: int = 10, keep: int | None = None) -> Both:
    """Both rankings of bank (cand, vec) for queries (query, truth, vec), whose ids are their own each (see vectors.ranked)."""
    keep = max(k, KEEP if keep is None else keep)
    spark, real = queries.sparkSession, vectors.real
    bank = storage.written(real(bank, "cand"), "bank")
    kind = bank.schema["cand"].dataType
    asks = real(queries.withColumn("truth", F.col("truth").cast(kind)), "query", "truth")
    n_bank, width = bank.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("query", asks.schema["query"].dataType), T.StructField("cand", kind), T.StructField("u", T.LongType()), T.StructField("c", T.DoubleType()), T.StructField("above", T.LongType())])
    if n_bank and n_bank * width * 8 <= vectors.SMALL:
        held = vectors._ready(bank.withColumnRenamed("cand", "id").toArrow().combine_chunks().to_batches()[0], "cosine")
        n_bank = len(held["id"])
        if len(pa.compute.unique(held["id"])) < n_bank:
            raise ValueError("candidates with the same id")
        got = asks.withColumnRenamed("query", "id").mapInArrow(vectors._whole(spark.sparkContext.broadcast(held), _heaps(keep, r), "cosine"), schema)
    else:
        ready = lambda df: df.where(vectors.whole("vec")).withColumn("vec", vectors.unit("vec"))
        bank, asks = ready(bank), ready(asks)
        n_bank, names = bank.agg(F.count(F.lit(1)), F.count_distinct("cand")).first()
        if names < n_bank:
            raise ValueError("candidates with the same id")
        known = bank.select(F.col("cand").alias("truth"), F.col("vec").alias("theirs"))
        asks = storage.written(asks.join(known, "truth", "left").select(F.col("query").alias("id"), "truth", vectors.dot(F.col("vec"), F.col("theirs")).alias("own"), "vec"), "queries")
        got = vectors.grid(asks, bank.withColumnRenamed("cand", "id"), _heaps(keep, r), schema, asks.count(), n_bank)
    got = storage.written(got, "heaps")
    by = W.partitionBy("query")
    best = got.where(F.col("kind") == BEST).withColumn("r", F.row_number().over(by.orderBy(F.desc("u"), "cand"))).where(F.col("r") <= keep)
    asked = got.where(F.col("kind") == ASKED).groupBy("query").agg(F.max("cand").alias("truth"), F.max(F.when(~F.isnan("c"), F.col("c"))).alias("c"), F.sum("above").alias("rank0"))
    near = got.where(F.col("kind") == NEAR).withColumn("r", F.row_number().over(W.partitionBy("cand").orderBy(F.desc("u")))).where(F.col("r") <= r)
    mean = near.groupBy("cand").agg((F.sum("u") / F.count("u") / UNIT).alias("penalty"))
    all_kept = n_bank <= keep
    penalty = bank.select("cand").join(mean, "cand", "left").select("cand", F.coalesce("penalty", F.lit(0e0)).alias("penalty"))
    penalty = penalty if all_kept else storage.written(penalty, "penalty")
    plain = vectors.Ranking(best.where(F.col("r") <= k).select("query", "r", "cand", "u"), asked.select("query", "truth", "rank0"), n_bank)
    scored = best.join(penalty, "cand").select("query", "cand", F.rint((2 * F.col("c") - F.col("penalty")) * UNIT).cast("long").alias("u"))
    own = asked.join(penalty.withColumnRenamed("cand", "truth"), "truth", "left").select("query", "truth", F.rint((2 * F.col("c") - F.col("penalty")) * UNIT).cast("long").alias("own"))
    top = scored.withColumn("r", F.row_number().over(by.orderBy(F.desc("u"), "cand")))
    counts = top.join(own.select("query", "own"), "query").groupBy("query").agg(F.count_if(F.col("u") > F.col("own")).alias("rank0"), F.min(F.when(F.col("r") <= k, F.col("u"))).alias("kth"))
    rank0 = F.when(F.col("own").isNull(), F.lit(n_bank)).otherwise(F.coalesce("rank0", F.lit(0))).cast("long")  # all of a bank is above a truth that it lacks
    full = own.join(counts, "query", "left")
    if all_kept:
        return Both(plain, vectors.Ranking(top.where(F.col("r") <= k).select("query", "r", "cand", "u"), full.select("query", "truth", rank0.alias("rank0")), n_bank), penalty, 0)
    least = F.broadcast(penalty.agg(F.min("penalty").alias("least")))  # one row
    # The lowest kept cosine, half a millionth up, bounds what is not kept.
    outside = F.when(F.max("r") >= keep, F.min("u") + 0.5)
    bound = best.groupBy("query").agg(outside.alias("out")).crossJoin(least).select("query", F.ceil(2 * F.col("out") - F.col("least") * UNIT).alias("bound"))
    full = full.join(bound, "query", "left")
    sure = F.col("bound").isNull() | (F.col("kth") > F.col("bound")) & (F.col("own").isNull() | (F.col("own") >= F.col("bound")))
    full = storage.written(full.select("query", "truth", rank0.alias("rank0"), F.coalesce(sure, F.lit(False)).alias("sure")), "corrected")
    again = full.where("not sure").count()
    topk = top.where(F.col("r") <= k).join(full.where("sure").select("query"), "query", "left_semi").select("query", "r", "cand", "u")
    ranks = full.where("sure").select("query", "truth", "rank0")
    if again:
        rest = vectors.ranked(queries.join(full.where("not sure").select("query"), "query", "left_semi"), bank.join(penalty, "cand"), k, penalty=True)
        topk, ranks = topk.unionByName(rest.topk), ranks.unionByName(rest.ranks)
    return Both(plain, vectors.Ranking(topk, ranks, n_bank), penalty, again)


def disagreement(queries: DataFrame, bank: DataFrame, ranks: DataFrame, penalty: DataFrame | None = None, sample: int = 50) -> DataFrame:
    """(difference): the largest between ranks (query, truth, rank0) and those counted anew, in the JVM, for `sample` queries of
    the smallest hashes. One row; null without a query whose truth is in the bank."""
    some = queries.where("query is not null").orderBy(F.md5(F.col("query").cast("string")), "query").limit(sample)
    some = F.broadcast(some.select("query", F.col("truth"), vectors.unit("vec").alias("v")))  # `sample` rows
    theirs = bank.select("cand", vectors.unit("vec").alias("w"))
    theirs = theirs.withColumn("p", F.lit(0e0)) if penalty is None else theirs.join(penalty.select("cand", F.col("penalty").alias("p")), "cand")
    times = 1 if penalty is None else 2
    scored = storage.written(theirs.crossJoin(some).select("query", "truth", "cand", F.rint((times * vectors.dot(F.col("v"), F.col("w")) - F.col("p")) * UNIT).alias("u")), "sample")
    own = scored.where(F.col("cand") == F.col("truth")).select("query", F.col("u").alias("own"))
    anew = scored.join(own, "query").groupBy("query").agg(F.count_if(F.col("u") > F.col("own")).alias("anew"))
    return anew.join(ranks, "query").agg(F.max(F.abs(F.col("anew") - F.col("rank0"))).cast("long").alias("difference"))
