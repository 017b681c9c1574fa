"""Sets of bits packed into longs, and the nearest by Tanimoto, all in the JVM.

A fingerprint of 2,048 bits is 32 longs. Of two sets of a and b bits the Tanimoto is at most min(a, b) / max(a, b), so
candidates stand in buckets of equal cardinality: a query first meets the buckets nearest to its own cardinality that hold k
candidates together, and then those buckets alone whose bound is not under the kth best found.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera import storage

UNIT, CHUNK, WORD = 1_000_000, 4096, 64


def packed(bits: str) -> Column:
    """An array of numbers, of which those above 0 are set, as longs of 64 bits each; null stays null, a null number is 0."""
    words = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(bits) - 1) / WORD)).cast("int"))
    part = lambda w: F.slice(bits, w * WORD + 1, F.lit(WORD))
    folded = lambda w: F.aggregate(part(w), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.coalesce((x > 0).cast("long"), F.lit(0).cast("long"))))
    return F.when(F.col(bits).isNotNull(), F.transform(words, folded))


def cardinality(words: str | Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda s, x: s + F.bit_count(x))


def shared(a: str, b: str, width: int) -> Column:
    """Bits set in both of two packed sets of `width` words; written out, so that it is compiled."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(a)[k].bitwiseAND(F.col(b)[k])) for k in range(width)])


def tanimoto(both: Column, a: str, b: str) -> Column:
    """Whole millionths; two empty sets have 0."""
    return F.rint(both / F.greatest(F.col(a) + F.col(b) - both, F.lit(1)) * UNIT).cast("long")


def nearest(queries: DataFrame, bank: DataFrame, k: int = 1) -> DataFrame:
    """(query, r from 1, cand, u): of each query its k best candidates by Tanimoto in whole millionths, ties to the smaller.

    queries (query, words), bank (cand, words): packed sets of one width each; others are an error. Null ids and sets take
    no part. Fewer than k candidates give all. What is broadcast has a row a cardinality.
    """
    q = storage.written(queries.where("query is not null and words is not null").select("query", "words", cardinality("words").alias("n")), "queries")
    b = bank.where("cand is not null and words is not null").select("cand", F.col("words").alias("theirs"), cardinality("words").alias("m"))
    b = storage.written(b, "bank")
    sizes = q.agg(F.min(F.size("words")).alias("a"), F.max(F.size("words")).alias("b")).unionByName(b.agg(F.min(F.size("theirs")).alias("a"), F.max(F.size("theirs")).alias("b")))
    low, high = sizes.agg(F.min("a"), F.max("b")).first()
    if low is not None and low != high:
        raise ValueError(f"sets of {low} and of {high} words")
    width = low or 0
    counts = b.groupBy("m").agg(F.count(F.lit(1)).alias("c")).withColumn("chunks", F.ceil(F.col("c") / CHUNK).cast("int"))
    held = F.broadcast(storage.written(counts, "counts"))  # a row a cardinality, of which there are as many as bits
    kinds = q.select("n").distinct().crossJoin(held)
    far = W.partitionBy("n").orderBy(F.desc(_bound()), "m")
    needed = kinds.withColumn("before", F.coalesce(F.sum("c").over(far.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < k)
    needed = storage.written(needed.select("n", "m", "chunks"), "needed")
    first = storage.written(_best(_met(q.join(F.broadcast(needed), "n"), b, width), k), "first")
    least = first.groupBy("query").agg(F.count(F.lit(1)).alias("have"), F.min("u").alias("least"))
    known = q.join(least, "query", "left")
    rest = known.join(held, (F.col("have") < k) | F.col("have").isNull() | (_bound() >= F.col("least"))).join(needed.select("n", "m"), ["n", "m"], "left_anti")
    second = _met(rest.select("query", "words", "n", "m", "chunks"), b, width)
    return _best(first.select("query", "cand", "u").unionByName(second), k)


def _bound() -> Column:
    return F.ceil(F.least("n", "m") / F.greatest(F.col("n"), F.col("m"), F.lit(1)) * UNIT)


def _met(asked: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """(query, cand, u) of queries (query, words, n, m, chunks) against the buckets m, which lie in chunks, so that no task
    has a whole large one."""
    asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    chunks = F.broadcast(b.groupBy("m").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")))  # a row a cardinality
    dealt = b.join(chunks, "m").withColumn("chunk", F.pmod(F.xxhash64("cand"), F.col("chunks")).cast("int")).drop("chunks")
    score = tanimoto(shared("words", "theirs", width) if width else F.lit(0), "n", "m")
    return asked.join(dealt, ["m", "chunk"]).select("query", "cand", score.alias("u"))


def _best(met: DataFrame, k: int) -> DataFrame:
    if k == 1:  # partial maxima in every task
        one = met.groupBy("query").agg(F.min(F.struct((-F.col("u")).alias("less"), "cand")).alias("b"))
        return one.select("query", F.lit(1).alias("r"), "b.cand", (-F.col("b.less")).alias("u"))
    r = F.row_number().over(W.partitionBy("query").orderBy(F.desc("u"), "cand"))
    return met.withColumn("r", r).where(F.col("r") <= k).select("query", "r", "cand", "u")
