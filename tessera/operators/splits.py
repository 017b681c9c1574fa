"""Splits into train, valid and test, by row, by group, and within groups. Order comes from a hash, never from a generator.

Null keys belong to no split of groups and go to the first; a table without rows has no splits.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import storage

NAMES, SHARES = ("train", "valid", "test"), (0.8, 0.1, 0.1)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with at, their place from 0 in the whole order. Ranges are sorted apart, their counts alone reach the driver."""
    dealt = rows.repartitionByRange(storage.partitions(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    table = storage.written(dealt, "ordered")
    counts = {r.part: r.c for r in table.groupBy("part").agg(F.count(F.lit(1)).alias("c")).collect()}  # one row a partition
    begin, at = [], 0
    for p in range(max(counts, default=-1) + 1):
        begin.append(at)
        at += counts.get(p, 0)
    first = F.array(*[F.lit(b).cast("long") for b in begin or [0]])
    place = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1 + F.element_at(first, F.col("part") + 1)
    return table.withColumn("at", place.cast("long")).drop("part")


def codes(labels: DataFrame, label: str) -> DataFrame:
    """(label, code): distinct labels in order, numbered from 0."""
    return numbered(labels.where(F.col(label).isNotNull()).select(label).distinct(), label).withColumnRenamed("at", "code")


def hashed(key: str, salt: str) -> Column:
    return F.md5(F.concat(F.lit(salt + "|"), F.col(key).cast("string")))


def random_split(items: DataFrame, key: str, salt: str = "7", shares=SHARES) -> DataFrame:
    """(key, split): the hash's order, cut at the whole part of each share."""
    table = storage.written(numbered(items.select(key).distinct().withColumn("hash", hashed(key, salt)), "hash", key), "numbered")
    n = table.count()
    a, b = int(shares[0] * n), int(shares[0] * n) + int(shares[1] * n)
    return table.select(key, F.when(F.col("at") < a, NAMES[0]).when(F.col("at") < b, NAMES[1]).otherwise(NAMES[2]).alias("split"))


def _assign(shares):
    """Groups, heaviest first, each to the split that it fills least, by members or by weight, whichever is fuller."""

    def run(batches):
        now = None
        for b in batches:
            n, w, out = np.asarray(b.column("n")).astype(float), np.asarray(b.column("weight")).astype(float), []
            if now is None and b.num_rows:
                now = np.zeros((2, len(shares)))
                goal = np.array(shares) * np.array([[b.column("all_n")[0].as_py()], [b.column("all_weight")[0].as_py() or 1.0]])
            for k in range(b.num_rows):
                fill = np.max((now + [[n[k]], [w[k]]]) / np.maximum(goal, 1e-9), 0)
                at = int(np.argmin(np.where(goal[0] > 0, fill, np.inf))) if (goal[0] > 0).any() else 0
                now[:, at] += n[k], w[k]
                out.append(at)
            yield pa.record_batch([b.column("group"), pa.array(out, pa.int32())], names=["group", "at"])

    return run


def group_split(items: DataFrame, group: str, key: str, weight: str | None = None, shares=SHARES) -> DataFrame:
    """(key, group, split): whole groups, balanced in members and in weight; items without a group go to the first split.

    The rule is sequential over groups, so one task reads a row a group, in order, and keeps nothing but the splits' fill.
    """
    rows = items.select(F.col(key).alias("key"), F.col(group).alias("group"), (F.col(weight) if weight else F.lit(1)).cast("double").alias("w"))
    sums = rows.where("group is not null").groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("weight"), F.min("key").alias("first"))
    sums = storage.written(sums, "groups")
    total = sums.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_weight"))
    ordered = sums.crossJoin(F.broadcast(total)).repartition(1).sortWithinPartitions(F.desc("weight"), F.desc("n"), "first")
    kind = sums.schema["group"].dataType
    dealt = ordered.mapInArrow(_assign(shares), T.StructType([T.StructField("group", kind), T.StructField("at", T.IntegerType())]))
    full = rows.join(dealt, "group", "left")
    name = F.element_at(F.array(*[F.lit(x) for x in NAMES]), F.coalesce("at", F.lit(0)) + 1)
    return full.select(F.col("key").alias(key), F.col("group").alias(group), name.alias("split"))


def stratified_split(rows: DataFrame, key: str, group: str, salt: str = "", share: float = 0.2, test: float = 0.5) -> DataFrame:
    """(key, split): `share` of each group's rows, one at least and never all, is held out; `test` of those, rounded down, for
    testing. Of a single row held out the group's own hash decides. Groups of one row stay in train."""
    order = F.row_number().over(W.partitionBy(group).orderBy(F.md5(F.concat(F.lit(salt), F.col(key).cast("string"))), key))
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("m"))
    held = F.when(F.col("m") < 2, 0).otherwise(F.least(F.col("m") - 1, F.greatest(F.lit(1), F.floor(F.col("m") * share + 0.5))))
    full = rows.select(key, group).withColumn("rn", order).join(sizes, group).withColumn("ne", held)
    alone = (F.col("ne") == 1) & (F.md5(F.col(group).cast("string")) < "8")
    split = F.when(F.col("rn") > F.col("ne"), NAMES[0]).when(alone | ((F.col("ne") > 1) & (F.col("rn") <= F.floor(F.col("ne") * test))), NAMES[2]).otherwise(NAMES[1])
    return full.select(key, split.alias("split"))


def holdout(rows: DataFrame, key: str, group: str, salt: str = "h", share: float = 0.05) -> DataFrame:
    """(key, held): of each group of two rows or more, `share` rounded half to even, one at least and never all."""
    order = F.row_number().over(W.partitionBy(group).orderBy(F.md5(F.concat(F.lit(salt), F.col(key).cast("string"))), key))
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("m"))
    most = F.least(F.greatest(F.bround(F.col("m") * share), F.lit(1)), F.col("m") - 1)
    full = rows.select(key, group).withColumn("rn", order).join(sizes, group)
    return full.select(key, ((F.col("m") >= 2) & (F.col("rn") <= most)).alias("held"))


def capped(rows: DataFrame, key: str, group: str, most: int, salt: str = "s") -> DataFrame:
    """rows (key, group), `most` of each group at most, by hash."""
    order = F.row_number().over(W.partitionBy(group).orderBy(F.md5(F.concat(F.lit(salt), F.col(key).cast("string"))), key))
    return rows.select(key, group).withColumn("rn", order).where(F.col("rn") <= most).drop("rn")


def probe(train: DataFrame, key: str, size: int, salt: str = "probe") -> DataFrame:
    """`size` rows of train, always the same ones: those of the smallest hash."""
    return train.orderBy(hashed(key, salt), key).limit(size)


def leak(split: DataFrame, group: str) -> DataFrame:
    """One row: leaked, the groups that lie both in train and in another split."""
    each = split.where(F.col(group).isNotNull()).groupBy(group).agg(F.max((F.col("split") == NAMES[0]).cast("int")).alias("a"), F.max((F.col("split") != NAMES[0]).cast("int")).alias("b"))
    return each.agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).cast("long").alias("leaked"))


def split(items: DataFrame, kind: str, key: str, group: str | None = None, weight: str | None = None) -> DataFrame:
    """The split of that kind: random, scaffold, moa or signature. A scaffold split that leaks is an error."""
    if kind == "random":
        return random_split(items, key)
    if kind == "signature":
        return stratified_split(items, key, group)
    if kind not in ("scaffold", "moa"):
        raise ValueError(f"unknown split {kind!r}")
    out = storage.written(group_split(items, group, key, weight), "split")
    if kind == "scaffold" and leak(out, group).first().leaked:
        raise ValueError("groups lie in several splits")
    return out


def subset(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """rows whose key is among the wanted ones, which may hold keys that no row has."""
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def deep_bank(train: DataFrame, queries: DataFrame, group: str = "group", truth: str = "truth", least: float | None = None) -> tuple[DataFrame, DataFrame]:
    """train and queries without groups that have fewer than `least` rows of train, or than the mean of all groups."""
    depth = train.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    floor = depth.agg(F.avg("_n").alias("_least")) if least is None else None
    deep = depth.join(F.broadcast(floor)).where("_n >= _least") if floor is not None else depth.where(F.col("_n") >= least)
    deep = storage.written(deep.select(group), "deep")
    return subset(train, deep, group), subset(queries, deep.withColumnRenamed(group, truth), truth)
