"""Places in a total order of a whole table, and ranks, medians and quantiles of keys of any size, without a task that sees
all rows or all of a key."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.storage import named, partitions, written

PART = 33  # bits of a place that count rows within a partition


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df as a written table with a long that grows along the order and by one from row to row within a partition.

    Rows are dealt by range, so rows that are equal in all of the order stand in one partition: end the order with a
    column that tells repeated rows apart where these can be many. An empty table stays empty.
    """
    dealt = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    return written(dealt.withColumn(name, F.monotonically_increasing_id()), "placed")


def ranked_rows(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with its rank along the order, a gapless long from 1. What is joined to each row is one number a partition."""
    rows = placed(df, order, "_place")
    part = F.shiftright("_place", PART)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.expr("sum(_n) over (order by _part rows between unbounded preceding and 1 preceding)"), F.lit(0))
    starts = F.broadcast(counts.select("_part", before.alias("_before")))
    out = rows.withColumn("_part", part).join(starts, "_part")
    return out.withColumn(name, F.col("_before") + F.col("_place") - F.shiftleft(F.col("_part"), PART) + 1).drop("_place", "_part", "_before")


LARGE = 250_000  # different values of a key that one task may hold


def _sizes(table: DataFrame, key: list[str]) -> tuple[int, int]:
    """Rows in all, and of the largest key."""
    return tuple(n or 0 for n in table.groupBy(*key).agg(F.count("*").alias("_n")).agg(F.sum("_n"), F.max("_n")).first())


def _together(table: DataFrame, key: list[str], n: int) -> DataFrame:
    """table, of n rows, dealt by key to so many tasks that each holds about LARGE rows or fewer, which windows sort."""
    return table.repartition(partitions(table.sparkSession, math.ceil(n / max(1, LARGE))), *key) if key else table


def cumulative(rows: DataFrame, key: list[str], value: str, weight: str | None = None) -> DataFrame:
    """A table (key..., value, c, rows, below, n): of every different value of each key how many rows have it (or the
    sum of their weights, and how many there are), how many of the key's rows have a smaller one, and how many there are.

    Rows are counted by value first, so one value that most rows have is one row. Where a key has more than LARGE different
    values, values are dealt by range, so that they lie in many tasks, and what goes from range to range is one number a
    key; where none has, a window over each key does. Null keys and values take no part.
    """
    spark, every = rows.sparkSession, [*key, value]
    if clash := {"c", "rows", "below", "n"} & set(every):
        raise ValueError(f"columns of these names are made here: {', '.join(sorted(clash))}")
    known = rows.where(" and ".join(f"`{c}` is not null" for c in every))
    counts = written(known.groupBy(*every).agg((F.sum(weight) if weight else F.count("*")).alias("c"), F.count("*").alias("rows")), "counts")
    n, largest = _sizes(counts, key)
    if largest <= LARGE:
        each = W.partitionBy(*(key or [F.lit(0)]))
        below = F.coalesce(F.sum("c").over(each.orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return _together(counts, key, n).select(*every, "c", "rows", below.alias("below"), F.sum("c").over(each).alias("n"))
    dealt = counts.repartitionByRange(partitions(spark), *every).sortWithinPartitions(*every)
    table = written(dealt.withColumn("_part", F.spark_partition_id()), "values")
    sums = table.groupBy(*key, "_part").agg(F.sum("c").alias("_sum"))
    by = W.partitionBy(*key) if key else W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_sum").over(by.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a key and range
    sums = sums.select(*key, "_part", before.alias("_before"), F.sum("_sum").over(by).alias("n"))
    within = F.coalesce(F.sum("c").over(W.partitionBy(*key, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    full = table.withColumn("_within", within).join(sums, [*key, "_part"])
    return full.select(*every, "c", "rows", (F.col("_within") + F.col("_before")).alias("below"), "n")


def quantile_of(table: DataFrame, key: list[str], value: str, q: float, name: str) -> DataFrame:
    """(key..., name): the quantile, interpolated between neighbours, of a table that cumulative gives."""
    place = F.lit(float(q)) * (F.col("n") - 1)
    at = lambda p: F.max(F.when((F.col("below") <= p) & (p < F.col("below") + F.col("c")), F.col(value).cast("double")))
    ends = table.groupBy(*key).agg(at(F.floor(place)).alias("a"), at(F.ceil(place)).alias("b"), F.max(place - F.floor(place)).alias("f"))
    return ends.select(*key, (F.col("a") + F.col("f") * (F.col("b") - F.col("a"))).alias(name))


def quantile(rows: DataFrame, key: list[str], value: str, q: float, name: str = "q") -> DataFrame:
    """(key..., name): exact quantiles, of a key whose rows no task could hold too. Without a key, one row, null if empty."""
    own = [f"_key{k}" for k in range(len(key))]  # whatever the columns are called
    some = rows.select(*[named(c).alias(o) for c, o in zip(key, own)], named(value).alias("_value"))
    return quantile_of(cumulative(some, own, "_value"), own, "_value", q, "_q").toDF(*key, name)


HEAVY = 1000


def beside(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """rows with the columns of table, one row for each `on`, whose column rows tells how many of rows it will meet.

    The HEAVY rows of table that meet most are broadcast, so that rows of one value needn't come together; no other meets more
    than a HEAVYth of all.
    """
    often = F.broadcast(table.orderBy(F.desc("rows"), *on).limit(HEAVY).drop("rows"))
    many = rows.join(often, on)
    return many.unionByName(rows.join(often.select(*on), on, "left_anti").join(table.drop("rows"), on))


def spearman(rows: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """(by, rho): rank correlation with average ranks for ties; null where a side doesn't vary. Rows that lack a side take
    no part. Where a group has more than LARGE rows, equal pairs are counted first, and where it has more different pairs,
    ranks come from counts of values, so neither a large group nor a common value is one task's work."""
    known = rows.select(F.col(by).alias("g"), F.col(a).alias("a"), F.col(b).alias("b")).where("g is not null and a is not null and b is not null")
    pairs, (n, largest) = known.withColumn("w", F.lit(1)), _sizes(known, ["g"])
    if largest > LARGE:
        pairs = written(known.groupBy("g", "a", "b").agg(F.count("*").alias("w")), "pairs")
        n, largest = _sizes(pairs, ["g"])
    full, mid = pairs, (F.col("n") + 1) / 2
    small = largest <= LARGE
    if small:
        each = W.partitionBy("g")
        mid = (F.sum("w").over(each) + 1) / 2
        rank = lambda x: F.sum("w").over(each.orderBy(x)) - (F.sum("w").over(W.partitionBy("g", x)) - 1) / F.lit(2e0) - mid
        full = _together(pairs, ["g"], n).withColumns({"ra": rank("a"), "rb": rank("b")})
    for side in "" if small else "ab":
        table = cumulative(pairs, ["g"], side, "w")
        rank = (F.col("below") + (F.col("c") + 1) / F.lit(2e0) - mid).alias(f"r{side}")
        full = beside(full, table.select("g", side, rank, "rows"), ["g", side])
    sums = full.groupBy("g").agg(*[F.sum(F.col("w") * F.col(x) * F.col(y)).alias(x + y) for x, y in (("ra", "ra"), ("rb", "rb"), ("ra", "rb"))])
    rho = F.when((F.col("rara") > 0) & (F.col("rbrb") > 0), F.col("rarb") / F.sqrt(F.nullif(F.col("rara"), F.lit(0e0))) / F.sqrt(F.nullif(F.col("rbrb"), F.lit(0e0))))
    return sums.select(F.col("g").alias(by), rho.alias("rho"))
