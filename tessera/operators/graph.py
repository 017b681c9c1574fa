"""Near-equal vectors as connected components, and groups of equal values."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import storage
from tessera.operators import metric, vectors


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of the edges (a, b): comp is the component's smallest node. Alternating star contraction.

    Smallest neighbours are written before they are joined, so that a node of many edges can be split between tasks.
    """
    e = storage.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    total = lambda x: x.agg(F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    before = total(e)
    while before.c:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = storage.written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "smallest")
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = storage.written(large, "edges")
        low = storage.written(large.groupBy("u").agg(F.min("v").alias("m")), "smallest")
        small = large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = storage.written(small, "edges")
        now = total(e)
        if (now.c, now.s) == (before.c, before.s):
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


def near_groups(rows: DataFrame, key: str, vec: str = "vec", tolerance: float = 1e-6, standardise: bool = True) -> DataFrame:
    """(key, group): components of vectors whose cosine, after each column is standardised, is at least 1 - tolerance.

    group is the smallest key of the component, or null for a vector alone. Equal vectors are one node before any pair is
    formed, so copies cost no pairs; near vectors are linked as in metric.near_links. A column without spread is left at
    zero. A vector that is null or not finite throughout is alone.
    """
    good = rows.where(F.col(key).isNotNull() & vectors.whole(vec)).select(F.col(key).cast("long").alias("key"), F.col(vec).cast("array<double>").alias("vec"))
    nodes = storage.written(good.groupBy("vec").agg(F.min("key").alias("node")), "nodes")
    used = nodes
    if standardise:
        column = good.select(F.posexplode("vec")).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s"))
        stats = column.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m", "s"))), lambda x: F.struct(x["m"].alias("m"), x["s"].alias("s"))).alias("stats"))  # a row a column
        used = nodes.crossJoin(F.broadcast(stats)).select("node", F.zip_with("vec", "stats", lambda x, s: F.when(s["s"] > 1e-9, (x - s["m"]) / s["s"]).otherwise(F.lit(0e0))).alias("vec"))
    unit = storage.written(used.select(F.col("node").alias("id"), vectors.unit("vec").alias("vec")), "unit")
    comp = components(metric.near_links(unit, round((1 - tolerance) * vectors.UNIT)))
    group = nodes.join(comp, "node", "left").select("vec", F.coalesce("comp", "node").alias("group"))
    full = good.join(group, "vec").select("key", "group")
    sizes = full.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    full = full.join(sizes, "group").select("key", F.when(F.col("n") > 1, F.col("group")).alias("group"))
    return rows.select(F.col(key).cast("long").alias("key")).distinct().join(full, "key", "left").select(F.col("key").alias(key), "group")


def equal_groups(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, group): the smallest key among rows of the same value, -1 for a value that occurs once; null is a value too.

    Values meet by 256 bits of their hash, so long texts are not shuffled.
    """
    text = F.coalesce(F.sha2(F.col(value).cast("binary"), 256), F.lit("null"))
    each = rows.select(F.col(key).alias("key"), text.alias("hash"))
    groups = storage.written(each.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first")), "groups")
    return each.join(groups, "hash").select(F.col("key").alias(key), F.when(F.col("n") > 1, F.col("first")).otherwise(F.lit(-1)).alias("group"))
