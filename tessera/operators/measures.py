"""Census, scaling and contrast of measurements, as operators on tables of any size.

Nulls are no measurement and are skipped; a measure without any is null. Divisions by nothing give null, never an error.
"""

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera import storage
from tessera.operators import order
from tessera.operators.vectors import listed, matrix

# What stands for no value, what stands for true, and the factor that makes a MAD a standard deviation.
PLACEHOLDERS = ["restricted", "nan", "", "none", "-666"]
TRUE = ["1", "1.0", "true", "True", "TRUE", "t", "y", "yes"]
MAD = 1.4826
SIZES, QUANTILES = (1, 2, 3, 5, 10, 20, 50), (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)


def valued(column: str | Column) -> Column:
    """The text, or null where it is a placeholder."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(~F.lower(F.trim(c)).isin(PLACEHOLDERS), c)


def truthy(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string").isin(TRUE)


def number(column: str | Column) -> Column:
    """The first number in a text; null if there is none."""
    return F.regexp_extract(column, r"([\d.]+)", 1).try_cast("double")


def log_scaled(x: Column, fill: float) -> Column:
    return F.log10(F.coalesce(x, F.lit(fill)) + 1e-3)


def unlogged(x: Column) -> Column:
    return F.pow(F.lit(10e0), x) - 1e-3


def many(column: str, mark: str = "|") -> Column:
    """The values of a text parted by the mark, without empty ones."""
    return F.filter(F.split(column, F.lit("\\" + mark)), lambda x: x != "")


def human_size(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("kB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1000**k, F.format_string(f"%.1f {unit}", F.floor(n / float(1000**k // 10)) / 10e0)).otherwise(out)
    return out


def cascade(rows: DataFrame, item: str, stages: list[tuple[str, Column | None]]) -> DataFrame:
    """(stage_no, stage, rows, items, note) after each stage and all before it; a stage without a condition is skipped.

    One pass: flags are summed by item first, so no count of distinct items shuffles rows.
    """
    flag, flags = F.lit(True), []
    for _, c in stages:
        flag = flag & F.coalesce(c, F.lit(False)) if c is not None else flag
        flags.append(flag)
    each = rows.groupBy(item).agg(*[F.sum(f.cast("long")).alias(f"c{k}") for k, f in enumerate(flags)])
    one = each.agg(*[F.struct(F.lit(k + 1).cast("long").alias("stage_no"), F.lit(stages[k][0]).alias("stage"), F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias("rows"), F.coalesce(F.sum((F.col(f"c{k}") > 0).cast("long")), F.lit(0)).alias("items"), F.lit("" if stages[k][1] is not None else "skipped").alias("note")).alias(f"s{k}") for k in range(len(stages))])
    return one.select(F.inline(F.array(*[f"s{k}" for k in range(len(stages))])))


def sweep(rows: DataFrame, item: str, value: str, thresholds: list[float]) -> DataFrame:
    """(threshold, rows, items) with the value at the threshold or above it. One pass, by item first."""
    each = rows.groupBy(item).agg(*[F.sum((F.col(value) >= t).cast("long")).alias(f"c{k}") for k, t in enumerate(thresholds)])
    zero = lambda c: F.coalesce(c, F.lit(0))
    one = each.agg(*[F.struct(F.lit(float(t)).alias("threshold"), zero(F.sum(f"c{k}")).alias("rows"), zero(F.sum((F.col(f"c{k}") > 0).cast("long"))).alias("items")).alias(f"s{k}") for k, t in enumerate(thresholds)])
    return one.select(F.inline(F.array(*[f"s{k}" for k in range(len(thresholds))])))


def depths(rows: DataFrame, item: str, bank: DataFrame | None = None) -> DataFrame:
    """(item, n): rows of each item; with a bank, 0 for its items without any."""
    n = rows.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    return n if bank is None else bank.select(item).join(n, item, "left").select(item, F.coalesce("n", F.lit(0)).alias("n"))


def depth_stats(each: DataFrame) -> DataFrame:
    """One row: quantiles, the largest, and how many items reach each size. each (item, n)."""
    hist = each.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    stats = [F.round(F.percentile("n", F.lit(q), F.col("c")), 6).alias(f"p{round(100 * q)}") for q in QUANTILES]
    return hist.agg(*stats, F.max("n").alias("largest"), *[F.coalesce(F.sum(F.when(F.col("n") >= s, F.col("c"))), F.lit(0)).alias(f"ge{s}") for s in SIZES])


def coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled, fraction, kinds): values of each column that are neither null, blank nor a placeholder."""
    v = {c: valued(F.col(c).cast("string")) for c in columns}
    one = rows.agg(*[F.struct(F.lit(c).alias("column"), F.count(x).alias("filled"), F.round(F.count(x) / F.nullif(F.count(F.lit(1)), F.lit(0)), 6).alias("fraction"), F.count_distinct(x).alias("kinds")).alias(f"s{k}") for k, (c, x) in enumerate(v.items())])
    return one.select(F.inline(F.array(*[f"s{k}" for k in range(len(columns))])))


def group_statistics(rows: DataFrame, group: str) -> DataFrame:
    """One row: groups, the fraction of one member, and the largest."""
    sizes = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("groups"), F.round(F.avg((F.col("n") == 1).cast("double")), 6).alias("singletons"), F.max("n").alias("largest"))


def aliases(*kinds: tuple[DataFrame, str, str]) -> DataFrame:
    """(alias, id) of tables with an alias and an id each: earlier tables win, then smaller ids; blank and `-` name nothing."""
    out = None
    for k, (df, alias, id_) in enumerate(kinds):
        one = df.select(F.upper(F.trim(alias)).alias("alias"), F.struct(F.lit(k).alias("k"), F.col(id_).cast("long").alias("id")).alias("at"))
        out = one if out is None else out.unionByName(one)
    return out.where("alias not in ('', '-')").groupBy("alias").agg(F.min("at.id").alias("low"), F.min("at").alias("at")).select("alias", "at.id")


def medians(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key..., median), exact, from counts of values (see order.cumulative): neither a key nor a value with most rows is a
    bottleneck."""
    return order.quantile(rows, key, value, 0.5, "median")


def spread(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key..., median, mad) of each key. The distances from the median are taken of the different values, with their counts."""
    own = [f"_key{k}" for k in range(len(key))]  # whatever the columns are called
    counts = order.cumulative(rows.select(*[storage.named(c).alias(o) for c, o in zip(key, own)], storage.named(value).alias("_value")), own, "_value")
    mid = storage.written(order.quantile_of(counts, own, "_value", 0.5, "_median"), "medians")
    off = (counts.join(mid, own) if key else counts.crossJoin(mid)).select(*own, F.abs(F.col("_value") - F.col("_median")).alias("_off"), F.col("c").alias("_weight"))
    mad = order.quantile_of(order.cumulative(off, own, "_off", "_weight"), own, "_off", 0.5, "_mad")
    return (mid.join(mad, own) if key else mid.crossJoin(mad)).toDF(*key, "median", "mad")


def robust_z(x: Column, median: Column, mad: Column, least: float = 1e-9) -> Column:
    return (x - median) / F.greatest(MAD * mad, F.lit(least))


def _robust(names: list[str], vec: str):
    def run(batches):
        for b in batches:
            v = matrix(b.column(vec))
            off = v - np.median(v, 1, keepdims=True) if v.size else v
            z = off / (MAD * np.median(np.abs(off), 1, keepdims=True) + 1e-6) if v.size else v
            yield pa.record_batch([listed(z) if c == vec else b.column(c) for c in names], names=names)

    return run


def robust_rows(rows: DataFrame, vec: str = "vec") -> DataFrame:
    """rows with vec less its own median, over its MAD, with 1e-6 in the divisor. Rows without a vector stay out."""
    good = rows.where(F.col(vec).isNotNull()).withColumn(vec, F.col(vec).cast("array<double>"))
    return good.mapInArrow(_robust(good.columns, vec), good.schema)


def filled(cells: DataFrame, genes: DataFrame) -> DataFrame:
    """(gene, sample, v): every gene of genes for every sample of cells (gene, sample, v), 0 where there is no value."""
    return F.broadcast(cells.select("sample").distinct()).crossJoin(genes.select("gene").distinct()).join(cells, ["gene", "sample"], "left").select("gene", "sample", F.coalesce("v", F.lit(0e0)).alias("v"))


def zscores(cells: DataFrame, genes: DataFrame) -> DataFrame:
    """(gene, sample, z) over each sample's filled values, the deviation 1e-6 at least. Sums, not windows, so a sample may be large."""
    full = filled(cells, genes)
    stats = full.groupBy("sample").agg(F.avg("v").alias("m"), F.greatest(F.stddev_pop("v"), F.lit(1e-6)).alias("s"))
    return full.join(F.broadcast(stats), "sample").select("gene", "sample", ((F.col("v") - F.col("m")) / F.col("s")).alias("z"))


def profile(cells: DataFrame) -> DataFrame:
    """(sample, mean, sd, top, negative, raw, spread_ok): guards against raw expression and against odd scales."""
    got = cells.groupBy("sample").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.max(F.abs("v")).alias("top"), F.avg((F.col("v") < 0).cast("double")).alias("negative"))
    return got.withColumns({"raw": F.col("negative") < 0.05, "spread_ok": (F.col("sd") > 0.2) & (F.col("sd") < 12)})


def present(cells: DataFrame) -> DataFrame:
    """(gene, present): whether a gene has a value in every sample."""
    n = F.broadcast(cells.select("sample").distinct().agg(F.count(F.lit(1)).alias("n")))
    return cells.groupBy("gene").agg(F.count("v").alias("c")).crossJoin(n).select("gene", (F.col("c") == F.col("n")).alias("present"))


def correlation(a: str, b: str) -> Column:
    """Pearson's, as an aggregate; null where either doesn't vary."""
    return F.covar_pop(a, b) / F.nullif(F.when(F.least(F.stddev_pop(a), F.stddev_pop(b)) > 1e-12, F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0e0))


def average_rank(by: list[str], value: str) -> Column:
    return F.rank().over(W.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*by, value)) - 1) / F.lit(2e0)


def spearman(rows: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """(by, rho) with average ranks for ties; null where a side doesn't vary. See order.spearman."""
    return order.spearman(rows, by, a, b)


def pairing(m: int, k: int) -> tuple[int, int, int, int]:
    """The m-th pairing (i, a, j, b) of k replicates a side: i < j among the treated, a and b different among the controls."""
    p, o = divmod(m, k * (k - 1))
    j = (1 + math.isqrt(1 + 8 * p)) // 2
    a, b = divmod(o, k - 1)
    return p - j * (j - 1) // 2, a, j, b + (b >= a)


def pairings(k: int, most: int, seed: int = 0) -> list[tuple[int, int, int, int]]:
    """All pairings, or `most` different ones where there are more: the numbers that a keyed permutation takes the first to."""
    full = k * k * (k - 1) * (k - 1) // 2
    if full <= most:
        return [pairing(m, k) for m in range(full)]
    key = int.from_bytes(hashlib.sha256(f"pairings:{seed}".encode()).digest()[:16])
    step, shift = key % full, (key >> 64) % full
    while math.gcd(step, full) != 1:
        step = (step + 1) % full
    return [pairing((step * m + shift) % full, k) for m in range(most)]


def reliability(cells: DataFrame, most: int = 5000) -> DataFrame:
    """One row: k, pairings, single, stepped, verdict: how well contrasts of disjoint replicates agree.

    cells (gene, side: treated or control, rep, v). k is the smaller side's replicates, and of each side the first k in
    order are used. Each pairing compares treated i less control a with treated j less control b, i < j and a <> b, by
    Spearman over genes that all replicates have; of more than `most` pairings as many are drawn, without listing the
    others. Those without a correlation don't count. Under two replicates on a side there is no reliability.
    """
    spark = cells.sparkSession
    schema = "k long, pairings long, single double, stepped double, verdict string"
    reps = cells.where("side in ('treated', 'control')").groupBy("side").agg(F.count_distinct("rep").alias("n")).collect()  # two rows
    k, every = min((r.n for r in reps), default=0) if len(reps) == 2 else 0, sum(r.n for r in reps)
    if k < 2:
        return spark.createDataFrame([(k, 0, None, None, None)], schema)
    ok = cells.where("v is not null").groupBy("gene").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") == every).select("gene")
    drawn = pairings(k, most)
    pairs = F.broadcast(spark.createDataFrame(drawn, "t1 long, c1 long, t2 long, c2 long"))  # `most` rows
    contrasts = F.broadcast(spark.createDataFrame(sorted({x for t1, c1, t2, c2 in drawn for x in ((t1, c1), (t2, c2))}), "t long, c long"))
    names = cells.select("side", "rep").distinct()
    names = names.withColumn("at", (F.row_number().over(W.partitionBy("side").orderBy("rep")) - 1).cast("long")).where(F.col("at") < k)
    some = cells.join(ok, "gene").join(F.broadcast(names), ["side", "rep"])  # a row a replicate
    t, c = (some.where(F.col("side") == s).select("gene", F.col("at").alias(r), F.col("v").alias(f"v{r}")) for s, r in (("treated", "t"), ("control", "c")))
    delta = t.join(contrasts, "t").join(c, ["gene", "c"]).select("gene", "t", "c", (F.col("vt") - F.col("vc")).alias("v"))
    ranks = storage.written(delta.select("gene", "t", "c", average_rank(["t", "c"], "v").alias("r")), "ranks")
    one = ranks.select(F.col("t").alias("t1"), F.col("c").alias("c1"), "gene", F.col("r").alias("a"))
    two = ranks.select(F.col("t").alias("t2"), F.col("c").alias("c2"), "gene", F.col("r").alias("b"))
    rho = one.join(pairs, ["t1", "c1"]).join(two, ["t2", "c2", "gene"]).groupBy("t1", "c1", "t2", "c2").agg(correlation("a", "b").alias("rho"))
    mean = rho.agg(F.count("rho").alias("pairings"), F.avg("rho").alias("single"))
    stepped = F.when(F.col("single") > -1 / (k - 1), k * F.col("single") / (1 + (k - 1) * F.col("single")))
    return mean.select(F.lit(k).cast("long").alias("k"), "pairings", "single", stepped.alias("stepped")).withColumn("verdict", verdict(F.col("stepped")))


def verdict(c: Column) -> Column:
    return F.when(c >= 0.4, "high").when(c >= 0.15, "moderate").when(c.isNotNull(), "low")


def scaler(rows: DataFrame, columns: list[str], train: Column, least: float = 1e-3, clip: float = 10.0) -> DataFrame:
    """rows with the columns centred and scaled by the training rows; one that hardly varies there is centred only."""
    stats = rows.agg(*[F.avg(F.when(train, F.col(c).cast("double"))).alias(f"_m{k}") for k, c in enumerate(columns)], *[F.stddev_pop(F.when(train, F.col(c).cast("double"))).alias(f"_s{k}") for k, c in enumerate(columns)])
    full = rows.crossJoin(F.broadcast(stats))  # one row
    scale = lambda k: F.when(F.col(f"_s{k}") < least, F.lit(1e0)).otherwise(F.col(f"_s{k}"))
    new = {c: F.greatest(F.least((F.col(c) - F.col(f"_m{k}")) / scale(k), F.lit(clip)), F.lit(-clip)) for k, c in enumerate(columns)}
    return full.withColumns(new).drop(*[f"_{x}{k}" for x in "ms" for k in range(len(columns))])


def label_pairs(rows: DataFrame, item: str, labels: list[list[str]]) -> DataFrame:
    """(x, y), x < y, of items alike in all columns of one of the lists; a null label is like nothing."""
    out = None
    for cols in labels:
        a = rows.where(F.concat_ws("", *cols).isNotNull()).select(F.col(item).alias("x"), *cols)
        one = a.join(a.withColumnRenamed("x", "y"), cols).where("x < y").select("x", "y")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def later_siblings(rows: DataFrame, item: str, labels: list[list[str]]) -> DataFrame:
    """(item, siblings): how many items after it in order are alike in all columns of one of the lists; a null label is like
    nothing. Counted class by class, no pair is formed: items alike by several lists are counted in each and taken off in
    the classes of the lists together. Items without any are left out; items have a value of their own each.
    """
    out = None
    for n in range(1, len(labels) + 1):
        for some in itertools.combinations(labels, n):
            cols = sorted({c for one in some for c in one})
            own = [f"_label{k}" for k in range(len(cols))]
            places = order.cumulative(rows.select(*[storage.named(c).alias(o) for c, o in zip(cols, own)], storage.named(item).alias("_item")), own, "_item")
            one = places.select("_item", ((-1) ** (n + 1) * (F.col("n") - F.col("below") - 1)).alias("s"))
            out = one if out is None else out.unionByName(one)
    return out.groupBy(F.col("_item").alias(item)).agg(F.sum("s").cast("long").alias("siblings")).where("siblings > 0")


def shared_values(rows: DataFrame, item: str, values: str) -> DataFrame:
    """(x, y, shared), x < y, of items whose arrays of values overlap, and by how many."""
    each = rows.select(F.col(item).alias("x"), F.explode(F.array_distinct(values)).alias("v")).where("v is not null")
    return each.join(each.withColumnRenamed("x", "y"), "v").where("x < y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("shared"))


def finite(vec: str) -> Column:
    """Whether all components of a vector are numbers."""
    return F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def first_seen(rows: DataFrame, label: str, order: str) -> DataFrame:
    """(label, code): labels numbered from 0 by the order in which they first appear; null has no code."""
    from tessera.operators.splits import numbered

    first = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.min(order).alias("first"))
    return numbered(first, "first", label).select(label, F.col("at").alias("code"))


def learning_rate(steps: DataFrame, warm: int, total: int) -> DataFrame:
    """(step, scale): linear to 1, then a half cosine to 0, where it stays. steps (step)."""
    s = F.col("step")
    down = 0.5 * (1 + F.cos(F.pi() * F.least(F.lit(1e0), (s - warm) / F.lit(float(max(1, total - warm))))))
    return steps.select("step", F.when(s < warm, (s + 1) / F.lit(float(max(1, warm)))).otherwise(down).alias("scale"))


def sizes(rows: DataFrame, width: int = 978, bytes_each: int = 4) -> DataFrame:
    """One row: n and gb of a matrix of that many rows."""
    return rows.agg(F.count(F.lit(1)).alias("n")).select("n", F.round(F.col("n") * float(width) * bytes_each / 1e9, 6).alias("gb"))


def split_counts(rows: DataFrame, split: str, item: str, keep: Column) -> DataFrame:
    """(split, before, after, items_before, items_after, empty): what a filter leaves of each split."""
    each = rows.groupBy(split, item).agg(F.count(F.lit(1)).alias("b"), F.sum(keep.cast("long")).alias("a"))
    got = each.groupBy(split).agg(F.sum("b").alias("before"), F.sum("a").alias("after"), F.count(F.lit(1)).alias("items_before"), F.sum((F.col("a") > 0).cast("long")).alias("items_after"))
    return got.withColumn("empty", F.col("after") == 0)


def filtered_by_split(rows: DataFrame, split: str, item: str, keep: Column, only: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows that a filter leaves, counts by split as split_counts gives them, and (split, item) of items that lost all rows.

    With only, rows of other splits stay as they are. A split that is left without rows is an error that names it.
    """
    holds = F.coalesce(keep, F.lit(False))
    holds = holds if only is None else holds | (F.col(split) != only)
    counts = storage.written(split_counts(rows, split, item, holds), "splits")
    if empty := [str(r[0]) for r in counts.where("empty").select(split).orderBy(split).collect()]:  # a row a split
        raise ValueError(f"no rows are left in {', '.join(empty)}")
    lost = rows.groupBy(split, item).agg(F.max(holds.cast("int")).alias("_kept")).where("_kept = 0").select(split, item)
    return rows.where(holds), counts, lost
