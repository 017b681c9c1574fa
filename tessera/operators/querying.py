"""A user's query from file to ranked hits: read, resolve genes, guard, fill, scale, rank, list.

Guards raise ValueError with what is wrong; they look at one row of aggregates.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera import storage
from tessera.operators import measures as ms
from tessera.operators import vectors
from tessera.sources import tables

LEAST_COVERAGE, LEAST_NEGATIVE = 0.5, 0.05


def cells(spark: SparkSession, path: str, genes: DataFrame) -> DataFrame:
    """(gene, sample, v) of a query file, for genes that are known; a file without any is an error."""
    got = tables.resolved(tables.query_table(spark, path), genes).select(F.col("gene_id").alias("gene"), "sample", F.col("value").alias("v"))
    got = storage.written(got, "query")
    if got.isEmpty():
        raise ValueError(f"{path}: no row names a known gene")
    return got


def coverage(cells_: DataFrame, genes: DataFrame) -> float:
    """Share of the genes that have a value in every sample."""
    full = ms.present(cells_).where("present")
    n = genes.select("gene_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    return full.agg(F.count(F.lit(1)).alias("c")).crossJoin(n).select(F.col("c") / F.greatest("n", F.lit(1))).first()[0]


def covered(cells_: DataFrame, genes: DataFrame, path: str) -> DataFrame:
    """cells of genes that all samples have; too few of them are refused."""
    share = coverage(cells_, genes)
    if share < LEAST_COVERAGE:
        raise ValueError(f"{path}: only {share:.0%} of the genes are there in every sample")
    return cells_.join(ms.present(cells_).where("present").select("gene"), "gene")


def as_vectors(full: DataFrame, genes: DataFrame, value: str = "v") -> DataFrame:
    """(query, vec): values of each sample in the genes' order, 0 where a gene has none."""
    order = genes.select(F.col("gene_id").alias("gene"), "ord").dropDuplicates(["gene"])
    cross = F.broadcast(full.select("sample").distinct()).crossJoin(order)
    got = cross.join(full, ["gene", "sample"], "left").select("sample", "ord", F.coalesce(value, F.lit(0e0)).alias("x"))
    lists = got.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("ord", "x"))).alias("a"))  # a value a gene
    return lists.select(F.col("sample").alias("query"), F.transform("a", lambda p: p["x"]).alias("vec"))


def differential(spark: SparkSession, path: str, genes: DataFrame, standardise: bool = False) -> DataFrame:
    """(query, vec) of a file of contrasts. Values without enough negatives are raw expression and are refused."""
    got = covered(cells(spark, path, genes), genes, path)
    negative = got.agg(F.avg((F.col("v") < 0).cast("double"))).first()[0] or 0.0
    if negative < LEAST_NEGATIVE:
        raise ValueError(f"{path}: {negative:.1%} of the values are negative, so these are no contrasts; give a control as well")
    if standardise:
        z = ms.zscores(got, genes.select(F.col("gene_id").alias("gene")))
        return as_vectors(z, genes, "z")
    return as_vectors(got, genes)


def contrast(spark: SparkSession, treated: str, control: str, genes: DataFrame, log: bool = False, pooled: bool = True) -> tuple[DataFrame, DataFrame]:
    """(query, vec), one row, of treated against control, and the reliability of the replicates (see measures.reliability).

    The contrast of means is scaled by the median and MAD of all genes' contrasts, or, unpooled, of each gene's controls.
    """
    sides = {}
    for side, path in (("treated", treated), ("control", control)):
        got = cells(spark, path, genes)
        if log:
            low = got.agg(F.min("v")).first()[0]
            if low is not None and low < 0:
                raise ValueError(f"{path}: negative values have no logarithm")
            got = got.withColumn("v", F.log2(F.col("v") + 1))
        sides[side] = covered(got, genes, path)
    both = sides["treated"].select("gene").distinct().join(sides["control"].select("gene").distinct(), "gene")
    if coverage(both.select("gene", F.lit("both").alias("sample"), F.lit(0e0).alias("v")), genes) < LEAST_COVERAGE:
        raise ValueError("too few genes are in both files")
    reps = None
    for side, df in sides.items():
        one = df.join(both, "gene").select("gene", F.lit(side).alias("side"), F.col("sample").alias("rep"), "v")
        reps = one if reps is None else reps.unionByName(one)
    reps = storage.written(reps, "replicates")
    mean = reps.groupBy("gene").agg(F.avg(F.when(F.col("side") == "treated", F.col("v"))).alias("t"), F.avg(F.when(F.col("side") == "control", F.col("v"))).alias("c"))
    if pooled:
        delta = mean.select("gene", (F.col("t") - F.col("c")).alias("x"), F.lit(0).alias("all"))
        got = delta.join(F.broadcast(ms.spread(delta, ["all"], "x")), "all")  # one row
        z = got.select("gene", ms.robust_z(F.col("x"), F.col("median"), F.col("mad")).alias("v"))
    else:
        control_ = ms.spread(reps.where("side = 'control'"), ["gene"], "v")
        z = mean.join(control_, "gene").select("gene", ms.robust_z(F.col("t"), F.col("median"), F.col("mad")).alias("v"))
    return as_vectors(z.withColumn("sample", F.lit("contrast")), genes), ms.reliability(reps)


def profile(queries: DataFrame) -> DataFrame:
    """(query, mean, sd, top, spread_ok) of each query."""
    got = queries.select("query", F.explode("vec").alias("v")).groupBy("query").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.max(F.abs("v")).alias("top"))
    return got.withColumn("spread_ok", (F.col("sd") > 0.2) & (F.col("sd") < 12))


def hits(queries: DataFrame, bank: DataFrame, k: int | None = 25) -> DataFrame:
    """(query, rank, compound_id, cosine, moa, target, smiles): the k best of bank (cand, vec, moa, targets, smiles), or all."""
    asks = queries.select("query", F.lit(None).alias("truth"), "vec")
    top = vectors.ranked(asks, bank.select("cand", "vec"), bank.count() if k is None else k, once=True).topk
    named = top.join(bank.select("cand", "moa", "targets", "smiles"), "cand")
    return named.select("query", F.col("r").alias("rank"), F.col("cand").alias("compound_id"), (F.col("u") / vectors.UNIT).alias("cosine"), "moa", F.array_join("targets", ",").alias("target"), "smiles")


def listing(hits_: DataFrame) -> DataFrame:
    """hits as short lines. Widths 33, 11 and 40."""
    cut = lambda c, n: F.coalesce(F.substring(c, 1, n), F.lit(""))
    line = F.format_string("%3d %-14s %+.3f %-33s %-11s %s", "rank", F.col("compound_id").cast("string"), "cosine", cut("moa", 33), cut("target", 11), cut("smiles", 40))
    return hits_.select("query", "rank", line.alias("line"))


def agreement(hits_: DataFrame, k: int = 10) -> DataFrame:
    """(query, moa, n): the commonest mechanism of the k best; equally common ones go to the first in order."""
    n = hits_.where((F.col("rank") <= k) & F.col("moa").isNotNull() & (F.col("moa") != "")).groupBy("query", "moa").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("at", F.row_number().over(W.partitionBy("query").orderBy(F.desc("n"), "moa"))).where("at = 1").drop("at")
