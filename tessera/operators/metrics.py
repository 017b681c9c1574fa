"""Metrics of a ranking: ranks (query, truth, rank0) and topk (query, r, cand, u), as vectors.ranked gives them.

Micro means weigh every query alike, macro means every true candidate. Without queries all metrics are null.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KS = (1, 5, 10, 20, 50)
PLACES = 10


def _flag(condition: Column) -> Column:
    return condition.cast("int").cast("double")


def recall(ranks: DataFrame, ks=KS) -> DataFrame:
    """One row: recall_k of every k, mrr and n_queries, over queries."""
    return ranks.agg(*[F.round(F.avg(_flag(F.col("rank0") < k)), PLACES).alias(f"recall_{k}") for k in ks], F.round(F.avg(1 / (F.col("rank0") + 1)), PLACES).alias("mrr"), F.count(F.lit(1)).alias("n_queries"))


def per_truth(ranks: DataFrame, ks=KS) -> DataFrame:
    """(truth, depth, recall_k, mrr): a row for each true candidate."""
    return ranks.groupBy("truth").agg(F.count(F.lit(1)).alias("depth"), *[F.avg(_flag(F.col("rank0") < k)).alias(f"recall_{k}") for k in ks], F.avg(1 / (F.col("rank0") + 1)).alias("mrr"))


def macro_recall(ranks: DataFrame, ks=KS) -> DataFrame:
    """One row: macro_recall_k, macro_mrr and n_truths."""
    each = per_truth(ranks, ks)
    return each.agg(*[F.round(F.avg(f"recall_{k}"), PLACES).alias(f"macro_recall_{k}") for k in ks], F.round(F.avg("mrr"), PLACES).alias("macro_mrr"), F.count(F.lit(1)).alias("n_truths"))


def group_hit(topk: DataFrame, ranks: DataFrame, labels: DataFrame, ks=KS, prefix: str = "group") -> DataFrame:
    """One row: whether the k best hold any candidate of the truth's label, as a mean over queries and over true candidates.

    labels (cand, label): a null or empty label matches nothing, and a query whose truth has none is skipped and counted.
    """
    known = labels.where("label is not null and label <> ''").select("cand", "label")
    theirs = known.select(F.col("cand").alias("truth"), F.col("label").alias("want"))
    asked = ranks.select("query", "truth").join(theirs, "truth", "left")
    near = topk.where(F.col("r") <= max(ks)).join(known, "cand").join(asked.where("want is not null"), "query").where("label = want")
    first = near.groupBy("query").agg(F.min("r").alias("first"))
    each = asked.join(first, "query", "left")
    hit = [_flag(F.coalesce(F.col("first") <= k, F.lit(False))).alias(f"h{k}") for k in ks]
    scored = each.select("truth", F.col("want").isNotNull().alias("scored"), *hit)
    by = scored.groupBy("truth", "scored").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"h{k}").alias(f"h{k}") for k in ks])
    some = F.col("scored")
    out = []
    for k in ks:
        out.append(F.round(F.sum(F.when(some, F.col(f"h{k}"))) / F.sum(F.when(some, F.col("n"))), PLACES).alias(f"{prefix}_hit_{k}"))
        out.append(F.round(F.avg(F.when(some, F.col(f"h{k}") / F.col("n"))), PLACES).alias(f"{prefix}_macro_hit_{k}"))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return by.agg(*out, count(some).alias(f"{prefix}_scored"), count(~some).alias(f"{prefix}_skipped"))


def bundle(ranking, moa: DataFrame, target: DataFrame, ks=KS, prefix: str = "") -> DataFrame:
    """One row with the macro and micro metrics and both group hits, their names prefixed."""
    parts = [macro_recall(ranking.ranks, ks), recall(ranking.ranks, ks), group_hit(ranking.topk, ranking.ranks, moa, ks, "moa"), group_hit(ranking.topk, ranking.ranks, target, ks, "target")]
    one = reduce(lambda a, b: a.crossJoin(b), parts)  # four tables of one row
    return one.select(*[F.col(c).alias(prefix + c) for c in one.columns])


def chance(n_bank: DataFrame, ks=KS) -> DataFrame:
    """(k, recall) of a random order of the n candidates of the one-row table n_bank."""
    one = n_bank.select("n", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    return one.select(F.col("k").cast("long").alias("k"), F.round(F.least(F.col("k"), F.col("n")) / F.col("n"), PLACES).alias("recall"))


def comparison(rows: dict[str, DataFrame], ks=KS, prefix: str = "macro_") -> DataFrame:
    """(place, name, recall at each k): one-row tables of metrics one under another; those without the metric are left out."""
    names = [f"{prefix}recall_{k}" for k in ks]
    have = [(k, n, df) for k, (n, df) in enumerate(rows.items()) if any(c in df.columns for c in names)]
    each = [df.select(F.lit(k).cast("long").alias("place"), F.lit(n).alias("name"), *[(F.col(c) if c in df.columns else F.lit(None)).cast("double").alias(c) for c in names]) for k, n, df in have]
    return reduce(DataFrame.unionByName, each)


def occupancy(topk: DataFrame, bank: DataFrame, k: int) -> DataFrame:
    """(cand, n): how often each candidate of the bank is among the k best; never is 0."""
    met = topk.where(F.col("r") <= k).groupBy("cand").agg(F.count(F.lit(1)).alias("met"))
    return bank.select("cand").join(met, "cand", "left").select("cand", F.coalesce("met", F.lit(0)).cast("long").alias("n"))


def hubness(topk: DataFrame, bank: DataFrame, k: int) -> DataFrame:
    """One row: largest, p99, median, never (count and fraction), top_share of the best hundredth, and the even share.

    The share is read off the counts' histogram, so candidates are never ordered in one task.
    """
    each = occupancy(topk, bank, k)
    stats = each.agg(F.max("n").alias("largest"), F.round(F.percentile("n", F.lit(0.99)), PLACES).alias("p99"), F.round(F.median("n"), PLACES).alias("median"), F.sum((F.col("n") == 0).cast("long")).alias("never"), F.count(F.lit(1)).alias("bank"), F.sum("n").alias("total"))
    hist = each.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    above = W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1)  # a row for each different count
    ranked = hist.withColumn("before", F.coalesce(F.sum("c").over(above), F.lit(0)))
    room = F.greatest(F.lit(1), F.floor(F.col("bank") / 100))
    top = ranked.crossJoin(F.broadcast(stats.select("bank"))).agg(F.sum(F.col("n") * F.greatest(F.lit(0), F.least(F.col("c"), room - F.col("before")))).alias("top"))
    one = stats.crossJoin(top)
    share = F.round(F.col("top") / F.nullif(F.col("total"), F.lit(0)), PLACES)
    return one.select("largest", "p99", "median", "never", F.round(F.col("never") / F.col("bank"), PLACES).alias("never_fraction"), share.alias("top_share"), F.round(F.col("total") / F.col("bank"), PLACES).alias("even_share"))


def breakdown(rows: DataFrame, value: str, edges: list[float], model: str = "model", baseline: str = "baseline", labels: list[str] | None = None) -> DataFrame:
    """(bin, label, n, model, baseline, ratio) of half-open bins, the last one closed; empty bins have n 0.

    The ratio is infinite where only the baseline is 0, and NaN where both are.
    """
    spark = rows.sparkSession
    bins = [(k, labels[k] if labels else f"{a:g}-{b:g}", float(a), float(b), k == len(edges) - 2) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    table = F.broadcast(spark.createDataFrame(bins, "bin long, label string, lo double, hi double, last boolean"))
    inside = (F.col(value) >= F.col("lo")) & ((F.col(value) < F.col("hi")) | (F.col("last") & (F.col(value) <= F.col("hi"))))
    got = rows.join(table, inside).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(model).alias("m"), F.avg(baseline).alias("b"))
    full = table.join(got, "bin", "left")
    ratio = F.when(F.col("b") > 0, F.round(F.col("m") / F.nullif(F.col("b"), F.lit(0.0)), PLACES)).when(F.col("m") > 0, F.lit(float("inf"))).when(F.col("n") > 0, F.lit(float("nan")))
    return full.select("bin", "label", F.coalesce("n", F.lit(0)).alias("n"), F.round("m", PLACES).alias("model"), F.round("b", PLACES).alias("baseline"), ratio.alias("ratio"))


# The bins of donors' similarities and of depths.
SIMILARITIES, DEPTHS = (0, 0.4, 0.5, 0.6, 0.7, 0.8, 1), (1, 2, 4, 8, 20, 60)


def _two(model: DataFrame, baseline: DataFrame, k: int) -> DataFrame:
    """(truth, model, baseline): recall at k of each true candidate by two rankings' ranks."""
    a, b = (per_truth(r, (k,)).select("truth", F.col(f"recall_{k}").alias(n)) for r, n in ((model, "model"), (baseline, "baseline")))
    return a.join(b, "truth")


def by_similarity(model: DataFrame, baseline: DataFrame, donors: DataFrame, k: int = 10) -> DataFrame:
    """breakdown of two rankings' recall at k by how similar the nearest donor is. donors (truth, similarity)."""
    return breakdown(_two(model, baseline, k).join(donors.select("truth", "similarity"), "truth"), "similarity", list(SIMILARITIES))


def by_depth(model: DataFrame, baseline: DataFrame, depths: DataFrame, k: int = 10, most: float = 1_000_000) -> DataFrame:
    """breakdown of two rankings' recall at k by the rows that a candidate was fitted on. depths (truth, n). The bank is whole."""
    return breakdown(_two(model, baseline, k).join(depths.select("truth", "n"), "truth"), "n", [*DEPTHS, most])


def modal_label(topk: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """(query, label, n): the commonest label of the k best; equally common ones go to the first in order."""
    met = topk.where(F.col("r") <= k).join(labels.where("label is not null and label <> ''"), "cand").groupBy("query", "label").agg(F.count(F.lit(1)).alias("n"))
    best = met.groupBy("query").agg(F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("b"))
    return best.select("query", "b.label", (-F.col("b.m")).alias("n"))


def ceiling(groups: DataFrame, ks=KS) -> DataFrame:
    """(k, recall): the best that any scorer can reach where the members of a group cannot be told apart. groups (group)."""
    size = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.sum("n").alias("rows"))
    each = size.select("n", "rows", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    return each.groupBy(F.col("k").cast("long").alias("k")).agg(F.round(F.sum(F.col("rows") * F.least(F.lit(1e0), F.col("k") / F.col("n"))) / F.sum("rows"), PLACES).alias("recall"))
