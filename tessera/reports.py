"""Reports of a finished run: hubs, recall by the donor's similarity and by depth, and the serving bundle.

A run's folder is what experiment.run writes; the bundle and the features are those it was trained on. Rows are those of the
split that is asked for. The baseline is the cosine to the means of training rows; a compound without any borrows its nearest
donor's mean, so that both rankings have the whole bank.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import experiment, storage
from tessera.models import two_tower as tt
from tessera.operators import fingerprints, hubs, measures, metrics, release, scorers, signal, vectors
from tessera.sources import tables


def features(spark: SparkSession, bundle: dict[str, DataFrame], path: str) -> DataFrame:
    """The bundle's bank with features, from stored vectors of its compounds."""
    bank = bundle["bank"].withColumn("id", F.col("compound_id"))
    return tables.load_vectors(spark, path, bank).withColumnRenamed("embedding", "features").drop("id")


class Run:
    """A finished run with its bundle: rows of each split, the bank as it was scaled, and its keys."""

    def __init__(self, spark: SparkSession, path: str, bundle: dict[str, DataFrame], bank: DataFrame):
        self.model, ready, parts, self.notes = experiment.rebuilt(spark, path, bank)
        self.rows = bundle["signatures"].join(parts, "sig_id")
        self.bank = storage.written(ready, "bank")
        self.keys = storage.written(tt.encoded(self.bank.select(F.col("pos").alias("cand"), F.col("features").alias("vec")), self.model.molecule), "keys")

    def part(self, split: str) -> DataFrame:
        return self.rows.where(F.col("split") == split)

    def asks(self, split: str) -> DataFrame:
        return tt.encoded(experiment.asks(self.part(split)), self.model.signature)

    def bits(self) -> DataFrame:
        n = self.notes["n_bits"]
        return self.bank.select(F.col("pos").alias("cand"), (F.slice("features", 1, n) if n else F.col("features")).alias("vec"))

    def baseline(self, split: str) -> DataFrame:
        """Ranks by the means of training rows."""
        lent = scorers.nearest_transfer(self.part("train").select(F.col("pos").alias("group"), "vec"), self.bits()).select("cand", "vec")
        return vectors.ranked(experiment.asks(self.part(split)), lent, 1).ranks


def hubness(run: Run, split: str = "test", k: int = 10, r: int = 10) -> DataFrame:
    """(arm, ...): occupancy of the bank and macro recall with the correction for hubs and without; difference is the largest
    between a sample's ranks and those counted anew."""
    asked = storage.written(run.asks(split), "asks")
    two, out = hubs.ranked(asked, run.keys, k, r), None
    for arm, got, penalty in (("cosine", two.plain, None), ("corrected", two.corrected, two.penalty)):
        again = hubs.disagreement(asked, run.keys, got.ranks, penalty)
        one = metrics.hubness(got.topk, run.keys, k).crossJoin(metrics.macro_recall(got.ranks, (k,))).crossJoin(again)  # tables of one row
        one = one.select(F.lit(arm).alias("arm"), *one.columns)
        out = one if out is None else out.unionByName(one)
    return out


def similarity(run: Run, split: str = "test", k: int = 10) -> DataFrame:
    """Recall at k of the model and of the baseline, by the Tanimoto of a compound's nearest other one with training rows."""
    sets = run.bits().select("cand", fingerprints.packed("vec").alias("words"))
    trained = run.part("train").select(F.col("pos").alias("cand")).distinct()
    asked = run.part(split).select(F.col("pos").alias("cand")).distinct()
    near = fingerprints.nearest(sets.join(asked, "cand", "left_semi").withColumnRenamed("cand", "query"), sets.join(trained, "cand", "left_semi"), 2).where("query <> cand")
    donors = near.groupBy(F.col("query").alias("truth")).agg((F.max("u") / fingerprints.UNIT).alias("similarity"))
    model = vectors.ranked(run.asks(split), run.keys, 1, once=True).ranks
    return metrics.by_similarity(model, run.baseline(split), donors, k)


def depth(run: Run, split: str = "test", k: int = 10) -> DataFrame:
    """Recall at k of the model and of the baseline, by a compound's rows of all splits; the bank is whole."""
    model = vectors.ranked(run.asks(split), run.keys, 1, once=True).ranks
    return metrics.by_depth(model, run.baseline(split), measures.depths(run.rows, "pos").withColumnRenamed("pos", "truth"), k)


def reliability(bundle: dict[str, DataFrame], bits: DataFrame | None = None, k: int = 4, k_pairs: int = 6) -> dict[str, DataFrame]:
    """Tables ceiling, pairs and filters of a bundle's signatures; with bits (group, bits) also structure."""
    rows = bundle["signatures"].select(F.col("sig_id").alias("key"), F.col("pos").alias("group"), "vec", F.when(F.col("has_dose"), measures.unlogged(F.col("log_dose"))).alias("dose"), measures.unlogged(F.col("log_time")).alias("time"))
    kept = signal.arms(rows)
    out = {"ceiling": signal.noise_ceiling(rows), "pairs": signal.random_pairs(rows), "filters": signal.filter_comparison(kept, k)}
    return out if bits is None else out | {"structure": signal.pair_correlation(kept, bits, k_pairs)}


def serving(run: Run, bundle: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables of the serving bundle of a run, whose bundle's genes have symbols and Ensembl ids where aliases are wanted."""
    spark, genes = run.keys.sparkSession, bundle["genes"]
    named = run.keys.join(run.bank.select(F.col("pos").alias("cand"), "compound_id"), "cand").select(F.col("compound_id").alias("cand"), "vec")
    known = genes if "gene_symbol" in genes.columns else genes.withColumns({"gene_symbol": F.lit("-"), "ensembl_id": F.lit("-")})
    return release.serving(run.bank.drop("features"), named, genes, release.landmark_aliases(known), release.weights_table(spark, run.model.state()))
