"""Scorers of a bank: each is fitted on training rows (group, vec) and gives a bank (cand, vec) that vectors.ranked takes.

A candidate without training rows is absent from the bank, so its score is below every other's.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import storage
from tessera.operators import fingerprints, vectors


def cosine_consensus(train: DataFrame, group: str = "group") -> DataFrame:
    """(cand, vec): each group's mean vector."""
    return vectors.consensus(train, group).select(F.col(group).alias("cand"), "vec")


def _signs(names: list[str], vec: str, n: int):
    def run(batches):
        for b in batches:
            v = vectors.matrix(b.column(vec))
            out, rows = np.zeros(v.shape), np.arange(len(v))[:, None]
            out[rows, np.argsort(-v, axis=1, kind="stable")[:, :n]] = 1
            out[rows, np.argsort(v, axis=1, kind="stable")[:, :n]] = -1
            yield pa.record_batch([vectors.listed(out) if c == vec else b.column(c) for c in names], names=names)

    return run


def signed(rows: DataFrame, n: int, vec: str = "vec") -> DataFrame:
    """rows with vec as signs: 1 at the n largest components, -1 at the n smallest, which win where both claim one, else 0.

    Ties go to the first place. Each vector is sorted twice, whatever n. Rows without a whole vector stay out.
    """
    good = rows.where(vectors.whole(vec)).withColumn(vec, F.col(vec).cast("array<double>"))
    return good.mapInArrow(_signs(good.columns, vec, n), good.schema)


def gene_set_overlap(train: DataFrame, group: str = "group", n: int = 100) -> DataFrame:
    """(cand, vec): signed indicators of the mean vectors. Against signed queries, n times the score is 2 n times the cosine."""
    return signed(cosine_consensus(train, group), n)


def nearest_transfer(train: DataFrame, bits: DataFrame, group: str = "group", k: int = 1) -> DataFrame:
    """(cand, vec, donor, similarity): means of the groups that have rows, and for each other candidate of bits (cand, vec of
    0 and 1) that of the most similar one that has, or of the k most similar, weighted by their similarity."""
    own = storage.written(cosine_consensus(train, group), "consensus")
    sets = bits.select("cand", fingerprints.packed("vec").alias("words"))
    donors, needy = (sets.join(own.select("cand"), "cand", f"left_{how}") for how in ("semi", "anti"))
    near = fingerprints.nearest(needy.withColumnRenamed("cand", "query"), donors, k)
    met = near.join(own, "cand").select("query", "r", "cand", (F.col("u") / vectors.UNIT).alias("s"), "vec")
    got = met.groupBy("query").agg(F.min_by("cand", "r").alias("donor"), F.max("s").alias("similarity"), F.sum("s").alias("total"), F.array_sort(F.collect_list(F.struct("r", "s", "vec"))).alias("lent"))  # k rows
    if k == 1:
        vec = F.col("lent")[0]["vec"]
    else:
        scaled = F.transform("lent", lambda d: F.transform(d["vec"], lambda x: x * d["s"] / (F.col("total") + 1e-9)))
        vec = F.aggregate(F.slice(scaled, 2, k), scaled[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    lent = got.select(F.col("query").alias("cand"), vec.alias("vec"), "donor", "similarity")
    return own.select("cand", "vec", F.lit(None).cast(own.schema["cand"].dataType).alias("donor"), F.lit(None).cast("double").alias("similarity")).unionByName(lent)
