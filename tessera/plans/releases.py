"""Queries of census, preparation and encoding over a release bound to the vectors, with SQL written on its own.

A vector is a signature: its compound is label * 10 + vec_id mod 10, its kind is control where vec_id mod 11 is 0, its
activity the last digit in tenths, its dose and time texts; compound 7 of each ten has no structure and 3 a placeholder as
mechanism. The first 48 components are landmark genes.
"""

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.models import spread
from tessera.models import two_tower as tt
from tessera.operators import release, vectors


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("id", F.col("vec_id").cast("long")).withColumn("c", F.col("label").cast("long") * 10 + F.col("id") % 10)


def parts(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    got = rows(spark, sf_dir)
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    sigs = got.select(F.col("id").alias("sig_id"), text("P", F.lpad(F.col("c").cast("string"), 3, "0")).alias("pert_id"), F.when(F.col("id") % 11 == 0, "ctl").otherwise("trt_cp").alias("pert_type"), (F.col("id") % 10 / 10).alias("tas"), (F.col("id") % 2).cast("string").alias("is_exemplar"), text("C", F.col("id") % 3).alias("cell"), F.when(F.col("id") % 5 > 0, (F.col("id") % 5).cast("double")).alias("dose"), F.when(F.col("id") % 4 > 0, 6e0 * (F.col("id") % 4)).alias("time"))
    c = F.col("c")
    mol = got.select("c").distinct().select(text("P", F.lpad(c.cast("string"), 3, "0")).alias("pert_id"), F.when(c % 10 == 7, "restricted").otherwise(text("C", c % 20)).alias("smiles"), F.when(c % 10 == 3, "-666").otherwise(text("m", c % 6)).alias("moa"), text("T", c % 4, "||T", c % 9).alias("target"))
    genes = spark.range(48).select(F.col("id").cast("string").alias("gene_id"), F.struct(F.lit("genes").alias("f"), F.lit(0).alias("b"), F.col("id").alias("i")).alias("ord"))
    matrix = got.where("id % 50 <> 1").select(F.col("id").alias("sig_id"), F.posexplode("embedding").alias("gene_id", "value")).withColumn("gene_id", F.col("gene_id").cast("string"))
    return sigs, mol, genes, matrix


def census_cascade(spark, sf_dir):
    return release.census(*parts(spark, sf_dir)[:2], exemplar=True)["cascade"]


def census_sweep(spark, sf_dir):
    return release.census(*parts(spark, sf_dir)[:2])["sweep"]


def census_report(spark, sf_dir):
    """One row of the report's single figures."""
    got = release.census(*parts(spark, sf_dir)[:2], least_rows=2, cap=3)
    depth = got["depth"].select("p50", "ge5")
    notes = got["annotation"].where("column = 'moa'").select("filled", "kinds")
    return got["groups"].crossJoin(got["sizes"]).crossJoin(got["capped"]).crossJoin(depth).crossJoin(notes)  # tables of one row


def prepared_signatures(spark, sf_dir):
    got = release.prepare(*parts(spark, sf_dir))["signatures"]
    total = F.aggregate("vec", F.lit(0e0), lambda s, x: s + x)
    return got.select("sig_id", "pos", "cell_index", F.round("log_dose", 6).alias("log_dose"), F.round("log_time", 6).alias("log_time"), "has_dose", F.size("vec").cast("long").alias("genes"), F.round(total, 6).alias("total"))


def prepared_bank(spark, sf_dir):
    return release.prepare(*parts(spark, sf_dir))["bank"].select("pos", "compound_id", "smiles", "moa", F.array_join("targets", ",").alias("targets"))


def encode_retrieve(spark, sf_dir):
    """The two best compounds of each vector by encoders of seeded weights, which no training has changed."""
    model = tt.TwoTower(64, 64, 0, tt.Config(embed=16, hidden=(32,), seed=5))
    got = rows(spark, sf_dir).select(F.col("id").alias("query"), F.lit(None).alias("truth"), F.col("embedding").alias("vec"))
    bank = rows(spark, sf_dir).groupBy(F.col("c").alias("cand")).agg(F.min_by("embedding", "id").alias("vec"))
    return vectors.ranked(tt.encoded(got, model.signature), tt.encoded(bank, model.molecule), 2).topk.select(F.col("query").alias("vec_id"), F.col("r").cast("long").alias("rank"), F.col("cand").alias("compound"), "u")


def trained_retrieval(spark, sf_dir):
    """Epochs of a short training on the vectors, by two tasks: its loss, and the recall at 10 of vectors held out. A compound's
    features are its first vector, and its label tells mechanisms apart."""
    got = rows(spark, sf_dir).select(F.col("c").alias("pos"), F.col("id").alias("sig"), F.col("embedding").alias("vec"))
    bank = got.groupBy("pos").agg(F.min_by("vec", "sig").alias("features")).withColumn("label", F.col("pos") % 7)
    held = F.col("sig") % 5 == 0
    c = tt.Config(embed=12, hidden=(32,), epochs=3, batch=128, rate=5e-3, dropout=0.0)
    history = spread.train(got.where(~held), bank, c, 2, got.where(held))[1]
    return spark.createDataFrame([(h["epoch"], None if np.isnan(h["loss"]) else round(h["loss"], 6), round(h["valid"], 6)) for h in history], "epoch long, loss double, recall_10 double")


NAMES = "census_cascade census_sweep census_report prepared_signatures prepared_bank encode_retrieve trained_retrieval".split()
QUERIES = {n: globals()[n] for n in NAMES}

# ---- SQL ----
S = """s AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(label AS BIGINT) * 10 + vec_id % 10 AS c, embedding FROM embeddings),
a AS (SELECT *, id % 11 <> 0 AS kind, id % 2 = 1 AS exemplar, id % 10 >= 1 AS active, c % 10 <> 7 AS usable FROM s), kept AS (SELECT * FROM a WHERE kind AND active AND usable)"""
NAME = "'P' || lpad(CAST(c AS VARCHAR), 3, '0')"
DEPTH = f"{S}, d AS (SELECT c, count(*) AS n FROM kept GROUP BY c HAVING count(*) >= 2)"
ORACLES = {
    "census_cascade": f"WITH {S} " + " UNION ALL ".join(f"""SELECT {k}::BIGINT AS stage_no, '{n}' AS stage, count(*) AS "rows", count(DISTINCT c) AS items, '' AS note FROM a WHERE {w}""" for k, (n, w) in enumerate((("type", "kind"), ("exemplar", "kind AND exemplar"), ("activity", "kind AND exemplar AND active"), ("structure", "kind AND exemplar AND active AND usable")), 1)),
    "census_sweep": f"""WITH {S} SELECT t / 20.0::DOUBLE AS threshold, count(*) FILTER (id % 10 * 2 >= t) AS "rows", count(DISTINCT c) FILTER (id % 10 * 2 >= t) AS items FROM a, range(11) r(t) WHERE kind AND usable GROUP BY t""",
    "census_report": f"WITH {DEPTH}, g AS (SELECT 'C' || c % 20 AS m, count(*) AS n FROM d GROUP BY m) SELECT (SELECT count(*) FROM g) AS groups, (SELECT round(count(*) FILTER (n = 1) / count(*)::DOUBLE, 6) FROM g) AS singletons, (SELECT max(n) FROM g) AS largest, (SELECT count(*) FROM kept) AS n, (SELECT round(count(*) * 978.0::DOUBLE * 4 / 1e9, 6) FROM kept) AS gb, CAST(sum(least(n, 3)) AS BIGINT) AS kept, CAST(sum(n) AS BIGINT) AS total, round(median(n), 6) AS p50, count(*) FILTER (n >= 5) AS ge5, count(*) FILTER (c % 10 <> 3) AS filled, count(DISTINCT c % 6) FILTER (c % 10 <> 3) AS kinds FROM d",
    "prepared_signatures": f"WITH {S}, p AS (SELECT c, row_number() OVER (ORDER BY {NAME}) - 1 AS pos FROM (SELECT DISTINCT c FROM kept)) SELECT id AS sig_id, pos, id % 3 AS cell_index, round(log10((id % 5) + 0.001), 6) AS log_dose, round(log10(CASE WHEN id % 4 = 0 THEN 24 ELSE 6 * (id % 4) END + 0.001), 6) AS log_time, id % 5 > 0 AS has_dose, 48::BIGINT AS genes, round(list_sum(list_transform(embedding[1:48], lambda x: x::DOUBLE)), 6) AS total FROM kept JOIN p ON kept.c = p.c WHERE id % 50 <> 1",
    "prepared_bank": f"WITH {S} SELECT row_number() OVER (ORDER BY {NAME}) - 1 AS pos, {NAME} AS compound_id, 'C' || c % 20 AS smiles, CASE WHEN c % 10 <> 3 THEN 'm' || c % 6 END AS moa, 'T' || c % 4 || ',T' || c % 9 AS targets FROM (SELECT DISTINCT c FROM kept)",
}
