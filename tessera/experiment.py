"""An experiment from bundle to report: split, scale, filter, hold out, train, test, compare; and a finished run again.

Training sees arrays on the driver: of the training rows, `cap` a compound at most, which is the reader's bound. All other
steps are tables. Split membership, scaler, weights, history and results are written to the run's folder.
"""

import json
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import storage
from tessera.models import two_tower as tt
from tessera.operators import measures as ms
from tessera.operators import metrics, release, scorers, signal, splits, vectors


def scaled(bank: DataFrame, train: DataFrame, n_bits: int, least: float = 1e-3, clip: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """bank (pos, features) with the columns after the bits scaled by the training compounds, and the scaler (at, m, s)."""
    known = bank.join(train.select("pos").distinct(), "pos", "left_semi").select(F.posexplode("features").alias("at", "x")).where(F.col("at") >= n_bits)
    stats = storage.written(known.groupBy("at").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")), "scaler")
    return rescaled(bank, stats, n_bits, least, clip), stats


def rescaled(bank: DataFrame, stats: DataFrame, n_bits: int, least: float = 1e-3, clip: float = 10.0) -> DataFrame:
    one = stats.agg(F.sort_array(F.collect_list(F.struct("at", "m", "s"))).alias("stats"))  # a row a column
    scale = lambda x, s: F.greatest(F.least((x - s["m"]) / F.when(s["s"] < least, 1e0).otherwise(s["s"]), F.lit(clip)), F.lit(-clip))
    tail = F.zip_with(F.slice("features", n_bits + 1, F.greatest(F.size("features") - n_bits, F.lit(0))), "stats", scale)
    return bank.crossJoin(F.broadcast(one)).withColumn("features", F.concat(F.slice("features", 1, n_bits), tail)).drop("stats")


def arrays(rows: DataFrame, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and compounds of up to `cap` rows a compound."""
    some = splits.capped(rows, "sig_id", "pos", cap, "cap")
    got = rows.join(some.select("sig_id"), "sig_id", "left_semi").orderBy("pos", F.md5(F.col("sig_id").cast("string"))).select("pos", "vec").toArrow()
    return vectors.matrix(got["vec"].combine_chunks()), np.asarray(got["pos"])


def asks(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("sig_id").alias("query"), F.col("pos").alias("truth"), "vec")


def evaluate(model: tt.TwoTower, rows: DataFrame, bank: DataFrame, prefix: str) -> DataFrame:
    """One row of metrics of rows against the bank (pos, features, moa, targets), their names prefixed."""
    if model.c.lookup:  # a free vector a compound, as large as the model
        keys = rows.sparkSession.createDataFrame([(k, v.tolist()) for k, v in enumerate(model.keys(np.zeros((0, 0))))], "cand long, vec array<double>")
    else:
        keys = tt.encoded(bank.select(F.col("pos").alias("cand"), F.col("features").alias("vec")), model.molecule)
    got = vectors.ranked(tt.encoded(asks(rows), model.signature), keys)
    return metrics.bundle(got, bank.select(F.col("pos").alias("cand"), F.col("moa").alias("label")), bank.select(F.col("pos").alias("cand"), F.try_element_at("targets", F.lit(1)).alias("label")), prefix=prefix)


def run(signatures: DataFrame, bank: DataFrame, path: str, c: tt.Config, kind: str = "signature", n_bits: int = 0, group: str = "scaffold", drop_outliers: float = 0.0, gene_set: int = 100) -> dict:
    """signatures (sig_id, pos, vec, ...), bank (pos, features, moa, targets, and group for a split by it). Returns the results."""
    spark = signatures.sparkSession
    signatures = storage.written(signatures, "signatures")
    if kind == "signature":
        parts = splits.split(signatures, kind, "sig_id", "pos")
    else:
        lines = ms.depths(signatures, "pos", bank).withColumnRenamed("n", "weight")
        by = splits.split(bank.join(lines, "pos"), kind, "pos", "moa" if kind == "moa" else group, "weight")
        parts = signatures.select("sig_id", "pos").join(by.select("pos", "split"), "pos").select("sig_id", "split")
    held = splits.holdout(signatures.join(parts.where("split = 'train'"), "sig_id"), "sig_id", "pos")
    parts = parts.join(held, "sig_id", "left").select("sig_id", F.when(F.col("held"), "newsig").otherwise(F.col("split")).alias("split"))
    parts.write.mode("overwrite").parquet(f"{path}/split")
    rows = signatures.join(spark.read.parquet(f"{path}/split"), "sig_id")
    if drop_outliers:
        named = rows.select(F.col("sig_id").alias("key"), F.col("pos").alias("group"), "vec", "split")
        keep = signal.quality_filter(named, drop_outliers=drop_outliers, restrict=F.col("split") == "train").where("keep").select(F.col("key").alias("sig_id"))
        rows = rows.join(keep, "sig_id", "left_semi")
    rows = storage.written(rows, "rows")
    part = lambda s: rows.where(F.col("split") == s)
    ready, stats = scaled(bank, part("train"), n_bits)
    stats.write.mode("overwrite").parquet(f"{path}/scaler")
    ready = storage.written(ready, "bank")
    table = ready.orderBy("pos").select("pos", "features", "moa").toArrow()  # the bank, which the model encodes whole
    features, moa = vectors.matrix(table["features"].combine_chunks()), np.array(table["moa"].to_pylist(), object)
    known = {m: k for k, m in enumerate(sorted({m for m in moa if m}))}
    label = np.array([known.get(m, -1) for m in moa])
    (x, at), valid = arrays(part("train"), c.cap), arrays(part("valid"), c.cap)
    if not len(x):
        raise ValueError("no training rows are left")
    model = tt.TwoTower(x.shape[1], features.shape[1], len(features), c)
    history = tt.train(model, x, at, features, [label], valid if len(valid[0]) else None)
    results = {}
    for name in ("valid", "test", "newsig"):
        if not part(name).isEmpty():
            results |= {k: v for k, v in evaluate(model, part(name), ready, f"{name}_").first().asDict().items()}
    cand = bank.select(F.col("pos").alias("cand"))
    fitted = {"cosine consensus": (scorers.cosine_consensus(part("train"), "pos"), asks(part("test"))), "gene sets": (scorers.gene_set_overlap(part("train"), "pos", gene_set), scorers.signed(asks(part("test")), gene_set))}
    table = {"model": spark.createDataFrame([{k.removeprefix("test_"): v for k, v in results.items() if k.startswith("test_macro_recall")}])} if any(k.startswith("test_macro_recall") for k in results) else {}
    if n_bits:
        bits = bank.select(F.col("pos").alias("cand"), F.slice("features", 1, n_bits).alias("vec"))
        fitted["nearest transfer"] = scorers.nearest_transfer(part("train").select(F.col("pos").alias("group"), "vec"), bits).select("cand", "vec"), asks(part("test"))
    table |= {n: metrics.macro_recall(vectors.ranked(q, b, 1, once=True).ranks) for n, (b, q) in fitted.items()}
    one = metrics.chance(cand.agg(F.count(F.lit(1)).alias("n")))
    table["chance"] = one.agg(*[F.max(F.when(F.col("k") == k, F.col("recall"))).alias(f"macro_recall_{k}") for k in metrics.KS])
    top = metrics.ceiling(ready.select(F.sha2(F.to_json("features"), 256).alias("group")))
    table["ceiling"] = top.agg(*[F.max(F.when(F.col("k") == k, F.col("recall"))).alias(f"macro_recall_{k}") for k in metrics.KS])
    metrics.comparison(table).coalesce(1).write.mode("overwrite").json(f"{path}/comparison")
    release.weights_table(spark, model.state()).write.mode("overwrite").parquet(f"{path}/weights")
    notes = {"config": asdict(c), "kind": kind, "n_bits": n_bits, "genes": x.shape[1], "features": features.shape[1], "n_compounds": len(features), "history": history, "results": results}
    spark.createDataFrame([(json.dumps(notes),)], "notes string").coalesce(1).write.mode("overwrite").text(f"{path}/notes")
    return notes | {"model": model}


def rebuilt(spark: SparkSession, path: str, bank: DataFrame) -> tuple[tt.TwoTower, DataFrame, DataFrame, dict]:
    """The model, the bank as it was scaled, the split and the notes of a finished run; other features are refused."""
    notes = json.loads(spark.read.text(f"{path}/notes").first()[0])
    width = bank.select(F.max(F.size("features"))).first()[0]
    if width != notes["features"]:
        raise ValueError(f"the bank has {width} features, the run had {notes['features']}")
    c = tt.Config(**{**notes["config"], "hidden": tuple(notes["config"]["hidden"])})
    model = tt.TwoTower(notes["genes"], width, notes["n_compounds"], c).load(release.state_of(spark.read.parquet(f"{path}/weights")))
    return model, rescaled(bank, spark.read.parquet(f"{path}/scaler"), notes["n_bits"]), spark.read.parquet(f"{path}/split"), notes
