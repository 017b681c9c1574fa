"""From a drawn bundle to the reports of a run, through the command line."""

from pyspark.sql import functions as F

from tessera.__main__ import main
from tessera.models import synthetic
from tessera.operators import release
from tessera.sources import tables


def test_train_and_report(spark, tmp_path):
    at = str(tmp_path)
    bank = synthetic.bank(spark, 40, bits=24, descriptors=3, seed=9)
    rows = synthetic.signatures(spark, 40, bits=24, genes=12, seed=9, most=14)
    genes = spark.range(12).select(F.col("id").cast("string").alias("gene_id"), F.col("id").alias("ord"))
    cells = spark.range(8).select(F.col("id").cast("string").alias("cell"), F.col("id").alias("cell_index"))
    release.save({"bank": bank.drop("features"), "signatures": rows, "genes": genes, "cells": cells}, f"{at}/data")
    tables.save_vectors(bank.select(F.col("compound_id").alias("id"), F.col("features").alias("embedding")), f"{at}/features")
    data = ["--data", f"{at}/data", "--mol-features", f"{at}/features"]
    main(["train", *data, "--out", f"{at}/run", "--split", "signature", "--epochs", "2", "--embed-dim", "8", "--hidden", "16", "--batch-size", "16", "--n-bits", "24"])
    names = {r.name for r in spark.read.json(f"{at}/run/comparison").collect()}
    assert {"model", "cosine consensus", "gene sets", "nearest transfer", "chance", "ceiling"} <= names
    run = ["--run", f"{at}/run", *data]
    main(["hubness", *run, "--out", f"{at}/hubs", "--k", "5"])
    hubs = {r.arm: r for r in spark.read.json(f"{at}/hubs").collect()}
    assert set(hubs) == {"cosine", "corrected"} and all(r.difference == 0 and 0 <= r.macro_recall_5 <= 1 for r in hubs.values())
    main(["tanimoto", *run, "--out", f"{at}/tanimoto"])
    main(["depth", *run, "--out", f"{at}/depth"])
    near, deep = (spark.read.json(f"{at}/{n}").collect() for n in ("tanimoto", "depth"))
    asked = spark.read.parquet(f"{at}/run/split").where("split = 'test'").join(rows, "sig_id").select("pos").distinct().count()
    assert sum(r.n for r in near) == sum(r.n for r in deep) == asked
    main(["export-serving", *run, "--out", f"{at}/serve"])
    served = release.load(spark, f"{at}/serve")
    assert served["keys"].count() == 40 and served["weights"].count() > 4
    main(["signal", *data, "--out", f"{at}/signal", "--n-bits", "24", "--k-filter", "2", "--k-corr", "2"])
    assert spark.read.json(f"{at}/signal/filters").count() >= 1 and spark.read.json(f"{at}/signal/ceiling").count() >= 1
