"""From a release's files to what the engine works on: census, preparation, the tables of a bundle, and the serving bundle.

Signatures have sig_id, pert_id, pert_type, tas, is_exemplar, cell, dose and time; compounds pert_id, smiles, moa and target
(see sources/tables.py). The expression matrix is a table (sig_id, gene_id, value).
"""

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import storage
from tessera.operators import measures as ms
from tessera.operators import metrics, splits

KIND = "trt_cp"  # fixed value: the type of a compound's signature


def once(compounds: DataFrame) -> DataFrame:
    """One row an id. Of repeated ids the row with a usable structure wins, then the least in the order of its columns; a
    reader that knows the file's order has taken the first already (see sources/tables.py)."""
    others = [c for c in compounds.columns if c != "pert_id"]
    order = F.struct(ms.valued("smiles").isNull().alias("_none"), *[F.col(c).cast("string").alias(c) for c in others])
    return compounds.groupBy("pert_id").agg(F.min_by(F.struct(*others), order).alias("one")).select("pert_id", "one.*")


def stages(signatures: DataFrame, compounds: DataFrame, least_tas: float | None, exemplar: bool) -> tuple[DataFrame, list[tuple[str, Column | None]]]:
    usable = once(compounds).where(ms.valued("smiles").isNotNull()).select("pert_id", F.lit(True).alias("usable"))
    rows = signatures.join(usable, "pert_id", "left")
    return rows, [
        ("type", F.col("pert_type") == KIND),
        ("exemplar", ms.truthy("is_exemplar") if exemplar else None),
        ("activity", F.col("tas") >= least_tas if least_tas is not None else None),
        ("structure", F.col("usable")),
    ]


def census(signatures: DataFrame, compounds: DataFrame, least_tas: float | None = 0.1, exemplar: bool = False, least_rows: int = 1, cap: int = 60, genes: int = 978) -> dict[str, DataFrame]:
    """Tables cascade, depth, annotation, groups, sweep, sizes, chance and capped of what a release offers."""
    rows, steps = stages(signatures, compounds, least_tas, exemplar)
    keep = F.lit(True)
    for _, c in steps:
        keep = keep & F.coalesce(c, F.lit(False)) if c is not None else keep
    kept = storage.written(rows.where(keep).drop("usable"), "census")
    each = ms.depths(kept, "pert_id").where(F.col("n") >= least_rows)
    bank = once(compounds).join(each.select("pert_id"), "pert_id", "left_semi")
    before = rows.where(F.coalesce(steps[0][1], F.lit(False)) & F.coalesce(steps[3][1], F.lit(False)))
    n = each.agg(F.count(F.lit(1)).alias("n"))
    return {
        "cascade": ms.cascade(rows, "pert_id", steps),
        "depth": ms.depth_stats(each),
        "annotation": ms.coverage(bank, ["moa", "target"]),
        "groups": ms.group_statistics(bank, "smiles"),
        "sweep": ms.sweep(before, "pert_id", "tas", [k / 20 for k in range(11)]),
        "sizes": ms.sizes(kept, genes),
        "chance": metrics.chance(n),
        "capped": each.agg(F.sum(F.least("n", F.lit(cap))).alias("kept"), F.sum("n").alias("total")),
    }


def prepare(signatures: DataFrame, compounds: DataFrame, genes: DataFrame, matrix: DataFrame, least_tas: float | None = 0.1, exemplar: bool = False, least_rows: int = 1, robust: bool = False) -> dict[str, DataFrame]:
    """Tables bank, signatures, cells and genes. Nothing left after the filters is an error.

    Compounds and cells get places in the order of their ids; doses and times are logarithms, with what was missing filled
    in; vectors follow the genes' order, a gene without a value is 0, and signatures that the matrix lacks are left out.
    """
    rows, steps = stages(signatures, compounds, least_tas, exemplar)
    for _, c in steps:
        rows = rows.where(F.coalesce(c, F.lit(False))) if c is not None else rows
    each = ms.depths(rows, "pert_id").where(F.col("n") >= least_rows)
    kept = storage.written(rows.join(each.select("pert_id"), "pert_id", "left_semi"), "kept")
    if kept.isEmpty():
        raise ValueError("no signature passes the filters")
    places = storage.written(splits.codes(kept, "pert_id").withColumnRenamed("code", "pos"), "places")
    cells = storage.written(splits.codes(kept, "cell").withColumnRenamed("code", "cell_index"), "cells")
    vec = selected(matrix, kept.select("sig_id"), genes, robust)
    got = kept.join(places, "pert_id").join(cells, "cell", "left").join(vec, "sig_id")
    bank = places.join(once(compounds), "pert_id").select("pos", F.col("pert_id").alias("compound_id"), "smiles", ms.valued("moa").alias("moa"), F.coalesce(F.transform(ms.many("target"), lambda x: F.trim(x)), F.array().cast("array<string>")).alias("targets"))
    known = lambda t: F.filter(t, lambda x: ~F.lower(F.trim(x)).isin(ms.PLACEHOLDERS))
    return {
        "bank": bank.withColumn("targets", known(F.col("targets"))),
        "signatures": got.select("sig_id", "pos", "cell_index", ms.log_scaled(F.col("dose"), 0).alias("log_dose"), ms.log_scaled(F.col("time"), 24).alias("log_time"), F.col("dose").isNotNull().alias("has_dose"), "vec"),
        "cells": cells,
        "genes": genes.select("gene_id", "ord"),
    }


def selected(matrix: DataFrame, wanted: DataFrame, genes: DataFrame, robust: bool = False) -> DataFrame:
    """(sig_id, vec) of the wanted signatures and genes, in the genes' order; ids that the matrix lacks are left out.

    Both selections reach the scan as semi-joins; neither id at all in the matrix is an error. A cell that the matrix holds
    more than once counts as the mean of its values.
    """
    order = genes.select("gene_id", "ord").dropDuplicates(["gene_id"])
    some = matrix.join(wanted.select("sig_id").distinct(), "sig_id", "left_semi").join(F.broadcast(order), "gene_id")
    cells = some.groupBy("sig_id", "ord").agg(F.avg(F.col("value").cast("double")).alias("value"))
    held = cells.groupBy("sig_id").agg(F.map_from_entries(F.collect_list(F.struct("ord", "value"))).alias("held"))  # a value a gene
    lists = order.agg(F.sort_array(F.collect_list("ord")).alias("order"))  # a row of all genes
    full = held.crossJoin(F.broadcast(lists)).select("sig_id", F.transform("order", lambda o: F.coalesce(F.try_element_at("held", o), F.lit(0e0))).alias("vec"))
    full = storage.written(full, "vectors")
    if full.isEmpty():
        raise ValueError("the matrix has none of the signatures and genes")
    return ms.robust_rows(full) if robust else full


def digest(df: DataFrame) -> tuple[int, str]:
    """Rows and a hash of what they hold, whatever their order and partitions. One pass; repeated rows count."""
    each = F.xxhash64(F.to_json(F.struct(*[storage.named(c).alias(f"c{k}") for k, c in enumerate(df.columns)]), {"ignoreNullFields": "false"}))
    one = df.agg(F.count(F.lit(1)).alias("n"), F.sum(each.cast("decimal(38,0)")).alias("s"), F.bit_xor(each).alias("x")).first()
    return one.n, f"{one.s}:{one.x}"


CURRENT = "CURRENT"


def save(tables: dict[str, DataFrame], path: str) -> str:
    """A bundle as a snapshot: tables in a folder of their own, a manifest of rows, hashes and schemas, and last the pointer
    CURRENT, which one rename publishes. Whatever fails before that leaves the bundle as it was. Returns the snapshot's name.
    """
    spark = next(iter(tables.values())).sparkSession
    name = f"snapshot-{uuid.uuid4().hex}"
    notes = []
    for table, df in tables.items():
        df.write.parquet(f"{path}/{name}/{table}")
        n, found = digest(spark.read.parquet(f"{path}/{name}/{table}"))
        notes.append({"name": table, "n": n, "hash": found, "schema": df.schema.jsonValue()})
    storage.write_text(spark, f"{path}/{name}/manifest.json", json.dumps(notes))
    storage.write_text(spark, f"{path}/{CURRENT}", name)
    return name


def load(spark: SparkSession, path: str, check: bool = True) -> dict[str, DataFrame]:
    """The tables of a bundle's published snapshot. A table with other rows than its manifest says is an error; the check
    reads each table once and may be left out."""
    name = storage.read_text(spark, f"{path}/{CURRENT}")
    if name is None:
        raise ValueError(f"{path}: no bundle is published")
    out = {}
    for r in json.loads(storage.read_text(spark, f"{path}/{name}/manifest.json")):
        out[r["name"]] = spark.read.schema(T.StructType.fromJson(r["schema"])).parquet(f"{path}/{name}/{r['name']}")
        if check and digest(out[r["name"]]) != (r["n"], r["hash"]):
            raise ValueError(f"{path}/{r['name']}: not the {r['n']} rows that were written")
    return out


def snapshots(spark: SparkSession, path: str) -> list[str]:
    return [n for n in storage.names(spark, path) if n.startswith("snapshot-")]


def tidy(spark: SparkSession, path: str) -> None:
    """Deletes snapshots that are not the published one, as failed saves and later ones leave them."""
    kept = storage.read_text(spark, f"{path}/{CURRENT}")
    for n in snapshots(spark, path):
        if n != kept:
            storage.delete(spark, f"{path}/{n}")


def cached_split(items: DataFrame, path: str, kind: str, key: str, group: str | None = None, weight: str | None = None) -> DataFrame:
    """The split, from a bundle named by its parameters and a hash of the items, or made and kept there. A kept one whose
    rows were changed, or are not the items', is an error. Items have a key of their own each."""
    used = [c for c in (key, group, weight) if c]
    sums = items.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*used)).alias("h")).first()
    at = f"{path}/{kind}-{'-'.join(used)}-{sums.n}-{sums.h}"
    spark = items.sparkSession
    if storage.read_text(spark, f"{at}/{CURRENT}") is None:
        save({"split": splits.split(items, kind, key, group, weight)}, at)
    got = load(spark, at)["split"]
    if got.count() != sums.n:
        raise ValueError(f"{at}: a split of other items")
    return got


def landmark_aliases(genes: DataFrame) -> DataFrame:
    """(alias, gene_id) of the genes at hand only, so that a name never leads to a gene that vectors lack."""
    from tessera.sources.tables import gene_aliases

    return gene_aliases(genes)


def merged_aliases(first: DataFrame, later: DataFrame) -> DataFrame:
    """Both tables (alias, gene_id); where both know a name, the later one's gene holds."""
    both = first.withColumn("k", F.lit(0)).unionByName(later.withColumn("k", F.lit(1)))
    return both.groupBy("alias").agg(F.max_by("gene_id", F.struct("k", "gene_id")).alias("gene_id"))


def serving(bank: DataFrame, keys: DataFrame, genes: DataFrame, aliases: DataFrame, weights: DataFrame) -> dict[str, DataFrame]:
    """Tables of a serving bundle: keys (unit vectors beside the bank's columns), genes, aliases and weights.

    keys (cand, vec); every compound of the bank needs one.
    """
    full = bank.join(keys.withColumnRenamed("cand", "compound_id"), "compound_id", "left")
    if not full.where("vec is null").isEmpty():
        raise ValueError("compounds without a key")
    return {"keys": full, "genes": genes, "aliases": aliases, "weights": weights}


def weights_table(spark: SparkSession, state: dict) -> DataFrame:
    """(part, name, shape, values) of a model's arrays."""
    rows = [(part, name, [int(n) for n in v.shape], v.ravel().astype(float).tolist()) for part, p in state.items() for name, v in p.items()]
    return spark.createDataFrame(rows, "part string, name string, shape array<int>, values array<double>")


def state_of(weights: DataFrame) -> dict:
    """A model's arrays out of their table, as large as the model."""
    import numpy as np

    out: dict = {}
    for r in weights.collect():
        out.setdefault(r.part, {})[r.name] = np.array(r["values"]).reshape(r.shape)
    return out


def attach(bank: DataFrame, embeddings: DataFrame, how: str = "concat") -> DataFrame:
    """bank (cand, vec) with embeddings (cand, extra): concat puts them behind vec, replace and only in its place.

    Only drops candidates without one; for the others a missing one is an error under concat and replace.
    """
    if how not in ("concat", "replace", "only"):
        raise ValueError(f"unknown way {how!r}")
    full = bank.join(embeddings.select("cand", "extra"), "cand", "inner" if how == "only" else "left")
    if how != "only" and not full.where("extra is null").isEmpty():
        raise ValueError("candidates without an embedding")
    vec = F.concat(F.col("vec").cast("array<double>"), F.col("extra").cast("array<double>")) if how == "concat" else F.col("extra").cast("array<double>")
    return full.select(*[vec.alias("vec") if c == "vec" else F.col(c) for c in bank.columns])


def feature_report(before: DataFrame, after: DataFrame, ks=metrics.KS) -> DataFrame:
    """(arm, duplicates, k, ceiling): candidates that share all features with another, and what any scorer can reach."""
    out = None
    for arm, df in (("before", before), ("after", after)):
        hashed = df.select(F.sha2(F.to_json("vec"), 256).alias("group"))
        doubled = hashed.groupBy("group").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicates"))
        one = metrics.ceiling(hashed, ks).crossJoin(doubled).select(F.lit(arm).alias("arm"), "duplicates", "k", F.col("recall").alias("ceiling"))
        out = one if out is None else out.unionByName(one)
    return out


def spaces(text: str, levels: str = "ABCDE", each: int = 5) -> list[str]:
    """Names of descriptor spaces out of a list such as `B1,B4`, a level's letter, `targets` or `all`, without repeats."""
    every = [f"{x}{k}" for x in levels for k in range(1, each + 1)]
    out: list[str] = []
    for part in (p.strip() for p in text.split(",")):
        if part.lower() == "all":
            more = every
        elif part.lower() == "targets":
            more = [x for x in every if x[0] == "B"]
        elif part.upper() in levels and len(part) == 1:
            more = [x for x in every if x[0] == part.upper()]
        elif part.upper() in every:
            more = [part.upper()]
        else:
            raise ValueError(f"unknown space {part!r}")
        out += [x for x in more if x not in out]
    return out


def filter_tag(min_dose: float | None = None, min_time: float | None = None, drop_outliers: float = 0.0, min_depth: int | None = None) -> str:
    """A name for a combination of filters, empty for none."""
    parts = [f"dose{min_dose:g}" if min_dose is not None else "", f"time{min_time:g}" if min_time is not None else "", f"loo{drop_outliers:g}" if drop_outliers else "", f"depth{min_depth}" if min_depth is not None else ""]
    return "_".join(p for p in parts if p)
