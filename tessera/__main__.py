"""Command line: download, census, prepare, signal, train, hubness, tanimoto, depth, export-serving and retrieve."""

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera import experiment, reports
from tessera.models.two_tower import Config
from tessera.operators import querying, release
from tessera.sources import fetch, tables


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("download", help="the release's files, taken up again where they broke off")
    s.add_argument("--base", required=True), s.add_argument("--out", required=True), s.add_argument("--group", choices=["metadata", "matrix", "all"], default="metadata")
    for name in ("census", "prepare"):
        s = sub.add_parser(name)
        s.add_argument("--signatures", required=True), s.add_argument("--compounds", required=True), s.add_argument("--out", required=True)
        s.add_argument("--tas-min", type=float, default=0.1), s.add_argument("--exemplar-only", action="store_true"), s.add_argument("--min-sigs", type=int, default=1)
        if name == "prepare":
            s.add_argument("--genes", required=True), s.add_argument("--matrix", required=True)
            s.add_argument("--all-genes", action="store_true"), s.add_argument("--robust-zscore", action="store_true")
    s = sub.add_parser("signal", help="what replicates of a bundle agree on")
    s.add_argument("--data", required=True), s.add_argument("--out", required=True), s.add_argument("--mol-features"), s.add_argument("--n-bits", type=int)
    s.add_argument("--k-filter", type=int, default=4), s.add_argument("--k-corr", type=int, default=6)
    c = Config()
    s = sub.add_parser("train")
    s.add_argument("--data", required=True), s.add_argument("--mol-features", required=True), s.add_argument("--out", required=True)
    s.add_argument("--split", choices=["signature", "random", "scaffold", "moa"], default="scaffold"), s.add_argument("--group", default="smiles"), s.add_argument("--n-bits", type=int, default=0)
    s.add_argument("--epochs", type=int, default=c.epochs), s.add_argument("--batch-size", type=int, default=c.batch), s.add_argument("--lr", type=float, default=c.rate)
    s.add_argument("--embed-dim", type=int, default=c.embed), s.add_argument("--hidden", default=",".join(map(str, c.hidden))), s.add_argument("--dropout", type=float, default=c.dropout)
    s.add_argument("--bit-dropout", type=float, default=c.bit_dropout), s.add_argument("--temperature", type=float, default=c.temperature), s.add_argument("--weight-decay", type=float, default=c.decay)
    s.add_argument("--max-sigs-per-epoch", type=int, default=c.cap), s.add_argument("--early-stop-patience", type=int, default=c.patience), s.add_argument("--seed", type=int, default=c.seed)
    s.add_argument("--lookup-ablation", action="store_true"), s.add_argument("--bank-negatives", action="store_true"), s.add_argument("--drop-outlier-frac", type=float, default=0.0)
    for name in ("hubness", "tanimoto", "depth", "export-serving"):
        s = sub.add_parser(name)
        s.add_argument("--data", required=True), s.add_argument("--run", required=True), s.add_argument("--mol-features", required=True), s.add_argument("--out", required=True)
        if name != "export-serving":
            s.add_argument("--rows", choices=["valid", "test", "newsig"], default="test"), s.add_argument("--k", type=int, default=10)
        if name == "hubness":
            s.add_argument("--csls-r", type=int, default=10)
    s = sub.add_parser("retrieve")
    s.add_argument("--query", required=True), s.add_argument("--control"), s.add_argument("--genes", required=True), s.add_argument("--bank", required=True), s.add_argument("--out", required=True)
    s.add_argument("--log", action="store_true"), s.add_argument("--dispersion", choices=["pooled", "gene"], default="pooled"), s.add_argument("--standardize", action="store_true"), s.add_argument("--k", type=int, default=25)
    return p


def download(spark, a) -> None:
    os.makedirs(a.out, exist_ok=True)
    for r in fetch.catalogue(spark, fetch.release(a.base), a.group).collect():  # five rows at most
        fetch.fetch(r.url, f"{a.out}/{r.name}", r.bytes)


def census(spark, a) -> None:
    found = release.census(tables.signatures(spark, a.signatures), tables.compounds(spark, a.compounds), a.tas_min, a.exemplar_only, a.min_sigs)
    for name, df in found.items():
        tables.save_report(df, f"{a.out}/{name}")


def prepare(spark, a) -> None:
    made = release.prepare(tables.signatures(spark, a.signatures), tables.compounds(spark, a.compounds), tables.genes(spark, a.genes, not a.all_genes), spark.read.parquet(a.matrix), a.tas_min, a.exemplar_only, a.min_sigs, a.robust_zscore)
    release.save(made, a.out)


def signal(spark, a) -> None:
    bundle, bits = release.load(spark, a.data), None
    if a.mol_features:
        bank = reports.features(spark, bundle, a.mol_features)
        bits = bank.select(F.col("pos").alias("group"), F.transform(F.slice("features", 1, a.n_bits) if a.n_bits else F.col("features"), lambda x: (x > 0).cast("double")).alias("bits"))
    for name, df in reports.reliability(bundle, bits, a.k_filter, a.k_corr).items():
        tables.save_report(df, f"{a.out}/{name}")


def train(spark, a) -> None:
    bundle = release.load(spark, a.data)
    bank = reports.features(spark, bundle, a.mol_features)
    c = Config(embed=a.embed_dim, hidden=tuple(int(x) for x in a.hidden.split(",") if x), dropout=a.dropout, bit_dropout=a.bit_dropout, n_bits=a.n_bits or None, lookup=a.lookup_ablation, temperature=a.temperature, epochs=a.epochs, batch=a.batch_size, rate=a.lr, decay=a.weight_decay, patience=a.early_stop_patience, cap=a.max_sigs_per_epoch, memory=a.bank_negatives, seed=a.seed)
    experiment.run(bundle["signatures"], bank, a.out, c, a.split, a.n_bits, a.group, a.drop_outlier_frac)


def finished(spark, a) -> tuple[reports.Run, dict]:
    bundle = release.load(spark, a.data)
    return reports.Run(spark, a.run, bundle, reports.features(spark, bundle, a.mol_features)), bundle


def hubness(spark, a) -> None:
    tables.save_report(reports.hubness(finished(spark, a)[0], a.rows, a.k, a.csls_r), a.out)


def tanimoto(spark, a) -> None:
    tables.save_report(reports.similarity(finished(spark, a)[0], a.rows, a.k), a.out)


def depth(spark, a) -> None:
    tables.save_report(reports.depth(finished(spark, a)[0], a.rows, a.k), a.out)


def export_serving(spark, a) -> None:
    release.save(reports.serving(*finished(spark, a)), a.out)


def retrieve(spark, a) -> None:
    genes = tables.genes(spark, a.genes)
    if a.control:
        asks, reliability = querying.contrast(spark, a.query, a.control, genes, a.log, a.dispersion == "pooled")
        tables.save_report(reliability, f"{a.out}/reliability")
    else:
        asks = querying.differential(spark, a.query, genes, a.standardize)
    tables.save_report(querying.profile(asks), f"{a.out}/profile")
    tables.save_hits(querying.hits(asks, spark.read.parquet(a.bank), a.k), f"{a.out}/hits")


def main(argv: list[str] | None = None) -> None:
    a = arguments().parse_args(argv)
    globals()[a.command.replace("-", "_")](SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()
