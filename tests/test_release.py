"""Release to bundle, and query file to hits, end to end on small files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import storage
from tessera.models import two_tower as tt
from tessera.operators import querying, release, vectors
from tessera.sources import tables

SIGS = "sig_id\tpert_id\tpert_type\ttas\tis_exemplar_sig\tcell_iname\tpert_dose\tpert_time\n"
MOL = "pert_id\tcanonical_smiles\tmoa\ttarget\n"
GENES = "gene_id\tgene_symbol\tensembl_id\tfeature_space\n"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    at, r = tmp_path_factory.mktemp("release"), np.random.default_rng(3)
    rows = [(f"s{k}", f"P{k % 9}", "trt_cp" if k % 11 else "ctl", 0.05 * (k % 7), k % 2, f"C{k % 3}", "" if k % 5 == 0 else f"{k % 4 + 1} uM", f"{6 * (k % 3 + 1)} h") for k in range(120)]
    (at / "siginfo.txt").write_text(SIGS + "".join("\t".join(map(str, x)) + "\n" for x in rows))
    mol = [(f"P{k}", "restricted" if k == 4 else f"C{'C' * k}", "-666" if k == 2 else f"moa{k % 3}", "T1||T2" if k % 2 else "nan") for k in range(9)] + [("P0", "CCO", "other", "T9")]
    (at / "compounds.txt").write_text(MOL + "".join("\t".join(x) + "\n" for x in mol))
    genes = [(str(100 + k), f"G{k}", f"ENS{k}", "landmark" if k < 20 else "other") for k in range(24)]
    (at / "genes.txt").write_text(GENES + "".join("\t".join(x) + "\n" for x in genes))
    values = r.normal(size=(120, 24)).round(3)
    return at, rows, mol, genes, values


@pytest.fixture(scope="module")
def parts(spark, files):
    at, rows, _, genes, values = files
    matrix = spark.createDataFrame([(f"s{i}", str(100 + g), float(values[i, g])) for i in range(118) for g in range(24) if (i, g) != (1, 3)], "sig_id string, gene_id string, value double")
    return tables.signatures(spark, f"{at}/siginfo.txt"), tables.compounds(spark, f"{at}/compounds.txt"), tables.genes(spark, f"{at}/genes.txt"), matrix


def kept(rows):
    return [x for x in rows if x[2] == "trt_cp" and round(x[3], 9) >= 0.1 and x[1] != "P4"]


def test_census(files, parts):
    _, rows, *_ = files
    got = release.census(parts[0], parts[1])
    cascade = {r.stage: (r["rows"], r["items"], r.note) for r in got["cascade"].collect()}
    a = [x for x in rows if x[2] == "trt_cp"]
    b = [x for x in a if round(x[3], 9) >= 0.1]
    for name, some, note in (("type", a, ""), ("exemplar", a, "skipped"), ("activity", b, ""), ("structure", kept(rows), "")):
        assert cascade[name] == (len(some), len({x[1] for x in some}), note)
    depth = got["depth"].first()
    n = np.array([sum(x[1] == f"P{k}" for x in kept(rows)) for k in range(9) if k != 4])
    assert depth.largest == n.max() and depth.p50 == np.median(n) and depth.ge10 == (n >= 10).sum()
    assert {r["column"]: r.filled for r in got["annotation"].collect()} == {"moa": 7, "target": 4}
    assert got["groups"].first().groups == 8 and got["sizes"].first().n == len(kept(rows)) and got["sweep"].count() == 11


def test_prepare_save_load(spark, files, parts, tmp_path):
    _, rows, _, genes, values = files
    made = release.prepare(*parts)
    release.save(made, f"{tmp_path}/b")
    back = release.load(spark, f"{tmp_path}/b")
    want = [x for x in kept(rows) if int(x[0][1:]) < 118]
    got = {r.sig_id: r for r in back["signatures"].collect()}
    names = sorted({x[1] for x in kept(rows)})
    assert set(got) == {x[0] for x in want}
    for x in want:
        r, i = got[x[0]], int(x[0][1:])
        v = values[i, :20].copy()
        assert r.vec == v.tolist() and names[r.pos] == x[1] and r.cell_index == int(x[5][1:])
        dose = float(x[6].split()[0]) if x[6] else None
        assert r.has_dose == (dose is not None) and abs(r.log_dose - np.log10((dose or 0) + 1e-3)) < 1e-9 and abs(r.log_time - np.log10(float(x[7].split()[0]) + 1e-3)) < 1e-9
    bank = {r.compound_id: r for r in back["bank"].collect()}
    assert bank["P2"].moa is None and bank["P0"].smiles == "C" and bank["P1"].targets == ["T1", "T2"] and bank["P0"].targets == []
    with pytest.raises(ValueError):
        release.prepare(parts[0], parts[1], parts[2], parts[3], least_tas=9.0)
    name = storage.read_text(spark, f"{tmp_path}/b/CURRENT")
    cells = back["cells"].withColumn("cell", F.reverse("cell")).collect()
    spark.createDataFrame(cells, "cell string, cell_index long").write.mode("overwrite").parquet(f"{tmp_path}/b/{name}/cells")  # as many rows
    with pytest.raises(ValueError, match="cells"):
        release.load(spark, f"{tmp_path}/b")
    one = release.cached_split(back["bank"], f"{tmp_path}/s", "random", "compound_id").collect()
    assert sorted(one) == sorted(release.cached_split(back["bank"], f"{tmp_path}/s", "random", "compound_id").collect())


def write(path, names, table):
    path.write_text("gene," + ",".join(f"r{k}" for k in range(table.shape[1])) + "\n" + "".join(f"{n}," + ",".join(map(str, x)) + "\n" for n, x in zip(names, table)))
    return str(path)


def test_query_to_hits(spark, parts, tmp_path):
    r, genes = np.random.default_rng(4), parts[2]
    names = ["g0", "ENS1", *[str(100 + k) for k in range(2, 18)], "unknown"]
    table = r.normal(size=(19, 2)).round(3)
    path = write(tmp_path / "q.csv", names, table)
    got = {x["query"]: x.vec for x in querying.differential(spark, path, genes).collect()}
    for k in range(2):
        assert got[f"r{k}"] == [*table[:18, k].tolist(), 0.0, 0.0]
    z = {x["query"]: x.vec for x in querying.differential(spark, path, genes, standardise=True).collect()}
    full = np.array(got["r0"])
    assert np.allclose(z["r0"], (full - full.mean()) / full.std(), atol=1e-9)
    with pytest.raises(ValueError):
        querying.differential(spark, write(tmp_path / "raw.csv", names, np.abs(table) + 1), genes)
    with pytest.raises(ValueError):
        querying.differential(spark, write(tmp_path / "few.csv", names[:5], table[:5]), genes)
    bank = spark.createDataFrame([(f"P{k}", r.normal(size=20).tolist(), f"m{k % 2}", [f"T{k}", "X"], "C" * 60) for k in range(12)], "cand string, vec array<double>, moa string, targets array<string>, smiles string")
    hits = querying.hits(querying.differential(spark, path, genes), bank, 5)
    rows = hits.orderBy("query", "rank").collect()
    keys = {x.cand: np.array(x.vec) for x in bank.collect()}
    cos = sorted(((-full @ v / np.linalg.norm(full) / np.linalg.norm(v), c) for c, v in keys.items()))[:5]
    assert [x.compound_id for x in rows[:5]] == [c for _, c in cos] and abs(rows[0].cosine + cos[0][0]) < 2e-6 and rows[0].target.endswith(",X")
    assert querying.hits(querying.differential(spark, path, genes), bank, None).count() == 24
    assert querying.listing(hits).count() == 10 and all(x.n <= 5 for x in querying.agreement(hits).collect())
    tables.save_hits(hits, f"{tmp_path}/hits")
    assert spark.read.option("header", True).csv(f"{tmp_path}/hits").count() == 10


@pytest.mark.parametrize("pooled", [True, False])
def test_contrast(spark, parts, tmp_path, pooled):
    r, genes = np.random.default_rng(6), parts[2]
    names = [f"G{k}" for k in range(18)]
    t, c = np.exp(r.normal(size=(18, 3))).round(3), np.exp(r.normal(size=(18, 4))).round(3)
    t[2] *= 8
    vec, rel = querying.contrast(spark, write(tmp_path / "t.csv", names, t), write(tmp_path / "c.csv", names, c), genes, log=True, pooled=pooled)
    a, b = np.log2(t + 1), np.log2(c + 1)
    if pooled:
        d = a.mean(1) - b.mean(1)
        want = (d - np.median(d)) / max(1.4826 * np.median(np.abs(d - np.median(d))), 1e-9)
    else:
        m = np.median(b, 1)
        want = (a.mean(1) - m) / np.maximum(1.4826 * np.median(np.abs(b - m[:, None]), 1), 1e-9)
    assert np.allclose(vec.first().vec[:18], want, atol=1e-6) and vec.first().vec[18:] == [0.0, 0.0]
    one = rel.first()
    rank = lambda x: np.argsort(np.argsort(x)).astype(float)
    rho = [np.corrcoef(rank(a[:, i] - b[:, x]), rank(a[:, j] - b[:, y]))[0, 1] for i in range(3) for j in range(i + 1, 3) for x in range(3) for y in range(3) if x != y]
    assert one.k == 3 and one.pairings == len(rho) and abs(one.single - np.mean(rho)) < 1e-6 and abs(one.stepped - 3 * one.single / (1 + 2 * one.single)) < 1e-9
    with pytest.raises(ValueError):
        querying.contrast(spark, write(tmp_path / "n.csv", names, -t), write(tmp_path / "c.csv", names, c), genes, log=True)


def test_serving(spark, parts, tmp_path):
    r = np.random.default_rng(2)
    model = tt.TwoTower(20, 6, 4, tt.Config(embed=4, hidden=(8,)))
    bank = spark.createDataFrame([(k, f"P{k}", r.normal(size=6).tolist()) for k in range(4)], "pos long, compound_id string, features array<double>")
    keys = tt.encoded(bank.select(F.col("compound_id").alias("cand"), F.col("features").alias("vec")), model.molecule)
    release.save(release.serving(bank.drop("features"), keys, parts[2].select("gene_id", "ord"), release.landmark_aliases(parts[2]), release.weights_table(spark, model.state())), f"{tmp_path}/serve")
    back = release.load(spark, f"{tmp_path}/serve")
    again = tt.TwoTower(20, 6, 4, model.c).load(release.state_of(back["weights"]))
    x = r.normal(size=(3, 20))
    assert np.allclose(again.signature.forward(x)[0], model.signature.forward(x)[0])
    asks = spark.createDataFrame([(k, None, v.tolist()) for k, v in enumerate(x)], "query long, truth string, vec array<double>")
    top = vectors.ranked(tt.encoded(asks, again.signature), back["keys"].select(F.col("compound_id").alias("cand"), "vec"), 4).topk
    assert top.count() == 12
    with pytest.raises(ValueError):
        release.serving(bank, keys.limit(2), parts[2], parts[2], parts[2])
    more = spark.createDataFrame([("G0", "999")], "alias string, gene_id string")
    assert {a.alias: a.gene_id for a in release.merged_aliases(back["aliases"], more).collect()}["G0"] == "999"


def test_attach_and_reports(spark):
    bank = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "cand long, vec array<double>")
    extra = spark.createDataFrame([(1, [5.0]), (2, [6.0])], "cand long, extra array<double>")
    assert {r.cand: r.vec for r in release.attach(bank.where("cand < 3"), extra).collect()} == {1: [1.0, 0.0, 5.0], 2: [1.0, 0.0, 6.0]}
    only = release.attach(bank, extra, "only")
    assert {r.cand: r.vec for r in only.collect()} == {1: [5.0], 2: [6.0]}
    with pytest.raises(ValueError):
        release.attach(bank, extra, "replace")
    got = {(r.arm, r.k): (r.duplicates, r.ceiling) for r in release.feature_report(bank, only, (1, 2)).collect()}
    assert got[("before", 1)] == (2, pytest.approx(2 / 3)) and got[("after", 1)] == (0, 1) and got[("before", 2)] == (2, 1)
    assert release.spaces("B1, c ,b1") == ["B1", "C1", "C2", "C3", "C4", "C5"] and len(release.spaces("all")) == 25 and len(release.spaces("targets")) == 5
    assert release.filter_tag() == "" and release.filter_tag(1, 24, 0.25, 20) == "dose1_time24_loo0.25_depth20"
    with pytest.raises(ValueError):
        release.spaces("Z9")


def test_repeated_compounds_and_cells(spark):
    sigs = spark.createDataFrame([(f"s{k}", "P1", "trt_cp", 0.5, "1", "C0", 1.0, 6.0) for k in range(3)], "sig_id string, pert_id string, pert_type string, tas double, is_exemplar string, cell string, dose double, time double")
    mol = spark.createDataFrame([("P1", "restricted", "m0", "T0"), ("P1", "CC", "m1", "T1"), ("P1", "CC", "m1", "T1"), ("P1", "CCC", "m2", "T2")], "pert_id string, smiles string, moa string, target string")
    genes = spark.createDataFrame([("g0", 0), ("g1", 1), ("g1", 1)], "gene_id string, ord long")
    cells = spark.createDataFrame([("s0", "g0", 1.0), ("s0", "g0", 3.0), ("s1", "g1", 4.0)], "sig_id string, gene_id string, value double")
    got = release.census(sigs, mol)
    assert [(r["rows"], r["items"]) for r in got["cascade"].orderBy("stage_no").collect()] == [(3, 1)] * 4 and got["groups"].first().groups == 1
    made = release.prepare(sigs, mol, genes, cells)
    assert [(r.pos, r.smiles, r.moa) for r in made["bank"].collect()] == [(0, "CC", "m1")]
    assert {r.sig_id: r.vec for r in made["signatures"].collect()} == {"s0": [2.0, 0.0], "s1": [0.0, 4.0]}


def test_a_failed_save_leaves_the_old_bundle(spark, tmp_path):
    at = f"{tmp_path}/bundle"
    good = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    with pytest.raises(ValueError, match="no bundle"):
        release.load(spark, at)
    release.save({"one": good, "two": good}, at)
    broken = good.select("id", F.raise_error(F.lit("lost")).cast("string").alias("v"))
    with pytest.raises(Exception, match="lost"):
        release.save({"one": good.limit(1), "two": broken}, at)
    assert {n: sorted(map(tuple, df.collect()), key=str) for n, df in release.load(spark, at).items()} == {"one": [(1, "a"), (2, None)], "two": [(1, "a"), (2, None)]}
    assert len(release.snapshots(spark, at)) == 2
    last = release.save({"one": good.limit(1)}, at)
    release.tidy(spark, at)
    assert release.snapshots(spark, at) == [last] and release.load(spark, at)["one"].count() == 1 and set(release.load(spark, at)) == {"one"}
