import http.server
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import release
from tessera import __main__ as cli
from tessera import experiment as ex
from tessera.models import two_tower as tt
from tessera.sources import fetch


@pytest.fixture(scope="module")
def tables(spark):
    x, compound, features, label = tt.planted(40, 24, 48, seed=2)
    desc = np.random.default_rng(1).normal(5, 3, (40, 3))
    sig = spark.createDataFrame([(k, int(c), v.tolist()) for k, (c, v) in enumerate(zip(compound, x))], "sig_id long, pos long, vec array<double>")
    bank = spark.createDataFrame([(k, [*f.tolist(), *d.tolist()], f"m{m}" if m >= 0 else None, [f"t{k % 4}"], f"s{k // 2}") for k, (f, d, m) in enumerate(zip(features, desc, label))], "pos long, features array<double>, moa string, targets array<string>, scaffold string")
    return sig, bank


@pytest.mark.parametrize("kind", ["signature", "scaffold"])
def test_run_and_rebuild(spark, tables, tmp_path, kind):
    sig, bank = tables
    c = tt.Config(embed=12, hidden=(32,), epochs=8, batch=24, rate=5e-3, patience=8)
    got = ex.run(sig, bank, str(tmp_path), c, kind, n_bits=48, drop_outliers=0.1, gene_set=6)
    assert got["results"]["test_n_queries"] > 0 and 0 <= got["results"]["test_macro_recall_10"] <= 1
    rows = {r.name: r for r in spark.read.json(f"{tmp_path}/comparison").collect()}
    assert set(rows) == {"model", "cosine consensus", "gene sets", "nearest transfer", "chance", "ceiling"} and rows["chance"].macro_recall_10 == 0.25
    model, ready, split, notes = ex.rebuilt(spark, str(tmp_path), bank)
    by = {r.sig_id: r.split for r in split.collect()}
    assert len(by) == sig.count() and set(by.values()) >= {"train", "test"}
    if kind == "scaffold":
        sides = {}
        for r in sig.select("sig_id", "pos").collect():
            sides.setdefault(r.pos // 2, set()).add({"newsig": "train"}.get(by[r.sig_id], by[r.sig_id]))
        assert all(len(s) == 1 for s in sides.values())
    test = sig.join(split.where("split = 'test'"), "sig_id")
    again = ex.evaluate(model, test, ready, "test_").first()
    assert again.test_macro_recall_10 == pytest.approx(got["results"]["test_macro_recall_10"])
    with pytest.raises(ValueError):
        ex.rebuilt(spark, str(tmp_path), bank.withColumn("features", F.slice("features", 1, 5)))


def test_fetch(tmp_path, spark):
    data, broken = bytes(range(256)) * 400, []

    class Half(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            at = int((self.headers.get("Range") or "bytes=0-")[6:-1])
            if self.path == "/none":
                self.send_error(404)
                return
            self.send_response(206 if at else 200)
            part = data[at : at + 60000]
            self.send_header("Content-Length", str(len(part)))
            self.end_headers()
            self.wfile.write(part)
            broken.append(at)

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Half)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, waits = f"http://127.0.0.1:{server.server_port}", []
    fetch.fetch(f"{url}/x", str(tmp_path / "x"), len(data), wait=waits.append)
    assert (tmp_path / "x").read_bytes() == data and broken == [0, 60000] and waits == [1]
    fetch.fetch(f"{url}/x", str(tmp_path / "x"), len(data))
    assert len(broken) == 2
    with pytest.raises(OSError):
        fetch.fetch(f"{url}/none", str(tmp_path / "n"), 5, wait=waits.append)
    with pytest.raises(OSError):
        fetch.fetch(f"{url}/x", str(tmp_path / "y"), 30000, wait=waits.append)
    server.shutdown()
    entries = [("a", "u", 1, "m"), ("b", "v", 2, "x")]
    assert fetch.catalogue(spark, entries, "m").count() == 1 and fetch.catalogue(spark, entries).count() == 2


def test_command_line(spark, tmp_path):
    (tmp_path / "s.txt").write_text("sig_id\tpert_id\tpert_type\ttas\tcell_id\nx1\tP1\ttrt_cp\t0.5\tA\nx2\tP1\ttrt_cp\t0.05\tA\n")
    (tmp_path / "c.txt").write_text("pert_id\tcanonical_smiles\tmoa\ttarget\nP1\tCC\tm\tT\n")
    (tmp_path / "g.txt").write_text("gene_id\tgene_symbol\tensembl_id\tpr_is_lm\n1\tA\tE1\t1\n2\tB\tE2\t1\n")
    at = lambda n: str(tmp_path / n)
    spark.createDataFrame([("x1", "1", 2.0), ("x1", "2", -1.0)], "sig_id string, gene_id string, value double").write.parquet(at("m"))
    both = ["--signatures", at("s.txt"), "--compounds", at("c.txt")]
    cli.main(["census", *both, "--out", at("census")])
    assert spark.read.json(at("census/cascade")).count() == 4
    cli.main(["prepare", *both, "--genes", at("g.txt"), "--matrix", at("m"), "--out", at("bundle")])
    assert release.load(spark, at("bundle"))["signatures"].first().vec == [2.0, -1.0]
    spark.createDataFrame([("P1", [1.0, -1.0], "m", ["T"], "CC")], "cand string, vec array<double>, moa string, targets array<string>, smiles string").write.parquet(at("bank"))
    (tmp_path / "q.csv").write_text("gene,s\nA,1.5\nB,-0.5\n")
    cli.main(["retrieve", "--query", at("q.csv"), "--genes", at("g.txt"), "--bank", at("bank"), "--out", at("out")])
    assert spark.read.option("header", True).csv(at("out/hits")).first().compound_id == "P1"
