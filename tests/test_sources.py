import pytest
from pyspark.sql import functions as F

from tessera.sources import tables as src


def put(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def test_metadata(spark, tmp_path):
    path = put(tmp_path, "sig.tsv", "sig_id\tpert_id\tpert_type\ttas\tcell_id\tpert_idose\tpert_itime\ns1\tp1\ttrt_cp\t0.5\tA\t10 uM\t24 h\ns2\tp2\tctl\tbad\tB\t\t1.2.3\n")
    a, b = src.signatures(spark, path).orderBy("sig_id").collect()
    assert (a.tas, a.dose, a.time, a.cell, a.is_exemplar) == (0.5, 10.0, 24.0, "A", None)
    assert (b.tas, b.dose, b.time) == (None, None, None)
    path = put(tmp_path, "c.txt", 'pert_id\tcanonical_smiles\tmoa\np1\tC"C\tx\np1\tCC\ty\np2\t\tz\n')
    assert sorted((r.pert_id, r.smiles, r.moa, r.target) for r in src.compounds(spark, path).collect()) == [("p1", 'C"C', "x", None), ("p2", None, "z", None)]


def test_queries_are_resolved(spark, tmp_path):
    path = put(tmp_path, "g.tsv", "gene_id\tgene_symbol\tensembl_id\tpr_is_lm\n7157\tTP53\tENSG1\t1\n12\t-\tENSG2\t1\n13\tTP53\t\t1\n99\tX\tENSG9\t0\n")
    known = src.genes(spark, path)
    assert [r.gene_id for r in known.orderBy("ord").collect()] == ["7157", "12", "13"]
    assert {r.alias: r.gene_id for r in src.gene_aliases(known).collect()} == {"TP53": "7157", "ENSG1": "7157", "ENSG2": "12"}
    query = src.query_table(spark, put(tmp_path, "q.csv", "gene,a,b.c\ntp53,2,x\n 7157 ,4,1\nXYZ,9,9\nensg2,,3\n"))
    got = {(r.gene_id, r.sample): r.value for r in src.resolved(query, known).collect()}
    assert got == {("7157", "a"): 3.0, ("7157", "b.c"): 1.0, ("12", "a"): None, ("12", "b.c"): 3.0}
    with pytest.raises(ValueError):
        src.query_table(spark, put(tmp_path, "one.csv", "gene\nTP53\n"))


def test_vectors_and_blocks(spark, tmp_path):
    path = str(tmp_path / "v")
    src.save_vectors(spark.createDataFrame([("a", [1.0, 2.0, 3.0, 4.0]), ("b", [5.0, 6.0, 7.0, 8.0])], "id string, embedding array<float>"), path)
    bank = spark.createDataFrame([("b", 1)], "id string, n int")
    got = src.select_blocks(src.load_vectors(spark, path, bank), ["x", "y"], ["y", "x"]).collect()
    assert [(r.id, r.n, r.embedding) for r in got] == [("b", 1, [7.0, 8.0, 5.0, 6.0])]
    with pytest.raises(ValueError):
        src.load_vectors(spark, path, bank.withColumn("id", F.lit("none")))
    with pytest.raises(ValueError):
        src.select_blocks(bank, ["x"], ["z"])


def test_sinks(spark, tmp_path):
    hits = spark.createDataFrame([("q", 1, "c1", 0.12345678, "m", "t", "C"), ("q", 2, "c2", 1234.5, None, "t", "C")], "query string, rank int, compound_id string, cosine double, moa string, target string, smiles string")
    src.save_hits(hits, str(tmp_path / "hits"))
    back = src.delimited(spark, str(tmp_path / "hits")).orderBy("rank").collect()
    assert [(r.compound_id, r.cosine, r.moa) for r in back] == [("c1", "0.123457", "m"), ("c2", "1234.500000", None)]
    src.save_report(hits, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2
