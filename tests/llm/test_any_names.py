"""Stages on tables with odd rows and with columns named like those that the operators add."""

import corpus_pipeline as cp
import pytest

from tessera.llm import decontaminate, near_dup, packing, quality, suffix_dedup

NAMES = "row id hash order tx key class_id spans h g s n at kinds asked bytes _id _tx _t _score _bytes score left body hits words item node bag bucket comp w low one d t m want shift letter y a.b x`y".split()
LONG = "the quick brown fox jumps over the lazy dog and runs far away into the green hills beyond " * 4


def rows():
    texts = [None, "", "   ", "short", LONG, LONG + "end", LONG, "unlike all of the others here", "x" * 3000, None]
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 9, 1]
    out = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)]
    return out + [(5, LONG, "en", "s", len(LONG)), (None, "no id", None, None, 5), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    return plain.withColumns({c: packing.F.lit(f"v{k}") for k, c in enumerate(NAMES)}).repartition(3)


@pytest.fixture(scope="module")
def tables(spark):
    labels = spark.createDataFrame([(5, 1, 0), (8, 1, 0), (9, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    marks = spark.createDataFrame([(1, "unlike all of the others here"), (2, None)], "item_id long, text string")
    return labels, marks


@pytest.mark.parametrize("name", ["quality", "near_dup", "suffix_dedup", "decontaminate"])
def test_stages_keep_all_columns(docs, tables, name):
    stage = {"quality": lambda d: quality.stage(d, tables[0]), "near_dup": near_dup.stage, "suffix_dedup": suffix_dedup.stage, "decontaminate": lambda d: decontaminate.stage(d, tables[1])}[name]
    out = stage(docs)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    got = [r.asDict() for r in out.collect()]
    assert got and all(r[c] == f"v{k}" for r in got for k, c in enumerate(NAMES))
    before = sorted((str(r[0]), str(r[1])) for r in rows())
    after = sorted((str(r["doc_id"]), str(r["text"])) for r in got)
    if name == "near_dup":
        assert [a[0] for a in after] == sorted(["1", "2", "3", "4", "5", "8", "9", "None", "None"])
    elif name == "suffix_dedup":
        assert len(after) == len(before) and all(len(r["text"] or "") == (r["n_chars"] or 0) for r in got)
    elif name == "decontaminate":
        assert after == [x for x in before if x[0] != "8"]
    else:
        assert all(x in before for x in after)
    assert stage(docs.limit(0)).count() == 0


def test_packing_ignores_other_columns(docs):
    out = packing.pack(docs, cp.vocabulary(cp.WORD_BPE))
    assert out.select("doc_id").count() >= len(rows()) and packing.pack(docs.limit(0), cp.vocabulary(cp.WORD_BPE)).count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_run_on_odd_tables(spark, tmp_path, docs, tables, empty):
    cut = (lambda d: d.limit(0)) if empty else (lambda d: d)
    for name, df in (("documents", docs.drop("a.b", "x`y")), ("labels", tables[0]), ("benchmark", tables[1])):
        cut(df).write.parquet(f"{tmp_path}/{name}.parquet")
    out = cp.run(spark, str(tmp_path)).collect()
    assert (not out) == empty
    ends = {}
    for r in out:
        ends[r.sequence_id] = ends.get(r.sequence_id, 0) + r.length
    assert all(n <= 2048 for n in ends.values())
