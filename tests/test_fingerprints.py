import numpy as np
import pytest

from tessera.operators import fingerprints as fp


def brute(q, b, k):
    for name, x in q.items():
        u = {c: int(np.rint((x & y).sum() / max(1, (x | y).sum()) * 1e6)) for c, y in b.items()}
        best = sorted(((-v, c) for c, v in u.items()))[:k]
        yield from ((name, r + 1, c, -v) for r, (v, c) in enumerate(best))


@pytest.mark.parametrize("k", [1, 3, 500])
def test_nearest_equals_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(fp, "CHUNK", 5)
    r = np.random.default_rng(k)
    draw = lambda n, at: {f"{at}{i:03d}": r.random(130) < r.choice([0.02, 0.2, 0.5, 0.9]) for i in range(n)}
    q, b = draw(40, "q"), draw(90, "c")
    b["c003"], q["q001"], q["q002"], b["c050"] = b["c001"].copy(), b["c001"].copy(), np.zeros(130, bool), np.zeros(130, bool)
    for i in range(60, 80):
        b[f"c{i:03d}"] = b["c060"].copy()  # one large bucket
    table = lambda d, name: spark.createDataFrame([(n, [float(x) for x in v]) for n, v in d.items()] + [(None, [0.0] * 130), ("zz", None)], f"{name} string, bits array<double>").select(name, fp.packed("bits").alias("words")).repartition(3)
    got = fp.nearest(table(q, "query"), table(b, "cand"), k)
    assert sorted(tuple(x) for x in got.select("query", "r", "cand", "u").collect()) == sorted(brute(q, b, k))
    assert table(q, "query").where("query = 'q001'").first().words is not None and len(table(q, "query").first().words) == 3


def test_odd_tables(spark):
    a = spark.createDataFrame([("x", [1, 0, 1])], "query string, bits array<int>").select("query", fp.packed("bits").alias("words"))
    b = a.withColumnRenamed("query", "cand")
    assert [tuple(r) for r in fp.nearest(a, b).collect()] == [("x", 1, "x", 1_000_000)]
    assert fp.nearest(a.limit(0), b).count() == 0 and fp.nearest(a, b.limit(0), 2).count() == 0
    wide = spark.createDataFrame([("y", [1] * 70)], "cand string, bits array<int>").select("cand", fp.packed("bits").alias("words"))
    with pytest.raises(ValueError):
        fp.nearest(a, wide)


def test_scores_stay_in_the_jvm(spark):
    a = spark.createDataFrame([("x", [1, 0, 1])], "query string, bits array<int>").select("query", fp.packed("bits").alias("words"))
    plan = fp.nearest(a, a.withColumnRenamed("query", "cand"))._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan
