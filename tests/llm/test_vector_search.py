import numpy as np
import pytest

from tessera.llm import vector_search as vs


@pytest.mark.parametrize("block,first,dense,held", [(8192, 64, 256, 32768), (40, 3, 256, 3), (64, 2, 4, 7), (40, 12, 0, 5)])
def test_top_k(spark, block, first, dense, held):
    r = np.random.default_rng(3)
    v = r.normal(size=(400, 8)).round(1)
    v[50:90] = v[0]
    rows = [(i, v[i].tolist(), "x") for i in range(400)]
    rows += [(500, None, "x"), (600, [None] * 8, "x"), (700, [float("nan")] * 8, "x"), (800, [float("inf")] + [0.0] * 7, "x"), (900, [1.0, 2.0], "x"), (901, [1.0, 1.0], "x"), (1000, [], "x"), (None, v[1].tolist(), "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(3)
    got = vs.top_k(df, vs.F.col("vec_id") % 20 == 0, block=block, first=first, dense=dense, held=held).collect()
    whole = np.floor(1024 * v).astype(int)
    want = []
    for q in range(0, 400, 20):
        s = whole @ whole[q]
        best = sorted((-s[i], i) for i in range(400) if i != q)[:10]
        want += [(q, k, i, -x) for k, (x, i) in enumerate(best, 1)]
    want.append((900, 1, 901, 1024 * 1024 * 3))
    assert sorted(map(tuple, got)) == sorted(want)
    assert vs.top_k(df.limit(0), vs.F.col("vec_id") % 20 == 0).count() == 0


def test_copies_crowds_and_large_components(spark):
    r = np.random.default_rng(4)
    v = np.concatenate((np.tile(r.normal(size=6), (150, 1)), r.normal(size=6) + r.normal(size=(150, 6)) * 1e-3, r.normal(size=(50, 6)))).round(4)
    v[340:345] *= 1e9
    v[345] = 1e300
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(7, v[7].tolist()), (20, v[21].tolist())]
    got = vs.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), vs.F.col("vec_id") % 20 == 0, block=64, dense=20).collect()
    whole = [[int(y) for y in np.floor(1024 * np.array(x))] for _, x in rows]
    asks = {i: min(w for (j, _), w in zip(rows, whole) if j == i) for i, _ in rows if i % 20 == 0}
    clip = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    want = []
    for i, q in asks.items():
        score = sorted((-clip(sum(a * b for a, b in zip(q, w))), j) for (j, _), w in zip(rows, whole) if j != i)[:10]
        want += [(i, n, j, -s) for n, (s, j) in enumerate(score, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
