import numpy as np
import pytest

from tessera.operators import hubs, vectors


def some(seed, n=70, m=45, d=5):
    r = np.random.default_rng(seed)
    q, b = r.normal(size=(n, d)), r.normal(size=(m, d)) + [1.5, 0, 0, 0, 0]  # hubs
    b[40] = b[3]
    return vectors.units(q), vectors.units(b)


@pytest.mark.parametrize("small,keep", [(32 << 20, None), (32 << 20, 12), (0, None), (0, 12), (0, 45)])
def test_both_rankings_from_one_pass(spark, monkeypatch, small, keep):
    monkeypatch.setattr(vectors, "SMALL", small)
    q, b = some(4)
    truth = [f"c{k % 50:02d}" for k in range(70)]  # some that the bank lacks
    queries = spark.createDataFrame([(k, truth[k], x.tolist()) for k, x in enumerate(q)] + [(99, "c01", None)], "query long, truth string, vec array<double>").repartition(3)
    bank = spark.createDataFrame([(f"c{k:02d}", x.tolist()) for k, x in enumerate(b)], "cand string, vec array<double>").repartition(2)
    got = hubs.ranked(queries, bank, 5, 4, keep)
    cos = q @ b.T
    pen = np.sort(np.rint(cos * 1e6), 0)[-4:].mean(0) / 1e6
    assert {r.cand: round(r.penalty, 9) for r in got.penalty.collect()} == {f"c{k:02d}": round(p, 9) for k, p in enumerate(pen)}
    for ranking, score in ((got.plain, cos), (got.corrected, 2 * cos - pen)):
        u, top = np.rint(score * 1e6), {}
        for r in ranking.topk.collect():
            top.setdefault(r["query"], []).append((r.r, r.cand, r.u))
        ranks = {r["query"]: (r.truth, r.rank0) for r in ranking.ranks.collect()}
        assert set(top) == set(ranks) == set(range(70)) and ranking.n_bank == 45
        for k in range(70):
            best = sorted((-u[k, c], f"c{c:02d}") for c in range(45))[:5]
            assert all(i == j + 1 and c == d and abs(v + w) <= 1 for (i, c, v), (j, (w, d)) in zip(sorted(top[k]), enumerate(best)))
            at = int(truth[k][1:])
            assert ranks[k] == (truth[k], (u[k] > u[k, at]).sum() if at < 45 else 45)
    if keep == 12:
        assert 0 < got.open < 70  # some are ranked again, not all
    else:
        assert got.open == 0
    assert hubs.disagreement(queries, bank, got.corrected.ranks, got.penalty).first().difference == 0
    assert hubs.disagreement(queries, bank, got.plain.ranks).first().difference == 0
    wrong = got.plain.ranks.withColumn("rank0", got.plain.ranks.rank0 + 2)
    assert hubs.disagreement(queries, bank, wrong).first().difference == 2
