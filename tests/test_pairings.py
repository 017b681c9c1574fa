import itertools

import numpy as np

from tessera.operators import measures as ms


def test_every_pairing_has_one_number():
    for k in (2, 3, 4, 7):
        want = {(i, a, j, b) for i, j in itertools.combinations(range(k), 2) for a, b in itertools.permutations(range(k), 2)}
        got = ms.pairings(k, 10**6)
        assert len(got) == len(want) and set(got) == want


def test_more_than_asked_for_are_drawn_without_a_list():
    for k in (20, 300, 100_000):
        got = ms.pairings(k, 5000)
        assert len(set(got)) == 5000 and all(0 <= i < j < k and a != b and 0 <= a < k and 0 <= b < k for i, a, j, b in got)
        firsts = np.array([i + j for i, _, j, _ in got]) / (2 * k)
        assert abs(firsts.mean() - 0.5) < 0.03


def test_reliability_of_many_replicates(spark):
    r = np.random.default_rng(1)
    truth = r.normal(size=30)
    cells = [(g, side, rep, float((truth[g] if side == "treated" else 0) + 0.5 * r.normal())) for side, n in (("treated", 40), ("control", 60)) for rep in range(n) for g in range(30)]
    got = ms.reliability(spark.createDataFrame(cells, "gene long, side string, rep long, v double"), most=300).first()
    v = {(side, rep, g): x for g, side, rep, x in cells}
    rank = lambda t, c: np.argsort(np.argsort([v["treated", t, g] - v["control", c, g] for g in range(30)]))
    want = np.mean([np.corrcoef(rank(i, a), rank(j, b))[0, 1] for i, a, j, b in ms.pairings(40, 300)])
    assert got.k == 40 and got.pairings == 300 and abs(got.single - want) < 1e-9 and got.verdict == "high"
    flat = [(g, side, rep, 1.0) for side in ("treated", "control") for rep in range(2) for g in range(5)]
    none = ms.reliability(spark.createDataFrame(flat, "gene long, side string, rep long, v double")).first()
    assert (none.k, none.pairings, none.single, none.verdict) == (2, 0, None, None)
