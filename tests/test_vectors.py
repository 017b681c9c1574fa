import numpy as np
import pytest

from tessera.operators import vectors as ve


def some(n, m, d, seed):
    r = np.random.default_rng(seed)
    return r.normal(size=(n, d)), r.normal(size=(m, d))


def test_consensus(spark, monkeypatch):
    monkeypatch.setattr(ve, "KEYS", 3)
    v = np.random.default_rng(1).normal(size=(200, 5))
    rows = [(k % 7, x.tolist()) for k, x in enumerate(v)] + [(None, [0.0] * 5), (3, None), (9, [2.0] * 5)]
    got = {r.label: (r.vec, r.n) for r in ve.consensus(spark.createDataFrame(rows, "label long, vec array<double>").repartition(4), "label").collect()}
    assert set(got) == {*range(7), 9} and got[9] == ([2.0] * 5, 1)
    for k in range(7):
        assert np.allclose(got[k][0], v[k::7].mean(0)) and got[k][1] == len(v[k::7])


@pytest.mark.parametrize("penalty", [False, True])
@pytest.mark.parametrize("block,held,small", [(1024, 65536, 32 << 20), (7, 20, 32 << 20), (1024, 65536, 0), (7, 20, 0)])
def test_ranked(spark, monkeypatch, penalty, block, held, small):
    monkeypatch.setattr(ve, "SMALL", small)
    monkeypatch.setattr(ve, "BLOCK", block)
    monkeypatch.setattr(ve, "HELD", held)
    q, b = some(60, 45, 6, 2)
    b[40] = b[3]  # a tie
    b[41] = 0
    name = lambda k: f"c{k:02d}"
    truth = [name(k % 50) if k else None for k in range(60)]  # some truths the bank lacks
    queries = spark.createDataFrame([(k, truth[k], x.tolist()) for k, x in enumerate(q)] + [(99, "c01", None)], "query long, truth string, vec array<double>").repartition(3)
    bank = spark.createDataFrame([(name(k), x.tolist()) for k, x in enumerate(b)], "cand string, vec array<double>").repartition(2)
    cos = (q / (np.linalg.norm(q, axis=1, keepdims=True) + 1e-9)) @ (b / (np.linalg.norm(b, axis=1, keepdims=True) + 1e-9)).T
    if penalty:
        bank = ve.hub_penalty(queries, bank, 4)
        cos = 2 * cos - np.sort(cos, 0)[-4:].mean(0)
    got = ve.ranked(queries, bank, 10, penalty=penalty)
    top, ranks = {}, {r["query"]: r.rank0 for r in got.ranks.collect()}
    for r in got.topk.collect():
        top.setdefault(r["query"], []).append((r.r, r.cand, r.u))
    assert got.n_bank == 45 and set(top) == set(ranks) == set(range(60))
    near = lambda a, b: abs(a - b) <= 2
    for k in range(60):
        u = np.rint(cos[k] * 1e6)
        best = sorted((-u[c], name(c)) for c in range(45))[:10]
        mine = sorted(top[k])
        assert [r for r, *_ in mine] == list(range(1, 11)) and all(near(m[2], -w[0]) for m, w in zip(mine, best))
        if not penalty:
            assert [m[1] for m in mine] == [w[1] for w in best]
        known = truth[k] is not None and int(truth[k][1:]) < 45
        assert ranks[k] == ((u > u[int(truth[k][1:])] + 0.5).sum() if known else 45)


def test_empty(spark):
    q, b = some(3, 3, 2, 1)
    queries = spark.createDataFrame([(k, k, x.tolist()) for k, x in enumerate(q)], "query long, truth long, vec array<double>")
    bank = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(b)], "cand long, vec array<double>")
    assert ve.ranked(queries.limit(0), bank).topk.count() == 0
    got = ve.ranked(queries, bank.limit(0))
    assert got.topk.count() == 0 and all(r.rank0 == 0 for r in got.ranks.collect())


def test_odd_vectors_are_refused_or_left_out(spark):
    kind = "key string, vec array<double>"
    ragged = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("a", [0.0, 1.0, 0.0, 5.0, 6.0])], kind)
    for df in (ragged.coalesce(1), ragged.repartition(2)):
        with pytest.raises(Exception, match="different lengths"):
            ve.consensus(df, "key").collect()
    odd = spark.createDataFrame([("a", [1.0, 3.0]), ("a", [None, 1.0]), ("a", [float("nan"), 1.0]), ("a", [float("inf"), 1.0]), ("b", [None, None])], kind)
    assert [(r.key, r.vec, r.n) for r in ve.consensus(odd, "key").collect()] == [("a", [1.0, 3.0], 1)]
    asks = odd.withColumnRenamed("key", "query").withColumn("truth", ve.F.lit(None))
    got = ve.ranked(asks, odd.limit(1).withColumnRenamed("key", "cand"))
    assert [(r["query"], r.cand) for r in got.topk.collect()] == [("a", "a")]


@pytest.mark.parametrize("small", [0, 32 << 20])
def test_repeated_ids_are_refused(spark, monkeypatch, small):
    monkeypatch.setattr(ve, "SMALL", small)
    bank = spark.createDataFrame([(k, [1.0 * k, 1.0]) for k in range(5)], "cand long, vec array<double>")
    twice = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 0, [0.0, 1.0])], "query long, truth long, vec array<double>")
    with pytest.raises(Exception, match="same id"):
        ve.ranked(twice, bank, 2).topk.collect()
    with pytest.raises(Exception, match="same id"):
        ve.ranked(twice, bank, 2).ranks.collect()
    with pytest.raises(ValueError, match="same id"):
        ve.ranked(twice.limit(1), bank.unionByName(bank), 2)


def test_ready_scores(spark):
    r = np.random.default_rng(8)
    u = r.integers(0, 6, size=(20, 9)) / 4
    rows = [(q, f"c{c}", float(u[q, c])) for q in range(20) for c in range(9) if (q, c) != (3, 4)] + [(3, "c4", None), (5, None, 9.0)]
    truths = spark.createDataFrame([(q, f"c{q % 10}") for q in range(21)], "query long, truth string")
    scores = spark.createDataFrame(rows, "query long, cand string, score double").repartition(3)
    got = ve.from_scores(scores, truths, 4)
    ranks = {x["query"]: x.rank0 for x in got.ranks.collect()}
    for q in range(20):
        have = {c: s for a, c, s in rows if a == q and c and s is not None}
        own = have.get(f"c{q % 10}")
        assert ranks[q] == sum(own is None or s > own for s in have.values())
        best = sorted((-s, c) for c, s in have.items())[:4]
        assert [(x.cand, x.u) for x in got.topk.where(f"query = {q}").orderBy("r").collect()] == [(c, round(-s * 1e6)) for s, c in best] if q < 2 else True
    assert ranks[20] == 0 and got.n_bank == 9 and ve.from_scores(scores.limit(0), truths).topk.count() == 0
    with pytest.raises(Exception, match="scored twice"):
        ve.from_scores(scores.unionByName(scores), truths).topk.collect()
