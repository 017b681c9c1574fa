"""Diagnostics, splits and breakdowns against plain numpy, on tables with singletons, zero vectors and nulls."""

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, metrics, scorers, signal, splits, vectors


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def cos(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return a @ b / n if n else 0.0


def unit(x):
    return x / (np.linalg.norm(x, axis=-1, keepdims=True) + 1e-9)


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(5)
    rows, at = [], 0
    for g, n in enumerate((30, 25, 40, 12, 16, 1, 2, 20)):
        middle = r.normal(size=6)
        for _ in range(n):
            rows.append((at, g, (middle * r.uniform(0.2, 2) + r.normal(size=6)).tolist(), float(r.integers(0, 20)) if at % 7 else None, float(6 * (at % 5 + 1))))
            at += 1
    rows.append((at, 8, [0.0] * 6, 1.0, 24.0))
    rows.append((at + 1, 8, [0.0] * 6, 1.0, 24.0))
    df = spark.createDataFrame(rows, "key long, group long, vec array<double>, dose double, time double").repartition(3)
    return df, rows


def loo_of(rows):
    v, g = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    out = []
    for k in range(len(rows)):
        rest = v[(g == g[k]) & (np.arange(len(v)) != k)]
        out.append(round(cos(v[k], rest.mean(0)), 6) if len(rest) else 0.0)
    return np.array(out), np.linalg.norm(v, axis=1).round(6)


def arms_of(rows):
    loo, norm = loo_of(rows)
    dose, time = np.array([np.nan if r[3] is None else r[3] for r in rows]), np.array([r[4] for r in rows])
    q1, q2 = np.quantile(norm, 0.25), np.quantile(loo, 0.25)
    return [dose == dose + 0 * dose if False else np.ones(len(rows), bool), dose >= 1, dose >= 10, time >= 24, (dose >= 1) & (time >= 24), norm >= q1, loo >= q2, (loo >= q2) & (dose >= 1) & (time >= 24)]


def halves(rows, mask, arm, g, k):
    keys = [r[0] for r, m in zip(rows, mask) if m and r[1] == g]
    pick = sorted(keys, key=lambda x: (md5(f"{arm}|{x}"), x))[: 2 * k]
    v = {r[0]: np.array(r[2]) for r in rows}
    return np.mean([v[x] for x in pick[:k]], 0), np.mean([v[x] for x in pick[k:]], 0)


def test_quality_and_filter(data):
    df, rows = data
    loo, norm = loo_of(rows)
    got = {r.key: r for r in signal.quality(df).collect()}
    assert all(abs(got[r[0]].loo - x) < 3e-6 and abs(got[r[0]].norm - n) < 3e-6 for r, x, n in zip(rows, loo, norm))
    size = {g: sum(r[1] == g for r in rows) for g in range(9)}
    free = [r[0] % 2 == 0 for r in rows]
    pool = [f and size[r[1]] >= 2 for f, r in zip(free, rows)]
    cut = np.quantile(loo[pool], 0.3)
    want = {r[0]: not f or size[r[1]] >= 2 and (r[3] is not None and r[3] >= 2) and r[4] >= 12 and (not p or x >= cut) for r, f, p, x in zip(rows, free, pool, loo)}
    got = signal.quality_filter(df, 2, 2, 12, 0.3, restrict=F.col("key") % 2 == 0).collect()
    assert {r.key: r.keep for r in got} == want


def test_filter_comparison(data):
    df, rows = data
    k, flags = 2, arms_of(rows)
    common = [g for g in range(9) if all(sum(m and r[1] == g for r, m in zip(rows, f)) >= 2 * k for f in flags)]
    assert 1 < len(common) < 8
    got = {r.arm: r for r in signal.filter_comparison(signal.arms(df), k).collect()}
    means = [np.mean([cos(*halves(rows, f, a, g, k)) for g in common]) for a, f in enumerate(flags)]
    for a, f in enumerate(flags):
        r = got[a]
        assert r.n_groups == len(common) and abs(r.self_cosine - means[a]) < 2e-6 and abs(r.delta - (means[a] - means[0])) < 3e-6 and abs(r.kept - np.mean(f)) < 1e-6


def bits_of(rows, g):
    return (np.array(next(r[2] for r in rows if r[1] == g)) > 0).astype(float)


def tanimoto(a, b):
    both = a @ b
    return both / max(a.sum() + b.sum() - both, 1)


def test_pairs(spark, data):
    df, rows = data
    bits = spark.createDataFrame([(g, bits_of(rows, g).tolist()) for g in range(9)], "group long, bits array<double>")
    flags = [f for a, f in enumerate(arms_of(rows)) if a in (0, 1)]
    common = [g for g in range(9) if all(sum(m and r[1] == g for r, m in zip(rows, f)) >= 4 for f in flags)]
    got = {r.arm: r for r in signal.pair_correlation(signal.arms(df, ["none (baseline)", "dose >= 1 uM"]), bits, 2).collect()}
    for a, f in enumerate(flags):
        h = [halves(rows, f, a, g, 2) for g in common]
        half = np.mean([unit(x) @ unit(y) for x, y in h])
        full = [unit((x + y) / 2) for x, y in h]
        pairs = list(itertools.combinations(range(len(common)), 2))
        chem = [tanimoto(bits_of(rows, common[i]), bits_of(rows, common[j])) for i, j in pairs]
        r = np.corrcoef(chem, [full[i] @ full[j] for i, j in pairs])[0, 1]
        rel = 2 * half / (1 + half)
        assert got[a].n_groups == len(common) and abs(got[a].corr - r) < 2e-6 and abs(got[a].reliability - rel) < 2e-6 and abs(got[a].disattenuated - r / np.sqrt(max(rel, 1e-9))) < 1e-4

    notes = [(g, "m" + str(g % 2) if g else None, [str(g % 3), "x" if g > 3 else "y"], bits_of(rows, g).tolist()) for g in range(9)]
    table = spark.createDataFrame(notes, "group long, moa string, targets array<string>, bits array<double>")
    flag = np.ones(len(rows), bool)
    some = [g for g in range(1, 9) if sum(r[1] == g for r in rows) >= 4]
    h = {g: halves(rows, flag, 0, g, 2) for g in some}
    top = np.mean([unit(x) @ unit(y) for x, y in h.values()])
    kinds = {}
    for i, j in itertools.combinations(some, 2):
        c, chem = unit(sum(h[i]) / 2) @ unit(sum(h[j]) / 2), tanimoto(bits_of(rows, i), bits_of(rows, j))
        moa, target = notes[i][1] == notes[j][1], bool(set(notes[i][2]) & set(notes[j][2]))
        for name, yes in (("unrelated (baseline)", not moa and not target and chem < 0.4), ("Tanimoto >= 0.7", chem >= 0.7), ("same target", target), ("same MOA", moa), ("same target, Tanimoto < 0.4", target and chem < 0.4)):
            if yes:
                kinds.setdefault(name, []).append(c)
    got = {r.name: r for r in signal.annotation_similarity(df, table, 2, least=3, pairs_least=1).collect()}
    assert got and set(got) <= set(kinds)
    for name, r in got.items():
        assert r.n_pairs == len(kinds[name]) and abs(r.cosine - np.mean(kinds[name])) < 2e-6
        if "unrelated (baseline)" in kinds:
            base = np.mean(kinds["unrelated (baseline)"])
            assert abs(r.fraction - (np.mean(kinds[name]) - base) / max(top - base, 1e-9)) < 1e-4
    assert signal.annotation_similarity(df, table, 2).first().name == "too few annotated groups"

    desc = {g: np.random.default_rng(g).normal(size=8) for g in range(9)}
    table = spark.createDataFrame([(g, x.tolist()) for g, x in desc.items()], "group long, desc array<double>")
    some = [g for g in range(9) if sum(r[1] == g for r in rows) >= 4]
    h = {g: halves(rows, flag, 0, g, 2) for g in some}
    bio = [unit(sum(h[i]) / 2) @ unit(sum(h[j]) / 2) for i, j in itertools.combinations(some, 2)]
    rel = (lambda x: 2 * x / (1 + x))(np.mean([unit(x) @ unit(y) for x, y in h.values()]))
    want = []
    for b in range(4):
        x = [unit(desc[i][2 * b : 2 * b + 2]) @ unit(desc[j][2 * b : 2 * b + 2]) for i, j in itertools.combinations(some, 2)]
        want.append(np.corrcoef(x, bio)[0, 1])
    got = signal.block_correlation(df, table, 4, 2).orderBy("place").collect()
    assert [g.block for g in got] == np.argsort(-np.abs(want)).tolist()
    assert all(abs(g.corr - want[g.block]) < 2e-6 and abs(g.disattenuated - want[g.block] / np.sqrt(max(rel, 1e-9))) < 1e-4 for g in got)


def greedy(groups, shares):
    """groups: name to (members, weight). The rule, step by step."""
    n, w = sum(len(m) for m, _ in groups.values()), sum(x for _, x in groups.values())
    have, out = [[0, 0] for _ in shares], {}
    for name, (members, weight) in sorted(groups.items(), key=lambda x: (-x[1][1], -len(x[1][0]), min(x[1][0]))):
        cost = [max((h[0] + len(members)) / (s * n), (h[1] + weight) / (s * w)) if s else float("inf") for h, s in zip(have, shares)]
        at = cost.index(min(cost))
        have[at][0] += len(members)
        have[at][1] += weight
        out[name] = splits.NAMES[at]
    return out


@pytest.mark.parametrize("shares", [(0.8, 0.1, 0.1), (0.5, 0.0, 0.5)])
def test_group_split(spark, shares):
    r = np.random.default_rng(3)
    rows = [(k, None if k % 29 == 0 else f"g{int(r.zipf(1.6)) % 40}", float(r.integers(1, 9))) for k in range(400)]
    groups = {}
    for k, g, w in rows:
        if g:
            m = groups.setdefault(g, [[], 0])
            m[0].append(k)
            m[1] += w
    want = greedy(groups, shares)
    df = spark.createDataFrame(rows, "key long, g string, w double").repartition(3)
    out = splits.group_split(df, "g", "key", "w", shares)
    assert {(x.key, x.split) for x in out.collect()} == {(k, want[g] if g else "train") for k, g, _ in rows}
    assert splits.leak(out, "g").first().leaked == 0
    with pytest.raises(ValueError):
        splits.split(df, "none", "key")


def test_numbered_and_near_groups(spark):
    rows = [(int(x),) for x in np.random.default_rng(2).integers(0, 500, 300)]
    got = splits.numbered(spark.createDataFrame(rows, "x long").repartition(5), "x").collect()
    assert [r.x for r in sorted(got, key=lambda r: r.at)] == sorted(x for x, in rows) and sorted(r.at for r in got) == list(range(300))
    v = np.random.default_rng(7).normal(size=(12, 4))
    v = np.concatenate((v, v[:3] * 2, v[:2] + 1e-9, [v[0] + 1e-4]))
    got = {r.key: r.group for r in graph.near_groups(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(99, None)], "key long, vec array<double>"), "key", standardise=False).collect()}
    want = {k: None for k in range(len(v))} | {k: k for k in range(3)} | {12: 0, 13: 1, 14: 2, 15: 0, 16: 1, 17: 0, 99: None}
    assert got == want


def test_breakdown_and_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (0.4, 1.0, 0.0), (1.0, 1.0, 0.5)], "s double, model double, baseline double")
    got = {r.bin: r for r in metrics.breakdown(df, "s", [0, 0.4, 0.8, 1, 2]).collect()}
    assert np.isnan(got[0].ratio) and got[1].ratio == float("inf") and got[2].n == 0 and got[2].ratio is None and got[3].ratio == 2
    none = spark.createDataFrame([], "query long, truth long, rank0 long")
    assert metrics.recall(none).first().n_queries == 0 and metrics.macro_recall(none).first().macro_mrr is None
    signed = spark.createDataFrame([([3.0, 1.0, 2.0, 0.0],)], "vec array<double>")
    signed = scorers.signed(signed, 3).first().vec
    assert signed == [1, -1, -1, -1]  # where both claim a place, the low set has it
    zero = spark.createDataFrame([(1, [0.0, 0.0])], "cand long, vec array<double>")
    asks = spark.createDataFrame([(5, 1, [0.0, 0.0])], "query long, truth long, vec array<double>")
    assert vectors.ranked(asks, zero).ranks.first().rank0 == 0
