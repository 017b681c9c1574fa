import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, metric, vectors


def roots(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        label[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(n)]


def clouds(seed, n=700, d=8):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, d))
    v[100:300] = v[0] + 0.02 * r.normal(size=(200, d))  # a clump
    v[300:400] = v[1] + np.linspace(0, 3, 100)[:, None] * r.normal(size=d)  # a chain
    v[400:450] = v[2] + 1e-5 * r.normal(size=(50, d))
    v[450] = 0
    return vectors.units(v)


@pytest.mark.parametrize("tolerance", [1e-6, 1e-3, 0.05, 0.4, 1.2])
def test_links_join_what_all_near_pairs_join(spark, monkeypatch, tolerance):
    monkeypatch.setattr(metric, "CELL", 20)
    monkeypatch.setattr(metric, "CHUNK", 40)
    v, least = clouds(3), round((1 - tolerance) * 1e6)
    near = np.rint(v @ v.T * 1e6) >= least
    items = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vec array<double>").repartition(4)
    links = [tuple(r) for r in metric.near_links(items, least).collect()]
    assert roots(len(v), links) == roots(len(v), list(zip(*np.nonzero(np.triu(near, 1)))))


def test_a_clump_gives_fewer_links_than_vectors_a_cell(spark):
    r = np.random.default_rng(1)
    v = vectors.units(np.ones(6) + 1e-4 * r.normal(size=(3000, 6)))
    items = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vec array<double>").repartition(4)
    assert metric.near_links(items, 999_000).count() == 2999


def test_cells_that_hold_no_pair_never_meet():
    v = vectors.units(np.random.default_rng(2).normal(size=(4000, 16)))
    centres = metric.apart(v[:40], 0.1)
    d = metric.distances(v, centres)
    home, reach = d.argmin(1), np.array([d[d.argmin(1) == c, c].max() for c in range(len(centres))])
    import pyarrow as pa

    batch = pa.record_batch([pa.array(np.arange(len(v))), vectors.listed(v), pa.array(home, pa.int32()), pa.array(np.zeros(len(v), bool))], names=["id", "vec", "home", "core"])
    met = sum(b.num_rows for b in metric._visits(centres, reach, np.ones(len(centres), int), 0.1)([batch]))
    assert met < 2 * len(v) + 0.05 * len(v) * len(centres)


def test_near_groups(spark):
    v = clouds(5)
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(900, v[7].tolist()), (901, None), (902, [float("nan")] * 8)], "key long, vec array<double>")
    got = {r.key: r.group for r in graph.near_groups(rows, "key", tolerance=0.05, standardise=False).collect()}
    near = np.rint(v @ v.T * 1e6) >= 950_000
    want = roots(len(v), [*zip(*np.nonzero(np.triu(near, 1)))])
    size = np.bincount(want, minlength=len(v))
    assert all(got[k] == (want[k] if size[want[k]] > 1 or k == 7 else None) for k in range(len(v)))
    assert got[900] == want[7] and got[901] is None and got[902] is None
    assert graph.near_groups(rows.where(F.lit(False)), "key").count() == 0


@pytest.mark.parametrize("tolerance", [0.4, 1.2])
def test_a_wide_radius_copies_vectors_a_bounded_number_of_times(spark, monkeypatch, tolerance):
    for name, value in (("CELL", 10), ("CHUNK", 60), ("COPIES", 4), ("PAIRS", 1000)):
        monkeypatch.setattr(metric, name, value, raising=False)
    v, least, grids, visits = clouds(4), round((1 - tolerance) * 1e6), [], metric._visits
    monkeypatch.setattr(metric, "_visits", lambda *grid: grids.append(grid) or visits(*grid))
    near = np.rint(v @ v.T * 1e6) >= least
    items = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vec array<double>").repartition(4)
    links = [tuple(r) for r in metric.near_links(items, least).collect()]
    assert roots(len(v), links) == roots(len(v), list(zip(*np.nonzero(np.triu(near, 1)))))
    (centres, _, chunks, _), = grids
    assert len(centres) == 1 and 1 < chunks[0] <= 4
