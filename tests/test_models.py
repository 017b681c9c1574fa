import math

import numpy as np
import pytest

from tessera.models import layers as ly
from tessera.models import two_tower as tt


def numeric(f, x, eps=1e-5):
    out = np.zeros_like(x)
    for i in np.ndindex(*x.shape):
        keep = x[i]
        x[i] = keep + eps
        a = f()
        x[i] = keep - eps
        out[i] = (a - f()) / (2 * eps)
        x[i] = keep
    return out


def test_functions():
    x = np.linspace(-8, 8, 3001)
    assert np.abs(ly.erf(x) - [math.erf(v) for v in x]).max() < 1e-10
    y, slope = ly.gelu(x)
    assert np.allclose(y, [v * (1 + math.erf(v / math.sqrt(2))) / 2 for v in x], atol=1e-9) and np.allclose(np.gradient(y, x)[1:-1], slope[1:-1], atol=1e-4)
    v, _ = ly.layer_norm(np.array([[1.0, 2, 3, 4]]), np.ones(4), np.zeros(4))
    assert np.allclose(v, (np.arange(4) - 1.5) / math.sqrt(1.25 + 1e-5))


@pytest.mark.parametrize("lookup", [False, True])
@pytest.mark.parametrize("weight,memory", [(0.0, False), (0.5, False), (0.0, True), (0.5, True)])
def test_gradients(lookup, weight, memory):
    r = np.random.default_rng(1)
    c = tt.Config(embed=5, hidden=(7,), dropout=0.0, lookup=lookup, sibling_weight=weight)
    model = tt.TwoTower(6, 4, 8, c)
    x, features, at, label = r.normal(size=(5, 6)), r.normal(size=(8, 4)), np.array([0, 2, 3, 5, 7]), np.array([0, 0, 0, 1, 1, 1, -1, -1])
    bank = tt.unit(r.normal(size=(8, 5)))[0] if memory else None
    inside = np.isin(np.arange(8), at) if memory else None
    same, kin = tt.alike((label[at], label[at])), tt.alike((label[at], label)) if memory else None

    def loss():
        q, k = model.signature.forward(x)[0], model._side(features, at)[0]
        return tt.contrast(q, k, float(model.scale["log"]), same, bank, kin, inside, weight)[0]

    q, kq = model.signature.forward(x)
    k, kk = model._side(features, at)
    _, dq, dk, ds = tt.contrast(q, k, float(model.scale["log"]), same, bank, kin, inside, weight)
    for side, got in ((model.signature, model.signature.backward(dq, kq)), (model.molecule, model.molecule.backward(dk, kk))):
        for name, g in got.items():
            assert np.allclose(g, numeric(loss, side.p[name]), atol=1e-6), name
    eps = 1e-6
    model.scale["log"] = model.scale["log"] + eps
    up = loss()
    model.scale["log"] = model.scale["log"] - 2 * eps
    assert abs((up - loss()) / (2 * eps) - ds) < 1e-5


def test_batches():
    compound = np.repeat(np.arange(9), [1, 2, 9, 30, 4, 4, 1, 70, 3])
    got = tt.batches(compound, 4, 10, np.random.default_rng(0))
    rows = np.concatenate(got)
    assert len(set(rows.tolist())) == len(rows) and all(len(np.unique(compound[b])) == len(b) > 1 for b in got)
    assert np.bincount(compound[rows], minlength=9).max() <= 10 and np.bincount(compound[rows], minlength=9).min() >= 1


@pytest.fixture(scope="module")
def trained():
    x, compound, features, label = tt.planted()
    test = np.random.default_rng(5).random(len(x)) < 0.2
    c = tt.Config(embed=16, hidden=(48,), epochs=25, batch=32, rate=5e-3, patience=25, bit_dropout=0.1, memory=True)
    model = tt.TwoTower(x.shape[1], features.shape[1], len(features), c)
    history = tt.train(model, x[~test], compound[~test], features, [label], (x[test], compound[test]))
    return model, history, x, compound, features, label, test


def test_training(trained):
    model, history, x, compound, features, label, test = trained
    chance = 10 / len(features)
    assert history[0]["valid"] < 3 * chance and not history[0]["suspicious"]
    assert max(h["valid"] for h in history) > 4 * chance and history[-1]["loss"] < history[1]["loss"]
    assert tt.recall(model, x[test], compound[test], features) == max(h["valid"] for h in history)
    again = tt.TwoTower(x.shape[1], features.shape[1], len(features), model.c).load(model.state())
    assert np.array_equal(again.keys(features), model.keys(features)) and np.isfinite(again.batch_loss(x, features, compound, [label]))
    with pytest.raises(ValueError):
        tt.TwoTower(x.shape[1] + 1, features.shape[1], len(features), model.c).load(model.state())
    assert tt.rate_at(0, 10, 100) == 0.1 and tt.rate_at(500, 10, 100) == pytest.approx(0)


def test_encode_and_retrieve(spark, trained):
    """Tables through the trained encoders and the ranking give what numpy gives."""
    from tessera.operators import metrics, vectors

    model, _, x, compound, features, _, test = trained
    asks = spark.createDataFrame([(int(k), int(compound[k]), x[k].tolist()) for k in np.flatnonzero(test)] + [(-1, 0, None)], "query long, truth long, vec array<double>")
    bank = spark.createDataFrame([(k, f.tolist()) for k, f in enumerate(features)], "cand long, vec array<double>")
    got = vectors.ranked(tt.encoded(asks, model.signature), tt.encoded(bank, model.molecule), 10)
    want = tt.recall(model, x[test], compound[test], features)
    assert metrics.macro_recall(got.ranks).first().macro_recall_10 == pytest.approx(want, abs=1e-6)
