import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import storage
from tessera.models import spread, synthetic
from tessera.models import two_tower as tt


@pytest.fixture(scope="module")
def tables(spark):
    bank = synthetic.bank(spark, 30, bits=24, descriptors=3, seed=5).withColumn("label", F.col("pos") % 20)
    rows = synthetic.signatures(spark, 30, bits=24, genes=16, seed=5, most=12).select("pos", F.col("sig_id").alias("sig"), "vec")
    held = F.crc32("sig") % 5 == 0
    return tuple(storage.written(df, "drawn") for df in (bank, rows.where(~held), rows.where(held)))


def test_any_number_of_tasks_has_the_losses_of_training_in_one_place(tables):
    bank, rows, valid = tables
    c = tt.Config(embed=8, hidden=(12,), epochs=3, batch=16, rate=5e-3, dropout=0.0, patience=9)
    runs = [spread.train(rows, bank, c, n, valid) for n in (1, 3)]
    b = bank.orderBy("pos").collect()
    table = lambda df: df.orderBy("pos", F.md5("sig")).collect()
    x, v = table(rows), table(valid)
    model = tt.TwoTower(16, 27, 0, c)
    arrays = lambda t: (np.array([r.vec for r in t]), np.array([r.pos for r in t]))
    history = tt.train(model, *arrays(x), np.array([r.features for r in b]), [np.array([r.label for r in b])], arrays(v))
    for other, told in runs:
        assert np.allclose([h["loss"] for h in told[1:]], [h["loss"] for h in history[1:]], rtol=1e-9)
        assert np.allclose([h["valid"] for h in told], [h["valid"] for h in history])
        for side in ("signature", "molecule"):
            assert all(np.allclose(p, getattr(other, side).p[k], atol=1e-8) for k, p in getattr(model, side).p.items())
    assert history[-1]["loss"] < history[1]["loss"]


def test_refusals(tables):
    bank, rows, _ = tables
    with pytest.raises(ValueError, match="one place"):
        spread.train(rows, bank, tt.Config(lookup=True), 2)
    with pytest.raises(ValueError, match="lacks"):
        spread.train(rows, bank.where("pos > 3"), tt.Config(), 2)


def test_a_drawn_bank_is_the_same_on_any_partitioning(spark):
    a = synthetic.signatures(spark, 40, bits=20, genes=6, seed=2, most=50)
    b = synthetic.signatures(spark, 40, bits=20, genes=6, seed=2, most=50).sparkSession.range(40).repartition(7)
    got = sorted((r.sig_id, r.vec) for r in a.collect())
    alone = [r for k in (0, 13, 39) for r in got if r[0].startswith(f"S{k}:")]
    assert len(got) == len({s for s, _ in got}) and b.count() == 40
    pos = np.arange(40)
    assert sum(synthetic.depths(2, pos, 50)) == len(got) and len(alone) == sum(synthetic.depths(2, np.array([0, 13, 39]), 50))
    v = np.array([x for _, x in got])
    z = synthetic.normal(3, "noise", np.arange(20000))
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03 and abs(np.corrcoef(z[1:], z[:-1])[0, 1]) < 0.03 and np.isfinite(v).all()
    bank = synthetic.bank(spark, 40, bits=20, descriptors=2, seed=2).collect()
    clean = np.array([r.features[:20] for r in bank]) @ (synthetic.normal(2, "map", np.arange(20)[:, None], np.arange(6)) / np.sqrt(2))
    at = np.array([int(s[1 : s.index(":")]) for s, _ in got])
    order = {r.pos: k for k, r in enumerate(bank)}
    off = v - clean[[order[p] for p in at]]
    assert abs(off.std() - 0.35) < 0.05
