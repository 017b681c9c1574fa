import numpy as np

from tessera.llm import language_id as li
from tessera.llm import quality as q


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


def test_windows_cover_all_bytes():
    body = np.arange(1, 101, dtype=np.uint8)
    x, row, real = li.windows(body, np.array([0, 0, 30, 100]), 16, 3)
    assert real.sum() == 100 and row.tolist() == [1, 1, 2, 2, 2, 2, 2]
    assert x[1, :14].tolist() == list(range(17, 31)) and not x[1, 14:].any()


def test_tables_equal_filters():
    net = li.ByteConvNet(["a", "b"])
    x = np.random.default_rng(1).integers(0, 256, (9, li.WINDOW + li.SPARE)).astype(np.uint8)
    h = np.maximum(net._pooled(x)[0], 0) @ net.out + net.out_bias
    want = h - np.log(np.exp(h).sum(1, keepdims=True))
    assert np.allclose(net.log_probs(x, net.tables()), want, atol=1e-4)


def test_language(spark):
    r = np.random.default_rng(2)
    say = {"xx": ["lorem", "ipsum", "dolor"], "yy": ["über", "straße", "nicht"], "zz": ["qui", "où", "être"]}
    rows = [(i, " ".join(r.choice(say[k], 40)), k) for i, k in enumerate(list(say) * 60)]
    rows += [(900, None, "xx"), (901, "123 !!", "xx"), (902, "", None), (903, "über straße nicht " * 3000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", li.F.lit(1)).withColumn("letter", li.F.lit(2))
    net = li.learn(docs, li.F.col("doc_id") % 2 == 0)
    got = {x.doc_id: x for x in li.predict(docs, net).collect()}
    assert len(got) == len(rows) and got[900].lang_pred == got[901].lang_pred == got[902].lang_pred == "und" and got[903].lang_pred == "yy"
    assert np.mean([got[i].lang_pred == k for i, _, k in rows[1:180:2]]) > 0.97
    assert li.learn(docs.limit(0), li.F.lit(True)) is None
    assert {x.lang_pred for x in li.predict(docs, None).collect()} == {"und"}


def test_attention_gradient():
    model = q.AttentionBag()
    r = np.random.default_rng(4)
    x, size, y = r.random((6, q.WIDTH)) * 0.05, np.array([1, 3, 2]), np.array([1.0, 0.0, 1.0])
    first, own = np.cumsum(size) - size, np.repeat(np.arange(3), size)
    loss = lambda: float(-np.mean(y * np.log(p := model.forward(x, first, own)[-1]) + (1 - y) * np.log(1 - p)))
    got = model.gradients(x, first, own, y)
    for k in ("b", "v", "u", "a", "s", "c"):
        assert np.allclose(got[k], numeric(loss, getattr(model, k)), atol=1e-6), k
    some = model.w[:7]  # a view: its first rows stand for all
    assert np.allclose(got["w"][:7], numeric(loss, some), atol=1e-6)


def test_convolution_gradient():
    net = li.ByteConvNet(["a", "b", "c"])
    r = np.random.default_rng(3)
    x, y, weight = r.integers(97, 105, (5, 40)).astype(np.uint8), np.array([0, 1, 2, 1, 0]), np.array([1.0, 2.0, 0.5, 2.0, 1.0])

    def loss():
        logit = np.maximum(net._pooled(x)[0], 0) @ net.out + net.out_bias
        logp = logit - np.log(np.exp(logit).sum(1, keepdims=True))
        return float(-(weight * logp[np.arange(5), y]).mean())

    got = net.gradients(x, y, weight)
    for k in ("out", "out_bias", "bias"):
        assert np.allclose(got[k], numeric(loss, getattr(net, k)), atol=1e-6), k
    assert np.allclose(got["embed"][97:105], numeric(loss, net.embed[97:105]), atol=1e-5)
    assert np.allclose(got["filters"], numeric(loss, net.filters) * net.mask, atol=1e-5)


def test_held_out_quality_and_language(spark):
    """The queries themselves: what they learned from the other folds holds on the rows held out."""
    from tessera.llm import queries

    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.lang for r in queries.table(spark, sf, "documents").select("doc_id", "lang").collect()}
    got = [(r.lang_pred, docs[r.doc_id]) for r in queries.op2_language_id(spark, sf).where("held_out and lang_pred <> 'und'").collect()]
    assert len(got) > 150 and np.mean([a == b for a, b in got if b]) >= 0.97
    label = {r.doc_id: r.quality for r in queries.table(spark, sf, "labels").where("quality is not null").collect()}
    told = [(r.score, label[r.doc_id]) for r in queries.op8_quality_classifier(spark, sf).where("held_out").collect() if r.doc_id in label]
    good, bad = (np.array([s for s, y in told if y == k]) for k in (1, 0))
    assert len(told) > 80 and (good[:, None] > bad).mean() >= 0.97 and np.mean([(s >= 0.5) == y for s, y in told]) >= 0.93


def test_ties_and_repeated_rows(spark):
    rows = [(1, "same words here", "b"), (1, "same words here", "a"), (2, "same words here", "a"), (2, "same words here", "b")] * 5 + [(None, "same words here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = li.learn(docs, li.F.lit(True))
    assert net.labels == ["a", "b"] and len({(r.lang_pred, r.score) for r in li.predict(docs, net).collect()}) == 1
    model = q.learn(docs, docs.selectExpr("doc_id", "int(lang = 'a') as quality"), li.F.lit(True))
    got = q.scored(docs, model).collect()
    assert len(got) == len(rows) and len({r.score for r in got}) == 1


def test_quality(spark):
    r = np.random.default_rng(6)
    good, bad = ["the", "river", "house", "green"], ["$$$", "!!!", "||", "###"]
    rows = [(i, " ".join(r.choice(good if i % 3 else bad, 30 + i % 400))) for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "the river")], "doc_id long, text string").withColumn("y", q.F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(400)] + [(3, None, 1), (None, 1, 1)], "doc_id long, quality int, y int")
    model = q.learn(docs, labels, q.F.col("doc_id") % 2 == 0)
    got = {x.row.doc_id: x.score for x in q.scored(docs, model).collect()}
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == (i % 3 > 0) for i in range(1, 400, 2)]) > 0.97
    kept = q.stage(docs, labels)
    assert kept.columns == docs.columns
    assert q.learn(docs, labels.limit(0), q.F.lit(True)) is None and q.scored(docs.limit(0), model).count() == 0
