import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import measures, order


def test_ranks_are_gapless_and_follow_the_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 701).alias("v"), "id")
    got = order.ranked_rows(df, [F.desc("v"), F.asc("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001))
    assert [(r.v, r.id) for r in got] == sorted(((i * 7919 % 701, i) for i in range(5000)), key=lambda x: (-x[0], x[1]))
    assert order.ranked_rows(df.limit(0), [F.asc("v")]).count() == 0


def test_places_grow_by_one_within_a_partition(spark):
    rows = order.placed(spark.range(1000), [F.asc("id")]).orderBy("id").collect()
    assert all(b.place == a.place + 1 or (b.place >> order.PART) == (a.place >> order.PART) + 1 for a, b in zip(rows, rows[1:]))


def rows(seed, n):
    r = np.random.default_rng(seed)
    return [(str(k), 0.0 if u < 0.9 else float(x), float(y) if k else 1.0) for k, u, x, y in zip(r.choice([0, 1, 2, 3], n, p=[0.01, 0.9, 0.05, 0.04]), r.random(n), r.normal(size=n).round(1), r.normal(size=n).round(2))]


@pytest.mark.parametrize("large", [0, order.LARGE])
def test_quantiles_and_medians(spark, monkeypatch, large):
    monkeypatch.setattr(order, "LARGE", large)
    some = rows(1, 3000)
    df = spark.createDataFrame(some + [("9", None, 1.0), (None, 1.0, 1.0), ("8", 5.0, 1.0)], "k string, v double, w double").repartition(3)
    for q in (0.0, 0.25, 0.5, 0.77, 1.0):
        got = {r.k: r.q for r in order.quantile(df, ["k"], "w", q).collect()}
        for k in "123":
            assert abs(got[k] - np.quantile([w for a, _, w in some if a == k], q)) < 1e-9
    one = order.quantile(df, [], "v", 0.97).first().q
    assert abs(one - np.quantile([v for _, v, _ in some] + [1.0, 5.0], 0.97)) < 1e-9 or abs(one - np.quantile([v for _, v, _ in some] + [5.0, 1.0], 0.97)) < 1e-9
    assert order.quantile(df.limit(0), [], "v", 0.5).first().q is None and order.quantile(df.limit(0), ["k"], "v", 0.5).count() == 0
    got = {r.k: (r.median, r.mad) for r in measures.spread(df, ["k"], "w").collect()}
    for k in "123":
        v = np.array([w for a, _, w in some if a == k])
        assert np.allclose(got[k], (np.median(v), np.median(abs(v - np.median(v)))))


@pytest.mark.parametrize("large", [0, order.LARGE])
def test_spearman_with_a_common_value(spark, monkeypatch, large):
    monkeypatch.setattr(order, "LARGE", large)
    monkeypatch.setattr(order, "HEAVY", 3)
    some = rows(2, 2500)
    df = spark.createDataFrame(some + [("1", None, 1.0), (None, 1.0, 1.0)], "k string, a double, b double").repartition(3)
    got = {r.k: r.rho for r in order.spearman(df, "k", "a", "b").collect()}

    def rank(x):
        return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])

    for k in "123":
        a, b = (np.array([r[i] for r in some if r[0] == k]) for i in (1, 2))
        assert abs(got[k] - np.corrcoef(rank(a), rank(b))[0, 1]) < 1e-9
    assert got["0"] is None  # one side doesn't vary


def test_no_task_has_most_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(order, "LARGE", 0)
    df = spark.range(40_000).select(F.lit("hot").alias("k"), F.when(F.col("id") % 10 < 9, 0.0).otherwise(F.col("id").cast("double")).alias("v"))
    table = order.cumulative(df, ["k"], "v")
    assert table.agg(F.max("c")).first()[0] == 36_000 and table.count() == 4001
    files = table.groupBy(F.spark_partition_id()).count()
    largest = max(r["count"] for r in order.written(df.groupBy("k", "v").count().repartitionByRange(4, "k", "v").withColumn("p", F.spark_partition_id()), "x").groupBy("p").count().collect())
    assert largest < 2000 and files.count() >= 1


def test_windows_over_many_small_keys_hold_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(order, "LARGE", 50)
    df = spark.range(1600).select((F.col("id") % 40).alias("k"), (F.col("id") * 7919 % 1601).cast("double").alias("v"), (F.col("id") * 31 % 97).cast("double").alias("w"))
    table = order.cumulative(df, ["k"], "v")
    assert max(r["count"] for r in table.groupBy(F.spark_partition_id()).count().collect()) < 400  # 32 tasks for 1,600 rows
    got = order.spearman(df, "k", "v", "w")
    assert ", 32), REPARTITION_BY_NUM" in got._jdf.queryExecution().toString()
    assert got.count() == 40
