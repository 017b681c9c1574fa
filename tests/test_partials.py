import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import measures as ms
from tessera.sources import fetch, tables


def test_later_siblings_without_pairs(spark):
    r = random.Random(4)
    rows = [(k, r.choice("ab"), r.choice("xyz"), r.choice(["p", "q", None]), r.choice([1, 2])) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string, d long")
    lists = [["a", "b"], ["c", "d"], ["b", "d"]]
    got = {x.id: x.siblings for x in ms.later_siblings(df, "id", lists).collect()}
    at = {"a": 1, "b": 2, "c": 3, "d": 4}
    alike = lambda x, y: any(all(x[at[c]] is not None and x[at[c]] == y[at[c]] for c in one) for one in lists)
    want = {}
    for x, y in itertools.combinations(rows, 2):
        if alike(x, y):
            want[x[0]] = want.get(x[0], 0) + 1
    assert got == want


def test_a_split_left_empty_is_refused(spark):
    rows = spark.createDataFrame([("train", 1, 5), ("train", 1, 1), ("train", 2, 1), ("test", 3, 1)], "split string, item long, v long")
    kept, counts, lost = ms.filtered_by_split(rows, "split", "item", F.col("v") > 2, only="train")
    assert kept.count() == 2 and [tuple(x) for x in lost.collect()] == [("train", 2)]
    assert {x.split: (x.before, x.after) for x in counts.collect()} == {"train": (3, 1), "test": (1, 1)}
    with pytest.raises(ValueError, match="test"):
        ms.filtered_by_split(rows, "split", "item", F.col("v") > 2)


def test_stored_vectors_by_name_order_and_row(spark, tmp_path):
    path = f"{tmp_path}/v"
    tables.save_vectors(spark.createDataFrame([("1", [1.0, 2.0]), ("0", [3.0, 4.0])], "id string, embedding array<float>"), path, ["x", "y"])
    assert tables.block_names(spark, path) == ["x", "y"]
    bank = spark.createDataFrame([("0", 2), ("1", 1)], "id string, place long")
    assert [r.id for r in tables.load_vectors(spark, path, bank, "place").collect()] == ["1", "0"]
    assert tables.load_rows(spark, path, 2).count() == 2
    with pytest.raises(ValueError):
        tables.load_rows(spark, path, 3)
    tables.save_vectors(spark.createDataFrame([("1", [1.0]), ("1", [2.0]), ("0", [2.0])], "id string, embedding array<float>"), path)
    assert tables.block_names(spark, path) == []
    with pytest.raises(ValueError, match="several"):
        tables.load_vectors(spark, path, bank)


def test_the_release_is_a_catalogue(spark):
    got = fetch.catalogue(spark, fetch.release("https://example.org/data/"), "matrix").collect()
    assert len(fetch.RELEASE) == 5 and got[0].url.startswith("https://example.org/data/level5/") and got[0].bytes > 35e9
