import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from tessera.llm import queries, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def small(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, target, percent=10, least=20, seed=2024, buckets=10000, grams=1):
    def cells(text):
        w = WORD.findall(small(text))
        return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, grams + 1) for i in range(len(w) - k + 1)]

    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for text, out in [(x, s) for _, x in docs] + [(x, t) for x in target]:
        for c in cells(text)[1]:
            out[c] += 1
    gain = [math.floor(1000 * math.log((int(b) + 1) * (int(s.sum()) + buckets) / ((int(a) + 1) * (int(t.sum()) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        w, c = cells(text)
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in c)
        rows.append([i, len(c), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


TEXT = "The QUICK brown-fox, jumps over 12 lazy dögs; Été naïve ÀB x_y " * 3
ROWS = [(1, TEXT), (2, None), (3, ""), (4, " .,;"), (5, TEXT), (5, TEXT), (None, TEXT + "end"), (7, "z" * 5000 + " " + TEXT), (8, "\x00a\x7fb" + TEXT), (9, "one two"), *[(100 + k, f"w{k} v{k % 3} " * (k % 40)) for k in range(200)]]


@pytest.mark.parametrize("grams", [1, 3])
def test_against_brute_force(spark, grams):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("weight", resample.F.lit("x")).withColumn("rank", resample.F.lit(0)).repartition(3)
    target = spark.createDataFrame([(1, "lazy dögs v1 w7"), (2, None)], "item_id long, text string")
    got = resample.resampled(docs, target, percent=30, grams=grams)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(ROWS, ["lazy dögs v1 w7", None], percent=30, grams=grams)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_empty_tables(spark):
    docs = spark.createDataFrame(ROWS[:6], "doc_id long, text string")
    got = resample.resampled(docs, docs.limit(0), percent=100)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(ROWS[:6], [], percent=100)
    assert resample.resampled(docs.limit(0), docs).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op12_importance_resampling"](spark, sf).collect()), key=str)
    assert got == brute(docs, target) and sum(r[4] is not None for r in got) > 5


def test_a_row_of_the_matrix_is_one_document_and_no_longer_than_the_buckets(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1)
    rows = resample.matrix(docs, buckets=50).collect()
    assert len(rows) == len(ROWS) and max(len(r.bucket) for r in rows) <= 50  # a reader's batch is counted in rows
    assert [sum(r.n) for r in rows] == [r.features for r in rows]
    whole = resample.column_sums(resample.matrix(docs))
    monkeypatch.setattr(resample, "CELLS", 7)  # stretches of a batch
    batch = resample.matrix(docs).toArrow().combine_chunks().to_batches()[0]
    parts = list(resample.csr(batch))
    assert [p[0] for p in parts] == [0, *(p[1] for p in parts[:-1])] and parts[-1][1] == len(ROWS)
    assert sum(int(p[4].sum()) for p in parts) == whole.sum()
    assert all(p[1] - p[0] == 1 or len(p[3]) <= 7 for p in parts)
