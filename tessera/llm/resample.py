"""Target-distribution importance resampling over hashed word features.

Texts are counted once into a sparse document-by-bucket matrix, kept as a table of a row a document; a batch of its rows is a
CSR block. The matrix's column sums give the corpus's and the target's distributions over buckets, their log ratios the gain of each bucket, and the product
of matrix and gains the weight of each document. Gumbel noise from a keyed hash of the id turns the highest scores into a
draw without replacement in proportion to exp(weight / 1000).

Defined cases: a null or empty text has no feature, weight 0, and its noise as score; it can be drawn only where no word
is asked for. A null id is noised as `null`. Repeated rows are scored each on their own, share their noise, and rank next
to one another. An empty corpus gives an empty table; an empty target has no counts, so gains follow from the corpus
alone. Columns other than doc_id and text take no part and are not returned.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit as tk
from tessera.operators import order

BUCKETS = 10_000
SEED = 2024
LEAST = 20
PERCENT = 10

#: Bytes that part words: all of ASCII but digits and small letters. Capitals are made small first.
APART = np.ones(256, bool)
APART[np.r_[48:58, 97:123, 128:256]] = False
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32
LONG = 64  # longer words are hashed one by one

MATRIX = "doc_id long, words long, features long, bucket array<int>, n array<int>"
CELLS = 1 << 20  # counts of a block that are at work at once


def _remainders() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> 1) ^ np.where(out & 1, np.uint32(0xEDB88320), np.uint32(0))
    return out


REMAINDERS = _remainders()


def extended(crc: np.ndarray, body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of what each crc stands for with the bytes start to end behind it."""
    size = end - start
    turn = np.argsort(-size, kind="stable")
    out, at, size = crc[turn] ^ np.uint32(0xFFFFFFFF), start[turn], size[turn]
    far = int(np.searchsorted(-size, -LONG))  # so many are longer
    for j in range(int(size[far]) if far < len(size) else 0):
        live = slice(far, int(np.searchsorted(-size, -j)))
        out[live] = REMAINDERS[(out[live] ^ body[at[live] + j]) & 255] ^ (out[live] >> 8)
    out ^= np.uint32(0xFFFFFFFF)
    for k in range(far):
        out[k] = zlib.crc32(body[at[k] : at[k] + size[k]].tobytes(), int(crc[turn[k]]))
    back = np.empty_like(out)
    back[turn] = out
    return back


def features(body: np.ndarray, offs: np.ndarray, grams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and CRC-32 of every run of 1 to grams consecutive words, joined by a space; and the words of each row."""
    body = SMALL[body]
    start, end, row = tk.words(body, offs, APART)
    n = np.bincount(row, minlength=len(offs) - 1)
    crc, rows, out = np.zeros(len(start), np.uint32), [], []
    for k in range(grams):
        if k:
            crc = crc[: len(crc) - 1]
            crc = ~(REMAINDERS[(~crc ^ np.uint32(32)) & 255] ^ (~crc >> 8))
        crc = extended(crc, body, start[k:], end[k:])
        whole = row[: len(crc)] == row[k:]
        rows.append(row[: len(crc)][whole])
        out.append(crc[whole])
        if not len(crc):
            break
    return np.concatenate(rows), np.concatenate(out), n


def matrix(docs: DataFrame, buckets: int = BUCKETS, grams: int = 1) -> DataFrame:
    """The count matrix by rows: doc_id, words, features, and the buckets of a document with what each holds.

    A row has a number a bucket at most, however long its text, so what readers hold of many rows is bounded too.
    """

    def count(batches):
        for b in batches:
            ids = b.column("doc_id")
            for lo, hi, body, offs in tk.slices(b.column("text")):
                row, crc, words = features(body, offs, grams)
                cell, n = np.unique(row * buckets + crc % np.uint32(buckets), return_counts=True)
                size = np.diff(np.searchsorted(cell, np.arange(hi - lo + 1) * buckets))
                cols = [ids.slice(lo, hi - lo), tk.i64(words), tk.i64(np.bincount(row, minlength=hi - lo)), tk.lists(size, pa.array(cell % buckets, pa.int32())), tk.lists(size, pa.array(n, pa.int32()))]
                yield pa.record_batch(cols, names=["doc_id", "words", "features", "bucket", "n"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, MATRIX)


def csr(batch):
    """(first row, end row, start, bucket, n) for stretches of the batch's rows of about CELLS counts."""
    bucket, n = batch.column("bucket"), batch.column("n")
    at = np.concatenate(([0], np.cumsum(np.asarray(bucket.value_lengths()).astype(np.int64))))
    bucket, n = (c.flatten().to_numpy(zero_copy_only=False) for c in (bucket, n))
    lo = 0
    while lo < batch.num_rows:
        hi = min(max(int(np.searchsorted(at, at[lo] + CELLS, "right")) - 1, lo + 1), batch.num_rows)
        own = slice(at[lo], at[hi])
        yield lo, hi, at[lo : hi + 1] - at[lo], bucket[own], n[own].astype(np.int64)
        lo = hi


def column_sums(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket. One partial sum a task is shuffled; the driver gets one number a bucket."""

    def total(batches):
        out = np.zeros(buckets, np.int64)
        for b in batches:
            for *_, bucket, n in csr(b):
                np.add.at(out, bucket, n)
        some = np.flatnonzero(out)
        yield pa.record_batch([pa.array(some, pa.int32()), tk.i64(out[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("bucket", "n").mapInArrow(total, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to corpus in each bucket, one added to every count."""
    many, few, size = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((int(t) + 1) * (many + size) / ((int(s) + 1) * (few + size)))) for s, t in zip(corpus, target)], np.int64)


def weights(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of each document: the matrix times the gains."""

    def product(batches):
        for b in batches:
            for lo, hi, start, bucket, n in csr(b):
                sums = np.concatenate(([0], np.cumsum(gain[bucket] * n)))
                cols = [*(b.column(c).slice(lo, hi - lo) for c in ("doc_id", "words", "features")), tk.i64(sums[start[1:]] - sums[start[:-1]])]
                yield pa.record_batch(cols, names=["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(product, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int):
    """Thousandths of Gumbel noise, from 32 bits of a hash of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, seed: int = SEED, buckets: int = BUCKETS, grams: int = 1) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank (from 1) is null for those not drawn.

    Drawn are percent of the documents of at least so many words, those of the highest scores, ties to the smaller id.
    """
    counts = tk.written(matrix(docs, buckets, grams), "counts")
    gain = gains(column_sums(counts, buckets), column_sums(matrix(target.withColumn("doc_id", F.lit(None)), buckets, grams), buckets))
    scored = tk.written(weights(counts, gain).withColumn("score", F.col("weight") + noise(seed)), "weights")
    able = scored.where(F.col("n_words") >= least)
    draw = able.count() * percent // 100
    ranked = order.ranked_rows(able.withColumn("_row", F.monotonically_increasing_id()), [F.desc("score"), F.asc("doc_id"), F.asc("_row")])
    cols = ["doc_id", "n_features", "weight", "score"]
    drawn = ranked.select(*cols, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    return drawn.unionByName(scored.where(F.col("n_words") < least).select(*cols, F.lit(None).cast("long").alias("rank")))
