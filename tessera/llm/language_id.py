"""Language identification by a convolutional network over bytes.

Bytes are embedded, filters of two, three and four bytes run over fixed windows, each filter's largest response feeds a
softmax. Training is plain numpy on the driver, on a bounded sample of windows of labelled documents. A text is scored by
all its windows: the mean of their log-probabilities, weighted by their bytes. For scoring, embedding and filters are
folded into tables over pairs of bytes, so a response is two look-ups and a sum.

Bounded by parameters: SAMPLE documents in all, shared out evenly over all labels by a hash of the id, one of each label
at least, and PER_DOC windows of each. Only training is bounded; every label that has a text is learned, and texts are
scored whole, in slices of bounded memory.

Defined cases: null texts and texts without a letter are `und` with score 1; without any labelled text all are `und`;
repeated rows are predicted alike, and equally likely languages go to the first in alphabetical order; an empty table has
no predictions; columns other than doc_id, text and lang are not read, whatever their names.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit as tk

WINDOW, EMBED, FILTERS, WIDTHS = 256, 6, 8, (2, 3, 4)
SAMPLE, PER_DOC = 3000, 4
UNKNOWN = "und"


def windows(body: np.ndarray, offs: np.ndarray, size: int, spare: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed windows over each row, the last filled with zeros: bytes (windows by size + spare), row, real bytes."""
    count = -(-np.diff(offs) // size)
    row = np.repeat(np.arange(len(count)), count)
    start = offs[row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * size
    end = offs[row + 1]
    at = start[:, None] + np.arange(size + spare)
    real = at < np.minimum(end, start + size + spare)[:, None]
    out = np.where(real, body[np.minimum(at, max(len(body) - 1, 0))], 0).astype(np.uint8) if len(body) else np.zeros(at.shape, np.uint8)
    return out, row, np.minimum(size, end - start)


class ByteConvNet:
    def __init__(self, labels: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.labels, f = labels, FILTERS * len(WIDTHS)
        self.embed = r.normal(0, 0.5, (256, EMBED))
        self.filters = r.normal(0, 0.3, (max(WIDTHS), EMBED, f))
        for k, w in enumerate(WIDTHS):
            self.filters[w:, :, k * FILTERS : (k + 1) * FILTERS] = 0
        self.mask = self.filters != 0
        self.bias = np.zeros(f)
        self.out = r.normal(0, 0.1, (f, len(labels)))
        self.out_bias = np.zeros(len(labels))

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        each = [self.embed @ w for w in self.filters]
        n = x.shape[1] - max(WIDTHS) + 1
        resp = sum(t[x[:, k : k + n]] for k, t in enumerate(each))
        at = resp.argmax(1)
        return np.take_along_axis(resp, at[:, None], 1)[:, 0] + self.bias, at

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean weighted cross-entropy; they run only through the pooled places."""
        n = np.arange(len(x))
        pooled, at = self._pooled(x)
        h = np.maximum(pooled, 0)
        logit = h @ self.out + self.out_bias
        d = np.exp(logit - logit.max(1, keepdims=True))
        d /= d.sum(1, keepdims=True)
        d[n, y] -= 1
        d *= (weight / len(x))[:, None]
        g = {"out": h.T @ d, "out_bias": d.sum(0)}
        dh = (d @ self.out.T) * (pooled > 0)
        g["bias"] = dh.sum(0)
        g["filters"], g["embed"] = np.zeros_like(self.filters), np.zeros_like(self.embed)
        for k in range(len(self.filters)):
            seen = x[n[:, None], at + k]
            g["filters"][k] = np.einsum("bfe,bf->ef", self.embed[seen], dh)
            np.add.at(g["embed"], seen.ravel(), (dh[:, :, None] * self.filters[k].T).reshape(-1, EMBED))
        g["filters"] *= self.mask
        return g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 1200, batch: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on the cross-entropy, classes weighted alike."""
        r = np.random.default_rng(seed)
        weight = 1 / np.maximum(np.bincount(y, minlength=len(self.labels)), 1)
        weight = weight / weight[y].mean()
        names = ("embed", "filters", "bias", "out", "out_bias")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        for step in range(1, steps + 1):
            pick = r.integers(0, len(x), batch)
            g = self.gradients(x[pick], y[pick], weight[y[pick]])
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                now = rate * (1 - step / (steps + 1))
                setattr(self, k, getattr(self, k) - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses to a pair of bytes at the filters' first and second two places."""
        a, b, c, d = (self.embed @ w for w in self.filters)
        first = (a[:, None] + b[None]).reshape(65536, -1)
        second = (c[:, None] + d[None]).reshape(65536, -1)
        return first.astype(np.float32), second.astype(np.float32)

    def log_probs(self, x: np.ndarray, tables, chunk: int = 32) -> np.ndarray:
        first, second = tables
        n = x.shape[1] - max(WIDTHS) + 1
        pooled = np.empty((len(x), first.shape[1]), np.float32)
        for lo in range(0, len(x), chunk):
            part = x[lo : lo + chunk].astype(np.uint16)
            pair = part[:, :-1] * np.uint16(256) + part[:, 1:]
            pooled[lo : lo + chunk] = (first[pair[:, :n]] + second[pair[:, 2 : 2 + n]]).max(1)
        logit = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
        logit -= logit.max(1, keepdims=True)
        return logit - np.log(np.exp(logit).sum(1, keepdims=True))


SPARE = max(WIDTHS) - 1


def _draw(batches):
    """PER_DOC windows of each text, at places a hash of the text picks."""
    for b in batches:
        labels, out, of = b.column("lang").to_pylist(), [], []
        for lo, hi, body, offs in tk.slices(b.column("text")):
            x, row, _ = windows(body, offs, WINDOW, SPARE)
            first, end = tk.runs(row)
            for a, z in zip(first, end):
                pick = np.unique((np.arange(PER_DOC) * 2654435761 + int(x[a, :8].astype(np.int64).sum()) * 40503) % (z - a)) + a
                out += [w.tobytes() for w in x[pick]]
                of += [labels[lo + row[a]]] * len(pick)
        yield pa.record_batch([pa.array(of, pa.string()), pa.array(out, pa.binary())], names=["lang", "window"])


def learn(docs: DataFrame, fold, sample: int = SAMPLE, text: str = "text", label: str = "lang") -> ByteConvNet | None:
    """A network trained on rows of docs that fold, a condition, admits and that have a label."""
    told = docs.where(fold & F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (F.length(text) > 0))
    rows = told.select(F.col(label).cast("string").alias("lang"), F.col(text).cast("binary").alias("text"), F.xxhash64(F.col("doc_id"), F.lit("lang")).alias("hash"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("c"), F.min("hash").alias("first")).collect()  # labels, which the network holds as well
    if not counts:
        return None
    quota = max(1, sample // len(counts))
    shares = [(r.lang, r.first, (1 << 63) - 1 if quota >= r.c else (quota << 64) // r.c - (1 << 63)) for r in counts]
    shares = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, first long, share long"))
    drawn = rows.join(shares, "lang").where((F.col("hash") == F.col("first")) | (F.col("hash") <= F.col("share")))
    drawn = drawn.groupBy("lang", "hash").agg(F.min("text").alias("text"))  # a repeated id is drawn once
    drawn = drawn.select("lang", "text").mapInArrow(_draw, "lang string, window binary").collect()  # about PER_DOC * sample windows
    if not drawn:
        return None
    drawn.sort(key=lambda r: (r.lang, r.window))
    labels = sorted({r.lang for r in drawn})
    net = ByteConvNet(labels)
    x = np.frombuffer(b"".join(bytes(r.window) for r in drawn), np.uint8).reshape(-1, WINDOW + SPARE)
    net.train(x, np.array([labels.index(r.lang) for r in drawn]))
    return net


def _predict(model):
    def run(batches):
        net = model.value
        tables = net.tables() if net else None
        for b in batches:
            known = np.asarray(b.column("letter").fill_null(False).to_numpy(zero_copy_only=False), bool)
            best, score = np.array([UNKNOWN] * b.num_rows, object), np.ones(b.num_rows)
            if net:
                for lo, hi, body, offs in tk.slices(b.column("text")):
                    x, row, real = windows(body, offs, WINDOW, SPARE)
                    if not len(x):
                        continue
                    lp = net.log_probs(x, tables)
                    first, end = tk.runs(row)
                    mean = np.add.reduceat(lp * real[:, None], first, 0) / np.add.reduceat(real, first)[:, None]
                    p = np.exp(mean - mean.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    at = lo + row[first]
                    best[at], score[at] = np.array(net.labels, object)[p.argmax(1)], p.max(1)
                best[~known], score[~known] = UNKNOWN, 1.0
            rest = [b.column(c) for c in b.schema.names if c not in ("text", "letter")]
            yield pa.record_batch([*rest, pa.array(best, pa.string()), pa.array(np.clip(score, 0, 1))], names=[*(c for c in b.schema.names if c not in ("text", "letter")), "lang_pred", "score"])

    return run


def predict(docs: DataFrame, net: ByteConvNet | None) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    model = docs.sparkSession.sparkContext.broadcast(net)  # its size depends on the parameters alone
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).cast("binary").alias("text"), text.rlike(r"\p{L}").alias("letter"))
    return rows.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")
