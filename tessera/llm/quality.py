"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes. Each passage is counted into hashed bytes and byte pairs and encoded;
a gated attention weighs the encodings, the weights summing to one over the bag, and the weighted sum is scored. Only
documents have labels; attention, encoder and score are learned together, in numpy on the driver, on a bounded sample of
labelled documents (SAMPLE documents, BAG passages of each, spread evenly over it). Every passage is scored in prediction.

Defined cases: a null or empty text is a bag of one empty passage; without labels the score is 0.5; a document with
several labels counts as often as it has them; null labels are left out, as are labels of null ids; repeated rows score
alike; a text of any length is scored by all its passages, in slices of bounded memory; an empty table has no scores;
columns other than doc_id and text pass through, whatever their names.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textkit as tk

PASSAGE, WIDTH, HIDDEN, GATE = 1024, 1024, 24, 12
SAMPLE, BAG = 4000, 24


def passages(body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage, and its row; a row has one at least."""
    size = np.diff(offs)
    count = np.maximum(-(-size // PASSAGE), 1)
    base = np.cumsum(count) - count
    row = np.repeat(np.arange(len(count)), count)
    total = int(count.sum())
    at = np.repeat(np.arange(len(size)), size)
    own = base[at] + (np.arange(len(body)) - offs[at]) // PASSAGE
    out = np.bincount(own * WIDTH + body, minlength=total * WIDTH)
    if len(body) > 1:
        pair = (body[:-1].astype(np.int64) * 256 + body[1:]) * 40503 % 65521 % (WIDTH - 256) + 256
        both = own[1:] == own[:-1]
        out = out + np.bincount((own[:-1] * WIDTH + pair)[both], minlength=total * WIDTH)
    x = np.log1p(out.reshape(total, WIDTH).astype(np.float32))
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1)
    return x, row


class AttentionBag:
    NAMES = ("w", "b", "v", "u", "a", "s", "c")

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.w, self.b = r.normal(0, 0.3, (WIDTH, HIDDEN)), np.zeros(HIDDEN)
        self.v, self.u, self.a = r.normal(0, 0.3, (HIDDEN, GATE)), r.normal(0, 0.3, (HIDDEN, GATE)), r.normal(0, 0.3, GATE)
        self.s, self.c = r.normal(0, 0.3, HIDDEN), np.zeros(1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.w + self.b)
        t, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        return h, t, g, (t * g) @ self.a

    def forward(self, x: np.ndarray, first: np.ndarray, own: np.ndarray):
        """first: where each bag begins; own: the bag of each passage."""
        h, t, g, e = self.encode(x)
        e = np.exp(e - np.maximum.reduceat(e, first)[own])
        att = e / np.add.reduceat(e, first)[own]
        z = np.add.reduceat(h * att[:, None], first, 0)
        return h, t, g, att, z, 1 / (1 + np.exp(-(z @ self.s + self.c)))

    def gradients(self, x: np.ndarray, first: np.ndarray, own: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of the bags, through score, attention and encoder."""
        h, t, g, att, z, p = self.forward(x, first, own)
        d = (p - y) / len(y)
        dz = d[:, None] * self.s
        dh = att[:, None] * dz[own]
        da = (h * dz[own]).sum(1)
        de = att * (da - np.add.reduceat(att * da, first)[own])
        dt, dg = de[:, None] * self.a * g * (1 - t * t), de[:, None] * self.a * t * g * (1 - g)
        dh += dt @ self.v.T + dg @ self.u.T
        dx = dh * (1 - h * h)
        return {"w": x.T @ dx, "b": dx.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "s": z.T @ d, "c": d.sum(keepdims=True)}

    def train(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        v = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        step, steps = 0, epochs * -(-len(bags) // batch)
        for _ in range(epochs):
            deal = r.permutation(len(bags))
            for lo in range(0, len(deal), batch):
                step += 1
                some = deal[lo : lo + batch]
                x = np.concatenate([bags[k] for k in some])
                size = np.array([len(bags[k]) for k in some])
                grad = self.gradients(x, np.cumsum(size) - size, np.repeat(np.arange(len(some)), size), y[some])
                for k in self.NAMES:
                    gk = grad[k] + 1e-5 * getattr(self, k)
                    m[k] = 0.9 * m[k] + 0.1 * gk
                    v[k] = 0.999 * v[k] + 0.001 * gk * gk
                    now = rate * (1 - step / (steps + 1))
                    setattr(self, k, getattr(self, k) - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))
        for k in self.NAMES:
            setattr(self, k, getattr(self, k).astype(np.float32))

    def score(self, x: np.ndarray, row: np.ndarray) -> np.ndarray:
        first, _ = tk.runs(row)
        own = np.cumsum(np.concatenate(([0], row[1:] != row[:-1])))
        return self.forward(x, first, own)[-1]


def _bag(batches):
    """BAG passages' bytes of each text, spread evenly over it."""
    for b in batches:
        out = []
        for text in tk.as_binary(b.column("text")):
            t = memoryview(text.as_buffer())
            n = max(1, -(-len(t) // PASSAGE))
            pick = range(n) if n <= BAG else [k * n // BAG for k in range(BAG)]
            out.append([bytes(t[k * PASSAGE : (k + 1) * PASSAGE]) for k in pick])
        yield pa.record_batch([b.column("y"), pa.array(out, pa.list_(pa.binary()))], names=["y", "bag"])


def learn(docs: DataFrame, labels: DataFrame, fold, sample: int = SAMPLE, label: str = "quality") -> AttentionBag | None:
    """A model of the labels of rows whose doc_id fold, a condition, admits."""
    told = labels.where(fold & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    told = told.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id", "y").limit(sample)  # bounded, so it may be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = texts.join(F.broadcast(told), "doc_id").select("y", "text").mapInArrow(_bag, "y double, bag array<binary>")
    got = rows.orderBy(F.xxhash64("bag"), "y").limit(2 * sample).collect()
    if not got:
        return None
    bags = []
    for r in got:
        sizes = [len(x) for x in r.bag]
        bags.append(passages(np.frombuffer(b"".join(bytes(x) for x in r.bag), np.uint8), np.array([0, sum(sizes)]))[0])
    model = AttentionBag()
    model.train(bags, np.clip(np.array([r.y for r in got]), 0, 1))
    return model


def _score(model, names: list[str]):
    def run(batches):
        net = model.value
        for b in batches:
            out = np.full(b.num_rows, 0.5)
            if net:
                for lo, hi, body, offs in tk.slices(b.column("text")):
                    x, row = passages(body, offs)
                    out[lo:hi] = net.score(x, row)
            yield pa.record_batch([*(b.column(c) for c in names), pa.array(out)], names=[*names, "score"])

    return run


def scored(docs: DataFrame, model: AttentionBag | None, with_text: bool = False) -> DataFrame:
    """row, a struct of the other columns, text, if asked for, and score: the likelihood that the label is 1."""
    net = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on the parameters alone
    rows = docs.select(tk.boxed(docs.drop("text")), F.col("text").cast("string").alias("text"))
    names = ["row", "text"] if with_text else ["row"]
    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_score(net, names), schema)


def stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score under one half; the others as they came, under whatever names their columns have.

    The model learns from all labels of the documents at hand. Without labels all documents score one half and stay; null
    and empty texts are scored as one empty passage; repeated rows score alike and stay or go together.
    """
    model = learn(docs, labels, F.lit(True))
    kept = scored(docs, model, with_text=True).where("score >= 0.5")
    return kept.select(*tk.unboxed(docs, text=F.col("text")))
