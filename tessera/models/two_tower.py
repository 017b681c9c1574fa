"""Two encoders into one space, trained against each other: responses on one side, features of compounds on the other.

Training runs in numpy on the driver, on the arrays it is given; encoding a table runs in tasks.
"""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.models.layers import Perceptron, unit, unit_back
from tessera.operators.vectors import matrix

MASKED, MOST_SCALE = -1e4, 100.0


@dataclass
class Config:
    """Of a run. The defaults."""

    embed: int = 256
    hidden: tuple[int, ...] = (1024, 512)
    dropout: float = 0.1
    bit_dropout: float = 0.0
    n_bits: int | None = None
    lookup: bool = False
    temperature: float = 0.07
    learn_scale: bool = True
    epochs: int = 60
    batch: int = 512
    rate: float = 3e-4
    decay: float = 1e-4
    molecule_decay: float | None = None
    warm: float = 0.05
    clip: float = 1.0
    patience: int = 10
    cap: int = 60
    sibling_weight: float = 0.0
    memory: bool = False
    seed: int = 0
    monitor: str = "valid"
    extra: dict = field(default_factory=dict)


class SignatureEncoder:
    def __init__(self, width: int, c: Config):
        self.net = Perceptron([width, *c.hidden, c.embed], c.dropout, c.seed + 1)
        self.p = self.net.p

    def forward(self, x, rng=None):
        z, kept = self.net.forward(x, rng)
        y, u = unit(z)
        return y, (kept, u)

    def backward(self, d, kept):
        return self.net.backward(unit_back(d, kept[1]), kept[0])[0]


class MoleculeEncoder:
    """Features to the shared space; in training a share of the leading bits may be hidden."""

    def __init__(self, width: int, c: Config):
        self.net = Perceptron([width, *c.hidden, c.embed], c.dropout, c.seed + 2)
        self.p, self.hide, self.cut = self.net.p, c.bit_dropout, width if c.n_bits is None else c.n_bits

    def forward(self, x, rng=None):
        if rng is not None and self.hide:
            x = x.copy()
            x[:, : self.cut] *= (rng.random((len(x), self.cut)) >= self.hide) / (1 - self.hide)
        z, kept = self.net.forward(x, rng)
        y, u = unit(z)
        return y, (kept, u)

    def backward(self, d, kept):
        return self.net.backward(unit_back(d, kept[1]), kept[0])[0]


class Lookup:
    """A free vector a compound, by its place: it can say nothing of a compound that it has not met."""

    def __init__(self, n: int, c: Config):
        self.p = {"table": np.random.default_rng(c.seed + 3).normal(0, 0.02, (n, c.embed))}

    def forward(self, at, rng=None):
        y, u = unit(self.p["table"][at])
        return y, (at, u)

    def backward(self, d, kept):
        g = np.zeros_like(self.p["table"])
        np.add.at(g, kept[0], unit_back(d, kept[1]))
        return {"table": g}


def softmax_loss(logits: np.ndarray, target: np.ndarray):
    """Mean cross-entropy of rows against target shares, and the logits' gradient."""
    z = logits - logits.max(1, keepdims=True)
    log = z - np.log(np.exp(z).sum(1, keepdims=True))
    return float(-(target * log).sum(1).mean()), (np.exp(log) - target) / len(logits)


def one_way(logits: np.ndarray, same: np.ndarray, weight: float):
    """Row k's own column is k. Siblings (same) are neither right nor wrong, or share in being right by the weight."""
    own = np.zeros(logits.shape, bool)
    own[np.arange(len(logits)), np.arange(len(logits))] = True
    siblings = same & ~own
    target = own.astype(float)
    if weight <= 0:
        gone = siblings
    else:
        gone = logits <= MASKED / 2
        live = siblings & ~gone
        target += weight * live / np.maximum(live.sum(1, keepdims=True), 1)
        target /= target.sum(1, keepdims=True)
    loss, d = softmax_loss(np.where(gone, MASKED, logits), target)
    return loss, np.where(gone, 0, d)


def contrast(q: np.ndarray, k: np.ndarray, log_scale: float, same: np.ndarray | None = None, memory=None, same_memory=None, in_batch=None, weight: float = 0.0):
    """Loss of queries against keys and back, and gradients by q, k and log_scale.

    memory: vectors of all compounds, as further wrong answers for the queries; those in_batch are left out.
    """
    scale = min(np.exp(log_scale), MOST_SCALE)
    cos = q @ k.T
    same = np.zeros(cos.shape, bool) if same is None else same
    there, wide = cos * scale, same
    if memory is not None and len(memory):
        far = scale * q @ memory.T
        kin = np.zeros(far.shape, bool) if same_memory is None else same_memory.copy()
        if in_batch is not None:
            far[:, in_batch] = MASKED
            kin[:, in_batch] = False
        there, wide = np.concatenate((there, far), 1), np.concatenate((same, kin), 1)
    a, da = one_way(there, wide, weight)
    b, db = one_way(cos.T * scale, same.T, weight)
    n = len(k)
    near = (da[:, :n] + db.T) / 2
    dq, dk = scale * near @ k, scale * near.T @ q
    ds = (near * cos).sum()
    if there.shape[1] > n:
        rest = da[:, n:] / 2
        if in_batch is not None:
            rest = rest * ~in_batch
        dq += scale * rest @ memory
        ds += (rest * (q @ memory.T)).sum()
    return (a + b) / 2, dq, dk, float(ds * scale) if np.exp(log_scale) < MOST_SCALE else 0.0


def alike(*labels: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Pairs that share any of the labels; -1 is no label and like nothing."""
    out = False
    for a, b in labels:
        out = out | ((a[:, None] == b[None, :]) & (a[:, None] >= 0))
    return out


def batches(compound: np.ndarray, size: int, cap: int, rng) -> list[np.ndarray]:
    """Rows of an epoch in batches of different compounds, at most `cap` rows of each; the fullest compounds go first."""
    by = rng.permutation(len(compound))
    by = by[np.argsort(compound[by], kind="stable")]
    first = np.searchsorted(compound[by], compound[by])
    nth = np.arange(len(by)) - first
    by, nth = by[nth < cap], nth[nth < cap]
    queues: dict[int, list[int]] = {}
    for r in by.tolist():
        queues.setdefault(int(compound[r]), []).append(r)
    out = []
    while queues:
        left = np.array([len(v) for v in queues.values()])
        keys = list(queues)
        pick = np.lexsort((rng.random(len(keys)), -left))[:size]
        out.append(np.array([queues[keys[x]].pop() for x in pick.tolist()]))
        for x in pick.tolist():
            if not queues[keys[x]]:
                del queues[keys[x]]
    return [b for b in out if len(b) > 1]


class AdamW:
    def __init__(self, c: Config):
        self.c, self.m, self.v, self.t = c, {}, {}, 0

    def step(self, groups: list[tuple[str, dict, dict, float]], rate: float) -> None:
        """groups: name, parameters, gradients, decay. All gradients are clipped together."""
        total = np.sqrt(sum(float((g * g).sum()) for _, _, gs, _ in groups for g in gs.values()))
        shrink = min(1.0, self.c.clip / (total + 1e-6))
        self.t += 1
        for name, p, gs, decay in groups:
            for k, g in gs.items():
                g, at = g * shrink, (name, k)
                m = self.m[at] = 0.9 * self.m.get(at, 0) + 0.1 * g
                v = self.v[at] = 0.999 * self.v.get(at, 0) + 0.001 * g * g
                p[k] = p[k] * (1 - rate * decay) - rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def rate_at(step: int, warm: int, total: int) -> float:
    """Linear to one, then a half cosine to nought, where it stays."""
    if step < warm:
        return (step + 1) / max(1, warm)
    return 0.5 * (1 + np.cos(np.pi * min(1.0, (step - warm) / max(1, total - warm))))


class TwoTower:
    def __init__(self, genes: int, features: int, n_compounds: int, c: Config):
        self.c, self.signature = c, SignatureEncoder(genes, c)
        self.molecule = Lookup(n_compounds, c) if c.lookup else MoleculeEncoder(features, c)
        self.scale = {"log": np.array(np.log(1 / c.temperature))}

    def keys(self, features: np.ndarray, chunk: int = 4096) -> np.ndarray:
        """The bank, in chunks."""
        if self.c.lookup:
            return self.molecule.forward(np.arange(len(self.molecule.p["table"])))[0]
        return np.concatenate([self.molecule.forward(features[lo : lo + chunk])[0] for lo in range(0, max(1, len(features)), chunk)])

    def state(self) -> dict:
        return {n: {k: np.array(v) for k, v in p.items()} for n, p in self.parts().items()}

    def parts(self) -> dict:
        return {"signature": self.signature.p, "molecule": self.molecule.p, "scale": self.scale}

    def load(self, state: dict, keep_scale: bool = False) -> "TwoTower":
        """A warm start; the temperature may stay as it is."""
        for n, p in self.parts().items():
            if n == "scale" and keep_scale:
                continue
            if {k: np.shape(v) for k, v in state[n].items()} != {k: np.shape(v) for k, v in p.items()}:
                raise ValueError(f"{n}: the widths differ")
            p.update({k: np.array(v) for k, v in state[n].items()})
        return self

    def batch_loss(self, x, features, compound, labels) -> float:
        """Loss of one batch without dropout, on fewer rows where compounds repeat."""
        _, at = np.unique(compound, return_index=True)
        if len(at) < 2:
            return float("nan")
        q, k = self.signature.forward(x[at])[0], self._side(features, compound[at])[0]
        return contrast(q, k, float(self.scale["log"]), self._same(labels, compound[at], compound[at]), weight=self.c.sibling_weight)[0]

    def _side(self, features, at, rng=None):
        return self.molecule.forward(at if self.c.lookup else features[at], rng)

    @staticmethod
    def _same(labels, a, b):
        return alike(*[(x[a], x[b]) for x in labels]) if labels else None


def recall(model: TwoTower, x: np.ndarray, compound: np.ndarray, features: np.ndarray, k: int = 10) -> float:
    """Share of rows whose compound is among the k best, of the compounds' own shares."""
    if not len(x):
        return float("nan")
    score = model.signature.forward(x)[0] @ model.keys(features).T
    hit = (score > score[np.arange(len(x)), compound][:, None]).sum(1) < k
    return float(np.mean([hit[compound == c].mean() for c in np.unique(compound)]))


def train(model: TwoTower, x: np.ndarray, compound: np.ndarray, features: np.ndarray, labels: list[np.ndarray] = (), valid: tuple[np.ndarray, np.ndarray] | None = None) -> list[dict]:
    """Trains in place and returns the epochs' history, the first of which is of the untrained model.

    Batches, dropout and evaluation draw from generators of their own, so watching a run doesn't change it. The best
    epoch on valid is put back at the end; a run without progress for `patience` epochs ends.
    """
    c = model.c
    drop = np.random.default_rng(c.seed + 11)
    deal = lambda e: batches(compound, c.batch, c.cap, np.random.default_rng((c.seed, e)))
    total = sum(len(deal(e)) for e in range(1, c.epochs + 1)) if c.epochs < 50 else c.epochs * len(deal(1))
    warm, step, optimiser = int(c.warm * total), 0, AdamW(c)
    watch = lambda: recall(model, *valid, features) if valid is not None else float("nan")
    first = watch()
    chance = min(10, len(features)) / max(1, len(features))
    history = [{"epoch": 0, "loss": float("nan"), "valid": first, "suspicious": bool(first > 10 * chance)}]
    best, held, since = -np.inf, model.state(), 0
    memory = model.keys(features) if c.memory else None
    for epoch in range(1, c.epochs + 1):
        losses = []
        for rows in deal(epoch):
            at = compound[rows]
            q, kq = model.signature.forward(x[rows], drop)
            k, kk = model._side(features, at, drop)
            inside = np.isin(np.arange(len(features)), at) if c.memory else None
            every = np.arange(len(features))
            kin = model._same(labels, at, every) if c.memory and len(labels) else None
            loss, dq, dk, ds = contrast(q, k, float(model.scale["log"]), model._same(labels, at, at), memory, kin, inside, c.sibling_weight)
            groups = [("signature", model.signature.p, model.signature.backward(dq, kq), c.decay), ("molecule", model.molecule.p, model.molecule.backward(dk, kk), c.decay if c.molecule_decay is None else c.molecule_decay)]
            if c.learn_scale:
                groups.append(("scale", model.scale, {"log": np.array(ds)}, 0.0))
            optimiser.step(groups, c.rate * rate_at(step, warm, total))
            model.scale["log"] = np.minimum(model.scale["log"], np.log(MOST_SCALE))
            if c.memory:
                memory[at] = k
            losses.append(loss)
            step += 1
        now = watch()
        history.append({"epoch": epoch, "loss": float(np.mean(losses)) if losses else float("nan"), "valid": now, "suspicious": False})
        if valid is not None:
            if now > best:
                best, held, since = now, model.state(), 0
            else:
                since += 1
                if since >= c.patience:
                    break
    if valid is not None and np.isfinite(best):
        model.load(held)
    return history


def _encoded(side, name: str, names: list[str]):
    def run(rows):
        net = side.value
        for b in rows:
            v = matrix(b.column(name))
            y = net.forward(v)[0] if len(v) else np.zeros((0, 1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
            yield pa.record_batch([flat if c == name else b.column(c) for c in names], names=names)

    return run


def encoded(rows: DataFrame, side, vec: str = "vec") -> DataFrame:
    """rows with vec replaced by its unit vector in the shared space; rows without a vector stay out. side: an encoder."""
    net = rows.sparkSession.sparkContext.broadcast(side)  # as large as its weights
    good = rows.where(rows[vec].isNotNull())
    good = good.withColumn(vec, good[vec].cast("array<double>"))
    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType()) if f.name == vec else f.dataType) for f in good.schema])
    return good.mapInArrow(_encoded(net, vec, good.columns), schema)


def planted(n_compounds: int = 60, genes: int = 40, bits: int = 64, seed: int = 0, noise: float = 0.6):
    """A bank whose responses are a linear map of its bits, with very unequal depths: rows, compound, features, labels."""
    r = np.random.default_rng(seed)
    features = (r.random((n_compounds, bits)) < 0.25).astype(float)
    depth = np.minimum(40, 2 + (r.pareto(1.3, n_compounds) * 2).astype(int))
    compound = np.repeat(np.arange(n_compounds), depth)
    clean = (features - features.mean(0)) @ r.normal(size=(bits, genes)) / np.sqrt(bits / 4)
    return clean[compound] + noise * r.normal(size=(len(compound), genes)), compound, features, np.where(np.arange(n_compounds) % 3 > 0, np.arange(n_compounds) // 6, -1)
