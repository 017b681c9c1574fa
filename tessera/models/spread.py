"""Training of the two encoders by tasks that run together, each on its own compounds and their rows.

A barrier stage starts all tasks at once. A compound's features and rows lie on one task, and no other sees them, the driver
neither. Every task draws the same batches from the compounds' numbers of rows; of a batch it encodes what is its own. The
tasks then gather the batch's vectors, each works out the loss of all, follows its own rows back, and the parameters'
gradients are summed over tasks in their order, so that all take the same step. A run on any number of tasks has the losses of
a run on one, up to rounding (with dropout, up to its draws, which a task makes for its own rows). What is gathered goes from task to
task: of a step, a batch's vectors and the gradients; of an evaluation, the bank's vectors.
"""

import json
import secrets
import socket

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.models import two_tower as tt
from tessera.operators import vectors

BANK, TRAIN, VALID = range(3)
OUT = "part string, name string, shape array<int>, values array<double>, notes string"


def _sent(link: socket.socket, data: bytes) -> None:
    link.sendall(len(data).to_bytes(8, "big") + data)


def _received(link: socket.socket) -> bytes:
    def take(n):
        out = bytearray()
        while len(out) < n:
            part = link.recv(min(n - len(out), 1 << 20))
            if not part:
                raise ConnectionError("a task of the stage is gone")
            out += part
        return bytes(out)

    return take(int.from_bytes(take(8), "big"))


class Ring:
    """The tasks of a stage, and what each of them says. The first one hears all and passes it on; the stage's own exchange,
    which goes through the driver, only tells where it listens and a word that tasks know each other by. A task that is
    lost ends the others' waiting, so the stage fails and starts again."""

    def __init__(self, context, wait: float = 600.0):
        self.rank, hosts = context.partitionId(), [i.address.rsplit(":", 1)[0] for i in context.getTaskInfos()]
        self.n, server = len(hosts), socket.create_server(("", 0)) if self.rank == 0 else None
        port, word = json.loads(context.allGather(json.dumps([server.getsockname()[1], secrets.token_hex(16)] if server else None))[0])
        self.links: dict[int, socket.socket] = {}
        if server:
            server.settimeout(wait)
            while len(self.links) < self.n - 1:
                link = server.accept()[0]
                link.settimeout(wait)
                said = json.loads(_received(link))
                if said[0] == word:
                    self.links[said[1]] = link
            server.close()
        else:
            self.links[0] = socket.create_connection((hosts[0], port), wait)
            _sent(self.links[0], json.dumps([word, self.rank]).encode())

    def gather(self, *arrays: np.ndarray) -> list[list[np.ndarray]]:
        """The arrays of every task, in their order."""
        head = json.dumps([(str(a.dtype), a.shape) for a in arrays]).encode()
        mine = len(head).to_bytes(8, "big") + head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
        if self.rank == 0:
            every = [mine, *(_received(self.links[r]) for r in range(1, self.n))]
            for r in range(1, self.n):
                for part in every:
                    _sent(self.links[r], part)
        else:
            _sent(self.links[0], mine)
            every = [_received(self.links[0]) for _ in range(self.n)]
        out = []
        for data in every:
            at = 8 + int.from_bytes(data[:8], "big")
            out.append([])
            for kind, shape in json.loads(data[8:at]):
                n = int(np.prod(shape))
                out[-1].append(np.frombuffer(data, kind, n, at).reshape(shape))
                at += n * np.dtype(kind).itemsize
        return out

    def close(self) -> None:
        for link in self.links.values():
            link.close()


class Shard:
    """A task's compounds and rows, and where they stand among all."""

    def __init__(self, ring: Ring, pos, features, label, rows, valid):
        self.ring, self.pos, self.features, self.label = ring, pos, features, label
        self.at, self.x = rows
        self.valid_at, self.valid_x = valid
        every = ring.gather(pos, label)
        self.all_pos = np.concatenate([p for p, _ in every])
        by = np.argsort(self.all_pos, kind="stable")
        self.all_pos, self.all_label = self.all_pos[by], np.concatenate([x for _, x in every])[by]
        counts = ring.gather(self.at)
        owner = np.repeat(np.arange(len(counts)), [len(a) for a, in counts])
        compound = np.concatenate([a for a, in counts])
        by = np.argsort(compound, kind="stable")  # a compound's rows are one task's, in its order
        self.compound, self.owner = np.searchsorted(self.all_pos, compound[by]), owner[by]
        self.local = (np.arange(len(owner)) - np.searchsorted(owner, owner))[by]

    def mine(self, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the batch and own rows."""
        at = np.flatnonzero(self.owner[batch] == self.ring.rank)
        return at, self.local[batch[at]]

    def own(self, at: np.ndarray) -> np.ndarray:
        return self.features[np.searchsorted(self.pos, at)]


def flat(groups: list[dict]) -> np.ndarray:
    return np.concatenate([g[k].ravel() for g in groups for k in sorted(g)])


def shaped(v: np.ndarray, groups: list[dict]) -> list[dict]:
    out, lo = [], 0
    for g in groups:
        out.append({})
        for k in sorted(g):
            out[-1][k] = v[lo : lo + g[k].size].reshape(g[k].shape)
            lo += g[k].size
    return out


def recall(model: tt.TwoTower, s: Shard, k: int = 10) -> float:
    """tt.recall of the valid rows of all tasks."""
    keys = model.molecule.forward(s.features)[0] if len(s.pos) else np.zeros((0, model.c.embed))
    parts = s.ring.gather(s.pos, keys)
    by = np.argsort(np.concatenate([p for p, _ in parts]), kind="stable")
    keys = np.concatenate([v for _, v in parts])[by]
    at = np.searchsorted(s.all_pos, s.valid_at)
    score = model.signature.forward(s.valid_x)[0] @ keys.T if len(at) else np.zeros((0, len(keys)))
    hit = (score > score[np.arange(len(at)), at][:, None]).sum(1) < k
    told = s.ring.gather(at, hit.astype(float))
    at, hit = (np.concatenate([x[i] for x in told]) for i in (0, 1))
    return float(np.mean([hit[at == c].mean() for c in np.unique(at)])) if len(at) else float("nan")


def _learn(s: Shard, model: tt.TwoTower, c: tt.Config) -> list[dict]:
    drop = np.random.default_rng((c.seed, 11, s.ring.rank)) if c.dropout or c.bit_dropout else None
    deal = lambda e: tt.batches(s.compound, c.batch, c.cap, np.random.default_rng((c.seed, e)))
    total = sum(len(deal(e)) for e in range(1, c.epochs + 1)) if c.epochs < 50 else c.epochs * len(deal(1))
    warm, step, optimiser = int(c.warm * total), 0, tt.AdamW(c)
    first, chance = recall(model, s), min(10, len(s.all_pos)) / max(1, len(s.all_pos))
    history = [{"epoch": 0, "loss": float("nan"), "valid": first, "suspicious": bool(first > 10 * chance)}]
    best, held, since = -np.inf, model.state(), 0
    decay = (c.decay, c.decay if c.molecule_decay is None else c.molecule_decay)
    for epoch in range(1, c.epochs + 1):
        losses = []
        for batch in deal(epoch):
            at, rows = s.mine(batch)
            compound = s.compound[batch]
            q, kq = model.signature.forward(s.x[rows], drop)
            k, kk = model.molecule.forward(s.own(s.all_pos[compound[at]]), drop)
            parts = s.ring.gather(at, q, k)
            by = np.argsort(np.concatenate([p for p, *_ in parts]), kind="stable")
            every_q, every_k = (np.concatenate([p[i] for p in parts])[by] for i in (1, 2))
            same = tt.alike((s.all_label[compound], s.all_label[compound]))
            loss, dq, dk, ds = tt.contrast(every_q, every_k, float(model.scale["log"]), same, weight=c.sibling_weight)
            sides = [model.signature.backward(dq[at], kq), model.molecule.backward(dk[at], kk)]
            total_grad = sum(g for g, in s.ring.gather(flat(sides)))
            sides = shaped(total_grad, sides)
            groups = [("signature", model.signature.p, sides[0], decay[0]), ("molecule", model.molecule.p, sides[1], decay[1])]
            if c.learn_scale:
                groups.append(("scale", model.scale, {"log": np.array(ds)}, 0.0))
            optimiser.step(groups, c.rate * tt.rate_at(step, warm, total))
            model.scale["log"] = np.minimum(model.scale["log"], np.log(tt.MOST_SCALE))
            losses.append(loss)
            step += 1
        now = recall(model, s)
        history.append({"epoch": epoch, "loss": float(np.mean(losses)) if losses else float("nan"), "valid": now, "suspicious": False})
        if np.isfinite(now):
            if now > best:
                best, held, since = now, model.state(), 0
            elif (since := since + 1) >= c.patience:
                break
    if np.isfinite(best):
        model.load(held)
    return history


def _task(c: tt.Config, genes: int, width: int):
    def run(batches):
        parts = [(np.asarray(b.column("kind")), np.asarray(b.column("pos")), np.asarray(b.column("label")), b.column("vec")) for b in batches if b.num_rows]

        def of(kind, n):
            got = [(pos[k == kind], label[k == kind], vectors.matrix(v.filter(pa.array(k == kind)))) for k, pos, label, v in parts if (k == kind).any()]
            return tuple(np.concatenate([g[i] for g in got]) for i in range(3)) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, n)))

        pos, label, features = of(BANK, width)
        at, _, x = of(TRAIN, genes)
        valid_at, _, valid_x = of(VALID, genes)
        ring = Ring(BarrierTaskContext.get())
        shard = Shard(ring, pos, features, label, (at, x), (valid_at, valid_x))
        model = tt.TwoTower(genes, width, 0, c)
        history = _learn(shard, model, c)
        ring.close()
        if ring.rank == 0:
            rows = [(part, name, list(v.shape), v.ravel().astype(float).tolist(), None) for part, p in model.state().items() for name, v in p.items()]
            rows.append(("history", None, None, None, json.dumps(history)))
            kinds = (pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.string())
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["part", "name", "shape", "values", "notes"])

    return run


def train(rows: DataFrame, bank: DataFrame, c: tt.Config, tasks: int, valid: DataFrame | None = None) -> tuple[tt.TwoTower, list[dict]]:
    """The model and the epochs' history (see two_tower.train). rows and valid (pos, sig, vec), bank (pos, features, label): the
    label is a number, -1 for none. Compounds have a pos of their own each; rows of others are an error. All tasks must have a
    core at the same time. A lookup table and a memory of vectors are for training in one place."""
    if c.lookup or c.memory:
        raise ValueError("a lookup table and a memory are for training in one place")
    genes, width = rows.agg(F.max(F.size("vec"))).first()[0], bank.agg(F.max(F.size("features"))).first()[0]
    if not genes or not width:
        raise ValueError("no training rows are left")
    both = rows if valid is None else rows.unionByName(valid)
    if not both.join(bank, "pos", "left_anti").isEmpty():
        raise ValueError("rows of compounds that the bank lacks")
    part = lambda df, kind, vec, label, key: df.select(F.lit(kind).alias("kind"), F.col("pos").cast("long").alias("pos"), F.md5(key.cast("string")).alias("key"), label.cast("long").alias("label"), F.col(vec).cast("array<double>").alias("vec"))
    none = F.lit(-1)
    every = part(bank, BANK, "features", F.col("label"), F.col("pos")).unionByName(part(rows, TRAIN, "vec", none, F.col("sig")))
    every = every if valid is None else every.unionByName(part(valid, VALID, "vec", none, F.col("sig")))
    dealt = every.repartition(tasks, "pos").sortWithinPartitions("kind", "pos", "key").drop("key")
    got = dealt.mapInArrow(_task(c, genes, width), OUT, barrier=True).collect()  # as large as the model
    model = tt.TwoTower(genes, width, 0, c)
    state: dict = {}
    for r in got:
        if r.part != "history":
            state.setdefault(r.part, {})[r.name] = np.array(r["values"]).reshape(r["shape"])
    return model.load(state), next(json.loads(r.notes) for r in got if r.part == "history")
