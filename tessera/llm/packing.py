"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents longer than a sequence are cut into pieces; every piece is placed whole. The histogram of piece lengths, at
most one row for each length, is all that the driver sees. It lists patterns of one to four lengths that fill a sequence,
fits how often to repeat each by non-negative least squares against the histogram, rounds down, and packs the residual
counts best fit first, longest length first. The result says for the r-th piece of each length where it goes, so the
pieces find their places by their rank within their length, counted in two steps: within a task, then over the tasks.

Defined cases: null text is empty; an empty document is its end token alone; ids, null ids among them, and texts may
repeat; texts may be of any length; an empty table gives no pieces; columns other than doc_id and text are not read,
whatever their names.
"""

import hashlib
import struct
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import textkit as tk

LENGTH = 2048
PARTS, MET, JOIN, SLICE = 300_000, 1 << 20, 256, 4 << 20

LETTER, DIGIT, SIGN = 1, 2, 3
KIND = np.full(256, SIGN, np.uint8)  # 0 is white space, of which the tokenizer knows other characters than Python
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[[c for c in range(256) if c >= 128 or chr(c).isalpha()]] = LETTER
KIND[48:58] = DIGIT
kind_is_space = KIND == 0
LOW = np.arange(256, dtype=np.uint8)
LOW[65:91] += 32
#: Bytes that may make a word odd: signs under 32, the apostrophe, `<`, and what is no Latin letter up to U+017E.
ODD = ((np.arange(256) < 32) & ~kind_is_space) | np.isin(np.arange(256), [ord("'"), ord("<"), 127, 0xC2]) | (np.arange(256) > 0xC5)
ODD_PAIRS = np.zeros((256, 256), bool)
for _pair in (b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0", b"\xc5\x89", b"\xc5\xbf"):  # signs of multiplication and division, and letters that fold to more
    ODD[_pair[1]] = ODD_PAIRS[_pair[0], _pair[1]] = True


class Encoder:
    """Encodes texts by their different parts; the result equals the tokenizer's own.

    The tokenizer works in lower case, drops white space and looks at nothing beyond a part: a run of letters, a digit, or
    a run of other signs. Words of other characters than ASCII and the Latin letters up to U+017E, and those with an
    apostrophe, a control character or the beginning of a special token, go to the tokenizer whole. Ids of parts met twice
    are kept, up to a bound; a table of MET bytes tells by hash whether a part was met before, so that parts met once take
    no room, and is emptied when half of it is marked.
    """

    def __init__(self, tokenizer: bytes, most: int = PARTS):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_buffer(tokenizer), most
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)  # tokens that end a part
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.met, self.marks = bytearray(MET), 0

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _together(self, parts: list[bytes]) -> list[bytes]:
        """Ids of parts, JOIN of them to a call; the tokens that end parts tell them apart."""
        out = []
        for lo in range(0, len(parts), JOIN):
            some = parts[lo : lo + JOIN]
            ids = np.array(self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False).ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(some) or cut[-1] != len(ids):
                raise ValueError("parts and tokens that end parts do not agree")
            raw, cut = ids.tobytes(), (cut * 4).tolist()
            out += [raw[x:y] for x, y in zip([0, *cut], cut)]
        return out

    def _ids(self, keys: list[bytes], whole: bool) -> list[bytes]:
        """Ids of different parts, or of whole words."""
        got = list(map(self.known.get, keys))
        new = [k for k, x in enumerate(got) if x is None]
        some = [keys[k] for k in new]
        for k, x in zip(new, [self.direct(w.decode("utf-8", "replace")) for w in some] if whole else self._together(some)):
            got[k], key = x, keys[k]
            if len(self.known) < self.most and len(key) < 40:
                h = hash(key) & (MET - 1)
                if self.met[h]:
                    self.known[key] = x
                else:
                    self.met[h], self.marks = 1, self.marks + 1
                    if self.marks > MET // 2:
                        self.met, self.marks = bytearray(MET), 0
        return got

    def encode(self, body: np.ndarray, offs: np.ndarray, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, the token `end` behind each, and where each row begins.

        Arrow finds the different parts of the rows; each is looked up once, and the ids are gathered from there.
        """
        start, odd = parts(body, offs)
        row = np.searchsorted(start, offs)  # the first part of each row
        codes, each = np.zeros(len(start), np.int32), []
        for pick, text, whole in ((np.flatnonzero(~odd), LOW[body], False), (np.flatnonzero(odd), np.ascontiguousarray(body), True)):
            if len(pick):
                at = pa.array(np.append(start, len(body)), pa.int32())
                values = pa.Array.from_buffers(pa.binary(), len(start), [None, at.buffers()[1], pa.py_buffer(text)])
                found = (values if len(pick) == len(start) else values.take(pa.array(pick))).dictionary_encode()
                codes[pick] = np.asarray(found.indices) + len(each)
                each += self._ids(list(map(bytes.rstrip, found.dictionary.to_pylist())), whole)
        size = np.array([*map(len, each), 4], np.int32) // 4
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(np.frombuffer(b"".join(each) + struct.pack("<I", end), "<u4")))
        codes = np.insert(codes, row[1:], len(each))
        begins = np.concatenate(([0], np.cumsum(size[codes])))[row + np.arange(len(row))]
        return lists.take(pa.array(codes)).flatten().to_numpy(), begins


def parts(body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each part of the rows begins, and whether it is a whole word that only the tokenizer can read."""
    n = len(body)
    kind = KIND[body]
    first = np.zeros(n + 1, bool)
    first[offs[:-1]] = True
    begin = (kind > 0) & (first[:n] | (kind == DIGIT))
    begin[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0)
    at = np.flatnonzero(ODD[body])
    after, before = body[np.minimum(at + 1, n - 1)], body[np.maximum(at - 1, 0)]
    sign = body[at]
    at = at[np.where(sign == ord("<"), after == ord("|"), np.where((sign >= 0x80) & (sign < 0xC0), ODD_PAIRS[before, sign], True))]
    if not len(at):
        start = np.flatnonzero(begin)
        return start, np.zeros(len(start), bool)
    word, stop, _ = tk.words(body, offs, kind_is_space)
    which = np.unique(np.searchsorted(word, at, "right") - 1)
    step = np.zeros(n + 1, np.int8)
    step[word[which]] = 1
    np.add.at(step, stop[which], -1)
    inside = np.cumsum(step[:n]).astype(bool)
    begin &= ~inside
    begin[word[which]] = True
    start = np.flatnonzero(begin)
    return start, inside[start]


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer: bytes) -> Encoder:
    """One for each Python worker."""
    key = hashlib.sha256(tokenizer).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(tokenizer)
    return _encoders[key]


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64()), ("ids", pa.list_(pa.int64()))])


def _pieces(tokenizer, length: int, with_ids: bool):
    def run(batches):
        from pyspark import TaskContext

        enc, part, met = encoder(tokenizer.value), TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for b in batches:
            for lo, hi, body, offs in tk.slices(b.column("text"), SLICE, SLICE):
                ids, begins = enc.encode(body, offs)
                size = np.diff(begins)
                count = -(-size // length)
                row = np.repeat(np.arange(hi - lo), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                at = begins[row] + piece * length
                n = np.minimum(length, begins[row + 1] - at)
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * x : 4 * (x + m)]) for x, m in zip(at.tolist(), n.tolist())]
                by = np.argsort(n, kind="stable")  # the place of each piece among those of its length in this task
                first, end = tk.runs(n[by])
                nth = np.empty(len(n), np.int64)
                nth[by] = np.arange(len(n)) - np.repeat(first, end - first) + met[n[by]]
                met += np.bincount(n, minlength=length + 1)
                cols = [b.column("doc_id").slice(lo, hi - lo).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * length), pa.array(n), pa.array(crc, pa.int64()), pa.array(np.full(len(n), part, np.int32)), pa.array(nth)]
                yield pa.record_batch([*cols, *([tk.lists(n, pa.array(ids.astype(np.int64)))] if with_ids else [])], schema=PIECES if with_ids else pa.schema(list(PIECES)[:7]))

    return run


def patterns(count: np.ndarray, length: int) -> list[tuple[int, ...]]:
    """Full patterns of lengths that occur: one, two, three and four pieces, every length as the smallest of some."""
    have = np.flatnonzero(count)
    have = have[have > 0]
    seen = np.zeros(length + 1, bool)
    seen[have] = True
    out = [(length,)] if seen[length] else []
    out += [(length - int(a), int(a)) for a in have if 2 * a <= length and seen[length - a]]
    step = max(1, length // 96)
    for c in have[have * 3 <= length].tolist():
        b = np.arange(c, (length - c) // 2 + 1, step)
        b = b[seen[b] & seen[length - c - b]]
        out += [(length - c - x, x, c) for x in b.tolist()]
    step = max(1, length // 12)
    for d in have[have * 4 <= length].tolist():
        for c in range(d, (length - d) // 3 + 1, step):
            b = np.arange(c, (length - c - d) // 2 + 1, step)
            b = b[seen[b] & seen[length - c - d - b]]
            if seen[c]:
                out += [(length - c - d - x, x, c, d) for x in b.tolist()]
    return out


def fit(count: np.ndarray, pats: list[tuple[int, ...]], rounds: int = 300) -> np.ndarray:
    """Non-negative least squares: repeats x of the patterns so that the lengths they use come near count.

    Accelerated projected gradient over the patterns' few entries.
    """
    if not pats:
        return np.zeros(0)
    width = max(map(len, pats))
    at = np.zeros((len(pats), width), np.int64)
    for k, p in enumerate(pats):
        at[k, : len(p)] = p
    norm = np.bincount(at.ravel(), minlength=len(count)).astype(float)
    step = 1 / max(1e-9, norm[at].sum(1).max())
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        used = np.bincount(at.ravel(), np.repeat(y, width), len(count))
        miss = used - count
        miss[0] = 0
        grad = miss[at].sum(1)
        new = np.maximum(0, y - step * grad)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(count: np.ndarray, length: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of sequences that together hold count[n] pieces of each length n."""
    left = count.astype(np.int64).copy()
    pats = patterns(left, length)
    x = fit(left, pats)
    out: dict[tuple[int, ...], int] = {}
    for k in np.argsort(-x, kind="stable").tolist():
        r = int(x[k])
        if r < 1:
            break
        need = np.bincount(pats[k], minlength=len(left))
        at = np.flatnonzero(need)
        r = min(r, int((left[at] // need[at]).min()))
        if r > 0:
            left[at] -= r * need[at]
            out[pats[k]] = out.get(pats[k], 0) + r
    room: list[dict[tuple[int, ...], int]] = [{} for _ in range(length + 1)]  # open sequences by what they can still take
    for n in range(length, 0, -1):
        todo = int(left[n])
        while todo:
            free = next((f for f in range(n, length + 1) if room[f]), None)
            if free is None:
                each = length // n  # a new sequence takes as many of the longest left as fit
                k, m = (todo // each, each) if todo >= each else (1, todo)
                p, todo = (n,) * m, todo - k * m
                f = length - n * m
            else:
                p, have = room[free].popitem()
                k = min(have, todo)
                if have > k:
                    room[free][p] = have - k
                p, todo, f = (*p, n), todo - k, free - n
            room[f][p] = room[f].get(p, 0) + k
    for f in room:
        for p, k in f.items():
            out[p] = out.get(p, 0) + k
    return sorted(out.items())


def places(plans: list[tuple[tuple[int, ...], int]], length: int) -> dict[str, np.ndarray]:
    """Stretches of ranks within a length: first rank, the sequence of that rank, and the offset there, by length."""
    rows, base = [], 0
    for p, k in plans:
        at = 0
        for n in p:
            rows.append((n, k, base, at))
            at += n
        base += k
    table = np.array(rows, np.int64).reshape(-1, 4)
    table = table[np.argsort(table[:, 0], kind="stable")]
    total = np.cumsum(table[:, 1]) - table[:, 1]
    begin = np.searchsorted(table[:, 0], np.arange(length + 2))
    return {"first": total, "sequence": table[:, 2], "offset": table[:, 3], "begin": begin}


def _placed(table):
    def run(batches):
        t = table.value
        for b in batches:
            n = np.asarray(b.column("length"))
            start = t["first"][t["begin"][n]] if len(n) else n
            rank = np.asarray(b.column("rank")) + start
            k = np.searchsorted(t["first"], rank, "right") - 1
            keep = [b.column(c) for c in b.schema.names if c != "rank"]
            yield pa.record_batch([*keep, pa.array(t["sequence"][k] + rank - t["first"][k]), pa.array(t["offset"][k])], names=[*(c for c in b.schema.names if c != "rank"), "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids themselves if asked for.

    tokenizer: a file that the driver reads and sends to the workers.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Path(tokenizer).read_bytes())  # as large as the vocabulary
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + (", ids array<long>" if with_ids else "")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = tk.written(source.mapInArrow(_pieces(model, length, with_ids), schema), "pieces")
    each = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    each = each.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    hist = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("c")).collect()  # one row for each length, `length` at most
    count = np.zeros(length + 1, np.int64)
    for r in hist:
        count[r["length"]] = r["c"]
    table = spark.sparkContext.broadcast(places(plan(count, length), length))
    ranked = pieces.join(each.hint("merge"), ["length", "part"]).withColumn("rank", F.col("nth") + F.col("before"))
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "") + ", sequence_id long, offset long"
    return ranked.select(*keep, "rank").mapInArrow(_placed(table), out)
