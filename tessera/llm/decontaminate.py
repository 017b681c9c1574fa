"""Benchmark decontamination by spaced seeds.

A seed looks at some words of a window and ignores the others. MASKS are two such windows of four words, each of which
ignores one inner word, so a seed survives a changed word there, and a changed word spoils three seeds of a mask at most.
A stretch of n words with c of them changed keeps n - 3 - 3 * c seeds of each mask or more, which with c at most a fifth of
n is LIKELY / 2 or more wherever n is SPAN or more: no placement of the changed words is missed. Shorter items keep one
seed at least (see needed). Hashes of the benchmark's seeds are joined with those of the training texts; each hit names an
item and a shift between item and text, and along a shift with enough hits the whole item is compared word by word. A text
is contaminated if a stretch of over LEAST words has at least AGREE of its words equal and begins and ends with equal ones,
or an item of SHORT to LEAST words has at least AGREE of all its words equal, edges included.

A benchmark of up to BLOCK words is broadcast, after its size is checked, and texts are scanned once. A larger one isn't:
both sides' seeds are shuffled by their hash, a text's only where a bounded filter of the benchmark's seeds admits them,
hits are counted by text, item and shift, and the shifts with enough of them meet texts and items again for the comparison.

Words are runs of letters and digits in lower case; ASCII punctuation and white space part them. Defined cases: null and
empty texts are clean; items under SHORT words are too short to tell and match nothing; repeated rows and items count like
others; a text or an item may be of any length; an empty benchmark or table finds nothing; other columns aren't read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit as tk

SPAN, SHORT, LEAST, AGREE = 12, 5, 13, 0.8
#: The words of a window that a seed looks at; the word between them may be any.
MASKS = ((0, 1, 3), (0, 2, 3))
LIKELY, BLOCK, FILTER_BITS, HITS = 6, 1_000_000, 26, 4_000_000


def needed(n: int) -> int:
    """Seeds that an item of n words keeps at least, with a fifth of its words changed; for a long one, any stretch."""
    return LIKELY if n >= SPAN else max(1, 2 * (n - 3 - 3 * (n // 5)))


def seeds(wh: np.ndarray, mask: int) -> np.ndarray:
    """Hash of the mask at every word where it fits."""
    n = max(0, len(wh) - MASKS[mask][-1])
    out = np.full(n, 7919 * (mask + 1), tk.U64)
    with np.errstate(over="ignore"):
        for k, p in enumerate(MASKS[mask]):
            out += wh[p : p + n] * tk.U64((2 * k + 3) * 0x9E3779B97F4A7C15 % (1 << 64) | 1)
    return tk.mix(out)


def stretch(same: np.ndarray, agree: float = AGREE) -> tuple[int, int]:
    """Longest stretch of which at least agree is true, from a true place to a true one."""
    gain = np.concatenate(([0.0], np.cumsum(np.where(same, 1 - agree, -agree))))
    low = np.minimum.accumulate(gain)
    end = np.flatnonzero(same) + 1
    if not len(end):
        return 0, 0
    begin = np.searchsorted(-low, -(gain[end] + 1e-9))
    best = int(np.argmax(end - begin))
    lo, hi = int(begin[best]), int(end[best])
    while lo < hi and not same[lo]:
        lo += 1
    return lo, hi


def agreement(words: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int]:
    """Words of the longest overlap of an item with a text's words along a shift, and how many of them are equal."""
    lo, hi = max(0, -shift), min(len(item), len(words) - shift)
    if hi <= lo:
        return 0, 0
    same = words[shift + lo : shift + hi] == item[lo:hi]
    if len(item) <= LEAST:
        return (len(item), int(same.sum())) if same.sum() >= AGREE * len(item) - 1e-9 else (0, 0)
    a, b = stretch(same)
    return (b - a, int(same[a:b].sum())) if b - a >= LEAST else (0, 0)


def item_seeds(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, item and place in the item of every seed."""
    seed, item, at = [np.zeros(0, tk.U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, wh in enumerate(items):
        for m in range(len(MASKS)):
            h = seeds(wh, m)
            seed.append(h), item.append(np.full(len(h), k)), at.append(np.arange(len(h)))
    return np.concatenate(seed), np.concatenate(item), np.concatenate(at)


class Filter:
    """Bits that say which seeds the benchmark may hold, by the first bits of their hash."""

    def __init__(self, bits: int, table: np.ndarray | None = None):
        self.bits, self.table = bits, np.zeros(1 << bits >> 6, tk.U64) if table is None else table

    def place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = h >> tk.U64(64 - self.bits)
        return (k >> tk.U64(6)).astype(np.int64), tk.U64(1) << (k & tk.U64(63))

    def add(self, h: np.ndarray) -> "Filter":
        at, bit = self.place(h)
        np.bitwise_or.at(self.table, at, bit)
        return self

    def admitted(self, wh: np.ndarray):
        """(words, hashes) of the seeds of each mask that may be the benchmark's."""
        for m in range(len(MASKS)):
            h = seeds(wh, m)
            at, bit = self.place(h)
            at = np.flatnonzero(self.table[at] & bit)
            yield at, h[at]


def tallied(own: np.ndarray, item: np.ndarray, shift: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of n by the other three."""
    by = np.lexsort((shift, item, own))
    own, item, shift, n = own[by], item[by], shift[by], n[by]
    new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1])))) if len(own) else np.zeros(0, np.int64)
    return own[new], item[new], shift[new], np.add.reduceat(n, new) if len(new) else n


class Block:
    """A bounded benchmark: word hashes of its items, and their seeds in order with a filter before them."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        self.need = np.array([needed(len(wh)) for _, wh in items], np.int64)
        seed, item, at = item_seeds([wh for _, wh in items])
        by = np.argsort(seed, kind="stable")
        self.seed, self.item, self.at = seed[by], item[by], at[by]
        self.filter = Filter(min(FILTER_BITS, max(16, int(len(seed) * 32).bit_length()))).add(seed)

    def hits(self, wh: np.ndarray, first: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, item, shift and number of the hits along each shift; at most about HITS of them are held at once."""
        got = [(np.zeros(0, np.int64),) * 4]
        for at, h in self.filter.admitted(wh):
            lo, hi = np.searchsorted(self.seed, h, "left"), np.searchsorted(self.seed, h, "right")
            some = (hi > lo) & (at + 3 < first[row[at] + 1])
            at, lo, n = at[some], lo[some], (hi - lo)[some]
            part = np.cumsum(n) // HITS
            for a, z in zip(*tk.runs(part)):
                m = n[a:z]
                k = np.repeat(lo[a:z], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                word = np.repeat(at[a:z], m)
                got.append(tallied(row[word], self.item[k], word - first[row[word]] - self.at[k], np.ones(len(k), np.int64)))
        return tallied(*(np.concatenate(x) for x in zip(*got)))

    def overlaps(self, wh: np.ndarray, first: np.ndarray, row: np.ndarray) -> dict[int, dict[int, tuple[int, int]]]:
        """Of each row: items met, with the longest overlap's words and how many of them are equal."""
        own, item, shift, n = self.hits(wh, first, row)
        found: dict[int, dict[int, tuple[int, int]]] = {}
        keep = n >= self.need[item] if len(n) else np.zeros(0, bool)
        for r, k, s in zip(own[keep].tolist(), item[keep].tolist(), shift[keep].tolist()):
            name, want = self.items[k]
            if found.get(r, {}).get(name) == (len(want), len(want)):
                continue  # no shift can give more
            got = agreement(wh[first[r] : first[r + 1]], want, s)
            if got[0]:
                mine = found.setdefault(r, {})
                mine[name] = max(mine.get(name, (0, 0)), got)
        return found


def _hashes(column: pa.Array):
    for lo, hi, body, offs in tk.slices(tk.lower(column)):
        start, end, row = tk.words(body, offs, tk.MARKS)
        first = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=hi - lo))))
        yield lo, hi, tk.word_hashes(body, start, end), first, row


def _words(names: list[str]):
    """The columns named, and the hashes of each text's words."""

    def run(batches):
        for b in batches:
            for lo, hi, wh, first, _ in _hashes(b.column("text")):
                yield pa.record_batch([*(b.column(c).slice(lo, hi - lo) for c in names), tk.lists(np.diff(first), tk.i64(wh))], names=[*names, "words"])

    return run


HIT = "array<struct<item_id: long, n_words: long, n_equal: long>>"


def _scan(block):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_words", pa.int64()), ("n_equal", pa.int64())]))

    def run(batches):
        from_ = block.value
        for b in batches:
            out: list[list] = [[] for _ in range(b.num_rows)]
            for lo, _, wh, first, row in _hashes(b.column("text")):
                for r, items in from_.overlaps(wh, first, row).items():
                    out[lo + r] = [{"item_id": k, "n_words": n, "n_equal": e} for k, (n, e) in sorted(items.items(), key=lambda x: (x[0] is None, x[0] or 0))]
            yield pa.record_batch([b.column("doc_id"), b.column("tx"), pa.array(out, kind)], names=["doc_id", "tx", "hits"])

    return run


def _item_rows(batches):
    """A row (seed, item, at, need) for every seed of the items."""
    for b in batches:
        for k in range(b.num_rows):
            wh = b.column("words")[k].values.to_numpy().view(tk.U64)
            seed, _, at = item_seeds([wh])
            same = lambda v: pa.array(np.full(len(seed), v, np.int64))
            yield pa.record_batch([tk.i64(seed), same(b.column("item")[k].as_py()), pa.array(at), same(needed(len(wh)))], names=["seed", "item", "at", "need"])


def _bits(bits: int):
    """Words of the filter that the seeds of a batch set."""

    def run(batches):
        for b in batches:
            at, bit = Filter(bits, np.zeros(0, tk.U64)).place(np.asarray(b.column("seed")).view(tk.U64))
            by = np.argsort(at, kind="stable")
            first, _ = tk.runs(at[by])
            if len(first):
                yield pa.record_batch([pa.array(at[by][first]), tk.i64(np.bitwise_or.reduceat(bit[by], first))], names=["place", "bits"])

    return run


def _text_rows(known):
    """A row (seed, doc_id, tx, word) for every seed of the texts that the filter admits."""

    def run(batches):
        filter_ = Filter(*known.value)
        for b in batches:
            ids, tx = b.column("doc_id"), b.column("tx")
            for lo, _, wh, first, row in _hashes(b.column("text")):
                for at, h in filter_.admitted(wh):
                    own = row[at]
                    at, h, own = at[at + 3 < first[own + 1]], h[at + 3 < first[own + 1]], own[at + 3 < first[own + 1]]
                    if len(at):
                        pick = pa.array(own + lo)
                        yield pa.record_batch([tk.i64(h), ids.take(pick), tx.take(pick), pa.array(at - first[own])], names=["seed", "doc_id", "tx", "word"])

    return run


def _compare(batches):
    for b in batches:
        got = [agreement(b.column("words")[k].values.to_numpy(), b.column("want")[k].values.to_numpy(), -b.column("lo")[k].as_py()) for k in range(b.num_rows)]
        out = [b.column("doc_id"), b.column("tx"), b.column("item_id"), pa.array([n for n, _ in got], pa.int64()), pa.array([e for _, e in got], pa.int64())]
        yield pa.record_batch(out, names=["doc_id", "tx", "item_id", "n_words", "n_equal"]).filter(pa.array([n > 0 for n, _ in got], pa.bool_()))


def joined(base: DataFrame, items: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, tx, hits) of texts with hits, for a benchmark of any size: items (item, item_id, words).

    The filter has 2 ** bits bits however large the benchmark; nothing else is broadcast. Adaptive execution may split the
    join where a seed is common, and hits of one text, item and shift are counted before they are shuffled.
    """
    table = tk.written(items.mapInArrow(_item_rows, "seed long, item long, at long, need long"), "seeds")
    rows = table.select("seed").mapInArrow(_bits(bits), "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits"))
    got = rows.toArrow()  # 2 ** bits / 64 rows at most
    known = np.zeros(1 << bits >> 6, tk.U64)
    known[np.asarray(got.column("place"))] = np.asarray(got.column("bits")).view(tk.U64)
    texts = base.mapInArrow(_text_rows(base.sparkSession.sparkContext.broadcast((bits, known))), "seed long, doc_id long, tx long, word long")
    met = texts.join(table.hint("merge"), "seed").select("doc_id", "tx", "item", "need", (F.col("word") - F.col("at")).alias("shift"))
    shifts = met.groupBy("doc_id", "tx", "item", "shift").agg(F.count(F.lit(1)).alias("c"), F.first("need").alias("need")).where("c >= need")
    shifts = tk.written(shifts.select("doc_id", "tx", "item", "shift"), "shifts")
    held = shifts.select(F.col("doc_id").alias("d"), F.col("tx").alias("t")).distinct()
    texts = base.join(held.hint("merge"), base.doc_id.eqNullSafe(F.col("d")) & (base.tx == F.col("t"))).select("d", "t", "text")
    texts = tk.written(texts.dropDuplicates(["d", "t"]).mapInArrow(_words(["d", "t"]), "d long, t long, words array<long>"), "texts")
    pairs = shifts.join(items.select("item", "item_id", F.col("words").alias("want")).hint("merge"), "item")
    lo = F.greatest(F.lit(0), -F.col("shift")).cast("int")
    part = F.slice("words", (F.col("shift") + lo + 1).cast("int"), F.greatest(F.size("want") - lo, F.lit(0)))
    pairs = pairs.join(texts.hint("merge"), pairs.doc_id.eqNullSafe(texts.d) & (pairs.tx == texts.t)).select("doc_id", "tx", "item_id", lo.alias("lo"), part.alias("words"), "want")
    found = pairs.mapInArrow(_compare, "doc_id long, tx long, item_id long, n_words long, n_equal long")
    best = found.groupBy("doc_id", "tx", "item_id").agg(F.max(F.struct("n_words", "n_equal")).alias("m"))
    return best.groupBy("doc_id", "tx").agg(F.sort_array(F.collect_list(F.struct("item_id", "m.n_words", "m.n_equal"))).cast(HIT).alias("hits"))


def overlaps(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, tx (a hash of the text) and hits, the items whose words the text holds, for every row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text")).mapInArrow(_words(["item_id"]), "item_id long, words array<long>")
    items = tk.written(items.where(F.size("words") >= SHORT).select(F.monotonically_increasing_id().alias("item"), "item_id", "words"), "benchmark")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("tx", F.xxhash64("text"))
    if (items.agg(F.sum(F.size("words"))).first()[0] or 0) <= block:
        part = Block([(r.item_id, np.array(r.words, np.int64).view(tk.U64)) for r in items.orderBy("item").collect()])
        return base.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(part)), f"doc_id long, tx long, hits {HIT}")
    hits = tk.written(joined(base, items), "hits").withColumnsRenamed({"doc_id": "d", "tx": "t"})
    rows = base.select("doc_id", "tx")
    full = rows.join(hits.hint("merge"), rows.doc_id.eqNullSafe(hits.d) & (rows.tx == hits.t), "left")
    return full.select("doc_id", "tx", F.coalesce("hits", F.array().cast(HIT)).alias("hits"))


def report(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, contaminated, n_items, n_words and item_id: the longest overlap, and the smallest id of those as long."""
    found = overlaps(docs, benchmark, block)
    most = F.array_max(F.transform("hits", lambda h: h["n_words"]))
    ids = F.array_distinct(F.transform("hits", lambda h: h["item_id"]))
    best = F.array_min(F.transform(F.filter("hits", lambda h: h["n_words"] == most), lambda h: h["item_id"]))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), F.coalesce(most, F.lit(0)).cast("long").alias("n_words"), best.alias("item_id"))


def stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones; all others stay as they are, under whatever names their columns have.

    Null and empty texts stay; of rows with one id and different texts each is judged by its own.
    """
    bad = overlaps(docs, benchmark).where(F.size("hits") > 0).select("doc_id", "tx").distinct()
    rows = docs.select(tk.boxed(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("hash"))
    kept = rows.join(bad.hint("merge"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("tx")), "left_anti")
    return kept.select(*tk.unboxed(docs))
