"""Near-duplicate classes by BagMinHash signatures of five-word shingles, banded and verified.

Shingles are counted, so documents are bags and similarity is the weighted Jaccard of their counts. The counts are
discretised into shells [0,1), [1,2), [2,4), [4,8), ... of which each shingle owns a Poisson process with the shell's
width as its rate; a point falls on a random slot, and counts if its place in the shell lies under the shingle's count.
A slot keeps its earliest point. Processes are run lazily, a shingle's next points only while they can still come before
the latest slot, so long documents cost little more than one point a shingle.

Texts of equal words, told by 128 bits of a cryptographic hash, are one node. Nodes that share a band are joined to the
smallest node of the bucket; exact bags decide (0.8 or more), and components follow from rounds of star contraction.
Members of a bucket that are then still in different components meet with their bags, in blocks of about BLOCK members or
BLOCK * SHINGLES shingles (see blocks). Signatures' low bytes say which may reach the threshold (DEVIATIONS standard
deviations below it), bags decide at once, and components found to be one are joined there, so a task lists fewer links
than it has members. Buckets of the same members are compared once. So no pairs within a component are listed, and none
between components are left out.

Words are runs of non-white-space in lower case. Defined cases: a text of under five words is one shingle of all its
words; a text without words, or null, is in a class of its own; repeated rows and ids are members like others; an empty
table has no classes; columns other than doc_id and text are not read, whatever their names.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit as tk
from tessera.operators.graph import components

SHINGLE, SIMILAR, ROWS, BANDS = 5, 0.8, 6, 40
BLOCK, SHINGLES, DEVIATIONS = 2048, 500, 6


def shingles(body: np.ndarray, offs: np.ndarray, size: int = SHINGLE):
    """Row, hash and count of each different shingle, sorted by row; and the number of each row's words."""
    n = len(offs) - 1
    start, end, row = tk.words(body, offs)
    wh = tk.word_hashes(body, start, end)
    many = np.bincount(row, minlength=n)
    first = np.cumsum(many) - many
    prefix = tk.prefix_hash(wh)
    take = np.where(many >= size, many - size + 1, np.minimum(many, 1))
    own = np.repeat(np.arange(n), take)
    at = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(take) - take, take)
    h = tk.mix(tk.stretch_hash(prefix, at, np.minimum(at + size, first[own] + many[own])))
    by = np.argsort(h, kind="stable")
    by = by[np.argsort(own[by], kind="stable")]
    h, own = h[by], own[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(new)
    return own[at], h[at], np.diff(np.concatenate((at, [len(h)]))), many


def signatures(own: np.ndarray, h: np.ndarray, count: np.ndarray, n: int, slots: int) -> np.ndarray:
    """Earliest point of each slot, for n bags; of an empty bag all are infinite."""
    sig = np.full(n * slots, np.inf)
    parts = [(np.arange(len(h)), np.zeros(len(h), np.int64), np.ones(len(h)))]
    k = 1
    while len(at := np.flatnonzero(count > 1 << (k - 1))):
        parts.append((at, np.full(len(at), k), np.full(len(at), float(1 << (k - 1)))))
        k += 1
    elem, shell, rate = (np.concatenate(x) for x in zip(*parts))
    seed, bag, most = tk.mix(h[elem] + shell.astype(tk.U64) * tk.U64(0x9E3779B97F4A7C15)), own[elem], count[elem]
    time, done, each, latest = np.zeros(len(elem)), 0, 1, np.full(n, np.inf)
    while len(seed):
        step = np.arange(done + 1, done + each + 1, dtype=tk.U64) * tk.U64(0xD1342543DE82EF95)
        bits = tk.mix((seed[:, None] + step).ravel())
        wait = -np.log1p(-(bits >> tk.U64(24)).astype(float) / (1 << 40)).reshape(-1, each) / rate[:, None]
        at = time[:, None] + np.cumsum(wait, 1)
        slot = ((bits & tk.U64(0xFFFFFF)).astype(np.int64) * slots >> 24).reshape(-1, each)
        good = at < latest[bag][:, None]
        if (shell > 0).any():
            wide = shell > 0
            place = (tk.mix(bits).reshape(-1, each)[wide] >> tk.U64(12)).astype(float) / (1 << 52)
            good[wide] &= rate[wide, None] * (1 + place) < most[wide, None]
        np.minimum.at(sig, ((bag * slots)[:, None] + slot)[good], at[good])
        latest = sig.reshape(n, slots).max(1)
        time = at[:, -1]
        on = time < latest[bag]
        seed, bag, most, rate, shell, time = seed[on], bag[on], most[on], rate[on], shell[on], time[on]
        done += each
        each = min(64, each if done < 2 else each * 2)
    return sig.reshape(n, slots)


PLAIN = bytes(32 if tk.SPACE[c] else c for c in range(256))


def same_words(data: bytes) -> bytes:
    """128 bits of a cryptographic hash of the words: texts of other words have other bits."""
    return hashlib.blake2b(b" ".join(data.translate(PLAIN).split()), digest_size=16).digest()


def _marks(rows: int, bands: int):
    schema = pa.schema([("doc_id", pa.int64()), ("tx", pa.int64()), ("w", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches):
        for b in batches:
            for lo, hi, body, offs in tk.slices(tk.lower(b.column("text"))):
                own, h, count, many = shingles(body, offs)
                sig = signatures(own, h, count, hi - lo, rows * bands)
                raw = tk.mix(sig.view(tk.U64).ravel()).reshape(sig.shape)
                band = np.zeros((hi - lo, bands), tk.U64)
                for k in range(rows):
                    band = tk.mix(band + raw[:, k::rows])
                band = tk.mix(band + np.arange(bands, dtype=tk.U64))
                size = np.bincount(own, weights=count, minlength=hi - lo).astype(np.int64)
                some = many > 0
                lists = tk.lists(np.where(some, bands, 0), tk.i64(band[some].ravel()))
                sketch = (raw & tk.U64(255)).astype(np.uint8)
                ids = b.slice(lo, hi - lo)
                data, ends = body.tobytes(), offs.tolist()
                same = pa.array([same_words(data[x:y]) for x, y in zip(ends, ends[1:])], pa.binary())
                yield pa.record_batch([ids.column("doc_id"), ids.column("tx"), same, pa.array(size), lists, pa.array([x.tobytes() for x in sketch], pa.binary())], schema=schema)

    return run


def _bags(batches):
    """Shingles of each text as sorted 64-bit numbers, the c-th copy of one as a number of its own."""
    for b in batches:
        for lo, hi, body, offs in tk.slices(tk.lower(b.column("text"))):
            own, h, count, _ = shingles(body, offs)
            at = np.repeat(np.arange(len(h)), count)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            every = np.where(nth > 0, tk.mix(h[at] + nth.astype(tk.U64)), h[at]).view(np.int64)
            row = own[at]
            by = np.argsort(every, kind="stable")
            by = by[np.argsort(row[by], kind="stable")]
            yield pa.record_batch([b.column("node").slice(lo, hi - lo), tk.lists(np.bincount(row, minlength=hi - lo), pa.array(every[by]))], names=["node", "bag"])


def _verify(similar: float):
    def run(batches):
        for b in batches:
            good = np.zeros(b.num_rows, bool)
            (x, xo), (y, yo) = (((c := b.column(k)).flatten().to_numpy(), np.concatenate(([0], np.cumsum(np.asarray(c.value_lengths()))))) for k in ("bag_a", "bag_b"))
            for i in range(b.num_rows):
                p, q = x[xo[i] : xo[i + 1]], y[yo[i] : yo[i + 1]]
                if min(len(p), len(q)) < similar * max(len(p), len(q)) or not len(p):
                    continue
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                good[i] = both >= similar * (len(p) + len(q) - both) - 1e-9
            yield pa.record_batch([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(good))

    return run


def linked(node, comp, size, side, bits, bag, offs, same: bool, similar: float):
    """Pairs at `similar` or more that join different components of one bucket's block, or of two blocks; one a join."""
    comp = np.unique(comp, return_inverse=True)[1]
    some, bag = np.unique(bag, return_inverse=True)
    held, size = np.zeros(len(some), bool), size.astype(float)
    left, right = (np.arange(len(node)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    m = bits.shape[1]
    least = m * (similar - DEVIATIONS * (similar * (1 - similar) / m) ** 0.5)
    for i in left:
        j = right[right > i] if same else right
        j = j[(comp[j] != comp[i]) & (np.minimum(size[j], size[i]) >= similar * np.maximum(size[j], size[i]) - 1e-9)]
        if len(j):
            j = j[(bits[j] == bits[i]).sum(1) >= least]
        if not len(j):
            continue
        many = offs[j + 1] - offs[j]
        first = np.cumsum(many) - many
        held[bag[offs[i] : offs[i + 1]]] = True
        both = np.add.reduceat(held[bag[np.repeat(offs[j] - first, many) + np.arange(many.sum())]].astype(np.int64), first)
        held[bag[offs[i] : offs[i + 1]]] = False
        j = j[both >= similar * (size[i] + size[j] - both) - 1e-9]
        for c, at in zip(*np.unique(comp[j], return_index=True)):
            yield node[i], node[j[at]]
            comp[comp == c] = comp[i]


def _across(similar: float):
    """Rows in order of bucket and blocks, to the links between components of each."""

    def close(now, parts):
        node, comp, size, side, bits, bag, many = (np.concatenate(x) for x in zip(*parts))
        offs = np.concatenate(([0], np.cumsum(many)))
        if len(node) > 1 and (out := list(linked(node, comp, size, side, bits, bag, offs, now[1] == now[2], similar))):
            a, b = np.array(out).T
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches):
        now, parts = None, []
        for b in batches:
            if not b.num_rows:
                continue
            bucket, i, j, node, comp, size, side = (b.column(c).to_numpy() for c in ("bucket", "i", "j", "node", "comp", "n", "side"))
            bits = tk.flat(b.column("sketch"))[0].reshape(len(node), -1)
            bag, many = b.column("bag").flatten().to_numpy(), np.asarray(b.column("bag").value_lengths()).astype(np.int64)
            offs = np.concatenate(([0], np.cumsum(many)))
            new = (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(node)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                key = (bucket[lo], i[lo], j[lo])
                if key != now:
                    if parts:
                        yield from close(now, parts)
                    now, parts = key, []
                got = (node[lo:hi], comp[lo:hi], size[lo:hi], side[lo:hi], bits[lo:hi], bag[offs[lo] : offs[hi]], many[lo:hi])
                parts.append(tuple(x.copy() for x in got) if hi == len(node) else got)
        if parts:
            yield from close(now, parts)

    return run


def blocks(where: DataFrame, block: int) -> DataFrame:
    """Rows (bucket, i, j, node, comp, n, side) of what must meet: members of a bucket that lie in different components.

    A bucket of over `block` members is dealt in two lots: its largest component, whose members need not meet each other,
    and the rest. Blocks of the rest meet all blocks, so a few strays cost one reading of a large component.
    """
    sizes = where.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("size"))
    sizes = sizes.groupBy("bucket").agg(F.sum("c").alias("c"), F.sum("size").alias("size"), F.max(F.struct("c", "size", "comp")).alias("top"))
    many = lambda c, size: F.ceil(F.greatest(c / block, size / (block * SHINGLES))).cast("int")
    split = many(F.col("c"), F.col("size")) > 1
    large = F.when(split, many(F.col("top.c"), F.col("top.size"))).otherwise(0)
    rest = F.when(split, many(F.col("c") - F.col("top.c"), F.col("size") - F.col("top.size"))).otherwise(1)
    plan = tk.written(sizes.select("bucket", F.when(split, F.col("top.comp")).alias("top"), large.alias("large"), rest.alias("rest")), "split")
    rows = where.join(plan.hint("merge"), "bucket")
    inside = F.coalesce(F.col("comp") == F.col("top"), F.lit(False))
    deal = F.xxhash64("node", F.lit("block"))
    own = F.when(inside, F.pmod(deal, F.greatest("large", F.lit(1)))).otherwise(F.col("large") + F.pmod(deal, F.col("rest"))).cast("int")
    meets = F.sequence(F.when(inside, F.col("large")).otherwise(0), F.col("large") + F.col("rest") - 1)
    rows = rows.withColumn("own", own).withColumn("o", F.explode(meets))
    return rows.select("bucket", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "node", "comp", "n", (F.col("own") > F.col("o")).cast("int").alias("side"))


def classes(docs: DataFrame, similar: float = SIMILAR, rows: int = ROWS, bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """doc_id, tx (a hash of the text), key, which tells classes apart, and class_id, the class's smallest doc_id, of every row."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tx", F.xxhash64("text"))
    marks = tk.written(base.mapInArrow(_marks(rows, bands), "doc_id long, tx long, w binary, n long, bands array<long>, sketch binary"), "marks")
    nodes = marks.where("n > 0").groupBy("w").agg(F.min(F.struct("doc_id", "tx", "n", "bands", "sketch")).alias("one"), F.min("doc_id").alias("low"))
    nodes = tk.written(nodes.select(F.monotonically_increasing_id().alias("node"), "w", "low", "one.*"), "nodes")
    member = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    first = F.min(F.struct("node", "n"))
    bucket = member.groupBy("bucket").agg(first.alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("bucket", F.col("first.node").alias("leader"), F.col("first.n").alias("size"))
    bucket = tk.written(bucket, "leaders")
    met = tk.written(member.join(bucket.hint("merge"), "bucket"), "buckets")

    def bags(of):
        found = nodes.select("node", F.col("doc_id").alias("d"), F.col("tx").alias("t")).join(of.distinct().hint("merge"), "node")
        texts = base.join(found.hint("merge"), base.doc_id.eqNullSafe(found.d) & (base.tx == found.t)).select("node", "text")
        return tk.written(texts.mapInArrow(_bags, "node long, bag array<long>").dropDuplicates(["node"]), "bags")

    near = F.least("n", "size") >= similar * F.greatest("n", "size") - 1e-9  # no others can be alike enough
    stars = tk.written(met.where((F.col("node") != F.col("leader")) & near).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    ends = bags(stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))))
    a, b = (ends.withColumnsRenamed({"node": k, "bag": f"bag_{k}"}) for k in "ab")
    links = tk.written(stars.join(b.hint("merge"), "b").join(a.hint("merge"), "a").mapInArrow(_verify(similar), "a long, b long"), "links")
    comp = tk.written(components(links), "components")
    where = met.select("bucket", "node", "n").join(comp.hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    where = tk.written(where, "members")
    alike = [F.count(F.lit(1)).alias("c"), F.sum("n").alias("size"), *(F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (1, 2))]
    split = where.groupBy("bucket").agg(*alike, F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    split = tk.written(split.groupBy("c", "size", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket"), "split")
    rest = tk.written(where.join(split.hint("merge"), "bucket"), "split")
    meets = blocks(rest, block)
    meets = meets.join(nodes.select("node", "sketch").hint("merge"), "node").join(bags(rest.select("node")).hint("merge"), "node")
    dealt = meets.repartition(tk.partitions(spark), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    more = tk.written(dealt.select("bucket", "i", "j", "node", "comp", "n", "side", "sketch", "bag").mapInArrow(_across(similar), "a long, b long").distinct(), "links")
    if not more.isEmpty():
        comp = tk.written(components(links.unionByName(more)), "components")
    named = nodes.select("node", "w", "low").join(comp.hint("merge"), "node", "left").select("w", "low", F.coalesce("comp", "node").alias("comp"))
    ids = tk.written(named.groupBy("comp").agg(F.min("low").alias("class_id")), "class-ids")
    named = tk.written(named.join(ids.hint("merge"), "comp").select("w", "comp", "class_id"), "classes")
    key = lambda e, k: F.struct(F.lit(e).alias("e"), k.alias("k")).alias("key")
    some = marks.where("n > 0").select("doc_id", "tx", "w").join(named.hint("merge"), "w").select("doc_id", "tx", key(0, F.col("comp")), "class_id")
    none = marks.where("n = 0").select("doc_id", "tx", key(1, F.coalesce("doc_id", F.lit(-1))), F.col("doc_id").alias("class_id"))
    return some.unionByName(none)


def stage(docs: DataFrame) -> DataFrame:
    """docs with one row of each class, whole and under the columns they came with.

    It is the row of the smallest id (a null id only where the class has no other), of the smallest text hash among its
    rows, and of the smallest hash of the other columns among rows alike in both. A row without words is a class of its
    own, but rows of one id without words are one; an empty table stays empty; columns may have any names.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = classes(docs).groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tx")).alias("one"))
    keep = found.select("one.doc_id", "one.tx")
    rest = [c for c in docs.columns if c != "text"]
    order = F.xxhash64(F.to_json(F.struct(*[tk.named(c).alias(f"c{k}") for k, c in enumerate(rest)])))
    rows = docs.select(tk.boxed(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("hash"), order.alias("order"))
    kept = rows.join(keep.hint("merge"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("tx")))
    return kept.groupBy("id", "hash").agg(F.min_by("row", "order").alias("row")).select(*tk.unboxed(docs))
