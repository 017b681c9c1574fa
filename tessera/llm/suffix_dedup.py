"""Repeated byte strings across documents: an enhanced suffix array read as a tree of common-prefix intervals.

The suffixes of a large corpus are dealt out before they are sorted. Every string of `length` bytes owns the smallest
hash among its 32-byte grams, its minimiser; equal strings have equal minimisers at equal places, so strings can only
repeat within the group of one minimiser. Neighbouring strings with the same minimiser occurrence travel together as one
segment. Groups met once in the corpus are dropped by their hash alone, equal segments are merged by a second hash, and
only one copy of each remaining segment is read back as bytes. Each task leaves out segments of which no string's hash
occurs twice, builds the suffix array of the others with common-prefix lengths, scans it with a stack and reports the
maximal repeats: intervals whose members differ in the byte before. A group with more different segments than HOT is too
large for one task; it is parted by minimisers of ever longer grams, until each part is small enough to be scanned in the
same way. Grams of `length` bytes are the end of that: a part is then one string.

Defined cases: a null or empty text has no strings; texts under `length` bytes keep all bytes; rows that repeat an id and
a text count as copies of each other; an empty table gives an empty result; other columns pass through untouched, whatever
their names.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit as tk

LENGTH, GRAM, HOT, FEW = 200, 32, 1024, 6
BATCH_BYTES = 512 << 10


def segments(body: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Of each segment: row, first string's start in the row, number of strings, minimiser's hash and place, segment's hash."""
    n = len(body)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.view(tk.U64), none, none.view(tk.U64)
    prefix = tk.prefix_hash(body)
    _, inv = tk.powers(n)
    grams = tk.mix((prefix[gram:] - prefix[:-gram]) * inv[: n - gram + 1])
    key = (grams & tk.U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=tk.U64)
    need, have = length - gram + 1, 1
    while have * 2 <= need:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if need > have:
        key = np.minimum(key[: n - length + 1], key[need - have : need - have + n - length + 1])
    at = (key & tk.U64(0xFFFFFFFF)).astype(np.int64)
    size = np.diff(offs)
    count = np.maximum(size - length + 1, 0)  # strings of each row
    rows = np.flatnonzero(count)
    inside = np.repeat(offs[rows] - np.concatenate(([0], np.cumsum(count[rows])[:-1])), count[rows]) + np.arange(count.sum())
    own = np.repeat(rows, count[rows])
    at = at[inside]
    change = np.flatnonzero((at[1:] != at[:-1]) | (own[1:] != own[:-1])) + 1
    first = np.concatenate(([0], change))
    many = np.diff(np.concatenate((first, [len(at)])))
    start, row, place = inside[first], own[first], at[first]
    end = start + many - 1 + length
    whole = tk.mix(tk.stretch_hash(prefix, start, end) ^ ((place - start) * 1000003 + many).astype(tk.U64))
    return row, start - offs[row], many, grams[place], place - start, whole


def _segment_rows(length: int, gram: int):
    schema = pa.schema([("doc_id", pa.int64()), ("tx", pa.int64()), ("h", pa.int64()), ("g", pa.int64()), ("s", pa.int64()), ("n", pa.int32())])

    def run(batches):
        for b in batches:
            ids, tx = b.column("doc_id"), b.column("tx")
            for lo, _, body, offs in tk.slices(b.column("text")):
                row, s, n, h, _, g = segments(body, offs, length, gram)
                if len(row):
                    pick = pa.array(row + lo)
                    yield pa.record_batch([ids.take(pick), tx.take(pick), tk.i64(h), tk.i64(g), pa.array(s), pa.array(n.astype(np.int32))], schema=schema)

    return run


class SuffixArray:
    """Enhanced suffix array of several strings; only suffixes of at least `length` bytes are listed.

    Strings are compared as if each ended in a symbol of its own. `order` holds positions in the joined bytes, `lcp[i]`
    the common prefix of order[i - 1] and order[i].
    """

    def __init__(self, body: np.ndarray, offs: np.ndarray, length: int):
        n, size = len(body), np.diff(offs)
        self.body, self.string = body, np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.offs, self.rest = offs, offs[1:][self.string] - np.arange(n)
        padded = np.concatenate((body, np.zeros(8, np.uint8)))
        word = np.zeros(n, np.uint64)
        for k in range(8):
            word |= np.where(self.rest > k, padded[k : k + n], 0).astype(np.uint64) << np.uint64(56 - 8 * k)
        self.word = word
        by = np.argsort(word, kind="stable")
        short = (self.rest < 8)[by]
        new = np.ones(n, bool)
        new[1:] = (word[by][1:] != word[by][:-1]) | short[1:] | short[:-1]
        rank = np.empty(n, np.int32)
        rank[by] = np.cumsum(new) - 1
        self.ranks, have, most = [(8, rank)], 8, int(size.max(initial=0))
        while have < most:
            after = np.full(n, -1, np.int32)
            after[: max(0, n - have)] = rank[have:]
            after[self.rest <= have] = -1
            pair = rank.astype(np.int64) * (n + 1) + after + 1
            by = np.argsort(pair, kind="stable")
            new[1:] = pair[by][1:] != pair[by][:-1]
            rank = np.empty(n, np.int32)
            rank[by] = np.cumsum(new) - 1
            have *= 2
            self.ranks.append((have, rank))
        keep = np.flatnonzero(self.rest >= length)
        self.order = keep[np.argsort(rank[keep], kind="stable")]
        self.lcp = np.zeros(len(self.order), np.int64)
        if len(self.order) > 1:
            self.lcp[1:] = self._common(self.order[:-1], self.order[1:])

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, got, open_ = len(self.body), np.zeros(len(a), np.int64), np.ones(len(a), bool)
        most = np.minimum(self.rest[a], self.rest[b])
        for have, rank in reversed(self.ranks):
            x, y = np.minimum(a + got, n - 1), np.minimum(b + got, n - 1)
            same = open_ & (got < most) & (rank[x] == rank[y])
            got[same] += have
        x, y = np.minimum(a + got, n - 1), np.minimum(b + got, n - 1)
        differ = self.word[x] ^ self.word[y]
        for k in range(8):
            same = differ >> np.uint64(56 - 8 * k) == 0
            got += same & (got < most)
        return np.minimum(got, most)

    def maximal(self, length: int):
        """Yields (common length, positions) of every maximal repeat of at least `length` bytes, deepest first.

        A stack scan of the common-prefix lengths meets every interval of the tree once; an interval counts if its
        members have more than one byte before them, where a string's start differs from everything.
        """
        order, lcp = self.order, self.lcp
        left = np.where(order == self.offs[self.string[order]] if len(order) else np.zeros(0, bool), 256 + np.arange(len(order)), self.body[np.maximum(order - 1, 0)] if len(order) else 0)
        edge = np.concatenate((np.flatnonzero(lcp < length), [len(order)]))
        for lo, hi in zip(edge[:-1], edge[1:]):
            if hi - lo < 2 or (left[lo] < 256 and (left[lo:hi] == left[lo]).all()):
                continue  # also what lies deeper has one byte before it
            stack = [(length, lo)] if lcp[lo + 1 : hi].min() == length else []
            for i in range(lo + 1, hi + 1):
                depth, begin = (int(lcp[i]), i - 1) if i < hi else (0, i - 1)
                while stack and stack[-1][0] > depth or stack and i == hi:
                    top, begin = stack.pop()
                    run = left[begin:i]
                    if i - begin > 1 and (run[0] >= 256 or (run != run[0]).any()):
                        yield top, order[begin:i]
                if i < hi and (not stack or stack[-1][0] < depth):
                    stack.append((depth, begin))


def repeats(texts: list[bytes], length: int = LENGTH) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Maximal repeats of at least `length` bytes in a few texts: (the string, every (text, start) of it)."""
    body = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    if not len(body):
        return []
    sa = SuffixArray(body, offs, length)
    return [(body[at[0] : at[0] + n].tobytes(), sorted((int(sa.string[p]), int(p - offs[sa.string[p]])) for p in at)) for n, at in sa.maximal(length)]


def covered(body: np.ndarray, offs: np.ndarray, length: int):
    """(string, start, end) of what the maximal repeats of these strings cover, overlaps included."""
    sa = SuffixArray(body, offs, length)
    reach = np.zeros(len(body), np.int64)
    for n, at in sa.maximal(length):
        reach[at] = np.maximum(reach[at], n)
    at = np.flatnonzero(reach)
    string = sa.string[at]
    return string, at - offs[string], at - offs[string] + reach[at]


def repeating(body: np.ndarray, offs: np.ndarray, length: int) -> np.ndarray:
    """The strings of which a stretch of `length` bytes may occur twice: of all others no hash does, so none can."""
    at = np.flatnonzero(np.repeat(offs[1:], np.diff(offs)) - np.arange(len(body)) >= length)
    hashes = tk.stretch_hash(tk.prefix_hash(body), at, at + length)
    by = np.argsort(hashes)
    same = hashes[by][1:] == hashes[by][:-1]
    twice = np.zeros(len(at), bool)
    twice[by[1:][same]] = twice[by[:-1][same]] = True
    return np.unique(np.searchsorted(offs, at[twice], "right") - 1)


def _scan(length: int, key: str, carried: list[str]):
    """Bytes of segments, in order of their group's key, to the covered stretches of each, beside the columns carried.

    A group is never parted between two arrays.
    """

    def joined(texts):
        return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)

    def done(rows, texts):
        some = repeating(*joined(texts), length)
        if not len(some):
            return
        string, lo, hi = covered(*joined([texts[k] for k in some.tolist()]), length)
        string = some[string]
        counts = np.bincount(string, minlength=len(texts)) * 2
        keep = np.flatnonzero(counts)
        if len(keep):
            flat = np.stack((lo, hi), 1).ravel().astype(np.int32)
            own = pa.Table.from_batches(rows).combine_chunks().take(pa.array(keep)).to_batches()[0]
            yield pa.record_batch([*own.columns, tk.lists(counts[keep], pa.array(flat))], names=[*carried, "spans"])

    def run(batches):
        rows, texts, size, last = [], [], 0, None
        for b in batches:
            keys, some, at = b.column(key).to_pylist(), b.column("bytes").to_pylist(), 0
            part = b.select(carried)
            for k, t in enumerate(some):
                if size > BATCH_BYTES and keys[k] != last:
                    yield from done([*rows, *([part.slice(at, k - at)] if k > at else [])], texts)
                    rows, texts, size, at = [], [], 0, k
                texts.append(t)
                size, last = size + len(t), keys[k]
            if at < len(some):
                rows.append(part.slice(at))
        if texts:
            yield from done(rows, texts)

    return run


def scanned(groups: DataFrame, length: int, key: str, carried: dict[str, str]) -> DataFrame:
    """groups (key, bytes and the columns carried, by name and type), each whole group in one task, to spans."""
    dealt = groups.repartition(tk.partitions(groups.sparkSession), key).sortWithinPartitions(key).select(*dict.fromkeys([key, *carried]), "bytes")
    return dealt.mapInArrow(_scan(length, key, [*carried]), ", ".join(f"{c} {t}" for c, t in carried.items()) + ", spans array<int>")


def _cut(length: int):
    schema = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("hot", pa.bool_()), ("bytes", pa.binary())])

    def run(batches):
        for b in batches:
            text = tk.as_binary(b.column("text"))
            asked = b.column("asked")
            counts = np.asarray(asked.value_lengths().fill_null(0))
            rows = np.repeat(np.arange(len(counts)), counts)
            fields = asked.flatten()
            s, n = np.asarray(fields.field("s")), np.asarray(fields.field("n"))
            out = [text[int(r)].as_buffer() for r in np.flatnonzero(counts)]
            at = np.repeat(np.arange(len(out)), counts[counts > 0])
            values = [bytes(memoryview(out[a])[x : x + m - 1 + length]) for a, x, m in zip(at, s, n)]
            for lo in range(0, len(rows), 20000):
                f = fields.slice(lo, 20000)
                yield pa.record_batch([f.field("h"), f.field("g"), f.field("hot"), pa.array(values[lo : lo + 20000], pa.binary())], schema=schema)

    return run


PIECES = "h long, g long, at int, n int, m long, w long, bytes binary"


def _pieces(length: int, gram: int):
    """Segments parted by the minimisers of a longer gram: m tells groups apart, w the pieces of one; at is in the segment."""

    def run(batches):
        for b in batches:
            for lo, _, body, offs in tk.slices(b.column("bytes")):
                row, s, n, h, _, w = segments(body, offs, length, gram)
                pick = pa.array(row + lo)
                m = tk.mix(h ^ tk.mix(np.asarray(b.column("h").take(pick)).view(tk.U64) + tk.U64(1)))
                data, start = body.tobytes(), offs[row] + s
                cut = pa.array([data[x:y] for x, y in zip(start.tolist(), (start + n - 1 + length).tolist())], pa.binary())
                at = np.asarray(b.column("at").take(pick)) + s
                yield pa.record_batch([b.column("h").take(pick), b.column("g").take(pick), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), tk.i64(m), tk.i64(w), cut], names=["h", "g", "at", "n", "m", "w", "bytes"])

    return run


def parted(hot: DataFrame, length: int, gram: int, most: int) -> DataFrame:
    """(h, g, spans) of segments (h, g, bytes) of groups too large for one array.

    A group is parted again and again by minimisers of half as many places. Equal pieces are covered, pieces alone in
    their group are not, and one of each kind goes on: into an array where its group has `most` kinds or fewer, else into
    the next round. Grams of `length` bytes leave one kind a group, so the rounds end.
    """
    left, places, found = hot.select("h", "g", F.lit(0).alias("at"), "bytes"), length - gram + 1, []
    while places > 1 and not left.isEmpty():
        places = (places + 1) // 2 if places > FEW else 1
        pieces = tk.written(left.mapInArrow(_pieces(length, length - places + 1), PIECES), "repeat-pieces")
        kinds = tk.written(pieces.groupBy("m", "w").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("h", "g", "at")).alias("one")), "repeat-kinds")
        groups = tk.written(kinds.groupBy("m").agg(F.count(F.lit(1)).alias("kinds")), "repeat-groups")
        kinds = tk.written(kinds.join(groups.hint("merge"), "m").where("c > 1 or kinds > 1"), "repeat-kinds")
        both = tk.written(pieces.join(kinds.hint("merge"), ["m", "w"]), "repeat-pieces")
        found.append(both.where("c > 1").select("h", "g", F.array("at", F.col("at") + F.col("n") - 1 + length).alias("spans")))
        on = both.where("kinds > 1 and one.h = h and one.g = g and one.at = at")
        small = scanned(on.where(F.col("kinds") <= most), length, "m", {"h": "long", "g": "long", "at": "int"})
        found.append(small.select("h", "g", F.transform("spans", lambda x: x + F.col("at")).alias("spans")))
        left = on.where(F.col("kinds") > most).select("h", "g", "at", "bytes")
    every = left.select("h", "g", F.array("at").alias("spans")).limit(0) if not found else found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return every.groupBy("h", "g").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of stretches that overlap or touch."""
    by = np.argsort(starts, kind="stable")
    s, e = starts[by], np.maximum.accumulate(ends[by])
    new = np.concatenate(([True], s[1:] > e[:-1])) if len(s) else np.zeros(0, bool)
    last = np.concatenate((np.flatnonzero(new)[1:], [len(s)])) - 1 if len(s) else np.zeros(0, np.int64)
    return s[new], e[last]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text as bytes, and tx, which tells rows apart that share an id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("tx", F.xxhash64("text"))


def repeat_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT, gram: int = GRAM) -> DataFrame:
    """(doc_id, tx, spans): the bytes of each document that a repeated string covers, as start and end in turn, unmerged."""
    base = keyed(docs)
    segs = base.where(F.length("text") >= length).mapInArrow(_segment_rows(length, gram), "doc_id long, tx long, h long, g long, s long, n int")
    often = segs.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("g").alias("g0"), F.max("g").alias("g1")).where("c > 1")
    often = tk.written(often.select("h", (F.col("g0") != F.col("g1")).alias("mixed")), "repeat-often")  # tables on both sides let a common h be split
    met = tk.written(segs.join(often.hint("merge"), "h"), "repeat-segments")
    whole = met.where(~F.col("mixed"))
    kinds = tk.written(met.where("mixed").groupBy("h", "g").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "tx", "s", "n")).alias("one")), "repeat-kinds")
    groups = tk.written(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).select("h", (F.col("kinds") > hot).alias("hot")), "repeat-groups")
    kinds = tk.written(kinds.join(groups.hint("merge"), "h").select("h", "g", "c", "hot", "one.*"), "repeat-kinds")
    asked = kinds.groupBy("doc_id", "tx").agg(F.collect_list(F.struct("h", "g", "hot", "s", "n")).alias("asked"))
    owners = base.join(asked.hint("merge"), (base.doc_id.eqNullSafe(asked.doc_id)) & (base.tx == asked.tx)).select("text", "asked")
    cut = tk.written(owners.mapInArrow(_cut(length), "h long, g long, hot boolean, bytes binary").dropDuplicates(["h", "g"]), "repeat-bytes")
    small = scanned(cut.where(~F.col("hot")), length, "h", {"h": "long", "g": "long"})
    large = parted(cut.where("hot"), length, gram, hot)
    own = kinds.select("h", "g", "c").join(small.unionByName(large).hint("merge"), ["h", "g"], "left")
    own = tk.written(own.where("c > 1 or spans is not null").select("h", "g", F.when(F.col("c") == 1, F.col("spans")).alias("spans")), "repeat-spans")
    part = met.where("mixed").join(own.hint("merge"), ["h", "g"]).select("doc_id", "tx", "s", "n", "spans")
    all_ = whole.select("doc_id", "tx", "s", "n", F.lit(None).cast("array<int>").alias("spans")).unionByName(part)
    stretch = F.coalesce(F.col("spans"), F.array(F.lit(0), F.col("n") - 1 + length))
    all_ = all_.select("doc_id", "tx", F.transform(stretch, lambda x: x + F.col("s")).alias("spans"))
    return all_.groupBy("doc_id", "tx").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def _removed(batches):
    for b in batches:
        text = tk.as_binary(b.column("text"))
        spans = b.column("spans")
        out = []
        for i in range(b.num_rows):
            data = text[i].as_py()
            kept, gone, n, at = data, 0, 0, []
            if spans[i].is_valid and len(spans[i]):
                pairs = np.asarray(spans[i].values).reshape(-1, 2)
                lo, hi = merged(pairs[:, 0], pairs[:, 1])
                gone, n = int((hi - lo).sum()), len(lo)
                ends = [0, *hi.tolist()]
                kept = b"".join(data[a:c] for a, c in zip(ends, [*lo.tolist(), len(data)]))
                at = np.stack((lo, hi), 1).ravel().tolist()
            out.append((len(data), gone, n, hashlib.sha256(kept).hexdigest(), at, kept))
        cols = list(zip(*out)) if out else [[]] * 6
        yield pa.record_batch(
            [b.column("doc_id"), b.column("tx"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(pa.int64())), pa.array(cols[5], pa.binary())],
            names=["doc_id", "tx", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"],
        )


def dedup(docs: DataFrame, length: int = LENGTH, hot: int = HOT, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: doc_id, tx, n_bytes, n_removed, n_spans, kept_sha256, removed (start, end in turn), kept (bytes)."""
    base, spans = keyed(docs), repeat_spans(docs, length, hot, gram)
    full = base.join(spans.hint("merge"), (base.doc_id.eqNullSafe(spans.doc_id)) & (base.tx == spans.tx), "left").select(base.doc_id, base.tx, base.text, spans.spans)
    return full.mapInArrow(_removed, "doc_id long, tx long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<long>, kept binary")


def _kept_text(text, spans):
    def one(t, s):
        if t is None or s is None or not len(s):
            return t
        data, pairs = t.encode(), np.asarray(s).reshape(-1, 2)
        lo, hi = merged(pairs[:, 0], pairs[:, 1])
        ends = [0, *hi.tolist()]
        return b"".join(data[a:c] for a, c in zip(ends, [*lo.tolist(), len(data)])).decode("utf-8", "ignore")

    return text.combine(spans, one)


def stage(docs: DataFrame) -> DataFrame:
    """docs with every repeated string of LENGTH bytes taken out of text; a character that a cut halves goes with it.

    All rows stay, also those left without text; null stays null; n_chars, where there is such a column, follows the text;
    rows of one id and text lose the same bytes; other columns pass through, whatever their names.
    """
    rows = docs.select(tk.boxed(docs), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("body"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("hash"))
    spans = repeat_spans(docs)
    full = rows.join(spans.hint("merge"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("tx")), "left")
    full = full.select("row", F.pandas_udf(_kept_text, "string")("body", "spans").alias("left"))
    new = {"text": F.col("left")} | ({"n_chars": F.length("left").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return full.select(*tk.unboxed(docs, **new))
