"""Personal data: base patterns, proposals of high recall, and boosted trees that choose among them.

Base patterns give spans that always stay. Besides, generators propose overlapping spans around every number and every
sign that can stand for `@`: all stretches of neighbouring groups of digits that can be a card, a phone number or an
address, and mail addresses also where `@` and dots are written out. Gradient-boosted trees score each proposal by its
format (digits, groups, separators, check digit, ranges, labels) and by what stands around it. They learn from
proposals of the corpus: one that is a base span is right, one that neither is nor touches a match that its check dropped
is wrong, and one that touches such a match is not learnt from but judged. Right ones are also learnt in other notations
and beside other numbers, and as wrong ones with digits changed or with a number that doesn't belong to them. On documents that the trees have not seen, scores of each kind are made monotone
probabilities, and the least score of probability 0.95 is the kind's threshold. Proposals above it that touch no base span
are added, the highest first, as long as they don't overlap.

One pass over the texts writes base spans and proposals with 24 characters on either side; training and choice read that
table. All proposals are learnt from, each with its context once. Lessons of equal numbers are one row with counts; bins follow
from the counts of every feature's values, and the trees grow in a barrier stage, whose tasks hold a share of the rows each and
sum what falls into each bin, in whole units, so that any number of tasks grows the same trees. Thresholds follow from counts by
score, in thousandths. The driver gets the counts of the features' values, the trees, and the counts of scores.

Defined cases: a null text is empty and holds nothing; repeated rows give the same rows; a kind of which the corpus has no
right or no wrong proposal gets none added; an empty table gives an empty one. Offsets count code points. Columns other
than doc_id and text take no part and are not returned.
"""

import bisect
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit as tk
from tessera.models import spread

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
ROWS = 200_000  # lessons of different numbers that are worth a task
UNITS = 1 << 20  # of a sum, so that its parts add up to the same in any order
AROUND = 24
SURE = 0.95

HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
ADDRESS = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])++")
CALL = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")

RUN = re.compile(r"[0-9](?:[ ().\-/]{0,3}[0-9])*+")
AT = re.compile(r"@| ?[\[({] ?at ?[\])}] ?| at (?=[\w-]{1,63} dot )", re.I)
NAME = re.compile(r"[\w.%+-]{1,64}\Z")
FULL = re.compile(r"[\w-]{1,63}(?:(?:\.| ?[\[({] ?dot ?[\])}] ?| dot )[\w-]{1,63}){0,5}", re.I)
SEPARATORS = " ().-/"


def checked(digits: str) -> bool:
    """The Luhn check."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or 0) < 256


def base(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans (kind, start, end) of the base patterns, leftmost and not overlapping within a kind; and the matches dropped."""
    kept, dropped = [], []
    done, at = 0, text.find("@")
    while at >= 0:  # a local part ends at its @ and the host follows, so a look back from each @ finds the leftmost match
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            kept.append((EMAIL, start, host.end()))
        done = host.end() if host else at + 1
        at = text.find("@", done)
    for m in ADDRESS.finditer(text):
        (kept if all(map(octet, m.groups())) else dropped).append((IP, *m.span()))
    for m in NUMBER.finditer(text):
        digits = re.sub("[ -]", "", m[0]) if m.end() - m.start() < 64 else ""
        (kept if 16 <= len(digits) <= 19 and checked(digits) else dropped).append((CARD, *m.span()))
    for m in CALL.finditer(text):
        n = sum(len(d) for d in DIGITS.findall(m[0]))
        (kept if 8 <= n <= 15 else dropped).append((PHONE, *m.span()))
    return kept, dropped


def proposed(text: str) -> list[tuple[int, int, int]]:
    """Spans that may be personal data. No more than some twenty start at one group of digits, none is long."""
    out = []
    for m in AT.finditer(text):
        name, host = NAME.search(text, max(0, m.start() - 64), m.start()), FULL.match(text, m.end())
        if name and host:
            out.append((EMAIL, name.start(), host.end()))
    for run in RUN.finditer(text):
        if run.end() - run.start() < 7:
            continue
        groups = [d.span() for d in DIGITS.finditer(text, *run.span())]
        for i, (start, _) in enumerate(groups):
            n = 0
            for j in range(i, len(groups)):
                n += groups[j][1] - groups[j][0]
                if n > 19:
                    break
                end = groups[j][1]
                if j == i + 3 and all(b - a < 4 for a, b in groups[i : j + 1]):
                    out.append((IP, start, end))
                if n >= 13:
                    out.append((CARD, start, end))
                if 7 <= n <= 15:
                    before = text[max(0, start - 2) : start]
                    out.append((PHONE, start - (2 if before == "+(" else before[-1:] in ("+", "(")), end))
    return out


def kind_of(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c in "abcdefABCDEF" else 4 if c.isalpha() else 5


def described(kind: int, before: str, span: str, after: str) -> list[float]:
    """Format and context of a proposal, as numbers."""
    groups = DIGITS.findall(span)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    between = re.sub(r"[0-9]", "", span)
    out = [float(kind == k) for k in range(4)]
    out += [len(span), len(digits), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1], len(between), len(set(between))]
    out += [between.count(c) for c in SEPARATORS]
    out += [span.startswith("+"), span.startswith("("), bool(digits) and checked(digits), len(groups) == 4 and all(map(octet, groups)), len(groups) == 4 and between == "...", int(digits[0]) if digits else -1]
    name, _, host = span.partition("@")
    labels = host.split(".")
    out += ["@" in span, len(name), len(labels), len(labels[-1]), labels[-1].isalpha(), bool(re.search(r"\bat\b", span, re.I)), len(re.findall(r"\bdot\b", span, re.I)), sum(c.isalpha() for c in span)]
    left, right = before.rstrip(), after.lstrip()
    out += [kind_of(before[-1:]), kind_of(before[-2:-1]), kind_of(after[:1]), kind_of(after[1:2]), kind_of(left[-1:]), kind_of(right[:1])]
    out += [before.endswith(tuple("+.-/")), after.startswith(tuple(".-/")) and after[1:2].isdigit(), before[-2:-1].isdigit() and before[-1:] in SEPARATORS]
    out += [sum(c.isdigit() for c in before), sum(c.isdigit() for c in after), sum(c.isalpha() for c in before[-8:])]
    return [float(x) for x in out]


def passing(span: str) -> str:
    """The span with a last digit that passes the Luhn check."""
    return next(t for t in (span[:-1] + d for d in "0123456789") if checked("".join(DIGITS.findall(t))))


def lessons(kind: int, before: str, span: str, after: str):
    """A right proposal in other notations and beside other numbers, and wrong ones that look like one: kind, what stands
    before, the span, what stands after, and whether it is right."""
    groups = DIGITS.findall(span)
    digits = "".join(groups)
    right, wrong = [], []
    if kind == EMAIL:
        name, _, host = span.partition("@")
        right = [name + at + host.replace(".", dot) for at, dot in ((" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), (" (at) ", " dot "))]
        wrong = [(EMAIL, f"{name}@{host.partition('.')[0]}")]
    elif kind == IP:
        a, b, c, d = groups
        wrong = [(IP, f"{a}.{b}.{c}.{int(d) + 300}"), (IP, f"{a} {b} {c} {d}"), (IP, f"{a}/{b}/{c}.{d}"), (CARD, passing(f"{span} 2019-{digits[:2]}-10"))]
    elif kind == CARD:
        right = [mark.join(digits[k : k + 4] for k in range(0, len(digits), 4)) for mark in (".", "/", " - ")]
        other = digits[:-1] + str((int(digits[-1]) + 3) % 10)
        wrong = [(CARD, other), (CARD, ".".join(other[k : k + 4] for k in range(0, len(other), 4)))]
    else:
        right = [re.sub(r"[ ()-]+", ".", span), re.sub(r"[()]", "", span), re.sub(r"\A\+[0-9]+ ?(?=\()", "", span)]
        wrong = [(PHONE, f"19{digits[:2]}-{digits[2:4]}-{digits[4:6]} {digits[6:8]}"), (PHONE, digits), (CARD, passing(f"{span[1:]} 20{digits[-2:]}-10-18")), (CARD, passing(f"{span[-8:]} {digits[:2]}.5 2018-04-27"))]
    for s in (span, *right):
        yield kind, before, s, after, True
    if kind in (CARD, PHONE):
        yield kind, before, span, f" 17{digits[-1]}.10{digits[0]}.4{digits[1]}.18{after}"[:AROUND], True
        yield kind, before, span, f" {digits[::-1]}{after}"[:AROUND], True
        yield kind, f"{before}20{digits[:2]}-10-{digits[2:4]} "[-AROUND:], span, after, True
    for k, s in wrong:
        yield k, before, s, after, False


class Trees:
    """Gradient boosting of the logistic loss with trees of three levels on binned features."""

    def __init__(self, rounds: int = 60, rate: float = 0.3, bins: int = 32):
        self.rounds, self.rate, self.bins = rounds, rate, bins
        self.start, self.feature, self.cut, self.leaf = 0.0, np.zeros((0, 7), int), np.zeros((0, 7)), np.zeros((0, 8))

    def edges(self, values: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Quantiles of the values, of which there are n each, without the greatest."""
        by = np.argsort(values, kind="stable")
        upto = np.cumsum(n[by])
        return np.unique(values[by][np.searchsorted(upto, np.floor(np.linspace(0, 1, self.bins) * (upto[-1] - 1)), "right")])[:-1]

    def fit(self, x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, edges: list[np.ndarray] | None = None, total=lambda a: a) -> "Trees":
        """x: features of a row, y: how many of the n that it stands for are right; total adds up the parts of many tasks."""
        n = np.ones(len(y)) if n is None else n
        edges = [self.edges(c, np.ones(len(c), int)) for c in x.T] if edges is None else edges
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1).astype(np.uint8)  # c <= edges[b] stands in bin b or below
        right, every = total(np.array([y.sum(), n.sum()], float))
        p = np.clip(right / every, 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        score, trees = np.full(len(y), self.start), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = np.rint((y - n * p) * UNITS), np.rint(n * p * (1 - p) * UNITS)
            feature, cut, node = np.zeros(7, int), np.full(7, np.inf), np.zeros(len(y), int)
            for level in range(3):
                first, many = 2**level - 1, 2**level
                best = np.full(many, 1e-6)
                sums = np.zeros((2, len(edges), many * self.bins))
                for f in range(len(edges)):
                    cell = (node - first) * self.bins + binned[:, f]
                    sums[0, f], sums[1, f] = (np.bincount(cell, w, many * self.bins) for w in (g, h))
                sums = total(sums).reshape(2, len(edges), many, self.bins) / UNITS
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    gs, hs = sums[:, f]
                    gl, hl = gs.cumsum(1)[:, : len(e)], hs.cumsum(1)[:, : len(e)]
                    ga, ha = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                    gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                    at = gain.argmax(1)
                    won = gain[np.arange(many), at] > best
                    best[won] = gain[np.arange(many), at][won]
                    feature[first : first + many][won], cut[first : first + many][won] = f, e[at[won]]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
            gs, hs = total(np.stack([np.bincount(node - 7, w, 8) for w in (g, h)])) / UNITS
            leaf = self.rate * gs / (hs + 1)
            score += leaf[node - 7]
            trees.append((feature, cut, leaf))
        self.feature, self.cut, self.leaf = (np.stack(a) for a in zip(*trees))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), int)
            for _ in range(3):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            out += leaf[node - 7]
        return out


def monotone(score: np.ndarray, right: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scores in order, and the probability of being right at each by pooling of adjacent violators. right: how many of the n
    of a score."""
    turn = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for y, m in zip(right[turn], np.ones(len(turn)) if n is None else n[turn]):
        pools.append([float(y), float(m), 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            y, m, k = pools.pop()
            pools[-1][0] += y
            pools[-1][1] += m
            pools[-1][2] += k
    return score[turn], np.repeat([y / m for y, m, _ in pools], [k for _, _, k in pools])


class Chooser:
    """The trees and the threshold of each kind; an endless one adds nothing."""

    def __init__(self, trees: Trees | None = None, least: tuple[float, ...] = (np.inf,) * 4):
        self.trees, self.least = trees, least

    def scores(self, kind, before, span, after) -> np.ndarray:
        if self.trees is None or not len(kind):
            return np.full(len(kind), -np.inf)
        return self.trees.score(np.array([described(*row) for row in zip(kind, before, span, after)]))


PROPOSALS = "doc_id long, base array<int>, base_start array<long>, base_end array<long>, kind array<int>, start array<long>, end array<long>, before array<string>, span array<string>, after array<string>, known array<int>"


def _propose(batches):
    kinds = [pa.int64(), *[pa.list_(t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32())]]
    names = [c.split()[0] for c in PROPOSALS.split(", ")]
    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            rows = []
            for i, text in zip(b.column("doc_id").slice(lo, 1000).to_pylist(), b.column("text").slice(lo, 1000).to_pylist()):
                kept, dropped = base(text) if text else ([], [])
                spans = proposed(text) if text else []
                right = set(kept)
                near = _touching(spans, dropped)
                known = [1 if s in right else -1 if t else 0 for s, t in zip(spans, near)]
                cols = [list(c) for c in zip(*spans)] or [[], [], []]
                rows.append((i, *([list(c) for c in zip(*kept)] or [[], [], []]), *cols, [text[max(0, s - AROUND) : s] for _, s, _ in spans], [text[s:e] for _, s, e in spans], [text[e : e + AROUND] for _, _, e in spans], known))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _touching(spans, dropped) -> list[bool]:
    """Whether each span lies over a dropped match of its kind without being that match, whose check says it is wrong."""
    out = []
    for kind in range(4):
        gone = [(s, e) for k, s, e in dropped if k == kind]
        starts, ends = np.array([s for s, _ in gone]), np.array([e for _, e in gone])
        own = [(n, s, e) for n, (k, s, e) in enumerate(spans) if k == kind]
        if gone and own:
            at = np.searchsorted(starts, [e for _, _, e in own], "left") - 1  # the last that begins before the span ends
            out += [n for (n, s, e), k in zip(own, at) if k >= 0 and ends[k] > s and (s, e) != (starts[k], ends[k])]
    found = set(out)
    return [n in found for n in range(len(spans))]


def proposals(docs: DataFrame) -> DataFrame:
    """Base spans and proposals of each document, in lists."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_propose, PROPOSALS)


TAUGHT = "seen boolean, x array<int>, y long"


def _taught(batches):
    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            seen, x, y = [], [], []
            for kind, before, span, after, known, own in zip(*b.slice(lo, 1000).to_pydict().values()):
                for *row, right in lessons(kind, before, span, after) if known else [(kind, before, span, after, False)]:
                    seen.append(own)
                    x.append([int(v) for v in described(*row)])
                    y.append(int(right))
            yield pa.record_batch([pa.array(seen, pa.bool_()), pa.array(x, pa.list_(pa.int32())), pa.array(y, pa.int64())], names=["seen", "x", "y"])


def taught(table: DataFrame) -> DataFrame:
    """A written table (seen, x, y, n) of the lessons of all proposals: of those of equal features x how many there are and how
    many are right. A proposal with its context counts once; a third of them, by hash, is not seen by the trees."""
    cols = ("kind", "before", "span", "after", "known")
    each = table.where("size(kind) > 0").select(F.explode(F.arrays_zip(*cols)).alias("p")).select("p.*").where("known >= 0").distinct()
    rows = each.withColumn("seen", F.pmod(F.xxhash64("kind", "before", "span", "after"), F.lit(3)) != 0).mapInArrow(_taught, TAUGHT)
    return tk.written(rows.groupBy("seen", "x").agg(F.sum("y").alias("y"), F.count("*").alias("n")), "lessons")


def _rows(batch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, width)


def _grow(edges: list[np.ndarray]):
    def run(batches):
        parts = [(_rows(b, len(edges)), np.asarray(b.column("y")), np.asarray(b.column("n"))) for b in batches]
        x, y, n = (np.concatenate(c) for c in zip((np.zeros((0, len(edges)), np.int32), np.zeros(0, int), np.zeros(0, int)), *parts))
        ring = spread.Ring(BarrierTaskContext.get())
        trees = Trees().fit(x, y, n, edges, lambda a: sum(part for part, in ring.gather(a)))
        ring.close()
        if ring.rank == 0:
            cols = [[trees.start], *([a.ravel().tolist()] for a in (trees.feature, trees.cut, trees.leaf))]
            kinds = (pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["start", "feature", "cut", "leaf"])

    return run


def grown(rows: DataFrame, edges: list[np.ndarray], tasks: int) -> Trees:
    """Trees of all rows (x, y, n). All tasks must have a core at the same time."""
    dealt = rows.select("x", "y", "n").repartition(tasks)  # any rows on any task
    got = dealt.mapInArrow(_grow(edges), "start double, feature array<int>, cut array<double>, leaf array<double>", barrier=True).collect()
    trees = Trees()
    trees.start, trees.feature, trees.cut, trees.leaf = got[0].start, *(np.array(got[0][c]).reshape(-1, k) for c, k in (("feature", 7), ("cut", 7), ("leaf", 8)))
    return trees


def _scored(trees: Trees, width: int):
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 10_000):
                part = b.slice(lo, 10_000)
                x = _rows(part, width)
                yield pa.record_batch([pa.array(x[:, :4].argmax(1), pa.int32()), tk.i64(np.floor(trees.score(x) * 1000)), part.column("y"), part.column("n")], names=["kind", "score", "y", "n"])

    return run


def learn(table: DataFrame) -> Chooser:
    """Trees and thresholds from the proposals of all documents; a third sets the thresholds."""
    spark, rows = table.sparkSession, taught(table)
    sizes = {r.seen: r for r in rows.groupBy("seen").agg(F.count("*").alias("rows"), F.sum("y").alias("y"), F.sum("n").alias("n")).collect()}
    if len(sizes) < 2 or not 0 < sizes[True].y < sizes[True].n:
        return Chooser()
    held = rows.where("seen").select("n", F.posexplode("x").alias("f", "v")).groupBy("f", "v").agg(F.sum("n").alias("n")).toPandas()  # features have few values each
    edges = [Trees().edges(one["v"].to_numpy(), one["n"].to_numpy()) for _, one in held.groupby("f")]
    tasks = min(spark.sparkContext.defaultParallelism, math.ceil(sizes[True].rows / ROWS))
    trees = grown(rows.where("seen"), edges, tasks)
    counts = rows.where("not seen").mapInArrow(_scored(trees, len(edges)), "kind int, score long, y long, n long").groupBy("kind", "score").agg(F.sum("y").alias("y"), F.sum("n").alias("n")).toPandas()
    least = []
    for kind in range(4):
        one = counts[counts["kind"] == kind]
        both = 0 < one["y"].sum() < one["n"].sum()
        s, p = monotone(*(one[c].to_numpy() for c in ("score", "y", "n"))) if both else (np.zeros(0), np.zeros(0))
        sure = np.flatnonzero(p >= SURE)
        least.append(float(s[sure[0]] / 1000) if len(sure) else np.inf)
    return Chooser(trees, tuple(least))


def chosen(kept: list[tuple[int, int, int]], spans: list[tuple[int, int, int]], scores: np.ndarray, least: tuple[float, ...]) -> list[tuple[int, int, int]]:
    """The spans to add: above their threshold, apart from the kept ones and from one another, the highest scores first."""
    taken = sorted((s, e) for _, s, e in kept)
    merged: list[list[int]] = []
    for s, e in taken:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    ends = [e for _, e in merged]
    able = sorted((-scores[k], s, -e, kind) for k, (kind, s, e) in enumerate(spans) if scores[k] >= least[kind])
    out = []
    for _, s, e, kind in able:
        at = bisect.bisect_right(ends, s)
        if at == len(merged) or merged[at][0] >= -e:
            merged.insert(at, [s, -e])
            ends.insert(at, -e)
            out.append((kind, s, -e))
    return out


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def found(table: DataFrame, chooser: Chooser) -> DataFrame:
    """doc_id, base spans counted by kind, their digest, and all spans as `kind:start:end`, of each document."""

    def choose(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                cols = b.slice(lo, 1000).to_pydict()
                sizes = [len(k) for k in cols["kind"]]
                flat = [[v for row in cols[c] for v in row] for c in ("kind", "before", "span", "after")]
                scores, at, rows = chooser.scores(*flat), 0, []
                for k, n in enumerate(sizes):
                    kept = list(zip(cols["base"][k], cols["base_start"][k], cols["base_end"][k]))
                    more = chosen(kept, list(zip(cols["kind"][k], cols["start"][k], cols["end"][k])), scores[at : at + n], chooser.least) if n else []
                    at += n
                    rows.append((cols["doc_id"][k], *[sum(x[0] == kind for x in kept) for kind in range(4)], hashlib.sha256(listed(kept).encode()).hexdigest(), listed(kept + more)))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in RESULT.split(", ")])

    return table.mapInArrow(choose, RESULT)


def report(docs: DataFrame) -> DataFrame:
    """What found returns, by trees learnt from the documents themselves."""
    table = tk.written(proposals(docs), "proposals")
    return found(table, learn(table))


def redacted(text: str, spans: str) -> str:
    """The text with `[kind]` in place of every listed span; of overlapping ones the first and its rest are one."""
    out, at = [], 0
    for s, e, kind in sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x)):
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join(out) + text[at:]
