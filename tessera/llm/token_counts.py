"""Token counts by a linear longest-match automaton.

The vocabulary forms a trie over bytes; pieces that begin with a space start a word, others go on in it. Every node has
a failure link: when no further byte fits, the longest piece and those that must follow are popped, in a number known
beforehand, and the link leads to the node that holds what is left. So each byte is read once, and greedy longest-match
lengths come without building a piece. All words of a batch run through the automaton side by side, byte by byte; what is
left of the few words longer than LONG bytes runs through it alone.

A word is a run of bytes without ASCII white space, with one space before it. Defined cases: null and empty texts have
no tokens; bytes that no piece starts with count as one token each; words and texts may be of any length; repeated rows are
counted alike; an empty table has no counts; columns other than doc_id and text are not read, whatever their names.
"""

import base64
import hashlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit as tk

LONG = 2048


class Automaton:
    """Trie as a table of edges, with failure links and popped counts.

    State 0 is the start of a word, state 1 the place within a word between two pieces.
    """

    def __init__(self, pieces: list[bytes]):
        first = [p for p in pieces if p[:1] == b" " and len(p) > 1]
        inner = {p for p in pieces if p and b" " not in p} | {bytes([b]) for b in range(256)}
        kids: list[dict[int, int]] = [{}, {}]
        whole = [False, False]

        def add(root: int, piece: bytes) -> None:
            at = root
            for b in piece:
                nxt = kids[at].get(b)
                if nxt is None:
                    nxt = kids[at][b] = len(kids)
                    kids.append({})
                    whole.append(False)
                at = nxt
            whole[at] = True

        add(0, b" ")
        for p in first:
            add(0, p)
        for p in sorted(inner):
            add(1, p)
        n = len(kids)
        fail, pops = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        for root in (1, 0):  # links of the first trie lead into the second, so that is done before
            todo = [root]
            while todo:
                later = []
                for at in todo:
                    for b, to in kids[at].items():
                        if whole[to]:
                            fail[to], pops[to] = 1, 1
                        else:
                            z, count = fail[at], pops[at]
                            while z >= 0 and b not in kids[z]:
                                z, count = fail[z], count + pops[z]
                            if z >= 0:
                                fail[to], pops[to] = kids[z][b], count
                        later.append(to)
                todo = later
        self.fail, self.pops = fail.astype(np.int32), pops.astype(np.int32)
        self._arrays(kids)
        self.rest = np.zeros(n, np.int32)  # tokens of what a node holds when the word ends
        for at in self._by_depth(kids):
            total, z = 0, at
            while z > 1:
                total += int(self.pops[z])
                z = int(self.fail[z])
            self.rest[at] = total

    @staticmethod
    def _by_depth(kids):
        todo = [0, 1]
        while todo:
            yield from todo
            todo = [to for at in todo for to in kids[at].values()]

    def _arrays(self, kids) -> None:
        """Edges of the states that have any, one row of 256 targets each; row 0 is empty and serves all leaves."""
        inner = [s for s in range(len(kids)) if kids[s]]
        self.row = np.zeros(len(kids), np.int32)
        self.row[inner] = np.arange(1, len(inner) + 1)
        self.to = np.full((len(inner) + 1, 256), -1, np.int32)
        for k, s in enumerate(inner, 1):
            self.to[k, list(kids[s])] = list(kids[s].values())

    def alone(self, data: bytes, total: int, state: int) -> tuple[int, int]:
        """Tokens popped and the state after more bytes of one word."""
        rows: dict[int, tuple[list[int], int, int]] = {}
        for c in data:
            while True:
                if state not in rows:
                    rows[state] = self.to[self.row[state]].tolist(), int(self.pops[state]), int(self.fail[state])
                to, pops, fail = rows[state]
                if to[c] >= 0:
                    state = to[c]
                    break
                total, state = total + pops, fail
        return total, state

    def count(self, body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each word body[start:end], a space before it."""
        words = len(start)
        total = np.zeros(words, np.int32)
        state = np.full(words, self.to[self.row[0], 32], np.int32)
        by = np.argsort(start - end, kind="stable")  # longest first, so that those still running stand together
        size = (end - start)[by]
        start = start[by]
        live, k = words, 0
        while live:
            live = int(np.searchsorted(-size, -k, "left"))
            if not live:
                break
            if k >= LONG:
                for w in range(live):
                    total[w], state[w] = self.alone(body[start[w] + k : start[w] + size[w]].tobytes(), int(total[w]), int(state[w]))
                break
            c = body[start[:live] + k].astype(np.int32)
            s = state[:live]
            s_next = self.to[self.row[s], c]
            bad = np.flatnonzero(s_next < 0)
            while len(bad):
                z = s[bad]
                total[bad] += self.pops[z]
                z = self.fail[z]
                s[bad] = z
                s_next[bad] = self.to[self.row[z], c[bad]]
                bad = bad[s_next[bad] < 0]
            state[:live] = s_next
            k += 1
        out = np.empty(words, np.int64)
        out[by] = total + self.rest[state]
        return out


_automata: dict[str, Automaton] = {}


def automaton(vocabulary: bytes) -> Automaton:
    """Of lines of base64 pieces and ranks; one for each Python worker."""
    key = hashlib.sha256(vocabulary).hexdigest()
    if key not in _automata:
        _automata[key] = Automaton([base64.b64decode(line.split()[0]) for line in vocabulary.splitlines() if line.strip()])
    return _automata[key]


def _count(vocabulary):
    def run(batches):
        auto = automaton(vocabulary.value)
        for b in batches:
            tokens, many = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for lo, hi, body, offs in tk.slices(b.column("text")):
                start, end, row = tk.words(body, offs)
                n = auto.count(body, start, end)
                tokens[lo:hi] = np.bincount(row, weights=n, minlength=hi - lo)
                many[lo:hi] = np.bincount(row, minlength=hi - lo)
            yield pa.record_batch([b.column("doc_id"), pa.array(many), pa.array(tokens)], names=["doc_id", "n_words", "n_tokens"])

    return run


def counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every row of docs. vocabulary: a file that the driver reads and sends to the workers."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    pieces = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())  # as large as the vocabulary
    return rows.mapInArrow(_count(pieces), "doc_id long, n_words long, n_tokens long")
