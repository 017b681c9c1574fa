import hashlib
import random

import numpy as np
import pytest

from tessera.llm import suffix_dedup as sd


def brute(texts, length):
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))) == 1)
        out.append((len(t), int(gone.sum()), len(edge), hashlib.sha256(kept).hexdigest()))
    return out


def some_texts(seed, alphabet):
    r = random.Random(seed)
    say = lambda n: bytes(r.choice(alphabet) for _ in range(n))
    shared = [say(n) for n in (150, 230, 260, 420, 700)]
    texts = [b"", b"x", say(199), say(200), b"a" * 900, b"ab" * 300]
    for _ in range(40):
        t = b"".join(r.choice(shared)[r.randrange(60) :] if r.random() < 0.5 else say(r.randrange(1, 120)) for _ in range(r.randrange(1, 8)))
        texts.append(t)
        if r.random() < 0.3:
            texts.append(t if r.random() < 0.5 else t[:100] + b"#" + t[101:])
    return texts


@pytest.mark.parametrize("alphabet", [b"ab", b"abcdefghij klmnop"])
def test_covered_matches_brute_force(alphabet):
    texts = some_texts(3, alphabet)
    body, offs = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    string, lo, hi = sd.covered(body, offs, 200)
    gone = [np.zeros(len(t), bool) for t in texts]
    for s, a, b in zip(string, lo, hi):
        gone[s][a:b] = True
    assert [int(g.sum()) for g in gone] == [x[1] for x in brute(texts, 200)]


def test_maximal_repeats_against_brute_force():
    r = random.Random(5)
    texts = [bytes(r.choice(b"abc") for _ in range(r.randrange(5, 60))) for _ in range(6)]
    got = {s: at for s, at in sd.repeats(texts, 3)}
    want = {}
    for k, t in enumerate(texts):
        for i in range(len(t)):
            for j in range(i + 3, len(t) + 1):
                want.setdefault(t[i:j], []).append((k, i))
    maximal = {}
    for s, at in want.items():
        before = {texts[k][i - 1] if i else (k, i) for k, i in at}
        after = {texts[k][i + len(s)] if i + len(s) < len(texts[k]) else (k, i) for k, i in at}
        if len(at) > 1 and len(before) > 1 and len(after) > 1:
            maximal[s] = sorted(at)
    assert got == maximal


@pytest.mark.parametrize("hot", [1, 3, 1024])
def test_dedup(spark, hot, monkeypatch):
    rounds, scanned = [], sd.scanned
    monkeypatch.setattr(sd, "scanned", lambda groups, *a: rounds.append(groups.isEmpty()) or scanned(groups, *a))
    texts = some_texts(7, b"abcdefgh ")
    rows = [(i, t.decode()) for i, t in enumerate(texts)] + [(900, None), (901, "é" * 300), (902, "x" + "é" * 300), (5, texts[5].decode())]
    got = sd.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = brute([(t or "").encode() for _, t in rows], 200)
    assert sorted(map(tuple, got)) == sorted((i, *w) for (i, _), w in zip(rows, want))
    assert hot > 3 or len(rounds) > 1 and (hot == 1 or not all(rounds[1:]))  # large groups, too, end in the tree


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, h long, spans string")
    assert sd.dedup(empty).count() == 0
    rows = [(1, "ab" * 150, "q", 3), (2, "cd" + "ab" * 149, "w", 4), (None, "zz", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tx string, n long")
    out = {r.doc_id: r for r in sd.stage(docs).collect()}
    assert out[None].text == "zz" and out[1].tx == "q" and out[1].text == "" and out[2].text == "cd"
