import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import near_dup as nd


def bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def pack(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64)


def test_signature_estimates_weighted_jaccard():
    r = random.Random(2)
    for heavy in (1, 3, 9):
        pool = [(f"s{i}", r.randrange(1, heavy + 1)) for i in range(150)]
        a = dict(pool[:110])
        b = {k: max(1, n + r.choice([-1, 0, 2])) for k, n in pool[40:]}
        want = sum(min(a.get(k, 0), b.get(k, 0)) for k in {*a, *b}) / sum(max(a.get(k, 0), b.get(k, 0)) for k in {*a, *b})
        h = lambda d: nd.tk.mix(np.array([int(k[1:]) for k in d], np.uint64) + np.uint64(77))
        own = np.repeat([0, 1], [len(a), len(b)])
        sig = nd.signatures(own, np.concatenate((h(a), h(b))), np.array([*a.values(), *b.values()]), 2, 4000)
        assert np.isfinite(sig).all()
        assert abs((sig[0] == sig[1]).mean() - want) < 0.035


def family(r, base, n, change):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(change):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [2048, 7])
def test_classes_against_brute_force(spark, block):
    r = random.Random(8)
    say = lambda n: " ".join(r.choice("abcdefghij") + str(r.randrange(50)) for _ in range(n))
    texts = [None, "", "  ", "one two", "One TWO", "one", "a b c d e", "a b c d e", "a b c d f"]
    passage = say(60)
    for k in range(12):
        texts += family(r, say(150), 6, 1 + k // 2)
        texts.append(say(50) + " " + passage + " " + say(40))
    base = say(200)
    texts += [base] * 20 + family(r, base, 25, 3) + [("tick tock " * 40).strip(), ("tick tock " * 45).strip(), ("tick tock " * 70).strip()]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(40, texts[40], 1), (None, base, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(4)
    got = nd.classes(docs, block=block).collect()
    assert len(got) == len(rows)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [bag(t) for _, t, _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and (jaccard(bags[i], bags[j]) >= 0.8 or (rows[i][1].lower().split() == rows[j][1].lower().split())):
                parent[find(i)] = find(j)
    want = {}
    for i in range(len(rows)):
        want.setdefault(find(i), []).append(rows[i][0])
    want = sorted((d, min(x for x in m if x is not None)) for m in want.values() for d in m if d is not None)
    assert sorted((g.doc_id, g.class_id) for g in got if g.doc_id is not None) == want
    kept = nd.stage(docs)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == sorted({c for _, c in want})
    assert nd.classes(docs.limit(0)).count() == 0


def test_swapped_words_are_no_copies(spark):
    """Every second word swapped in a pattern that a polynomial hash modulo 2**64 cannot tell from the original."""
    turn = [bin(i).count("1") % 2 for i in range(2048)]
    a = " ".join(f"{'yes' if t else 'no'} w" for t in turn)
    b = " ".join(f"{'no' if t else 'yes'} w" for t in turn)
    rows = [(1, " ".join(f"x{i} {w}" for i, w in enumerate(t.split()))) for t in (a, b)]
    rows = [(1, rows[0][1]), (2, rows[1][1]), (3, a), (4, b), (5, "  " + a.upper().replace(" ", "\t"))]
    want = {1: 1, 2: 2, 3: 3, 4: 3 if jaccard(bag(a), bag(b)) >= 0.8 else 4, 5: 3}
    got = nd.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {g.doc_id: g.class_id for g in got} == want
    assert len({nd.same_words(x.encode()) for x in (a, b)}) == 2
