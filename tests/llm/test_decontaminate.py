import random
import re

import numpy as np
import pytest

from tessera.llm import decontaminate as dc


def words(t):
    return re.findall(r"[a-z0-9]+", (t or "").lower())


def brute(text, item):
    w, it = words(text), words(item)
    if len(it) < dc.SHORT:
        return 0
    if len(it) <= dc.LEAST:
        most = max((sum(0 <= s + k < len(w) and w[s + k] == x for k, x in enumerate(it)) for s in range(-len(it) + 1, len(w))), default=0)
        return len(it) * (most >= 0.8 * len(it) - 1e-9)
    best = 0
    for s in range(-len(it) + 1, len(w)):
        same = [0 <= s + k < len(w) and w[s + k] == it[k] for k in range(len(it))]
        for i in range(len(it)):
            for j in range(i + 1, len(it) + 1):
                part = same[i:j]
                if same[i] and same[j - 1] and sum(part) >= 0.8 * (j - i) - 1e-9:
                    best = max(best, j - i)
    return best if best >= dc.LEAST else 0


def test_stretch():
    r = np.random.default_rng(1)
    for _ in range(200):
        same = r.random(r.integers(1, 30)) < 0.7
        lo, hi = dc.stretch(same)
        best = max([j - i for i in range(len(same)) for j in range(i + 1, len(same) + 1) if same[i] and same[j - 1] and same[i:j].mean() >= 0.8 - 1e-9], default=0)
        assert hi - lo == best


@pytest.mark.parametrize("block", [1_000_000, 60])
def test_report(spark, block):
    r = random.Random(4)
    say = lambda n: " ".join(r.choice("abcdefgh") + str(r.randrange(90)) for _ in range(n))
    items = [(k, say(r.randrange(16, 45))) for k in range(8)] + [(20, "red green blue grey black pink"), (21, "too short to"), (22, None), (23, ""), (2, "again " + say(20))]
    docs = [(100, None), (101, ""), (102, say(300)), (103, "RED green, blue grey black pink!"), (104, "red green blue grey white pink"), (105, "red green")]
    for k in range(8):
        w = words(items[k][1])
        for sub in (0, 1, 2):
            part = w[: r.randrange(14, len(w) + 1)]
            for s in range(sub):
                part[2 + 5 * s] = "changed"
            docs.append((200 + 10 * k + sub, say(30) + " " + " ".join(part).upper() + ". " + say(20)))
        docs.append((200 + 10 * k + 5, say(10) + " " + " ".join(w[:9]) + " " + say(10)))
    docs += [docs[-4], (None, items[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hits", dc.F.lit(1)).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", dc.F.lit(2))
    got = dc.report(df, bench, block=block).collect()
    assert len(got) == len(docs)
    want = []
    for d, t in docs:
        each = {}
        for k, i in items:
            if n := brute(t, i):
                each[k] = max(n, each.get(k, 0))
        top = max(each.values(), default=0)
        want.append((d, bool(each), len(each), top, min((k for k, n in each.items() if n == top), default=None)))
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(x[1] for x in want) > 20
    kept = dc.stage(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(not x[1] for x in want)
    assert dc.report(df, bench.limit(0)).where("contaminated").count() == 0 and dc.report(df.limit(0), bench).count() == 0


def test_long_items_and_repeated_words(spark):
    long = [f"w{k}" for k in range(5000)]
    items = [(1, " ".join(long)), (2, "a " * 3000), (3, "one two three four five")]
    docs = [(1, "x y " + " ".join(long) + " z"), (2, "a " * 20000), (3, "One, two; FOUR three four five. two"), (4, " ".join(long[100:112])), (5, " ".join(long[4000:]))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {1: (1, 5000), 2: (2, 3000), 3: (None, 0), 4: (None, 0), 5: (1, 1000)}
    for block in (1_000_000, 10):
        assert {r.doc_id: (r.item_id, r.n_words) for r in dc.report(df, bench, block=block).collect()} == want
