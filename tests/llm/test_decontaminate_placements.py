import itertools
import math
import random

import numpy as np
from test_decontaminate import brute, words

from tessera.llm import decontaminate as dc


def test_every_placement_keeps_enough_seeds():
    """Of any item of SHORT words or more with up to a fifth of its words changed, wherever they are."""
    for n in range(dc.SHORT, 25):
        for c in range(n // 5 + 1):
            at = np.array(list(itertools.combinations(range(n), c)), int).reshape(math.comb(n, c), c)
            same = np.ones((len(at), n), bool)
            same[np.arange(len(at))[:, None], at] = False
            kept = sum(np.all([same[:, p : n - 3 + p] for p in mask], 0).sum(1) for mask in dc.MASKS)
            assert kept.min() >= dc.needed(n), (n, c)


def test_changes_of_a_fifth_are_found(spark):
    r = random.Random(7)
    say = lambda n: [r.choice("abcdefgh") + str(r.randrange(900)) for _ in range(n)]
    items = [(k, " ".join(say(n))) for k, n in enumerate((5, 6, 7, 9, 10, 11, 12, 13, 14, 15, 16, 17, 20, 25, 41, 59))]
    docs = []
    for k, t in items:
        w = words(t)
        for m in range(12):
            inner = range(1, len(w) - 1) if len(w) > dc.LEAST else range(len(w))  # a short item's edges may change as well
            changed = range(4, len(w) - 1, 5) if m == 0 else r.sample(inner, len(w) // 5 + (m == 11))
            part = ["changed" if i in changed else x for i, x in enumerate(w)]
            docs.append((20 * k + m, " ".join(say(9) + part + say(9))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: (x.n_items, x.n_words) for x in dc.report(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    for d, t in docs:
        each = [n for _, i in items if (n := brute(t, i))]
        assert got[d] == (len(each), max(each, default=0)), d
    assert all(got[20 * k + m][0] for k in range(len(items)) for m in range(11))
