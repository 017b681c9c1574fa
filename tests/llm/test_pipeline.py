import corpus_pipeline as cp
from test_near_dup import bag, jaccard

DIR = "/root/testdata/sf0.001"


def removed(texts, length):
    """The texts without what a string of `length` bytes covers that also starts elsewhere."""
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        yield bytes(c for c, g in zip(t, gone) if not g)


def test_stages_against_brute_force(spark):
    docs = cp.table(spark, DIR, "documents")
    labels, marks = cp.table(spark, DIR, "labels"), cp.table(spark, DIR, "benchmark")
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    stages, columns = dict(cp.STAGES), docs.columns

    before, now = rows(docs), cp.storage.written(stages["quality"](spark, docs, DIR), "t")
    kept = rows(now)
    assert now.columns == columns and 0 < len(kept) < len(before) and all(before[k] == v for k, v in kept.items())
    known = {r.doc_id: r.quality for r in labels.collect()}
    right = [(k in kept) == (q == 1) for k, q in known.items() if k in before]
    assert sum(right) >= 0.8 * len(right)

    before, now = kept, cp.storage.written(stages["near_dup"](spark, now, DIR), "t")
    kept, bags = rows(now), {k: bag(r.text) for k, r in before.items()}
    assert now.columns == columns and all(before[k] == v for k, v in kept.items())
    group = {k: k for k in before}

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in before:
        for b in before:
            if a < b and bags[a] and bags[b] and jaccard(bags[a], bags[b]) >= 0.8:
                x, y = sorted((top(a), top(b)))
                group[y] = x
    assert set(kept) == {top(k) for k in before}

    before, now = kept, cp.storage.written(stages["suffix_dedup"](spark, now, DIR), "t")
    kept, ids = rows(now), sorted(before)
    assert now.columns == columns and set(kept) == set(ids)
    for k, want in zip(ids, removed([(before[k].text or "").encode() for k in ids], 200)):
        assert (kept[k].text or "") == want.decode("utf-8", "ignore")

    before, now = kept, cp.storage.written(stages["decontaminate"](spark, now, DIR), "t")
    kept = rows(now)
    assert now.columns == columns and all(before[k] == v for k, v in kept.items())
    grams = {tuple(w[i : i + 13]) for r in marks.collect() for w in [(r.text or "").lower().split()] for i in range(len(w) - 12)}
    for k, r in kept.items():
        w = (r.text or "").lower().split()
        assert not any(tuple(w[i : i + 13]) in grams for i in range(len(w) - 12)), k

    out = stages["packing"](spark, now, DIR).collect()
    assert {r.doc_id for r in out} == set(kept)
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for at in places.values():
        end = 0
        for lo, n in sorted(at):
            assert lo == end
            end += n
        assert end <= 2048
