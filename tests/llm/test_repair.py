import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from tessera.llm import queries, repair

GIVEN = re.compile(r"(s?(ua)+)?\Z")
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(turns):
    """Cost, audit and repaired turns, by trying every edit at every turn."""
    n = len(turns)

    @cache
    def best(k, state, added):
        found = [] if k < n or state in "su" and state else [(0, "", ())]
        if added < 3:
            for role in "ua":
                if (state, role) in NEXT:
                    c, a, t = best(k, NEXT[state, role], added + 1)
                    found.append((c + 3, "I" + a, (("user" if role == "u" else "assistant", ""), *t)))
        if k < n:
            role, text, fault = turns[k]
            c, a, t = best(k + 1, state, 0)
            found.append((c + 4, "D" + a, t))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                for name, cost, letter in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                    if (state, name[:1]) in NEXT:
                        c, a, t = best(k + 1, NEXT[state, name[:1]], 0)
                        found.append((c + cost + more, letter + a, ((name, text), *t)))
        return min(found, key=lambda x: x[:2], default=(10**9, "", ()))

    for k in range(n, 0, -1):  # from the end, so that the recursion stays shallow
        for state in ("", "s", "u", "a"):
            best(k, state, 0)
    return best(0, "", 0)


def brute(rows, ids):
    by, out = {}, {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv in ids:
        turns = sorted(by.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        met, judged, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in turns:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in met else "" if solid[-1] in ".!?" else "truncated"
            met.add((role, text))
            judged.append((role, text, fault))
            if fault:
                count[fault] += 1
        at = [t for t, _, _ in turns if t is not None]
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        ill = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, said = cheapest(judged)
        assert GIVEN.match("".join(r[:1] for r, _ in said))
        out[conv] = (gaps, *count.values(), ill, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest())
    return out


def told(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def chats(seed, convs, most):
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "no", "", "  \t", "What?", "Go!\n", "é.", "cut off,", None, "Yes. "]
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            rows.append((c, rng.choice([t, t, t, t + 3, None]), rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "U"]), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."))
    return rows


@pytest.mark.parametrize("bits", [9, 1])
def test_against_every_edit(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "STRIP", bits)
    rows = chats(bits, 150, 9)
    rows += [(None, 1, "user", "a."), (None, None, "user", "a."), *[(500, 3, "user", "same.")] * 7, *[(501, k, ("user", "assistant")[k % 2], f"t {k}.") for k in range(60)], *[(502, k, "user", "again.") for k in range(40)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("cost", repair.F.lit("x")).repartition(3)
    ids = {r[0] for r in rows} | {900}
    got = told(repair.report(spark.createDataFrame([(i,) for i in ids], "conv_id long"), df))
    assert got == brute(rows, ids)
    want = {c: sum(1 for r in rows if r[0] == c) for c in ids}
    kept = repair.repaired(df).groupBy("conv_id").count().collect()
    assert all(r["count"] <= 3 * want[r.conv_id] for r in kept)


def test_long_conversation_is_split(spark):
    rows = [(1, k, ("user", "assistant", "tool")[zlib.crc32(b"%d" % k) % 3], f"t {k}" + "." * (k % 4 > 0)) for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert repair.strips(repair.ordered(df)).count() >= 6
    got = told(repair.report(df, df))
    assert got == brute(rows, [1])


def test_empty_tables(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.report(df, repair.damaged(df)).count() == 0 and repair.repaired(df).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows, out = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()], []
    for conv, turn, role, text in rows:
        how = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        row = (conv, turn, "user" if how == 4 else role, "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text)
        out += [row] * (0 if how == 0 else 2 if how == 3 else 1)
    got = queries.QUERIES["op11_conversation_repair"](spark, sf)
    assert got.columns == "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    assert told(got) == brute(out, {r[0] for r in rows})
