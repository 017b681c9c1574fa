"""Repair of conversation structure: the cheapest edits that make roles follow `(s?(ua)+)?`.

Turns are put in order and each becomes one small code: the initial of its role and its first fault. Codes are grouped in
strips of at most 512 turns. Strips of equal length form one time-major tensor: going back over the turns, the costs of
the four states of all strips are updated at once and kept, and edits are traced forward from the kept costs, again for
all strips at once. A conversation of more than one strip is split: each strip first gives the costs from every state at
its start to every state at its end, these small matrices are chained back and forth, and each strip is then traced on
its own. So the longest conversation sends one row for 512 turns to a task, which reads them as a stream.

Edits: K keeps a turn, R gives it the role user or assistant (3), D deletes it (4; the only edit of blank and duplicate
turns), I inserts an empty turn of user or assistant (3). A truncated turn that is not deleted costs 3 more.

Defined cases: a null role or text counts as one space. Turns are ordered by turn, null first, then role and text; equal
turns are counted as one with copies, of which all but the first are duplicates. An initial other than s, u or a (case
matters; an empty role has none) can't be kept. Rows of a null conv_id form one conversation. Other columns take no part.
Equality of texts that makes duplicates is that of their SHA-256.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit as tk
from tessera.operators import order

STRIP = 9  # bits of a place within a strip
BLANKS = " \t\n\x0b\x0c\r"
INITIALS = "sua"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
DELETE, REROLE, INSERT, CUT = 4, 3, 3, 3

# States: nothing yet, after system, after user, after assistant. The state that keeping a turn of initial s, u, a or
# another leads to (or 4: not allowed), and the one that an inserted or renamed turn leads to.
KEPT = np.array([[1, 2, 4, 4], [4, 2, 4, 4], [4, 4, 3, 4], [4, 2, 4, 4]])
STEP = np.array([2, 2, 3, 2])
ENDED = np.array([0, 2 * INSERT, INSERT, 0])  # what is to be inserted at the end
FAR = 1 << 50  # above any cost


def damaged(chats: DataFrame) -> DataFrame:
    """The rows with faults planted by CRC-32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes its
    full stops, question and exclamation marks, 3 repeats it, 4 makes it the user's."""
    filled = [F.coalesce(tk.named(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    how = F.crc32(F.concat(filled[0], F.lit(":"), filled[1]).cast("binary")) % 20
    rows = chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled[2].alias("role"), filled[3].alias("text"), how.alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.where("how <> 0").select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("how") == 3, 2).otherwise(1))))
    return rows.drop("col")


def ordered(turns: DataFrame) -> DataFrame:
    """A written table of conv_id, turn, role, text, copies of the different turns, with their place in the order."""
    filled = [F.coalesce(tk.named(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *filled)
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    return order.placed(rows, [F.asc("conv_id"), F.asc("turn"), F.asc("role"), F.asc("text")])


def strips(rows: DataFrame) -> DataFrame:
    """conv_id, strip, first (the place of its first turn), codes and copies of the turns in order."""
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    found = F.when(body == "", BLANK).when(F.substring(body, -1, 1).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    narrow = rows.select("conv_id", "place", "copies", "role", F.sha2(F.col("text").cast("binary"), 256).alias("same"), found.alias("fault"), F.when((initial > 0) & (F.length("role") > 0), initial - 1).otherwise(3).alias("initial"))
    met = narrow.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("same").alias("s")).agg(F.min("place").alias("met"), F.count("*").alias("times")).where("times > 1")
    told = narrow.join(met, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("same") == F.col("s")), "left")
    fault = F.when(F.col("fault") == BLANK, BLANK).when(F.col("place") > F.col("met"), DUPLICATE).otherwise(F.col("fault"))
    coded = told.select("conv_id", "place", "copies", (F.col("initial") + 4 * fault).alias("code"))
    grouped = coded.groupBy("conv_id", F.shiftright("place", STRIP).alias("strip")).agg(F.sort_array(F.collect_list(F.struct("place", "code", "copies"))).alias("t"))
    return grouped.select("conv_id", "strip", F.col("t")[0]["place"].alias("first"), F.col("t.code").alias("codes"), F.col("t.copies").alias("copies"))


def costs(codes: np.ndarray, copies: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least costs from every state before every turn on: turns x lanes x 4 states, of codes and copies (turns x lanes)
    and the costs behind the last turn (lanes x 4 states)."""
    turns, lanes = codes.shape
    out = np.empty((turns + 1, lanes, 4), np.int64)
    out[turns] = end
    initial, fault = codes & 3, codes >> 2
    for t in range(turns - 1, -1, -1):
        after = np.concatenate((out[t + 1], np.full((lanes, 1), FAR)), axis=1)
        cut = np.where(fault[t] == TRUNCATED, CUT, 0)[:, None]
        stays = np.minimum(np.take_along_axis(after, KEPT[:, initial[t]].T, 1), REROLE + after[:, STEP]) + cut
        stays[(fault[t] == BLANK) | (fault[t] == DUPLICATE)] = FAR
        here = np.minimum(stays, DELETE + out[t + 1]) + (DELETE * (copies[t] - 1))[:, None]
        out[t] = np.minimum(np.minimum(here, INSERT + here[:, STEP]), 2 * INSERT + here[:, STEP[STEP]])
    return out


def traced(codes: np.ndarray, copies: np.ndarray, cost: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every turn and lane what is inserted before it and its edit, and the state behind the last turn.

    An insertion is 0 for none, or 3 * turns + 1 if it begins with an assistant; an edit is 0 to 3 for D, K, R to user, R
    to assistant. Of equally cheap edits the one with the smallest letter is taken at each turn, so the audit is least.
    """
    turns, lanes = codes.shape
    state, lane = state.copy(), np.arange(lanes)
    added, edits = np.zeros((turns, lanes), np.int64), np.zeros((turns, lanes), np.int64)
    for t in range(turns):
        rest, after = cost[t], np.concatenate((cost[t + 1], np.full((lanes, 1), FAR)), axis=1)
        more = DELETE * (copies[t] - 1)
        cut = np.where(codes[t] >> 2 == TRUNCATED, CUT, 0)
        waits = np.ones(lanes, bool)
        while waits.any():
            left = rest[lane, state]
            gone = waits & (left == DELETE + more + after[lane, state])
            waits &= ~gone
            into = waits & (left == INSERT + rest[lane, STEP[state]])
            added[t] += np.where(into, 3 + (added[t] == 0) * (state == 2), 0)
            kept = KEPT[state, codes[t] & 3]
            keep = waits & ~into & (left == cut + more + after[lane, kept])
            named = waits & ~into & ~keep
            edits[t] += keep + named * (2 + (STEP[state] == 3))
            state = np.where(keep, kept, np.where(into | named, STEP[state], state))
            waits = into
    return added, edits, state


def buckets(codes: list[np.ndarray]):
    """Rows of equal length, at most 4,096 at once."""
    size = np.array([len(c) for c in codes], np.int64)
    turn = np.argsort(size, kind="stable")
    for lo, hi in zip(*tk.runs(size[turn])):
        for a in range(lo, hi, 4096):
            yield turn[a : min(a + 4096, hi)]


def _arrays(batch, name: str) -> list[np.ndarray]:
    column = batch.column(name)
    cut = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.int64)
    return [flat[a:b] for a, b in zip(cut[:-1], cut[1:])]


def _stacked(parts: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    return np.stack([parts[k] for k in rows], axis=1)


def _lists(rows: np.ndarray) -> pa.Array:
    return tk.lists(np.full(len(rows), rows.shape[1]), tk.i64(rows.ravel()))


def _spans(batches):
    """The costs from each state before a strip to each behind it, and its counts."""
    for b in batches:
        codes, copies, n = _arrays(b, "codes"), _arrays(b, "copies"), b.num_rows
        way, counts = np.empty((n, 16), np.int64), np.empty((n, 6), np.int64)
        for rows in buckets(codes):
            c, k = _stacked(codes, rows), _stacked(copies, rows)
            for s in range(4):
                way[rows, s::4] = costs(c, k, np.where(np.arange(4) == s, 0, FAR)[None].repeat(len(rows), 0))[0]
            initial, fault = c & 3, c >> 2
            pair = lambda a, b: (a == 3) | (b == 3) | (a == b) | (b == 0) | ((a == 0) & (b != 1))
            ill = pair(initial[:-1], initial[1:]).sum(0) + (k - 1).sum(0)
            blank = np.where(fault == BLANK, k, 0).sum(0)
            twice = np.where(fault == BLANK, 0, k - 1 + (fault == DUPLICATE)).sum(0)
            counts[rows] = np.stack((blank, twice, (fault == TRUNCATED).sum(0), ill, initial[0], initial[-1]), 1)
        out = {"way": _lists(way), **{c: tk.i64(counts[:, k]) for k, c in enumerate(("blank", "duplicate", "truncated", "illegal", "opens", "closes"))}}
        yield pa.record_batch([*b.columns, *out.values()], names=[*b.schema.names, *out])


def _behind(batches):
    """Strips from the last to the first of each conversation: the costs behind each, which state it leaves for each
    state it is entered in, and the initial that follows."""
    now, ahead, opens = (), None, 3
    for b in batches:
        conv, way, n = b.column("conv_id").to_pylist(), b.column("way").flatten().to_numpy().reshape(-1, 4, 4), b.num_rows
        end, follows, last = np.empty((n, 4), np.int64), np.full(n, -1), np.ones(n, bool)
        first = b.column("opens").to_numpy()
        for k in range(n):
            last[k] = (conv[k],) != now
            end[k] = ENDED if last[k] else ahead
            follows[k] = -1 if last[k] else opens
            now, opens = (conv[k],), first[k]
            ahead = (way[k] + end[k]).min(1)
        exits = np.zeros((n, 4), np.int64)
        inner = np.flatnonzero(~last)
        if len(inner):
            codes, copies = _arrays(b, "codes"), _arrays(b, "copies")
            for rows in buckets([codes[k] for k in inner]):
                c, m = _stacked(codes, inner[rows]), _stacked(copies, inner[rows])
                cost = costs(c, m, end[inner[rows]])
                for s in range(4):
                    exits[inner[rows], s] = traced(c, m, cost, np.full(len(rows), s))[2]
        yield pa.record_batch([*b.columns, _lists(end), _lists(exits), tk.i64(follows)], names=[*b.schema.names, "end", "exits", "follows"])


#: What an insertion and an edit write: role initials of inserted turns, then the edit; and what they add to the audit.
WRITTEN = np.array([("", "u", "ua")[a // 3] if a % 3 == 0 else ("", "a", "au")[a // 3] for a in range(8)], object)
LETTERS = np.array(["D", "K", "U", "A"], object)
AUDIT = np.array(["D", "K", "R", "R"], object)
TAILS = {0: "", INSERT: "a", 2 * INSERT: "ua"}


def _edited(batches):
    """Strips from the first to the last of each conversation: audit, cost and what becomes of every turn."""
    now, state = (), 0
    for b in batches:
        conv, exits, n = b.column("conv_id").to_pylist(), b.column("exits").flatten().to_numpy().reshape(-1, 4), b.num_rows
        codes, copies, end = _arrays(b, "codes"), _arrays(b, "copies"), b.column("end").flatten().to_numpy().reshape(-1, 4)
        enters = np.zeros(n, np.int64)
        for k in range(n):
            enters[k] = state if (conv[k],) == now else 0
            now, state = (conv[k],), exits[k, enters[k]]
        last = b.column("follows").to_numpy() < 0
        scripts, audits, paid = [None] * n, [None] * n, np.zeros(n, np.int64)
        for rows in buckets(codes):
            c, m = _stacked(codes, rows), _stacked(copies, rows)
            cost = costs(c, m, end[rows])
            added, edits, left = traced(c, m, cost, enters[rows])
            tail = np.where(last[rows], ENDED[left], 0)
            paid[rows] = cost[0][np.arange(len(rows)), enters[rows]] - np.where(last[rows], 0, end[rows][np.arange(len(rows)), left])
            script, audit = WRITTEN[added] + LETTERS[edits], np.array(["", "I", "II"], object)[added // 3] + AUDIT[edits]
            audit[m > 1] += np.array(["D" * (int(x) - 1) for x in m[m > 1]], object)
            for j, k in enumerate(rows):
                scripts[k] = script[:, j].tolist()
                scripts[k][-1] += TAILS[tail[j]]
                audits[k] = "".join(audit[:, j]) + "I" * len(TAILS[tail[j]])
        cols = [b.column("conv_id"), b.column("strip"), b.column("first"), pa.array(scripts, pa.list_(pa.string())), pa.array(audits, pa.string()), tk.i64(paid)]
        bridge = b.column("follows").to_numpy()
        a = b.column("closes").to_numpy()
        ill = (bridge >= 0) & ((a == 3) | (bridge == 3) | (a == bridge) | (bridge == 0) | ((a == 0) & (bridge != 1)))
        cols += [b.column("blank"), b.column("duplicate"), b.column("truncated"), tk.i64(b.column("illegal").to_numpy() + ill)]
        yield pa.record_batch(cols, names=["conv_id", "strip", "first", "scripts", "audit", "cost", "blank", "duplicate", "truncated", "illegal"])


KEYS = "conv_id long, strip long, first long"
WITH_WAY = f"{KEYS}, codes array<int>, copies array<long>, way array<long>, blank long, duplicate long, truncated long, illegal long, opens long, closes long"


def edited(rows: DataFrame) -> DataFrame:
    """A written table, one row a strip of ordered turns: conv_id, strip, first, scripts, audit, cost and counts of faults.

    A turn's script holds, in order, u and a for turns inserted, then K, U or A for a turn that stays as it is, as the
    user's or as the assistant's, or D.
    """
    n = tk.partitions(rows.sparkSession)
    spans = strips(rows).select("conv_id", "strip", "first", F.col("codes").cast("array<int>").alias("codes"), "copies").mapInArrow(_spans, WITH_WAY)
    behind = spans.repartition(n, "conv_id").sortWithinPartitions(F.asc("conv_id"), F.desc("strip")).mapInArrow(_behind, f"{WITH_WAY}, end array<long>, exits array<long>, follows long")
    out = behind.repartition(n, "conv_id").sortWithinPartitions("conv_id", "strip")
    return tk.written(out.mapInArrow(_edited, f"{KEYS}, scripts array<string>, audit string, cost long, blank long, duplicate long, truncated long, illegal long"), "edits")


def said(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, place and turns (role and text of each, in order) of the repaired conversations, without empty places."""
    e = edits.select(F.col("conv_id").alias("c"), F.col("strip").alias("s"), "first", "scripts")
    both = rows.select("conv_id", "place", "role", "text").join(e, F.col("conv_id").eqNullSafe(F.col("c")) & (F.shiftright("place", STRIP) == F.col("s")))

    def turn(c: Column) -> Column:
        role = F.when(c == "K", F.col("role")).when(c.isin("u", "U"), "user").when(c.isin("a", "A"), "assistant")
        return F.struct(role.alias("role"), F.when(c.isin("u", "a"), "").otherwise(F.col("text")).alias("text"))

    script = F.col("scripts")[(F.col("place") - F.col("first")).cast("int")]
    return both.select("conv_id", "place", F.filter(F.transform(F.split(script, ""), turn), lambda x: x["role"].isNotNull()).alias("turns")).where("size(turns) > 0")


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired conversations, one row a turn: conv_id, place, k (from 0 at each place), role and text."""
    rows = ordered(turns)
    return said(rows, edited(rows)).select("conv_id", "place", F.posexplode("turns").alias("k", "turn")).select("conv_id", "place", "k", "turn.*")


def _digest(batches):
    now, whole, out = (), None, []

    def batch():
        return pa.record_batch([pa.array([c for c, _ in out], pa.int64()), pa.array([d for _, d in out], pa.string())], names=["c", "repaired_sha256"])

    for b in batches:
        for conv, turns in zip(b.column("conv_id").to_pylist(), b.column("turns").to_pylist()):
            if (conv,) != now:
                if now:
                    out.append((*now, whole.hexdigest()))
                if len(out) >= 5000:
                    yield batch()
                    out = []
                now, whole, mark = (conv,), hashlib.sha256(), ""
            for turn in turns:
                whole.update(f"{mark}{turn['role']}:{turn['text']}".encode())
                mark = "\n"
    if now:
        out.append((*now, whole.hexdigest()))
    if out:
        yield batch()


def report(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """For every conv_id of ids: gaps, faults, cost, audit and a digest of the repaired turns. A digest needs all turns of a
    conversation one after another, so one task reads each, as a stream; nothing else brings a whole one together."""
    rows = ordered(turns)
    edits = edited(rows)
    ids = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    gaps = rows.groupBy(F.col("conv_id").alias("c")).agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    sums = edits.groupBy(F.col("conv_id").alias("c")).agg(*[F.sum(x).alias(x) for x in counts], F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("strip", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    hashes = said(rows, edits).repartition(tk.partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_digest, "c long, repaired_sha256 string")
    for part in (gaps, sums, hashes):
        ids = ids.join(part, F.col("conv_id").eqNullSafe(part["c"]), "left").drop("c")
    nothing = hashlib.sha256(b"").hexdigest()
    return ids.select("conv_id", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", *counts)], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
