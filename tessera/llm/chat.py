"""Chat formatting with a grammar round trip.

A turn is written as an opening mark, its text and a closing mark. What was written is read again by a deterministic
parser, which knows nothing of the source, and the turns it recovers are compared with the source; turns that differ
are written again with their control strings escaped, until all are identical. The escape adds a backslash after the
first character of a control string, and one more where backslashes stand there already, so the parser can always take
one away. Marks are never open at the end of a turn, so a conversation may be written and read in chunks of turns: a
conversation of any length passes through a task in bounded memory.

Defined cases: null text is empty, null role is the empty role; rows of one conversation are ordered by turn (null
first), then role and text; any role is allowed; rows with null conv_id form one conversation.
"""

import hashlib
import re
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit as tk

# The template's marks.
USER = ("[INST] ", " [/INST]")
ASSISTANT = ("<s>", "</s>")
OTHER_OPEN, OTHER_MIDDLE, OTHER_CLOSE = "<<TURN ", ">> ", " <</TURN>>"
CONTROL = re.compile(r"([\[<])(\\*)(/?INST\]|/?s>|<TURN |</TURN>>)")
OPEN = re.compile(r"\[INST\] |<s>|<<TURN ([^<> ]*)>> ")
CHUNK = 64


class Conflict(ValueError):
    """The text does not follow the grammar."""


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def marks(role: str) -> tuple[str, str]:
    if role == "user":
        return USER
    if role == "assistant":
        return ASSISTANT
    return OTHER_OPEN + quote(role, safe="") + OTHER_MIDDLE, OTHER_CLOSE


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end hold the escaped text."""
    out, at = [], 0
    while at < len(text):
        m = OPEN.match(text, at)
        if not m:
            raise Conflict(f"no turn begins at {at}")
        role = "user" if m[0] == USER[0] else "assistant" if m[0] == ASSISTANT[0] else unquote(m[1])
        close = marks(role)[1]
        end = text.find(close, m.end())
        if end < 0:
            raise Conflict(f"the turn at {at} does not end")
        body = text[m.end() : end]
        for c in CONTROL.finditer(body):
            if not c[2]:
                raise Conflict(f"a mark inside the turn at {at}")
        out.append((role, unescape(body), m.end(), end))
        at = end + len(close)
    return out


def recovered(written: list[str]) -> list[tuple[str, str] | None]:
    """What the parser makes of each turn, where its marks fall on the turn's own ends."""
    whole = "".join(written)
    try:
        got = parse(whole)
        if len(got) == len(written):
            return [x[:2] for x in got]
    except Conflict:
        pass
    out = []
    for w in written:  # tells which turns conflict
        try:
            got = parse(w)
            out.append(got[0][:2] if len(got) == 1 else None)
        except Conflict:
            out.append(None)
    return out


def render(turns: list[tuple[str, str]]) -> str:
    """The turns as one text that parses back to them."""
    raw = [True] * len(turns)
    write = lambda k: (o := marks(turns[k][0]))[0] + (turns[k][1] if raw[k] else escape(turns[k][1])) + o[1]
    written = [write(k) for k in range(len(turns))]
    while True:
        wrong = [k for k, (got, want) in enumerate(zip(recovered(written), turns)) if got != want]
        if not wrong:
            break
        todo = [k for k in wrong if raw[k]]
        if not todo:
            raise Conflict("an escaped turn does not come back")
        for k in todo:
            raw[k] = False
            written[k] = write(k)
    whole = "".join(written)
    if [x[:2] for x in parse(whole)] != list(turns):
        raise Conflict("the conversation does not come back")
    return whole


def ordered(conversations: DataFrame) -> DataFrame:
    """Rows of a conversation in one partition, in order. A partition is read as a stream, so its size is no bound."""
    cols = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return cols.repartition(tk.partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _format(batches):
    def row(conv, k, turns):
        text = render(turns)
        spans = [x for role, _, lo, hi in parse(text) if role == "assistant" for x in (lo, hi)]
        return conv, k, text, spans

    def out(rows):
        cols = list(zip(*rows))
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32())))], names=["conv_id", "chunk", "formatted", "loss"])

    now, turns, k, rows, size = (), [], 0, [], 0
    for b in batches:
        for conv, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()):
            if (conv,) != now or len(turns) == CHUNK:
                if turns:
                    rows.append(row(*now, k, turns))
                    size += len(rows[-1][2])
                k = k + 1 if (conv,) == now else 0
                now, turns = (conv,), []
                if size > 1 << 20:
                    yield out(rows)
                    rows, size = [], 0
            turns.append((role, text))
    if turns:
        rows.append(row(*now, k, turns))
    if rows:
        yield out(rows)


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, chunk (from 0), formatted, loss: the chunks of a conversation in order, one after another, are its text;
    loss holds start and end of every stretch under the loss mask, in code points of the chunk."""
    return ordered(conversations).mapInArrow(_format, "conv_id long, chunk int, formatted string, loss array<int>")


def _digest(batches):
    def out(rows):
        cols = list(zip(*rows))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    now, rows, n, turns, loss, chars, size = (), [], 0, None, None, 0, 0
    for b in batches:
        for conv, text, spans in zip(b.column("conv_id").to_pylist(), b.column("formatted").to_pylist(), b.column("loss").to_pylist()):
            if (conv,) != now:
                if now:
                    rows.append((*now, n, turns.hexdigest(), chars, loss.hexdigest(), size))
                if len(rows) >= 5000:
                    yield out(rows)
                    rows = []
                now, n, turns, loss, chars, size = (conv,), 0, hashlib.sha256(), hashlib.sha256(), 0, 0
            for role, said, _, _ in parse(text):
                n += 1
                turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            for lo, hi in zip(spans[::2], spans[1::2]):
                said = unescape(text[lo:hi])
                chars += len(said)
                loss.update(said.encode("utf-8", "surrogatepass"))
            size += len(text)
    if now:
        rows.append((*now, n, turns.hexdigest(), chars, loss.hexdigest(), size))
    if rows:
        yield out(rows)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, from the formatted text and its loss mask alone. Takes format_chats' own partitions."""
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
