import base64
import random

import numpy as np
import pytest

from tessera.llm import token_counts as tc

public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.tiktoken")


def greedy(word: bytes, pieces: set[bytes]) -> int:
    """Longest piece first; those within a word hold no space, as every byte does alone."""
    text, at, n = b" " + word, 0, 0
    while at < len(text):
        for end in range(min(len(text), at + 130), at, -1):
            if text[at:end] in pieces and (at == 0 or b" " not in text[at:end]) or end == at + 1:
                n, at = n + 1, end
                break
    return n


@pytest.fixture(scope="module")
def pieces():
    return {base64.b64decode(x.split()[0]) for x in open(PATH, "rb") if x.strip()}


def test_small_vocabulary():
    r = random.Random(3)
    for _ in range(60):
        vocab = {bytes(r.choice(b"ab") for _ in range(r.randrange(1, 6))) for _ in range(8)}
        vocab |= {b" " + bytes(r.choice(b"ab") for _ in range(r.randrange(1, 5))) for _ in range(4)}
        auto = tc.Automaton(sorted(vocab))
        words = [bytes(r.choice(b"abc") for _ in range(r.randrange(1, 14))) for _ in range(40)]
        body, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
        got = auto.count(body, ends - [len(w) for w in words], ends)
        assert got.tolist() == [greedy(w, vocab) for w in words]
        with pytest.MonkeyPatch.context() as m:
            m.setattr(tc, "LONG", 3)
            assert auto.count(body, ends - [len(w) for w in words], ends).tolist() == got.tolist()


def test_counts(spark, pieces):
    r = random.Random(5)
    texts = [None, "", "   ", "hello world", "été über 漢字 \x00 🙂", "x" * 5000, "unbelievableness " * 300]
    texts += [" ".join("".join(r.choice("etaoinshrdlu.,'éß") for _ in range(r.randrange(1, 15))) for _ in range(60)) for _ in range(30)]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, "a", 0), (3, "hello world", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = tc.counts(df, PATH).collect()
    key = lambda x: (x[0] is None, *[v or 0 for v in x])
    want = [(i, len((t or "").split()), sum(greedy(w.encode(), pieces) for w in (t or "").split())) for i, t, _ in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert tc.counts(df.limit(0), PATH).count() == 0
