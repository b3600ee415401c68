import random

import numpy as np
import sentencepiece

from llm.fixtures import clashing, empty, hard
from scholarmetrics.llm import pieces as S


def reference():
    return sentencepiece.SentencePieceProcessor(model_file=S.default_model())


def check(texts, chars=200_000):
    ref, enc = reference(), S._Encoder(S.model_tables(S.default_model()))
    S.BLOCK_CHARS, old = chars, S.BLOCK_CHARS
    try:
        ids, n = enc.encode(texts)
    finally:
        S.BLOCK_CHARS = old
    edge = np.concatenate([[0], np.cumsum(n)])
    for i, t in enumerate(texts):
        assert ids[edge[i] : edge[i + 1]].tolist() == ref.encode(t or ""), repr(t)


def test_equals_the_library_on_hard_texts():
    check(["", " ", "  ", "   a", "a   b", " " * 40 + "x" + " " * 17, "\n\n\t x", "▁▁a ▁", "aaaa" * 30, "日本語テキスト 中文",
           "🙂🙂 é́", "a", "...... ....", "x" * 3000, None, "\x00\x01", "ab" * 500 + " " * 33])


def test_equals_the_library_on_random_texts():
    r = random.Random(1)
    letters = "aaabbeth   .,!\n"
    check(["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(1500)], chars=500)
    ref = reference()
    parts = [ref.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    check(["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(1500)])
    check(["".join(r.choice(parts[:4000]) for _ in range(r.randrange(30))) for _ in range(1500)])


def test_chunks_are_remembered_and_forgotten(monkeypatch):
    monkeypatch.setattr(S, "KNOWN_CHUNKS", 3)
    ref, enc = reference(), S._Encoder(S.model_tables(S.default_model()))
    for t in ["one two three four five", "one two", "six seven one", ""]:
        ids, n = enc.encode([t])
        assert ids.tolist() == ref.encode(t) and n.tolist() == [len(ids)]


def test_round_trip_of_hard_rows(spark):
    d = clashing(hard(spark), ["ids", "check", "_text", "decoded"])
    rows = S.encoded(d).collect()
    assert len(rows) == d.count() and all(r.round_trip for r in rows)
    ref = reference()
    texts = {}
    for r in hard(spark).collect():
        texts.setdefault(r.doc_id, ref.encode(r.text or ""))
    assert all(r.ids == texts[r.doc_id] and r.n_tokens == len(r.ids) for r in rows)
    assert S.encoded(empty(spark)).count() == 0
