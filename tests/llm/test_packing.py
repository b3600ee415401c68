import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from llm.fixtures import clashing, empty, hard, prose
from scholarmetrics.llm import packing as K


def reference():
    return Tokenizer.from_file(K.default_tokenizer())


def test_words_encode_like_whole_texts(monkeypatch):
    r, tk = random.Random(3), reference()
    parts = ["a", "B", " ", " ", "\n", "\t", ",", ".", "'s", "'", "é", "é", "日", " ", "​", "5", "<|endoftext|>", "!", "Word", " the",
             "\r\n", "🙂", "\x01", "\x1c", "_", "İ", "Σ", "́", " ́"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(3000)] + [None, "", "x" * 5000, " " * 300]
    for known in (100, K.KNOWN):
        monkeypatch.setattr(K, "KNOWN", known)
        enc = K.WordEncoder(tk.to_str(), "<u2")
        assert enc.by_word
        for at in range(0, len(texts), 400):
            for t, ids in zip(texts[at : at + 400], enc.encode(texts[at : at + 400]), strict=True):
                assert np.frombuffer(ids, "<u2").tolist() == tk.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    tk = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    enc = K.WordEncoder(tk.to_str(), "<u2")
    assert not enc.by_word
    for t in ("a  b\n c", "", None):
        assert np.frombuffer(enc.encode([t])[0], "<u2").tolist() == tk.encode(t or "", add_special_tokens=False).ids


def check(rows, packed, cfg):
    """Every id in one place, sequences gapless and short enough, padding as promised."""
    tk = reference()
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in packed:
        docs[r.doc_id, r.doc_tokens].append(r)
        seqs[r.sequence_id].append(r)
        assert r.length > 0 and len(r.ids) == 2 * r.length
    want = defaultdict(list)
    for doc_id, text in rows:
        ids = tk.encode(text or "", add_special_tokens=False).ids + [cfg.end_id]
        want[doc_id, len(ids)].append(ids)
    assert docs.keys() == want.keys()
    for key, copies in want.items():
        flat = sorted(i for c in copies for i in enumerate(c))
        assert sorted((r.start + k, int(i)) for r in docs[key] for k, i in enumerate(np.frombuffer(r.ids, "<u2"))) == flat
    padding = 0
    for own in seqs.values():
        own.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in own])
        assert [r.offset for r in own] == [0, *ends[:-1]] and ends[-1] <= cfg.length
        if ends[-1] & (ends[-1] - 1):
            assert cfg.length - ends[-1] <= cfg.max_padding
            padding += cfg.length - ends[-1]
    return padding, sum(len(i) for c in want.values() for i in c)


def test_pack(spark):
    r = random.Random(5)
    rows = [(i, prose(i, r.choice([0, 1, 5, 40, 200, 700, 3000]))) for i in range(120)] + [(7, "again the same id"), (None, "no id"), (None, None)]
    for cfg in (K.PackConfig(), K.PackConfig(length=256, max_padding=4), K.PackConfig(length=8, max_padding=0)):
        packed = K.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), cfg).collect()
        padding, tokens = check(rows, packed, cfg)
        assert padding <= cfg.max_padding / cfg.length * tokens


def test_sequences_and_hard_rows(spark):
    d = clashing(hard(spark), ["class", "part", "row", "ids", "length"])
    packed = K.pack(d.repartition(4)).cache()
    check([(r.doc_id, r.text) for r in d.collect()], packed.collect(), K.PackConfig())
    whole = K.sequences(packed).collect()
    assert sum(s.length for s in whole) == sum(len(r.ids) // 2 for r in packed.collect())
    for s in whole:
        own = sorted((r for r in packed.collect() if r.sequence_id == s.sequence_id), key=lambda r: r.offset)
        assert bytes(s.ids) == b"".join(bytes(r.ids) for r in own) and s.padded == (s.length if s.length & (s.length - 1) == 0 else 4096)
    packed.unpersist()
    assert K.pack(empty(spark)).count() == 0 and K.sequences(K.pack(empty(spark))).count() == 0


def test_query_digests_the_ids(spark, tmp_path):
    rows = [(i, prose(i, 30 * i)) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tk, texts = reference(), dict(rows)
    for r in K.query(spark, str(tmp_path)).collect():
        ids = tk.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def total(patterns):
    out = defaultdict(int)
    for n, counts in patterns:
        for k, a in counts.items():
            out[k] += n * a
    return dict(out)


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece(seed):
    r = random.Random(seed)
    draw = [lambda: r.randint(1, 512), lambda: r.choice([170, 171, 256, 300]), lambda: min(512, int(r.lognormvariate(4, 1)) + 1), lambda: 375][seed]
    histogram = defaultdict(int)
    for _ in range(30000):
        histogram[draw()] += 1
    patterns = K.plan(dict(histogram), 512)
    assert total(patterns) == histogram and all(sum(k * a for k, a in c.items()) <= 512 for _, c in patterns)
    x = K.solve(np.array(sorted(histogram)), np.array([histogram[k] for k in sorted(histogram)], float), 512)
    assert sum(n for n, _ in patterns) <= sum(v for v, _ in x) + len(histogram)  # rounding costs less than one sequence a pattern
    # the lookup table covers each class's ranks once, and no two pieces share a place
    table = K.slots(patterns)
    for k, n in histogram.items():
        spans = sorted((a, b) for c, a, b, *_ in table if c == k)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    taken = [(s + i // a, p + i % a) for _, lo, hi, s, a, p in table for i in range(hi - lo)]
    assert len(taken) == len(set(taken)) == sum(histogram.values())


def test_linear_program_is_optimal():
    # lengths 4 and 3 in 10: 4 + 3 + 3 fills a sequence, and no plan beats total / room
    x = K.solve(np.array([3, 4]), np.array([200.0, 100.0]), 10)
    assert abs(sum(v for v, _ in x) - 100) < 0.1
    # 6 never meets another 6: one sequence each
    assert abs(sum(v for v, _ in K.solve(np.array([6]), np.array([50.0]), 10)) - 50) < 1e-6
    assert K.plan({}, 512) == []
