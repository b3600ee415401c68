import random
import zlib

import numpy as np
import pyarrow.fs as pafs
from tokenizers import Tokenizer

from llm.fixtures import clashing, empty, hard
from scholarmetrics.llm import tokenfiles as T
from scholarmetrics.sources.io import scratch_path


def reference():
    return Tokenizer.from_file(T.default_tokenizer())


def test_pieces_encode_like_whole_texts(monkeypatch):
    r, tk = random.Random(3), reference()
    parts = ["a", "b", " ", " ", "\n", "\t", ",", ".", "'s", "'", "é", "日", " ", "​", "5", "<|endoftext|>", "!", "word", " the",
             "\r\n", "🙂", " ", "_"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(3000)] + [None, "", "x" * 5000, " " * 300]
    texts += ["\n".join(" ".join(r.choice(["a", "word,", "the", "é", "it's", "x<|endoftext|>", "5%"]) for _ in range(r.randrange(6)))
                        for _ in range(r.randrange(5))) for _ in range(1500)]
    for known in (100, T.KNOWN):
        monkeypatch.setattr(T, "KNOWN", known)
        enc = T.PieceEncoder(tk.to_str(), "<u2")
        for at in range(0, len(texts), 400):
            for t, ids in zip(texts[at : at + 400], enc.encode(texts[at : at + 400]), strict=True):
                assert np.frombuffer(ids, "<u2").tolist() == tk.encode(t or "", add_special_tokens=False).ids, repr(t)
                assert "".join(map(T.piece, T.cut(t or ""))) == (t or "")


def test_files_read_back(spark):
    tk, folder = reference(), scratch_path(spark, "token_test")
    d = clashing(hard(spark), ["part", "base", "ids"])
    parts = T.write_tokens(d.repartition(3), folder)
    got = sorted(T.read_tokens(parts, folder, tk.get_vocab_size()).collect(), key=lambda r: r.start)
    want = sorted((r.doc_id is not None, r.doc_id or 0, tk.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in d.collect())
    at = 0
    for g, (known, doc_id, ids) in zip(got, want, strict=True):
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (doc_id if known else None, at, len(ids), crc)
        at += len(ids)
    # the files themselves: one flat run of 16-bit ids, offsets that continue over parts, no leftovers
    fs, root = pafs.FileSystem.from_uri(folder)
    names = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(root)))
    rows = sorted(parts.collect(), key=lambda r: r.part)
    assert names == sorted(f"part-{r.part:06d}.{k}" for r in rows for k in ("bin", "doc", "len", "off"))
    flat = np.concatenate([np.fromfile(f"{root}/part-{r.part:06d}.bin", "<u2") for r in rows])
    assert flat.tolist() == [i for _, _, ids in want for i in ids]
    offsets = [np.fromfile(f"{root}/part-{r.part:06d}.off", "<u8") for r in rows]
    assert all(a[-1] == b[0] for a, b in zip(offsets, offsets[1:])) and offsets[0][0] == 0 and offsets[-1][-1] == len(flat)


def test_empty_table(spark):
    folder = scratch_path(spark, "token_test")
    assert T.read_tokens(T.write_tokens(empty(spark), folder), folder, 50257).count() == 0
