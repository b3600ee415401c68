import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.fixtures import clashing, empty, hard, prose
from scholarmetrics.llm import phrases as P

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams_of(rows, most):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            for m in range(1, most + 1):
                f[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    return f


def brute(rows, cfg):
    out = []
    for lang, f in grams_of(rows, cfg.max_words).items():
        n = sum(v for g, v in f.items() if len(g) == 1)
        cand = [g for g, a in f.items() if len(g) > 1 and a >= cfg.min_count]
        inside = lambda s, g: any(g[i : i + len(s)] == s for i in range(len(g) - len(s) + 1))
        scored = []
        for g in cand:
            if any(len(x) > len(g) and 100 * f[x] >= 100 * f[g] and inside(g, x) for x in cand):
                continue
            score, k = min(((1000 * f[g] * n) // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            scored.append((-score, -f[g], " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        scored.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(scored[: cfg.top])]
    return sorted(out)


def sample(seed, n):
    r = random.Random(seed)
    passage = prose(77, 60)
    words = [f"w{i}" for i in range(12)]
    rows = []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randrange(30))]
        if i % 4 == 0:
            w.insert(r.randrange(len(w) + 1), passage)
        if i % 5 == 0:
            w.insert(r.randrange(len(w) + 1), "Fixed Phrase, new\tyork city! aa aa aa aa aa aa aa")
        rows.append((r.choice(["en", "en", "fr", None]), r.choice([" ", "  ", "\t"]).join(w)))
    return rows


@pytest.mark.parametrize("cfg", [P.PhraseConfig(min_count=3), P.PhraseConfig(min_count=10, top=7), P.PhraseConfig(min_count=2, max_words=3),
                                 P.PhraseConfig(min_count=4, max_words=2)])
def test_equals_brute_force(spark, cfg):
    rows = sample(3, 200)
    got = P.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(3), cfg)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == brute(rows, cfg)


def test_pair_counts_merge(monkeypatch):
    monkeypatch.setattr(P, "PENDING", 50)
    r, c = np.random.default_rng(1), P._PairCounts()
    given = [r.integers(0, 300, 40).astype(np.uint64) for _ in range(30)]
    for h in given:
        c.add(h)
    rows = c.rows()
    assert dict(zip(rows.column(2).to_pylist(), rows.column(3).to_pylist())) == Counter(np.concatenate(given).tolist())


def test_small_steps_and_full_bitmaps_change_nothing(spark, monkeypatch):
    rows, cfg = sample(4, 60), P.PhraseConfig(min_count=3)
    bits = np.full(1 << (P.PAIR_BITS - 3), 255, np.uint8)  # every word and pair may be frequent
    monkeypatch.setattr(P, "bitmap", lambda hashes, n: bits)
    got = P.collocations(spark.createDataFrame(rows, "lang string, text string"), cfg)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == brute(rows, cfg)


def test_hard_rows(spark):
    cfg = P.PhraseConfig(min_count=2)
    d = clashing(hard(spark), ["gram", "n", "m", "h", "salt"])
    rows = [(r.lang, r.text) for r in d.collect()]
    got = P.collocations(d, cfg).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == brute(rows, cfg)
    assert P.collocations(empty(spark)).count() == 0
    nulls = spark.createDataFrame([(None, None), ("en", None), (None, "")], "lang string, text string")
    assert P.collocations(nulls).count() == 0


def test_products_beyond_64_bits(spark):
    big = 10**13
    row = spark.createDataFrame([(big, 9 * big)], "a long, n long").select(
        (F.lit(1000).cast("decimal(38,0)") * F.col("a").cast("decimal(38,0)") * F.col("n").cast("decimal(38,0)")).alias("up"),
        (F.col("a").cast("decimal(38,0)") * F.col("a").cast("decimal(38,0)")).alias("down")).select(F.expr("up div down").alias("s")).first()
    assert row.s == 1000 * big * 9 * big // (big * big)


def test_flows_and_paths(spark):
    rows, cfg = sample(5, 120), P.PhraseConfig(min_count=5)
    docs = spark.createDataFrame(rows, "lang string, text string")
    f = grams_of(rows, 5)
    found = P.flows(P.graph(docs, P.counts(docs, cfg), cfg), cfg)
    for m, t in found.items():  # node flow plus corrections gives every frequent count
        got = {(r.lang, r.gram): r.n for r in t.collect()}
        want = {(lang, " ".join(g)): n for lang, c in f.items() for g, n in c.items() if len(g) == m and n >= cfg.min_count}
        assert {k: v for k, v in got.items() if v >= cfg.min_count} == want
    heavy = {m: t.filter(F.col("n") >= cfg.min_count) for m, t in found.items()}
    paths = P.unary_paths(heavy[5], heavy[4], cfg).collect()
    # every edge lies on exactly one path of its weight, and the passage is one path where nothing branches
    edges = Counter((p.lang, " ".join(w[i : i + 5]), p.n) for p in paths for w in [p.phrase.split()] for i in range(len(w) - 4))
    assert set(edges) == {(r.lang, r.gram, r.n) for r in heavy[5].collect()} and set(edges.values()) == {1}
    assert any(prose(77, 60) in p.phrase for p in paths if p.lang == "en")
