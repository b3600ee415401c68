import random
import re

from pyspark.sql import functions as F

from llm.fixtures import clashing, empty, hard
from scholarmetrics.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items, window=13):
    w, hit, found = words(text), set(), set()
    for name, it in items:
        x = words(it)
        n = min(window, len(x))
        grams = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if x else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(name)
    return len(w), len(hit), found


def tables(spark, seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É1", "über"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.choice([1, 3, 12, 13, 14, 40]))) for i in range(30)] + [(40, None), (41, "...!"), (42, ""), (None, text(20))]
    docs = []
    for i in range(120):
        parts = [text(r.randrange(30))]
        for _ in range(r.randrange(3)):
            it = (r.choice(items)[1] or "").split()
            a = r.randrange(len(it) + 1)
            parts += [" ".join(it[a : a + r.randrange(5, 40)]).upper() if r.random() < 0.3 else " ".join(it), text(r.randrange(8))]
        docs.append((i, ", ".join(parts)))
    docs += [(200, None), (201, ""), (202, "?!")]
    return docs, items


def check(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    texts = dict(docs)
    named = [("" if i is None else str(i), t) for i, t in items]
    for r in D.find_matches(d, b).collect():
        n, hit, found = brute(texts[r["_row"]["doc_id"]], named)
        assert (r["n_words"], r["n_hit"], {m["item_id"] for m in r["matches"]}) == (n, hit, found)
        w = words(texts[r["_row"]["doc_id"]])
        for m in r["matches"]:  # every match is verbatim and can't be longer
            same = [words(t) for i, t in named if i == m["item_id"]]
            a, o, n = m["doc_start"], m["item_start"], m["length"]
            assert any(w[a : a + n] == x[o : o + n] for x in same)
            assert all(not (w[a : a + n] == x[o : o + n] and a + n < len(w) and o + n < len(x) and w[a + n] == x[o + n]) for x in same)


def test_matches_equal_brute_force(spark):
    check(spark, *tables(spark))


def test_benchmark_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WORDS", 60)
    check(spark, *tables(spark, 5))


def test_hard_rows_and_filter(spark):
    bench = spark.createDataFrame([(1, " ".join(hard(spark).filter("doc_id = 5").first().text.split()[:20]))], "item_id long, text string")
    d = clashing(hard(spark), ["matches", "n_words", "_text"])
    out = D.decontaminate(d, bench)
    assert out.columns == d.columns
    assert {r.doc_id for r in out.collect()} == {1, 2, 3, 4, 8, 9, 10, 11, 12, 13}
    assert D.decontaminate(d, bench.filter(F.lit(False))).count() == d.count()
    assert D.decontaminate(empty(spark), bench).count() == 0
