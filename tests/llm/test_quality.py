import re
from collections import Counter

from pyspark.sql import functions as F

from llm.fixtures import clashing, empty, hard, prose
from scholarmetrics.llm import quality as Q


def base(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(grams)
    covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_base_counts_equal_brute_force(spark):
    texts = [None, "", "a", "a b c d e f a b c d e", "x y x y x y x y", "#*$%&|<>", "   x", "l\n\nl\n l", "\x0b\x0c a\rb",
             "a b c d e " * 40, prose(5, 300) + " " + prose(5, 300), "é 日本 🙂 " * 7]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = df.select("i", Q.metrics(F.col("text")).alias("m")).collect()
    for r in got:
        m = r["m"]
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["lines"]["dup"], m["n_repeat_words"]) == base(texts[r["i"]]), texts[r["i"]]


def test_filter_keeps_columns_and_is_whole(spark):
    d = clashing(hard(spark), ["m", "symbols", "kept", "_row2"])
    out = Q.quality_filter(d)
    assert out.columns == d.columns
    kept = [r.doc_id for r in out.collect()]
    assert 1 not in kept and 2 not in kept and 11 not in kept
    assert kept.count(6) == 2  # repeated rows stay repeated
    assert Q.quality_filter(empty(spark)).count() == 0


def test_adaptive_fence_rejects_outliers_only(spark):
    rows = [(i, prose(i, 80), "en", "s") for i in range(150)] + [(1000, " ".join(w + "%%%" for w in prose(3, 80).split()), "en", "s")]
    rows += [(2000 + i, prose(i, 80) + " ###", "xx", "small") for i in range(3)]  # a small group uses the merged sketch
    out = Q.quality_filter(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert ids == set(range(150)) | {2000, 2001, 2002}


def test_sketch_merges(spark):
    rows = spark.range(1000).select(F.lit("a").alias("lang"), (F.col("id") % 3).cast("string").alias("source"),
                                    F.col("id").alias("symbols"), F.col("id").alias("dup"), F.col("id").alias("length"))
    one = Q._quantiles(Q.sketch(rows), ["lang"]).first()
    parts = Q.sketch(rows.filter("id < 500")).unionByName(Q.sketch(rows.filter("id >= 500")))
    assert one == Q._quantiles(parts, ["lang"]).first()
    assert abs(one["symbols_q50"] - 500) <= 500 / 64
