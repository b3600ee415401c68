import random

from pyspark.sql import functions as F

from conftest import SF_SMALL
from llm.fixtures import clashing, empty, hard, prose
from scholarmetrics.llm import toxicity as X


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def bound(term, word, stem):
    """Least edits with the first and the last letter met (or a digit in their place) and any ending."""
    end = lambda a, b: 0 if a == b else 1 if not b.isalpha() else 99
    if not word:
        return 99
    return min((end(term[0], word[0]) + distance(term[1:-1], word[1:j]) + end(term[-1], word[j]) + (0 if stem else len(word) - 1 - j)
                for j in range(1, len(word))), default=99)


def test_automaton_equals_edit_distance():
    terms = [("idiot", False), ("scum", False), ("pathetic", False), ("disgusting", False), ("loweich", True), ("abc", True)]
    a, r = X.LexiconAutomaton(terms), random.Random(2)
    words = ["", "x"] + [t for t, _ in terms]
    for t, _ in terms * 120:
        w = list(t)
        for _ in range(r.randrange(4)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randrange(2)] = r.choice(["", "z", "i", "o", "0"])
        words.append("".join(w) + r.choice(["", "", "s", "ung"]))
    for w in words:
        want = []
        for t, stem in terms:
            k = X.edits_allowed(t, stem)
            d = bound(t, w, stem)
            if d <= k:
                want.append(d)
        assert a.match(w) == min(want, default=-1), w


def test_quotation_counts_less_than_abuse():
    a = X.LexiconAutomaton([("idiot", False)])
    abuse, quote = X.evidence("you are an idiot", a), X.evidence('he said "idiot" again', a)
    assert abuse[0] == 1 > quote[0] > 0 and abuse[1] > 1 and quote[3] == [("idiot", 0, True)]
    typo = X.evidence("what an idi0t here", a)
    assert quote[0] < typo[0] < 1 and typo[2] and not abuse[2]


def test_one_clear_hit_is_enough_and_a_quotation_is_not(spark):
    # learnt from toxic texts with many exact hits only
    rows = [(prose(i, 40) + " idiot " + prose(i + 900, 9) + " moron scum " + prose(i + 700, 9), 1) for i in range(40)]
    rows += [(prose(i, 60), 0) for i in range(1000, 1400)]
    model = X.learn(spark.createDataFrame(rows, "text string, toxic int"))
    texts = [prose(1, 50) + " idiot " + prose(2, 30), prose(3, 50) + " idi0t " + prose(4, 30), prose(5, 30) + ' he said "idiot" ' + prose(6, 30),
             prose(7, 50), ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [r["score"] >= 0.5 for r in sorted(X.score(df, model).collect(), key=lambda r: r["_row"]["i"])]
    assert got == [True, True, False, False, False]


def test_misspelled_hits_of_clean_documents_count_against_them(spark):
    rows = [(prose(i, 40) + " loser " + prose(i + 900, 9), 1) for i in range(40)]
    rows += [(prose(i, 60) + " looser " + prose(i, 5), 0) for i in range(1000, 1400)]
    model = X.learn(spark.createDataFrame(rows, "text string, toxic int"))
    df = spark.createDataFrame([(prose(1, 20) + " looser " + prose(2, 9),), (prose(1, 20) + " loser " + prose(2, 9),)], "text string")
    assert [r["score"] >= 0.5 for r in X.score(df, model).collect()] == [False, True]


def test_copies_do_not_make_terms(spark):
    bad = prose(500, 80) + " grobian " + prose(501, 10)
    rows = [(prose(i, 60) + f" grobian{'abc'[i % 3]} " + prose(i + 900, 20), 1) for i in range(40)] + [(bad, 1)] * 60
    rows += [(prose(i, 80), 0) for i in range(1000, 1400)]
    lexicon = X.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    learnt = [t for t in lexicon if t[0] not in X.SEED]
    assert learnt and all(t.startswith("grob") for t, _ in learnt)


def test_held_out_labels(spark):
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    rows = X.query(spark, SF_SMALL)
    assert rows.count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    r = rows.join(labels, "doc_id").collect()
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in r)
    clean = [x for x in r if x.toxic == 0]
    assert sum(x.predicted for x in clean) <= 0.03 * len(clean)


def test_terms_of_names_the_terms_behind_a_match():
    a = X.LexiconAutomaton([("idiot", False), ("loser", False), ("worthl", True)])
    assert a.terms_of("loser") == {("loser", False)} == a.terms_of("looser") and a.terms_of("plain") == a.terms_of("closer") == set()
    assert a.terms_of("worthlessly") == {("worthl", True)}
    b = X.LexiconAutomaton([("idiot", False), ("loser", False)], frozenset({("loser", False)}))
    assert (b.match("looser"), b.match("loser"), b.match("idi0t"), b.match("1diot"), b.match("idiots")) == (-1, 0, 1, 1, 1)


def test_model_learnt_from_the_tables(spark):
    """The model of the given labels catches misspelled abuse, and neither quotations nor innocent words."""
    sf = SF_SMALL.replace("0.001", "0.01")
    for d in (SF_SMALL, sf):
        docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
        model = X.learn(X.learning_rows(docs, labels.filter(~X.held_out(F.col("doc_id")))))
        texts = {"you are an idi0t": True, "You worthles scvm, you are pathetlc": True, "such a stupid idiot": True,
                 'he said "idiot" again': False, "the word idi0t was quoted": False, "he took the path through the forest": False,
                 "Das ist ein langes Wort": False, "Viajamos tras la guerra por el campo": False, "closer to the sea": False, "": False}
        df = spark.createDataFrame(list(texts.items()), "text string, want boolean")
        got = {r["_row"]["text"]: r["score"] for r in X.score(df, model).collect()}
        assert {t: v >= 0.5 for t, v in got.items()} == texts, got
    scored = X.score(docs, model, keep=["doc_id"]).select("_row.doc_id", "score", "hits", "misspelled").join(labels, "doc_id")
    rows = scored.filter(X.held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).collect()
    toxic = [r for r in rows if r.toxic == 1 and r.hits]
    assert toxic and sum(r.score >= 0.5 for r in toxic) >= 0.9 * len(toxic)
    clean = [r for r in rows if r.toxic == 0]
    assert sum(r.score >= 0.5 for r in clean) <= 0.03 * len(clean)


def test_hard_rows(spark):
    model = {"lexicon": [("idiot", False)], "weights": X.PRIOR}
    d = clashing(hard(spark), ["score", "hits", "strength", "_text"])
    rows = X.score(d, model).collect()
    assert len(rows) == d.count() and len({r["score"] for r in rows}) == 1 and rows[0]["score"] < 0.5
    assert X.score(empty(spark), model).count() == 0
    labels = spark.createDataFrame([(5, 1), (5, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    assert [r.toxic for r in X.learning_rows(hard(spark), labels).collect()] == [1]
    twice = hard(spark).filter("doc_id = 6").unionByName(hard(spark).filter("doc_id = 6"))
    assert X.learning_rows(twice, spark.createDataFrame([(6, 1)], "doc_id long, toxic int")).count() == 1
    nothing = X.learn(X.learning_rows(hard(spark), labels.filter(F.lit(False))))
    assert nothing["lexicon"] == [(t, False) for t in X.SEED]
