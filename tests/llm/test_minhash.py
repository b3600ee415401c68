import random

from llm.fixtures import WORDS, clashing, empty, hard, prose
from scholarmetrics.llm import minhash as M
from scholarmetrics.llm.graph import components


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def families(seed, n):
    """Families of near copies of graded similarity, chains, copies and a shared passage."""
    r, rows, i = random.Random(seed), [], 0
    passage = prose(99, 45)
    for f in range(n):
        words = prose(f, r.choice([5, 9, 30, 60, 120])).split()
        for _ in range(r.randrange(1, 9)):
            rows.append((i, " ".join(words) + (" " + passage if f % 3 == 0 else "")))
            i += 1
            if r.random() < 0.8:
                for _ in range(r.randrange(1, 3)):
                    words[r.randrange(len(words))] = r.choice(WORDS)
    return rows


def test_components_equal_brute_force(spark):
    rows = families(4, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for k in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(df, M.DedupConfig(words=k)).collect()}
        assert got == brute(rows, k, 80)


def test_chain_of_links_is_one_component(spark):
    words = prose(7, 60).split()
    rows = []
    for i in range(25):  # each differs a little from the one before; the ends share nothing
        rows.append((i, " ".join(words)))
        words = words[2:] + [f"w{i}a", f"w{i}b"]
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), M.DedupConfig(words=4)).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_hard_rows(spark):
    d = hard(spark)
    got = M.near_duplicates(d, M.DedupConfig(words=4)).collect()
    assert len(got) == d.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id, r.kept))
    assert by[1] == {(0, 1, True)} and by[2] == {(0, 2, True)} and by[3] == {(0, 3, True)}
    assert by[4] == {(1, 4, True)} and by[12] == {(1, 4, False)}
    assert by[6] == {(57, 5, False)} and by[7] == {(59, 5, False)} and by[None] == {(57, None, True)}
    kept = M.dedup_filter(clashing(d, ["node", "rep", "hub", "_gone2"]))
    assert [c for c in kept.columns if c in d.columns] == d.columns
    assert {r.doc_id for r in kept.collect()} == {None, 1, 2, 3, 4, 5, 8, 9, 10, 11, 13}
    assert M.near_duplicates(empty(spark)).count() == 0


def test_components_of_long_chain(spark):
    links = spark.range(200).selectExpr("id as a", "id + 1 as b").unionByName(spark.range(1).selectExpr("1000L as a", "900L as b"))
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 900, 900: 900}


def test_no_text_goes_with_another_of_the_same_id(spark):
    a, b = prose(501, 40), prose(502, 40)
    near = lambda t: t + " one more"
    cases = [
        ([(3, a), (5, a), (5, b), (9, b)], {(3, a), (5, b)}),
        ([(3, a), (5, near(a)), (5, b), (9, near(b))], {(3, a), (5, b)}),
        ([(2, near(a)), (5, a), (5, b)], {(2, near(a)), (5, b)}),  # two classes with the same smallest id
        ([(5, a), (5, b), (5, a), (6, "")], {(5, a), (5, b), (6, "")}),
        ([(1, a), (5, a), (5, ""), (5, None), (None, a)], {(1, a), (5, ""), (5, None), (None, a)}),
    ]
    for rows, want in cases:
        d = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), ["_id", "d1", "node", "_row", "_maybe", "b", "bits"])
        kept = M.dedup_filter(d)
        assert kept.columns == d.columns and {(r.doc_id, r.text) for r in kept.collect()} == want, rows
        by_row = M.near_duplicates(d).collect()
        assert len(by_row) == len(rows)


def test_bitmap_never_misses(spark):
    from scholarmetrics.llm.common import bitmap, has_bit, may_hold
    import numpy as np

    held = [0, 1, 7, 8, 32767, 32768, -1, 2**62, -(2**63), 123456789]
    values = spark.createDataFrame([(v,) for v in held], "h long")
    bits = bitmap(values, 26)
    assert has_bit(bits, np.array(held, np.int64)).all() and np.unpackbits(bits).sum() == len({v % 2**26 for v in held})
    asked = held + [2, 9, 40000, -2, None]
    got = {r.k: r.hit for r in may_hold(spark.createDataFrame([(v,) for v in asked], "k long"), "k", values, 26, "hit").collect()}
    assert got == {v: v is not None and v % 2**26 in {h % 2**26 for h in held} for v in asked}
