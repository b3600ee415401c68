"""Edges with a hot cited paper and very long author lists."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from scholarmetrics import Config
from scholarmetrics.operators import citations as C
from scholarmetrics.sources.io import CORPUS_SCHEMA

CFG = Config(name="t", min_year=1990, min_cite_year=1995, max_year=2000)
HOT, LARGE, N, MANY = 1, 2, 3000, 5000


def paper(eid, year, refs, authors):
    au = None if authors is None else [(a, i + 1, "S", "G", "I", "X", "X") for i, a in enumerate(authors)]
    return (eid, year, dt.datetime(year, 6, 1), "ar", (eid % 7,), refs, au, None, None)


@pytest.fixture(scope="module")
def papers():
    """Paper HOT is cited by a third of the corpus, paper LARGE has 5,000 authors and cites many."""
    r = random.Random(3)
    rows = [paper(HOT, 1994, [], ["7", "8", "x", None]), paper(LARGE, 1996, list(range(10, 200)), [str(1000 + i) for i in range(MANY)])]
    for e in range(3, N):
        refs = [r.randrange(1, N + 500) for _ in range(r.randrange(5))] + [HOT] * (e % 3 == 0) + [LARGE] * (e % 50 == 0)
        authors = None if e % 97 == 0 else [str(r.randrange(5, 4000)) for _ in range(r.choice([1, 2, 3, 16, 17, 40]))] + (["x"] if e % 5 == 0 else [])
        rows.append(paper(e, r.choice([1993, 1996, 2001]), refs if e % 31 else None, authors))
    return rows


def brute(rows):
    known = lambda au: {int(a[0]) for a in au or [] if a[0] and a[0].isdigit()}
    authors = {p[0]: known(p[6]) for p in rows}
    return {(p[0], c, int(bool(authors[p[0]] & authors[c])), p[4][0])
            for p in rows if p[1] >= CFG.min_cite_year for c in p[5] or [] if c in authors}


def edges(df):
    return df.select("citing", "cited", "is_self", "citing_srcid")


def test_edges_equal_brute_force(spark, papers):
    got = [tuple(r) for r in edges(C.citing_edges_base(spark.createDataFrame(papers, CORPUS_SCHEMA).repartition(4), CFG)).collect()]
    want = brute(papers)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(cited == HOT and own for _, cited, own, _ in want) and any(LARGE in (a, b) and own for a, b, own, _ in want)


@pytest.mark.parametrize("few", [0, 2, 10_000])
def test_any_list_length_gives_the_same_edges(spark, papers, few, monkeypatch):
    monkeypatch.setattr(C, "FEW", few)
    got = edges(C.citing_edges_base(spark.createDataFrame(papers[:600], CORPUS_SCHEMA), CFG)).collect()
    assert {tuple(r) for r in got} == brute(papers[:600])


def test_hot_paper_is_found_and_dealt_out(spark, papers):
    pubs = spark.createDataFrame(papers, CORPUS_SCHEMA)
    refs = pubs.filter(F.col("year") >= CFG.min_cite_year).select(F.col("eid").alias("citing"), F.explode("references").alias("cited"))
    hot = C.frequent_ids(refs, "cited")
    assert HOT in hot and len(hot) <= C.HOT_PAPERS
    size = lambda salting: sorted(
        r["count"] for r in refs.withColumn("salt", salting.many("cited", "citing")).repartition(16, "cited", "salt")
        .groupBy(F.spark_partition_id()).count().collect())
    plain, dealt = size(C.Salting([])), size(C.Salting(hot))
    assert sum(plain) == sum(dealt) and plain[-1] > 3 * plain[8] and dealt[-1] <= 3 * dealt[8]


def test_sketch_never_returns_too_many(spark):
    even = spark.range(5000).select((F.col("id") % 2500).alias("c"))
    assert C.frequent_ids(even, "c") == []
    assert C.frequent_ids(spark.createDataFrame([], "c long"), "c") == []


def test_no_long_list_travels(spark, papers):
    pubs = spark.createDataFrame(papers, CORPUS_SCHEMA)
    assert pubs.select(F.max(F.size(C._short_list(pubs)))).first()[0] <= C.FEW


def test_references_that_leave_the_corpus_are_dropped_early(spark, papers):
    pubs = spark.createDataFrame(papers, CORPUS_SCHEMA)
    want = brute(papers)
    for bits in (15, 20, 27):  # a full bitmap drops little, and nothing that counts
        assert {tuple(r) for r in edges(C.citing_edges_base(pubs, CFG, outside_bits=bits)).collect()} == want
    refs = C.references_of(C._references(pubs, CFG))
    kept = C._inside(refs, pubs, 27)
    assert kept.columns == refs.columns and len(want) <= kept.count() < refs.count()
    text = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "Python" not in text


def test_staged_edges_are_written_once(spark):
    """A run reads its edges from the resolved references; they are not copied to a stage of their own."""
    import __spark_entry__ as E
    from conftest import SF_SMALL

    staged, plain = E._run(spark, SF_SMALL), E._run(spark, SF_SMALL, stage=False)
    assert not any("/stages/edges_" in f and "long_lists" not in f for f in staged.edges.inputFiles())
    assert any("/stages/references_" in f for f in staged.edges.inputFiles())
    cols = ["citing", "cited", "is_self", "is_disc"]
    assert sorted(map(tuple, staged.edges.select(*cols).collect())) == sorted(map(tuple, plain.edges.select(*cols).collect()))
