"""The corpus partitioned by year, and authors placed on a published scale."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from scholarmetrics.operators import authorship as A
from scholarmetrics.operators import citations as C
from scholarmetrics.operators import ranking as R
from scholarmetrics.plans.pipeline import Run
from scholarmetrics.sources import io as IO
from scholarmetrics.sources.fixtures import CAREER, build_inputs


def scans(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x or "Location" in x]


@pytest.fixture(scope="module")
def by_year(spark):
    base = IO.scratch_path(spark, "core")
    path = IO.write_corpus(build_inputs(spark, SF_SMALL).corpus, base, "v1", "full", "20200506")
    return path, IO.read_corpus(spark, base, "v1", "full", "20200506")


def test_same_papers_in_year_folders(spark, by_year):
    path, corpus = by_year
    given = build_inputs(spark, SF_SMALL).corpus
    assert corpus.columns == IO.CORPUS_SCHEMA.names and corpus.schema["year"].dataType == given.schema["year"].dataType
    key = lambda df: df.select("eid", "year", F.xxhash64("references", "au", "af", "au_af", "source", "datesort").alias("h"))
    assert key(corpus).exceptAll(key(given)).isEmpty() and key(given).exceptAll(key(corpus)).isEmpty()
    years = {f.split("/year=")[1].split("/")[0] for f in corpus.inputFiles()}
    assert years == {str(r.year) for r in given.select("year").distinct().collect()}


def test_year_bounds_select_folders(spark, by_year):
    path, corpus = by_year
    i = build_inputs(spark, SF_SMALL)
    run = Run(spark, type(i)(**{**i.tables(), "corpus": corpus}, key="by-year"), CAREER, stage=False)
    # edges: the citing side reads only the years from min_cite_year on
    found = C._resolved(C.references_of(C._references(corpus, CAREER)), corpus, C.Salting([]))
    assert any("PartitionFilters: [isnotnull(year" in s and f">= {CAREER.min_cite_year}" in s for s in scans(found))
    cites = IO.write_once(C.paper_citations(run.edges), "cites")
    fact = A.authorship(corpus, cites, run.disc, CAREER)
    assert any("PartitionFilters: [isnotnull(year" in s and f"<= {CAREER.max_year}" in s for s in scans(fact))


def test_years_chosen_at_run_time_prune_folders(spark, by_year):
    path, corpus = by_year
    years = IO.write_once(spark.createDataFrame([(1996,), (1999,), (1996,)], "y int"), "years").filter("y > 1990")
    some = IO.only_years(corpus, years)
    assert any("dynamicpruning" in s for s in scans(some))
    assert {r.year for r in some.select("year").distinct().collect()} == {1996, 1999}
    assert some.count() == corpus.filter(F.col("year").isin(1996, 1999)).count()


def brute(new, published):
    out = {}
    for a, *scores in new:
        row = []
        for k, s in enumerate(scores):
            known = [p[k + 1] for p in published if p[k + 1] is not None]
            ahead = sum(p > s for p in known) if s is not None else None
            row.append((None, None, None) if s is None else (ahead + 1, 100 * (len(known) - ahead) / len(known) if known else None, len(known)))
        out[a] = tuple(row)
    return out


@pytest.mark.parametrize("n_published", [0, 1, 400])
def test_placement(spark, n_published):
    r = random.Random(n_published)
    score = lambda: r.choice([None, 0.0, 1.5, 3.25, round(r.uniform(0, 6), 1)])
    published = [(10_000 + i, score(), score()) for i in range(n_published)]
    new = [(i, score(), score()) for i in range(150)]
    make = lambda rows: spark.createDataFrame(rows, "author_id long, c_ns double, c_ws double").repartition(3)
    got = R.place_on_scale(make(new), make(published)).collect()
    assert {x.author_id: ((x.rank_ns, x.percentile_ns and pytest.approx(x.percentile_ns), x.n_published_ns),
                          (x.rank_ws, x.percentile_ws and pytest.approx(x.percentile_ws), x.n_published_ws)) for x in got} == brute(new, published)


def test_placing_the_published_authors_gives_their_ranks(spark):
    rows = spark.createDataFrame([(i, float(i % 7), float(-i)) for i in range(50)], "author_id long, c_ns double, c_ws double")
    want = {r.author_id: (r.rank_ns, r.rank_ws) for r in R.global_rank(rows, CAREER).collect()}
    assert {r.author_id: (r.rank_ns, r.rank_ws) for r in R.place_on_scale(rows, rows).collect()} == want
