"""A newer snapshot refreshed from the last one equals a full run over it."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from scholarmetrics import Config
from scholarmetrics.operators import citations as C
from scholarmetrics.operators import refresh as RF
from scholarmetrics.sources.io import CORPUS_SCHEMA

CFG = Config(name="t", min_year=1990, min_cite_year=1995, max_year=2000)


def paper(r, eid, n):
    refs = [r.randrange(n) for _ in range(r.randrange(6))] + ([0] if eid % 3 == 0 else [])
    authors = None if r.random() < 0.05 else [str(r.randrange(60)) for _ in range(r.choice([1, 2, 4, 20]))]
    year = r.choice([1993, 1995, 1998, 2001])
    au = authors and [(a, i + 1, "S", "G", "I", "X", "X") for i, a in enumerate(authors)]
    return (eid, year, dt.datetime(year, 6, 1), "ar", (eid % 7,), refs if eid % 11 else None, au, None, None)


def snapshots(seed, n=160):
    """Old and new papers: some added (cited before they were there), removed and changed."""
    r = random.Random(seed)
    every = {e: paper(r, e, n + 40) for e in range(n)}
    old = {e: p for e, p in every.items() if e % 7 != 3}
    new = {e: p for e, p in every.items() if e % 13 != 5}
    for e in list(new):
        if e % 17 == 4:
            new[e] = paper(r, e, n + 40)
    # names, dates and affiliations may change without touching the graph
    for e in list(new):
        if e % 19 == 1:
            new[e] = (*new[e][:2], dt.datetime(2020, 1, 1), *new[e][3:])
    return list(old.values()), list(new.values())


def rows(df, cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


@pytest.fixture(scope="module", params=[1, 2])
def case(spark, request):
    old, new = snapshots(request.param)
    make = lambda p: spark.createDataFrame(p, CORPUS_SCHEMA).repartition(3)
    return old, new, make(old), make(new)


def test_refresh_equals_a_full_run(spark, case, monkeypatch):
    old, new, before, after = case
    state = RF.full_state(before, CFG)
    assert rows(state.edges, RF.EDGE) == rows(C.citing_edges_base(before, CFG), RF.EDGE)
    exploded = []
    real = C.references_of
    monkeypatch.setattr(C, "references_of", lambda p: exploded.append({x.eid for x in p.select("eid").collect()}) or real(p))
    r = RF.refresh(state, after, CFG)
    was, now = {p[0]: p for p in old}, {p[0]: p for p in new}
    part = lambda p: (p[1], p[4], p[5], p[6] and [a[0] for a in p[6]])
    touched = {e for e in now if e not in was or part(was[e]) != part(now[e])}
    assert len(exploded) == 1 and exploded[0] == {e for e in touched if now[e][1] >= CFG.min_cite_year}  # nothing else was exploded
    monkeypatch.undo()
    full = RF.full_state(after, CFG)
    assert rows(r.state.edges, RF.EDGE) == rows(full.edges, RF.EDGE) == rows(C.citing_edges_base(after, CFG), RF.EDGE)
    assert rows(r.state.outside, RF.OUTSIDE) == rows(full.outside, RF.OUTSIDE)
    assert rows(r.state.papers, ("eid", "f1", "f2")) == rows(full.papers, ("eid", "f1", "f2"))
    disc = spark.createDataFrame([(2,), (5,)], "srcid long")
    count = lambda e: C.paper_citations(C.with_discontinued(e, disc))
    cols = ("eid", "n_cit", "n_self", "n_cit_ns", "n_cit_disc")
    assert rows(RF.refreshed_citations(count(state.edges), r, disc), cols) == rows(count(full.edges), cols)


def test_same_snapshot_again_moves_nothing(spark, case):
    _, _, before, _ = case
    state = RF.full_state(before, CFG)
    r = RF.refresh(state, before, CFG)
    assert r.came.isEmpty() and r.went.isEmpty() and rows(r.state.edges, RF.EDGE) == rows(state.edges, RF.EDGE)


def test_from_and_to_an_empty_snapshot(spark, case):
    _, _, before, _ = case
    none = before.filter("eid < 0")
    state = RF.full_state(none, CFG)
    r = RF.refresh(state, before, CFG)
    assert rows(r.state.edges, RF.EDGE) == rows(C.citing_edges_base(before, CFG), RF.EDGE)
    back = RF.refresh(r.state, none, CFG)
    assert back.state.edges.isEmpty() and back.state.outside.isEmpty() and back.state.papers.isEmpty()


def test_changes(spark, case):
    old, new, before, after = case
    got = {r.eid: r.kind for r in RF.changes(RF.fingerprints(before), after).collect()}
    a, b = {p[0] for p in old}, {p[0] for p in new}
    assert {e for e, k in got.items() if k == "added"} == b - a and {e for e, k in got.items() if k == "removed"} == a - b


def test_unchanged_papers_are_not_shuffled(spark, case):
    _, _, before, _ = case
    ids = before.filter("eid = 4").select("eid")
    text = RF._papers(before, ids)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and RF._papers(before, ids).count() == 1


def test_unchanged_edges_are_not_joined(spark):
    edges = spark.range(2000).select(F.col("id").alias("citing"), (F.col("id") * 7).alias("cited")).unionByName(
        spark.createDataFrame([(5, None)], "citing long, cited long"))
    ids = spark.createDataFrame([(21,), (None,)], "eid long")
    near, far = RF._near(edges, {"citing": ids, "cited": ids}, "near")
    found = {tuple(r) for r in near.collect()}
    assert {(21, 147), (3, 21)} <= found and len(found) < 10
    assert near.count() + far.count() == 2001 and not {21} & {x for r in far.collect() for x in r}
