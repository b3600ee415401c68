"""Incremental refresh: the citation graph of a newer dated snapshot from that of the last one.

A run leaves a ``GraphState``: its edges, its references that left the corpus, and a
fingerprint of each paper. The next snapshot is compared by fingerprint (two narrow columns a
paper), and only what changed is worked on:

* added and changed papers have their references exploded anew;
* references of other papers are looked at again only where the cited paper was added,
  changed or removed: such a reference is an old edge or an old outside reference;
* everything else is carried over as it stands.

Papers, edges and outside references are selected by a bitmap of a fixed size before any shuffle,
so the unchanged part of the corpus and of the graph is scanned for its ids and never moved. Citation counts are sums, so they follow
by adding what came and subtracting what went.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.membership import may_hold
from ..sources.io import write_once
from . import citations as C

BITS = 27  # the bitmaps that select papers: 16 MB

EDGE = ("citing", "cited", "is_self", "citing_srcid")
OUTSIDE = ("citing", "cited", "citing_srcid")


@dataclass(frozen=True)
class GraphState:
    edges: DataFrame  # citing, cited, is_self, citing_srcid
    outside: DataFrame  # citing, cited, citing_srcid: references that leave the corpus
    papers: DataFrame  # eid, f1, f2: fingerprint of what the graph takes from each paper


@dataclass(frozen=True)
class Refreshed:
    state: GraphState
    went: DataFrame  # edges of the last state that no longer hold as they were
    came: DataFrame  # edges that the last state did not have as they are


def fingerprints(pubs: DataFrame) -> DataFrame:
    """128 bits of each paper's year, journal, references and author ids."""
    parts = ["year", F.col("source.srcid"), "references", F.col("au.auid")]
    return pubs.select("eid", F.xxhash64(F.lit(1), *parts).alias("f1"), F.xxhash64(F.lit(2), *parts).alias("f2"))


def full_state(pubs: DataFrame, cfg: Config) -> GraphState:
    """The state of a snapshot, from all of its papers."""
    refs = C.references_of(C._references(pubs, cfg))
    salting = C.Salting(C.frequent_ids(refs, "cited"))
    resolved = write_once(C._resolved(refs, pubs, salting, "left"), "references")
    edges = C._with_flags(resolved.filter("found"), pubs, salting)
    return _written(edges, resolved.filter(~F.col("found")), pubs)


def _written(edges: DataFrame, outside: DataFrame, pubs: DataFrame) -> GraphState:
    return GraphState(write_once(edges.select(*EDGE), "edges"), write_once(outside.select(*OUTSIDE), "outside"),
                      write_once(fingerprints(pubs), "fingerprints"))


def changes(old: DataFrame, pubs: DataFrame) -> DataFrame:
    """(eid, kind): papers added, removed or changed since the fingerprints ``old``."""
    new = fingerprints(pubs)
    kind = (F.when(F.col("o.f1").isNull(), "added").when(F.col("n.f1").isNull(), "removed")
            .when((F.col("o.f1") != F.col("n.f1")) | (F.col("o.f2") != F.col("n.f2")), "changed"))
    both = old.select("eid", F.struct("f1", "f2").alias("o")).join(new.select("eid", F.struct("f1", "f2").alias("n")), "eid", "full")
    return both.select("eid", kind.alias("kind")).filter(F.col("kind").isNotNull())


def _papers(pubs: DataFrame, ids: DataFrame) -> DataFrame:
    """The papers of the one-column frame ``ids``; only rows that its bitmap may hold are shuffled."""
    near = may_hold(pubs.withColumn("_h", F.xxhash64("eid")), "_h", ids.select(F.xxhash64(ids.columns[0]).alias("h")), BITS, "_in")
    return near.filter("_in").drop("_h", "_in").join(ids.toDF("eid").distinct(), "eid", "left_semi")


def _near(df: DataFrame, ids: dict[str, DataFrame], name: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` that may have a column's value among its one-column frame in ``ids``, written once,
    and the others, which surely have none; only the first need a join."""
    flags = []
    marked = df
    for side, values in ids.items():
        flags.append(f"_in_{side}")
        hashed = marked.withColumn("_h", F.xxhash64(side))
        marked = may_hold(hashed, "_h", values.select(F.xxhash64(values.columns[0]).alias("h")), BITS, flags[-1]).drop("_h")
    hit = F.greatest(*flags) if len(flags) > 1 else F.col(flags[0])
    return write_once(marked.filter(hit).drop(*flags), name), marked.filter(~hit).drop(*flags)


def refresh(state: GraphState, pubs: DataFrame, cfg: Config) -> Refreshed:
    """The state of the snapshot ``pubs``, equal to ``full_state`` of it (the same ``min_cite_year``)."""
    diff = write_once(changes(state.papers, pubs), "changes")
    touched = diff.select("eid")
    by = lambda df, side, ids, how: df.join(ids.toDF(side), side, how)
    added = diff.filter(F.col("kind") == "added").select("eid")
    present = diff.filter(F.col("kind") != "removed").select("eid")

    # references of unchanged papers whose other end moved
    near_edges, far_edges = _near(state.edges, {"citing": touched, "cited": touched}, "near_edges")
    near_out, far_out = _near(state.outside, {"citing": touched, "cited": added}, "near_outside")
    steady = by(near_edges, "citing", touched, "left_anti")
    steady_out = by(near_out, "citing", touched, "left_anti")
    moved = by(steady, "cited", touched, "left_semi").select(*OUTSIDE).unionByName(
        by(steady_out, "cited", added, "left_semi").select(*OUTSIDE))
    moved = write_once(moved, "moved")
    lists = _papers(pubs, moved.select("citing")).select(F.col("eid").alias("citing"), F.struct(C._short_list(pubs).alias("mine")).alias("l"))
    again = moved.join(lists, "citing").select("citing", "citing_srcid", F.col("l.mine").alias("mine"), "cited")
    # all references of added and changed papers
    refs = write_once(C.references_of(C._references(_papers(pubs, present), cfg)).unionByName(again), "references")

    slim = pubs.select("eid", F.arrays_zip(F.col("au.auid").alias("auid")).alias("au"))  # the ids of authors, not their names
    near = write_once(_papers(slim, refs.select("cited").unionByName(refs.select("citing").toDF("cited"))), "near")
    salting = C.Salting(C.frequent_ids(refs, "cited"))
    resolved = write_once(C._resolved(refs, near, salting, "left"), "resolved")
    came = write_once(C._with_flags(resolved.filter("found"), near, salting).select(*EDGE), "came")
    kept = far_edges.select(*EDGE).unionByName(by(steady, "cited", touched, "left_anti").select(*EDGE))
    outside = far_out.select(*OUTSIDE).unionByName(by(steady_out, "cited", added, "left_anti").select(*OUTSIDE)).unionByName(
        resolved.filter(~F.col("found")).select(*OUTSIDE))
    new = _written(kept.unionByName(came), outside, pubs)
    went = by(near_edges, "citing", touched, "left_semi").select(*EDGE).unionByName(by(steady, "cited", touched, "left_semi").select(*EDGE))
    return Refreshed(new, went, came)


def refreshed_citations(old: DataFrame, r: Refreshed, disc: DataFrame) -> DataFrame:
    """``paper_citations`` of the new state from those of the last one (same discontinued journals)."""
    count = lambda edges: C.paper_citations(C.with_discontinued(edges, disc))
    sums = [c for c in old.columns if c != "eid"]
    less = count(r.went).select("eid", *[(-F.col(c)).alias(c) for c in sums])
    total = old.unionByName(count(r.came)).unionByName(less).groupBy("eid").agg(*[F.sum(c).cast("long").alias(c) for c in sums])
    return total.filter(F.col("n_cit") > 0)
