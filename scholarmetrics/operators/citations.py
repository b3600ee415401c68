"""The citation graph: edges, self-citation flags, citations per paper.

A reference finds its cited paper in one shuffle join. Author lists of at most ``FEW``
authors, a bounded width, take part in it and settle whether the two papers share an author.
A longer list never travels: the authors of the edge's other paper become rows (citing,
cited, author), and one that matches an author slot of the long paper makes the edge a
self-citation. A paper with thousands of authors thus costs one row a slot, with a key that
is spread by author, not an array on each of its edges.

Papers cited by a large share of all references (at most ``HOT_PAPERS``, found by a mergeable
frequent-items sketch of fixed size) are salted explicitly: their references are dealt to
``SALTS`` partitions by the citing paper, and their own rows are copied to each. The sketch
decides where rows go, never what is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import as_long_ids, shares_author
from ..functions.membership import may_hold
from ..sources.io import write_once


def flag_members(df: DataFrame, col: str, members: DataFrame, name: str) -> DataFrame:
    """Add ``name`` = 1 when ``df[col]`` is in the one-column ``members`` frame, else 0
    (NULL keys are not members)."""
    m = members.select(F.col(members.columns[0]).alias("_member")).distinct().withColumn("_hit", F.lit(1))
    return (
        df.join(m, F.col(col) == F.col("_member"), "left")
        .withColumn(name, F.coalesce(F.col("_hit"), F.lit(0)))
        .drop("_member", "_hit")
    )


FEW = 16  # authors of a list that travels with an edge
# papers with at least 1 / HOT_PAPERS of all references; a sketch of TRACKED items finds them
HOT_PAPERS, TRACKED, SALTS = 1000, 1 << 13, 64


def frequent_ids(df: DataFrame, col: str) -> list[int]:
    """The ids that hold at least 1 / HOT_PAPERS of the rows: at most HOT_PAPERS."""
    r = df.agg(F.expr(f"approx_top_k({col}, {HOT_PAPERS}, {TRACKED})").alias("top"), F.count(F.col(col)).alias("n")).first()
    return [t["item"] for t in r["top"] or [] if t["count"] * HOT_PAPERS >= r["n"]]


class Salting:
    """Deals the rows of hot ids to SALTS partitions: ``many`` gives a row of the large side its salt,
    ``one`` copies a row of the other side to every salt of its id."""

    def __init__(self, hot: list[int]):
        self.hot = hot

    def many(self, key: str, spread: str) -> Column:
        salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
        return F.when(F.col(key).isin(self.hot), salt).otherwise(F.lit(0)) if self.hot else F.lit(0)

    def one(self, key: str) -> Column:
        every = F.sequence(F.lit(0), F.lit(SALTS - 1))
        return F.explode(F.when(F.col(key).isin(self.hot), every).otherwise(F.array(F.lit(0))) if self.hot else F.array(F.lit(0)))


def _references(pubs: DataFrame, cfg: Config) -> DataFrame:
    return pubs.filter(F.col("year") >= cfg.min_cite_year)


def _short_list(p: DataFrame) -> Column:
    """The paper's author ids; empty where it has none, NULL where they are more than FEW."""
    few = F.coalesce(F.size("au"), F.lit(0)) <= FEW
    return F.when(few, F.coalesce(as_long_ids("au.auid"), F.array().cast("array<bigint>")))


def references_of(papers: DataFrame) -> DataFrame:
    """(citing, citing_srcid, mine, cited): every distinct reference, with the citing paper's short author list."""
    return papers.select(
        F.col("eid").alias("citing"), F.col("source.srcid").alias("citing_srcid"), _short_list(papers).alias("mine"),
        F.explode(F.array_distinct("references")).alias("cited"))


def _inside(refs: DataFrame, pubs: DataFrame, bits: int) -> DataFrame:
    """``refs`` without most of those that leave the corpus, dropped before any shuffle."""
    hashed = refs.withColumn("_h", F.xxhash64("cited"))
    return may_hold(hashed, "_h", pubs.select(F.xxhash64("eid").alias("h")), bits, "_in").filter("_in").drop("_h", "_in")


def _resolved(refs: DataFrame, pubs: DataFrame, salting: Salting, how: str = "inner") -> DataFrame:
    """(citing, cited, citing_srcid, is_self, short, long, found): the references (``references_of``) inside the
    corpus, or with ``how`` = "left" all of them. is_self is NULL where an author list is too long to
    travel; such an edge has the id of that paper (the cited one, if both are) in ``long`` and
    the other's authors, if they are few, in ``short``."""
    refs = refs.withColumn("salt", salting.many("cited", "citing"))
    papers = pubs.select(F.col("eid").alias("cited"), _short_list(pubs).alias("theirs"), F.lit(True).alias("found"), salting.one("eid").alias("salt"))
    both = F.col("mine").isNotNull() & F.col("theirs").isNotNull()
    return refs.join(papers, ["cited", "salt"], how).select(
        "citing", "cited", "citing_srcid", F.when(both, shares_author("mine", "theirs").cast("int")).alias("is_self"),
        F.when(~both, F.coalesce("mine", "theirs")).alias("short"),
        F.when(~both, F.when(F.col("theirs").isNull(), F.col("cited")).otherwise(F.col("citing"))).alias("long"),
        F.coalesce("found", F.lit(False)).alias("found"))


def _with_flags(resolved: DataFrame, pubs: DataFrame, salting: Salting) -> DataFrame:
    """(citing, cited, is_self, citing_srcid) of ``_resolved`` edges that were found."""
    return settled(resolved).unionByName(_flag_by_rows(resolved.filter(F.col("long").isNotNull()), pubs, salting)).select(
        "citing", "cited", "is_self", "citing_srcid")


def settled(resolved: DataFrame) -> DataFrame:
    """The edges of ``resolved_references`` that the short author lists settle."""
    return resolved.filter(F.col("long").isNull()).select("citing", "cited", "citing_srcid", "is_self")


def flagged_by_rows(resolved: DataFrame, pubs: DataFrame) -> DataFrame:
    """The other edges of ``resolved_references``, those with a long paper."""
    rows = resolved.filter(F.col("long").isNotNull())
    return _flag_by_rows(rows, pubs, Salting(frequent_ids(rows, "long")))


def _flag_by_rows(edges: DataFrame, pubs: DataFrame, salting: Salting) -> DataFrame:
    """The edges with a ``long`` paper, with is_self: 1 where an author of the other paper has a slot on it."""
    slots = pubs.filter(F.size("au") > FEW).select("eid", F.explode(F.array_distinct(as_long_ids("au.auid"))).alias("auid")).filter(F.col("auid").isNotNull())
    keys = ["citing", "cited", "citing_srcid", "long"]
    one = edges.filter(F.col("short").isNotNull()).select(*keys, F.explode_outer("short").alias("auid"))
    two = edges.filter(F.col("short").isNull()).join(slots.withColumnRenamed("eid", "citing"), "citing", "left").select(*keys, "auid")
    rows = one.unionByName(two).withColumn("salt", salting.many("long", "citing"))
    theirs = slots.select(F.col("eid").alias("long"), "auid", salting.one("eid").alias("salt"), F.lit(1).alias("hit"))
    return rows.join(theirs, ["long", "auid", "salt"], "left").groupBy("citing", "cited", "citing_srcid").agg(
        F.coalesce(F.max("hit"), F.lit(0)).alias("is_self"))


def citing_edges_base(pubs: DataFrame, cfg: Config, outside_bits: int | None = None) -> DataFrame:
    """One row per distinct (citing, cited) pair: the citing paper is from
    ``min_cite_year`` on (no upper bound), the cited paper is in the corpus (any
    year); ``is_self`` = citing and cited share a known author; ``citing_srcid``
    = journal of the citing paper. Depends on ``min_cite_year`` only.

    ``outside_bits``: drop references that leave the corpus before the shuffle, by a bitmap of
    2 ** outside_bits bits of the corpus ids (27: 16 MB). Worth it where many do."""
    found = write_once(resolved_references(pubs, cfg, outside_bits), "references")  # read twice
    return settled(found).unionByName(flagged_by_rows(found, pubs)).select("citing", "cited", "is_self", "citing_srcid")


def resolved_references(pubs: DataFrame, cfg: Config, outside_bits: int | None = None) -> DataFrame:
    """The references inside the corpus with is_self where the author lists are short (``_resolved``): to be
    written once, for ``settled`` and ``flagged_by_rows`` to read."""
    citing = _references(pubs, cfg)
    salting = Salting(frequent_ids(citing.select(F.explode("references").alias("cited")), "cited"))
    refs = references_of(citing)
    if outside_bits is not None:
        refs = _inside(refs, pubs, outside_bits)
    return _resolved(refs, pubs, salting).drop("found")


def with_discontinued(base: DataFrame, disc: DataFrame) -> DataFrame:
    """Edges with ``is_disc`` = the citing paper's journal is discontinued (a small
    journal list is broadcast by its size, so the edges are not shuffled)."""
    return flag_members(base, "citing_srcid", disc, "is_disc").select(
        "citing", "cited", "is_self", F.col("is_disc").cast("int").alias("is_disc")
    )


def citing_edges(pubs: DataFrame, disc: DataFrame, cfg: Config) -> DataFrame:
    """Citing edges with self-citation and discontinued-journal flags."""
    return with_discontinued(citing_edges_base(pubs, cfg), disc)


def self_citations(edges: DataFrame) -> DataFrame:
    """The self-citation edges (citing and cited paper share an author)."""
    return edges.filter(F.col("is_self") == 1).select("citing", "cited")


def paper_citations(edges: DataFrame) -> DataFrame:
    """Per cited paper: citations with and without self-citations, self-citations,
    and citations from discontinued journals (partial + final hash aggregate)."""
    return edges.groupBy(F.col("cited").alias("eid")).agg(
        F.count(F.lit(1)).alias("n_cit"),
        F.sum("is_self").cast("long").alias("n_self"),
        (F.count(F.lit(1)) - F.sum("is_self")).cast("long").alias("n_cit_ns"),
        F.sum("is_disc").cast("long").alias("n_cit_disc"),
    )


def discontinued_flags(pubs: DataFrame, edges: DataFrame, disc: DataFrame) -> DataFrame:
    """Per paper: published in a discontinued journal (0/1) and citations received
    from papers in discontinued journals."""
    papers = flag_members(pubs.select("eid", F.col("source.srcid").alias("srcid")), "srcid", disc, "is_disc_source")
    from_disc = edges.filter(F.col("is_disc") == 1).groupBy(F.col("cited").alias("eid")).agg(
        F.count(F.lit(1)).alias("n_cit_disc")
    )
    return papers.join(from_disc, "eid", "left").select(
        "eid", "is_disc_source", F.coalesce("n_cit_disc", F.lit(0)).cast("long").alias("n_cit_disc")
    )
