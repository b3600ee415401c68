"""Authorship facts: one row per (paper, author slot) with the paper's counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import as_long_ids, is_core
from .citations import flag_members


def valid_author(auid_col: str, cfg: Config):
    c = F.col(auid_col).isNotNull()
    if cfg.auid_floor is not None:
        c = c & (F.col(auid_col) > cfg.auid_floor)
    return c


def authorship(
    pubs: DataFrame,
    cites: DataFrame,
    disc: DataFrame,
    cfg: Config,
    with_subjects: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Author slots of papers up to ``max_year`` (no lower bound), placeholder and
    malformed author ids removed. Citation counts are joined, and subjects added
    by ``with_subjects``, per paper before the author array is exploded; the
    corpus is scanned once.

    ``n_authors`` counts every slot of the paper, placeholders included; a
    repeated author keeps both slots, and ``repeats`` marks the papers that have one.
    """
    # only two flat lists of the author structs travel through the joins; built from the
    # nested columns so the parquet reader prunes the rest (names, initials)
    papers = pubs.filter(F.col("year") <= cfg.max_year).select(
        "eid", "year", "publication_type", F.col("source.srcid").alias("srcid"),
        F.size("au").cast("int").alias("n_authors"),
        (F.size(F.array_distinct("au.auid")) < F.size("au")).alias("repeats"),
        as_long_ids("au.auid").alias("_auids"), F.col("au.authorseq").alias("_seqs"),
    )
    papers = flag_members(papers, "srcid", disc, "is_disc_source")
    papers = papers.join(cites, "eid", "left")
    given = papers.columns
    if with_subjects is not None:
        papers = with_subjects(papers)
    extra = [c for c in papers.columns if c not in given]
    slots = papers.select(
        "eid", "year", "publication_type", "srcid", "is_disc_source",
        "n_authors",
        F.coalesce("n_cit", F.lit(0)).cast("long").alias("cites_ws"),
        F.coalesce("n_cit_ns", F.lit(0)).cast("long").alias("cites_ns"),
        F.coalesce("n_cit_disc", F.lit(0)).cast("long").alias("cites_disc"),
        "repeats",
        *extra,
        F.explode(F.arrays_zip(F.col("_auids").alias("auid"), F.col("_seqs").alias("authorseq"))).alias("a"),
    )
    return (
        slots.withColumns({"auid": F.col("a.auid"), "authorseq": F.col("a.authorseq")})
        .drop("a")
        .filter(valid_author("auid", cfg))
    )


def eligible_authors(auth: DataFrame, cfg: Config) -> DataFrame:
    """Authors with at least ``min_core_papers`` core-type slots (up to max_year)."""
    return (
        auth.groupBy("auid")
        .agg(
            F.count(F.lit(1)).alias("n_slots"),
            F.count(F.when(is_core("publication_type", cfg), F.col("eid"))).alias("n_core"),
        )
        .filter(F.col("n_core") >= cfg.min_core_papers)
    )


def eligible_slots(auth: DataFrame, cfg: Config) -> DataFrame:
    """Authorship rows of the ``eligible_authors`` (no columns added). An author's core slots are counted
    beside its rows, so ``auth`` is computed and shuffled once; a long group spills."""
    core = is_core("publication_type", cfg) & F.col("eid").isNotNull()  # moves with the rows: a flag, not the id
    n_core = F.count(F.when(core, F.lit(True))).over(Window.partitionBy("auid"))
    return auth.withColumn("_n_core", n_core).filter(F.col("_n_core") >= cfg.min_core_papers).drop("_n_core")


def dup_check(df: DataFrame, key: list[str] | str) -> DataFrame:
    """Keys that occur more than once, with their count (empty when unique)."""
    key = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
