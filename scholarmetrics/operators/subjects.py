"""Subjects of papers and the dominant subjects of each author."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import is_core, ratio
from ..sources.io import write_buckets


def with_paper_subject(papers: DataFrame, smc: DataFrame, cfg: Config) -> DataFrame:
    """2019: ``papers`` (eid, publication_type, ...) with the subject from the per-paper map. Only
    core types keep the subfield; field and domain are kept for every type, as the subject
    volumes count them."""
    return papers.join(smc.select("eid", "subfield", "field", "domain"), "eid", "left").withColumn(
        "subfield", F.when(is_core("publication_type", cfg), F.col("subfield")))


def with_journal_subject(papers: DataFrame, journal_map: DataFrame, tree: DataFrame, cfg: Config) -> DataFrame:
    """2017: ``papers`` (srcid, publication_type, ...) with the subject of their journal; non-core
    types get none."""
    return (
        papers.join(journal_map.select("srcid", "subfield_code"), "srcid", "left")
        .withColumn("subfield_code", F.when(is_core("publication_type", cfg), F.col("subfield_code")))
        .join(tree.select("subfield_code", "subfield", "field_code", "field"), "subfield_code", "left")
    )


def paper_subject(pubs: DataFrame, smc: DataFrame, cfg: Config) -> DataFrame:
    """Subject per paper, 2019."""
    return with_paper_subject(pubs.select("eid", "publication_type"), smc, cfg).select(
        "eid", "publication_type", "subfield", "field", "domain")


def journal_subject(pubs: DataFrame, journal_map: DataFrame, tree: DataFrame, cfg: Config) -> DataFrame:
    """Subject per paper, 2017."""
    papers = pubs.select("eid", "publication_type", F.col("source.srcid").alias("srcid"))
    return with_journal_subject(papers, journal_map, tree, cfg).select(
        "eid", "publication_type", "subfield_code", "subfield", "field_code", "field")


def subject_dictionary(smc: DataFrame) -> DataFrame:
    """subfield -> field, domain (deterministic: the smallest label if a subfield
    ever maps to more than one)."""
    return smc.groupBy("subfield").agg(F.min("field").alias("field"), F.min("domain").alias("domain"))


def subject_volume(auth: DataFrame, key: str = "subfield") -> DataFrame:
    """Per (author, subject): the author's slots in the subject, and the slots of
    all given authors in that subject. NULL is a subject of its own here."""
    return _volume(auth.groupBy("auid", key).agg(F.count(F.lit(1)).alias("n")), key)


def _volume(counts: DataFrame, key: str) -> DataFrame:
    """The same from counts ``n`` per author and (at least) ``key``."""
    mine = counts.groupBy("auid", key).agg(F.sum("n").alias("n_author"))
    overall = counts.groupBy(key).agg(F.sum("n").alias("n_overall"))
    # one row per subject, so the classification bounds the broadcast; a join that is planned as a
    # shuffle first would deal every author's counts to a few subjects
    o = F.broadcast(overall.select(F.col(key).alias("_k"), "n_overall"))
    return mine.join(o, mine[key].eqNullSafe(o["_k"]), "left").drop("_k")


def _ranked(counts: DataFrame, key: str) -> DataFrame:
    """Subjects of each author ranked: classified first, own volume desc, overall
    volume asc (the rarer subject wins a tie), then key asc. The window holds at
    most (number of subjects + 1) rows per author."""
    vol = _volume(counts, key)
    w = Window.partitionBy("auid").orderBy(
        F.col(key).isNull().asc(), F.col("n_author").desc(), F.col("n_overall").asc(), F.col(key).asc()
    )
    return vol.withColumn("r", F.dense_rank().over(w)).filter(F.col("r") <= 2)


def author_subjects(
    auth: DataFrame, cfg: Config, subfield: str = "subfield", field: str = "field"
) -> DataFrame:
    """Per author: first and second subfield, first field, each with its share of
    the author's classified slots (slots with a field). Subjects are assigned only
    with at least ``min_classified`` classified slots; a fraction is NULL where its
    subject is NULL."""
    # slots per (author, subfield, field), written once by author: all five aggregates read these few
    # rows and not the authorship fact, and only those per subject shuffle
    counts = write_buckets(auth.groupBy("auid", subfield, field).agg(F.count(F.lit(1)).alias("n")), "subject_counts", "auid")
    classified = counts.groupBy("auid").agg(F.sum(F.when(F.col(field).isNotNull(), F.col("n")).otherwise(0)).alias("n_classified"))
    sf = _ranked(counts, subfield).groupBy("auid").agg(
        F.max(F.when(F.col("r") == 1, F.col(subfield))).alias("sf1"),
        F.max(F.when(F.col("r") == 1, F.col("n_author"))).alias("sf1_n"),
        F.max(F.when(F.col("r") == 2, F.col(subfield))).alias("sf2"),
        F.max(F.when(F.col("r") == 2, F.col("n_author"))).alias("sf2_n"),
    )
    fd = _ranked(counts, field).groupBy("auid").agg(
        F.max(F.when(F.col("r") == 1, F.col(field))).alias("f1"),
        F.max(F.when(F.col("r") == 1, F.col("n_author"))).alias("f1_n"),
    )
    ok = F.col("n_classified") >= cfg.min_classified

    def pick(subj, n):
        return F.when(ok, F.col(subj)), F.when(ok & F.col(subj).isNotNull(), ratio(n, "n_classified"))

    s1, s1f = pick("sf1", "sf1_n")
    s2, s2f = pick("sf2", "sf2_n")
    f1, f1f = pick("f1", "f1_n")
    return classified.join(sf, "auid", "left").join(fd, "auid", "left").select(
        "auid",
        s1.alias("sm_subfield_1"),
        s1f.alias("sm_subfield_1_frac"),
        s2.alias("sm_subfield_2"),
        s2f.alias("sm_subfield_2_frac"),
        f1.alias("sm_field"),
        f1f.alias("sm_field_frac"),
        "n_classified",
    )
