"""Display labels of authors: name, active years, affiliation.

Every "best record per author" choice is a ``max_by`` over a struct of sort
keys inside ``groupBy(auid)``: a partial (map-side) aggregation, so a prolific
author is reduced before the shuffle instead of being sorted in one task.

An affiliation comes from an author's last records alone. Their dates are found first, from two
narrow columns, and a bitmap of a fixed size drops most earlier records before any label moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.membership import may_hold

BITS = 26  # the bitmap that selects an author's last records: 8 MB


def latest_per_key(df: DataFrame, key: list[str] | str, order: list, cols: list[str]) -> DataFrame:
    """One row per key: ``cols`` of the row with the greatest ``order`` tuple
    (columns compared left to right; negate a numeric column for ascending).
    A partial aggregation, not a ranked window over whole rows."""
    key = [key] if isinstance(key, str) else list(key)
    ordering = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"_o{i}") for i, c in enumerate(order)])
    return df.groupBy(*key).agg(F.max_by(F.struct(*cols), ordering).alias("_best")).select(*key, "_best.*")


def _ascending(col: str, name: str) -> list:
    """Sort keys by which ``max_by`` prefers the smallest value, a missing one before all (as an
    ascending sort puts NULL first)."""
    return [F.col(col).isNull().cast("int").alias(f"{name}_null"), (-F.col(col)).alias(name)]


def _slots(pubs: DataFrame, *cols: str) -> DataFrame:
    return pubs.select(*cols, F.explode("au").alias("a")).withColumn("auid", F.col("a.auid").try_cast("long"))


def author_names(pubs: DataFrame) -> DataFrame:
    """Per author id over the whole corpus: display name from the best record (a
    given name present, then latest date, highest eid, highest position), the eid
    of that record, and first and last publication year."""
    s = _slots(pubs, "eid", "year", "datesort").filter(F.col("auid").isNotNull())
    a = F.col("a")
    full = F.coalesce(
        F.concat(a["surname_pn"], F.lit(", "), F.coalesce(a["given_name_pn"], a["initials_pn"])),
        a["indexed_name_pn"],
        a["indexed_name"],
    )
    key = F.struct(
        a["given_name_pn"].isNotNull().cast("int").alias("k1"), F.col("datesort").alias("k2"),
        F.col("eid").alias("k3"), a["authorseq"].alias("k4"),
    )
    best = F.max_by(F.struct(F.col("eid").alias("eid"), full.alias("authfull")), key)
    return (
        s.groupBy("auid")
        .agg(best.alias("b"), F.min("year").alias("firstyr"), F.max("year").alias("lastyr"))
        .select("auid", F.col("b.authfull").alias("authfull"), F.col("b.eid").alias("last_eid_name"), "firstyr", "lastyr")
    )


def _own_links(pubs: DataFrame) -> DataFrame:
    """One row per (author slot, own affiliation link): the author-affiliation links
    are filtered inside the row to the slot's position before exploding, so a
    paper with k authors yields k rows, not k x links."""
    au = F.arrays_zip(F.col("au.auid").alias("auid"), F.col("au.authorseq").alias("authorseq"))  # prunes names
    return (
        pubs.select("eid", "year", "datesort", "af", "au_af", F.explode(au).alias("a"))
        .withColumn("links", F.filter("au_af", lambda l: l["authorseq"] == F.col("a.authorseq")))
        .select("eid", "year", "datesort", "af", "a", F.explode("links").alias("l"))
        .withColumns({
            "auid": F.col("a.auid").try_cast("long"),
            # position past the end (or before the start) -> NULL
            "aff": F.get(F.col("af"), F.col("l.affiliation_seq") - 1),
        })
        .drop("af")
    )


def _last(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` without most of those below their author's greatest ``by`` (NULL is the smallest). All rows
    of the greatest are kept; some others pass the bitmap, so a choice by ``by`` first must follow."""
    last = rows.groupBy("auid").agg(F.max(by).alias(by))
    found = may_hold(rows.withColumn("_h", F.xxhash64("auid", by)), "_h", last.select(F.xxhash64("auid", by).alias("h")), BITS, "_in")
    return found.filter("_in").drop("_h", "_in")


def author_affiliation(pubs: DataFrame, ipr: DataFrame) -> DataFrame:
    """2019: the affiliation an author used most often in the last year with a
    usable affiliation (ties: latest date, then a missing id, then the lowest); name and country from
    its latest record; preferred institution name where known."""
    rows = _own_links(pubs).filter(
        F.col("auid").isNotNull()
        & F.col("aff").isNotNull()
        & F.col("aff.affiliation_organization").isNotNull()
        & (F.size("aff.affiliation_organization") > 0)
    )
    # dealt by author once: both aggregates find an author's rows in one partition
    rows = _last(rows, "year").select(
        "auid", "year", "datesort", "eid", F.col("a.authorseq").alias("authorseq"), F.col("aff.afid").alias("affil_id"),
        F.array_join("aff.affiliation_organization", ", ").alias("affil_name"), F.col("aff.affiliation_tag_country").alias("cntry"),
    ).repartition("auid")
    per_afid = rows.groupBy("auid", "year", "affil_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("datesort").alias("max_datesort"),
        F.max_by(F.struct("affil_name", "cntry"), F.struct("datesort", "eid", "authorseq")).alias("lab"),
    )
    best = per_afid.groupBy("auid").agg(
        F.max_by(
            F.struct("affil_id", "lab", "max_datesort"),
            F.struct("year", "n", "max_datesort", *_ascending("affil_id", "k4")),
        ).alias("b")
    )
    names = ipr.select(F.col("afid").alias("affil_id"), "preferred_name")
    return (
        best.select(
            "auid", F.col("b.affil_id").alias("affil_id"), F.col("b.lab.affil_name").alias("affil_name"),
            F.col("b.lab.cntry").alias("cntry"), F.col("b.max_datesort").alias("max_datesort"),
        )
        .join(names, "affil_id", "left")
        .withColumn("inst_name", F.coalesce("preferred_name", "affil_name"))
        .select("auid", "affil_id", "affil_name", "cntry", "max_datesort", "preferred_name", "inst_name")
    )


def institution_dedupe(inst_map: DataFrame, inst: DataFrame) -> DataFrame:
    """2017: one institution per affiliation id (the lowest id), with its name."""
    one = inst_map.groupBy("afid").agg(F.min("institution_id").alias("institution_id"))
    names = inst.select("institution_id", F.col("name").alias("sv_name"), F.col("country_code").alias("sv_country_code"))
    return one.join(names, "institution_id", "left").select("afid", "institution_id", "sv_name", "sv_country_code")


def author_affiliation_latest(pubs: DataFrame, inst_map: DataFrame, inst: DataFrame) -> DataFrame:
    """2017: the affiliation of the author's latest paper (ties: highest eid, a
    missing affiliation id, the lowest one, lowest link sequence, lowest position), labelled through the
    institution map, else the organisation as printed."""
    rows = _own_links(pubs).filter(F.col("auid").isNotNull()).withColumn("afid", F.explode("aff.affiliation_ids"))
    best = _last(rows, "datesort").groupBy("auid").agg(
        F.max_by(
            F.struct(
                F.col("eid").alias("last_eid_aff"), "afid",
                F.col("aff.affiliation_organization").alias("org"),
                F.col("aff.affiliation_tag_country").alias("country"),
            ),
            F.struct("datesort", "eid", *_ascending("afid", "k3"), *_ascending("l.affiliation_seq", "k4"),
                     *_ascending("a.authorseq", "k5")),
        ).alias("b")
    ).select("auid", "b.*")
    ia = institution_dedupe(inst_map, inst)
    return best.join(ia, "afid", "left").select(
        "auid",
        "last_eid_aff",
        F.col("institution_id").alias("inst_id"),
        F.coalesce("sv_name", F.concat_ws(", ", "org")).alias("inst_name"),
        F.coalesce("sv_country_code", "country").alias("cntry"),
        F.col("afid").alias("affil_id"),
    )
