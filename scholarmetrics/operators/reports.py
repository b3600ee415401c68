"""Report tables built from the result table and the cut-offs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import percent_label, ratio
from .cutoffs import TOTAL, _pct
from .ordered import ordered_rows, rank_rows

UNASSIGNED = "Unassigned"


def count_label(n: int) -> str:
    """100000 -> '100k'."""
    return f"{n // 1000}k" if n >= 1000 and n % 1000 == 0 else str(n)


def _share_text(col: str) -> Column:
    """A share as percent text with two decimals."""
    return F.when(F.col(col).isNotNull(), F.format_string("%.2f %%", F.round(100 * F.col(col), 2)))


def _published(cfg: Config) -> list[Column]:
    """The published columns of a cut-off report, in their order: counts with their shares, citations
    and composite (three decimals) at each percentile, and the ratios inside the top list."""
    n = count_label(cfg.top_n)
    out = [F.col("auth").alias("#Auth")]
    for col, label, short in (("auth_top_ns", f"top {n} (ns)", f"{n} (ns)"), ("auth_top", f"top {n}", n),
                              ("auth_in_top_list", "in top-list", "top-list")):
        out += [F.col(col).alias(f"#Auth {label}"), percent_label(col, "auth", "%").alias(f"% in {short}")]
    at = [(p, _pct(p)) for p in cfg.percentiles]
    out += [F.col(f"cites_{d}").alias(f"Cites@{d}") for _, d in at]
    out += [F.round(f"c_{d}", 3).alias(f"c@{d}") for _, d in at]
    ratios = [_pct(p) for p in cfg.ratio_percentiles]
    out += [_share_text(f"top_list_selfp_{d}").alias(f"top-list self%@{d}") for d in ratios]
    out += [F.col(f"top_list_cprat_{d}").alias(f"top-list cprat@{d}") for d in ratios]
    return out + [F.col(f"top_list_cprat_ns_{d}").alias(f"top-list cprat@{d} (ns)") for d in ratios]


def field_report(cut: DataFrame, dictionary: DataFrame, cfg: Config) -> DataFrame:
    """Per field plus TOTAL, as published: counts, shares (text), cut-offs; unclassified
    authors form the 'Unassigned' row. Ordered by domain (none last), field, TOTAL last."""
    labels = dictionary.select("domain", F.col("field").alias("_f")).distinct()
    rows = cut.filter(F.col("level").isin("field", "total"))
    out = rows.join(labels, rows["subject"] == labels["_f"], "left").select(
        F.col("domain").alias("Domain"), F.coalesce("subject", F.lit(UNASSIGNED)).alias("Field"), *_published(cfg))
    return out.orderBy(F.coalesce("Domain", F.lit("ZZ")), F.when(F.col("Field") == TOTAL, "ZZ").otherwise(F.col("Field")))


def subfield_report(cut: DataFrame, dictionary: DataFrame, cfg: Config) -> DataFrame:
    """Per subfield plus TOTAL, as published, labelled with field and domain."""
    labels = dictionary.select(F.col("subfield").alias("_s"), "field", "domain")
    rows = cut.filter(F.col("level").isin("subfield", "total"))
    out = rows.join(labels, rows["subject"] == labels["_s"], "left").select(
        F.col("domain").alias("Domain"), F.col("field").alias("Field"),
        F.coalesce("subject", F.lit(UNASSIGNED)).alias("Subfield"), *_published(cfg))
    return out.orderBy(
        F.coalesce("Domain", F.lit("ZZ")), F.col("Field").asc_nulls_first(),
        F.when(F.col("Subfield") == TOTAL, "ZZ").otherwise(F.col("Subfield")),
    )


def subfield_report_2017(cut_lower: DataFrame, tree: DataFrame) -> DataFrame:
    """2017: subfield cut-offs joined (inner) to the subject hierarchy, so the
    unclassified group is not reported."""
    t = tree.select(F.col("field_code").alias("sm22"), F.col("subfield_code").cast("string").alias("_s"))
    rows = cut_lower.filter(F.col("level") == "subfield")
    return rows.join(t, rows["subject"] == t["_s"], "inner").select(
        "sm22", F.col("subject").alias("sm176"), F.col("subject_name").alias("sm176_name"),
        *[c for c in rows.columns if c not in ("level", "subject", "subject_name")],
    )


def dropout_stats(res: DataFrame, cut: DataFrame, cfg: Config) -> DataFrame:
    """One row on how self-citations lift authors: of the authors in the top fraction of their
    subfield with self-citations, the share that leaves it (x1), and the share that leaves
    even the best ``wide_frac`` (x2), without them; and the top-listed authors whose cites per
    citing paper reach their subfield's highest top-list cut-off (x3), with the numbers of
    authors these refer to."""
    highest = f"top_list_cprat_{_pct(max(cfg.ratio_percentiles))}"
    limits = cut.filter(F.col("level") == "subfield").select(F.col("subject").alias("_s"), F.col(highest).alias("_limit"))
    place = lambda v: ratio(f"rank_sm_subfield_1_{v}", "count_sm_subfield_1")
    each = res.join(limits, res["sm_subfield_1"] == limits["_s"], "left").select(
        F.col("top_listed").alias("listed"),
        F.col("sm_subfield_1").isNotNull().alias("classified"),
        F.col("cprat_ws").alias("per_paper"),
        F.coalesce(place("ws") <= cfg.top_frac, F.lit(False)).alias("leads"),
        (place("ns") > cfg.top_frac).alias("leaves"),
        (place("ns") > cfg.wide_frac).alias("falls"),
        F.coalesce(F.col("cprat_ws") >= F.col("_limit"), F.lit(False)).alias("concentrated"),
    )
    n = lambda cond: F.count_if(cond)
    c = F.col
    return each.agg(
        F.count(F.lit(1)).alias("n_authors"), n(c("listed")).alias("n_listed"),
        n(c("listed") & c("classified")).alias("n_listed_classified"),
        n(c("listed") & c("classified") & c("per_paper").isNotNull()).alias("n_listed_with_ratio"),
        n(c("leads")).alias("n_leading"), n(c("leads") & c("leaves")).alias("n_leaving"),
        n(c("leads") & c("falls")).alias("n_falling"), n(c("listed") & c("concentrated")).alias("x3_concentrated"),
    ).withColumns({"x1_leaving_share": ratio("n_leaving", "n_leading"), "x2_falling_share": ratio("n_falling", "n_leading")})


def cprat_percentile(res: DataFrame, subfield: str, cfg: Config, ceiling: float = 4.0) -> DataFrame:
    """Drill-down into one subfield: ascending percentile of cites per citing
    paper (NULL ratios still take the lowest ranks and count in the size), for
    authors below ``ceiling``."""
    s = res.filter(F.col("sm_subfield_1") == subfield)
    r = ordered_rows(s, [], [("cprat_ws", True)], spread=["author_id"])
    return r.filter(F.col("cprat_ws") < ceiling).select(
        "author_id", "cprat_ws",
        F.when(F.col("cprat_ws").isNotNull(), ratio("_rank", "_size")).alias("cprat_perc"),
        "nc_ws", "ncp_ws", "top_listed",
    )


def null_rank(res: DataFrame, col: str, cfg: Config) -> DataFrame:
    """Ranks of a nullable column, ascending and descending, NULL rows unranked
    (ascending puts NULL first, so the first ranked value gets rank #NULL + 1)."""
    r = rank_rows(res.select("author_id", col), [], [(col, True)], "_ra", spread=["author_id"])
    r = rank_rows(r, [], [(col, False)], "_rd", spread=["author_id"])
    has = F.col(col).isNotNull()
    return r.select("author_id", col, F.when(has, F.col("_ra")).alias("rank_asc"), F.when(has, F.col("_rd")).alias("rank_desc"))


def corpus_summary(res: DataFrame) -> DataFrame:
    """Authors in the result and those with a field."""
    return res.agg(F.count(F.lit(1)).alias("n_authors"), F.count("sm_field").alias("n_with_field"))
