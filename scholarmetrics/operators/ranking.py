"""Author profile, global and per-subfield ranks, the top list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import ratio
from .ordered import ordered_rows


def author_profile(scored: DataFrame, names: DataFrame, affiliation: DataFrame, cfg: Config) -> DataFrame:
    """Scored authors with at least ``min_papers`` papers in the span, with name,
    years and affiliation; ``auid`` becomes ``author_id``."""
    return (
        scored.filter(F.col("auid").isNotNull() & (F.col("np") >= cfg.min_papers))
        .join(names, "auid", "left")
        .join(affiliation, "auid", "left")
        .withColumnRenamed("auid", "author_id")
    )


# (result column, value, ranked inside the first subfield)
RANKS = (("rank_ns", "c_ns", False), ("rank_ws", "c_ws", False),
         ("rank_sm_subfield_1_ns", "c_ns", True), ("rank_sm_subfield_1_ws", "c_ws", True))
SUBFIELD_SIZE = "count_sm_subfield_1"


def _with_ranks(p: DataFrame, ranks: tuple, subject: str = "sm_subfield_1") -> DataFrame:
    """``p`` with the given ranks and, with subfield ranks, the subfield's size.

    The values are stacked as narrow (scope, group, value, author) rows and ranked in one
    distributed pass (see ``ordered``), then pivoted back per author with one aggregate.
    Authors without a subfield have no subfield rows."""
    inside = any(i for _, _, i in ranks)
    sub = F.col(subject).cast("string") if inside else F.lit(None).cast("string")
    rows = [
        F.when(sub.isNotNull() if i else F.lit(True),
               F.struct(F.lit(name).alias("scope"), (sub if i else F.lit(None).cast("string")).alias("grp"), F.col(c).alias("value")))
        for name, c, i in ranks
    ]
    stacked = p.select("author_id", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("x")).select("author_id", "x.*")
    ranked = ordered_rows(stacked, ["scope", "grp"], [("value", False)], spread=["author_id"])
    wide = ranked.groupBy("author_id").agg(
        *[F.max(F.when(F.col("scope") == name, F.col("_rank"))).alias(name) for name, _, _ in ranks],
        *([F.max(F.when(F.col("grp").isNotNull(), F.col("_size"))).alias(SUBFIELD_SIZE)] if inside else []),
    )
    return p.join(wide, "author_id", "left")


def global_rank(p: DataFrame, cfg: Config) -> DataFrame:
    """rank_ns / rank_ws: rank by composite c desc over all profiled authors."""
    return _with_ranks(p, RANKS[:2])


def subfield_rank(p: DataFrame, cfg: Config, subject: str = "sm_subfield_1") -> DataFrame:
    """Rank by c (ws, ns) and size inside the author's first subfield; NULL for
    authors without a subfield."""
    return _with_ranks(p, RANKS[2:], subject)


def ranked_result(profile: DataFrame, cfg: Config) -> DataFrame:
    """Profile + global ranks + ratios + subfield ranks + top-list flag; all four
    ranks come from one pass."""
    return citation_ratios(_with_ranks(profile, RANKS)).withColumn("top_listed", top_list_predicate(cfg))


def citation_ratios(p: DataFrame) -> DataFrame:
    """Self-citation share and citations per citing paper (NULL on zero)."""
    return p.withColumns({
        "self_p": ratio(F.col("nc_ws") - F.col("nc_ns"), "nc_ws"),
        "cprat_ns": ratio("nc_ns", "ncp_ns"),
        "cprat_ws": ratio("nc_ws", "ncp_ws"),
    })


def top_list_predicate(cfg: Config) -> Column:
    """In the top N by either rank, or in the top fraction of the first subfield
    by either rank (NULL parts count as false)."""
    frac_ws = F.try_divide(F.col("rank_sm_subfield_1_ws").cast("double"), F.col("count_sm_subfield_1").cast("double"))
    frac_ns = F.try_divide(F.col("rank_sm_subfield_1_ns").cast("double"), F.col("count_sm_subfield_1").cast("double"))
    pred = (
        (F.col("rank_ws") <= cfg.top_n) | (F.col("rank_ns") <= cfg.top_n)
        | (frac_ws <= cfg.top_frac) | (frac_ns <= cfg.top_frac)
    )
    return F.coalesce(pred, F.lit(False))


def top_list(result: DataFrame, cfg: Config) -> DataFrame:
    return result.filter(top_list_predicate(cfg))


def top_n_either(result: DataFrame, cfg: Config) -> DataFrame:
    """2017: top N by either rank (ties kept, so possibly more than N)."""
    return result.filter((F.col("rank_ws") <= cfg.top_n) | (F.col("rank_ns") <= cfg.top_n))


def place_on_scale(new: DataFrame, published: DataFrame) -> DataFrame:
    """Where the composite scores of ``new`` authors would stand in a ``published`` table (both with
    author_id, c_ns, c_ws): ``rank_*`` = 1 + published authors with a higher score (SQL rank: a tie
    takes the published rank), ``percentile_*`` = per cent of the published authors with no higher
    score, and ``n_published_*``; NULL for a NULL score, and no percentile in an empty table.

    An as-of join of two sorted sides without a pair of rows: both are range-partitioned together
    by (variant, score), new rows before published ones of the same score, and a distributed
    running count of the published rows gives every new row the number ahead of it."""
    stack = lambda df, flag: df.select(
        "author_id", F.lit(flag).alias("is_published"),
        F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(f"c_{v}").alias("score")) for v in ("ns", "ws")])).alias("s"),
    ).select("author_id", "is_published", "s.variant", "s.score").filter(F.col("score").isNotNull())
    both = stack(new, 0).unionByName(stack(published, 1))
    run = ordered_rows(both, ["variant"], [("score", False), ("is_published", True)], ["is_published"], spread=["author_id"])
    size = published.agg(*[F.count(f"c_{v}").alias(v) for v in ("ns", "ws")]).first()
    ahead = run.filter(F.col("is_published") == 0).groupBy("author_id").agg(
        *[F.max(F.when(F.col("variant") == v, F.col("_cum_is_published"))).alias(f"_ahead_{v}") for v in ("ns", "ws")])
    cols = {}
    for v in ("ns", "ws"):
        known = F.col(f"_ahead_{v}").isNotNull()
        n = F.lit(size[v]).cast("long")
        cols[f"rank_{v}"] = F.col(f"_ahead_{v}") + 1
        cols[f"percentile_{v}"] = ratio(100 * (n - F.col(f"_ahead_{v}")), n)
        cols[f"n_published_{v}"] = F.when(known, n)
    return new.select("author_id", "c_ns", "c_ws").join(ahead, "author_id", "left").withColumns(cols).drop("_ahead_ns", "_ahead_ws")
