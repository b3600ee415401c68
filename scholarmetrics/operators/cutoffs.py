"""Percentile cut-offs per subject and in total.

The notebooks rank every metric in a window per subject (five ranks per
grouping, three more for the top-list subset, the TOTAL in one task) and take
a conditional ``min``. Here the result is scanned once: its values become an exact
histogram with one cell per (metric, field, subfield, value), merged map-side, that counts
all authors, the top-listed ones and those in the top N. GROUPING SETS over the cells give
the histograms per field, per subfield and in total, which are ranked once by a distributed
running sum (``ordered_rows``), for both scopes at a time, so no subject and not the TOTAL
is ever sorted in a single task. Cut-offs and counts then are one grouped aggregate.

2019 (upper-bound form): value v is within the top fraction p when
``(n - (rank_desc - 1)) / n >= p`` with n = non-null values of the group;
the cut-off is the smallest such v. 2017 (lower-bound form): ``rank_asc / N >=
p`` with N = all rows of the group, NULL values ranked first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import within_percentile_lower, within_percentile_upper
from ..sources.io import write_once
from .ordered import ordered_rows

FIELD, SUBFIELD = "sm_field", "sm_subfield_1"
LEVELS = ("field", "subfield", "total")
ALL_METRICS = ("nc_ws", "c_ws", "self_p", "cprat_ws", "cprat_ns")
TOP_METRICS = ("self_p", "cprat_ws", "cprat_ns")
TOTAL = "TOTAL"


def _pct(p: float) -> str:
    return f"{int(round(p * 100)):02d}"


def value_histogram(res: DataFrame, metrics: tuple[str, ...], cfg: Config, names: tuple[str, str] | None = None) -> DataFrame:
    """(level, subject, metric, value, n, n_top, n_top_ns, n_top_ws), written once: authors, top-listed
    authors and authors in the top N by either rank at each value of each metric, per field, per
    subfield and in total. ``names``: columns that label the field and the subfield (as ``name``)."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    named = {"_fn": F.col(names[0]), "_sn": F.col(names[1])} if names else {}
    flags = {"_top": F.col("top_listed") if "top_listed" in res.columns else F.lit(False),
             "_ns": F.col("rank_ns") <= cfg.top_n, "_ws": F.col("rank_ws") <= cfg.top_n}
    rows = res.withColumns(flags | named).select(FIELD, SUBFIELD, *flags, *named, values.alias("v")).select("*", "v.metric", "v.value")
    counts = {"n": F.lit(1), "n_top": F.col("_top"), "n_top_ns": F.col("_ns"), "n_top_ws": F.col("_ws")}
    cells = rows.groupBy("metric", FIELD, SUBFIELD, "value").agg(
        *[F.count(F.when(c, 1) if k != "n" else c).alias(k) for k, c in counts.items()], *[F.max(c).alias(c) for c in named])
    by = [["metric", "value", FIELD], ["metric", "value", SUBFIELD], ["metric", "value"]]
    sets = cells.groupingSets(by, "metric", "value", FIELD, SUBFIELD).agg(
        *[F.sum(k).alias(k) for k in counts], *[F.max(c).alias(c) for c in named],
        F.grouping(FIELD).alias("_no_field"), F.grouping(SUBFIELD).alias("_no_subfield"))
    in_field, in_subfield = F.col("_no_field") == 0, F.col("_no_subfield") == 0
    level = lambda f, sf, total: F.when(in_field, f).when(in_subfield, sf).otherwise(total)
    text = lambda c: F.col(c).cast("string") if names else F.col(c)
    label = [level(F.col("_fn"), F.col("_sn"), F.lit(TOTAL)).alias("name")] if names else []
    return write_once(sets.select(
        level(*[F.lit(x) for x in LEVELS]).alias("level"), level(text(FIELD), text(SUBFIELD), F.lit("" if names else TOTAL)).alias("subject"),
        *label, "metric", "value", *counts), "value_histogram")


def _counts(aggs: dict[str, str]) -> list[Column]:
    """Authors of a group, by the metric that every author has a row of."""
    return [F.sum(F.when(F.col("metric") == "nc_ws", F.col(c))).cast("long").alias(n) for n, c in aggs.items()]


def _join_small(big: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    s = small.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(keys)], *[c for c in small.columns if c not in keys])
    cond = None
    for i, k in enumerate(keys):
        c = big[k].eqNullSafe(s[f"_j{i}"])
        cond = c if cond is None else cond & c
    # the small side is derived (one row per group): AQE broadcasts it from its
    # measured size instead of a counting pre-pass that would re-run the plan
    return big.join(s, cond, "left").drop(*[f"_j{i}" for i in range(len(keys))])


def cutoff_table(res: DataFrame, cfg: Config) -> DataFrame:
    """All 2019 cut-off columns per (level, subject); level in field/subfield/total."""
    keys = ["level", "subject", "metric"]
    hist = value_histogram(res, ALL_METRICS, cfg)
    known = lambda c: F.sum(F.when(F.col("value").isNotNull(), F.col(c)).otherwise(0))
    sizes = hist.groupBy(*keys).agg(known("n").alias("_cnt_all"), known("n_top").alias("_cnt_top"))
    run = _join_small(ordered_rows(hist, keys, [("value", False)], ["n", "n_top"]), sizes, keys)
    # rank by value, descending: one more than the authors above
    run = run.withColumns({"_rank_all": F.col("_cum_n") - F.col("n") + 1, "_rank_top": F.col("_cum_n_top") - F.col("n_top") + 1})

    def passes(scope, m, p):
        return (F.col("metric") == m) & F.col("value").isNotNull() & within_percentile_upper(f"_rank_{scope}", f"_cnt_{scope}", p)

    aggs = _counts({"auth": "n", "auth_top_ns": "n_top_ns", "auth_top": "n_top_ws", "auth_in_top_list": "n_top"})
    names = {"nc_ws": "cites", "c_ws": "c", "self_p": "selfp", "cprat_ws": "cprat", "cprat_ns": "cprat_ns"}
    for m in ALL_METRICS:
        ps = cfg.percentiles if m in ("nc_ws", "c_ws") else cfg.ratio_percentiles
        for p in ps:
            v = F.min(F.when(passes("all", m, p), F.col("value")))
            aggs.append((v.cast("long") if m == "nc_ws" else v).alias(f"{names[m]}_{_pct(p)}"))
    for m in TOP_METRICS:
        for p in cfg.ratio_percentiles:
            sel = passes("top", m, p) & (F.col("n_top") > 0)
            aggs.append(F.min(F.when(sel, F.col("value"))).alias(f"top_list_{names[m]}_{_pct(p)}"))
            aggs.append(F.sum(F.when(sel, F.col("n_top")).otherwise(0)).cast("long").alias(f"auth_in_top_list_{names[m]}_{_pct(p)}"))
    return run.groupBy("level", "subject").agg(*aggs).withColumn("auth_in_top_list", F.nullif("auth_in_top_list", F.lit(0)))


def _cols(cfg: Config, kind: str) -> list[str]:
    if kind == "all":
        return (
            ["auth", "auth_top_ns", "auth_top", "auth_in_top_list"]
            + [f"cites_{_pct(p)}" for p in cfg.percentiles]
            + [f"c_{_pct(p)}" for p in cfg.percentiles]
            + [f"{n}_{_pct(p)}" for n in ("selfp", "cprat", "cprat_ns") for p in cfg.ratio_percentiles]
        )
    if kind == "top":
        return [f"top_list_{n}_{_pct(p)}" for n in ("selfp", "cprat", "cprat_ns") for p in cfg.ratio_percentiles]
    return [f"auth_in_top_list_{n}_{_pct(p)}" for n in ("selfp", "cprat", "cprat_ns") for p in cfg.ratio_percentiles]


def subject_cutoffs(cut: DataFrame, cfg: Config) -> DataFrame:
    """Of a ``cutoff_table``: authors, top-N counts, cites and c at the percentiles, self-share and
    cites-per-citing-paper at the ratio percentiles, per field, subfield and total."""
    return cut.select("level", "subject", *_cols(cfg, "all"))


def toplist_cutoffs(cut: DataFrame, cfg: Config) -> DataFrame:
    """Of a ``cutoff_table``: the ratio cut-offs computed inside the top list only."""
    return cut.select("level", "subject", *_cols(cfg, "top"))


def toplist_above(cut: DataFrame, cfg: Config) -> DataFrame:
    """Of a ``cutoff_table``: top-listed authors at or above each top-list cut-off."""
    return cut.select("level", "subject", *_cols(cfg, "above"))


# ---- 2017 (lower-bound form) ---------------------------------------------------------

def cutoffs_lower(res: DataFrame, cfg: Config) -> DataFrame:
    """2017 cut-offs of cites and c: smallest value whose ascending rank over all
    rows of the group (NULL first) reaches the fraction p."""
    keys = ["level", "subject", "metric"]
    hist = value_histogram(res, ("nc_ws", "c_ws"), cfg, ("sm_field_name", "sm_subfield_1_name"))
    sizes = hist.groupBy(*keys).agg(F.sum("n").alias("_cnt"))
    run = _join_small(ordered_rows(hist, keys, [("value", True)], ["n"]), sizes, keys).withColumn("_rank", F.col("_cum_n") - F.col("n") + 1)
    aggs = [F.max("name").alias("subject_name"), *_counts({"auth": "n", "auth_top_ns": "n_top_ns", "auth_top": "n_top_ws"})]
    for m, n in (("nc_ws", "cites"), ("c_ws", "c")):
        for p in cfg.percentiles:
            ok = within_percentile_lower("_rank", "_cnt", p)
            v = F.min(F.when((F.col("metric") == m) & ok, F.col("value")))
            aggs.append((v.cast("long") if m == "nc_ws" else v).alias(f"{n}_{_pct(p)}"))
    return run.groupBy("level", "subject").agg(*aggs)
