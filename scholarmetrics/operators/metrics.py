"""Per-author citation metrics (ns = without self-citations, ws = with).

h and hm come from a citation histogram of each author: cells (cites_ns, cites_ws) with the
number of slots and the sum of 1/n_authors, which merge map-side, so uncited and equally
cited papers are one row before the shuffle. Reading the cells from the most cited down
gives, per variant, every level of equal citations with the slots and the weight before and
after it. All papers above the last level that counts are settled by these sums; the order
inside a level (by eid, a repeated author's slots tie) matters in one level only:

* hm: the one level whose weight starts at or below its citations and ends above;
* h: ranks are consecutive, so a level gives min(citations, slots) unless one of its papers
  lists the author twice.

The papers of those levels alone are looked at one by one. An author who holds a large
share of all slots is dealt to ``SALTS`` partitions, each of which passes on only the papers
that its own running sum leaves possible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import in_span
from ..sources.io import bucket_count, write_buckets

# hm compares a running sum of 1/n_authors with an integer; rounding the sum
# keeps floating noise (1/3 + 1/3 + 1/3 != 1) from flipping the comparison
SUM_DIGITS = 9
# authors with at least 1 / HOT_SHARE of all slots, so at most HOT_SHARE of them, are dealt to SALTS partitions
HOT_SHARE, SALTS = 1000, 64
PAIR_TASKS = 4  # tasks of (author, citing paper) pairs per bucket of authors


def citation_histogram(auth: DataFrame) -> DataFrame:
    """Per (author, citations ns, citations ws): slots, sum of 1/n_authors, and whether a paper among them
    lists some author twice (taken as so where ``auth`` does not tell)."""
    repeats = F.col("repeats") if "repeats" in auth.columns else F.lit(True)
    return auth.groupBy("auid", "cites_ns", "cites_ws").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.lit(1.0) / F.col("n_authors")).alias("w"), F.max(repeats).alias("repeats"))


def _levels(cells: str, v: str) -> Column:
    """The cells of one variant as (c, n, w, repeats), most cited first, and a closing one of c = -1."""
    cited = F.filter(cells, lambda x: x[f"cites_{v}"] > 0)
    one = F.transform(cited, lambda x: F.struct(x[f"cites_{v}"].cast("long").alias("c"), x["n"].alias("n"), x["w"].alias("w"), x["repeats"].alias("repeats")))
    end = F.struct(F.lit(-1).cast("long").alias("c"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("w"), F.lit(False).alias("repeats"))
    return F.concat(F.sort_array(one, asc=False), F.array(end))


def _fold(cells: str, v: str) -> Column:
    """Struct per author: h_c, h_s0, h_s1, h_rep (the last level with a rank that counts: citations, slots before
    and after it, repeats), hm (the weight of the levels that fit) and x_c, x_w0 (the level
    that fits in part: citations and weight before it), 0 where there is none."""
    long0, no = F.lit(0).cast("long"), F.lit(False)
    names = ("c", "s0", "w0", "rep", "s", "w", "h_c", "h_s0", "h_s1", "h_rep", "hm", "x_c", "x_w0")
    start = (long0, long0, F.lit(0.0), no, long0, F.lit(0.0), long0, long0, long0, no, F.lit(0.0), long0, F.lit(0.0))

    def merge(st, x):
        same = st["c"] == x["c"]
        closes = ~same & (st["c"] > 0)
        ranked = closes & (st["s0"] < st["c"])
        fits = F.round(st["w"], SUM_DIGITS) <= st["c"]
        crosses = closes & ~fits & (st["x_c"] == 0)
        pick = lambda cond, new, old: F.when(cond, new).otherwise(st[old])
        values = (
            x["c"], F.when(same, st["s0"]).otherwise(st["s"]), F.when(same, st["w0"]).otherwise(st["w"]),
            x["repeats"] | (same & st["rep"]), st["s"] + x["n"], st["w"] + x["w"],
            pick(ranked, st["c"], "h_c"), pick(ranked, st["s0"], "h_s0"), pick(ranked, st["s"], "h_s1"), pick(ranked, st["rep"], "h_rep"),
            pick(closes & fits, st["w"], "hm"), pick(crosses, st["c"], "x_c"), pick(crosses, st["w0"], "x_w0"),
        )
        return F.struct(*[c.alias(n) for c, n in zip(values, names, strict=True)])

    return F.aggregate(_levels(cells, v), F.struct(*[c.alias(n) for c, n in zip(start, names, strict=True)]), merge)


def _settled(auth: DataFrame) -> DataFrame:
    """Per author, by its histogram: slots, and per variant v the struct ``_fold`` as column v."""
    cells = citation_histogram(auth).groupBy("auid").agg(
        F.sum("n").alias("slots"), F.collect_list(F.struct("cites_ns", "cites_ws", "n", "w", "repeats")).alias("cells"))
    keep = ("h_c", "h_s0", "h_s1", "h_rep", "hm", "x_c", "x_w0")
    folds = cells.select("auid", "slots", *[_fold("cells", v).alias(v) for v in ("ns", "ws")])
    narrow = [F.struct(*[F.col(f"{v}.{k}").alias(k) for k in keep]).alias(v) for v in ("ns", "ws")]
    return write_buckets(folds.select("auid", "slots", *narrow), "settled", "auid", clustered=True)


def _by_paper(auth: DataFrame, settled: DataFrame) -> DataFrame:
    """h and hm (h_ns, m_ns, h_ws, m_ws) of the levels where the order of papers matters; NULL elsewhere."""
    wants = []
    for v in ("ns", "ws"):
        s = F.col(v)
        in_part = (s["x_c"] > 0) & (s["x_w0"] < s["x_c"])
        wants.append(F.when(s["h_rep"], F.struct(F.lit(f"h_{v}").alias("kind"), s["h_c"].alias("c"), s["h_s0"].cast("double").alias("start"))))
        wants.append(F.when(in_part, F.struct(F.lit(f"m_{v}").alias("kind"), s["x_c"].alias("c"), s["x_w0"].alias("start"))))
    wanted = settled.select("auid", "slots", F.filter(F.array(*wants), lambda x: x.isNotNull()).alias("wants")).filter(F.size("wants") > 0)
    slots = settled.agg(F.sum("slots").alias("n")).first()["n"] or 0
    hot = [r["auid"] for r in wanted.filter(F.col("slots") * HOT_SHARE >= slots).select("auid").collect()]
    is_hot = F.col("auid").isin(hot) if hot else F.lit(False)
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    wanted = wanted.select("auid", "wants", F.explode(salts).alias("salt"))
    papers = auth.filter((F.col("cites_ns") > 0) | (F.col("cites_ws") > 0)).select(
        "auid", "eid", "cites_ns", "cites_ws", (F.lit(1.0) / F.col("n_authors")).alias("w"),
        F.when(is_hot, F.pmod(F.xxhash64("eid"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int").alias("salt"))
    cites = lambda x: F.when(x["kind"].endswith("ns"), F.col("cites_ns")).otherwise(F.col("cites_ws"))
    # without hot authors the sides meet where their tables hold them
    met = papers.join(wanted, ["auid", "salt"]) if hot else papers.drop("salt").join(wanted, "auid")
    rows = met.select(
        "auid", "salt", "eid", "w", F.explode(F.filter("wants", lambda x: x["c"] == cites(x))).alias("x")
    ).select("auid", "salt", "eid", F.col("x.kind").alias("kind"), F.col("x.c").alias("c"), F.col("x.start").alias("start"),
             F.when(F.col("x.kind").startswith("h"), F.lit(1.0)).otherwise(F.col("w")).alias("w"))
    # no paper counts once the papers before it pass the limit, in this partition's share of the level alone
    mine = Window.partitionBy("auid", "salt", "kind").orderBy("eid")
    before = F.coalesce(F.sum("w").over(mine.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("before", before).filter(F.col("start") + F.col("before") <= F.col("c") + 1e-6)
    level = Window.partitionBy("auid", "kind").orderBy("eid")
    rows = rows.select("auid", "kind", "eid", "c", "start", "w").repartition("auid").withColumns({
        "rank": F.col("start") + F.rank().over(level), "sum": F.col("start") + F.sum("w").over(level)})
    aggs = []
    for v in ("ns", "ws"):
        aggs.append(F.max(F.when((F.col("kind") == f"h_{v}") & (F.col("rank") <= F.col("c")), F.col("rank"))).alias(f"h_{v}"))
        aggs.append(F.max(F.when((F.col("kind") == f"m_{v}") & (F.round("sum", SUM_DIGITS) <= F.col("c")), F.col("sum"))).alias(f"m_{v}"))
    return rows.groupBy("auid").agg(*aggs)


def h_and_hm(auth: DataFrame, cfg: Config) -> DataFrame:
    """h and hm, ns and ws, per author, by papers ranked by citations desc then eid (SQL rank: a repeated
    author's slots tie).

    h: the largest rank r with at least r citations at that rank.
    hm: the largest running sum of 1/n_authors (peers included) not above the citations."""
    settled = _settled(auth)
    found = settled.join(_by_paper(auth, settled), "auid", "left")
    out = []
    for v in ("ns", "ws"):
        s = F.col(v)
        out.append(F.coalesce(F.col(f"h_{v}").cast("long"), F.least(s["h_c"], s["h_s1"])).alias(f"h_{v}"))
        out.append(F.coalesce(F.col(f"m_{v}"), s["hm"]).alias(f"hm_{v}"))
    return found.select("auid", *out)


def h_index(auth: DataFrame, cfg: Config) -> DataFrame:
    """h (ns, ws)."""
    return h_and_hm(auth, cfg).select("auid", "h_ns", "h_ws")


def hm_index(auth: DataFrame, cfg: Config) -> DataFrame:
    """hm (ns, ws)."""
    return h_and_hm(auth, cfg).select("auid", "hm_ns", "hm_ws")


def _volume_aggs(cfg: Config) -> list:
    span = in_span("year", cfg)

    def cnt(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")

    return [
        cnt(span).alias("np"),
        cnt(span & (F.col("cites_ns") > 0)).alias("npc_ns"),
        cnt(span & (F.col("cites_ws") > 0)).alias("npc_ws"),
        F.sum("cites_ns").cast("long").alias("nc_ns"),
        F.sum("cites_ws").cast("long").alias("nc_ws"),
        F.sum(F.when(span, F.col("is_disc_source")).otherwise(0)).cast("long").alias("np_d"),
        F.sum("cites_disc").cast("long").alias("nc_d"),
    ]


def _position_aggs() -> list:
    single = F.col("n_authors") == 1
    first = single | (F.col("authorseq") == 1)
    first_last = first | (F.col("authorseq") == F.col("n_authors"))
    out = []
    for tag, cond in (("s", single), ("sf", first), ("sfl", first_last)):
        out.append(F.sum(F.when(cond, 1).otherwise(0)).cast("long").alias(f"np{tag}"))
        for v in ("ns", "ws"):
            out.append(F.sum(F.when(cond, F.col(f"cites_{v}")).otherwise(0)).cast("long").alias(f"nc{tag}_{v}"))
    return out


def author_volume(auth: DataFrame, cfg: Config) -> DataFrame:
    """Papers in [min_year, max_year], cited papers in that span, citations (all
    papers up to max_year), papers and citations involving discontinued journals."""
    return auth.groupBy("auid").agg(*_volume_aggs(cfg))


def author_positions(auth: DataFrame) -> DataFrame:
    """Single, single+first and single+first+last authored papers and their citations."""
    return auth.groupBy("auid").agg(*_position_aggs())


def citing_papers(auth: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct papers citing any of the author's papers (ws), and those with at
    least one non-self citation to them (ns). Deduplicated by (author, citing
    paper) aggregation rather than per-author id arrays; bitmaps of the ids were
    measured and move more bytes, since an author's citing papers lie far apart.

    The pairs are dealt by author before they are aggregated (hardly any two of a task are
    equal, so a map-side pass would only fill its memory), and an author's counts come from
    one task; those of an author with a large share of all slots from ``SALTS`` tasks."""
    e = edges.select(F.col("cited").alias("eid"), "citing", "is_self")
    per_author = auth.groupBy("auid").agg(F.count(F.lit(1)).alias("n"))
    total = auth.count()
    hot = [r["auid"] for r in per_author.filter(F.col("n") * HOT_SHARE >= total).select("auid").collect()]  # at most HOT_SHARE
    pairs = auth.select("auid", "eid").join(e, "eid").select("auid", "citing", (1 - F.col("is_self")).alias("ns"))
    dealt = ["auid"]
    if hot:
        salt = F.pmod(F.xxhash64("citing"), F.lit(SALTS)).cast("int")
        pairs = pairs.withColumn("salt", F.when(F.col("auid").isin(hot), salt).otherwise(F.lit(0)))
        dealt.append("salt")
    # a multiple of the buckets: each task holds authors of one bucket, and a small table of pairs
    pairs = pairs.repartition(PAIR_TASKS * bucket_count(auth.sparkSession), *dealt).groupBy(*dealt, "citing").agg(F.max("ns").alias("ns"))
    return pairs.groupBy("auid").agg(
        F.count(F.lit(1)).alias("ncp_ws"), F.sum("ns").cast("long").alias("ncp_ns")
    )


def author_metrics(auth: DataFrame, edges: DataFrame, subjects: DataFrame, cfg: Config) -> DataFrame:
    """All metrics of the eligible authors in ``auth`` (already restricted), one row
    per author. ``subjects`` is ``author_subjects`` of the same rows. Each part is written
    once, bucketed by author, so the joins between them move nothing."""
    base = write_buckets(auth.groupBy("auid").agg(*_volume_aggs(cfg), *_position_aggs()), "volumes", "auid", clustered=True)
    indexes = write_buckets(h_and_hm(auth, cfg), "indexes", "auid", clustered=True)
    cp = write_buckets(citing_papers(auth, edges), "citing", "auid", clustered=True)
    own = write_buckets(subjects, "subjects", "auid", clustered=True)
    return (
        base.join(indexes, "auid", "left")
        .join(cp, "auid", "left")
        .join(own, "auid", "left")
        .withColumns({"ncp_ws": F.coalesce("ncp_ws", F.lit(0)), "ncp_ns": F.coalesce("ncp_ns", F.lit(0))})
    )
