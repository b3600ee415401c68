"""Quality rules with adaptive thresholds (operator 9; native DataFrame operations only).

Every document gets integer metrics. Per (language, source) group the metrics are
summarised by a mergeable quantile sketch: a log-linear histogram (values below 128
exact, above that seven significant bits, so a quantile is off by under 1.6 %).
Sketches merge by adding counts, so partial sketches are built map-side, a hot source
is pre-aggregated before any shuffle, and small groups borrow the merged sketch of
their language, or of the whole corpus. Robust fences (median plus or minus a multiple
of the spread of the clean side) replace fixed cut-offs; they are joined to the rows by
group and judge each document.

Defined results: null or empty text has no words, hence fails the base rule; null
``lang`` or ``source`` is a group of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, ascii_words, let, materialize, packed, table, unpacked

REPEAT_WINDOW = 5


@dataclass(frozen=True)
class QualityConfig:
    min_words: int = 10
    max_repeat_percent: int = 20
    min_group: int = 100  # documents a group needs for a sketch of its own
    spread: int = 6  # fence = median +- spread * (median - quantile on the clean side)
    # least distance of a fence from the median, in the metric's unit
    margin_symbols: int = 60  # symbols per 1000 word characters
    margin_dup: int = 400  # repeated lines per 1000 lines
    margin_length: int = 90  # hundredths of a character of the shrunk mean word length
    prior_words: int = 20  # pseudo words of five characters that shrink a short text's mean


def _repeat_words(words: Column) -> Column:
    """Words inside five-word windows that occur at least twice. Windows are compared by a
    64-bit hash of five 64-bit word hashes; a false repeat in a text of 20,000 words has a
    probability below 1e-10. Linear unless the text repeats itself, else one sort."""

    def of_hashes(h: Column) -> Column:
        n = F.size(h) - F.lit(REPEAT_WINDOW - 1)
        windows = F.transform(
            F.slice(h, F.lit(1), F.greatest(n, F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(h, i + F.lit(k)) for k in range(1, REPEAT_WINDOW)]),
        )
        return let(windows, of_windows)

    def of_windows(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(_repeated_starts(w), covered))

    def covered(starts: Column) -> Column:
        # starts ascending: each window adds the words not covered by the one before
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(-REPEAT_WINDOW).alias("last")),
            lambda a, p: F.struct(
                (a["n"] + F.least(F.lit(REPEAT_WINDOW), p - a["last"])).alias("n"), p.alias("last")
            ),
            lambda a: a["n"],
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def _repeated_starts(w: Column) -> Column:
    ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    return let(
        ordered,
        lambda s: F.sort_array(
            F.transform(
                F.filter(
                    F.transform(
                        s,
                        lambda e, i: F.struct(
                            e["p"].alias("p"),
                            (
                                F.coalesce(F.get(s, i + F.lit(1))["h"] == e["h"], F.lit(False))
                                | ((i > 0) & (F.get(s, F.greatest(i - F.lit(1), F.lit(0)))["h"] == e["h"]))
                            ).alias("twice"),
                        ),
                    ),
                    lambda e: e["twice"],
                ),
                lambda e: e["p"],
            )
        ),
    )


def metrics(text: Column) -> Column:
    """Struct of the base counts of a text (all long)."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_CLASS))
    line_counts = let(
        lines,
        lambda a: F.struct(F.size(a).alias("n"), (F.size(a) - F.size(F.array_distinct(a))).alias("dup")),
    )
    return let(
        ascii_words(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            line_counts.alias("lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )


def _base(m: Column, cfg: QualityConfig) -> Column:
    return (m["n_words"] < cfg.min_words) | (100 * m["n_repeat_words"] > cfg.max_repeat_percent * m["n_words"])


def _rates(m: Column, cfg: QualityConfig) -> dict[str, Column]:
    one = F.lit(1).cast("long")
    return {
        "symbols": F.floor(1000 * m["n_symbols"] / F.greatest(m["word_chars"], one)),
        "dup": F.floor(1000 * m["lines"]["dup"] / F.greatest(m["lines"]["n"].cast("long"), one)),
        "length": F.floor(100 * (m["word_chars"] + 5 * cfg.prior_words) / (m["n_words"] + cfg.prior_words)),
    }


def _bucket(v: Column) -> Column:
    """Lower bound of the log-linear bucket: seven significant bits."""
    shift = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    unit = F.pow(F.lit(2.0), shift).cast("long")
    return v - v % unit


def _key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def sketch(rows: DataFrame) -> DataFrame:
    """Mergeable sketch: (lang, source, metric, bucket, n) of rows (lang, source, rates...)."""
    names = ("symbols", "dup", "length")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), _bucket(F.col(k)).alias("bucket")) for k in names]))
    return (
        rows.select("lang", "source", each.alias("e"))
        .groupBy("lang", "source", F.col("e.metric").alias("metric"), F.col("e.bucket").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _quantiles(hist: DataFrame, by: list[str]) -> DataFrame:
    """Per group and metric: documents and the 10, 25, 50, 75 % quantiles of a merged sketch."""
    merged = hist.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "metric")
    run = merged.withColumns(
        {
            "cum": F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "total": F.sum("n").over(w),
        }
    )
    q = [F.min(F.when(100 * F.col("cum") >= p * F.col("total"), F.col("bucket"))).alias(f"q{p}") for p in (10, 50, 75)]
    per = run.groupBy(*by, "metric").agg(F.max("total").alias("docs"), *q)
    pick = lambda k, c: F.max(F.when(F.col("metric") == k, F.col(c)))
    return per.groupBy(*by).agg(
        F.max("docs").alias("docs"),
        *[pick(k, c).alias(f"{k}_{c}") for k in ("symbols", "dup", "length") for c in ("q10", "q50", "q75")],
    )


def thresholds(hist: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """Fences per (lang, source) group of a sketch: a group under ``min_group`` documents uses
    the merged sketch of its language, and if that is small too, of the whole corpus."""
    own = _quantiles(hist, ["lang", "source"])
    lang = _quantiles(hist, ["lang"])
    stats = [c for c in own.columns if c not in ("lang", "source")]
    # the corpus sketch is one row of numbers: literals, no join
    row = _quantiles(hist.withColumn("_all", F.lit(0)), ["_all"]).first()
    every = F.struct(*[F.lit(row[c] if row else None).cast("long").alias(c) for c in stats])
    j = own.select("lang", "source", F.struct(*stats).alias("own")).join(
        lang.select("lang", F.struct(*stats).alias("by_lang")), "lang", "left").withColumn("every", every)
    s = (
        F.when(F.col("own.docs") >= cfg.min_group, F.col("own"))
        .when(F.col("by_lang.docs") >= cfg.min_group, F.col("by_lang"))
        .otherwise(F.col("every"))
    )
    j = j.select("lang", "source", s.alias("s"))
    q = lambda k, p: F.col("s")[f"{k}_q{p}"]
    up = lambda k, margin: q(k, 50) + F.greatest(cfg.spread * (q(k, 50) - q(k, 10)), F.lit(margin))
    low = q("length", 50) - F.greatest(cfg.spread * (q("length", 75) - q("length", 50)), F.lit(cfg.margin_length))
    return j.select(
        "lang", "source",
        F.col("s.docs").alias("sketch_docs"),
        up("symbols", cfg.margin_symbols).alias("max_symbols"),
        up("dup", cfg.margin_dup).alias("max_dup"),
        up("length", cfg.margin_length).alias("max_length"),
        low.alias("min_length"),
    )


def score(docs: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """(_row, m, lang, source, rates): the packed rows with their metrics and group keys."""
    rows = packed(docs).select("_row", metrics(F.col("_row.text")).alias("m"), _key(F.col("_row.lang")).alias("lang"),
                               _key(F.col("_row.source")).alias("source"))
    return rows.select("*", *[v.alias(k) for k, v in _rates(F.col("m"), cfg).items()])


def judged(scored: DataFrame, fences: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """Joined filtering: ``base_failed`` and ``kept`` per row."""
    j = scored.join(fences, ["lang", "source"], "left")
    failed = _base(F.col("m"), cfg)
    # the base rule enters as a bound that no text meets, so that the verdict is one predicate on both
    # sides of the join: pushed below it on its own, it would compute the metrics twice more
    inside = (
        (F.col("symbols") <= F.when(failed, F.lit(-1)).otherwise(F.col("max_symbols")))
        & (F.col("dup") <= F.col("max_dup"))
        & F.col("length").between(F.col("min_length"), F.col("max_length"))
    )
    return j.withColumns({"base_failed": failed, "kept": F.coalesce(inside, ~failed)})


def fences_of(docs: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """Thresholds learnt from all documents (sketch and fences written once to shared scratch)."""
    rows = score(docs, cfg).select("lang", "source", "symbols", "dup", "length")
    return _written(thresholds(materialize(sketch(rows), "quality_sketch"), cfg))


def _written(fences: DataFrame) -> DataFrame:
    """The fences (one narrow row per group) in a few files, so that the planner knows their size:
    few groups are broadcast by it, and the documents are not shuffled by (lang, source)."""
    return materialize(fences.coalesce(4), "quality_fences")


def quality_filter(docs: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """The documents that pass, with their own columns."""
    return judged(score(docs, cfg), fences_of(docs, cfg), cfg).filter("kept").select(
        *unpacked(docs, docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    cfg = QualityConfig()
    scored = score(docs, cfg)
    # narrow rows (no text), written once: read by the sketch and by the verdicts
    rows = materialize(scored.select(F.struct("_row.doc_id").alias("_row"), "m", "lang", "source", "symbols", "dup",
                                     "length"), "quality_metrics")
    fences = _written(thresholds(sketch(rows), cfg))
    return judged(rows, fences, cfg).select(
        F.col("_row.doc_id").alias("doc_id"), "m.n_words", "m.word_chars", "m.n_symbols",
        F.col("m.lines.dup").cast("long").alias("n_dup_lines"), "m.n_repeat_words", "base_failed", "kept",
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    CASE WHEN lang IS NULL THEN 'null' ELSE '=' || lang END AS lang,
    CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS source,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT rid, p, array_to_string(list_slice(w, p, p + 4), ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)
), rep AS (
  SELECT rid, count(DISTINCT q) AS n_repeat FROM (
    SELECT g.rid, unnest(range(g.p, g.p + 5)) AS q FROM g
    JOIN (SELECT rid, g FROM g GROUP BY rid, g HAVING count(*) > 1) x ON g.rid = x.rid AND g.g = x.g
  ) GROUP BY rid
), m AS (
  SELECT d.rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep ON d.rid = rep.rid
), r AS (
  SELECT *, 1000 * n_symbols // greatest(word_chars, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup,
    100 * (word_chars + 100) // (n_words + 20) AS length_ FROM m
), h0 AS (
  SELECT lang, source, 'symbols' AS metric, symbols AS v FROM r UNION ALL SELECT lang, source, 'dup', dup FROM r
  UNION ALL SELECT lang, source, 'length', length_ FROM r
), h AS (
  SELECT lang, source, metric, v - v % CAST(pow(2, greatest(length(bin(v)) - 7, 0)) AS BIGINT) AS bucket, count(*) AS n FROM h0 GROUP BY ALL
), levels AS (
  SELECT 0 AS level, lang, source, metric, bucket, n FROM h
  UNION ALL SELECT 1, lang, '*', metric, bucket, sum(n) FROM h GROUP BY lang, metric, bucket
  UNION ALL SELECT 2, '*', '*', metric, bucket, sum(n) FROM h GROUP BY metric, bucket
), c AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS cum,
    sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM levels
), q AS (
  SELECT level, lang, source, metric, max(total) AS docs, min(CASE WHEN 100 * cum >= 10 * total THEN bucket END) AS q10,
    min(CASE WHEN 100 * cum >= 50 * total THEN bucket END) AS q50, min(CASE WHEN 100 * cum >= 75 * total THEN bucket END) AS q75
  FROM c GROUP BY level, lang, source, metric
), f AS (
  SELECT o.lang, o.source, o.metric,
    CASE WHEN o.docs >= 100 THEN o.q10 WHEN l.docs >= 100 THEN l.q10 ELSE e.q10 END AS q10,
    CASE WHEN o.docs >= 100 THEN o.q50 WHEN l.docs >= 100 THEN l.q50 ELSE e.q50 END AS q50,
    CASE WHEN o.docs >= 100 THEN o.q75 WHEN l.docs >= 100 THEN l.q75 ELSE e.q75 END AS q75
  FROM q o JOIN q l ON o.level = 0 AND l.level = 1 AND o.lang = l.lang AND o.metric = l.metric
  JOIN q e ON e.level = 2 AND e.metric = o.metric
), b AS (
  SELECT lang, source,
    max(CASE WHEN metric = 'symbols' THEN q50 + greatest(6 * (q50 - q10), 60) END) AS max_symbols,
    max(CASE WHEN metric = 'dup' THEN q50 + greatest(6 * (q50 - q10), 400) END) AS max_dup,
    max(CASE WHEN metric = 'length' THEN q50 + greatest(6 * (q50 - q10), 90) END) AS max_length,
    max(CASE WHEN metric = 'length' THEN q50 - greatest(6 * (q75 - q50), 90) END) AS min_length
  FROM f GROUP BY lang, source
), v AS (
  SELECT r.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    symbols <= max_symbols AND dup <= max_dup AND length_ BETWEEN min_length AND max_length AS inside
  FROM r JOIN b ON r.lang = b.lang AND r.source = b.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept FROM v
"""
