"""Phrase collocations from a weighted de Bruijn graph (operator 11).

Nodes are 4-grams, edges are the longest grams (5 words) between overlapping nodes, weighted by
their occurrences; everything is per language.

1. One pass counts the words, and the word pairs by hash. A phrase that occurs ``min_count`` times
   holds only pairs that do. A bitmap of a fixed size (``PAIR_BITS``) says which pairs can be
   frequent; a collision only lets a rare one through, and a frequent one is never lost.
2. A second pass emits, at every word, the longest gram of at most 5 words that starts there and
   has only such pairs: an edge if it has 5 words, else a piece-end correction (the piece, or
   the part of it that can hold a phrase, ends there). Aggregated, these are the graph.
3. Node flow gives all shorter counts: an m-gram occurs as often as the (m + 1)-grams that
   start with it, plus its own corrections.
4. Unary paths are compacted: where a node's whole flow equals the weight of one edge into it and
   of one edge out of it, the two are one path. Pointer doubling over the edges of at least
   ``min_count`` finds the start of each path; paths of less flow hold no candidate. A node on a
   path that carries all its flow lies inside an equally frequent longer phrase.

Counting tasks aggregate what they read before the shuffle; nothing is gathered but the
bitmap. A path is as long as a repeated passage, which lies in one text.

Defined results: a null or empty text has no words; a null language is ``und``; documents of
equal id are counted each; doc_id and further columns are not read; texts of any length are
cut into steps only between texts; an empty table gives an empty result. Ties of score and
count are ranked by the phrase's UTF-8 bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Numbered, bitmap, has_bit, materialize, releasing, table

PAIR_BITS = 26  # a bitmap of 8 MB
STEP_BYTES = 1 << 19  # text counted at a time
KNOWN = 120_000  # distinct words of a language that a task holds
PENDING = 1 << 19  # distinct pairs that a task holds

# Signs that end a piece; every other character but space and tab belongs to a word.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_CAPITALS = bytes(range(65, 91))
_TABLE = bytes.maketrans(_CAPITALS + PIECE_ENDS, _CAPITALS.lower() + b"." * len(PIECE_ENDS))
BREAK = b"."  # stands for any piece end; never part of a word
UNKNOWN = "und"


@dataclass(frozen=True)
class PhraseConfig:
    min_count: int = 100
    max_words: int = 5
    top: int = 2000

    def __post_init__(self):
        if self.max_words < 2 or self.min_count < 1:
            raise ValueError("phrases have two words or more and occur at least once")


# -- tokens ---------------------------------------------------------------------------


def tokens(texts: list[bytes]) -> list[bytes]:
    """The words of texts, with BREAK between pieces and between texts."""
    return BREAK.join(texts).translate(_TABLE).replace(BREAK, b" . ").split()


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, tokens) of the rows (lang, text), some STEP_BYTES of one language at a time."""
    held: dict[str, list[bytes]] = {}
    size: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            value = text.as_py()
            if value:
                held.setdefault(lang, []).append(value)
                size[lang] += len(value)
                if size[lang] >= STEP_BYTES:
                    yield lang, tokens(held.pop(lang))
                    del size[lang]
        if sum(size.values()) >= 4 * STEP_BYTES:  # many languages
            for lang in list(held):
                yield lang, tokens(held.pop(lang))
            size.clear()
    for lang, texts in held.items():
        yield lang, tokens(texts)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text"))


class _Hashes(dict):
    """word -> its hash, 0 for BREAK."""

    def __init__(self, lang: str):
        super().__init__({BREAK: 0})
        self.seed = xxhash.xxh64_intdigest(lang.encode(), 42)

    def __missing__(self, word):
        self[word] = h = xxhash.xxh64_intdigest(word, self.seed)
        return h


def _pairs(known: dict[str, _Hashes], lang: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word with the next, and whether they are of one piece."""
    mine = known.get(lang)
    if mine is None or len(mine) > KNOWN:
        mine = known[lang] = _Hashes(lang)
    h = np.fromiter(map(mine.__getitem__, words), np.uint64, len(words))
    a, b = h[:-1], h[1:]
    mixed = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (a >> np.uint64(31))
    mixed = (mixed + b) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ (mixed >> np.uint64(29)), (a != 0) & (b != 0)


# -- passes ---------------------------------------------------------------------------


class _PairCounts:
    """Counts of pair hashes, merged as they come in."""

    def __init__(self):
        self.h, self.n, self.size = [], [], 0

    def add(self, h: np.ndarray) -> None:
        one, n = np.unique(h, return_counts=True)
        self.h.append(one)
        self.n.append(n)
        self.size += len(one)
        if self.size > 2 * PENDING:
            self.merge()

    def merge(self) -> None:
        h, n = np.concatenate(self.h), np.concatenate(self.n)
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
        self.h, self.n, self.size = [h[first]], [np.add.reduceat(n[order], first) if len(h) else n], len(first)

    def rows(self) -> pa.RecordBatch:
        self.merge()
        h, n = self.h[0], self.n[0]
        none = pa.nulls(len(h), pa.string())
        return pa.RecordBatch.from_arrays([none, none, pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "h", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words as (lang, gram, null, n), pairs as (null, null, h, n)."""
    counts: dict[str, Counter] = {}
    known: dict[str, _Hashes] = {}
    pairs = _PairCounts()

    def flush(lang: str) -> pa.RecordBatch:
        c = counts.pop(lang)
        c.pop(BREAK, None)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()).cast(pa.string()), pa.nulls(len(c), pa.int64()),
             pa.array(list(c.values()), pa.int64())], names=["lang", "gram", "h", "n"])

    for lang, words in _steps(batches):
        counts.setdefault(lang, Counter()).update(words)
        if len(counts[lang]) > KNOWN:
            yield flush(lang)
        pair, ok = _pairs(known, lang, words)
        pairs.add(pair[ok])
        if pairs.size > PENDING and len(pairs.h) == 1:  # merged, and still many
            yield pairs.rows()
            pairs = _PairCounts()
    for lang in list(counts):
        yield flush(lang)
    if pairs.h:
        yield pairs.rows()


def longest_grams(ids: np.ndarray, joined: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per length m of 2 .. most, (m, first places, counts) of the distinct grams that are the longest at
    their place; ``joined[i]`` tells whether word i + 1 may follow word i."""
    at = np.flatnonzero(joined)
    rank = ids[at]
    for m in range(2, most + 1):
        _, first, rank = np.unique(rank.astype(np.int64) << 32 | ids[at + m - 1], return_index=True, return_inverse=True)
        goes_on = np.zeros(len(at), bool)
        if m < most:
            more = at + m - 1 < len(joined)
            goes_on[more] = joined[at[more] + m - 1]
        ends = np.bincount(rank[~goes_on], minlength=len(first))
        some = np.flatnonzero(ends)
        yield m, at[first[some]], ends[some]
        at, rank = at[goes_on], rank[goes_on]


def _emit(allowed, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Hashes] = {}
        bits = allowed.value
        for lang, words in _steps(batches):
            pair, joined = _pairs(known, lang, words)
            joined &= has_bit(bits, pair)
            number = Numbered()
            ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            for m, places, n in longest_grams(ids, joined, most):
                grams = [b" ".join(words[i : i + m]) for i in places.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.binary()).cast(pa.string()),
                     pa.array(np.full(len(grams), m, np.int32)), pa.array(n.astype(np.int64))], names=["lang", "gram", "m", "n"])

    return run


# -- graph ------------------------------------------------------------------------------


def counts(docs: DataFrame, cfg: PhraseConfig = PhraseConfig()) -> DataFrame:
    """Written once: (lang, gram, null, n) of every word and (null, null, h, n) of every frequent pair hash."""
    one = _rows(docs).mapInArrow(releasing(_count), "lang string, gram string, h long, n long")
    every = one.groupBy("lang", "gram", "h").agg(F.sum("n").alias("n"))
    return materialize(every.filter(F.col("h").isNull() | (F.col("n") >= cfg.min_count)), "counts")


def graph(docs: DataFrame, counted: DataFrame, cfg: PhraseConfig = PhraseConfig()) -> DataFrame:
    """(lang, gram, m, n), written once: the edges (m = max_words) and the corrections (shorter grams that
    a piece, or the part of it that can hold a phrase, ends with)."""
    allowed = docs.sparkSession.sparkContext.broadcast(bitmap(counted.filter(F.col("h").isNotNull()).select("h"), PAIR_BITS))
    one = _rows(docs).mapInArrow(releasing(_emit(allowed, cfg.max_words)), "lang string, gram string, m int, n long")
    return materialize(one.groupBy("lang", "gram", "m").agg(F.sum("n").alias("n")), "grams")


def _head(gram: str, m: int) -> Column:
    return F.substring_index(gram, " ", m)


def _tail(gram: str, m: int) -> Column:
    return F.substring_index(gram, " ", -m)


def flows(grams: DataFrame, cfg: PhraseConfig = PhraseConfig()) -> dict[int, DataFrame]:
    """length -> (lang, gram, n) for 2 .. max_words words: node flow plus corrections."""
    out = {cfg.max_words: grams.filter(F.col("m") == cfg.max_words).select("lang", "gram", "n")}
    for m in range(cfg.max_words - 1, 1, -1):
        through = out[m + 1].select("lang", _head("gram", m).alias("gram"), "n")
        ends = grams.filter(F.col("m") == m).select("lang", "gram", "n")
        out[m] = materialize(through.unionByName(ends).groupBy("lang", "gram").agg(F.sum("n").alias("n")), f"flow_{m}")
    return out


def unary_paths(edges: DataFrame, nodes: DataFrame, cfg: PhraseConfig = PhraseConfig()) -> DataFrame:
    """(lang, phrase, n): maximal paths of ``edges`` (lang, gram, n) through ``nodes`` of the same flow."""
    k = cfg.max_words - 1
    e = materialize(edges.select(F.monotonically_increasing_id().alias("edge"), "lang", "gram", "n"), "path_edges")
    node = nodes.select("lang", F.col("gram").alias("node"), "n")
    into = e.select("lang", _tail("gram", k).alias("node"), "n", F.col("edge").alias("before"))
    out = e.select("lang", _head("gram", k).alias("node"), "n", "edge")
    # the whole flow of the node comes by one edge and leaves by one edge
    step = out.join(node, ["lang", "node", "n"]).join(into, ["lang", "node", "n"]).select("edge", "before")
    at = materialize(
        e.select("edge").join(step, "edge", "left")
        .select("edge", F.coalesce("before", "edge").alias("at"), F.when(F.col("before").isNull(), 0).otherwise(1).alias("hops"),
                F.col("before").isNull().alias("done")), "path_0")
    rounds = 0
    while not at.filter(~F.col("done")).isEmpty():
        rounds += 1
        ahead = at.select(F.col("edge").alias("at"), F.col("at").alias("to"), F.col("hops").alias("more"), F.col("done").alias("there"))
        moved = at.filter(~F.col("done")).join(ahead, "at").select(
            "edge", F.col("to").alias("at"), (F.col("hops") + F.col("more")).alias("hops"), F.col("there").alias("done"))
        at = materialize(at.filter("done").unionByName(moved), f"path_{rounds}")
    last = F.array_sort(F.collect_list(F.struct("hops", "gram")))
    whole = at.join(e, "edge").groupBy("at", "lang", "n").agg(last.alias("s"))
    words = F.concat(F.array(F.col("s")[0]["gram"]), F.transform(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), lambda x: F.substring_index(x["gram"], " ", -1)))
    return whole.select("lang", F.array_join(words, " ").alias("phrase"), "n")


def _nodes_of(paths: DataFrame, m: int) -> DataFrame:
    """(lang, gram, most): the m-grams of paths with the largest weight of a path through them."""
    w = F.split("phrase", " ")
    each = paths.select("lang", "n", w.alias("w")).select(
        "lang", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - (m - 1)), lambda i: F.array_join(F.slice("w", i, m), " "))).alias("gram"))
    return each.groupBy("lang", "gram").agg(F.max("n").alias("most"))


def collocations(docs: DataFrame, cfg: PhraseConfig = PhraseConfig()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best ``top`` phrases of each language."""
    counted = counts(docs, cfg)
    words = counted.filter(F.col("h").isNull()).select("lang", "gram", "n")
    found = flows(graph(docs, counted, cfg), cfg)
    enough = F.col("n") >= cfg.min_count
    heavy = {m: materialize(f.filter(enough).select("lang", "gram", "n", F.lit(m).alias("m")), f"heavy_{m}") for m, f in found.items()}
    paths = materialize(unary_paths(heavy[cfg.max_words], heavy[cfg.max_words - 1], cfg), "paths") if cfg.max_words > 2 else None

    # what a longer candidate of the same count holds is dropped; one word longer is enough to look at
    longer = None
    for m in range(2, cfg.max_words):
        if m == cfg.max_words - 1:
            inside = _nodes_of(paths, m)
        else:
            both = F.explode(F.array(_head("gram", m), _tail("gram", m)))
            inside = heavy[m + 1].select("lang", "n", both.alias("gram")).groupBy("lang", "gram").agg(F.max("n").alias("most"))
        longer = inside if longer is None else longer.unionByName(inside)
    every = heavy[2]
    for m in range(3, cfg.max_words + 1):
        every = every.unionByName(heavy[m])
    kept = every if longer is None else every.join(longer, ["lang", "gram"], "left").filter(F.coalesce("most", F.lit(0)) < F.col("n")).drop("most")

    known = every.filter(F.col("m") < cfg.max_words).select("lang", "gram", "n").unionByName(words.filter(enough))
    cut = kept.select("lang", "gram", F.col("n").alias("a"), "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cut = cut.select("lang", "gram", "a", "k", F.expr("substring_index(gram, ' ', k)").alias("first"), F.expr("substring_index(gram, ' ', k - m)").alias("rest"))
    left = known.select("lang", F.col("gram").alias("first"), F.col("n").alias("l"))
    right = known.select("lang", F.col("gram").alias("rest"), F.col("n").alias("r"))
    # one row per language, several times, so that the rows of a large language do not meet in one task
    salts = 32
    totals = words.groupBy("lang").agg(F.sum("n").alias("n")).select("lang", "n", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    scored = (
        cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
        .withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(salts)).cast("int")).join(totals, ["lang", "salt"])
        .withColumns({"up": F.lit(1000).cast("decimal(38,0)") * wide("a") * wide("n"), "down": wide("l") * wide("r")})
        .withColumn("score", F.expr("up div down"))
        .groupBy("lang", "gram", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
        .select("lang", F.col("gram").alias("phrase"), "a", "c.l", "c.r", "n", "c.score")
    )
    # ranks up to a limit: every task keeps its first ``top`` rows of a language before the shuffle
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cfg.top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def oracle(cfg: PhraseConfig = PhraseConfig()) -> str:
    """Brute force in SQL: every gram of every piece, every cut, every longer candidate."""
    return rf"""
WITH p AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p
), g AS MATERIALIZED (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS gram, count(*) AS n
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), (SELECT unnest(range(1, {cfg.max_words + 1})) AS m)
  WHERE i + m - 1 <= len(w) GROUP BY ALL
), total AS (SELECT lang, sum(n) AS n FROM g WHERE m = 1 GROUP BY lang
), cand AS MATERIALIZED (SELECT lang, gram, m, n AS a, string_split(gram, ' ') AS w FROM g WHERE m > 1 AND n >= {cfg.min_count}
), held AS (
  SELECT DISTINCT s.lang, s.gram FROM (
    SELECT lang, a, array_to_string(w[i : i + k - 1], ' ') AS sub
    FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM cand), (SELECT unnest(range(2, {cfg.max_words})) AS k) WHERE k < m AND i + k - 1 <= m
  ) l JOIN cand s ON s.lang = l.lang AND s.gram = l.sub AND 100 * l.a >= 100 * s.a
), cuts AS (
  SELECT c.lang, c.gram, c.a, c.k, x.n AS l, y.n AS r, t.n,
    (1000 * CAST(c.a AS HUGEINT) * CAST(t.n AS HUGEINT)) // (CAST(x.n AS HUGEINT) * CAST(y.n AS HUGEINT)) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) c JOIN total t ON t.lang = c.lang
  JOIN g x ON x.lang = c.lang AND x.gram = array_to_string(c.w[1 : c.k], ' ')
  JOIN g y ON y.lang = c.lang AND y.gram = array_to_string(c.w[c.k + 1 : c.m], ' ')
  WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.lang = c.lang AND h.gram = c.gram)
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank, gram AS phrase, CAST(a AS BIGINT) AS a,
  CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best QUALIFY rank <= {cfg.top}
"""


ORACLE_SQL = oracle()
