"""Benchmark decontamination with training suffix arrays (operator 3).

Each batch of documents is a training shard. Its words are mapped to the word ids of the
benchmark; a match can only lie inside a maximal run of benchmark words, so the shard's
suffix array holds the suffixes of those runs (of at least the shortest window), sorted to
the window depth by prefix doubling. Every test suffix is binary-searched in it: the range
found gives all places where its window occurs, and places that continue each other on one
diagonal are merged into the longest verbatim matches with their locations. Nothing is
shuffled. The benchmark goes to the executors in blocks of at most ``BLOCK_WORDS`` words
(the size bound of a broadcast); a larger benchmark takes one more pass per block.

Defined results: null or wordless texts have no words and no matches; an item without
words, and an empty benchmark, match nothing; items of the same id are one item; a null
item id counts as the empty string; an empty table of documents gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import releasing, table

WINDOW = 13
BLOCK_WORDS = 2_000_000  # benchmark words broadcast at a time

# Bytes that separate words (ASCII except digits and small letters); the bytes of
# characters beyond ASCII belong to words.
_SEPARATORS = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))
_TO_SPACE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


@dataclass(frozen=True)
class DecontaminateConfig:
    window: int = WINDOW
    # a document is contaminated from this share of hit words on (1 / share)
    hit_share: int = 20


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().translate(_TO_SPACE).split() if text else []


def suffix_table(items: list[tuple[str, list[bytes]]], window: int) -> dict:
    """A block of the benchmark: item names, word ids, and per window depth the windows of all
    items as arrays (item, offset, ids). Plain values, to be broadcast."""
    vocabulary: dict[bytes, int] = {}
    ids = [[vocabulary.setdefault(w, len(vocabulary)) for w in words] for _, words in items]
    by_depth: dict[int, list[tuple[int, int, list[int]]]] = {}
    for k, x in enumerate(ids):
        depth = min(window, len(x))
        for at in range(len(x) - depth + 1 if x else 0):
            by_depth.setdefault(depth, []).append((k, at, x[at : at + depth]))
    groups = [
        (d, np.array([g[0] for g in v]), np.array([g[1] for g in v]), np.array([g[2] for g in v], np.int64))
        for d, v in sorted(by_depth.items())
    ]
    return {"names": [name for name, _ in items], "vocabulary": vocabulary, "groups": groups}


def _suffix_order(x: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``x`` (ids; -1 ends a run) sorted by their next ``depth`` ids."""
    rank, width = x + 1, 1
    while width < depth:
        # a suffix that ends inside its prefix sorts first; the last step may overlap
        step = min(width, depth - width)
        nxt = np.zeros_like(rank)
        nxt[:-step] = rank[step:]
        # ranks are dense, so one 64-bit key holds the pair
        key = rank * (rank.max() + 1) + nxt
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        width += step
    return np.argsort(rank, kind="stable")


def _search(x: np.ndarray, order: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of each row of ``keys`` in the suffix array: its range [lo, hi)."""
    depth = keys.shape[1]
    padded = np.concatenate([x, np.full(depth, -1, np.int64)])

    def bound(after: bool) -> np.ndarray:
        lo, hi = np.zeros(len(keys), np.int64), np.full(len(keys), len(order), np.int64)
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) // 2
            at = order[np.minimum(mid, len(order) - 1)]
            less, same = np.zeros(len(keys), bool), np.ones(len(keys), bool)
            for d in range(depth):
                v = padded[at + d]
                less |= same & (v < keys[:, d])
                same &= v == keys[:, d]
                if not same.any():
                    break
            go = open_ & (less | same if after else less)
            lo = np.where(go, mid + 1, lo)
            hi = np.where(open_ & ~go, mid, hi)

    return bound(False), bound(True)


def _shard_matches(docs: list[np.ndarray], tests: dict) -> list[list[tuple[int, int, int, int]]]:
    """Per document the longest matches (item, item start, document start, length)."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in docs]
    if not docs or not tests["groups"]:
        return out
    lens = np.array([len(d) + 1 for d in docs])
    base = np.concatenate([[0], np.cumsum(lens)])
    flat = np.full(base[-1], -1, np.int64)
    for d, b in zip(docs, base, strict=False):
        flat[b : b + len(d)] = d
    # runs of benchmark words at least as long as the shortest window, with one gap between them
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (flat >= 0).astype(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= tests["groups"][0][0]
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return out
    size = ends - starts + 1
    place = np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    x = flat[place]
    for depth, item, offset, keys in tests["groups"]:
        order = _suffix_order(x, depth)
        lo, hi = _search(x, order, keys)
        n = hi - lo
        if not n.sum():
            continue
        which = np.repeat(np.arange(len(keys)), n)
        at = order[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        at = place[at]
        doc = np.searchsorted(base, at, side="right") - 1
        start, it, off = at - base[doc], item[which], offset[which]
        # windows that continue each other: same document, item and diagonal, next start
        by = np.lexsort((start, start - off, it, doc))
        doc, start, it, off = doc[by], start[by], it[by], off[by]
        new = np.ones(len(by), bool)
        new[1:] = ~((doc[1:] == doc[:-1]) & (it[1:] == it[:-1]) & (start[1:] - off[1:] == start[:-1] - off[:-1])
                    & (start[1:] == start[:-1] + 1))
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(by)]]) - 1
        for a, b in zip(first, last, strict=True):
            out[doc[a]].append((int(it[a]), int(off[a]), int(start[a]), int(start[b] - start[a]) + depth))
    return out


_MATCH = pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("length", pa.int64())])
_MATCH_DDL = "array<struct<item_id:string,item_start:long,doc_start:long,length:long>>"


def _hit_words(matches: list[dict]) -> int:
    hit = end = 0
    for a, b in sorted((m["doc_start"], m["doc_start"] + m["length"]) for m in matches):
        hit += max(0, b - max(a, end))
        end = max(end, b)
    return hit


def _matcher(tests, with_text: bool):
    """One pass: adds the block's matches to the column ``matches`` and counts hit words anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tests.value
        known = t["vocabulary"].get
        for batch in batches:
            counts, docs = [], []
            for v in batch.column(1).cast(pa.binary()):
                words = words_of(v.as_py())
                counts.append(len(words))
                docs.append(np.fromiter((known(w, -1) for w in words), np.int64, len(words)))
            rows = [
                [*before, *({"item_id": t["names"][i], "item_start": o, "doc_start": s, "length": n} for i, o, s, n in m)]
                for before, m in zip(batch.column(2).to_pylist(), _shard_matches(docs, t), strict=True)
            ]
            out = {"_row": batch.column(0)} | ({"_text": batch.column(1)} if with_text else {})
            out |= {"matches": pa.array(rows, pa.list_(_MATCH)), "n_words": pa.array(counts, pa.int64()),
                    "n_hit": pa.array([_hit_words(m) for m in rows], pa.int64())}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def _test_blocks(benchmark: DataFrame, window: int) -> Iterator[dict]:
    """The benchmark in blocks of at most BLOCK_WORDS words (one item more at most)."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("binary"))
    for name, text in rows.toLocalIterator():
        words = words_of(bytes(text) if text is not None else None)
        if words:
            block.append((name, words))
            size += len(words)
        if size >= BLOCK_WORDS:
            yield suffix_table(block, window)
            block, size = [], 0
    if block:
        yield suffix_table(block, window)


def find_matches(docs: DataFrame, benchmark: DataFrame, cfg: DecontaminateConfig = DecontaminateConfig(),
                 keep: list[str] | None = None) -> DataFrame:
    """(_row: struct of the ``keep`` columns, all by default; n_words; n_hit: words inside a match;
    matches: item_id, item_start, doc_start, length in words) per document."""
    keep = docs.columns if keep is None else keep
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col("text").alias("_text"),
                       F.lit(None).cast(_MATCH_DDL).alias("matches"))
    rows = rows.withColumn("matches", F.coalesce("matches", F.array().cast(_MATCH_DDL)))
    row_ddl = f"_row {rows.schema['_row'].dataType.simpleString()}"
    blocks = list(_broadcasts(spark, benchmark, cfg.window))
    for k, block in enumerate(blocks):
        more = k + 1 < len(blocks)
        ddl = f"{row_ddl}, {'_text string, ' if more else ''}matches {_MATCH_DDL}, n_words long, n_hit long"
        rows = rows.select("_row", "_text", "matches").mapInArrow(releasing(_matcher(block, more)), ddl)
    return rows.select("_row", "n_words", "n_hit", "matches")


def _broadcasts(spark: SparkSession, benchmark: DataFrame, window: int):
    """One broadcast per block of the benchmark; an empty one if there is no item with a word."""
    found = False
    for tests in _test_blocks(benchmark, window):
        found = True
        yield spark.sparkContext.broadcast(tests)
    if not found:
        yield spark.sparkContext.broadcast(suffix_table([], window))


def contaminated(cfg: DecontaminateConfig = DecontaminateConfig()):
    return (F.col("n_hit") > 0) & (cfg.hit_share * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, cfg: DecontaminateConfig = DecontaminateConfig()) -> DataFrame:
    """``docs`` without the contaminated documents."""
    return find_matches(docs, benchmark, cfg).filter(~contaminated(cfg)).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = find_matches(docs.select("doc_id", "text"), benchmark, keep=["doc_id"])
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select(
        F.col("_row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n,
    array_to_string(list_slice(w, p, p + least(13, len(w)) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), m AS (
  SELECT DISTINCT doc_id, item_id, p, dw.n FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n
), hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
