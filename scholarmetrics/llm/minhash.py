"""Near-duplicate groups by min-max hashing (operator 1).

One pass over the texts hashes the distinct word shingles of each document and keeps, for
every one of ``PERMS`` permutations, both the smallest and the largest value: two signature
values per hash evaluation, each colliding with probability J. ``2 * PERMS`` values make
``BANDS`` bands of ``ROWS`` values (all rows of a band come from different permutations);
two sets with J = 0.8 miss every band with probability below 3e-6.

Equal sets collapse to one class first (a node, represented by its smallest doc_id), so
thousands of copies cost one signature in the buckets. A bitmap of a fixed size tells which
bucket keys occur twice, another one which documents are candidates, so bands and texts of
the others are never shuffled. Inside a bucket no all-pairs list is emitted:
members are linked to one hub of the bucket, links are confirmed on the full shingle sets,
components are contracted, and the hub round repeats on buckets that still hold several
components until it adds nothing. What remains are pairs of different components among the
members of unsettled buckets; an exact prefix join over their shingles finds those that can
be links, and they are confirmed on the full sets as well. Pairs are dropped unseen only by
set size (exact) or by a 160-bit sketch of the signature, which a link fails with
probability below 1e-7. No link is taken from signatures alone.

Defined results: null or empty text (no words) has an empty set and links with nothing; a
text shorter than a shingle is one shingle; rows of one doc_id with different sets are linked
each by its own set, so no text is lost with another one of the same id (a component's id is
the smallest doc_id of its rows); repeated rows stay together; rows without doc_id link with
nothing and stay; an empty table gives an empty result. Columns besides doc_id and text are
not read, and ``dedup_filter`` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, has_bit, materialize, may_hold, packed, releasing, table, unpacked
from .graph import extended

PERMS, BANDS, ROWS = 80, 32, 5
KEY_BITS, NODE_BITS = 27, 26  # bitmaps of 16 and 8 MB
BLOCK = 1 << 17  # shingles hashed at a time (keeps the arrays in cache)
SKETCH_SLACK = 37  # differing sketch bits allowed: mean 16, five and a half deviations at J = 0.8

_RNG = np.random.default_rng(20240501)
_MUL = _RNG.integers(0, 2**63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, PERMS, dtype=np.uint64)
_WORD_MUL = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


@dataclass(frozen=True)
class DedupConfig:
    words: int = 5  # words of a shingle
    percent: int = 80  # least Jaccard similarity of a link, in per cent


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of the k-word shingles of a UTF-8 text (A-Z lower-cased)."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(len(h) - k + 1, 1)
    out = np.full(n, len(h) if len(h) < k else 0, np.uint64)
    for i in range(min(k, len(h))):
        out = (out + h[i : i + n]) * _WORD_MUL[i % 64]
        out ^= out >> np.uint64(31)
    return np.unique(_mixed(out))


def digest(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits of a non-empty set."""
    return np.add.reduce(_mixed(s)), np.bitwise_xor.reduce(s * _MUL[0])


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), 2 * PERMS): minima, then maxima, of each permutation over non-empty sets."""
    sig = np.empty((len(sets), 2 * PERMS), np.uint64)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= BLOCK):
            size += len(sets[end])
            end += 1
        x = np.concatenate(sets[at:end])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : end - 1]], dtype=np.int64)]).astype(np.int64)
        for p in range(PERMS):
            v = x * _MUL[p] + _ADD[p]
            sig[at:end, p] = np.minimum.reduceat(v, starts)
            sig[at:end, PERMS + p] = np.maximum.reduceat(v, starts)
        at = end
    return sig


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
    ("bands", pa.list_(pa.int64())), ("s0", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()),
])
_OUT_DDL = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, s0 long, s1 long, s2 long"


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            for at in range(0, batch.num_rows, 1000):
                yield _sign_block(ids.slice(at, 1000), [shingles(t.as_py(), k) for t in texts.slice(at, 1000)])

    return run


def _sign_block(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    n = len(sets)
    full = [i for i, s in enumerate(sets) if len(s)]
    d1, d2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    bands, bits = np.zeros((n, BANDS), np.uint64), np.zeros((n, 3), np.uint64)
    if full:
        own = [sets[i] for i in full]
        sig = _mixed(_signatures(own))
        for j in range(0, ROWS):
            bands[full] = (bands[full] + sig[:, j * BANDS : (j + 1) * BANDS]) * _WORD_MUL[j]
            bands[full] ^= bands[full] >> np.uint64(32)
        bands[full] = _mixed(bands[full] + np.arange(BANDS, dtype=np.uint64))
        lowest = np.zeros((len(full), 192), np.uint8)
        lowest[:, : 2 * PERMS] = (sig >> np.uint64(17)).astype(np.uint8) & 1
        bits[full] = np.packbits(lowest, axis=1).view(np.uint64)
        for i, s in zip(full, own, strict=True):
            d1[i], d2[i] = digest(s)
    counts = np.array([BANDS if len(s) else 0 for s in sets], np.int32)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[full].ravel().view(np.int64) if full else np.empty(0, np.int64)))
    as_long = lambda a: pa.array(np.ascontiguousarray(a).view(np.int64))
    return pa.RecordBatch.from_arrays(
        [ids.cast(pa.int64()), pa.array(np.array([len(s) for s in sets], np.int64)), as_long(d1), as_long(d2), lists,
         *[as_long(bits[:, i]) for i in range(3)]], schema=_OUT)


def signatures(docs: DataFrame, cfg: DedupConfig = DedupConfig()) -> DataFrame:
    """Per row: set size, 128-bit set digest, band keys and sketch of the min-max signature."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(releasing(_sign(cfg.words)), _OUT_DDL)


def _shared_keys(bits):
    """(node, key) rows of nodes (node, bands) whose key may occur twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = batch.column(1)
            keys = bands.flatten().to_numpy(zero_copy_only=False)
            node = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), bands.value_lengths().to_numpy(zero_copy_only=False))
            keep = has_bit(bits.value, np.ascontiguousarray(keys))
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(keys[keep])], names=["node", "key"])

    return run


def _candidate_texts(bits, k: int):
    """(doc_id, d1, d2, text) of the rows whose doc_id the bitmap holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            held = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
            held = held[has_bit(bits.value, ids.take(pa.array(held)).to_numpy(zero_copy_only=False))]
            for at in range(0, len(held), 1000):
                part = batch.take(pa.array(held[at : at + 1000]))
                sets = [shingles(t.as_py(), k) for t in part.column(1).cast(pa.binary())]
                full = [i for i, s in enumerate(sets) if len(s)]
                d = np.array([digest(sets[i]) for i in full], np.uint64).reshape(-1, 2).view(np.int64)
                part = part.take(pa.array(full, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1])), part.column(1)],
                    names=["doc_id", "d1", "d2", "text"])

    return run


def _verify(cfg: DedupConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            keep = []
            hubs, texts = batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())
            for i in range(batch.num_rows):
                hub = hubs[i].as_py()
                if hub != last:
                    last, known = hub, shingles(hub, cfg.words)
                other = shingles(texts[i].as_py(), cfg.words)
                inter = np.intersect1d(known, other, assume_unique=True).size
                if inter and 100 * inter >= cfg.percent * (known.size + other.size - inter):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, cfg: DedupConfig) -> DataFrame:
    """The pairs (hub, rep) whose full shingle sets are similar enough. The wide text is joined on
    the member first, so a hub with many members is a skewed join by bytes that AQE splits."""
    t = texts.select("node", "text")
    wide = (
        pairs.join(t.withColumnRenamed("node", "rep").withColumnRenamed("text", "rep_text"), "rep")
        .join(t.withColumnRenamed("node", "hub").withColumnRenamed("text", "hub_text"), "hub")
        .select("hub", "rep", "hub_text", "rep_text")
    )
    return wide.mapInArrow(releasing(_verify(cfg)), "a long, b long").distinct()


def _similar(n1: Column, n2: Column, s1: list[Column], s2: list[Column], cfg: DedupConfig) -> Column:
    """Necessary conditions for a link: set sizes (exact) and sketch bits (with slack)."""
    sizes = 100 * F.least(n1, n2) >= cfg.percent * F.greatest(n1, n2)
    differ = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(s1, s2, strict=True)), F.lit(0))
    return sizes & (differ <= SKETCH_SLACK)


_SKETCH = ["s0", "s1", "s2"]


def _hub_pairs(members: DataFrame, nodes: DataFrame, cfg: DedupConfig) -> DataFrame:
    """Each member with the hub of its bucket (least label, then least node) if their labels differ."""
    hub = members.groupBy("key").agg(F.min(F.struct("label", "rep")).alias("h"))
    pairs = members.join(hub, "key").filter(F.col("label") != F.col("h.label")).select(F.col("h.rep").alias("hub"), "rep").distinct()
    n = nodes.select("node", F.struct("n", *_SKETCH).alias("s"))
    j = pairs.join(n.toDF("rep", "rs"), "rep").join(n.toDF("hub", "hs"), "hub")
    ok = _similar(F.col("rs.n"), F.col("hs.n"), [F.col(f"rs.{c}") for c in _SKETCH], [F.col(f"hs.{c}") for c in _SKETCH], cfg)
    return j.filter(ok).select("hub", "rep")


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(t.as_py(), k) for t in part.column(3).cast(pa.binary())]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    names=["node", "label", "sketch", "tokens"])

    return run


def _rest_pairs(members: DataFrame, nodes: DataFrame, texts: DataFrame, cfg: DedupConfig) -> DataFrame:
    """Pairs of different labels among the members of unsettled buckets that can still be links: an
    exact prefix join. Shingles are ordered by how many of these sets hold them; two sets of
    similarity t share a shingle in short prefixes of that order, at positions that leave room for
    the overlap t asks for. A passage that many documents share is frequent, so it stands past the
    prefixes and makes no pairs."""
    p = cfg.percent
    who = members.groupBy("rep").agg(F.min("label").alias("label"))
    sketch = nodes.select(F.col("node").alias("rep"), F.struct(*_SKETCH).alias("sketch"))
    rows = (
        who.join(sketch, "rep").join(texts.withColumnRenamed("node", "rep"), "rep")
        .select(F.col("rep").alias("node"), "label", "sketch", "text")
        .mapInArrow(releasing(_sets(cfg.words)), "node long, label long, sketch struct<s0:long,s1:long,s2:long>, tokens array<long>")
    )
    rows = materialize(rows, "rest_sets")
    n = F.size("tokens").cast("long")
    each = rows.select("node", F.explode("tokens").alias("token"))
    held = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # shingles of one set only come first in its order and can never be shared: they only shift positions
    common = each.join(held, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("common"))
    ceil = lambda x, d: F.floor((x + (d - 1)) / d).cast("long")
    base = rows.select("node", "label", "sketch", n.alias("n")).join(common, "node").withColumn("alone", F.col("n") - F.size("common"))
    probe = F.greatest(F.col("n") - ceil(p * F.col("n"), 100) + 1 - F.col("alone"), F.lit(0)).cast("int")
    index = F.col("n") - ceil(2 * p * F.col("n"), 100 + p) + 1
    prefix = (
        base.select("node", "label", "sketch", "n", "alone", index.alias("index"), F.posexplode(F.slice("common", F.lit(1), probe)).alias("i", "c"))
        .select("node", "label", "n", "sketch", F.col("c.token").alias("token"), (F.col("alone") + F.col("i")).alias("at"), "index")
    )
    prefix = materialize(prefix, "rest_prefixes")
    mixed = prefix.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("token")
    prefix = prefix.join(mixed, "token", "left_semi")
    x = prefix.select("token", *[F.col(c).alias(f"x_{c}") for c in ("node", "label", "n", "sketch", "at")])
    y = prefix.filter("at < index").select("token", *[F.col(c).alias(f"y_{c}") for c in ("node", "label", "n", "sketch", "at")])
    room = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
    ok = _similar(F.col("x_n"), F.col("y_n"), [F.col(f"x_sketch.{c}") for c in _SKETCH], [F.col(f"y_sketch.{c}") for c in _SKETCH], cfg)
    smaller = (F.col("y_n") < F.col("x_n")) | ((F.col("y_n") == F.col("x_n")) & (F.col("y_node") < F.col("x_node")))
    on = (x["token"] == y["token"]) & (F.col("x_label") != F.col("y_label")) & smaller & ok & (
        (100 + p) * room >= p * (F.col("x_n") + F.col("y_n")))
    return x.join(y, on).select(F.least("x_node", "y_node").alias("hub"), F.greatest("x_node", "y_node").alias("rep")).distinct()


def _unsettled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members, with current labels, of the buckets that hold more than one component."""
    if labels is None:
        m = members.withColumn("label", F.col("rep"))
    else:
        m = members.join(labels.toDF("rep", "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    several = m.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("key")
    return m.join(several, "key", "left_semi")


def _linked(docs: DataFrame, cfg: DedupConfig) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, rep, component) of each row of ``docs``, rep and component NULL
    where it links with nothing."""
    spark = docs.sparkSession
    broadcast = spark.sparkContext.broadcast
    sigs = materialize(signatures(docs, cfg), "signatures")
    usable = sigs.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("d1", "d2").agg(
        F.min(F.struct("doc_id", "n_shingles", *_SKETCH, "bands")).alias("r"))
    rep = materialize(classes.select(
        "d1", "d2", F.col("r.doc_id").alias("doc_id"), F.col("r.n_shingles").alias("n"), *[F.col(f"r.{c}").alias(c) for c in _SKETCH],
        F.col("r.bands").alias("bands")), "representatives")
    # a node has the number of its smallest doc_id, so hubs are the earliest documents; where two classes
    # (may) share that, a hash of both
    several = materialize(rep.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("doc_id"), "shared_ids")
    node = F.when(F.col("_several"), F.xxhash64("doc_id", "d1", "d2")).otherwise(F.col("doc_id"))
    nodes = may_hold(rep, "doc_id", several, NODE_BITS, "_several").withColumn("node", node).drop("_several")
    twice = nodes.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    twice = materialize(twice, "shared_keys")
    shared = broadcast(bitmap(twice, KEY_BITS))
    keyed = nodes.select("node", "bands").mapInArrow(releasing(_shared_keys(shared)), "rep long, key long")
    members = materialize(keyed.join(twice, "key", "left_semi"), "members")
    shared.unpersist()
    mine = materialize(
        nodes.select("node", "doc_id", "d1", "d2").join(members.select(F.col("rep").alias("node")).distinct(), "node", "left_semi"), "candidates")
    held = broadcast(bitmap(mine.select("doc_id"), NODE_BITS))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(
        releasing(_candidate_texts(held, cfg.words)), "doc_id long, d1 long, d2 long, text string")
    same = ["doc_id", "d1", "d2"]
    texts = materialize(texts.dropDuplicates(same).join(mine, same).select("node", "text"), "candidate_texts")
    held.unpersist()

    tested, labels, rounds = None, None, 0
    left = _unsettled(members, None)
    while True:
        pairs = _hub_pairs(left, nodes, cfg)
        if tested is not None:
            pairs = pairs.join(tested, ["hub", "rep"], "left_anti")
        pairs = materialize(pairs, f"hub_pairs_{rounds}")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = materialize(_confirmed(pairs, texts, cfg), f"hub_links_{rounds}")
        rounds += 1
        if found.isEmpty():
            break
        labels = extended(labels, found)
        left = materialize(_unsettled(members, labels), f"unsettled_{rounds}")
    rest = materialize(_rest_pairs(left, nodes, texts, cfg).join(tested, ["hub", "rep"], "left_anti"), "rest_pairs")
    found = materialize(_confirmed(rest, texts, cfg), "rest_links")
    if not found.isEmpty():
        labels = extended(labels, found)

    rep = nodes.select("node", "d1", "d2", F.col("doc_id").alias("rep"))
    if labels is None:
        rep = rep.withColumn("component", F.col("rep"))
    else:
        own = labels.toDF("node", "root").join(rep.select("node", "rep"), "node")
        least = own.groupBy("root").agg(F.min("rep").alias("component"))
        rep = rep.join(own.join(least, "root").select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "rep"))
    out = sigs.select("doc_id", "n_shingles", "d1", "d2").join(rep.drop("node"), ["d1", "d2"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", "n_shingles", "d1", "d2", F.when(linked, F.col("rep")).alias("rep"), F.when(linked, F.col("component")).alias("component"))


def near_duplicates(docs: DataFrame, cfg: DedupConfig = DedupConfig()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, class_id (smallest doc_id with the same
    set), component_id (smallest doc_id reachable by links), kept."""
    component = F.coalesce("component", "doc_id")
    return _linked(docs, cfg).select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("class_id"), component.alias("component_id"),
                                     F.col("doc_id").eqNullSafe(component).alias("kept"))


def _with_digest(columns: list[str], k: int):
    """Rows (_row, doc_id, text) with the digest of the text's set in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), k) for t in batch.column(2).cast(pa.binary())]
            d = np.array([digest(s) if len(s) else (0, 0) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1]))],
                names=columns)

    return run


def dedup_filter(docs: DataFrame, cfg: DedupConfig = DedupConfig()) -> DataFrame:
    """``docs`` without the rows whose doc_id is not the smallest of their component. A doc_id with a row
    that goes and another that stays is told apart by the sets of its rows."""
    gone = materialize(
        _linked(docs, cfg).filter(F.col("component") != F.col("doc_id")).select(F.col("doc_id").alias("_id"), "d1", "d2").distinct(), "removed")
    ids = gone.select("_id").distinct()
    rows = packed(docs).select("_row", F.col("_row.doc_id").cast("long").alias("_id"))
    kept = rows.join(ids, "_id", "left_anti").select("_row")
    several = materialize(
        rows.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_id").join(ids, "_id", "left_semi"), "repeated_ids")
    if not several.isEmpty():
        again = rows.join(several, "_id", "left_semi").select("_row", "_id", F.col("_row.text").alias("_text"))
        schema = again.select("_row", "_id").schema.add("d1", "long").add("d2", "long")
        told = again.mapInArrow(releasing(_with_digest(["_row", "_id", "d1", "d2"], cfg.words)), schema)
        kept = kept.unionByName(told.join(gone, ["_id", "d1", "d2"], "left_anti").select("_row"))
    return kept.select(*unpacked(docs, docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, DedupConfig(words=4)).select(
        "doc_id", "n_shingles", "component_id", "kept", "class_id")


# Brute force: all pairs of different sets that share a shingle, links by exact counts, reachability.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + least(4, len(w)) - 1), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)
), sets AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS digest FROM s GROUP BY doc_id
), cls AS (
  SELECT doc_id, n, min(doc_id) OVER (PARTITION BY digest, n) AS rep FROM sets
), rs AS (
  SELECT s.doc_id AS rep, g, n FROM s JOIN cls ON s.doc_id = cls.doc_id AND cls.rep = s.doc_id
), link AS (
  SELECT a.rep AS a, b.rep AS b FROM rs a JOIN rs b ON a.g = b.g AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT DISTINCT a AS node, a AS far FROM link UNION SELECT reach.node, link.b FROM reach JOIN link ON reach.far = link.a
), comp AS (
  SELECT node, min(far) AS component FROM reach GROUP BY node
)
SELECT d.doc_id, CAST(coalesce(cls.n, 0) AS BIGINT) AS n_shingles, coalesce(comp.component, cls.rep, d.doc_id) AS component_id,
  d.doc_id = coalesce(comp.component, cls.rep, d.doc_id) AS kept, coalesce(cls.rep, d.doc_id) AS class_id
FROM d LEFT JOIN cls ON d.doc_id = cls.doc_id LEFT JOIN comp ON comp.node = cls.rep
"""
