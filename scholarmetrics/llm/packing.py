"""Packing documents into training sequences by cutting-stock column generation (operator 12).

1. One pass encodes every text and writes its pieces with their ids: a document longer than a
   sequence is cut at multiples of the sequence length, any other is one piece. A piece's class
   is its length rounded up to ``GRID`` tokens. Each task numbers its pieces per class.
2. Counts per (task, class), as prefix sums, give the rank of every piece in its class; the
   histogram over classes (at most length / GRID rows, whatever the table's size) goes to the
   driver.
3. Column generation on that histogram: a linear program over patterns (how many pieces of each
   class share a sequence), solved by the revised simplex method; a knapsack dynamic program
   over the sequence length prices new patterns until the program is within ``GAP`` of its bound. The
   patterns are rounded down, and what is left over (less than one sequence per pattern) is
   filled first-fit by decreasing length.
4. Pattern p covers a range of ranks of each of its classes, so a piece finds its sequence and
   place from (class, rank) by a lookup in the pattern table, which is broadcast: its size
   depends on the number of classes only.
5. A running sum per sequence gives offsets. A sequence that would need more than
   ``max_padding`` tokens of padding, as the last ones of a run or where no lengths go together,
   is cut into sequences of the powers of two of its length, which need none.

Ids travel once, in the join of the pieces with their places.

Defined results: a null or empty text has its end id only; rows are packed each, whatever their
doc_id, so repeated and null doc_ids stay; documents of any length are cut, never shortened;
equal lengths are placed in the order of the tasks that read them; an empty table gives an
empty result. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.io import scratch_path
from .common import releasing, table
from .tokenfiles import id_type

GRID = 8  # lengths of a class differ by less than this
GAP = 5e-4  # the linear program ends within this part of its bound
ROUNDS = 2000  # columns at most; ending earlier costs padding, never pieces
KNOWN = 700_000  # distinct words of a generation that a worker remembers
GROUP = 500  # new words encoded in one call of the library
STEP = 200  # texts encoded at a time
MARK = "\x01"  # stands between words that are encoded together; ends with a byte that ends no other character


@dataclass(frozen=True)
class PackConfig:
    length: int = 4096  # tokens of a sequence, a power of two
    end_id: int = 2
    max_padding: int = 64

    def __post_init__(self):
        if self.length < GRID or self.length & (self.length - 1):
            raise ValueError(f"length must be a power of two from {GRID} on")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


# -- encoding ---------------------------------------------------------------------------


def drops_space(definition: str) -> bool:
    """The tokenizer keeps only what its pattern matches, and the pattern matches no white space: texts
    can be cut there and their words encoded one by one."""
    d = json.loads(definition)
    steps = lambda x, inner: [] if x is None else x[inner] if x["type"] == "Sequence" else [x]
    norm = {s["type"] for s in steps(d.get("normalizer"), "normalizers")}
    pre = steps(d.get("pre_tokenizer"), "pretokenizers")
    first = pre[0] if pre else {"type": None}
    return (norm <= {"NFC", "Replace", "Lowercase"} and first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"]
            and "\\S" not in first["pattern"].get("Regex", "\\S") and "." not in first["pattern"]["Regex"])


class WordEncoder:
    """Encodes texts with a tokenizers model. Where the model drops white space every distinct word is
    encoded once and kept as the bytes of its ids; two generations of words bound the memory."""

    def __init__(self, definition: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.by_word = Tokenizer.from_str(definition), dtype, drops_space(definition)
        mark = self.ids([MARK])[0]
        self.mark = mark[0] if len(mark) == 1 else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_new(self, words: list[str]) -> None:
        plain = [w for w in words if MARK not in w and "<|" not in w] if self.mark is not None else []
        groups = [plain[i : i + GROUP] for i in range(0, len(plain), GROUP)]
        for group, ids in zip(groups, self.ids([f" {MARK} ".join(g) for g in groups]), strict=True):
            a = np.array(ids, self.dtype)
            raw, width, start = a.tobytes(), a.itemsize, 0
            for w, end in zip(group, np.append(np.flatnonzero(a == self.mark), len(a)).tolist(), strict=True):
                self.young[w] = raw[start * width : end * width]
                start = end + 1
        rest = list(set(words).difference(plain))
        for w, ids in zip(rest, self.ids(rest), strict=True):
            self.young[w] = np.array(ids, self.dtype).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        if not self.by_word:
            return [np.array(ids, self.dtype).tobytes() for ids in self.ids([t or "" for t in texts])]
        words = [t.replace("\n", " ").replace("\t", " ").split(" ") if t else [] for t in texts]
        if len(self.young) > KNOWN:
            self.old, self.young = self.young, {}
        self.young[""] = b""
        missing = set().union(*words).difference(self.young)
        # the comma or stop after a letter is a match of its own: the word is encoded without it (only after
        # letters that stay one letter in lower case and NFC)
        tailed = [w for w in missing if w[-1] in ",." and w[-2:-1].isalpha() and w[-2] < "\u0130"]
        missing.difference_update(tailed)
        missing.update([w[:-1] for w in tailed if w[:-1] not in self.young], [t for t in ",." if t not in self.young])
        new = []
        for w in missing:
            known = self.old.get(w)
            if known is None:
                new.append(w)
            else:
                self.young[w] = known
        if new:
            self._encode_new(new)
        for w in tailed:
            self.young[w] = self.young[w[:-1]] + self.young[w[-1]]
        get = self.young.__getitem__
        return [b"".join(map(get, own)) for own in words]


PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
    ("class", pa.int32()), ("part", pa.int32()), ("nth", pa.int64()), ("row", pa.int64()), ("ids", pa.binary()),
])
PIECES_DDL = "doc_id long, start long, length long, doc_tokens long, class int, part int, nth long, row long, ids binary"


def _encode(shared, cfg: PackConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, seen, own = TaskContext.get().partitionId(), 0, defaultdict(int), shared.value
        if "encoder" not in own:  # kept with the worker's copy of the broadcast
            own["encoder"] = WordEncoder(own["definition"], own["dtype"])
        encoder, width = own["encoder"], np.dtype(own["dtype"]).itemsize
        end = np.array([cfg.end_id], own["dtype"]).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                rows, out = batch.slice(at, STEP), []
                for doc_id, ids in zip(rows.column(0).to_pylist(), encoder.encode(rows.column(1).to_pylist()), strict=True):
                    ids += end
                    tokens = len(ids) // width
                    for start in range(0, tokens, cfg.length):
                        n = min(cfg.length, tokens - start)
                        kind = -(-n // GRID)
                        out.append((doc_id, start, n, tokens, kind, part, seen[kind], row, ids[start * width : (start + n) * width]))
                        seen[kind] += 1
                        row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PIECES, strict=True)], schema=PIECES)

    return run


# -- planning -----------------------------------------------------------------------------


def _knapsack(lengths: np.ndarray, value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: (value, count of each class), any number of each that fits ``room``."""
    use = np.flatnonzero(value > 1e-12)
    kinds, worth = lengths[use], value[use]
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(kinds, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]  # one unit left free
        if fits[c]:
            v = best[c - kinds[: fits[c]]] + worth[: fits[c]]
            k = int(v.argmax())
            if v[k] > best[c]:
                best[c], pick[c] = v[k], k
    counts, c = np.zeros(len(lengths)), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[use[pick[c]]] += 1
            c -= int(kinds[pick[c]])
    return float(best[room]), counts


class _Basis:
    """Columns of the linear program with the inverse of their matrix and their values. Products are
    elementwise: threaded linear algebra must not start in a driver that has forked."""

    def __init__(self, lengths: np.ndarray, room: int):
        plain = (room // lengths).astype(float)
        self.columns, self.inverse, self.x = np.diag(plain), np.diag(1 / plain), np.zeros(len(lengths))

    def step(self, pattern: np.ndarray) -> np.ndarray:
        return (self.inverse * pattern).sum(axis=1)

    def enter(self, pattern: np.ndarray, leave: int, step: np.ndarray, size: float) -> None:
        pivot = self.inverse[leave] / step[leave]
        others = step.copy()
        others[leave] = 0
        self.inverse -= np.outer(others, pivot)
        self.inverse[leave] = pivot
        self.columns[:, leave], self.x[leave] = pattern, size


def _first_fit(basis: _Basis, lengths: np.ndarray, demand: np.ndarray, room: int) -> None:
    """Fill the basis by fractional first fit with decreasing lengths. Every pattern uses up a class and
    takes the place of its plain column; a class used up on the way keeps that, with value 0."""
    left = demand.copy()
    while left.any():
        counts, free = np.zeros(len(lengths)), room
        for i in np.flatnonzero(left)[::-1]:
            counts[i] = min(free // lengths[i], max(1, int(left[i])))
            free -= counts[i] * lengths[i]
        at = np.flatnonzero(counts)
        most = left[at] / counts[at]
        last, size = at[most.argmin()], most.min()
        basis.enter(counts, last, basis.step(counts), size)
        left[at] -= counts[at] * size
        left[last] = 0
        left[left < 1e-9 * demand] = 0


def solve(lengths: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[float, np.ndarray]]:
    """Fractional sequences per pattern: the linear program min sum(x), patterns @ x = demand, by the
    revised simplex method with generated columns. ``lengths`` ascend, each at most ``room``. Prices are
    smoothed towards the ones of the best bound so far (at first a length's share of a
    sequence), as plain simplex prices swing widely."""
    basis = _Basis(lengths, room)
    _first_fit(basis, lengths, demand, room)
    centre = lengths / room
    bound = (centre * demand).sum()
    for _ in range(ROUNDS):
        if basis.x.sum() <= bound * (1 + GAP):
            break
        duals = basis.inverse.sum(axis=0)  # every pattern costs one sequence
        for share in (0.8, 0.4, 0.0):
            prices = np.maximum(share * centre + (1 - share) * duals, 0)
            value, pattern = _knapsack(lengths, prices, room)
            # no pattern is worth more than ``value``: prices / value are a feasible dual
            worth = (prices * demand).sum()
            if value > 0 and worth / value > bound:
                centre, bound = prices / value, worth / value
            if (pattern * duals).sum() > 1 + 1e-9:
                break
        else:
            break
        step = basis.step(pattern)
        up = np.flatnonzero(step > 1e-9)
        leave = up[np.argmin(basis.x[up] / step[up])]
        size = basis.x[leave] / step[leave]
        np.maximum(basis.x - size * step, 0, out=basis.x)
        basis.enter(pattern, leave, step, size)
    return [(float(n), column.astype(np.int64)) for n, column in zip(basis.x, basis.columns.T, strict=True)]


def plan(histogram: dict[int, int], room: int) -> list[tuple[int, dict[int, int]]]:
    """(sequences, pieces of each class in one) of a histogram class -> pieces; every piece has one place."""
    kinds = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[k] for k in kinds.tolist()], np.int64)
    out = []

    def use(n: int, counts: np.ndarray) -> None:
        at = np.flatnonzero(counts)
        n = min(n, int((left[at] // counts[at]).min())) if len(at) else 0
        if n > 0:
            left[at] -= n * counts[at]
            out.append((n, {int(kinds[i]): int(counts[i]) for i in at[::-1]}))

    if len(kinds):
        for x, counts in solve(kinds, left.astype(float), room):
            use(int(x + 1e-6), counts)
    while left.any():  # less than one sequence per pattern
        counts, free = np.zeros(len(kinds), np.int64), room
        for i in range(len(kinds) - 1, -1, -1):
            counts[i] = min(left[i], free // kinds[i])
            free -= counts[i] * kinds[i]
        use(int(left.max()), counts)
    return out


def slots(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, end rank, first sequence, pieces a sequence, first place in it) of each class
    of each pattern."""
    taken, sequence, out = defaultdict(int), 0, []
    for n, counts in patterns:
        place = 0
        for kind, a in counts.items():
            out.append((kind, taken[kind], taken[kind] + n * a, sequence, a, place))
            taken[kind] += n * a
            place += a
        sequence += n
    return out


# -- tables ----------------------------------------------------------------------------------


def pieces(docs: DataFrame, cfg: PackConfig = PackConfig(), tokenizer_path: str | None = None) -> DataFrame:
    """Encoded pieces, written once."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    tokenizer = Tokenizer.from_file(tokenizer_path or default_tokenizer())
    shared = spark.sparkContext.broadcast({"definition": tokenizer.to_str(), "dtype": id_type(max(tokenizer.get_vocab_size(), cfg.end_id + 1))})
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    path = scratch_path(spark, "pieces")
    rows.mapInArrow(releasing(_encode(shared, cfg)), PIECES_DDL).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(PIECES_DDL).parquet(path)


def places(parts: DataFrame, cfg: PackConfig = PackConfig()) -> DataFrame:
    """(part, row, sequence, offset, total) of every piece: where it lies, and the tokens of its sequence."""
    spark = parts.sparkSession
    counts = parts.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"))
    # one row per class and task
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    histogram = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    found = spark.createDataFrame(slots(plan(histogram, cfg.length // GRID)),
                                  "class int, first long, last long, sequence long, each long, place long")
    small = parts.select("part", "row", "class", "nth", "length")
    ranked = small.join(base, ["class", "part"]).withColumn("rank", F.col("nth") + F.col("base"))
    on = (ranked["class"] == found["class"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    nth = F.col("rank") - F.col("first")
    placed = ranked.join(F.broadcast(found), on).select(
        "part", "row", "length", (F.col("sequence") + F.floor(nth / F.col("each"))).alias("sequence"), (F.col("place") + nth % F.col("each")).alias("place"))
    mine = Window.partitionBy("sequence")  # at most length / GRID pieces
    up_to = mine.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("part", "row", "length", "sequence", F.coalesce(F.sum("length").over(up_to), F.lit(0)).alias("offset"),
                         F.sum("length").over(mine).alias("total"))


def pack(docs: DataFrame, cfg: PackConfig = PackConfig(), tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids) of every piece; ids are
    little-endian unsigned integers of the width that the vocabulary needs."""
    parts = pieces(docs, cfg, tokenizer_path)
    where = places(parts, cfg)
    # a sequence with too much padding becomes one for each power of two in its length, the largest first;
    # the bits above a power say where it starts
    powers = [1 << b for b in range(cfg.length.bit_length() - 1, -1, -1)]
    total, offset, end = F.col("total"), F.col("offset"), F.col("offset") + F.col("length")
    whole = (F.lit(cfg.length) - total <= cfg.max_padding)
    start_of = lambda p: total - total % (2 * p)
    cut = [F.when((F.floor(total / p) % 2 == 1) & (offset < start_of(p) + p) & (end > start_of(p)),
                  F.struct(F.lit(b).cast("long").alias("b"), start_of(p).alias("at"),
                           F.greatest(offset, start_of(p)).alias("lo"), F.least(end, start_of(p) + p).alias("hi")))
           for b, p in [(p.bit_length(), p) for p in powers]]
    one = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("at"), offset.alias("lo"), end.alias("hi"))
    split = F.explode(F.when(whole, F.array(one)).otherwise(F.filter(F.array(*cut), lambda s: s.isNotNull())))
    where = where.select("part", "row", "sequence", "offset", split.alias("s"))
    width = F.expr("length(ids) div length")
    take = lambda c: (c * width).cast("int")
    skip, n = F.col("s.lo") - F.col("offset"), F.col("s.hi") - F.col("s.lo")
    return parts.select("part", "row", "doc_id", "start", "length", "doc_tokens", "ids").join(where, ["part", "row"]).select(
        "doc_id", (F.col("start") + skip).alias("start"), n.alias("length"), "doc_tokens",
        # up to 14 sequences come from one
        (F.col("sequence") * 64 + F.col("s.b")).alias("sequence_id"), (F.col("s.lo") - F.col("s.at")).alias("offset"),
        F.col("ids").substr(take(skip) + 1, take(n)).alias("ids"))


def sequences(packed: DataFrame, cfg: PackConfig = PackConfig()) -> DataFrame:
    """One row per sequence: its ids in order, its length and the length after padding."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # one sequence: bounded by its length
    n = F.sum("length")
    power = F.pow(F.lit(2), F.ceil(F.log2(n))).cast("long") == n
    return packed.groupBy("sequence_id").agg(
        n.alias("length"), F.when(power, n).otherwise(F.lit(cfg.length)).alias("padded"), own.alias("s")).select(
        "sequence_id", "length", "padded", F.aggregate("s", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def _digest(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(np.frombuffer(x.as_buffer(), dtype).astype("<u4").tobytes()) for x in batch.column(6)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(crc, pa.int64())], names=[*batch.schema.names[:6], "ids_crc32"])

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenizers import Tokenizer

    dtype = id_type(Tokenizer.from_file(default_tokenizer()).get_vocab_size())
    packed = pack(table(spark, sf_dir, "documents"))
    return packed.mapInArrow(
        releasing(_digest(dtype)), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long")
