"""Vector code compression: integer codebooks per part, nearest entries by a Walsh-Hadamard transform
(operator 13).

Every component becomes an integer once (``floor(scale * x)``), natively, and the integer
vectors are written as a table; nothing after that uses floating point. A vector is cut into
equal parts. Each part and each codebook entry is zero-padded to a power of two P and
transformed by the integer Walsh-Hadamard transform, which multiplies squared distances by
exactly P. The scaled squared differences are added up coefficient by coefficient in
sequency order (fewest sign changes first: most of the energy of smooth parts). What is not
added yet of a pair is at most twice the sum of both tails' energies, so an entry whose sum so
far exceeds the least such upper bound of its rivals can't be nearest and is dropped early;
ties are never dropped, and go to the lowest index.

Training: the codebooks start as the parts of the first kept vectors by id. A round is one
pass over the vectors in which each task returns one row per (part, entry) with a count and
sums; Spark adds them up and the driver gets parts * entries * part-length numbers, whatever
the table's size. The codebooks, of the same fixed size, go to the tasks.

Defined results: a row whose vector is null, empty or holds a null, NaN or infinite component
is dropped, and so is a vector of another length than that of the first row by vec_id. That
length must be a multiple of the number of parts (ValueError). Repeated rows count each.
Among equal vec_ids the first rows are those of the least integer vector; rows without
vec_id are coded, and start a codebook only when no others are left. Fewer kept rows than
entries give that many entries; an empty table gives an empty result. A sum or an error
beyond 64 bits is an error, never a wrong number. Columns besides the three are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, releasing, table

STEP = 8192  # vectors coded at a time
HOT_SHARE = 1000  # a label that holds at least this part (1 / HOT_SHARE) of all rows is hot: at most HOT_SHARE of them


@dataclass(frozen=True)
class CodeConfig:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096

    def __post_init__(self):
        if not 1 <= self.entries <= 256:
            raise ValueError("a code has two hex digits a part: 1 to 256 entries")
        if self.parts < 1 or self.rounds < 0 or self.scale < 1:
            raise ValueError("parts and scale must be positive, rounds not negative")


# -- arithmetic ---------------------------------------------------------------------


def padded(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def transform(x: np.ndarray) -> np.ndarray:
    """Integer Walsh-Hadamard transform of the rows (length a power of two), natural order."""
    n, size = x.shape
    h = 1
    while h < size:
        y = x.reshape(n, size // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, size)
        h *= 2
    return x


def sequency(size: int) -> np.ndarray:
    """The natural-order places of the transform's rows by their number of sign changes."""
    rows = transform(np.eye(size, dtype=np.int64))
    return np.argsort((rows[:, 1:] != rows[:, :-1]).sum(axis=1), kind="stable")


def _exact(x: np.ndarray, entries: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers where no bound of ``nearest`` can overflow, else as Python integers."""
    top = max((int(abs(a).max()) for a in (x, entries) if a.size), default=0)
    if top == abs(np.iinfo(np.int64).min) or 4 * size**3 * top * top >= 1 << 62:
        return x.astype(object), entries.astype(object)
    return x, entries


def _spectrum(x: np.ndarray, size: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients in sequency order, and the energy from each place on (one place more)."""
    wide = np.zeros((len(x), size), x.dtype)
    wide[:, : x.shape[1]] = x
    c = transform(wide)[:, order]
    tail = np.zeros((len(x), size + 1), x.dtype)
    tail[:, :size] = np.cumsum((c * c)[:, ::-1], axis=1)[:, ::-1]
    return c, tail


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``x`` the index of the nearest entry (ties to the lowest) and the squared distance."""
    n, k = len(x), len(entries)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    size = padded(x.shape[1])
    x, entries = _exact(x, entries, size)
    order = sequency(size)
    (a, a_tail), (b, b_tail) = _spectrum(x, size, order), _spectrum(entries, size, order)
    row, entry = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    total = np.zeros(n * k, x.dtype)
    for c in range(size):
        d = a[row, c] - b[entry, c]
        total = total + d * d
        if c + 1 < size:
            most = total + 2 * (a_tail[row, c + 1] + b_tail[entry, c + 1])
            least = np.minimum.reduceat(most, np.flatnonzero(np.diff(row, prepend=-1)))
            alive = (total <= least[row]).astype(bool)
            row, entry, total = row[alive], entry[alive], total[alive]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    best = np.minimum.reduceat(total, first)
    hit = np.flatnonzero((total == best[row]).astype(bool))
    chosen = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]
    return entry[chosen], best // size


# -- tables ---------------------------------------------------------------------------


def integers(vectors: DataFrame, cfg: CodeConfig = CodeConfig()) -> DataFrame:
    """(vec_id, label, v): the kept rows with their integer components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    given = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    kept = given.filter(F.col("e").isNotNull() & (F.size("e") > 0) & ~F.exists("e", bad))
    whole = materialize(kept.select("vec_id", "label", F.transform("e", lambda x: F.floor(x * F.lit(float(cfg.scale)))).alias("v")), "integers")
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("n")).first()
    if first is None:
        return whole
    if first["n"] % cfg.parts:
        raise ValueError(f"vectors of {first['n']} components can't be cut into {cfg.parts} equal parts")
    return whole.filter(F.size("v") == first["n"])


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            rows = batch.slice(at, STEP)
            yield rows, rows.column(column).flatten().to_numpy().reshape(rows.num_rows, -1)


def _sums(books: np.ndarray):
    """One row per (part, entry) of a task: how many parts chose the entry, and their sums."""
    parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), object)
        for _, v in _blocks(batches, 0):
            for p in range(parts):
                x = v[:, p * width : (p + 1) * width]
                chosen, _ = nearest(x, books[p])
                count[p] += np.bincount(chosen, minlength=k)
                big = int(abs(x).max()) * len(x) >= 1 << 62
                step = np.zeros((k, width), object if big else np.int64)
                np.add.at(step, chosen, x.astype(object) if big else x)
                total[p] += step
        at = np.argwhere(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array([int(count[p, e]) for p, e in at], pa.int64()),
             pa.array([[int(s) for s in total[p, e]] for p, e in at], pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"])

    return run


def train(vectors: DataFrame, cfg: CodeConfig = CodeConfig()) -> np.ndarray:
    """Codebooks (parts, entries, components of a part) of ``integers(..)`` rows after all rounds."""
    seeds = [r["v"] for r in vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(cfg.entries).collect()]
    if not seeds:
        return np.zeros((cfg.parts, 0, 0), np.int64)
    books = np.array(seeds, np.int64).reshape(len(seeds), cfg.parts, -1).transpose(1, 0, 2).copy()
    for _ in range(cfg.rounds):
        one = vectors.select("v").mapInArrow(releasing(_sums(books)), "part int, entry int, n long, sums array<long>")
        wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))  # noqa: E731  sums of sums may pass 64 bits
        added = (
            one.select("part", "entry", "n", F.posexplode("sums").alias("at", "s"))
            .groupBy("part", "entry", "at").agg(wide("n").alias("n"), wide("s").alias("s")).collect()
        )
        for r in added:
            books[r["part"], r["entry"], r["at"]] = int(r["s"]) // int(r["n"])
    return books


def _code(books: np.ndarray):
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, v in _blocks(batches, 2):
            codes, error = np.empty((len(v), parts), np.uint8), np.zeros(len(v), object)
            for p in range(parts):
                codes[:, p], d = nearest(v[:, p * width : (p + 1) * width], books[p])
                error += d
            text = codes.tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]),
                 pa.array([int(x) for x in error], pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of ``integers(..)`` rows."""
    schema = vectors.select("vec_id", "label").schema.add("code", "string").add("error", "long")
    if books.shape[1] == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    return vectors.select("vec_id", "label", "v").mapInArrow(releasing(_code(books)), schema)


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """``codes`` with ``v``, the integer vector that a code stands for."""
    parts = books.shape[0]
    lists = [F.array(*[F.array(*[F.lit(int(x)) for x in entry]) for entry in books[p]]) for p in range(parts)]
    index = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("v", F.concat(*[F.get(lists[p], index(p)) for p in range(parts)]))


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the error summed over all rows of the same label (nulls together).
    Labels with a large share of the rows, a bounded number, are broadcast, so their rows are not
    gathered; the others are joined by label."""
    totals = materialize(
        coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label_totals")
    rows = totals.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = totals.filter(F.col("n") * HOT_SHARE >= rows).select(F.col("label").alias("_l"), F.col("label_error"))
    same = coded["label"].eqNullSafe(F.col("_l"))
    by_hot = coded.join(F.broadcast(hot), same, "left")
    known = F.col("label_error").isNotNull()
    cold = totals.filter(F.col("n") * HOT_SHARE < rows).select(F.col("label").alias("_l"), F.col("label_error"))
    rest = by_hot.filter(~known).select(*coded.columns)
    done = by_hot.filter(known).select(*coded.columns, "label_error")
    return done.unionByName(rest.join(cold, rest["label"].eqNullSafe(cold["_l"])).select(*[rest[c] for c in coded.columns], "label_error"))


def compress(vectors: DataFrame, cfg: CodeConfig = CodeConfig()) -> tuple[DataFrame, np.ndarray]:
    """The codes of ``vectors`` (vec_id, embedding, label) and the codebooks trained on all of them."""
    ints = integers(vectors, cfg)
    books = train(ints, cfg)
    return materialize(encode(ints, books), "codes"), books


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    return with_label_error(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def oracle(cfg: CodeConfig = CodeConfig()) -> str:
    """Brute force in SQL: every full distance, in each round."""
    out = [f"""WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({cfg.scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), el AS MATERIALIZED (
  SELECT vec_id, label, CAST(i // (len(v) // {cfg.parts}) AS BIGINT) AS p, i % (len(v) // {cfg.parts}) AS i, v[i + 1] AS x
  FROM (SELECT vec_id, label, v, unnest(range(len(v))) AS i FROM k)
), c0 AS MATERIALIZED (
  SELECT p, e, i, x AS c FROM el JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT {cfg.entries}) USING (vec_id)
)"""]
    for r in range(cfg.rounds + 1):
        out.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, label, p, min(s * 256 + e) % 256 AS e, min(s) AS s
  FROM (SELECT vec_id, label, p, e, sum((x - c) * (x - c)) AS s FROM el JOIN c{r} USING (p, i) GROUP BY ALL) GROUP BY ALL
)""")
        if r < cfg.rounds:
            out.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c{r}.p, c{r}.e, c{r}.i, coalesce((m.s - (m.s % m.n + m.n) % m.n) // m.n, c) AS c FROM c{r}
  LEFT JOIN (SELECT p, a.e, i, sum(x) AS s, count(*) AS n FROM el JOIN a{r} a USING (vec_id, p) GROUP BY ALL) m USING (p, e, i)
)""")
    last = f"a{cfg.rounds}"
    return ",\n".join(out) + f""", coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(s) AS BIGINT) AS error FROM {last} GROUP BY ALL
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) FROM c{cfg.rounds}) AS codebooks_sha256
FROM coded"""


ORACLE_SQL = oracle()
