"""Shared helpers: reading tables, materialising steps, row packing, ASCII words."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import scratch_path

# The word classes of the corpus contracts (ASCII white space only).
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet to the cluster's shared scratch folder and read it back:
    cuts the lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once (bound as a lambda variable), so a
    costly array is not recomputed for each element of a higher-order function."""
    return F.transform(F.array(value), body).getItem(0)


def ascii_words(text: Column) -> Column:
    """Maximal runs of non-space characters (ASCII white space), empty for null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def packed(df: DataFrame, alias: str = "_row") -> DataFrame:
    """The rows as one struct column, so that added columns never clash with given ones."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(alias))


def unpacked(df: DataFrame, columns: list[str], alias: str = "_row") -> list[Column]:
    return [F.col(alias).getField(c).alias(c) for c in columns]


def _bitmap_parts(hashes: DataFrame, bits: int) -> DataFrame:
    """(b, bits): the set bits of block b, 4 KB each; at most 2 ** (bits - 15) rows."""
    place = F.col(hashes.columns[0]).bitwiseAND(F.lit((1 << bits) - 1))
    return hashes.groupBy(F.shiftright(place, 15).cast("int").alias("b")).agg(
        F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias("bits"))


def may_hold(df: DataFrame, key: str, values: DataFrame, bits: int, name: str) -> DataFrame:
    """``df`` with the flag ``name``: false where the long column ``key`` is surely not among ``values``
    (one long column). The bitmap is broadcast, of a size that ``bits`` bounds; no Python."""
    place = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    low = place.bitwiseAND(F.lit(32767)).cast("int")
    byte = F.conv(F.hex(F.col("_m.bits").substr((F.floor(low / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    parts = _bitmap_parts(values, bits).select(F.col("b").alias("_b"), F.struct("bits").alias("_m"))
    hit = F.call_function("shiftright", byte, (low % 8)).bitwiseAND(F.lit(1)) == 1
    joined = df.join(F.broadcast(parts), F.shiftright(place, 15).cast("int") == F.col("_b"), "left")
    return joined.select(*df.columns, F.coalesce(hit, F.lit(False)).alias(name))


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """One bit per value of the only column (a long hash) modulo 2 ** bits, as bytes: a set of a fixed size
    that may hold more, never less. At most 2 ** (bits - 15) rows of 4 KB reach the driver."""
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in _bitmap_parts(hashes, bits).toLocalIterator():
        out[r["b"] << 12 : (r["b"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return out


def has_bit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (64-bit) a ``bitmap`` holds."""
    at = hashes.view(np.uint64) & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class Numbered(dict):
    """Gives every new key the next number."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


Batches = Iterator[pa.RecordBatch]


def releasing(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for mapInArrow, giving back the memory of its task at the end: Python workers stay
    alive between tasks, and what they keep counts against the executor."""

    def wrapped(batches: Batches) -> Batches:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
        if trim is not None:
            trim(0)

    return wrapped
