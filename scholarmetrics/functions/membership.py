"""Membership filters of a fixed size, as broadcast bitmaps and in native expressions.

A set of long values becomes one bit per value hash modulo 2 ** bits: at most 2 ** (bits - 3)
bytes whatever the set's size, so the broadcast has a proven bound. A filter may let a value
through that is not in the set, never the other way round; an exact join follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 15  # bits of a place inside a block: blocks of 4 KB


def bitmap_blocks(values: DataFrame, bits: int) -> DataFrame:
    """(b, bits): the set bits of block b of the one-column frame ``values``; at most 2 ** (bits - 15) rows."""
    place = F.col(values.columns[0]).bitwiseAND(F.lit((1 << bits) - 1))
    return values.groupBy(F.shiftright(place, BLOCK).cast("int").alias("b")).agg(
        F.bitmap_construct_agg(place.bitwiseAND(F.lit((1 << BLOCK) - 1))).alias("bits"))


def bitmap_words(values: DataFrame, bits: int) -> DataFrame:
    """``bitmap_blocks`` as arrays of long words, of which one can be read without a copy of its block."""
    word = lambda i: F.conv(F.hex(F.col("bits").substr(i * 8 + 1, F.lit(8))), 16, -10).cast("long")
    words = F.transform(F.sequence(F.lit(0), F.lit((1 << (BLOCK - 6)) - 1)), word)
    return bitmap_blocks(values, bits).select("b", words.alias("words"))


def may_hold(df: DataFrame, key: str, values: DataFrame, bits: int, name: str) -> DataFrame:
    """``df`` with the flag ``name``: false where the long column ``key`` is surely not among ``values``."""
    place = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    low = place.bitwiseAND(F.lit((1 << BLOCK) - 1)).cast("int")
    # byte 0 of a word is its highest; bit 0 of a byte its lowest
    shift = (7 - F.shiftright(low, 3).bitwiseAND(F.lit(7))) * 8 + low.bitwiseAND(F.lit(7))
    blocks = bitmap_words(values, bits).toDF("_b", "_words")
    hit = F.call_function("shiftright", F.get("_words", F.shiftright(low, 6)), shift).bitwiseAND(F.lit(1)) == 1
    joined = df.join(F.broadcast(blocks), F.shiftright(place, BLOCK).cast("int") == F.col("_b"), "left")
    return joined.select(*df.columns, F.coalesce(hit, F.lit(False)).alias(name))
