"""Filters that keep rows out of a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a map of keys: 2^27 bits are two million words of 64.
MAP_BITS = 27


def maybe_among(df: DataFrame, value: Column, keys: DataFrame, bits: int = MAP_BITS) -> DataFrame:
    """The rows of ``df`` whose ``value`` may be among the (only) column of ``keys``; an exact join has to follow.

    Hashes of the keys set bits of a map that is broadcast. It has 2^bits bits, so its
    size is bounded whatever the keys'; where it fills up, more rows pass. Null is never among them.
    """
    slot = lambda c: F.xxhash64(c).bitwiseAND((1 << bits) - 1)
    low = lambda c: slot(c).bitwiseAND(63).cast("int")
    key = F.col(keys.columns[0])
    one = F.call_function("shiftleft", F.lit(1).cast("long"), low(key))
    words = keys.where(key.isNotNull()).groupBy(F.shiftright(slot(key), 6).alias("_word")).agg(F.bit_or(one).alias("_bits"))
    met = df.where(value.isNotNull()).join(F.broadcast(words), F.shiftright(slot(value), 6) == F.col("_word"))
    return met.where(F.getbit("_bits", low(value)) == 1).select(*[df[c] for c in df.columns])
