"""Rows whose key a table names: a bit filter of the keys at the scan, an exact semi join behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch

#: Bits for each key, and in all at most (2 MB in each task); places that a key sets.
KEY_BITS, MOST_BITS, PLACES = 12, 1 << 24, 3
#: Share of other keys that a filter may let through and still be worth its cost.
WORTH = 0.5


def _places(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key.cast("string"), F.lit(k)), F.lit(bits)) for k in range(PLACES)]


def bit_filter(keys: DataFrame, key: str, most_bits: int = MOST_BITS) -> tuple[list[int], int, float]:
    """(words of 64 bits, number of bits, measured share of other keys that pass) of the keys of a table.

    The words are made on Spark; the driver collects them, ``most_bits`` / 64 longs at most. Keys beyond what so many bits hold apart fill them up, which the measured share shows.
    """
    n = keys.agg(F.approx_count_distinct(key)).first()[0]
    bits = 64
    while bits < min(most_bits, KEY_BITS * max(1, n)):
        bits *= 2
    at = keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*_places(F.col(key), bits))).alias("at"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    words = [0] * (bits // 64)
    for r in at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(one).alias("bits")).collect():
        words[r["word"]] = r["bits"]
    filled = sum((w & (1 << 64) - 1).bit_count() for w in words) / bits
    return words, bits, filled**PLACES


def passes(key: Column, words: list[int], bits: int) -> Column:
    """Whether a key may be in the filter; false for null."""
    table, out = F.lit(words), key.isNotNull()
    for at in _places(key, bits):
        out = out & (F.shiftrightunsigned(F.get(table, F.floor(at / 64).cast("int")), 0).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))) != 0)
    return out


def needed_rows(rows: DataFrame, keys: DataFrame, key: str, most_bits: int = MOST_BITS) -> DataFrame:
    """Rows whose ``key`` is one of ``keys``: the filter drops nearly all others where they are read, so only what passes is shuffled for the exact join.

    Where so many keys are needed that half of the others would pass, there is no filter. Null keys match nothing.
    """
    work = Scratch(rows.sparkSession, "keys")
    distinct = work.save(keys.select(key).where(F.col(key).isNotNull()).distinct(), "distinct")
    words, bits, share = bit_filter(distinct, key, most_bits)
    if share <= WORTH:
        rows = rows.where(passes(F.col(key), words, bits))
    return rows.join(distinct, key, "left_semi")
