"""Distinct counts and quantiles that roll up: exact by bit words, approximate by stored sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.operators.joins import look_up

WHOLE = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)


def numbered(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of ``column`` with numbers from 0; meant for a dictionary's items.

    Numbers follow the order of the values, so a task that is run again gives the same ones.  That
    order is one task over the distinct values.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    return values.withColumn("_id", F.row_number().over(Window.orderBy(column)).cast("long") - 1)


def distinct_words(df: DataFrame, keys: list[str], column: str, heavy: list = []) -> DataFrame:
    """Which values each group holds: rows ``keys, _word, _bits`` of 64 values each.

    A whole number is its own id; other values are numbered by a dictionary, in whose join ``heavy``
    values are spread.  A group without values has one row without bits.  Bits are combined inside
    tasks before they are shuffled, and coarser groups combine those of finer ones.
    """
    if isinstance(df.schema[column].dataType, WHOLE):
        rows = df.select(*keys, F.col(column).cast("long").alias("_id"))
    else:
        rows = look_up(df.select(*keys, column), numbered(df, column), column, keys, heavy).select(*keys, "_id")
    known = F.col("_id").isNotNull()
    bit = F.expr("shiftleft(1L, cast(_id & 63L as int))")
    rows = rows.select(
        *keys,
        F.when(known, F.shiftright("_id", 6)).otherwise(F.lit(0).cast("long")).alias("_word"),
        F.when(known, bit).otherwise(F.lit(0).cast("long")).alias("_bits"),
    )
    return rows.groupBy(*keys, "_word").agg(F.bit_or("_bits").alias("_bits"))


def distinct_levels(
    df: DataFrame, levels: dict[str, list[str]], column: str, out: str = "n", heavy: list = []
) -> DataFrame:
    """Exact distinct counts of ``column`` at several levels of grouping, from one scan.

    ``levels`` names lists of keys.  Returns ``level``, all keys (NULL where the level lacks one)
    and ``out``.  NULL is a key like any other but not a value.
    """
    keys = list(dict.fromkeys(k for level in levels.values() for k in level))
    words = distinct_words(df, keys, column, heavy)
    sets = [[*level, "_word"] for level in levels.values()]
    combined = words.groupingSets(sets, *keys, "_word").agg(
        F.bit_or("_bits").alias("_bits"), F.grouping_id(*keys, "_word").alias("_gid")
    )
    # a key that a set lacks counts as a bit, the first key as the highest
    place = {k: 1 << (len(keys) - i) for i, k in enumerate(keys)}
    level = F.lit(None).cast("string")
    for name, own in levels.items():
        level = F.when(F.col("_gid") == sum(p for k, p in place.items() if k not in own), name).otherwise(level)
    counted = combined.groupBy("_gid", *keys).agg(F.sum(F.bit_count("_bits")).cast("long").alias(out))
    return counted.select(level.alias("level"), *keys, out)


# ---------------------------------------------------------------- sketches

# Standard error of a distinct count with 2^k registers; rank error of quantiles with this k.
REGISTERS = 12
HLL_ERROR = 1.04 / 2 ** (REGISTERS / 2)
KLL_K = 200
KLL_ERROR = 0.0133


def sketches(df: DataFrame, keys: list[str], distinct: list[str] = [], quantiles: list[str] = []) -> DataFrame:
    """Mergeable state per group: a distinct-count sketch and a quantile sketch per column.

    The state is plain binary columns (``<c>_hll``, ``<c>_kll``), to be stored and merged with that
    of other days or files by ``merged``.  ``HLL_ERROR`` is the standard error of a count relative
    to it, ``KLL_ERROR`` the rank error of a quantile at 99 % confidence, as the sketches' authors
    state them.
    """
    parts = [F.hll_sketch_agg(c, REGISTERS).alias(f"{c}_hll") for c in distinct]
    parts += [F.kll_sketch_agg_double(F.col(c).cast("double"), KLL_K).alias(f"{c}_kll") for c in quantiles]
    return df.groupBy(*keys).agg(*parts)


def merged(state: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups, from those of finer ones."""
    parts = [F.hll_union_agg(c).alias(c) for c in state.columns if c.endswith("_hll")]
    parts += [F.kll_merge_agg_double(c).alias(c) for c in state.columns if c.endswith("_kll")]
    return state.groupBy(*keys).agg(*parts)


def approx_distinct(column: str) -> Column:
    return F.hll_sketch_estimate(f"{column}_hll")


def approx_quantile(column: str, p: float) -> Column:
    return F.kll_sketch_get_quantile_double(f"{column}_kll", F.lit(p))
