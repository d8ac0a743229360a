"""Joins whose keys may be NULL.

Dictionary joins spread the keys that many rows share, and NULL, over several partitions.
No join carries a broadcast hint: Spark broadcasts a side when its known size is below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise sorts and merges, with adaptive
execution splitting skewed partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(
        lambda a, b: a & b, [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys]
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join in which NULL keys match; keys come out once, as with ``on=[...]``."""
    joined = left.alias("l").join(right.alias("r"), _same(left, right, keys), how)
    if how in ("left_semi", "left_anti"):
        return joined
    side = {"left": "l", "inner": "l", "right": "r"}
    if how in side:
        key_columns = [F.col(f"{side[how]}.`{k}`") for k in keys]
    else:
        key_columns = [F.coalesce(F.col(f"l.`{k}`"), F.col(f"r.`{k}`")).alias(k) for k in keys]
    rest = [F.col(f"l.`{c}`") for c in left.columns if c not in keys]
    rest += [F.col(f"r.`{c}`") for c in right.columns if c not in keys]
    return joined.select(*key_columns, *rest)


def heavy_groups(df: DataFrame, keys: list[str], slices: int | None = None, sample: int = 64) -> list[tuple]:
    """Values of ``keys`` that hold more than one in ``slices`` (default: the shuffle partitions) of the rows.

    All rows are counted, added up in their tasks before they meet by key, so the driver gets the values
    themselves, of which there are fewer than ``slices``.  A table under ``slices`` times ``sample`` rows has none.
    """
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_k{i}" for i in range(len(keys))]
    counts = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)]).groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))  # one row; its shuffle by key is that of the counts
    large = (F.col("_n") * slices > F.col("_all")) & (F.col("_all") >= slices * sample)
    return [tuple(r) for r in counts.crossJoin(total).where(large).select(*names).collect()]


def heavy_values(df: DataFrame, key: str, slices: int | None = None, sample: int = 64) -> list:
    """``heavy_groups`` of one column, without NULL."""
    return sorted(k for (k,) in heavy_groups(df, [key], slices, sample) if k is not None)


def spread_join(
    df: DataFrame, small: DataFrame, keys: list[str], how: str, spread: list[str], heavy: list[tuple],
    copies: int | None = None,
) -> DataFrame:
    """Join with a table of few rows per key, in which NULL keys match.

    Rows with a ``heavy`` key are dealt over ``copies`` (default: the shuffle partitions) parts by a
    hash of their ``spread`` columns, and the other side's rows of that key go to all parts, so no
    key is one partition; all else goes to one part.  The parts only matter where Spark shuffles: a
    small side is broadcast as before.
    """
    copies = copies or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = F.lit(False)
    for values in heavy:
        same = [F.col(f"`{k}`").isNull() if v is None else F.col(f"`{k}`").eqNullSafe(F.lit(v)) for k, v in zip(keys, values)]
        dealt = dealt | reduce(lambda a, b: a & b, same, F.lit(True))
    part = F.when(dealt, F.pmod(F.xxhash64(*spread), F.lit(copies)).cast("int")).otherwise(0)
    parts = F.when(dealt, F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))
    joined = null_safe_join(df.withColumn("_part", part), small.withColumn("_part", F.explode(parts)), [*keys, "_part"], how)
    return joined.drop("_part")


def look_up(
    df: DataFrame, dictionary: DataFrame, key: str, spread: list[str], heavy: list, copies: int | None = None
) -> DataFrame:
    """Left join with a dictionary on ``key``; NULL, which matches NULL, and ``heavy`` values are spread."""
    return spread_join(df, dictionary, [key], "left", spread, [(None,), *[(v,) for v in heavy]], copies)


def members(df: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs in ``allowed`` (NULL is a value like any other)."""
    return null_safe_join(df, allowed.select(*keys), keys, "left_semi")


def non_members(df: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key does not occur in ``listed``; a NULL key is kept unless listed."""
    return null_safe_join(df, listed.select(*keys), keys, "left_anti")


def outside(value: Column, listed: tuple) -> Column:
    """Negated membership in a short literal list; NULL counts as outside."""
    if not listed:
        return F.lit(True)
    return F.coalesce(~value.isin(*listed), F.lit(True))


def natural_full_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full join on every column name the two sides share."""
    return null_safe_join(left, right, [c for c in left.columns if c in right.columns], "full")
