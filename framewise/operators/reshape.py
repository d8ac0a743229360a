"""Wide/long reshaping, delimited lists and zero filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions.text import split_capped
from framewise.operators.joins import heavy_groups, spread_join


CHUNKS = 8  # of a domain


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` in table order."""
    names = df.columns
    return names[names.index(first) : names.index(last) + 1]


def map_columns(df: DataFrame, names: list[str], function) -> DataFrame:
    """Apply one Column function to several columns."""
    return df.withColumns({n: function(F.col(n)) for n in names})


def melt(df: DataFrame, keep: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """Columns to rows."""
    return df.select(*keep, *columns).unpivot(keep, columns, name, value)


def widen(df: DataFrame, keys: list[str], name: str, levels: list, value: Column) -> DataFrame:
    """Rows to columns for a known list of levels; absent cells are NULL."""
    return df.groupBy(*keys).pivot(name, list(levels)).agg(value)


def explode_list(
    df: DataFrame, column: str, max_items: int | None = None, sep: str = ",", keep_if: Column | None = None
) -> DataFrame:
    """One row per list entry, all or the first ``max_items``.

    Entries are trimmed and empty ones dropped.  A row left without entries survives
    once, with NULL, where ``keep_if`` holds.
    """
    entries = F.filter(
        split_capped(F.col(column), max_items, sep), lambda x: x.isNotNull() & (x != "")
    )
    rows = df.withColumn(column, F.explode_outer(entries))
    if keep_if is None:
        return rows.where(F.col(column).isNotNull())
    return rows.where(F.col(column).isNotNull() | keep_if)


def one_hot(df: DataFrame, column: str, levels: dict[str, str]) -> DataFrame:
    """0/1 columns ``{level: name}``; an unknown value gives NULL."""
    return df.withColumns(
        {name: (F.col(column) == level).cast("int") for level, name in levels.items()}
    )


def complete(
    df: DataFrame, group: list[str], rows: str, columns: str, fill: dict[str, object]
) -> DataFrame:
    """Add the missing ``rows`` x ``columns`` pairs inside each group, with filled values.

    ``df`` has one row per (group, rows, columns).  The cells of a ``rows`` key are packed
    into a map and the group's ``columns`` domain into chunks of an array (all at most the
    vocabulary); each chunk unfolds beside the map, so the completed pairs are produced in
    place and never shuffled.  A group that holds many rows is dealt over parts by its ``rows``
    keys, and its chunks go to all parts.
    """
    values = [c for c in df.columns if c not in (*group, rows, columns)]
    cell = F.struct(F.struct(columns), F.struct(*values))  # a struct may hold NULL as a key
    packed = df.groupBy(*group, rows).agg(F.map_from_entries(F.collect_list(cell)).alias("_cells"))
    chunk = F.pmod(F.xxhash64(columns), F.lit(CHUNKS)).alias("_chunk")
    domain = df.select(*group, columns).distinct().groupBy(*group, chunk)
    domain = domain.agg(F.collect_list(F.struct(columns)).alias("_domain")).drop("_chunk")
    pairs = spread_join(packed, domain, group, "inner", [rows], heavy_groups(df, group)).select(
        *group, rows, "_cells", F.explode("_domain").alias("_column")
    )
    found = F.try_element_at("_cells", F.col("_column"))
    filled = [
        F.coalesce(found.getField(v), F.lit(fill[v])).alias(v) if v in fill else found.getField(v).alias(v)
        for v in values
    ]
    return pairs.select(*group, rows, F.col("_column").getField(columns).alias(columns), *filled)


def counts_over_levels(
    df: DataFrame, keys: list[str], frame: str, column: str, levels: tuple[str, ...]
) -> DataFrame:
    """Rows per key and level, zero-filled, with the key's number of distinct frames.

    The levels become conditional counts, so nothing is joined: rows collapse to frames
    first (which spreads a busy key over many tasks), then to keys, then unfold.
    """
    parts = [f"_n{i}" for i in range(len(levels))]
    per_frame = df.groupBy(*keys, frame).agg(
        *[F.count_if(F.col(column) == lv).alias(p) for p, lv in zip(parts, levels)]
    )
    per_key = per_frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_frames"), *[F.sum(p).alias(p) for p in parts]
    )
    cells = [F.struct(F.lit(lv).alias(column), F.col(p).alias("n")) for p, lv in zip(parts, levels)]
    return per_key.select(*keys, "n_frames", F.inline(F.array(*cells)))


def histogram(df: DataFrame, column: str, width: float, group: list[str] = []) -> DataFrame:
    """Counts in bins of ``width`` centred on multiples of ``width``."""
    center = (F.floor(F.col(column) / width + 0.5) * width).cast("double")
    return df.groupBy(*group, center.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
