"""Order-dependent operators that never need one task per hot key.

A plain window keeps all rows of its key in one task.  Where a key holds many rows, its order is
cut into slices of about equal row counts here; each slice is one window partition and only slice
edges or slice totals meet per key.  Cuts come from a sample of the rows and are literals of the
plan, so every branch and every retried task cuts alike; results do not depend on them.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.operators.joins import null_safe_join
from framewise.operators.tasks import dealt

SAMPLE = 64  # sampled rows a slice


def _plain(df: DataFrame, name: str) -> Column:
    """A column in a form that keeps its order and survives the way to the driver and back."""
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return F.unix_micros(name)
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.col(name).cast("string")  # a time zone's clock changes would break the order
    return F.col(f"`{name}`")


def _cuts_below(cuts: list[tuple], place: Column, types: list[str]) -> Column:
    """How many of the cuts are not above ``place``, by bisection."""
    as_struct = [F.struct(*[F.lit(v).cast(t).alias(f"c{i}") for i, (v, t) in enumerate(zip(c, types))]) for c in cuts]
    ordered = F.sort_array(F.array(*as_struct))

    def halve(state: Column, _: Column) -> Column:
        low, high = state["low"], state["high"]
        middle = F.shiftright(low + high, 1)
        open_, under = low < high, F.get(ordered, middle) <= place
        return F.struct(
            F.when(open_ & under, middle + 1).otherwise(low).alias("low"),
            F.when(open_ & ~under, middle).otherwise(high).alias("high"),
        )

    begin = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))
    return F.aggregate(steps, begin, halve, lambda state: state["low"])


def slice_of(
    df: DataFrame, key: list[str], order: list[str], slices: int | None = None, sample: int = SAMPLE
) -> Column | None:
    """Number of a row's slice within its key, non-decreasing along ``order``; None if no key needs any.

    ``slices`` (default: the shuffle partitions) times ``sample`` rows are drawn at random, however
    large the table; a key with more than ``sample`` of them, so more than a slice's share of all
    rows, is cut at every ``sample``-th.  A table with fewer rows is not cut.  At most ``slices``
    cuts are made.  The draw keeps the least random numbers of every task, so tasks send no more
    than the sample.
    """
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys, places = [_plain(df, c) for c in key], [_plain(df, c) for c in order]
    rows = df.select(*[c.alias(f"k{i}") for i, c in enumerate(keys)], *[c.alias(f"c{i}") for i, c in enumerate(places)])
    types = [f.dataType.simpleString() for f in rows.schema.fields]
    drawn = rows.orderBy(F.rand(7)).limit(slices * sample).collect()
    if len(drawn) < slices * sample:
        return None
    by_key = defaultdict(list)
    for r in drawn:
        by_key[tuple(r[: len(key)])].append(tuple(r[len(key) :]))
    place = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(places)])
    out = None
    for values, found in by_key.items():
        if len(found) <= sample:
            continue
        found.sort(key=lambda p: [(v is not None, v) for v in p])
        cuts = list(dict.fromkeys(found[sample::sample]))
        here = reduce(
            lambda a, b: a & b,
            [k.eqNullSafe(F.lit(v).cast(t)) for k, v, t in zip(keys, values, types)],
            F.lit(True),
        )
        number = _cuts_below(cuts, place, types[len(key) :])
        out = F.when(here, number) if out is None else out.when(here, number)
    return None if out is None else out.otherwise(0)


def rank_rows(
    df: DataFrame, group: list[str], order: list[Column], top: int | None = None, out: str = "rank"
) -> DataFrame:
    """``row_number`` per group, optionally the first ``top`` rows only.

    Meant for aggregated input (one row per item, so a group is at most the vocabulary).
    With ``top`` Spark cuts each map task to ``top`` rows per group before the shuffle.
    """
    ranked = df.withColumn(
        out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")
    )
    return ranked if top is None else ranked.where(F.col(out) <= top)


def neighbours(
    df: DataFrame,
    key: list[str],
    order: list[str],
    columns: list[str],
    slice_: Column | None = None,
    drawn_from: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Add ``prev_<c>`` and ``next_<c>`` of the row before and after within ``key``.

    The first column of ``order`` is never NULL.  Without a key that holds many rows this is one
    window.  Otherwise neighbours are looked up inside slices of the key's order; only the first
    and last row of each slice meet in a second window per key, which carries them across.  Slices
    come from ``drawn_from`` (rows with the columns of ``key`` and ``order``; default ``df``), or are
    those of ``slice_``, which must be non-decreasing along ``order``.  With ``tasks`` the rows are
    dealt over so many, by key and slice.
    """
    if slice_ is None:
        slice_ = slice_of(df if drawn_from is None else drawn_from, key, order)
    if slice_ is None:
        whole = Window.partitionBy(*key).orderBy(*order)
        looked = {f"prev_{c}": F.lag(c).over(whole) for c in columns} | {f"next_{c}": F.lead(c).over(whole) for c in columns}
        return dealt(df, key, tasks).select("*", *[looked[f"{side}_{c}"].alias(f"{side}_{c}") for c in columns for side in ("prev", "next")])
    inner = Window.partitionBy(*key, "_slice").orderBy(*order)
    across = Window.partitionBy(*key).orderBy("_slice", *order)
    # The leading order column is never NULL, so its neighbour is NULL at a slice edge only.
    looked = [*columns, *([order[0]] if order[0] not in columns else [])]
    rows = dealt(df.withColumn("_slice", slice_), [*key, "_slice"], tasks)
    rows = rows.withColumns(
        {
            **{f"prev_{c}": F.lag(c).over(inner) for c in looked},
            **{f"next_{c}": F.lead(c).over(inner) for c in looked},
        }
    )
    first, last = F.col(f"prev_{order[0]}").isNull(), F.col(f"next_{order[0]}").isNull()
    steps = {}
    for c in columns:
        steps[f"prev_{c}"] = F.when(first, F.lag(c).over(across)).otherwise(F.col(f"prev_{c}"))
        steps[f"next_{c}"] = F.when(last, F.lead(c).over(across)).otherwise(F.col(f"next_{c}"))
    edges = rows.where(first | last).withColumns(steps)
    out = [*df.columns, *[f"{side}_{c}" for c in columns for side in ("prev", "next")]]
    return rows.where(~(first | last)).unionByName(edges).select(*out)


def running_total(
    df: DataFrame,
    family: list[str],
    value: str,
    amount: str,
    width: float | None = None,
    drawn_from: DataFrame | None = None,
) -> DataFrame:
    """Add ``before``, the sum of ``amount`` over smaller values of the family, and
    ``total``, the sum over the whole family.

    Input has one row per (family, value).  Values are cut into slices with about as many rows of
    ``drawn_from`` (default ``df``) each, or of ``width``; slice totals are summed per family, and
    each slice adds its own running sum.  The null-safe join keeps both branches equal below the
    shuffle, so it is done once.  Without a family that needs slices this is one window.
    """
    whole = Window.partitionBy(*family)
    if width is None:
        slice_ = slice_of(df if drawn_from is None else drawn_from, family, [value])
    else:
        slice_ = F.floor(F.col(value) / width)
    if slice_ is None:
        smaller = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns(
            {"before": F.coalesce(F.sum(amount).over(smaller), F.lit(0)), "total": F.sum(amount).over(whole)}
        )
    rows = df.withColumn("_slice", slice_)
    sums = rows.groupBy(*family, "_slice").agg(F.sum(amount).alias("_sum"))
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns(
        {
            "_base": F.coalesce(F.sum("_sum").over(earlier), F.lit(0)),
            "total": F.sum("_sum").over(whole),
        }
    ).drop("_sum")
    inner = Window.partitionBy(*family, "_slice").orderBy(value)
    local = F.sum(amount).over(inner.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_local", F.coalesce(local, F.lit(0)))
    rows = null_safe_join(rows, sums, [*family, "_slice"], "inner")
    return rows.withColumn("before", F.col("_base") + F.col("_local")).drop(
        "_slice", "_base", "_local"
    )


def quantiles(
    df: DataFrame, family: list[str], value: str, probs: dict[str, float], width: float | None = None
) -> DataFrame:
    """Exact interpolated quantiles ``{name: p}`` per family, plus ``n``.

    Built on value counts and their running total, so no task holds a family's values; slices
    follow the rows (``width``: a fixed width).
    """
    known = df.where(F.col(value).isNotNull()).select(*family, value)
    counts = known.groupBy(*family, value).agg(F.count(F.lit(1)).alias("_m"))
    placed = running_total(counts, family, value, "_m", width, known).withColumnRenamed("total", "n")
    spots, picks = {}, []
    for name, p in probs.items():
        spots[name] = (F.col("n") - 1) * F.lit(float(p))
        for tag, spot in (("lo", F.floor(spots[name])), ("hi", F.ceil(spots[name]))):
            here = (F.col("before") <= spot) & (spot < F.col("before") + F.col("_m"))
            picks.append(F.max(F.when(here, F.col(value))).alias(f"_{name}_{tag}"))
    found = placed.groupBy(*family, "n").agg(*picks)
    between = [
        (
            F.col(f"_{name}_lo")
            + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * (spot - F.floor(spot))
        )
        .cast("double")
        .alias(name)
        for name, spot in spots.items()
    ]
    return found.select(*family, "n", *between)


def holm(df: DataFrame, p: str, family: list[str], tests: str, out: str = "p_adjusted") -> DataFrame:
    """Step-down adjusted p-values per family (one row per test; ``tests`` breaks ties)."""
    w = Window.partitionBy(*family)
    ordered = w.orderBy(F.col(p).asc_nulls_last(), F.col(tests))
    scaled = (F.count(p).over(w) - F.row_number().over(ordered) + 1) * F.col(p)
    df = df.withColumn("_scaled", F.least(F.lit(1.0), scaled))
    running = F.max("_scaled").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(out, F.when(F.col(p).isNotNull(), running)).drop("_scaled")
