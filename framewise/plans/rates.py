"""Hourly diversity, category shares and transition rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.domain import Domain
from framewise.functions.nulls import share
from framewise.operators.joins import members, natural_full_join, null_safe_join
from framewise.operators.ordered import neighbours
from framewise.operators.reshape import counts_over_levels, one_hot
from framewise.operators.tasks import dealt

SUBJECT = ["site", "subject"]
SUBJECT_HOUR = ["site", "subject", "age", "hour"]


def per_hour(view: DataFrame, column: str, keys: list[str] = SUBJECT_HOUR) -> DataFrame:
    """Distinct items (or categories) per subject and hour of day."""
    return view.groupBy(*keys).agg(F.count_distinct(column).alias("y"))


def items_per_hour_by_category(view: DataFrame) -> DataFrame:
    """Distinct items per hour within a category, averaged over the subject's hours."""
    hourly = per_hour(view, "item", [*SUBJECT, "hour", "category"])
    return hourly.groupBy(*SUBJECT, "category").agg(F.avg("y").alias("y"))


def category_share(
    view: DataFrame, domain: Domain, keys: list[str] = SUBJECT, scale: float = 100.0
) -> DataFrame:
    """Rows of each category over the subject's distinct frames, zero-filled."""
    counts = counts_over_levels(view, keys, "frame", "category", domain.categories)
    return counts.withColumn("y", share(F.col("n"), F.col("n_frames")) * scale)


def category_share_by_age(view: DataFrame, domain: Domain) -> DataFrame:
    """The same share as a proportion with age, observed categories only."""
    return category_share(view, domain, [*SUBJECT, "age"], 1.0).where(F.col("n") > 0)


def category_panel(values: DataFrame, site: str | None = None) -> DataFrame:
    """Per-subject category values of one site or of all."""
    return values if site is None else values.where(F.col("site") == site)


def transition_rate(
    view: DataFrame, column: str = "item", keep_zero: bool = False, slice_by: str | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Changes of the handled ``column`` values between successive frames, per hour.

    A frame is described by its values in sorted order, so their order of entry does not
    matter.  The count of changes is divided by the distinct values of that hour.  Frames
    are ordered by time within the subject; the order of a subject with very many frames is cut
    into slices of about equal row counts, or into calendar units by ``slice_by``.  With ``tasks`` frames
    and values are dealt over so many.
    """
    # A set of (value, item) pairs: repeated records count once, the list is no longer than
    # the vocabulary, and two items of one category still show as two entries.
    pairs = F.sort_array(F.collect_set(F.struct(F.col(column).alias("v"), F.col("item").alias("i"))))
    frames = view.groupBy("site", "subject", "age", "frame").agg(
        F.min("ts").alias("ts"), F.array_join(pairs.getField("v"), ", ").alias("held")
    )
    unit = None if slice_by is None else F.date_trunc(slice_by, "ts")
    steps = neighbours(frames, ["subject"], ["ts", "frame"], ["held"], unit, view, tasks)
    changed = (F.col("held") != F.col("prev_held")).cast("long")
    moves = (
        steps.withColumn("hour", F.hour("ts").cast("long"))
        .groupBy(*SUBJECT_HOUR)
        .agg(F.coalesce(F.sum(changed), F.lit(0)).alias("n_transitions"))
    )
    wide = ["site", "subject", "age", "hour"] if column == "item" else ["subject", "hour"]
    values = dealt(view.select(*dict.fromkeys([*wide, column])), list(dict.fromkeys([*wide, column])), tasks)
    variety = per_hour(values, column, wide).withColumnRenamed("y", "n_values")
    rates = null_safe_join(moves, variety, wide, "left").withColumn(
        "y", share(F.col("n_transitions"), F.col("n_values"))
    )
    rates = rates.select(*SUBJECT_HOUR, "n_transitions", "n_values", "y")
    return rates if keep_zero else rates.where(F.col("y") > 0)


def hour_scaffold(
    hours: DataFrame,
    participants: DataFrame,
    included: DataFrame,
    domain: Domain | None = None,
) -> DataFrame:
    """Every codeable hour of the included subjects with their metadata.

    Participants without such hours stay with a NULL hour.  With a domain each row is
    repeated per category.
    """
    people = participants.select(*SUBJECT, "age")
    rows = natural_full_join(members(hours, included, ["subject"]), people)
    rows = rows.select(*SUBJECT, "age", "hour")
    if domain is None:
        return rows
    return rows.select(*rows.columns, domain.explode_categories().alias("category"))


def hourly_counts(
    view: DataFrame, column: str, scaffold: DataFrame | None = None
) -> DataFrame:
    """Distinct values per subject and hour; with a scaffold, hours without any give 0.

    Scaffold hours are stacked below the data with a NULL value, which a distinct count
    ignores, so zero hours need no outer join.
    """
    rows = view.select("subject", "hour", column)
    if scaffold is not None:
        known = members(scaffold, view.select("subject").distinct(), ["subject"])
        empty = known.select("subject", "hour", F.lit(None).cast("string").alias(column))
        rows = rows.unionByName(empty)
    return per_hour(rows, column, ["subject", "hour"])


def hourly_stats(
    view: DataFrame, column: str, scaffold: DataFrame | None = None
) -> DataFrame:
    """Mean, median, sd and range of the hourly counts over all subject-hours.

    The exact median keeps one entry per distinct count, at most the vocabulary size.
    """
    return describe(hourly_counts(view, column, scaffold), "y")


def describe(df: DataFrame, column: str, group: list[str] = []) -> DataFrame:
    """Mean, median, sample sd, minimum and maximum of an integer count."""
    return df.groupBy(*group).agg(
        F.avg(column).alias("mean"),
        F.median(column).alias("median"),
        F.stddev_samp(column).alias("sd"),
        F.min(column).cast("long").alias("min"),
        F.max(column).cast("long").alias("max"),
    )


def _indicators(domain: Domain) -> dict[str, str]:
    return {c: "is_" + c.lower().replace(" ", "_") for c in domain.categories}


def model_frame(view: DataFrame, domain: Domain) -> DataFrame:
    """Distinct items per subject, hour and category with 0/1 category columns."""
    cells = view.groupBy(*SUBJECT, "hour", "category").agg(
        F.count_distinct("item").alias("n_items")
    )
    frames = view.groupBy(*SUBJECT).agg(F.count_distinct("frame").alias("n_frames"))
    joined = null_safe_join(cells, frames, SUBJECT, "inner")
    joined = joined.select(*SUBJECT, "n_frames", "hour", "category", "n_items")
    return one_hot(joined, "category", _indicators(domain))


def model_frame_zero(view: DataFrame, scaffold: DataFrame, domain: Domain) -> DataFrame:
    """The model frame with a zero row for every codeable hour and category.

    ``n_frames`` is the subject's frames in that hour, 0 in the added rows.  ``scaffold``
    is ``hour_scaffold(..., domain)``; only subjects of the view are kept.
    """
    cell = [*SUBJECT, "hour", "category"]
    cells = view.groupBy(*cell).agg(F.count_distinct("item").alias("n_items"))
    frames = view.groupBy(*SUBJECT, "hour").agg(F.count_distinct("frame").alias("n_frames"))
    seen = null_safe_join(cells, frames, [*SUBJECT, "hour"], "inner").select(*cell, "n_frames", "n_items")
    known = members(scaffold, view.select("subject").distinct(), ["subject"])
    empty = known.select(*cell, F.lit(0).cast("long").alias("n_frames"), F.lit(0).cast("long").alias("n_items"))
    filled = seen.unionByName(empty).groupBy(*cell).agg(
        F.max("n_frames").alias("n_frames"), F.max("n_items").alias("n_items")
    )
    return one_hot(filled, "category", _indicators(domain))
