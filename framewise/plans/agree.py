"""Time between frames and agreement between two codings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions.nulls import if_known
from framewise.operators.joins import members
from framewise.operators.ordered import neighbours

FRAME = ["site", "subject", "frame"]


def frame_durations(timestamps: DataFrame) -> DataFrame:
    """Seconds to the subject's next frame; NULL for its first and last frame.

    A subject with very many frames is spread over slices of its order.
    """
    steps = neighbours(
        timestamps.select("subject", "frame", "ts"),
        ["subject"],
        ["ts", "frame"],
        ["ts"],
    )
    inside = F.col("prev_ts").isNotNull() & F.col("next_ts").isNotNull()
    seconds = F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("next_ts")) / F.lit(1e6)
    return steps.select("subject", "frame", "ts", F.when(inside, seconds).alias("duration"))


def _values(column: str, source: int) -> Column:
    return F.when(F.col("_coder") == source, F.col(column))


def frame_agreement(
    main: DataFrame,
    second: DataFrame,
    columns: tuple[str, ...] = ("item", "category", "reason"),
    missing: str = "agree",
    compare: str = "any_pair",
) -> DataFrame:
    """Per frame and column: 1 if the two codings agree, else 0.

    ``any_pair``: a frame disagrees when some known value of one coder differs from some
    known value of the other, which is the case exactly when both have values and more
    than one value occurs.  That needs counts, minimum and maximum only, so both codings
    are stacked and aggregated and no pairs are formed.  ``set`` compares value sets.
    With ``missing="disagree"`` a value known to one coder only is a disagreement.
    """
    main = members(main, second.select("subject").distinct(), ["subject"])
    stacked = (
        main.select(*FRAME, *columns)
        .withColumn("_coder", F.lit(1))
        .unionByName(second.select(*FRAME, *columns).withColumn("_coder", F.lit(2)))
    )
    parts = [F.count_if(F.col("_coder") == k).alias(f"_rows{k}") for k in (1, 2)]
    for c in columns:
        for k in (1, 2):
            parts.append(F.count(_values(c, k)).alias(f"_{c}{k}"))
            if compare == "set":
                parts.append(F.array_sort(F.collect_set(_values(c, k))).alias(f"_{c}_set{k}"))
        parts += [F.min(c).alias(f"_{c}_min"), F.max(c).alias(f"_{c}_max")]
    per_frame = stacked.groupBy(*FRAME).agg(*parts)

    out = []
    for c in columns:
        one, two = F.col(f"_{c}1") > 0, F.col(f"_{c}2") > 0
        if compare == "set":
            differ = one & two & (F.col(f"_{c}_set1") != F.col(f"_{c}_set2"))
        else:
            differ = one & two & (F.col(f"_{c}_min") != F.col(f"_{c}_max"))
        if missing == "disagree":
            differ = F.coalesce(differ, F.lit(False)) | (one != two)
        out.append(F.when(differ, 0).otherwise(1).alias(f"{c}_match"))
    rows1, rows2 = F.col("_rows1"), F.col("_rows2")
    same_size = if_known((rows1 > 0) & (rows2 > 0) & (rows1 != rows2), F.lit(0), F.lit(1))
    return per_frame.select(*FRAME, *out, same_size.alias("n_items_match"))


def agreement(main: DataFrame, second: DataFrame, **options) -> DataFrame:
    """Per subject: number of frames and the share that agrees by category and by item."""
    return (
        frame_agreement(main, second, **options)
        .groupBy("site", "subject")
        .agg(
            F.count(F.lit(1)).alias("n_frames"),
            F.avg("category_match").alias("category_agreement"),
            F.avg("item_match").alias("item_agreement"),
        )
    )


def agreement_summary(per_subject: DataFrame) -> DataFrame:
    """Frames coded twice and mean percent agreement over subjects, per site and overall."""
    return (
        per_subject.rollup("site")
        .agg(
            F.sum("n_frames").alias("n_frames"),
            (F.avg("category_agreement") * 100).alias("category_pct"),
            (F.avg("item_agreement") * 100).alias("item_pct"),
            F.grouping("site").alias("_all"),
        )
        .withColumn("site", F.when(F.col("_all") == 1, F.lit("All")).otherwise(F.col("site")))
        .drop("_all")
    )
