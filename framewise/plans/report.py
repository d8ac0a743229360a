"""Corpus accounting and descriptive tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewise.domain import Domain
from framewise.functions.nulls import share
from framewise.operators.joins import heavy_groups, null_safe_join, spread_join
from framewise.operators.ordered import quantiles
from framewise.operators.reshape import widen
from framewise.operators.tasks import dealt
from framewise.plans.rates import category_share

SUBJECT = ["site", "subject"]


def _frames(fact: DataFrame) -> DataFrame:
    """One row per frame: rows, whether any row is excluded, whether any is usable."""
    excluded = F.col("reason").isNotNull()
    usable = ~excluded & F.col("category").isNotNull()
    return fact.groupBy(*SUBJECT, "frame").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(excluded).alias("excluded"),
        F.max(usable).alias("usable"),
    )


def inclusion_report(fact: DataFrame) -> DataFrame:
    """Frames coded, included and excluded with percent, per site and overall."""
    return (
        _frames(fact)
        .rollup("site")
        .agg(
            F.count(F.lit(1)).alias("n_coded"),
            F.count_if(F.col("usable") & ~F.col("excluded")).alias("n_included"),
            F.count_if("excluded").alias("n_excluded"),
            F.grouping("site").alias("_all"),
        )
        .withColumn("pct_excluded", share(F.col("n_excluded"), F.col("n_coded")) * 100)
        .withColumn("site", F.when(F.col("_all") == 1, F.lit("All")).otherwise(F.col("site")))
        .drop("_all")
    )


def unusable_subjects(fact: DataFrame) -> DataFrame:
    """Subjects whose excluded rows are as many as their frames."""
    lost = F.coalesce(F.sum(F.when(F.col("excluded"), F.col("n_rows"))), F.lit(0))
    return (
        _frames(fact)
        .groupBy("subject")
        .agg(lost.alias("n_excluded"), F.count(F.lit(1)).alias("n_frames"))
        .where(F.col("n_excluded") == F.col("n_frames"))
    )


def wearer_share(fact: DataFrame) -> DataFrame:
    """Per site: subjects by who wore the camera and the caregivers' share."""
    wearer = F.when(F.col("wearer") == 1, "child").when(F.col("wearer") != 1, "caregiver")
    counts = (
        fact.select("site", "subject", wearer.alias("who"))
        .groupBy("site", "who")
        .agg(F.count_distinct("subject").alias("n"))
    )
    wide = widen(counts, ["site"], "who", ["caregiver", "child"], F.first("n"))
    everyone = F.col("caregiver") + F.col("child")
    return wide.withColumn("prop", share(F.col("caregiver"), everyone))


def demographics_by_site(fact: DataFrame) -> DataFrame:
    """Per site: subjects, mean distinct frames and mean age."""
    people = fact.groupBy(*SUBJECT, "age").agg(F.count_distinct("frame").alias("n_frames"))
    return people.groupBy("site").agg(
        F.count_distinct("subject").alias("n_subjects"),
        F.avg("n_frames").alias("mean_frames"),
        F.avg("age").alias("mean_age"),
    )


def demographics(fact: DataFrame) -> DataFrame:
    """Overall: records per subject, age range and number of subjects."""
    people = fact.groupBy("subject", "age").agg(F.count(F.lit(1)).alias("n"))
    # A subject has one age, so rows of `people` are subjects; the median's state holds
    # the distinct record counts only.
    return people.agg(
        F.min("n").alias("min_records"),
        F.max("n").alias("max_records"),
        F.avg("n").alias("mean_records"),
        F.median("n").alias("median_records"),
        F.min("age").cast("long").alias("min_age"),
        F.max("age").cast("long").alias("max_age"),
        F.count_distinct("subject").alias("n_subjects"),
    )


def items_per_subject(view: DataFrame, tasks: int | None = None) -> DataFrame:
    """Distinct items per subject; with ``tasks`` rows are dealt over so many by subject and item."""
    rows = dealt(view.select(*SUBJECT, "item"), [*SUBJECT, "item"], tasks)
    return rows.groupBy(*SUBJECT).agg(F.count_distinct("item").alias("n_items"))


def daily_items(view: DataFrame, tasks: int | None = None) -> DataFrame:
    """Mean, median, sd and range of distinct items per subject, per site and overall."""
    per_subject = items_per_subject(view, tasks)
    stats = per_subject.rollup("site").agg(
        F.avg("n_items").alias("mean"),
        F.median("n_items").alias("median"),
        F.stddev_samp("n_items").alias("sd"),
        F.min("n_items").alias("min"),
        F.max("n_items").alias("max"),
        F.grouping("site").alias("_all"),
    )
    return stats.withColumn("site", F.when(F.col("_all") == 1, F.lit("All")).otherwise(F.col("site"))).drop("_all")


def category_means(view: DataFrame, domain: Domain) -> DataFrame:
    """Mean, sd, number and standard error of the category shares over subjects."""
    return (
        category_share(view, domain, scale=1.0)
        .groupBy("category", "site")
        .agg(
            F.avg("y").alias("mean"), F.stddev_samp("y").alias("sd"), F.count(F.lit(1)).alias("n")
        )
        .withColumn("se", F.col("sd") / F.sqrt("n"))
    )


def top_category(
    view: DataFrame, domain: Domain, categories: tuple[str, ...] | None = None
) -> DataFrame:
    """The category with the largest share of each subject (ties all kept), optionally
    only where it is one of ``categories``."""
    shares = category_share(view, domain, scale=1.0)
    best = F.max("y").over(Window.partitionBy(*SUBJECT))
    rows = shares.withColumn("_best", best).where(F.col("y") == F.col("_best"))
    if categories is not None:
        rows = rows.where(F.col("category").isin(*categories))
    return rows.select(*SUBJECT, "category", F.col("y").alias("prop"))


def subject_totals(view: DataFrame) -> DataFrame:
    """Distinct items and distinct frames per subject and age."""
    return view.groupBy(*SUBJECT, "age").agg(
        F.count_distinct("item").alias("n_items"), F.count_distinct("frame").alias("n_frames")
    )


def item_prevalence(view: DataFrame, item: str, width: float | None = None) -> DataFrame:
    """Per site: share of subjects with the item, and its share of frames over subjects."""
    rows = F.count_if(F.col("item") == item)
    shares = (
        view.groupBy(*SUBJECT)
        .agg(F.count_distinct("frame").alias("n_frames"), rows.alias("n"))
        .withColumn("prop", share(F.col("n"), F.col("n_frames")))
    )
    spread = shares.groupBy("site").agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(F.col("n") > 0).alias("n_subjects"),
        F.min("prop").alias("min"),
        F.max("prop").alias("max"),
        F.avg("prop").alias("mean"),
    )
    middle = quantiles(shares, ["site"], "prop", {"median": 0.5}, width).drop("n")
    return null_safe_join(spread, middle, ["site"], "inner").withColumn(
        "prop_subjects", share(F.col("n_subjects"), F.col("n_all"))
    )


def box_summary(
    values: DataFrame, group: list[str], column: str, width: float | None = None, reach: float = 1.5
) -> DataFrame:
    """Quartiles and whisker ends (the extreme values within 1.5 quartile ranges)."""
    boxes = quantiles(
        values, group, column, {"lower": 0.25, "middle": 0.5, "upper": 0.75}, width
    )
    y, margin = F.col(column), reach * (F.col("upper") - F.col("lower"))
    rows = spread_join(values, boxes, group, "inner", [column], heavy_groups(values, group))
    return rows.groupBy(*group, "n", "lower", "middle", "upper").agg(
        F.min(F.when(y >= F.col("lower") - margin, y)).cast("double").alias("ymin"),
        F.max(F.when(y <= F.col("upper") + margin, y)).cast("double").alias("ymax"),
    )
