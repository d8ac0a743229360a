"""Which items are handled, by how many subjects and how much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.domain import Domain
from framewise.functions.nulls import half_even, share
from framewise.functions.text import sentence_case, strip_first
from framewise.operators.counts import WHOLE, distinct_levels
from framewise.operators.joins import null_safe_join, outside
from framewise.operators.ordered import rank_rows
from framewise.operators.reshape import widen
from framewise.operators.tasks import dealt

ITEM = ["item", "category"]


def _by(value: str) -> list[Column]:
    return [F.col(value).desc_nulls_last(), F.col("item").asc_nulls_last()]


def _with_total(view: DataFrame, outer: list[str], inner: list[str], counted: str) -> DataFrame:
    """Distinct ``counted`` per (outer, inner) as ``n`` beside that of ``outer`` as ``total``.

    Both levels come from one scan: whole numbers as bit words that roll up, other values by
    grouping sets over the rows.  The window only sees aggregates.
    """
    if isinstance(view.schema[counted].dataType, WHOLE):
        levels = distinct_levels(view, {"inner": outer + inner, "outer": outer}, counted)
        total = F.max(F.when(F.col("level") == "outer", F.col("n"))).over(Window.partitionBy(*outer))
        return levels.withColumn("total", total).where(F.col("level") == "inner").drop("level")
    sets = view.groupingSets([outer + inner, outer], *outer, *inner).agg(
        F.count_distinct(counted).alias("n"), F.grouping(inner[0]).alias("_is_total")
    )
    total = F.max(F.when(F.col("_is_total") == 1, F.col("n"))).over(Window.partitionBy(*outer))
    return sets.withColumn("total", total).where(F.col("_is_total") == 0).drop("_is_total")


def item_reach(view: DataFrame) -> DataFrame:
    """Per site: the share of subjects that handled each item at least once, ranked."""
    counts = _with_total(view, ["site"], ITEM, "subject")
    reach = counts.withColumn("prop", share(F.col("n"), F.col("total")))
    return rank_rows(reach, ["site"], _by("prop")).select(
        "site", *ITEM, F.col("n").alias("n_subjects"), F.col("total").alias("n_all"), "prop", "rank"
    )


def _subject_shares(view: DataFrame, measure: str) -> DataFrame:
    """Per subject and item: the share of the subject's frames (or rows per frame).

    One extra row per subject with NULL item marks the subject itself (``_subjects`` = 1).
    """
    subject = ["site", "subject"]
    amount = F.count_distinct("frame") if measure == "frames" else F.count(F.lit(1))
    sets = view.groupingSets([subject + ITEM, subject], *subject, *ITEM).agg(
        F.count_distinct("frame").alias("_frames"),
        amount.alias("_amount"),
        F.grouping("item").alias("_subjects"),
    )
    marker = F.col("_subjects") == 1
    frames = F.max(F.when(marker, F.col("_frames"))).over(Window.partitionBy(*subject))
    return sets.withColumn("_share", F.when(~marker, share(F.col("_amount"), frames)))


def item_exposure(view: DataFrame, measure: str = "frames") -> DataFrame:
    """Per site: mean over all subjects of the share of frames with each item, ranked.

    Subjects without the item count as 0.  The sum of shares over the number of subjects
    equals the mean of the zero-filled table, which is never built.  Shares are added as
    decimals of 12 digits, so ranks do not depend on the order of addition.
    """
    shares = _subject_shares(view, measure)
    sums = shares.groupBy("site", *ITEM, "_subjects").agg(
        F.sum(F.col("_share").cast("decimal(20,12)")).cast("double").alias("_sum"), F.sum("_subjects").alias("_n")
    )
    n_all = F.max("_n").over(Window.partitionBy("site"))
    means = (
        sums.withColumn("n_all", n_all)
        .where(F.col("_subjects") == 0)
        .withColumn("prop", share(F.col("_sum"), F.col("n_all")))
    )
    return rank_rows(means, ["site"], _by("prop")).select("site", *ITEM, "n_all", "prop", "rank")


def item_distribution(
    view: DataFrame, excluded_items: tuple[str, ...] = (), log: bool = False, by: list[str] = ITEM,
    tasks: int | None = None,
) -> DataFrame:
    """Percent (or log percent) of each subject's records per item, ranked within subject.

    With ``tasks`` rows and counts are dealt over so many (default: as Spark shuffles).
    """
    subject = ["site", "subject", "age"]
    rows = dealt(view.where(outside(F.col("item"), excluded_items)).select(*subject, *by), [*subject, *by], tasks)
    counts = dealt(rows.groupBy(*subject, *by).agg(F.count(F.lit(1)).alias("n")), ["site", "subject"], tasks)
    total = F.sum("n").over(Window.partitionBy(*subject))
    percent = F.col("n") / F.col("total") * 100
    shares = counts.withColumn("total", total).withColumn("prop", F.ln(percent) if log else percent)
    return rank_rows(shares, subject, [F.col("n").desc(), F.col("item").asc_nulls_last()])


def distribution_panel(
    distribution: DataFrame,
    top: int,
    ages: tuple[int, int],
    category: str | None = None,
    min_points: int | None = None,
) -> DataFrame:
    """Top items of each subject in an age range, optionally of one category.

    ``min_points`` keeps only subjects with at least that many ranks (for a curve).
    """
    rows = distribution.where(F.col("age").between(min(ages), max(ages))).drop("rank")
    if category is not None:
        rows = rows.where(F.col("category") == category)
    panel = rank_rows(rows, ["site", "subject", "age"], _by("prop"), top)
    if min_points is None:
        return panel
    ranks = F.count(F.lit(1)).over(Window.partitionBy("site", "subject"))
    return panel.withColumn("_ranks", ranks).where(F.col("_ranks") >= min_points).drop("_ranks")


def _selection(
    ranked: DataFrame, domain: Domain, sites: tuple[str, ...] | None, category: str | None
) -> DataFrame:
    rows = ranked.where(outside(F.col("item"), domain.excluded_items))
    if sites is not None:
        rows = rows.where(F.col("site").isin(*sites))
    if category is not None:
        rows = rows.where(F.col("category") == category)
    return rows.drop("rank")


def in_every_site(ranked: DataFrame, top: int, sites: tuple[str, ...]) -> DataFrame:
    """Add ``in_both``: 1 if the item is within the top ranks of every site."""
    hits = F.count_if((F.col("rank") <= top) & F.col("site").isin(*sites))
    return ranked.withColumn(
        "in_both", (hits.over(Window.partitionBy("item")) == len(sites)).cast("long")
    )


def top_items(
    ranked: DataFrame,
    top: int,
    domain: Domain,
    sites: tuple[str, ...] | None = None,
    category: str | None = None,
    short: bool = False,
) -> DataFrame:
    """Leading items per site, re-ranked without study equipment, with display labels.

    ``in_both`` looks at the ranks of the unfiltered input, study equipment included.
    """
    rows = _selection(in_every_site(ranked, top, domain.sites), domain, sites, category)
    rows = rank_rows(rows, ["site"], _by("prop"), top)
    name = sentence_case(strip_first(F.col("item"), domain.strip))
    if category is None:
        tag = domain.label(F.col("category"), short=short)
        name = F.concat(name, F.lit(" ("), tag, F.lit(")"))
    return rows.select(
        "site", *ITEM, "rank", "in_both", "prop", (F.col("prop") * 100).alias("y"), name.alias("label")
    )


def top_items_table(
    ranked: DataFrame,
    top: int,
    domain: Domain,
    sites: tuple[str, ...] | None = None,
    category: str | None = None,
) -> DataFrame:
    """The same selection as one list, ranked across the chosen sites."""
    rows = _selection(ranked, domain, sites, category)
    rows = rank_rows(rows, [], [*_by("prop"), F.col("site")], top)
    return rows.select(
        strip_first(F.col("item"), domain.strip).alias("item"),
        "category",
        "rank",
        half_even(F.col("prop") * 100, 1).alias("pct"),
    )


def _top_lists(scored: DataFrame, domain: Domain, top: int) -> DataFrame:
    """Best items per (site, category) as one text cell per site."""
    best = rank_rows(scored, ["site", "category"], _by("score"), top)
    label = strip_first(F.col("item"), tuple(s for s in domain.strip if s.startswith("-")))
    entry = F.struct("rank", label.alias("label"))
    text = F.array_join(F.sort_array(F.collect_list(entry)).getField("label"), ", ")
    return widen(best, ["category"], "site", list(domain.sites), text)


def top3_by_reach(view: DataFrame, domain: Domain, top: int = 3, tasks: int | None = None) -> DataFrame:
    """Per category and site: the items handled by the most subjects."""
    kept = view.where(outside(F.col("item"), domain.excluded_items)).select("site", *ITEM, "subject")
    kept = dealt(kept, ["site", *ITEM, "subject"], tasks)
    scored = kept.groupBy("site", *ITEM).agg(F.count_distinct("subject").alias("score"))
    return _top_lists(scored, domain, top)


def top3_by_exposure(view: DataFrame, domain: Domain, top: int = 3) -> DataFrame:
    """Per category and site: the items with the highest mean share over all subjects."""
    kept = view.where(outside(F.col("item"), domain.excluded_items))
    scored = item_exposure(kept, measure="rows").withColumnRenamed("prop", "score")
    return _top_lists(scored.drop("rank"), domain, top)


def category_table(view: DataFrame, domain: Domain, top: int = 3, tasks: int | None = None) -> DataFrame:
    """Distinct items per category and site beside the leading items."""
    counts = view.groupBy("category", "site").agg(F.count_distinct("item").alias("n_items"))
    wide = widen(counts, ["category"], "site", list(domain.sites), F.first("n_items"))
    wide = wide.withColumnsRenamed({s: f"n_{s}" for s in domain.sites})
    tops = top3_by_reach(view, domain, top, tasks)
    tops = tops.withColumnsRenamed({s: f"top_{s}" for s in domain.sites})
    return null_safe_join(wide, tops, ["category"], "left").withColumn("label", domain.label(F.col("category")))


def uncommon_items(reach: DataFrame, few: tuple[int, int] = (1, 2)) -> DataFrame:
    """Per site: number and percent of items handled by only a few subjects."""
    rare = F.col("n_subjects").between(*few)
    return (
        reach.groupBy("site")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(rare).alias("n"))
        .where(F.col("n") > 0)
        .withColumn("pct", half_even(F.col("n") / F.col("total") * 100, 2))
    )


def shared_items(fact: DataFrame, sites: tuple[str, ...]) -> DataFrame:
    """Share of all recorded items (missing counts as one) that every site uses."""
    usable = F.col("reason").isNull() & F.col("category").isNotNull()
    used = [F.max(F.coalesce(usable & (F.col("site") == s), F.lit(False))) for s in sites]
    per_item = fact.groupBy("item").agg(*[u.alias(f"_s{i}") for i, u in enumerate(used)])
    everywhere = F.lit(True)
    for i in range(len(sites)):
        everywhere = everywhere & F.col(f"_s{i}")
    return per_item.agg(
        F.count_if(everywhere).alias("n_shared"), F.count(F.lit(1)).alias("n_items")
    ).withColumn("prop", share(F.col("n_shared"), F.col("n_items")))


def shared_top_items(ranked: DataFrame, top: int, sites: tuple[str, ...]) -> DataFrame:
    """Items within the top ranks of every site."""
    best = ranked.where((F.col("rank") <= top) & F.col("site").isin(*sites))
    in_all = best.groupBy("item").agg(F.count_distinct("site").alias("n_sites"))
    return in_all.where(F.col("n_sites") == len(sites)).select("item")
