import pytest
from pyspark.sql import functions as F

from framewise.domain import Domain
from framewise.operators import reshape
from framewise.plans import rank

DOMAIN = Domain(
    sites=("T", "R"), categories=("Toy", "Mealtime Tool"), labels=("Toy", "Tool-M"), short_labels=("T", "M"),
    excluded_items=("camera",), strip=("-M", "-W", "empty drink "),
)
VIEW = "site string, subject long, age long, frame string, item string, category string"


@pytest.fixture
def view(make):
    t, m = "Toy", "Mealtime Tool"
    return make(
        VIEW,
        ("T", 1, 5, "a", "ball", t), ("T", 1, 5, "a", "camera", t), ("T", 1, 5, "b", "ball", t),
        ("T", 2, 9, "a", "ball", t), ("T", 2, 9, "c", "knife-M", m), ("T", 2, 9, "c", "camera", t),
        ("T", 3, 9, "a", "doll", t),
        ("R", 7, 5, "a", "ball", t), ("R", 7, 5, "b", "spoon", m), ("R", 7, 5, "c", "camera", t),
        ("R", 8, 6, "a", "knife-M", m), ("R", 8, 6, "b", "camera", t),
    )


def test_reach_ranks_and_breaks_ties_by_item(view, values):
    assert values(rank.item_reach(view), "site", "rank", "item", "n_subjects", "n_all") == [
        ("R", 1, "camera", 2, 2), ("R", 2, "ball", 1, 2), ("R", 3, "knife-M", 1, 2), ("R", 4, "spoon", 1, 2),
        ("T", 1, "ball", 2, 3), ("T", 2, "camera", 2, 3), ("T", 3, "doll", 1, 3), ("T", 4, "knife-M", 1, 3),
    ]


def test_exposure_equals_the_zero_filled_mean(view, values):
    frames = view.groupBy("site", "subject").agg(F.count_distinct("frame").alias("t"))
    seen = view.groupBy("site", "subject", "item").agg(F.count_distinct("frame").alias("n"))
    zero = reshape.complete(seen, ["site"], "subject", "item", {"n": 0}).join(frames, ["site", "subject"])
    want = zero.groupBy("site", "item").agg(F.round(F.avg(F.col("n") / F.col("t")), 12).alias("prop"))
    got = rank.item_exposure(view).withColumn("prop", F.round("prop", 12))
    assert values(got, "site", "item", "prop") == values(want)
    ranks = {(r["site"], r["item"]): r["rank"] for r in got.collect()}
    assert ranks[("T", "ball")] == 1 and ranks[("R", "camera")] == 1


def test_distribution_sums_to_hundred_without_study_items(view, values):
    out = rank.item_distribution(view, DOMAIN.excluded_items)
    total = out.groupBy("subject").agg(F.round(F.sum("prop"), 9).alias("p"))
    assert {r["p"] for r in total.collect()} == {100.0}
    assert values(out.where("subject = 2"), "item", "n", "total", "rank") == [("ball", 1, 2, 1), ("knife-M", 1, 2, 2)]
    log = rank.item_distribution(view, DOMAIN.excluded_items, log=True).where("subject = 1").first()
    assert log["prop"] == pytest.approx(4.605170185988092)


def test_panel_filters_and_reranks(view, values):
    base = rank.item_distribution(view)
    out = rank.distribution_panel(base, 1, (9, 6), "Toy")
    assert values(out, "subject", "item", "rank") == [(2, "ball", 1), (3, "doll", 1), (8, "camera", 1)]
    assert values(rank.distribution_panel(base, 5, (0, 48), min_points=3), "subject", "rank") == [
        (2, 1), (2, 2), (2, 3), (7, 1), (7, 2), (7, 3),
    ]


def test_top_items_flag_uses_unfiltered_ranks(view, values):
    reach = rank.item_reach(view)
    out = rank.top_items(reach, 2, DOMAIN)
    # With study equipment, the two leaders are camera, ball at R and ball, camera at T.
    assert values(out, "site", "rank", "item", "in_both", "label") == [
        ("R", 1, "ball", 1, "Ball (Toy)"), ("R", 2, "knife-M", 0, "Knife (Tool-M)"),
        ("T", 1, "ball", 1, "Ball (Toy)"), ("T", 2, "doll", 0, "Doll (Toy)"),
    ]
    one = rank.top_items(reach, 31, DOMAIN, ("R",), "Mealtime Tool")
    assert values(one, "rank", "label", "y") == [(1, "Knife", 50.0), (2, "Spoon", 50.0)]
    short = rank.top_items(reach, 31, DOMAIN, ("R",), short=True)
    assert values(short, "label") == [("Ball (T)",), ("Knife (M)",), ("Spoon (M)",)]


def test_table_ranks_across_sites(view, values):
    out = rank.top_items_table(rank.item_reach(view), 3, DOMAIN)
    assert values(out, "rank", "item", "pct") == [(1, "ball", 66.7), (2, "ball", 50.0), (3, "knife", 50.0)]


def test_top_lists(view, values):
    assert values(rank.top3_by_reach(view, DOMAIN)) == [("Mealtime Tool", "knife", "knife, spoon"), ("Toy", "ball, doll", "ball")]
    assert values(rank.top3_by_exposure(view, DOMAIN)) == [("Mealtime Tool", "knife", "knife, spoon"), ("Toy", "ball, doll", "ball")]
    table = rank.category_table(view, DOMAIN)
    assert values(table, "label", "n_T", "top_T", "n_R", "top_R") == [
        ("Tool-M", 1, "knife", 2, "knife, spoon"), ("Toy", 3, "ball, doll", 2, "ball"),
    ]


def test_uncommon_and_shared(view, values):
    reach = rank.item_reach(view)
    assert values(rank.uncommon_items(reach, (1, 1))) == [("R", 4, 3, 75.0), ("T", 4, 2, 50.0)]
    fact = view.withColumn("reason", F.lit(None).cast("string")).select("site", "item", "category", "reason")
    extra = fact.limit(1).select("site", F.lit(None).cast("string").alias("item"), F.lit(None).cast("string").alias("category"), F.lit("None").alias("reason"))
    out = rank.shared_items(fact.unionByName(extra), DOMAIN.sites).first()
    assert (out["n_shared"], out["n_items"]) == (3, 6)
    assert values(rank.shared_top_items(reach, 2, DOMAIN.sites)) == [("ball",), ("camera",)]


def test_dealt_rows_give_the_same_ranks(spark, make, values):
    view = make(
        "site string, subject int, age int, item string, category string, frame int",
        ("A", 1, 3, "x", "c", 1), ("A", 1, 3, "x", "c", 2), ("A", 1, 3, "y", "d", 1), ("B", 2, 4, "y", "d", 5),
    )
    whole, spread = rank.item_distribution(view), rank.item_distribution(view, tasks=37)
    assert values(spread) == values(whole)
    assert spread.rdd.getNumPartitions() == 37 and whole.rdd.getNumPartitions() < 37
