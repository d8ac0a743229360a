from datetime import datetime, timedelta

import pytest

from framewise.domain import Domain
from framewise.plans import rates, report
from framewise.plans.prep import analysis_view

DOMAIN = Domain(sites=("T", "R"), categories=("C", "S", "N"))
FACT = "site string, subject long, age long, wearer int, frame string, reason string, category string, item string, ts timestamp"
DAY = datetime(2024, 5, 1)


def fact_of(spark, *rows):
    full = [(s, p, a, w, f, r, c, i, DAY + timedelta(minutes=m)) for s, p, a, w, f, r, c, i, m in rows]
    return spark.createDataFrame(full, FACT)


@pytest.fixture
def fact(spark):
    return fact_of(
        spark,
        ("T", 1, 5, 1, "a", None, "C", "apple", 370), ("T", 1, 5, 1, "a", None, "S", "bag", 370),
        ("T", 1, 5, 1, "b", None, "S", "bag", 371), ("T", 1, 5, 1, "b", None, "C", "apple", 371),
        ("T", 1, 5, 1, "c", None, "C", "corn", 372), ("T", 1, 5, 1, "d", None, "C", "corn", 440),
        ("T", 1, 5, 1, "e", "None", None, None, 441), ("T", 1, 5, 1, "e", None, "C", "apple", 441),
        ("T", 2, 9, 0, "a", None, "N", "leaf", 600), ("T", 3, 9, 0, "a", "Unsure", None, None, 600),
        ("R", 7, 4, 1, "a", None, "S", "bag", 400), ("R", 7, 4, 1, "b", None, "S", "cup", 401),
    )


@pytest.fixture
def view(fact):
    return analysis_view(fact)


def test_hourly_counts(view, values):
    assert values(rates.per_hour(view, "item"), "subject", "hour", "y") == [
        (1, 6, 3), (1, 7, 2), (2, 10, 1), (7, 6, 2),
    ]
    assert values(rates.items_per_hour_by_category(view), "subject", "category", "y") == [
        (1, "C", 2.0), (1, "S", 1.0), (2, "N", 1.0), (7, "S", 2.0),
    ]


def test_share_counts_rows_over_frames_and_fills_zero(view, values):
    out = rates.category_share(view, DOMAIN)
    assert values(out, "subject", "category", "y") == [
        (1, "C", 100.0), (1, "N", 0.0), (1, "S", 40.0),
        (2, "C", 0.0), (2, "N", 100.0), (2, "S", 0.0),
        (7, "C", 0.0), (7, "N", 0.0), (7, "S", 100.0),
    ]
    assert rates.category_share_by_age(view, DOMAIN).count() == 4


def test_transitions(view, values):
    # Frames a and b hold the same items in another order; c differs; d (next hour) does not; e does.
    out = rates.transition_rate(view, "item", keep_zero=True)
    assert values(out, "subject", "hour", "n_transitions", "n_values", "y") == [
        (1, 6, 1, 3, pytest.approx(1 / 3)), (1, 7, 1, 2, 0.5), (2, 10, 0, 1, 0.0), (7, 6, 1, 2, 0.5),
    ]
    assert values(rates.transition_rate(view, "item"), "subject", "hour") == [(1, 6), (1, 7), (7, 6)]
    by_category = rates.transition_rate(view, "category", keep_zero=True)
    assert values(by_category, "subject", "hour", "n_transitions", "n_values") == [
        (1, 6, 1, 2), (1, 7, 0, 1), (2, 10, 0, 1), (7, 6, 0, 1),
    ]


def test_category_transitions_see_repeated_categories(spark, values):
    view = analysis_view(fact_of(
        spark,
        ("T", 1, 5, 1, "a", None, "C", "apple", 1), ("T", 1, 5, 1, "b", None, "C", "apple", 2),
        ("T", 1, 5, 1, "b", None, "C", "corn", 2),
    ))
    assert values(rates.transition_rate(view, "category"), "n_transitions") == [(1,)]


def test_neighbouring_subjects_do_not_mix(spark):
    view = analysis_view(fact_of(spark, ("T", 1, 5, 1, "a", None, "C", "x", 1), ("T", 2, 5, 1, "b", None, "C", "y", 2)))
    assert rates.transition_rate(view, "item").count() == 0


@pytest.fixture
def scaffold_parts(make, view):
    hours = make("subject long, hour long", (1, 6), (1, 8), (2, 10), (2, 11), (99, 7))
    people = make("site string, subject long, age long", ("T", 1, 5), ("T", 2, 9), ("R", 7, 4), ("T", 50, 3))
    return hours, people


def test_scaffold_keeps_participants_without_hours(scaffold_parts, view, values):
    out = rates.hour_scaffold(*scaffold_parts, view)
    assert values(out, "subject", "site", "hour") == [
        (1, "T", 6), (1, "T", 8), (2, "T", 10), (2, "T", 11), (50, "T", None), (7, "R", None),
    ]
    assert rates.hour_scaffold(*scaffold_parts, view, DOMAIN).count() == 18


def test_hourly_stats_with_and_without_zero_hours(scaffold_parts, view):
    plain = rates.hourly_stats(view, "item").first()
    assert (plain["mean"], plain["median"], plain["min"], plain["max"]) == (2.0, 2.0, 1, 3)
    scaffold = rates.hour_scaffold(*scaffold_parts, view).where("hour is not null")
    filled = rates.hourly_stats(view, "item", scaffold).first()
    assert (filled["mean"], filled["min"]) == (pytest.approx(8 / 6), 0)


def test_model_frames(scaffold_parts, view, values):
    frame = rates.model_frame(view, DOMAIN)
    assert values(frame, "subject", "hour", "category", "n_frames", "n_items", "is_c") == [
        (1, 6, "C", 5, 2, 1), (1, 6, "S", 5, 1, 0), (1, 7, "C", 5, 2, 1), (2, 10, "N", 1, 1, 0), (7, 6, "S", 2, 2, 0),
    ]
    scaffold = rates.hour_scaffold(*scaffold_parts, view, DOMAIN).where("hour is not null")
    zero = rates.model_frame_zero(view, scaffold, DOMAIN)
    assert values(zero.where("subject = 1 and hour <> 7"), "hour", "category", "n_frames", "n_items") == [
        (6, "C", 3, 2), (6, "N", 0, 0), (6, "S", 3, 1), (8, "C", 0, 0), (8, "N", 0, 0), (8, "S", 0, 0),
    ]


def test_inclusion(fact, values):
    assert values(report.inclusion_report(fact)) == [
        ("All", 9, 7, 2, pytest.approx(200 / 9)), ("R", 2, 2, 0, 0.0), ("T", 7, 5, 2, pytest.approx(200 / 7)),
    ]
    # Subject 1: two excluded rows in one frame, five frames.
    assert values(report.unusable_subjects(fact)) == [(3, 1, 1)]


def test_people(fact, values):
    assert values(report.wearer_share(fact)) == [("R", None, 1, None), ("T", 2, 1, pytest.approx(2 / 3))]
    assert values(report.demographics_by_site(fact)) == [("R", 1, 2.0, 4.0), ("T", 3, pytest.approx(7 / 3), pytest.approx(23 / 3))]
    row = report.demographics(fact).first()
    assert (row["min_records"], row["max_records"], row["median_records"], row["n_subjects"]) == (1, 8, 1.5, 4)


def test_daily_and_category_tables(view, values):
    rows = {r["site"]: r for r in report.daily_items(view).collect()}
    assert (rows["All"]["mean"], rows["All"]["max"], rows["T"]["median"], rows["R"]["sd"]) == (2.0, 3, 2.0, None)
    means = {(r["category"], r["site"]): r for r in report.category_means(view, DOMAIN).collect()}
    assert means[("C", "T")]["mean"] == 0.5 and means[("C", "T")]["n"] == 2
    assert means[("C", "T")]["se"] == pytest.approx(0.5)
    assert values(report.top_category(view, DOMAIN, ("C", "S")), "subject", "category") == [(1, "C"), (7, "S")]
    assert values(report.subject_totals(view), "subject", "n_items", "n_frames") == [(1, 3, 5), (2, 1, 1), (7, 2, 2)]


def test_prevalence_counts_subjects_without_the_item(view):
    rows = {r["site"]: r for r in report.item_prevalence(view, "apple").collect()}
    assert (rows["T"]["min"], rows["T"]["max"], rows["T"]["median"], rows["T"]["prop_subjects"]) == (0.0, 0.6, 0.3, 0.5)
    assert rows["R"]["max"] == 0.0


def test_box_whiskers_stop_at_data(make):
    df = make("g string, y double", *[("a", float(v)) for v in (1, 2, 3, 4, 100)])
    row = report.box_summary(df, ["g"], "y", 1.0).first()
    assert (row["lower"], row["middle"], row["upper"], row["ymin"], row["ymax"]) == (2.0, 3.0, 4.0, 1.0, 4.0)
