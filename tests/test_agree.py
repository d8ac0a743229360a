import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from framewise.plans import agree

CODING = "site string, subject long, frame string, item string, category string, reason string"


def coding(make, *rows):
    return make(CODING, *[("T", *r) for r in rows])


def test_frames_missing_on_one_side_agree_and_two_item_frames_do_not(make, values):
    main = coding(make, (1, "a", "cup", "M", None), (1, "b", "x", "C", None), (1, "b", "y", "C", None),
                  (1, "c", "cup", "M", None), (1, "d", None, None, "None"), (9, "a", "cup", "M", None))
    second = coding(make, (1, "a", "cup", "M", None), (1, "b", "x", "C", None), (1, "b", "y", "C", None),
                    (1, "d", "pot", "M", None), (1, "e", "cup", "M", None))
    out = agree.frame_agreement(main, second)
    assert values(out, "frame", "item_match", "category_match", "reason_match", "n_items_match") == [
        ("a", 1, 1, 1, 1), ("b", 0, 1, 1, 1), ("c", 1, 1, 1, 1), ("d", 1, 1, 1, 1), ("e", 1, 1, 1, 1),
    ]
    strict = agree.frame_agreement(main, second, columns=("item",), missing="disagree", compare="set")
    assert values(strict, "frame", "item_match") == [("a", 1), ("b", 1), ("c", 0), ("d", 0), ("e", 0)]
    per_subject = agree.agreement(main, second)
    assert values(per_subject) == [("T", 1, 5, 1.0, 0.8)]


@pytest.mark.parametrize("seed", range(3))
def test_agreement_equals_the_pairwise_join(spark, values, seed):
    rng = random.Random(seed)

    def rows():
        return [("T", 1, f"f{rng.randrange(60)}", rng.choice(["a", "b", "c", None]), None, None) for _ in range(110)]

    main = spark.createDataFrame(rows(), CODING).distinct()
    second = spark.createDataFrame(rows(), CODING).distinct()
    pairs = main.alias("m").join(second.alias("s"), ["site", "subject", "frame"], "full")
    differ = F.coalesce(F.sum((F.col("m.item") != F.col("s.item")).cast("int")), F.lit(0))
    sizes = F.coalesce(F.max((F.col("m.n") != F.col("s.n")).cast("int")), F.lit(0))
    frame = Window.partitionBy("site", "subject", "frame")
    pairs = (
        main.withColumn("n", F.count(F.lit(1)).over(frame)).alias("m")
        .join(second.withColumn("n", F.count(F.lit(1)).over(frame)).alias("s"), ["site", "subject", "frame"], "full")
        .groupBy("frame").agg((differ == 0).cast("int").alias("a"), (sizes == 0).cast("int").alias("b"))
    )
    got = agree.frame_agreement(main, second, columns=("item",))
    assert values(got, "frame", "item_match", "n_items_match") == values(pairs)


def test_summary_means_are_over_subjects(make, values):
    stats = make("site string, subject long, n_frames long, category_agreement double, item_agreement double",
                 ("R", 1, 100, 0.9, 0.8), ("T", 2, 10, 1.0, 0.5), ("T", 3, 30, 0.5, 0.5))
    assert values(agree.agreement_summary(stats)) == [
        ("All", 140, pytest.approx(80.0), pytest.approx(60.0)),
        ("R", 100, pytest.approx(90.0), pytest.approx(80.0)),
        ("T", 40, pytest.approx(75.0), pytest.approx(50.0)),
    ]


def test_durations_skip_the_first_and_last_frame(spark, values):
    start = datetime(2024, 3, 1, 23, 59, 30)
    rows = [(1, f"f{i}", start + timedelta(seconds=15 * i)) for i in range(5)] + [(2, "only", start)]
    rows += [(3, "x", start), (3, "y", start + timedelta(days=3))]
    df = spark.createDataFrame(rows, "subject long, frame string, ts timestamp")
    out = agree.frame_durations(df)
    assert values(out, "subject", "frame", "duration") == [
        (1, "f0", None), (1, "f1", 15.0), (1, "f2", 15.0), (1, "f3", 15.0), (1, "f4", None),
        (2, "only", None), (3, "x", None), (3, "y", None),
    ]
