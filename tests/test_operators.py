import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from framewise.operators import joins, ordered, reshape


def test_anti_join_keeps_null_unless_listed(make, values):
    df = make("k string, v int", ("a", 1), ("b", 2), (None, 3))
    assert values(joins.non_members(df, make("k string", ("a",)), ["k"])) == [("b", 2), (None, 3)]
    assert values(joins.non_members(df, make("k string", (None,)), ["k"])) == [("a", 1), ("b", 2)]
    assert values(joins.members(df, make("k string", (None,), ("a",), ("a",)), ["k"])) == [("a", 1), (None, 3)]


def test_outside_counts_null_as_outside(make, values):
    df = make("k string", ("a",), ("b",), (None,))
    assert values(df.where(joins.outside(F.col("k"), ("a",)))) == [("b",), (None,)]
    assert values(df.where(joins.outside(F.col("k"), ()))) == [("a",), ("b",), (None,)]


def test_null_keys_match(make, values):
    left = make("k string, a int", ("x", 1), (None, 2), ("z", 9))
    right = make("k string, b int", ("x", 3), (None, 4), ("y", 5))
    assert values(joins.null_safe_join(left, right, ["k"], "left")) == [
        ("x", 1, 3), ("z", 9, None), (None, 2, 4),
    ]
    assert values(joins.null_safe_join(left, right, ["k"], "full")) == [
        ("x", 1, 3), ("y", None, 5), ("z", 9, None), (None, 2, 4),
    ]


def test_natural_full_join_uses_all_shared_names(make, values):
    left = make("s int, h int, n int", (1, 6, 2), (1, 7, 3))
    right = make("s int, h int, age int", (1, 6, 30), (1, 8, 30))
    assert values(joins.natural_full_join(left, right)) == [
        (1, 6, 2, 30), (1, 7, 3, None), (1, 8, None, 30),
    ]


def test_explode_list(make, values):
    df = make(
        "id int, item string, reason string",
        (1, "a", None), (2, "a , b", None), (3, "a,b,c", None), (4, "a,b,c,d", None),
        (5, None, None), (6, None, "None"), (7, " ,", None),
    )
    out = reshape.explode_list(df, "item", 3, keep_if=F.col("reason").isNotNull())
    assert values(out, "id", "item") == [
        (1, "a"), (2, "a"), (2, "b"), (3, "a"), (3, "b"), (3, "c"),
        (4, "a"), (4, "b"), (4, "c"), (6, None),
    ]


def test_melt_and_widen(make, values):
    df = make("id int, a int, b int, c int", (1, 1, 0, None))
    assert reshape.column_range(df, "a", "b") == ["a", "b"]
    long = reshape.melt(df, ["id"], ["a", "b", "c"], "flag", "val")
    assert values(long) == [(1, "a", 1), (1, "b", 0), (1, "c", None)]
    wide = reshape.widen(long, ["id"], "flag", ["a", "c", "d"], F.first("val"))
    assert values(wide) == [(1, 1, None, None)]


def test_complete_of_a_hot_group_is_spread(spark, values):
    rows = [("hot", i % 400, f"item {(i * 7) % 30}", i) for i in range(2000)] + [(None, 1, "x", 5), ("small", 2, "y", 6), ("small", 3, None, 7)]
    df = spark.createDataFrame(rows, "site string, s int, item string, n int").dropDuplicates(["site", "s", "item"])
    want = set()
    sites = {r[0] for r in rows}
    cells = {(r.site, r.s, r.item): r.n for r in df.collect()}
    for site in sites:
        for s in {r[1] for r in rows if r[0] == site}:
            want |= {(site, s, item, cells.get((site, s, item), 0)) for item in {r[2] for r in rows if r[0] == site}}
    assert joins.heavy_groups(df, ["site"]) == [("hot",)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = reshape.complete(df, ["site"], "s", "item", {"n": 0})
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = out.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    keyed = [line.split("hashpartitioning(")[1].split(", 8,")[0] for line in plan.split("\n") if "hashpartitioning(" in line]
    assert keyed and all("," in k and ("_part" in k or "s#" in k or "item" in k or "groupingexpression" in k) for k in keyed)


def test_heavy_groups_are_counted_over_all_rows(spark):
    """Shares just above and just below the bound, which a sample of rows cannot tell apart."""
    above, at = 1001, 1000
    rows = [("above", 1)] * above + [(None, 2)] * above + [("at", 3)] * at + [(f"rare {i}", 4) for i in range(8000 - 2 * above - at)]
    df = spark.createDataFrame(rows, "a string, `b.c` int")
    assert set(joins.heavy_groups(df, ["a", "b.c"])) == {("above", 1), (None, 2)} and joins.heavy_values(df, "a") == ["above"]
    assert joins.heavy_groups(df, ["a"], sample=1001) == [] and set(joins.heavy_groups(df, ["a"], sample=1000)) == {("above",), (None,)}
    assert joins.heavy_groups(df, []) == [()] and joins.heavy_groups(df.limit(0), []) == []


def test_heavy_groups_send_only_themselves_to_the_driver(spark, tmp_path):
    """Tasks add up their own rows: nothing but the hot keys is collected, and the rows are read once."""
    spark.range(200_000).selectExpr("if(id % 3 = 0, 'hot', concat('item ', id)) as item").repartition(40).write.parquet(f"{tmp_path}/rows")
    frame = type(spark.range(1))
    seen, collect = [], frame.collect

    def collected(self):
        out = collect(self)
        seen.append((len(out), self._jdf.queryExecution().executedPlan().toString()))
        return out

    frame.collect = collected
    try:
        assert joins.heavy_groups(spark.read.parquet(f"{tmp_path}/rows"), ["item"]) == [("hot",)]
    finally:
        frame.collect = collect
    [(rows, plan)] = seen
    assert rows == 1 and "TakeOrdered" not in plan and "ReusedExchange" in plan.split("Initial Plan")[0]


def test_complete_stays_inside_the_group(make, values):
    df = make("site string, s int, item string, n int", ("A", 1, "x", 4), ("A", 2, "y", 1), ("B", 3, "z", 2))
    out = reshape.complete(df, ["site"], "s", "item", {"n": 0})
    assert values(out) == [
        ("A", 1, "x", 4), ("A", 1, "y", 0), ("A", 2, "x", 0), ("A", 2, "y", 1), ("B", 3, "z", 2),
    ]


def test_counts_over_levels(make, values):
    df = make("s int, frame int, c string", (1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (2, 1, "b"))
    out = reshape.counts_over_levels(df, ["s"], "frame", "c", ("a", "b", "z"))
    assert values(out, "s", "n_frames", "c", "n") == [
        (1, 2, "a", 2), (1, 2, "b", 1), (1, 2, "z", 0), (2, 1, "a", 0), (2, 1, "b", 1), (2, 1, "z", 0),
    ]


def test_histogram_bins_are_centred(make, values):
    df = make("x double", (0.0,), (0.4,), (0.5,), (1.2,), (-0.6,))
    assert values(reshape.histogram(df, "x", 1.0)) == [(-1.0, 1), (0.0, 2), (1.0, 2)]


def test_one_hot(make, values):
    df = make("c string", ("a",), ("b",), (None,))
    assert values(reshape.one_hot(df, "c", {"a": "is_a"})) == [("a", 1), ("b", 0), (None, None)]


@pytest.mark.parametrize("seed", range(4))
def test_neighbours_equal_a_plain_window(spark, values, seed):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for subject in range(5):
        for i in range(rng.choice([1, 2, 40])):
            rows.append((subject, i, start + timedelta(hours=rng.randrange(0, 200)), rng.choice(["a", "b", None])))
    df = spark.createDataFrame(rows, "subject int, frame int, ts timestamp, v string")
    got = ordered.neighbours(df, ["subject"], ["ts", "frame"], ["v", "ts"], F.date_trunc("day", "ts"))
    w = Window.partitionBy("subject").orderBy("ts", "frame")
    want = df.withColumns(
        {f"{p}_{c}": f(c).over(w) for c in ("v", "ts") for p, f in (("prev", F.lag), ("next", F.lead))}
    )
    assert values(got, *want.columns) == values(want)


def one_day(subjects, hot):
    """Rows of many subjects in one day, ``hot`` of them of subject 0."""
    start = datetime(2024, 1, 1)
    owner = [0] * hot + [1 + i % subjects for i in range(2 * hot)]
    return [(s, i, start + timedelta(seconds=(i * 7919) % 86400), i % 5) for i, s in enumerate(owner)]


def test_a_hot_subject_of_one_day_is_cut_evenly(spark, values):
    df = spark.createDataFrame(one_day(500, 4000), "subject int, frame int, ts timestamp, v int")
    cut = ordered.slice_of(df, ["subject"], ["ts", "frame"], slices=16)
    sizes = [r["count"] for r in df.groupBy("subject", cut.alias("s")).count().collect() if r["subject"] == 0]
    assert len(sizes) > 3 and max(sizes) <= 2 * 12000 / 16
    got = ordered.neighbours(df, ["subject"], ["ts", "frame"], ["v"], cut)
    w = Window.partitionBy("subject").orderBy("ts", "frame")
    assert values(got) == values(df.withColumns({"prev_v": F.lag("v").over(w), "next_v": F.lead("v").over(w)}))
    auto = ordered.neighbours(df, ["subject"], ["ts", "frame"], ["v"])
    assert values(auto) == values(got)
    assert ordered.slice_of(df.limit(100), ["subject"], ["ts", "frame"]) is None


def test_clustered_values_spread_over_slices(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.random(9000) * 1e-6, rng.random(1000) * 100, np.full(2000, 50.0)])
    df = spark.createDataFrame([("g", float(v)) for v in x] + [(None, 1.0), (None, None)], "g string, x double")
    counts = df.groupBy("g", "x").count()
    cut = ordered.slice_of(df.where("x is not null"), ["g"], ["x"], slices=20)
    sizes = [r["count"] for r in counts.groupBy("g", cut.alias("s")).count().collect()]
    assert max(sizes) <= 3 * len(x) / 20
    out = {r["g"]: r for r in ordered.quantiles(df, ["g"], "x", {"q": 0.25, "r": 0.9}).collect()}
    assert [out["g"]["q"], out["g"]["r"]] == pytest.approx(list(np.quantile(x, [0.25, 0.9])))
    assert (out[None]["q"], out[None]["n"]) == (1.0, 1)


@pytest.mark.parametrize("order", [["s"], ["d", "s"], ["f", "s"], ["t", "f"], ["z", "s"]])
def test_cuts_follow_the_order_of_any_type(spark, order):
    rng = random.Random(2)
    rows = [
        (rng.choice(["a", "é", "Z", "aa", "\U0001F600", None]), date(2024, 1, 1) + timedelta(days=rng.randrange(50)),
         rng.choice([0.5, -1.0, 3.0, float("nan"), None]), datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(999)))
        for _ in range(2000)
    ]
    df = spark.createDataFrame(rows, "s string, d date, f double, t timestamp")
    df = df.withColumn("z", F.col("t").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, 0, cast(hash(s) % 100000 as decimal(18, 6)) / 1000)"))
    cut = ordered.slice_of(df, [], order, slices=8)
    w = Window.orderBy(*order)
    steps = df.withColumn("n", cut).withColumn("before", F.lag("n").over(w))
    assert steps.where("n < before").isEmpty() and steps.agg(F.max("n")).first()[0] > 1


@pytest.mark.parametrize("width", [0.5, 7.0, 1000.0, None])
def test_running_total_and_quantiles(spark, width):
    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.integers(-30, 60, 400)] + [("b", 2.5)] + [(None, 1.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    out = ordered.quantiles(df, ["g"], "x", {"q1": 0.25, "q2": 0.5, "q9": 0.93}, width).collect()
    for row in out:
        x = [v for g, v in rows if g == row["g"]]
        assert row["n"] == len(x)
        assert [row["q1"], row["q2"], row["q9"]] == pytest.approx(list(np.quantile(x, [0.25, 0.5, 0.93])))
    assert len(out) == 3


def test_holm_steps_down_with_a_running_maximum(make):
    df = make("t string, p double", ("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None))
    out = {r["t"]: r["p_adjusted"] for r in ordered.holm(df, "p", [], "t").collect()}
    assert out["d"] is None
    assert [out["a"], out["c"], out["b"]] == pytest.approx([0.03, 0.06, 0.06])


def test_rank_ties_follow_the_last_key(make, values):
    df = make("g string, item string, p double", ("x", "b", 0.5), ("x", "a", 0.5), ("x", "c", None), ("y", "z", 0.1))
    order = [F.col("p").desc_nulls_last(), F.col("item")]
    assert values(ordered.rank_rows(df, ["g"], order), "g", "item", "rank") == [
        ("x", "a", 1), ("x", "b", 2), ("x", "c", 3), ("y", "z", 1),
    ]
    assert values(ordered.rank_rows(df, ["g"], order, top=1), "item") == [("a",), ("z",)]


def test_tasks_follow_the_rows_and_are_kept(spark, make):
    from framewise.operators.tasks import ROWS, dealt, tasks_for

    assert tasks_for(spark, 0) == spark.sparkContext.defaultParallelism
    assert tasks_for(spark, 1000 * ROWS + 1) == 1001
    rows = make("k int, v int", (1, 1), (1, 1), (2, 3))
    assert dealt(rows, ["k"], None) is rows
    spread = dealt(rows, ["k"], 37).groupBy("k", "v").count()
    assert spread.rdd.getNumPartitions() == 37
