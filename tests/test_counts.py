"""Counts that roll up against plain distinct counts, sketches against exact values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.operators import counts


@pytest.mark.parametrize("kind", ["long", "string"])
def test_levels_equal_distinct_counts(spark, values, kind):
    rng = random.Random(3)
    big = [0, 63, 64, -1, -64, -65, 2**62, 2**62 + 1, 2**53 + 1, -(2**63), 2**63 - 1, None]
    cast = (lambda v: v) if kind == "long" else (lambda v: None if v is None else f"v{v}")
    rows = [(rng.choice(["a", "b", None]), rng.randrange(5), cast(rng.choice(big + list(range(40))))) for _ in range(600)]
    rows.append(("only null", 1, None))
    df = spark.createDataFrame(rows, f"site string, hour int, v {kind}")
    got = counts.distinct_levels(df, {"hour": ["site", "hour"], "site": ["site"], "all": []}, "v")
    seen = {}
    for site, hour, v in rows:
        for key in (("hour", site, hour), ("site", site, None), ("all", None, None)):
            seen.setdefault(key, set()).update([] if v is None else [v])
    assert {(r.level, r.site, r.hour): r.n for r in got.collect()} == {k: len(v) for k, v in seen.items()}
    assert counts.distinct_levels(df.limit(0), {"site": ["site"]}, "v").count() == 0


def test_levels_read_the_table_once(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    out = counts.distinct_levels(df, {"one": ["l_returnflag", "l_linestatus"], "two": ["l_returnflag"]}, "l_partkey")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 3


def test_sketches_stay_within_their_stated_errors(spark, tmp_path):
    n = 50_000
    df = spark.range(n).select((F.col("id") % 7).alias("day"), (F.col("id") * F.col("id") % 40_009).alias("v"), F.rand(5).alias("x"))
    counts.sketches(df, ["day"], distinct=["v"], quantiles=["x"]).write.parquet(str(tmp_path / "s"))
    state = spark.read.parquet(str(tmp_path / "s"))
    whole = counts.merged(state.drop("day"), [])
    row = whole.select(counts.approx_distinct("v").alias("v"), *[counts.approx_quantile("x", p).alias(f"q{i}") for i, p in enumerate((0.1, 0.5, 0.99))]).first()
    exact = df.select("v").distinct().count()
    assert abs(row.v - exact) <= 4 * counts.HLL_ERROR * exact
    x = np.sort([r.x for r in df.select("x").collect()])
    for q, p in zip(row[1:], (0.1, 0.5, 0.99)):
        assert abs(np.searchsorted(x, q) / n - p) <= 2 * counts.KLL_ERROR
    per_day = state.select("day", counts.approx_distinct("v").alias("n")).collect()
    days = {r.day: r.n for r in df.groupBy("day").agg(F.count_distinct("v").alias("n")).collect()}
    assert all(abs(r.n - days[r.day]) <= 4 * counts.HLL_ERROR * days[r.day] for r in per_day)
