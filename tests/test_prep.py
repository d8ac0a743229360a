import random

import pytest
from pyspark.sql import functions as F

from framewise.domain import Domain
from framewise.operators import joins
from framewise.plans import prep

REC = "subject long, frame string, item string, reason string"
OVER = "subject long, frame string, new_item string, new_reason string"


@pytest.fixture
def annotations(make):
    ddl = "subject long, frame string, item string, none int, exclude int, unsure int"
    return make(
        ddl,
        (1, "a", "cup", 0, 0, 0),
        (1, "b", "cup", 0, 1, 0),
        (1, "c", None, 1, 0, 1),
        (1, "d", "EXCLUDE this", 0, 0, 0),
    )


def test_excluded_frames_keep_a_row_without_reason(annotations, values):
    flagged = prep.text_flag(annotations, "item", prep.EXPERIMENTER_TEXT, "experimenter")
    assert values(prep.flags_to_reason(flagged, prep.REASON_FLAGS), "frame", "item", "reason") == [
        ("a", "cup", None),
        ("b", "cup", "Exclude"), ("b", "cup", None),
        ("c", None, "None"), ("c", None, "Unsure"), ("c", None, None),
        ("d", "EXCLUDE this", "Experimenter"), ("d", "EXCLUDE this", None),
    ]
    strict = prep.flags_to_reason(flagged, prep.REASON_FLAGS, strict=True)
    assert values(strict, "frame", "reason") == [
        ("a", None), ("b", "Exclude"), ("c", "None"), ("c", "Unsure"), ("d", "Experimenter"),
    ]


def test_overlay_replaces_even_by_null(make, values):
    base = make(REC, (1, "a", "cup", None), (1, "a", "pot", None), (1, "b", "cup", None), (2, "a", "mug", "None"))
    overlay = make(OVER, (1, "a", None, None), (1, "b", "rope", "Unsure"), (9, "z", "new", None))
    assert values(prep.apply_overlay(base, overlay)) == [
        (1, "a", None, None), (1, "b", None, "Unsure"), (2, "a", None, "None"),
    ]
    assert values(prep.apply_overlay(base, overlay, how="full")) == [
        (1, "a", None, None), (1, "b", None, "Unsure"), (2, "a", None, "None"), (9, "z", "new", None),
    ]


@pytest.mark.parametrize("seed", range(6))
def test_folded_overlays_equal_one_after_the_other(spark, values, seed):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    rows = lambda n, frames: [(pick(1, 2), pick(*frames), pick("cup", "pot", None), pick(None, None, "Unsure")) for _ in range(n)]
    base = spark.createDataFrame(rows(12, "abcd"), REC)
    overlays = [(spark.createDataFrame(rows(4, "abcdefg"), OVER), pick("left", "full")) for _ in range(3)]
    want = base
    for overlay, how in overlays:
        want = prep.apply_overlay(want, overlay, how)
    assert values(prep.fold_overlays(base, overlays)) == values(want.distinct())
    assert values(prep.fold_overlays(base, [])) == values(prep.apply_overlay(base, overlays[0][0].limit(0)))


def one_after_the_other(records, overlays, labels, corrections, categories, people, times, caps):
    rows = prep.flags_to_reason(prep.text_flag(records, "item", prep.EXPERIMENTER_TEXT, "experimenter"), prep.REASON_FLAGS)
    for overlay, how in overlays:
        rows = prep.apply_overlay(rows, overlay, how)
    rows = prep.regularise_labels(prep.split_items(rows, caps[0]), labels, caps[1])
    rows = prep.relabel_by_frame(prep.apply_corrections(rows, corrections, caps[2]), records, "knife", RULES)
    return prep.clean_fact(prep.resolve_reasons(prep.assign_category(rows, categories)), people, times)


@pytest.mark.parametrize("seed", range(8))
def test_prepare_equals_its_steps_one_after_the_other(spark, values, seed):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    items = ("cup", "knife, cup", " pot ,cup", " , ", None, "exclude it", "knife", "a,b,c,d", "phone")
    flag = lambda: pick(0, 0, 0, 1, None)
    records = spark.createDataFrame(
        [(pick(1, 2), pick(*"abcdef"), pick(*items), flag(), flag(), flag(), flag(), flag()) for _ in range(14)],
        "subject long, frame string, item string, none int, exclude int, unsure int, tool_meal int, tool_work int",
    )

    def overlay(n):
        return spark.createDataFrame(
            [(pick(1, 2), pick(*"abcdefgh"), pick(*items), pick(None, None, "Unsure", "None")) for _ in range(n)], OVER
        )

    overlays = [(overlay(4), pick("left", "full")) for _ in range(3)]
    labels = spark.createDataFrame([("cup", "mug, saucer,lid"), ("pot", " , "), ("phone", None), ("knife", "blade"), (None, "ghost")], "item string, new_item string")
    categories = spark.createDataFrame([("mug", "Toy"), ("blade", "Tool"), ("knife-M", "Tool"), (None, "Nothing")], "item string, category string")
    people = spark.createDataFrame([(1, "T", 3, "f", 0)], "subject long, site string, age int, sex string, wearer int")
    times = spark.createDataFrame([(1, f, "10:00:00") for f in "abcg"], "subject long, frame string, ts string")
    corrections, caps = overlay(5), pick((None, None, None), prep.PUBLISHED_CAPS)
    got = prep.prepare(records, overlays, labels, corrections, "knife", RULES, categories, people, times, caps=caps)
    assert values(got) == values(one_after_the_other(records, overlays, labels, corrections, categories, people, times, caps))


def test_prepare_without_rules_and_with_durations(spark, make, values):
    records = make(
        "subject long, frame string, item string, none int, exclude int, unsure int, tool_meal int, tool_work int",
        (1, "a", "knife", 0, 0, 0, 1, 0), (1, "b", "cup", 0, 0, 0, 0, 0),
    )
    nothing = make(OVER)
    names = make("item string, new_item string, category string", ("cup", None, "Toy"), ("knife", None, "Tool"))
    people = make("subject long, site string, age int, sex string, wearer int", (1, "T", 3, "f", 0))
    times = make("subject long, frame string, ts string, duration double", (1, "a", "10:00:00", 5.0))
    out = prep.prepare(records, [], names, nothing, "knife", [], names, people, times)
    assert values(out.select("frame", "item", "category", "duration")) == [("a", "knife", "Tool", 5.0), ("b", "cup", "Toy", None)]


def test_the_chain_shuffles_records_by_frame_once(spark):
    from framewise.catalog import prep as catalog

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.overlaid(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        chain = catalog.fact(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    names = "hashpartitioning(subject#"
    overlays = [line for line in plan.split("\n") if "Exchange" in line and names in line and "_turn" not in line]
    assert plan.count("Window") == 1 and len(overlays) <= 2
    assert "Exchange hashpartitioning(coalesce(item" not in chain.replace(" ", "") and "_part" in chain


def test_heavy_and_null_items_are_dealt_over_parts(spark, values):
    rows = [(1, str(i), "cup" if i % 3 == 0 else None if i % 3 == 1 else f"item {i}", None) for i in range(3000)]
    df = spark.createDataFrame(rows, REC)
    labels = spark.createDataFrame([("cup", "mug"), ("cup", "jug"), (None, "void"), ("item 5", "five"), ("unused", "x")], "item string, new_item string")
    assert joins.heavy_values(df, "item") == ["cup"] and joins.heavy_values(df.limit(100), "item") == []
    want = joins.null_safe_join(df, labels, ["item"], "left")
    for heavy in ([], ["cup"]):
        assert values(joins.look_up(df, labels, "item", prep.KEYS, heavy), *want.columns) == values(want)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = joins.look_up(df, labels, "item", prep.KEYS, ["cup"])
        plan = dealt._jdf.queryExecution().executedPlan().toString()
        sizes = [r["count"] for r in dealt.groupBy(F.pmod(F.xxhash64(*prep.KEYS), F.lit(8)).alias("p"), "item").count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all("_part" in line for line in plan.split("\n") if "Exchange hashpartitioning" in line)
    assert max(sizes) < 2 * 3000 / 3 / 4


def test_analysis_view_with_a_domain(make, values):
    fact = make(
        "site string, item string, category string, reason string, ts timestamp",
        ("R", "cup", "Toy", None, None), ("X", "cup", "Other", None, None), ("T", "cup", None, None, None), ("T", "p", "Toy", "None", None),
    )
    out = prep.analysis_view(fact, domain=Domain(sites=("T", "R"), categories=("Tool", "Toy")))
    assert values(out, "site", "site_level", "category", "category_level") == [("R", 2, "Toy", 2), (None, None, None, None)]


def test_duplicate_overlay_keys_give_all_their_rows(make, values):
    base = make(REC, (1, "a", "cup", None), (1, "a", "pot", None))
    overlay = make(OVER, (1, "a", "x", None), (1, "a", "y", None), (1, "a", "x", None))
    assert values(prep.apply_overlay(base, overlay), "item") == [("x",), ("y",)]


def test_overlays_from_flags(make, values):
    each = make("subject long, frame string, item string, exclude int, unsure int", (1, "a", "cup", 1, 0), (1, "b", "pot", 1, 1))
    out = prep.overlay_each_flag(each, {"exclude": "Exclude", "unsure": "Unsure"})
    assert values(out, "frame", "new_reason") == [("a", "Exclude"), ("a", None), ("b", "Exclude"), ("b", "Unsure")]
    first = make(
        "subject long, frame string, item string, none int, exclude int",
        (1, "a", None, 1, 1), (1, "b", None, 1, 0), (1, "c", "cup", 0, 0), (1, "d", "cup", 1, None),
    )
    out = prep.overlay_first_flag(first, [("exclude", "Exclude"), ("none", "None")])
    assert values(out, "frame", "new_reason") == [("a", "Exclude"), ("b", "None"), ("c", None), ("d", None)]


def test_worklist_leaves_out_checked_frames(make, values):
    df = make(REC, (1, "a", None, "Unsure"), (1, "b", None, "Unsure"), (2, "a", None, "None"))
    checked = make("subject long, frame string", (1, "a"))
    out = prep.worklist(df, checked, prep.KEYS, F.col("reason") == "Unsure")
    assert values(out, "subject", "frame") == [(1, "b")]


def test_split_caps_trims_and_blanks(make, values):
    df = make(REC, (1, "a", "x, y ,z,w", None), (1, "b", None, None), (1, "c", "x,y", "Unsure"), (1, "d", "x, x", None))
    assert values(prep.split_items(df), "frame", "item") == [
        ("a", "w"), ("a", "x"), ("a", "y"), ("a", "z"), ("c", None), ("d", "x"),
    ]
    assert values(prep.split_items(df, prep.PUBLISHED_CAPS[0]), "frame", "item") == [
        ("a", "x"), ("a", "y"), ("a", "z"), ("c", None), ("d", "x"),
    ]


def test_labels_may_be_lists_and_missing_labels_keep_the_item(make, values):
    df = make(REC, (1, "a", "phone w case", None), (1, "b", "cup", None), (1, "c", "pan", None), (1, "d", None, "None"))
    labels = make("item string, new_item string", ("phone w case", "phone, case, strap"), ("cup", None))
    assert values(prep.regularise_labels(df, labels), "frame", "item") == [
        ("a", "case"), ("a", "phone"), ("a", "strap"), ("b", "cup"), ("c", "pan"), ("d", None),
    ]
    assert values(prep.regularise_labels(df, labels, 2), "frame", "item") == [
        ("a", "case"), ("a", "phone"), ("b", "cup"), ("c", "pan"), ("d", None),
    ]


def test_corrections_replace_whole_frames(make, values):
    df = make(REC, (1, "a", "x", None), (1, "a", "y", None), (1, "b", None, "None"), (1, "c", "z", None))
    corrections = make(OVER, (1, "a", "p, q", None), (1, "b", "r", None), (1, "c", None, "Unsure"), (7, "n", "s", None))
    assert values(prep.apply_corrections(df, corrections), "frame", "item", "reason") == [
        ("a", "p", None), ("a", "q", None), ("b", "r", None), ("c", None, "Unsure"),
    ]


@pytest.fixture
def knives(make):
    ddl = "subject long, frame string, item string, tool_meal int, tool_work int"
    return make(
        ddl,
        (1, "a", "knife, cup", 1, 0), (1, "b", "knife", 0, 1), (1, "c", "knife", 1, 1),
        (1, "d", "knife", 0, 0), (1, "e", "cup", 1, 0), (1, "f", None, 1, 1),
    )


RULES = [("tool_meal", "knife-M"), ("tool_work", "knife-W")]


def test_relabel_renames_the_whole_frame_first_rule_wins(knives, make, values):
    df = make(REC, *[(1, f, i, None) for f, i in [("a", "knife"), ("a", "cup"), ("b", "knife"), ("c", "knife"), ("d", "knife"), ("e", "cup")]])
    assert values(prep.relabel_by_frame(df, knives, "knife", RULES), "frame", "item") == [
        ("a", "knife-M"), ("a", "knife-M"), ("b", "knife-W"), ("c", "knife-M"), ("d", "knife"), ("e", "cup"),
    ]
    only = prep.relabel_by_frame(df, knives, "knife", RULES, only_matching=True)
    assert values(only.where("frame = 'a'"), "item") == [("cup",), ("knife-M",)]


def test_audit_counts_conflicting_flags(knives):
    assert prep.audit_exclusive(knives, "knife", "tool_meal", "tool_work").first()[0] == 1


def test_categories_and_conflicting_reasons(make, values):
    df = make(REC, (1, "a", "cup", None), (1, "a", "odd", None), (1, "b", "cup", "Exclude"), (1, "b", "cup", "Unsure"), (1, "b", "cup", None), (1, "c", None, "Unsure"))
    categories = make("item string, category string", ("cup", "Mealtime Tool"))
    step = prep.assign_category(df, categories)
    assert values(step.where("frame = 'a'"), "item", "category") == [("cup", "Mealtime Tool"), ("odd", None)]
    resolved = prep.resolve_reasons(step)
    assert values(resolved.where("frame <> 'a'"), "frame", "reason", "item") == [
        ("b", "None", "cup"), ("b", "None", None), ("c", "Unsure", None),
    ]


def test_pick_one_is_fixed_by_the_seed(make, values):
    df = make("person int, subject long", (1, 10), (1, 11), (2, 20), (2, 21), (3, 30))
    picks = {s: values(prep.pick_one(df, "person", "subject", s)) for s in range(12)}
    assert picks[3] == values(prep.pick_one(df, "person", "subject", 3))
    assert {len(p) for p in picks.values()} == {3}
    assert {p[0][1] for p in picks.values()} == {10, 11}


def test_clean_fact_and_view(make, values):
    df = make("subject long, frame string, reason string, category string, item string",
              (1, "a", None, "Toy", "ball"), (1, "b", "None", "Toy", "ball"), (2, "a", None, "Toy", "ball"), (3, "a", None, None, "odd"))
    people = make("subject long, site string, age int, sex string, wearer int", (1, "T", 5, "F", 1), (2, "R", 7, "M", 0))
    times = make("subject long, frame string, ts timestamp", ).unionByName(
        make("subject long, frame string, t string", (1, "a", "2024-01-01 13:05:00"), (3, "a", "2024-01-01 08:00:00"))
        .select("subject", "frame", F.to_timestamp("t").alias("ts")))
    dropped = make("subject long", (2,))
    fact = prep.clean_fact(df, people, times, dropped)
    assert fact.columns == ["site", "subject", "age", "sex", "wearer", "frame", "reason", "category", "item", "ts"]
    assert values(fact, "subject", "frame", "reason", "category", "item") == [
        (1, "a", None, "Toy", "ball"), (1, "b", "None", None, None), (3, "a", None, None, "odd"),
    ]
    view = prep.analysis_view(fact, ("camera",))
    assert values(view, "subject", "item", "hour") == [(1, "ball", 13)]


def test_colocated_records_are_not_shuffled_again(spark, make):
    base = make(REC, (1, "a", "x", None), (1, "b", "y, z", None), (2, "a", None, "Unsure"))
    overlay = make(OVER, (1, "a", "p, q", None))
    chain = prep.apply_overlay(prep.colocate(base.distinct()), overlay)
    chain = prep.resolve_reasons(prep.split_items(prep.apply_overlay(chain, overlay)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        chain.collect()
        plan = chain._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    base_exchanges = [
        line for line in plan.splitlines()
        if "Exchange hashpartitioning" in line and "Reused" not in line and "new_" not in line
    ]
    by_all_columns = [line for line in base_exchanges if "item#" in line]
    assert len(by_all_columns) == 1  # the first distinct
    assert sum("REPARTITION_BY_COL" in line for line in base_exchanges) == 1


def test_steps_dealt_by_frame_keep_rows_and_tasks(spark, make, values):
    records = "subject int, frame int, item string, reason string"
    rows = make(records, (1, 1, "a, b, a", None), (1, 1, "b", None), (2, 1, None, "Exclude"), (2, 2, "c", None))
    labels = make("item string, new_item string", ("a", "d, e"), ("c", "f"))
    kinds = make("item string, category string", ("d", "D"), ("b", "B"))
    patch = make("subject int, frame int, new_item string, new_reason string", (2, 2, "g, h", None))
    people = make("subject int, site string, age int, sex string, wearer int", (1, "A", 3, "f", 0), (1, "A", 3, "f", 0))
    times = make("subject int, frame int, ts string", (1, 1, "t"))

    def chain(tasks):
        out = prep.regularise_labels(prep.split_items(rows, tasks=tasks), labels, tasks=tasks)
        out = prep.apply_corrections(out, patch, tasks=tasks)
        out = prep.resolve_reasons(prep.assign_category(out, kinds, tasks=tasks))
        return out, prep.clean_fact(out, people, times, tasks=tasks)

    (named, fact), (named_n, fact_n) = chain(None), chain(37)
    assert values(named_n) == values(named) and values(fact_n) == values(fact)
    assert len(values(fact)) == 6 == len(set(values(fact)))
    assert named_n.rdd.getNumPartitions() == 37
