"""Registered preparation queries: each step alone and the whole chain."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.catalog.common import PEOPLE, query, with_ctes
from framewise.operators.joins import non_members
from framewise.plans import prep
from framewise.sources import bindings as b
from framewise.sources import files
from framewise.sources.stages import StageStore

SEED = 11
PATTERN = "ring"
RULES = [("tool_meal", "ring-M"), ("tool_work", "ring-W")]

RECORDS = """listed AS (
  SELECT l_orderkey, string_agg(p_name, ', ' ORDER BY l_linenumber, p_name) AS text
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey)
  GROUP BY l_orderkey),
records AS (
  SELECT o_custkey AS subject, o_orderkey AS frame,
    CASE WHEN o_orderkey % 41 = 0 THEN 'please Exclude' WHEN o_orderkey % 43 = 0 THEN NULL ELSE text END AS item,
    o_orderkey % 29 = 0 AS none, o_orderkey % 31 = 0 AS exclude, o_orderkey % 37 = 0 AS unsure,
    o_orderkey % 3 = 0 AS tool_meal, o_orderkey % 4 = 0 AS tool_work
  FROM orders LEFT JOIN listed ON o_orderkey = l_orderkey)"""

RAW = """raw AS (SELECT DISTINCT * FROM (
  SELECT subject, frame, item, CASE WHEN none THEN 'None' END AS reason FROM records UNION ALL
  SELECT subject, frame, item, CASE WHEN exclude THEN 'Exclude' END FROM records UNION ALL
  SELECT subject, frame, item, CASE WHEN unsure THEN 'Unsure' END FROM records UNION ALL
  SELECT subject, frame, item, CASE WHEN lower(item) LIKE '%exclude%' THEN 'Experimenter' END FROM records))"""

OVERLAYS = """base_orders AS (SELECT *, o_custkey AS subject, o_orderkey AS frame FROM orders),
checked_unsure AS (
  SELECT subject, frame, CASE WHEN frame % 3 <> 0 THEN o_orderpriority END AS item,
    frame % 3 = 0 AS exclude, frame % 5 = 0 AS none FROM base_orders WHERE frame % 74 = 0),
o_unsure AS (SELECT DISTINCT * FROM (
  SELECT subject, frame, item AS new_item, CASE WHEN exclude THEN 'Exclude' END AS new_reason FROM checked_unsure UNION ALL
  SELECT subject, frame, item, CASE WHEN none THEN 'None' END FROM checked_unsure UNION ALL
  SELECT subject, frame, item, NULL FROM checked_unsure)),
o_immovable AS (
  SELECT subject, frame, nullif(o_orderpriority, '5-LOW') AS new_item,
    CASE WHEN frame % 100 = 0 THEN 'Exclude' END AS new_reason FROM base_orders WHERE frame % 50 = 0),
o_none AS (
  SELECT subject, CASE WHEN frame % 2 = 0 THEN -frame ELSE frame END AS frame,
    CASE WHEN frame % 5 = 0 THEN o_orderpriority END AS new_item,
    CASE WHEN frame % 3 = 0 THEN 'Exclude' WHEN frame % 7 = 0 THEN NULL WHEN frame % 5 <> 0 THEN 'None' END AS new_reason
  FROM base_orders WHERE frame % 47 = 0),
o_corrections AS (
  SELECT subject, frame,
    CASE WHEN frame % 2 = 1 THEN 'hand axe, ' || o_orderstatus || ', old anvil, rope' END AS new_item,
    CASE WHEN frame % 2 = 0 THEN 'Unsure' END AS new_reason
  FROM base_orders WHERE frame % 53 = 0)"""

DICTIONARIES = """names AS (
  SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS noun FROM part),
labels_dict AS (
  SELECT p_name AS item, CASE noun WHEN 'bolt' THEN first || ' nut' WHEN 'gear' THEN p_name || ' , cog' END AS new_item
  FROM names WHERE noun <> 'widget'),
categories_dict AS (
  SELECT DISTINCT CASE noun WHEN 'bolt' THEN first || ' nut' ELSE p_name END AS item, first AS category
  FROM names WHERE noun <> 'plate')"""


def overlay_sql(name: str, base: str, overlay: str, join: str = "LEFT") -> str:
    return f"""{name} AS (
  SELECT DISTINCT subject, frame, CASE WHEN reason IS NULL THEN item END AS item, reason FROM (
    SELECT coalesce(b.subject, o.subject) AS subject, coalesce(b.frame, o.frame) AS frame,
      CASE WHEN o.hit THEN new_item ELSE item END AS item,
      CASE WHEN o.hit THEN new_reason ELSE reason END AS reason
    FROM {base} b {join} JOIN (SELECT *, true AS hit FROM {overlay}) o
      ON b.subject = o.subject AND b.frame = o.frame))"""


def split_sql(name: str, base: str) -> str:
    return f"""{name} AS (
  SELECT DISTINCT subject, frame, CASE WHEN reason IS NULL THEN entry END AS item, reason FROM (
    SELECT subject, frame, reason, unnest(CASE WHEN len(entries) > 0 THEN entries ELSE [NULL] END) AS entry FROM (
      SELECT subject, frame, reason,
        list_filter(list_transform(string_split(item, ','), lambda x: trim(x)), lambda x: x <> '') AS entries
      FROM {base}))
  WHERE entry IS NOT NULL OR reason IS NOT NULL)"""


def labels_sql(name: str, base: str) -> str:
    named = f"""{name}_named AS (
  SELECT subject, frame, coalesce(new_item, b.item) AS item, reason
  FROM {base} b LEFT JOIN labels_dict d ON b.item IS NOT DISTINCT FROM d.item)"""
    return named + ",\n" + split_sql(name, f"{name}_named")


def relabel_sql(name: str, base: str) -> str:
    return f"""{name} AS (
  SELECT subject, frame, CASE
    WHEN (subject, frame) IN (SELECT (subject, frame) FROM records WHERE item LIKE '%ring%' AND tool_meal) THEN 'ring-M'
    WHEN (subject, frame) IN (SELECT (subject, frame) FROM records WHERE item LIKE '%ring%' AND tool_work) THEN 'ring-W'
    ELSE item END AS item, reason FROM {base})"""


def category_sql(name: str, base: str) -> str:
    return f"""{name} AS (
  SELECT DISTINCT subject, frame, reason, CASE WHEN reason IS NULL THEN category END AS category,
    CASE WHEN reason IS NULL THEN b.item END AS item
  FROM {base} b LEFT JOIN categories_dict d ON b.item IS NOT DISTINCT FROM d.item)"""


def resolve_sql(name: str, base: str) -> str:
    return f"""{name} AS (
  SELECT DISTINCT b.* REPLACE (CASE WHEN m.frame IS NOT NULL THEN 'None' ELSE reason END AS reason)
  FROM {base} b LEFT JOIN (
    SELECT subject, frame FROM {base} WHERE reason IS NOT NULL GROUP BY ALL HAVING count(DISTINCT reason) > 1) m
  ON b.subject = m.subject AND b.frame = m.frame)"""


PICKED = f"""pairs AS (SELECT c_custkey // 100 AS person, c_custkey AS subject FROM customer WHERE c_custkey % 100 < 2),
picked AS (
  SELECT person, arg_min(subject, md5('{SEED}/' || CAST(subject AS VARCHAR))) AS subject FROM pairs GROUP BY person),
dropped AS (SELECT subject FROM pairs WHERE subject NOT IN (SELECT subject FROM picked))"""

ALL_STEPS = with_ctes(
    PEOPLE,
    RECORDS,
    RAW,
    OVERLAYS,
    DICTIONARIES,
    overlay_sql("s_unsure", "raw", "o_unsure"),
    overlay_sql("s_immovable", "s_unsure", "o_immovable"),
    overlay_sql("s_none", "s_immovable", "o_none", "FULL"),
    split_sql("s_items", "s_none"),
    labels_sql("s_labels", "s_items"),
    overlay_sql("s_corrected", "s_labels", "o_corrections"),
    split_sql("s_corrections", "s_corrected"),
    relabel_sql("s_relabel", "s_corrections"),
    category_sql("s_category", "s_relabel"),
    resolve_sql("s_resolved", "s_category"),
    PICKED,
)


# ---------------------------------------------------------------- the chain in Spark


def raw(s, d):
    flagged = prep.text_flag(b.records(s, d), "item", prep.EXPERIMENTER_TEXT, "experimenter")
    return prep.flags_to_reason(flagged, prep.REASON_FLAGS)


def unsure_overlay(s, d):
    flags = {"exclude": "Exclude", "none": "None", "unsure": "Unsure"}
    return prep.overlay_each_flag(b.checked_unsure(s, d), flags)


def none_overlay(s, d):
    return prep.overlay_first_flag(b.no_items(s, d), [("exclude", "Exclude"), ("none", "None")])


def overlaid(s, d):
    return prep.fold_overlays(raw(s, d), overlays(s, d), b.line_tasks(s, d))


def dropped(s, d):
    pairs = b.pairs(s, d)
    picked = prep.pick_one(pairs, "person", "subject", SEED)
    return non_members(pairs, picked, ["subject"]).select("subject")


def overlays(s, d):
    return [(unsure_overlay(s, d), "left"), (b.immovable(s, d), "left"), (none_overlay(s, d), "full")]


def fact(s, d):
    return prep.prepare(
        b.records(s, d), overlays(s, d), b.labels(s, d), b.corrections(s, d), PATTERN, RULES,
        b.categories(s, d), b.people(s, d), b.timestamps(s, d), dropped(s, d), tasks=b.line_tasks(s, d),
    )


def _records_as_items(s, d):
    """Single items per order with a reason on some, for the steps tested alone."""
    return prep.split_items(raw(s, d))


def _written_worklists(s, d):
    """A worklist with rows is written and read back; one without any leaves nothing."""
    rows = prep.worklist(raw(s, d), b.checked_unsure(s, d), prep.KEYS, F.col("reason") == "Unsure")
    path = files.scratch_folder(s, "worklist")
    parts = []
    for name, todo in (("unsure", rows), ("checked again", rows.where(F.col("reason") != "Unsure"))):
        target = f"{path}/{name.replace(' ', '-')}"
        written = files.write_if_any(todo, target, "parquet")
        found = s.read.parquet(target) if written else todo.limit(0)
        count = found.agg(F.count(F.lit(1)).alias("n"))
        parts.append(count.select(F.lit(name).alias("list"), "n", F.lit(int(written)).cast("long").alias("written")))
    return parts[0].unionByName(parts[1])


def _teed(s, d):
    """What a sink hands back, stacked with what it wrote."""
    path = files.scratch_folder(s, "tee")
    kept = files.write_table(raw(s, d), path)
    return kept.unionByName(s.read.parquet(path)).groupBy(*prep.RECORD).agg(F.count(F.lit(1)).alias("n"))


def _written_sources(s, d, path):
    """The working tables as text files with headers."""
    sources = {
        "records": b.records(s, d), "labels": b.labels(s, d), "corrections": b.corrections(s, d),
        "categories": b.categories(s, d), "people": b.people(s, d),
        "timestamps": b.timestamps(s, d).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")),
    }
    for name, df in sources.items():
        files.write_table(df, f"{path}/{name}", "csv")


# The orders' keys are numbers where the field files have names of images.
LAYOUTS = {
    "records": T.StructType([T.StructField("frame", T.LongType()) if f.name == "frame" else f for f in files.RECORDS.fields]),
    "labels": files.schema(new_item="string", item="string"),
    "corrections": files.schema(new_reason="string", new_item="string", frame="long", subject="long"),
    "categories": files.CATEGORIES,
    "people": files.schema(wearer="long", subject="long", site="string", age="long", sex="string"),
    "timestamps": files.schema(ts="string", frame="long", subject="long"),
}


def _read_sources(s, path):
    out = {name: files.read_annotations(s, f"{path}/{name}", layout) for name, layout in LAYOUTS.items()}
    out["timestamps"] = out["timestamps"].withColumn("ts", F.to_timestamp_ntz("ts", F.lit("yyyy-MM-dd HH:mm:ss")))
    return out


def _fact_from_files(s, d):
    """The clean fact from text files, bound by name in another order than they were written."""
    path = files.scratch_folder(s, "sources")
    _written_sources(s, d, path)
    t = _read_sources(s, path)
    return prep.prepare(
        t["records"], overlays(s, d), t["labels"], t["corrections"], PATTERN, RULES,
        t["categories"], t["people"], t["timestamps"], dropped(s, d), tasks=b.line_tasks(s, d),
    )


def _resumed_fact(s, d):
    """The clean fact of a second run, which finds its first two stages stored."""
    store, tasks = StageStore(s, files.scratch_folder(s, "stages")), b.line_tasks(s, d)

    def run():
        folded = store.stage("overlaid", lambda: overlaid(s, d), params=SEED)
        named = store.stage(
            "named", lambda df: prep.regularise_labels(prep.split_items(df, tasks=tasks), b.labels(s, d), tasks=tasks), [folded], SEED
        )
        return folded, named

    run()
    folded, named = run()
    if folded.computed or named.computed:
        raise AssertionError("a stored stage was computed again")
    rows = prep.apply_corrections(named.table, b.corrections(s, d), tasks=tasks)
    rows = prep.relabel_by_frame(rows, b.records(s, d), PATTERN, RULES)
    rows = prep.resolve_reasons(prep.assign_category(rows, b.categories(s, d), tasks=tasks))
    return prep.clean_fact(rows, b.people(s, d), b.timestamps(s, d), dropped(s, d), tasks)


FACT_SQL = """SELECT DISTINCT site, b.subject, age, sex, wearer, b.frame, reason,
  CASE WHEN reason IS NULL THEN category END AS category, CASE WHEN reason IS NULL THEN item END AS item,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts
FROM s_resolved b LEFT JOIN people p ON b.subject = p.subject
LEFT JOIN (SELECT o_custkey AS subject, o_orderkey AS frame, o_orderdate AS ts FROM orders) t
  ON b.subject = t.subject AND b.frame = t.frame
WHERE b.subject NOT IN (SELECT subject FROM dropped)"""

RECORD_SQL = "SELECT subject, frame, item, reason FROM "

QUERIES = {
    "flags_to_reason": query(raw, with_ctes(RECORDS, RAW) + RECORD_SQL + "raw"),
    "flags_to_reason_strict": query(
        lambda s, d: prep.flags_to_reason(
            prep.text_flag(b.records(s, d), "item", prep.EXPERIMENTER_TEXT, "experimenter"),
            prep.REASON_FLAGS,
            strict=True,
        ),
        with_ctes(RECORDS, RAW) + """SELECT subject, frame, item, reason FROM raw r WHERE reason IS NOT NULL
  OR NOT EXISTS (SELECT 1 FROM raw q WHERE q.subject = r.subject AND q.frame = r.frame AND q.reason IS NOT NULL)""",
    ),
    "overlay_each_flag": query(
        unsure_overlay, ALL_STEPS + "SELECT subject, frame, new_item, new_reason FROM o_unsure"
    ),
    "overlay_first_flag": query(
        none_overlay, ALL_STEPS + "SELECT subject, frame, new_item, new_reason FROM o_none"
    ),
    "overlay_left": query(
        lambda s, d: prep.apply_overlay(raw(s, d), b.immovable(s, d)),
        with_ctes(RECORDS, RAW, OVERLAYS, overlay_sql("step", "raw", "o_immovable")) + RECORD_SQL + "step",
    ),
    "overlay_full": query(
        lambda s, d: prep.apply_overlay(raw(s, d), none_overlay(s, d), how="full"),
        with_ctes(RECORDS, RAW, OVERLAYS, overlay_sql("step", "raw", "o_none", "FULL")) + RECORD_SQL + "step",
    ),
    "overlay_chain": query(overlaid, ALL_STEPS + RECORD_SQL + "s_none"),
    "worklist": query(
        lambda s, d: prep.worklist(
            raw(s, d), b.checked_unsure(s, d), prep.KEYS, F.col("reason") == "Unsure"
        ),
        with_ctes(RECORDS, RAW, OVERLAYS) + RECORD_SQL + """raw WHERE reason = 'Unsure'
  AND (subject, frame) NOT IN (SELECT (subject, frame) FROM checked_unsure)""",
    ),
    "worklist_labels": query(
        lambda s, d: prep.worklist(
            _records_as_items(s, d).select("item").distinct(), b.labels(s, d), ["item"], F.lit(True)
        ),
        with_ctes(RECORDS, RAW, DICTIONARIES, split_sql("items", "raw")) + """
SELECT DISTINCT item FROM items i WHERE NOT EXISTS (
  SELECT 1 FROM labels_dict d WHERE d.item IS NOT DISTINCT FROM i.item)""",
    ),
    "worklist_no_items": query(
        lambda s, d: prep.worklist(overlaid(s, d), b.no_items(s, d), prep.KEYS, F.col("reason") == "None"),
        ALL_STEPS + RECORD_SQL + """s_none WHERE reason = 'None'
  AND (subject, frame) NOT IN (SELECT (subject, CASE WHEN frame % 2 = 0 THEN -frame ELSE frame END) FROM base_orders WHERE frame % 47 = 0)""",
    ),
    "worklist_categories": query(
        lambda s, d: prep.worklist(
            prep.regularise_labels(_records_as_items(s, d), b.labels(s, d), tasks=b.line_tasks(s, d)).where("reason is null").select("item").distinct(),
            b.categories(s, d), ["item"], F.lit(True),
        ),
        with_ctes(RECORDS, RAW, DICTIONARIES, split_sql("items", "raw"), labels_sql("named", "items")) + """
SELECT DISTINCT item FROM named n WHERE reason IS NULL AND NOT EXISTS (
  SELECT 1 FROM categories_dict d WHERE d.item IS NOT DISTINCT FROM n.item)""",
    ),
    "worklist_written": query(
        _written_worklists,
        ALL_STEPS + """SELECT 'unsure' AS list, count(*) AS n, CAST(1 AS BIGINT) AS written FROM raw WHERE reason = 'Unsure'
  AND (subject, frame) NOT IN (SELECT (subject, frame) FROM checked_unsure)
UNION ALL SELECT 'checked again', 0, 0""",
    ),
    "tee_sink": query(
        _teed,
        with_ctes(RECORDS, RAW) + """SELECT subject, frame, item, reason, count(*) AS n FROM (
  SELECT subject, frame, item, reason FROM raw UNION ALL SELECT subject, frame, item, reason FROM raw) GROUP BY ALL""",
    ),
    "clean_fact_from_files": query(_fact_from_files, ALL_STEPS + FACT_SQL),
    "clean_fact_resumed": query(_resumed_fact, ALL_STEPS + FACT_SQL),
    "explode_list": query(
        _records_as_items,
        with_ctes(RECORDS, RAW, split_sql("items", "raw")) + RECORD_SQL + "items",
    ),
    "regularise_labels": query(
        lambda s, d: prep.regularise_labels(_records_as_items(s, d), b.labels(s, d), tasks=b.line_tasks(s, d)),
        with_ctes(RECORDS, RAW, DICTIONARIES, split_sql("items", "raw"), labels_sql("named", "items"))
        + RECORD_SQL + "named",
    ),
    "apply_corrections": query(
        lambda s, d: prep.apply_corrections(_records_as_items(s, d), b.corrections(s, d), tasks=b.line_tasks(s, d)),
        with_ctes(
            RECORDS, RAW, OVERLAYS, split_sql("items", "raw"),
            overlay_sql("corrected", "items", "o_corrections"), split_sql("step", "corrected"),
        )
        + RECORD_SQL + "step",
    ),
    "relabel_by_frame": query(
        lambda s, d: prep.relabel_by_frame(_records_as_items(s, d), b.records(s, d), PATTERN, RULES, tasks=b.line_tasks(s, d)),
        with_ctes(RECORDS, RAW, split_sql("items", "raw"), relabel_sql("step", "items"))
        + RECORD_SQL + "step",
    ),
    "relabel_by_frame_matching": query(
        lambda s, d: prep.relabel_by_frame(
            _records_as_items(s, d), b.records(s, d), PATTERN, RULES, only_matching=True, tasks=b.line_tasks(s, d)
        ),
        with_ctes(RECORDS, RAW, split_sql("items", "raw"), relabel_sql("step", "items")) + """
SELECT i.subject, i.frame, CASE WHEN i.item LIKE '%ring%' THEN s.item ELSE i.item END AS item, i.reason
FROM items i JOIN (SELECT DISTINCT subject, frame, item FROM step WHERE item IN ('ring-M', 'ring-W')) s
  ON i.subject = s.subject AND i.frame = s.frame
UNION ALL SELECT * FROM items i WHERE (subject, frame) NOT IN (
  SELECT (subject, frame) FROM step WHERE item IN ('ring-M', 'ring-W'))""",
    ),
    "audit_exclusive": query(
        lambda s, d: prep.audit_exclusive(b.records(s, d), PATTERN, "tool_meal", "tool_work"),
        with_ctes(RECORDS)
        + "SELECT count(*) AS n_conflicts FROM records WHERE item LIKE '%ring%' AND tool_meal AND tool_work",
    ),
    "assign_category": query(
        lambda s, d: prep.assign_category(_records_as_items(s, d), b.categories(s, d), tasks=b.line_tasks(s, d)),
        with_ctes(RECORDS, RAW, DICTIONARIES, split_sql("items", "raw"), category_sql("step", "items"))
        + "SELECT subject, frame, reason, category, item FROM step",
    ),
    "resolve_reasons": query(
        lambda s, d: prep.resolve_reasons(_records_as_items(s, d)),
        with_ctes(RECORDS, RAW, split_sql("items", "raw"), resolve_sql("step", "items"))
        + RECORD_SQL + "step",
    ),
    "pick_one": query(
        lambda s, d: prep.pick_one(b.pairs(s, d), "person", "subject", SEED),
        with_ctes(PICKED) + "SELECT person, subject FROM picked",
    ),
    "clean_fact": query(fact, ALL_STEPS + FACT_SQL),
}
