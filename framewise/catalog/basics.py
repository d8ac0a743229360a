"""Registered single-operator queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewise.catalog.common import EV_DAY, EV_HOUR, OBS_ORDERS, query, with_ctes
from framewise.domain import ordinal
from framewise.functions import nulls, text
from framewise.operators import counts, joins, ordered, reshape
from framewise.plans.prep import analysis_view
from framewise.sources import files
from framewise.sources.bindings import (
    EVENTS_DOMAIN,
    ORDERS_DOMAIN,
    events_fact,
    obs_events,
    obs_orders,
    table,
)

ORDERS_SCHEMA = files.schema(
    o_orderkey="long", o_custkey="long", o_totalprice="double", priority="string"
)


def _csv_roundtrip(s, d):
    rows = table(s, d, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice",
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
    )
    path = files.scratch_folder(s, "csv")
    files.write_table(rows, path, "csv")
    return files.read_annotations(s, path, ORDERS_SCHEMA)


def _parquet_roundtrip(s, d):
    path = files.scratch_folder(s, "fact")
    files.write_table(events_fact(s, d, "day"), path, by=["site"])
    return s.read.parquet(path).where(F.col("site") == "A").select(
        "site", "subject", "age", "frame", "reason", "item"
    )


def _orders_null(s, d):
    """Orders whose customer key is missing for every seventh customer."""
    key = F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey"))
    return table(s, d, "orders").select("o_orderkey", key.alias("key"))


def _customers_null(s, d):
    """Customers of one segment, without every seventh."""
    key = F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey"))
    rows = table(s, d, "customer").where(F.col("c_mktsegment") == "BUILDING")
    return rows.select(key.alias("key")).where(F.col("key").isNotNull())


def _segments(s, d):
    segment = F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))
    return table(s, d, "customer").select(segment.alias("segment"), "c_custkey", "c_acctbal")


NULL_SQL = """ord AS (SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS key FROM orders),
cust AS (SELECT c_custkey AS key FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 7 <> 0),
seg AS (SELECT CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment, c_custkey, c_acctbal FROM customer)"""


def _segment_names(s, d):
    """A dictionary that also names the missing segment."""
    return (
        _segments(s, d)
        .select("segment")
        .distinct()
        .where("segment is null or segment <> 'FURNITURE'")
        .withColumn("name", F.coalesce(F.lower("segment"), F.lit("none")))
    )


DICT_SQL = """dict AS (SELECT DISTINCT segment, coalesce(lower(segment), 'none') AS name FROM seg
  WHERE segment IS NULL OR segment <> 'FURNITURE')"""


def _full_null(s, d):
    """Counts by segment on both sides of a full join; a renamed key leaves gaps on either side."""
    left = _segments(s, d).replace("MACHINERY", "MACHINES", "segment")
    left = left.groupBy("segment").agg(F.count(F.lit(1)).alias("n_left"))
    right = _segments(s, d).replace("BUILDING", "BUILDINGS", "segment")
    right = right.groupBy("segment").agg(F.count(F.lit(1)).alias("n_right"))
    return joins.null_safe_join(left, right, ["segment"], "full").select(
        "segment", F.col("n_left").cast("double"), F.col("n_right").cast("double")
    )


def _flag_rows(s, d):
    docs = table(s, d, "documents").select("doc_id", "source")
    return table(s, d, "labels").join(docs, "doc_id")


def _strings(s, d):
    """Text functions over every part name."""
    name = F.concat(F.col("p_name"), F.lit("-M"), F.col("p_type"), F.lit("-W-M"))
    listed = F.concat(F.col("p_name"), F.lit(", "), F.col("p_brand"), F.lit(" ,"), F.col("p_type"))
    p = F.col("p_size") / F.lit(10000.0)
    return table(s, d, "part").select(
        "p_partkey",
        F.lower("p_type").alias("lowered"),
        F.col("p_name").rlike("ring").cast("long").alias("has_ring"),
        text.strip_first(name, ("-M", "-W")).alias("stripped"),
        text.sentence_case(F.col("p_type")).alias("sentence"),
        text.list_length(listed).cast("long").alias("n_listed"),
        F.array_join(text.split_capped(listed, 2), "|").alias("first_two"),
        text.p_text(p).alias("p_text"),
        ordinal(F.substring_index("p_name", " ", 1), ORDERS_DOMAIN.categories[:6]).cast("double").alias("position"),
        ORDERS_DOMAIN.label(F.substring_index("p_name", " ", 1), short=True).alias("short"),
    )


def _numbers(s, d):
    """Numeric and conditional helpers over every event."""
    value = F.when(F.col("event_id") % 11 != 0, F.col("value"))
    return table(s, d, "events").select(
        "event_id",
        nulls.if_known(value > 20, F.lit("high"), F.lit("low")).alias("level"),
        F.when(value < 5, "a").when(value < 50, "b").alias("band"),
        nulls.half_even((F.col("event_id") % 100) / F.lit(8.0), 2).alias("even"),
        nulls.share(F.col("event_id") % 7, F.col("event_id") % 5).alias("ratio"),
        F.ln(F.col("value") + 1).alias("logged"),
        F.hour("ts").cast("long").alias("hour"),
        F.coalesce(value, F.lit(-1.0)).alias("filled"),
    )


def _null_aggregates(s, d):
    value = F.when(F.col("event_id") % 3 == 0, F.col("value"))
    typed = F.when(F.col("event_type") != "view", F.col("event_type"))
    rows = table(s, d, "events").select("user_id", value.alias("v"), typed.alias("t"))
    return rows.groupBy("user_id").agg(
        nulls.sum_or_zero(F.col("v")).alias("total"),
        nulls.count_values(F.col("t")).alias("n_values"),
        F.count_distinct("t").alias("n_known"),
        F.avg("v").alias("mean"),
    )


def _complete(s, d):
    view = obs_events(s, d, "day")
    counts = view.groupBy("site", "subject", "item").agg(F.count(F.lit(1)).alias("n"))
    return reshape.complete(counts, ["site"], "subject", "item", {"n": 0})


def _pivot(s, d):
    rows = obs_orders(s, d).groupBy("category", "site").agg(F.count_distinct("subject").alias("n"))
    rows = rows.withColumn("site", F.expr("nullif(site, if(category = 'hot', 'ASIA', ''))"))
    wide = reshape.widen(rows, ["category"], "site", ["ASIA", "EUROPE"], F.first("n"))
    return reshape.map_columns(wide, ["ASIA", "EUROPE"], lambda c: c.cast("double"))


def _quantiles(s, d):
    return ordered.quantiles(
        table(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice",
        {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95},
    )


def _neighbours(s, d):
    """Previous and next order of each customer."""
    rows = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    steps = ordered.neighbours(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_totalprice"])
    return steps.select("o_custkey", "o_orderkey", "prev_o_totalprice", "next_o_totalprice")


def _running(s, d):
    days = table(s, d, "orders").groupBy(
        "o_orderpriority", F.datediff("o_orderdate", F.lit("1990-01-01")).alias("day")
    ).agg(F.count(F.lit(1)).alias("n"))
    return ordered.running_total(days, ["o_orderpriority"], "day", "n")


ITEM_LEVELS = {"hour": ["site", "subject", "age", "hour"], "subject": ["site", "subject", "age"], "site": ["site"]}


def _approx_items(s, d):
    """Distinct frames per site: the exact count beside whether the merged sketches are near it."""
    view = obs_events(s, d, "hour").withColumn("seen", F.xxhash64("subject", "frame", "item"))
    state = counts.sketches(view, ["site", "subject"], distinct=["seen"])
    path = files.scratch_folder(s, "sketches")
    files.write_table(state, path)
    rough = counts.merged(s.read.parquet(path).drop("subject"), ["site"])
    rough = rough.select("site", counts.approx_distinct("seen").alias("guess"))
    exact = counts.distinct_levels(view, {"site": ["site"]}, "seen").drop("level")
    near = F.abs(F.col("guess") - F.col("n")) <= 4 * counts.HLL_ERROR * F.col("n")
    return joins.null_safe_join(exact, rough, ["site"], "inner").select("site", "n", near.cast("long").alias("near"))


def _approx_quantiles(s, d):
    """Whether the rank of each approximate quantile, from merged sketches, is near the asked one."""
    rows = table(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    state = counts.sketches(rows, ["l_returnflag", "l_linestatus"], quantiles=["l_extendedprice"])
    rough = counts.merged(state.drop("l_linestatus"), ["l_returnflag"])
    asked = {"q05": 0.05, "median": 0.5, "q95": 0.95}
    rough = rough.select("l_returnflag", *[counts.approx_quantile("l_extendedprice", p).alias(f"{q}_at") for q, p in asked.items()])
    below = [F.avg((F.col("l_extendedprice") <= F.col(f"{q}_at")).cast("double")).alias(q) for q in asked]
    ranks = joins.null_safe_join(rows, rough, ["l_returnflag"], "inner").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), *below)
    near = [(F.abs(F.col(q) - p) <= 2 * counts.KLL_ERROR).cast("long").alias(q) for q, p in asked.items()]
    return ranks.select("l_returnflag", "n", *near)


QUERIES = {
    "distinct_items_levels": query(
        lambda s, d: counts.distinct_levels(obs_events(s, d, "hour"), ITEM_LEVELS, "item"),
        with_ctes(EV_HOUR) + """SELECT 'hour' AS level, site, subject, age, hour, count(DISTINCT item) AS n FROM obs GROUP BY ALL
UNION ALL SELECT 'subject', site, subject, age, NULL, count(DISTINCT item) FROM obs GROUP BY ALL
UNION ALL SELECT 'site', site, NULL, NULL, NULL, count(DISTINCT item) FROM obs GROUP BY ALL""",
    ),
    "distinct_subjects_levels": query(
        lambda s, d: counts.distinct_levels(
            obs_orders(s, d), {"item": ["site", "item"], "site": ["site"], "all": []}, "subject"
        ),
        with_ctes(OBS_ORDERS) + """SELECT 'item' AS level, site, item, count(DISTINCT subject) AS n FROM obs GROUP BY ALL
UNION ALL SELECT 'site', site, NULL, count(DISTINCT subject) FROM obs GROUP BY ALL
UNION ALL SELECT 'all', NULL, NULL, count(DISTINCT subject) FROM obs""",
    ),
    "approx_distinct": query(
        _approx_items,
        with_ctes(EV_HOUR) + "SELECT site, count(DISTINCT (subject, frame, item)) AS n, CAST(1 AS BIGINT) AS near FROM obs GROUP BY site",
    ),
    "approx_quantiles": query(
        _approx_quantiles,
        """SELECT l_returnflag, count(*) AS n, CAST(1 AS BIGINT) AS q05, CAST(1 AS BIGINT) AS median, CAST(1 AS BIGINT) AS q95
FROM lineitem GROUP BY l_returnflag""",
    ),
    "csv_roundtrip": query(
        _csv_roundtrip,
        "SELECT o_orderkey, o_custkey, o_totalprice, nullif(o_orderpriority, '5-LOW') AS priority FROM orders",
    ),
    "parquet_roundtrip": query(
        _parquet_roundtrip,
        with_ctes(EV_DAY) + """SELECT site, subject, age, strftime(frame, '%Y-%m-%d %H:%M:%S') AS frame, reason, item
FROM fact WHERE site = 'A'""",
    ),
    "analysis_view": query(
        lambda s, d: analysis_view(events_fact(s, d, "hour"), EVENTS_DOMAIN.excluded_items)
        .withColumn("category_position", ordinal(F.col("category"), EVENTS_DOMAIN.categories))
        .drop("ts", "reason"),
        with_ctes(EV_HOUR) + """SELECT site, subject, age, CAST(wearer AS BIGINT) AS wearer, strftime(frame, '%Y-%m-%d %H:%M:%S') AS frame,
  category, item, hour, CAST(list_position(['view', 'click', 'purchase', 'signup', 'error'], category) AS BIGINT) AS category_position
FROM obs WHERE item NOT IN ('view-0', 'error-3')""",
    ),
    "semi_join": query(
        lambda s, d: joins.members(_orders_null(s, d), _customers_null(s, d), ["key"]).select("o_orderkey", "key"),
        with_ctes(NULL_SQL) + "SELECT o_orderkey, key FROM ord WHERE key IN (SELECT key FROM cust)",
    ),
    "anti_join_null": query(
        lambda s, d: joins.non_members(_orders_null(s, d), _customers_null(s, d), ["key"]).select(
            "o_orderkey", F.col("key").cast("double").alias("key")
        ),
        with_ctes(NULL_SQL) + """SELECT o_orderkey, CAST(key AS DOUBLE) AS key FROM ord
WHERE key IS NULL OR key NOT IN (SELECT key FROM cust)""",
    ),
    "outside_list": query(
        lambda s, d: _segments(s, d)
        .where(joins.outside(F.col("segment"), ("BUILDING", "MACHINERY")))
        .select("c_custkey", "segment"),
        with_ctes(NULL_SQL) + """SELECT c_custkey, segment FROM seg
WHERE segment IS NULL OR segment NOT IN ('BUILDING', 'MACHINERY')""",
    ),
    "dictionary_join_null": query(
        lambda s, d: joins.null_safe_join(_segments(s, d), _segment_names(s, d), ["segment"], "left").select(
            "c_custkey", "segment", "name"
        ),
        with_ctes(NULL_SQL, DICT_SQL) + """SELECT c_custkey, seg.segment, name FROM seg
LEFT JOIN dict ON seg.segment IS NOT DISTINCT FROM dict.segment""",
    ),
    "full_join_nullsafe": query(
        _full_null,
        with_ctes(NULL_SQL) + """SELECT coalesce(l.segment, r.segment) AS segment, CAST(n_left AS DOUBLE) AS n_left, CAST(n_right AS DOUBLE) AS n_right
FROM (SELECT replace(segment, 'MACHINERY', 'MACHINES') AS segment, count(*) AS n_left FROM seg GROUP BY 1) l
FULL JOIN (SELECT replace(segment, 'BUILDING', 'BUILDINGS') AS segment, count(*) AS n_right FROM seg GROUP BY 1) r
ON l.segment IS NOT DISTINCT FROM r.segment""",
    ),
    "natural_full_join": query(
        lambda s, d: joins.natural_full_join(
            table(s, d, "nation").select((F.col("n_nationkey") + 4).cast("long").alias("n_nationkey"), "n_name"),
            table(s, d, "customer")
            .groupBy(F.col("c_nationkey").cast("long").alias("n_nationkey"))
            .agg(F.avg("c_acctbal").alias("balance")),
        ),
        """SELECT CAST(coalesce(n.n_nationkey, c.k) AS BIGINT) AS n_nationkey, n_name, round(balance, 6) AS balance
FROM (SELECT n_nationkey + 4 AS n_nationkey, n_name FROM nation) n
FULL JOIN (SELECT c_nationkey AS k, avg(c_acctbal) AS balance FROM customer GROUP BY 1) c ON n_nationkey = k""",
        6,
    ),
    "unpivot": query(
        lambda s, d: reshape.melt(
            _flag_rows(s, d), ["doc_id", "source"],
            reshape.column_range(table(s, d, "labels"), "quality", "toxic"), "flag", "value",
        ),
        """SELECT doc_id, source, 'quality' AS flag, CAST(quality AS BIGINT) AS value FROM labels JOIN documents USING (doc_id)
UNION ALL SELECT doc_id, source, 'toxic', CAST(toxic AS BIGINT) FROM labels JOIN documents USING (doc_id)""",
    ),
    "pivot": query(
        _pivot,
        with_ctes(OBS_ORDERS) + """SELECT category, CASE WHEN category <> 'hot' THEN CAST(count(DISTINCT subject) FILTER (site = 'ASIA') AS DOUBLE) END AS "ASIA",
  CAST(count(DISTINCT subject) FILTER (site = 'EUROPE') AS DOUBLE) AS "EUROPE" FROM obs GROUP BY category""",
    ),
    "one_hot": query(
        lambda s, d: reshape.one_hot(
            _segments(s, d).select("c_custkey", "segment"), "segment",
            {"BUILDING": "is_building", "MACHINERY": "is_machinery"},
        ).withColumns({c: F.col(c).cast("double") for c in ("is_building", "is_machinery")}),
        with_ctes(NULL_SQL) + """SELECT c_custkey, segment, CAST(segment = 'BUILDING' AS DOUBLE) AS is_building,
  CAST(segment = 'MACHINERY' AS DOUBLE) AS is_machinery FROM seg""",
    ),
    "complete": query(
        _complete,
        with_ctes(EV_DAY) + """SELECT s.site, s.subject, i.item, count(o.item) AS n
FROM (SELECT DISTINCT site, subject FROM obs) s JOIN (SELECT DISTINCT site, item FROM obs) i ON s.site = i.site
LEFT JOIN obs o ON o.site = s.site AND o.subject = s.subject AND o.item = i.item GROUP BY ALL""",
    ),
    "counts_over_levels": query(
        lambda s, d: reshape.counts_over_levels(
            obs_events(s, d, "day"), ["subject"], "frame", "item", ("view-0", "click-1", "absent")
        ),
        with_ctes(EV_DAY) + """SELECT s.subject, n_frames, l.item, count(o.item) AS n
FROM (SELECT subject, count(DISTINCT frame) AS n_frames FROM obs GROUP BY subject) s
CROSS JOIN (SELECT unnest(['view-0', 'click-1', 'absent']) AS item) l
LEFT JOIN obs o ON o.subject = s.subject AND o.item = l.item GROUP BY ALL""",
    ),
    "string_funcs": query(
        _strings,
        """SELECT p_partkey, lower(p_type) AS lowered, CAST(contains(p_name, 'ring') AS BIGINT) AS has_ring,
  p_name || p_type || '-W-M' AS stripped, upper(p_type[1:1]) || lower(p_type[2:]) AS sentence,
  CAST(len(string_split(p_name || ', ' || p_brand || ' ,' || p_type, ',')) AS BIGINT) AS n_listed,
  p_name || '|' || p_brand AS first_two,
  CASE WHEN p_size / 10000 < 0.001 THEN '< 0.001' ELSE '= ' || CAST(round(p_size / 10000, 3) AS VARCHAR) END AS p_text,
  CAST(nullif(coalesce(list_position(['blue', 'cold', 'hot', 'large', 'new', 'old'], split_part(p_name, ' ', 1)), 0), 0) AS DOUBLE) AS position,
  upper(p_name[1:1]) AS short FROM part""",
    ),
    "numeric_funcs": query(
        _numbers,
        """SELECT event_id, CASE WHEN v > 20 THEN 'high' WHEN v <= 20 THEN 'low' END AS level,
  CASE WHEN v < 5 THEN 'a' WHEN v < 50 THEN 'b' END AS band, round_even((event_id % 100) / 8.0, 2) AS even,
  round(CASE WHEN event_id % 5 <> 0 THEN (event_id % 7) / CAST(event_id % 5 AS DOUBLE) END, 9) AS ratio,
  round(ln("value" + 1), 9) AS logged, CAST(hour(ts) AS BIGINT) AS hour, coalesce(v, -1.0) AS filled
FROM (SELECT *, CASE WHEN event_id % 11 <> 0 THEN "value" END AS v FROM events)""",
    ),
    "null_aggregates": query(
        _null_aggregates,
        """SELECT user_id, round(coalesce(sum(v), 0), 6) AS total, count(DISTINCT coalesce(t, '?')) AS n_values,
  count(DISTINCT t) AS n_known, round(avg(v), 6) AS mean FROM (
  SELECT user_id, CASE WHEN event_id % 3 = 0 THEN "value" END AS v, nullif(event_type, 'view') AS t FROM events)
GROUP BY user_id""",
        6,
    ),
    "quantiles": query(
        _quantiles,
        """SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.05), 6) AS q05,
  round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
  round(quantile_cont(l_extendedprice, 0.75), 6) AS q75, round(quantile_cont(l_extendedprice, 0.95), 6) AS q95
FROM lineitem GROUP BY l_returnflag""",
        6,
    ),
    "neighbours": query(
        _neighbours,
        """SELECT o_custkey, o_orderkey, lag(o_totalprice) OVER w AS prev_o_totalprice, lead(o_totalprice) OVER w AS next_o_totalprice
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    ),
    "running_total": query(
        _running,
        """SELECT o_orderpriority, day, n, CAST(coalesce(sum(n) OVER (
  PARTITION BY o_orderpriority ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
  CAST(sum(n) OVER (PARTITION BY o_orderpriority) AS BIGINT) AS total
FROM (SELECT o_orderpriority, date_diff('day', DATE '1990-01-01', o_orderdate) AS day, count(*) AS n FROM orders GROUP BY ALL)""",
    ),
    "intersect_items": query(
        lambda s, d: obs_orders(s, d).select("item", "age")
        .intersect(obs_orders(s, d).select("item", (F.col("age") + 7).cast("long").alias("age"))),
        with_ctes(OBS_ORDERS) + """SELECT item, CAST(age AS BIGINT) AS age FROM obs
INTERSECT SELECT item, age + 7 FROM obs""",
    ),
    "sorted_by_level": query(
        lambda s, d: ordered.rank_rows(
            obs_orders(s, d).groupBy("site", "category").agg(F.count_distinct("subject").alias("n")),
            ["site"],
            [ordinal(F.col("category"), ORDERS_DOMAIN.categories[::-1]).asc_nulls_last()],
        ),
        with_ctes(OBS_ORDERS) + """SELECT site, category, count(DISTINCT subject) AS n,
  row_number() OVER (PARTITION BY site ORDER BY category DESC) AS rank FROM obs GROUP BY site, category""",
    ),
}
