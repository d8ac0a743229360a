"""Registered ranking queries."""

from __future__ import annotations

from framewise.catalog.common import EV_DAY, OBS_ORDERS, query, with_ctes
from framewise.plans import rank
from framewise.sources.bindings import (
    EVENTS_DOMAIN,
    ORDERS_DOMAIN,
    events_fact,
    obs_events,
    line_tasks,
    obs_orders,
)

REACH = """reach AS (
  SELECT o.site, item, category, count(DISTINCT subject) AS n_subjects, any_value(n_all) AS n_all,
         count(DISTINCT subject) / CAST(any_value(n_all) AS DOUBLE) AS prop
  FROM obs o JOIN (SELECT site, count(DISTINCT subject) AS n_all FROM obs GROUP BY site) t
    ON o.site = t.site
  GROUP BY o.site, item, category),
reach_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY prop DESC, item) AS rank FROM reach)"""

# The zero-filled table is really built here: subjects x items of a site.
EXPOSURE = """subjects AS (SELECT site, subject, count(DISTINCT frame) AS n_frames FROM obs GROUP BY ALL),
items AS (SELECT DISTINCT site, item, category FROM obs),
seen AS (SELECT site, subject, item, count(DISTINCT frame) AS n, count(*) AS n_rows FROM obs GROUP BY ALL),
exposure AS (
  SELECT s.site, i.item, i.category, count(*) AS n_all,
         CAST(sum(CAST(coalesce(n, 0) / CAST(n_frames AS DOUBLE) AS DECIMAL(20, 12))) AS DOUBLE) / count(*) AS prop,
         CAST(sum(CAST(coalesce(n_rows, 0) / CAST(n_frames AS DOUBLE) AS DECIMAL(20, 12))) AS DOUBLE) / count(*) AS prop_rows
  FROM subjects s JOIN items i ON s.site = i.site
  LEFT JOIN seen ON seen.site = s.site AND seen.subject = s.subject AND seen.item = i.item
  GROUP BY s.site, i.item, i.category)"""

EXPOSURE_OUT = """SELECT site, item, category, n_all, round(prop, 9) AS prop,
  row_number() OVER (PARTITION BY site ORDER BY prop DESC, item) AS rank FROM exposure"""

# The exposure measure under the names of the reach measure.
BY_EXPOSURE = EXPOSURE + """,
reach AS (SELECT site, item, category, prop FROM exposure),
reach_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY prop DESC, item) AS rank FROM reach)"""

REACH_TOP = with_ctes(OBS_ORDERS, REACH)

NOT_STUDY = "item NOT IN ('blue ring', 'hot rod', 'old anvil')"

BOTH = """flags AS (
  SELECT *, CAST((item IN (SELECT item FROM reach_ranked WHERE site = 'ASIA' AND rank <= {n})
       AND item IN (SELECT item FROM reach_ranked WHERE site = 'EUROPE' AND rank <= {n})) AS BIGINT) AS in_both
  FROM reach_ranked),
picked AS (
  SELECT site, item, category, in_both, prop,
         row_number() OVER (PARTITION BY site ORDER BY prop DESC, item) AS rank
  FROM flags WHERE """ + NOT_STUDY + """ AND site IN ('ASIA', 'EUROPE') {extra})"""

STRIPPED = "regexp_replace(item, 'small |-M', '')"
SENTENCE = f"upper({STRIPPED}[1:1]) || lower({STRIPPED}[2:])"


def _labels(names: str) -> str:
    pairs = zip(ORDERS_DOMAIN.categories, names)
    return "CASE category " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in pairs) + " END"


def _panel_sql(n: int, label: str, extra: str = "", measure: str = REACH) -> str:
    return with_ctes(OBS_ORDERS, measure, BOTH.format(n=n, extra=extra)) + (
        "SELECT site, item, category, rank, in_both, round(prop, 9) AS prop, "
        f"round(prop * 100, 9) AS y, {label} AS label FROM picked WHERE rank <= {n}"
    )


def _table_sql(n: int, extra: str, measure: str = REACH) -> str:
    return with_ctes(OBS_ORDERS, measure) + f"""
SELECT {STRIPPED} AS item, category, rank, round_even(prop * 100, 1) AS pct FROM (
  SELECT *, row_number() OVER (ORDER BY prop DESC, item, site) AS rank
  FROM reach WHERE {NOT_STUDY} {extra}) WHERE rank <= {n}"""


def _distribution_sql(log: bool) -> str:
    measure = "ln(n / CAST(total AS DOUBLE) * 100)" if log else "n / CAST(total AS DOUBLE) * 100"
    return f"""shares AS (
  SELECT site, subject, age, item, category, n, total, {measure} AS prop FROM (
    SELECT *, CAST(sum(n) OVER (PARTITION BY site, subject, age) AS BIGINT) AS total FROM (
      SELECT site, subject, age, item, category, count(*) AS n FROM obs
      WHERE {NOT_STUDY} GROUP BY ALL)))"""


DIST_OUT = """SELECT site, subject, age, item, category, n, total, round(prop, 9) AS prop,
  row_number() OVER (PARTITION BY site, subject, age ORDER BY n DESC, item) AS rank FROM shares"""


def _top3_sql(scored: str) -> str:
    return f"""best AS (
  SELECT site, category, item, row_number() OVER (
    PARTITION BY site, category ORDER BY score DESC, item) AS rank
  FROM ({scored}) WHERE site IN ('ASIA', 'EUROPE')),
tops AS (
  SELECT category,
    string_agg(CASE WHEN site = 'ASIA' THEN regexp_replace(item, '-M', '') END, ', ' ORDER BY rank) AS "ASIA",
    string_agg(CASE WHEN site = 'EUROPE' THEN regexp_replace(item, '-M', '') END, ', ' ORDER BY rank) AS "EUROPE"
  FROM best WHERE rank <= 3 GROUP BY category)"""


KEPT = f"kept AS (SELECT * FROM obs WHERE {NOT_STUDY})"
BY_REACH = "SELECT site, category, item, count(DISTINCT subject) AS score FROM kept GROUP BY ALL"
KEPT_EXPOSURE = EXPOSURE.replace("FROM obs", "FROM kept")


QUERIES = {
    "item_reach": query(
        lambda s, d: rank.item_reach(obs_orders(s, d)),
        REACH_TOP + "SELECT site, item, category, n_subjects, n_all, round(prop, 9) AS prop, rank FROM reach_ranked",
    ),
    "item_exposure": query(
        lambda s, d: rank.item_exposure(obs_orders(s, d)),
        with_ctes(OBS_ORDERS, EXPOSURE) + EXPOSURE_OUT,
    ),
    "item_exposure_events": query(
        lambda s, d: rank.item_exposure(obs_events(s, d, "day")),
        with_ctes(EV_DAY, EXPOSURE) + EXPOSURE_OUT,
    ),
    "item_distribution": query(
        lambda s, d: rank.item_distribution(obs_orders(s, d), ORDERS_DOMAIN.excluded_items, tasks=line_tasks(s, d)),
        with_ctes(OBS_ORDERS, _distribution_sql(False)) + DIST_OUT,
    ),
    "item_distribution_log": query(
        lambda s, d: rank.item_distribution(
            obs_orders(s, d), ORDERS_DOMAIN.excluded_items, log=True, tasks=line_tasks(s, d)
        ),
        with_ctes(OBS_ORDERS, _distribution_sql(True)) + DIST_OUT,
    ),
    "item_distribution_panel": query(
        lambda s, d: rank.distribution_panel(
            rank.item_distribution(obs_orders(s, d), ORDERS_DOMAIN.excluded_items, tasks=line_tasks(s, d)), 3, (5, 12)
        ),
        with_ctes(OBS_ORDERS, _distribution_sql(False))
        + f"SELECT * FROM ({DIST_OUT}) WHERE rank <= 3 AND age BETWEEN 5 AND 12",
    ),
    "item_distribution_panel_category": query(
        lambda s, d: rank.distribution_panel(
            rank.item_distribution(obs_orders(s, d), ORDERS_DOMAIN.excluded_items, tasks=line_tasks(s, d)), 2, (5, 12), "new"
        ),
        with_ctes(OBS_ORDERS, _distribution_sql(False))
        + """SELECT * FROM (SELECT site, subject, age, item, category, n, total, round(prop, 9) AS prop,
  row_number() OVER (PARTITION BY site, subject, age ORDER BY prop DESC, item) AS rank
  FROM shares WHERE category = 'new' AND age >= 5 AND age <= 12) WHERE rank <= 2""",
    ),
    "min_points_filter": query(
        lambda s, d: rank.distribution_panel(
            rank.item_distribution(obs_orders(s, d), ORDERS_DOMAIN.excluded_items, tasks=line_tasks(s, d)),
            5, (0, 24), "new", min_points=3,
        ),
        with_ctes(OBS_ORDERS, _distribution_sql(False))
        + """, panel AS (SELECT * FROM (
  SELECT site, subject, age, item, category, n, total, round(prop, 9) AS prop,
    row_number() OVER (PARTITION BY site, subject, age ORDER BY prop DESC, item) AS rank
  FROM shares WHERE category = 'new' AND age BETWEEN 0 AND 24) WHERE rank <= 5)
SELECT * FROM panel WHERE subject IN (
  SELECT subject FROM panel GROUP BY subject HAVING count(DISTINCT rank) > 2)""",
    ),
    "top_items": query(
        lambda s, d: rank.top_items(rank.item_reach(obs_orders(s, d)), 25, ORDERS_DOMAIN, ORDERS_DOMAIN.sites),
        _panel_sql(25, f"{SENTENCE} || ' (' || {_labels(ORDERS_DOMAIN.labels)} || ')'"),
    ),
    "top_items_short_labels": query(
        lambda s, d: rank.top_items(rank.item_reach(obs_orders(s, d)), 40, ORDERS_DOMAIN, ORDERS_DOMAIN.sites, short=True),
        _panel_sql(40, f"{SENTENCE} || ' (' || {_labels(ORDERS_DOMAIN.short_labels)} || ')'"),
    ),
    "top_items_category": query(
        lambda s, d: rank.top_items(
            rank.item_reach(obs_orders(s, d)), 5, ORDERS_DOMAIN, ORDERS_DOMAIN.sites, "small"
        ),
        _panel_sql(5, SENTENCE, "AND category = 'small'"),
    ),
    "top_items_table": query(
        lambda s, d: rank.top_items_table(rank.item_reach(obs_orders(s, d)), 30, ORDERS_DOMAIN, ORDERS_DOMAIN.sites),
        _table_sql(30, "AND site IN ('ASIA', 'EUROPE')"),
    ),
    "top_items_table_category": query(
        lambda s, d: rank.top_items_table(
            rank.item_reach(obs_orders(s, d)), 5, ORDERS_DOMAIN, ("EUROPE",), "old"
        ),
        _table_sql(5, "AND site = 'EUROPE' AND category = 'old'"),
    ),
    "top_items_exposure": query(
        lambda s, d: rank.top_items(rank.item_exposure(obs_orders(s, d)), 25, ORDERS_DOMAIN, ORDERS_DOMAIN.sites),
        _panel_sql(25, f"{SENTENCE} || ' (' || {_labels(ORDERS_DOMAIN.labels)} || ')'", measure=BY_EXPOSURE),
    ),
    "top_items_table_exposure": query(
        lambda s, d: rank.top_items_table(rank.item_exposure(obs_orders(s, d)), 30, ORDERS_DOMAIN, ORDERS_DOMAIN.sites),
        _table_sql(30, "AND site IN ('ASIA', 'EUROPE')", BY_EXPOSURE),
    ),
    "item_distribution_by_item": query(
        lambda s, d: rank.item_distribution(obs_events(s, d, "day"), by=["item"]),
        with_ctes(EV_DAY) + """SELECT site, subject, age, item, n, total, round(n / CAST(total AS DOUBLE) * 100, 9) AS prop,
  row_number() OVER (PARTITION BY site, subject, age ORDER BY n DESC, item) AS rank FROM (
  SELECT *, CAST(sum(n) OVER (PARTITION BY site, subject, age) AS BIGINT) AS total FROM (
    SELECT site, subject, age, item, count(*) AS n FROM obs GROUP BY ALL))""",
    ),
    "top3_by_reach": query(
        lambda s, d: rank.top3_by_reach(obs_orders(s, d), ORDERS_DOMAIN, tasks=line_tasks(s, d)),
        with_ctes(OBS_ORDERS, KEPT, _top3_sql(BY_REACH)) + "SELECT * FROM tops",
    ),
    "top3_by_exposure": query(
        lambda s, d: rank.top3_by_exposure(obs_orders(s, d), ORDERS_DOMAIN),
        with_ctes(
            OBS_ORDERS, KEPT, KEPT_EXPOSURE,
            _top3_sql("SELECT site, category, item, prop_rows AS score FROM exposure"),
        )
        + "SELECT * FROM tops",
    ),
    "category_table": query(
        lambda s, d: rank.category_table(obs_orders(s, d), ORDERS_DOMAIN, tasks=line_tasks(s, d)),
        with_ctes(OBS_ORDERS, KEPT, _top3_sql(BY_REACH)) + f"""
SELECT c.*, "ASIA" AS "top_ASIA", "EUROPE" AS "top_EUROPE", {_labels(ORDERS_DOMAIN.labels).replace('category', 'c.category')} AS label
FROM (SELECT category, count(DISTINCT CASE WHEN site = 'ASIA' THEN item END) AS "n_ASIA",
        count(DISTINCT CASE WHEN site = 'EUROPE' THEN item END) AS "n_EUROPE" FROM obs GROUP BY category) c
LEFT JOIN tops ON tops.category = c.category""",
    ),
    "uncommon_items": query(
        lambda s, d: rank.uncommon_items(rank.item_reach(obs_orders(s, d)), (1, 190)),
        REACH_TOP + """SELECT site, count(*) AS total, count(*) FILTER (n_subjects BETWEEN 1 AND 190) AS n,
  round_even(count(*) FILTER (n_subjects BETWEEN 1 AND 190) / CAST(count(*) AS DOUBLE) * 100, 2) AS pct
FROM reach GROUP BY site HAVING count(*) FILTER (n_subjects BETWEEN 1 AND 190) > 0""",
    ),
    "shared_items": query(
        lambda s, d: rank.shared_items(events_fact(s, d, "day"), EVENTS_DOMAIN.sites),
        with_ctes(EV_DAY) + """SELECT n_shared, n_items, round(n_shared / CAST(n_items AS DOUBLE), 9) AS prop FROM (
  SELECT (SELECT count(*) FROM (SELECT item FROM obs WHERE site = 'A' INTERSECT SELECT item FROM obs WHERE site = 'B')) AS n_shared,
         (SELECT count(*) FROM (SELECT DISTINCT item FROM fact)) AS n_items)""",
    ),
    "shared_top_items": query(
        lambda s, d: rank.shared_top_items(rank.item_reach(obs_orders(s, d)), 25, ORDERS_DOMAIN.sites),
        REACH_TOP + """SELECT item FROM reach_ranked WHERE site = 'ASIA' AND rank <= 25
INTERSECT SELECT item FROM reach_ranked WHERE site = 'EUROPE' AND rank <= 25""",
    ),
}
