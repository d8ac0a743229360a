"""Registered agreement and reporting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewise.catalog.common import EV_DAY, EV_HOUR, OBS_ORDERS, query, with_ctes
from framewise.plans import agree, report
from framewise.sources import bindings as b

CODERS = """coded AS (
  SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
    CASE WHEN event_id % 10 = 0 THEN 'other' ELSE event_type END AS type2 FROM events),
main_coding AS (
  SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS site, user_id AS subject, date_trunc('hour', ts) AS frame,
    CASE WHEN k % 20 = 0 THEN 'Exclude' WHEN k % 20 = 1 THEN 'None' END AS reason,
    CASE WHEN k % 20 > 1 THEN event_type END AS category,
    CASE WHEN k % 20 > 1 THEN event_type || '-' || CAST(k // 50 AS VARCHAR) END AS item FROM coded),
second_coding AS (
  SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS site, user_id AS subject, date_trunc('hour', ts) AS frame,
    CASE WHEN k % 20 = 0 THEN 'Exclude' WHEN k % 20 = 1 THEN 'None' END AS reason,
    CASE WHEN k % 20 > 1 THEN type2 END AS category,
    CASE WHEN k % 20 > 1 THEN type2 || '-' || CAST(k // 50 AS VARCHAR) END AS item
  FROM coded WHERE event_id % 17 <> 0 AND user_id % 3 <> 0),
m AS (SELECT *, count(*) OVER (PARTITION BY site, subject, frame) AS n FROM main_coding
      WHERE subject IN (SELECT subject FROM second_coding)),
s AS (SELECT *, count(*) OVER (PARTITION BY site, subject, frame) AS n FROM second_coding),
matched AS (
  SELECT site, subject, frame,
    CAST(coalesce(sum(CAST(m.item <> s.item AS INT)), 0) = 0 AS BIGINT) AS item_match,
    CAST(coalesce(sum(CAST(m.category <> s.category AS INT)), 0) = 0 AS BIGINT) AS category_match,
    CAST(coalesce(sum(CAST(m.reason <> s.reason AS INT)), 0) = 0 AS BIGINT) AS reason_match,
    CAST(coalesce(sum(CAST(m.n <> s.n AS INT)), 0) = 0 AS BIGINT) AS n_items_match
  FROM m FULL JOIN s USING (site, subject, frame) GROUP BY ALL),
stats AS (
  SELECT site, subject, count(*) AS n_frames, avg(category_match) AS category_agreement, avg(item_match) AS item_agreement
  FROM matched GROUP BY ALL)"""

SETS = """sets AS (
  SELECT site, subject, frame, a, b FROM (
    SELECT site, subject, frame, list_sort(list(DISTINCT item) FILTER (item IS NOT NULL)) AS a FROM m GROUP BY ALL)
  FULL JOIN (
    SELECT site, subject, frame, list_sort(list(DISTINCT item) FILTER (item IS NOT NULL)) AS b FROM s GROUP BY ALL)
  USING (site, subject, frame))"""



def _codings(s, d):
    return b.first_coding(s, d), b.second_coding(s, d)


def _lost_fact(s, d):
    """All rows of the fact; every frame of each seventh subject is excluded."""
    lost = F.col("subject") % 7 == 0
    fact = b.events_fact(s, d, "day").withColumn("reason", F.when(lost, "Exclude").otherwise(F.col("reason")))
    return fact.withColumns({c: F.when(~lost, F.col(c)) for c in ("category", "item")}).distinct()


DAILY = "per AS (SELECT site, subject, count(DISTINCT item) AS n FROM obs GROUP BY ALL)"
SHARES = """shares AS (
  SELECT s.site, s.subject, c.category, count(o.category) / CAST(any_value(n_frames) AS DOUBLE) AS y
  FROM (SELECT site, subject, count(DISTINCT frame) AS n_frames FROM obs GROUP BY ALL) s
  CROSS JOIN (SELECT unnest(['view', 'click', 'purchase', 'signup', 'error']) AS category) c
  LEFT JOIN obs o ON o.site = s.site AND o.subject = s.subject AND o.category = c.category
  GROUP BY s.site, s.subject, c.category)"""


def _top_sql(extra: str) -> str:
    return with_ctes(EV_DAY, SHARES) + f"""SELECT site, subject, category, round(y, 9) AS prop FROM (
  SELECT *, max(y) OVER (PARTITION BY site, subject) AS best FROM shares) WHERE y = best {extra}"""


QUERIES = {
    "frame_agreement": query(
        lambda s, d: agree.frame_agreement(*_codings(s, d)),
        with_ctes(CODERS)
        + """SELECT site, subject, strftime(frame, '%Y-%m-%d %H:%M:%S') AS frame, item_match, category_match,
  reason_match, n_items_match FROM matched""",
    ),
    "agreement": query(
        lambda s, d: agree.agreement(*_codings(s, d)),
        with_ctes(CODERS) + """SELECT site, subject, n_frames, round(category_agreement, 9) AS category_agreement,
  round(item_agreement, 9) AS item_agreement FROM stats""",
    ),
    "agreement_sets": query(
        lambda s, d: agree.frame_agreement(
            *_codings(s, d), columns=("item",), missing="disagree", compare="set"
        ).select("site", "subject", "frame", "item_match"),
        with_ctes(CODERS, SETS) + """SELECT site, subject, strftime(frame, '%Y-%m-%d %H:%M:%S') AS frame,
  CAST(coalesce(a, []) = coalesce(b, []) AS BIGINT) AS item_match FROM sets""",
    ),
    "agreement_summary": query(
        lambda s, d: agree.agreement_summary(agree.agreement(*_codings(s, d))),
        with_ctes(CODERS) + """SELECT coalesce(site, 'All') AS site, CAST(sum(n_frames) AS BIGINT) AS n_frames,
  round(avg(category_agreement) * 100, 9) AS category_pct, round(avg(item_agreement) * 100, 9) AS item_pct
FROM stats GROUP BY ROLLUP (site)""",
    ),
    "inclusion_report": query(
        lambda s, d: report.inclusion_report(b.events_fact(s, d, "day")),
        with_ctes(EV_DAY) + """, bad AS (SELECT DISTINCT subject, frame FROM fact WHERE reason IS NOT NULL),
per AS (SELECT coalesce(f.site, 'All') AS site, count(DISTINCT (f.subject, f.frame)) AS n_coded,
    count(DISTINCT (f.subject, f.frame)) FILTER (f.reason IS NULL AND f.category IS NOT NULL AND b.subject IS NULL) AS n_included,
    count(DISTINCT (b.subject, b.frame)) FILTER (b.subject IS NOT NULL) AS n_excluded
  FROM fact f LEFT JOIN bad b ON f.subject = b.subject AND f.frame = b.frame GROUP BY ROLLUP (f.site))
SELECT *, round(n_excluded / CAST(n_coded AS DOUBLE) * 100, 9) AS pct_excluded FROM per""",
    ),
    "unusable_subjects": query(
        lambda s, d: report.unusable_subjects(_lost_fact(s, d)),
        with_ctes(EV_DAY) + """, whole AS (
  SELECT DISTINCT subject, frame, CASE WHEN subject % 7 = 0 THEN 'Exclude' ELSE reason END AS reason,
    CASE WHEN subject % 7 <> 0 THEN category END AS category, CASE WHEN subject % 7 <> 0 THEN item END AS item FROM fact),
bad AS (SELECT DISTINCT subject, frame FROM whole WHERE reason IS NOT NULL)
SELECT subject, n_excluded, n_frames FROM (
  SELECT subject, count(*) FILTER ((subject, frame) IN (SELECT (subject, frame) FROM bad)) AS n_excluded,
    count(DISTINCT frame) AS n_frames FROM whole GROUP BY subject) WHERE n_excluded = n_frames""",
    ),
    "wearer_share": query(
        lambda s, d: report.wearer_share(b.events_fact(s, d, "day")),
        with_ctes(EV_DAY) + """SELECT site, caregiver, child, round(caregiver / CAST(caregiver + child AS DOUBLE), 9) AS prop FROM (
  SELECT site, count(DISTINCT CASE WHEN wearer = 0 THEN subject END) AS caregiver,
    count(DISTINCT CASE WHEN wearer = 1 THEN subject END) AS child FROM fact GROUP BY site)""",
    ),
    "demographics": query(
        lambda s, d: report.demographics(b.events_fact(s, d, "day")),
        with_ctes(EV_DAY) + """SELECT min(n) AS min_records, max(n) AS max_records, round(avg(n), 9) AS mean_records,
  CAST(median(n) AS DOUBLE) AS median_records, min(age) AS min_age, max(age) AS max_age,
  count(DISTINCT subject) AS n_subjects
FROM (SELECT subject, age, count(*) AS n FROM fact GROUP BY ALL)""",
    ),
    "demographics_by_site": query(
        lambda s, d: report.demographics_by_site(b.events_fact(s, d, "day")),
        with_ctes(EV_DAY) + """SELECT site, count(DISTINCT subject) AS n_subjects, round(avg(n), 9) AS mean_frames,
  round(avg(age), 9) AS mean_age
FROM (SELECT site, subject, age, count(DISTINCT frame) AS n FROM fact GROUP BY ALL) GROUP BY site""",
    ),
    "daily_items": query(
        lambda s, d: report.daily_items(b.obs_orders(s, d), b.line_tasks(s, d)),
        with_ctes(OBS_ORDERS, DAILY) + """SELECT coalesce(site, 'All') AS site, round(avg(n), 9) AS mean,
  CAST(median(n) AS DOUBLE) AS median, round(stddev_samp(n), 9) AS sd, min(n) AS min, max(n) AS max
FROM per GROUP BY ROLLUP (site)""",
    ),
    "subject_totals": query(
        lambda s, d: report.subject_totals(b.obs_orders(s, d)),
        with_ctes(OBS_ORDERS) + """SELECT site, subject, age, count(DISTINCT item) AS n_items,
  count(DISTINCT frame) AS n_frames FROM obs GROUP BY ALL""",
    ),
    "category_means": query(
        lambda s, d: report.category_means(b.obs_events(s, d, "day"), b.EVENTS_DOMAIN),
        with_ctes(EV_DAY, SHARES) + """SELECT category, site, round(avg(y), 9) AS mean, round(stddev_samp(y), 9) AS sd,
  count(*) AS n, round(stddev_samp(y) / sqrt(count(*)), 9) AS se FROM shares GROUP BY ALL""",
    ),
    "top_category": query(
        lambda s, d: report.top_category(b.obs_events(s, d, "day"), b.EVENTS_DOMAIN),
        _top_sql(""),
    ),
    "top_category_among": query(
        lambda s, d: report.top_category(
            b.obs_events(s, d, "day"), b.EVENTS_DOMAIN, ("view", "error")
        ),
        _top_sql("AND category IN ('view', 'error')"),
    ),
    "item_prevalence": query(
        lambda s, d: report.item_prevalence(b.obs_events(s, d, "hour"), "view-0"),
        with_ctes(EV_HOUR) + """, v AS (SELECT site, subject, count(DISTINCT frame) AS n_frames,
  count(*) FILTER (item = 'view-0') AS n FROM obs GROUP BY ALL), p AS (SELECT *, n / CAST(n_frames AS DOUBLE) AS y FROM v)
SELECT site, count(*) AS n_all, count(*) FILTER (n > 0) AS n_subjects, round(min(y), 9) AS min, round(max(y), 9) AS max,
  round(avg(y), 9) AS mean, round(median(y), 9) AS median,
  round(count(*) FILTER (n > 0) / CAST(count(*) AS DOUBLE), 9) AS prop_subjects FROM p GROUP BY site""",
    ),
}
