"""Registered hourly, transition and model-frame queries."""

from __future__ import annotations

from framewise.catalog.common import EV_DAY, EV_HOUR, OBS_ORDERS, query, with_ctes
from framewise.operators.reshape import histogram
from framewise.plans import agree, rates, report
from framewise.sources.bindings import (
    EVENTS_DOMAIN,
    ORDERS_DOMAIN,
    event_hours,
    event_people,
    obs_events,
    line_tasks,
    obs_orders,
    table,
)
from pyspark.sql import functions as F

CATEGORIES = "categories AS (SELECT unnest(['view', 'click', 'purchase', 'signup', 'error']) AS category)"

SCAFFOLD = """ev_people AS (
  SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS site, user_id AS subject, user_id % 49 AS age FROM events),
hours AS (SELECT user_id AS subject, h AS hour FROM (SELECT DISTINCT user_id FROM events), generate_series(6, 21) g(h)),
scaffold AS (
  SELECT site, subject, age, hour FROM (
    SELECT * FROM hours WHERE subject IN (SELECT subject FROM obs)) FULL JOIN ev_people USING (subject))"""

STEPS = """frames AS (
  SELECT site, subject, age, frame, min(ts) AS ts, string_agg({col}, ', ' ORDER BY {col}) AS held
  FROM (SELECT DISTINCT site, subject, age, frame, ts, item, category FROM obs) GROUP BY ALL),
steps AS (
  SELECT *, lag(held) OVER (PARTITION BY subject ORDER BY ts, frame) AS prev FROM frames),
moves AS (
  SELECT site, subject, age, CAST(hour(ts) AS BIGINT) AS hour,
         CAST(sum(CASE WHEN held <> prev THEN 1 ELSE 0 END) AS BIGINT) AS n_transitions
  FROM steps GROUP BY ALL)"""

INDICATORS = ", ".join(
    f"CAST(category = '{c}' AS BIGINT) AS is_{c}" for c in EVENTS_DOMAIN.categories
)


def _transition_sql(relation: str, column: str, zero: bool, hour: str = "hour") -> str:
    keys = "site, subject, age, hour" if column == "item" else "subject, hour"
    return with_ctes(relation, STEPS.format(col=column)) + f"""
SELECT site, subject, age, hour, n_transitions, n_values, round(y, 9) AS y FROM (
  SELECT m.*, n_values, n_transitions / CAST(n_values AS DOUBLE) AS y
  FROM moves m LEFT JOIN (
    SELECT {keys}, count(DISTINCT {column}) AS n_values FROM (SELECT *, {hour} FROM obs) GROUP BY ALL) v
  USING ({keys})) {'' if zero else 'WHERE y > 0'}"""


def _share_sql(relation: str, names, extra: str = "", scale: str = "* 100", age: str = "") -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return with_ctes(relation) + f"""
SELECT s.site, s.subject{age and ', s.age'}, n_frames, category, n, round(n / CAST(n_frames AS DOUBLE) {scale}, 9) AS y FROM (
  SELECT s.site, s.subject, s.age, n_frames, c.category, count(o.category) AS n
  FROM (SELECT site, subject, age, count(DISTINCT frame) AS n_frames FROM obs GROUP BY ALL) s
  CROSS JOIN (SELECT unnest([{listed}]) AS category) c
  LEFT JOIN obs o ON o.site = s.site AND o.subject = s.subject AND o.category = c.category
  GROUP BY ALL) s {extra}"""


def _hourly(s, d, column, zero):
    view = obs_events(s, d, "hour")
    if not zero:
        return rates.hourly_stats(view, column)
    scaffold = rates.hour_scaffold(event_hours(s, d), event_people(s, d), view)
    return rates.hourly_stats(view, column, scaffold)


def _hourly_sql(column: str, zero: bool) -> str:
    counts = f"SELECT subject, hour, count(DISTINCT {column}) AS y FROM obs GROUP BY ALL"
    if zero:
        counts = f"""SELECT subject, hour, coalesce(y, 0) AS y FROM ({counts}) FULL JOIN (
          SELECT subject, hour FROM scaffold WHERE subject IN (SELECT subject FROM obs)) USING (subject, hour)"""
    return with_ctes(EV_HOUR, SCAFFOLD) + f"""
SELECT round(avg(y), 9) AS mean, CAST(median(y) AS DOUBLE) AS median, round(stddev_samp(y), 9) AS sd,
       min(y) AS min, max(y) AS max FROM ({counts})"""


MODEL = f"""SELECT site, subject, n_frames, hour, category, n_items, {INDICATORS} FROM (
  SELECT site, subject, hour, category, count(DISTINCT item) AS n_items FROM obs GROUP BY ALL)
JOIN (SELECT site, subject, count(DISTINCT frame) AS n_frames FROM obs GROUP BY ALL) USING (site, subject)"""

MODEL_ZERO = """filled AS (
  SELECT site, subject, hour, category, coalesce(n_frames, 0) AS n_frames, coalesce(n_items, 0) AS n_items
  FROM (SELECT site, subject, hour, category, count(DISTINCT item) AS n_items FROM obs GROUP BY ALL)
  JOIN (SELECT site, subject, hour, count(DISTINCT frame) AS n_frames FROM obs GROUP BY ALL) USING (site, subject, hour)
  FULL JOIN (SELECT site, subject, hour, category FROM scaffold CROSS JOIN categories
             WHERE subject IN (SELECT subject FROM obs)) USING (site, subject, hour, category))"""


def _model_zero(s, d):
    view = obs_events(s, d, "hour")
    scaffold = rates.hour_scaffold(event_hours(s, d), event_people(s, d), view, EVENTS_DOMAIN)
    return rates.model_frame_zero(view, scaffold, EVENTS_DOMAIN)


def _durations(s, d):
    ts = table(s, d, "events").select(
        F.col("user_id").alias("subject"), F.col("event_id").alias("frame"), "ts"
    )
    return agree.frame_durations(ts)


QUERIES = {
    "items_per_hour": query(
        lambda s, d: rates.per_hour(obs_events(s, d, "hour"), "item"),
        with_ctes(EV_HOUR)
        + "SELECT site, subject, age, hour, count(DISTINCT item) AS y FROM obs GROUP BY ALL",
    ),
    "categories_per_hour": query(
        lambda s, d: rates.per_hour(obs_events(s, d, "hour"), "category"),
        with_ctes(EV_HOUR)
        + "SELECT site, subject, age, hour, count(DISTINCT category) AS y FROM obs GROUP BY ALL",
    ),
    "items_per_hour_by_category": query(
        lambda s, d: rates.items_per_hour_by_category(obs_events(s, d, "hour")),
        with_ctes(EV_HOUR) + """SELECT site, subject, category, round(avg(n), 9) AS y FROM (
  SELECT site, subject, hour, category, count(DISTINCT item) AS n FROM obs GROUP BY ALL) GROUP BY ALL""",
    ),
    "category_panel": query(
        lambda s, d: rates.category_panel(
            rates.items_per_hour_by_category(obs_events(s, d, "hour")), "A"
        ),
        with_ctes(EV_HOUR) + """SELECT site, subject, category, round(avg(n), 9) AS y FROM (
  SELECT site, subject, hour, category, count(DISTINCT item) AS n FROM obs WHERE site = 'A' GROUP BY ALL) GROUP BY ALL""",
    ),
    "category_share": query(
        lambda s, d: rates.category_share(obs_orders(s, d), ORDERS_DOMAIN),
        _share_sql(OBS_ORDERS, ORDERS_DOMAIN.categories),
    ),
    "category_share_events": query(
        lambda s, d: rates.category_share(obs_events(s, d, "day"), EVENTS_DOMAIN),
        _share_sql(EV_DAY, EVENTS_DOMAIN.categories),
    ),
    "category_share_by_age": query(
        lambda s, d: rates.category_share_by_age(obs_events(s, d, "day"), EVENTS_DOMAIN),
        _share_sql(EV_DAY, EVENTS_DOMAIN.categories, "WHERE n > 0", "", "age"),
    ),
    "item_transition_rate": query(
        lambda s, d: rates.transition_rate(obs_events(s, d, "hour"), "item"),
        _transition_sql(EV_HOUR, "item", False),
    ),
    "item_transition_rate_zero": query(
        lambda s, d: rates.transition_rate(obs_events(s, d, "hour"), "item", keep_zero=True),
        _transition_sql(EV_HOUR, "item", True),
    ),
    "category_transition_rate": query(
        lambda s, d: rates.transition_rate(obs_events(s, d, "hour"), "category"),
        _transition_sql(EV_HOUR, "category", False),
    ),
    "item_transition_rate_orders": query(
        lambda s, d: rates.transition_rate(
            obs_orders(s, d).withColumn("hour", F.lit(0).cast("long")), "item", tasks=line_tasks(s, d)
        ),
        _transition_sql(OBS_ORDERS, "item", False, "CAST(0 AS BIGINT) AS hour"),
    ),
    "frame_durations": query(
        _durations,
        """SELECT subject, frame, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN p IS NOT NULL AND n IS NOT NULL THEN
  round((epoch_us(n) - epoch_us(ts)) / 1e6, 9) END AS duration FROM (
  SELECT user_id AS subject, event_id AS frame, ts, lag(ts) OVER w AS p, lead(ts) OVER w AS n
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""",
    ),
    "hour_scaffold": query(
        lambda s, d: rates.hour_scaffold(
            event_hours(s, d), event_people(s, d), obs_events(s, d, "hour")
        ).withColumn("hour", F.col("hour").cast("double")),
        with_ctes(EV_HOUR, SCAFFOLD)
        + "SELECT site, subject, age, CAST(hour AS DOUBLE) AS hour FROM scaffold",
    ),
    "hour_scaffold_categories": query(
        lambda s, d: rates.hour_scaffold(
            event_hours(s, d), event_people(s, d), obs_events(s, d, "hour"), EVENTS_DOMAIN
        ),
        with_ctes(EV_HOUR, SCAFFOLD, CATEGORIES)
        + "SELECT site, subject, age, hour, category FROM scaffold CROSS JOIN categories",
    ),
    "hourly_stats": query(lambda s, d: _hourly(s, d, "item", False), _hourly_sql("item", False)),
    "hourly_stats_zero": query(lambda s, d: _hourly(s, d, "item", True), _hourly_sql("item", True)),
    "hourly_categories": query(
        lambda s, d: _hourly(s, d, "category", False), _hourly_sql("category", False)
    ),
    "hourly_categories_zero": query(
        lambda s, d: _hourly(s, d, "category", True), _hourly_sql("category", True)
    ),
    "model_frame": query(
        lambda s, d: rates.model_frame(obs_events(s, d, "hour"), EVENTS_DOMAIN),
        with_ctes(EV_HOUR) + MODEL,
    ),
    "model_frame_zero": query(
        _model_zero,
        with_ctes(EV_HOUR, SCAFFOLD, CATEGORIES, MODEL_ZERO)
        + f"SELECT site, subject, hour, category, n_frames, n_items, {INDICATORS} FROM filled",
    ),
    "histogram": query(
        lambda s, d: histogram(_model_zero(s, d), "n_items", 1.0),
        with_ctes(EV_HOUR, SCAFFOLD, CATEGORIES, MODEL_ZERO)
        + "SELECT CAST(n_items AS DOUBLE) AS bin, count(*) AS n FROM filled GROUP BY n_items",
    ),
    "histogram_wide": query(
        lambda s, d: histogram(table(s, d, "events"), "value", 2.5, ["event_type"]),
        """SELECT event_type, floor("value" / 2.5 + 0.5) * 2.5 AS bin, count(*) AS n
FROM events GROUP BY ALL""",
    ),
    "box_summary": query(
        lambda s, d: report.box_summary(
            rates.items_per_hour_by_category(obs_events(s, d, "hour")), ["site", "category"], "y"
        ),
        with_ctes(EV_HOUR) + """, v AS (SELECT site, subject, category, avg(n) AS y FROM (
  SELECT site, subject, hour, category, count(DISTINCT item) AS n FROM obs GROUP BY ALL) GROUP BY ALL),
q AS (SELECT site, category, count(*) AS n, quantile_cont(y, 0.25) AS lower, quantile_cont(y, 0.5) AS middle,
  quantile_cont(y, 0.75) AS upper FROM v GROUP BY ALL)
SELECT site, category, n, round(lower, 9) AS lower, round(middle, 9) AS middle, round(upper, 9) AS upper,
  round(min(y) FILTER (y >= lower - 1.5 * (upper - lower)), 9) AS ymin,
  round(max(y) FILTER (y <= upper + 1.5 * (upper - lower)), 9) AS ymax
FROM v JOIN q USING (site, category) GROUP BY site, category, n, lower, middle, upper""",
    ),
}
