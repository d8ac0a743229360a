"""Registered tests and regressions.

The SQL side has its own closed forms: regressions by partialling out one predictor from
per-site simple regressions, tail probabilities by Simpson integration.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from framewise.catalog.common import EV_DAY, EV_HOUR, OBS_ORDERS, query, with_ctes
from framewise.catalog.rates import CATEGORIES, STEPS as MOVE_STEPS
from framewise.catalog.reports import DAILY, SHARES
from framewise.operators.ordered import holm
from framewise.plans import models, rates, report
from framewise.sources.bindings import (
    EVENTS_DOMAIN,
    ORDERS_DOMAIN,
    obs_events,
    line_tasks,
    obs_orders,
)

STEPS = 20000
SIMPSON = f"CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
POINTS = f"points AS (SELECT i, CAST({SIMPSON} AS DOUBLE) / 3 / {STEPS} AS w, i / CAST({STEPS} AS DOUBLE) AS u FROM range(0, {STEPS + 1}) r(i))"


def z_p(z: str) -> str:
    return (
        f"(SELECT greatest(0, 1 - 2 * abs({z}) / sqrt(2 * pi()) * sum(w * exp(-0.5 * ({z} * u) * ({z} * u)))) FROM points)"
    )


def t_p(t: str, df: str) -> str:
    top = f"atan(abs({t}) / sqrt({df}))"
    scale = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi())"
    return (
        f"(SELECT greatest(0, 1 - 2 * {scale} * {top} * sum(w * pow(cos(u * {top}), {df} - 1))) FROM points)"
    )


def f_lower(f: str, d1: str, d2: str) -> str:
    top = f"asin(sqrt({d1} * {f} / ({d1} * {f} + {d2})))"
    log_scale = f"lgamma(({d1} + {d2}) / 2.0) - lgamma({d1} / 2.0) - lgamma({d2} / 2.0)"
    return (
        f"(SELECT 2 * {top} * sum(w * exp({log_scale} + ({d1} - 1) * ln(greatest(sin(u * {top}), 1e-300))"
        f" + ({d2} - 1) * ln(cos(u * {top})))) FROM points)"
    )


def _rank_sum_sql(relation: str, values: str, family: str, a: str, b: str) -> str:
    over = f"PARTITION BY {family}" if family else ""
    by = f"GROUP BY {family}" if family else ""
    keep = f"{family}, " if family else ""
    return with_ctes(relation, POINTS) + f""", v AS ({values}),
r AS (SELECT *, rank() OVER ({over} ORDER BY y) + (count(*) OVER (PARTITION BY {keep} y) - 1) / 2.0 AS mid,
        count(*) OVER (PARTITION BY {keep} y) AS t FROM v),
s AS (SELECT {keep} CAST(count(*) FILTER (site = '{a}') AS DOUBLE) AS n1, CAST(count(*) FILTER (site = '{b}') AS DOUBLE) AS n2,
        CAST(sum(mid) FILTER (site = '{a}') AS DOUBLE) AS r1, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r {by}),
w AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS w FROM s),
z AS (SELECT *, (w - n1 * n2 / 2 - sign(w - n1 * n2 / 2) * 0.5) /
        sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM w),
out AS (SELECT {keep} CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, w, z, least(1, {z_p('z')}) AS p FROM z)
"""


RANK_OUT = "n1, n2, round(w, 6) AS w, round(z, 6) AS z, round(p, 6) AS p_value FROM out"


def _daily(s, d):
    return report.items_per_subject(obs_orders(s, d), line_tasks(s, d))


def _shares(s, d):
    return rates.category_share(obs_events(s, d, "day"), EVENTS_DOMAIN, scale=1.0)


def _rank_by_category(s, d):
    return models.rank_sum(_shares(s, d), ["category"], "site", EVENTS_DOMAIN.sites, "y")


# Per site and category: sums of squares and products of age (x), frames (f) and share (y).
AGE_SHARES = """v AS (
  SELECT category, o.site, subject, age, n_frames AS f, count(*) / CAST(any_value(n_frames) AS DOUBLE) AS y
  FROM obs o JOIN (SELECT site, subject, count(DISTINCT frame) AS n_frames FROM obs GROUP BY ALL) t USING (site, subject)
  GROUP BY ALL),
c AS (
  SELECT category, site, CAST(count(*) AS DOUBLE) AS n, avg(age) AS mx, avg(f) AS mf, avg(y) AS my,
    regr_sxx(y, age) AS sxx, regr_sxy(f, age) AS sxf, regr_sxy(y, age) AS sxy,
    regr_syy(f, age) AS sff, regr_syy(y, age) AS syy, regr_sxy(y, f) AS sfy FROM v GROUP BY ALL),
r AS (
  SELECT category, sum(sff - sxf * sxf / sxx) AS rff, sum(sfy - sxf * sxy / sxx) AS rfy,
    sum(syy - sxy * sxy / sxx) AS ryy, sum(n) - 5 AS df FROM c GROUP BY category),
k AS (SELECT *, rfy / rff AS cf, (ryy - rfy * rfy / rff) / df AS s2 FROM r),
ab AS (
  SELECT c.category, site, n, mx, sxx, sxy / sxx AS by, sxf / sxx AS bf,
    my - sxy / sxx * mx AS ay, mf - sxf / sxx * mx AS af, 1 / n + mx * mx / sxx AS va, 1 / sxx AS vb FROM c),
j AS (
  SELECT a.category, a.ay AS ay0, b.ay - a.ay AS dy, a.by AS by0, b.by - a.by AS dby,
    a.af AS af0, b.af - a.af AS df_, a.bf AS bf0, b.bf - a.bf AS dbf,
    a.va AS va0, a.va + b.va AS vd, a.vb AS vb0, a.vb + b.vb AS vdb
  FROM ab a JOIN ab b ON a.category = b.category AND a.site = 'A' AND b.site = 'B'),
tss AS (
  SELECT category, count(*) * var_pop(CAST(site = 'B' AS INT)) AS t_site, count(*) * var_pop(age) AS t_age,
    count(*) * var_pop(f) AS t_f, count(*) * var_pop(CASE WHEN site = 'B' THEN age ELSE 0 END) AS t_int FROM v GROUP BY category),
terms AS (
  SELECT category, 1 AS position, '(intercept)' AS term, ay0 - cf * af0 AS est, s2 * (va0 + af0 * af0 / rff) AS var, df, NULL AS vif FROM j JOIN k USING (category)
  UNION ALL SELECT category, 2, 'site', dy - cf * df_, s2 * (vd + df_ * df_ / rff), df, t_site * (vd + df_ * df_ / rff) FROM j JOIN k USING (category) JOIN tss USING (category)
  UNION ALL SELECT category, 3, 'age', by0 - cf * bf0, s2 * (vb0 + bf0 * bf0 / rff), df, t_age * (vb0 + bf0 * bf0 / rff) FROM j JOIN k USING (category) JOIN tss USING (category)
  UNION ALL SELECT category, 4, 'n_frames', cf, s2 / rff, df, t_f / rff FROM k JOIN tss USING (category)
  UNION ALL SELECT category, 5, 'site:age', dby - cf * dbf, s2 * (vdb + dbf * dbf / rff), df, t_int * (vdb + dbf * dbf / rff) FROM j JOIN k USING (category) JOIN tss USING (category)),
tested AS (SELECT *, sqrt(var) AS se, est / sqrt(var) AS t, """ + t_p("est / sqrt(var)", "df") + """ AS p FROM terms)"""

ADJUSTED = """scaled AS (
  SELECT *, least(1, p * (5 - row_number() OVER w + 1)) AS sp, row_number() OVER w AS o FROM tested
  WINDOW w AS (PARTITION BY category ORDER BY p, term)),
adjusted AS (SELECT *, max(sp) OVER (PARTITION BY category ORDER BY o ROWS UNBOUNDED PRECEDING) AS padj FROM scaled)"""


def _share_terms():
    return models.site_by("age", EVENTS_DOMAIN.sites, ("n_frames",))


def _share_fit(s, d):
    values = rates.category_share_by_age(obs_events(s, d, "day"), EVENTS_DOMAIN)
    return models.linear_fit(values, "y", _share_terms(), "category"), values


def _share_coefs(s, d):
    return models.coefficients(_share_fit(s, d)[0], "category")


def _share_predict(s, d):
    fit, values = _share_fit(s, d)
    grid = models.prediction_grid(values, EVENTS_DOMAIN.sites, "category", ("n_frames",))
    return models.predict(fit, grid, _share_terms(), "category")


# n_items ~ site * age is two simple regressions with a common residual variance.
TOTALS = """v AS (SELECT site, subject, age, count(DISTINCT item) AS y FROM obs WHERE site IN ('ASIA', 'EUROPE') GROUP BY ALL),
c AS (SELECT site, CAST(count(*) AS DOUBLE) AS n, avg(age) AS mx, regr_sxx(y, age) AS sxx,
  regr_slope(y, age) AS b, regr_intercept(y, age) AS a, regr_syy(y, age) - regr_sxy(y, age) ** 2 / regr_sxx(y, age) AS rss FROM v GROUP BY site),
k AS (SELECT sum(rss) / (sum(n) - 4) AS s2, sum(n) - 4 AS df FROM c),
j AS (SELECT p.a AS a0, q.a - p.a AS da, p.b AS b0, q.b - p.b AS db, 1 / p.n + p.mx ** 2 / p.sxx AS va,
  1 / p.n + p.mx ** 2 / p.sxx + 1 / q.n + q.mx ** 2 / q.sxx AS vda, 1 / p.sxx AS vb, 1 / p.sxx + 1 / q.sxx AS vdb
  FROM c p, c q WHERE p.site = 'ASIA' AND q.site = 'EUROPE'),
terms AS (
  SELECT 1 AS position, '(intercept)' AS term, a0 AS est, s2 * va AS var, df FROM j, k
  UNION ALL SELECT 2, 'site', da, s2 * vda, df FROM j, k
  UNION ALL SELECT 3, 'age', b0, s2 * vb, df FROM j, k
  UNION ALL SELECT 4, 'site:age', db, s2 * vdb, df FROM j, k)"""


def _totals(s, d):
    totals = report.subject_totals(obs_orders(s, d)).where(F.col("site").isin(*ORDERS_DOMAIN.sites))
    return totals.withColumn("model", F.lit("n_items"))


def _totals_fit(s, d):
    return models.linear_fit(_totals(s, d), "n_items", models.site_by("age", ORDERS_DOMAIN.sites), "model")


def _totals_predict(s, d):
    grid = models.prediction_grid(_totals(s, d), ORDERS_DOMAIN.sites, "model")
    return models.predict(_totals_fit(s, d), grid, models.site_by("age", ORDERS_DOMAIN.sites), "model").drop("model")


def _age_fit(s, d):
    rows = models.age_model_rows(obs_events(s, d, "hour"))
    return models.random_intercept_fit(rows, "y", models.site_by("age", EVENTS_DOMAIN.sites), "model")


def _category_fit(s, d):
    frame = rates.model_frame(obs_events(s, d, "hour"), EVENTS_DOMAIN)
    rows = models.category_model_rows(frame, EVENTS_DOMAIN)
    return models.random_intercept_fit(
        rows, "n_items", models.site_by("target", EVENTS_DOMAIN.sites), "model"
    )


def _age_predict(s, d):
    rows = models.age_model_rows(obs_events(s, d, "hour"))
    grid = models.prediction_grid(rows, EVENTS_DOMAIN.sites, "model")
    terms = models.site_by("age", EVENTS_DOMAIN.sites)
    return models.predict(models.random_intercept_fit(rows, "y", terms, "model"), grid, terms, "model")


# Random intercepts: y ~ site * x splits into one weighted regression per site with a common
# variance ratio, as every subject belongs to one site.  The derivative of the restricted
# likelihood by the ratio is read on a grid of its logarithm, which is zoomed eight times.
ZOOMS = 8


def _reml_level(i: int, grid: str) -> list[str]:
    return [
        f"grid{i} AS MATERIALIZED ({grid})",
        f"""mean{i} AS MATERIALIZED (
  SELECT model, s, site, sum(n / (1 + n * exp(s))) AS sw, sum(n / (1 + n * exp(s)) * mx) / sum(n / (1 + n * exp(s))) AS xb,
    sum(n / (1 + n * exp(s)) * my) / sum(n / (1 + n * exp(s))) AS yb FROM grid{i} JOIN subj USING (model) GROUP BY ALL)""",
        f"""cross{i} AS MATERIALIZED (
  SELECT model, s, site, any_value(sw) AS sw, any_value(xb) AS xb, any_value(yb) AS yb,
    sum(cxx + n / (1 + n * exp(s)) * (mx - xb) ** 2) AS dxx, sum(cxy + n / (1 + n * exp(s)) * (mx - xb) * (my - yb)) AS dxy,
    sum(cyy + n / (1 + n * exp(s)) * (my - yb) ** 2) AS dyy FROM mean{i} JOIN subj USING (model, site) GROUP BY ALL)""",
        f"""rest{i} AS MATERIALIZED (
  SELECT model, s, sum(dyy - dxy * dxy / dxx) AS rss, sum(ln(sw) + ln(dxx)) AS logdet FROM cross{i} GROUP BY ALL)""",
        f"""level{i} AS MATERIALIZED (
  SELECT model, s, any_value((total - 4) * ln(rss) + logdet) + sum(ln(1 + n * exp(s))) AS deviance,
    sum(n / (1 + n * exp(s)) - (n / (1 + n * exp(s))) ** 2 * ((total - 4) / rss * ((my - yb) - dxy / dxx * (mx - xb)) ** 2
      + 1 / sw + (mx - xb) ** 2 / dxx)) AS slope
  FROM cross{i} JOIN rest{i} USING (model, s) JOIN subj USING (model, site) JOIN sizes USING (model) GROUP BY ALL)""",
    ]


def _reml_sql() -> str:
    parts = [
        """subj AS MATERIALIZED (
  SELECT model, site, subject, CAST(count(*) AS DOUBLE) AS n, avg(x) AS mx, avg(y) AS my,
    regr_sxx(y, x) AS cxx, regr_sxy(y, x) AS cxy, regr_syy(y, x) AS cyy FROM v GROUP BY ALL)""",
        "sizes AS MATERIALIZED (SELECT model, sum(n) AS total FROM subj GROUP BY model)",
        *_reml_level(0, "SELECT model, s FROM sizes, (SELECT -800.0 AS s UNION ALL SELECT i * 0.25 FROM range(-48, 33) r(i))"),
        "found0 AS MATERIALIZED (SELECT model, arg_min(s, deviance) - 0.25 AS lo, 0.5 AS width FROM level0 GROUP BY model)",
    ]
    for i in range(1, ZOOMS + 1):
        parts += _reml_level(i, f"SELECT model, lo + width * k / 20 AS s, lo, width FROM found{i - 1}, range(0, 21) r(k)")
        parts.append(
            f"""found{i} AS MATERIALIZED (
  SELECT model, coalesce(max(s) FILTER (slope < 0), min(s)) AS lo, any_value(width) / 20 AS width
  FROM level{i} JOIN found{i - 1} USING (model) GROUP BY model)"""
        )
    last = ZOOMS + 1
    parts += _reml_level(last, f"SELECT model, lo + width / 2 AS s FROM found{ZOOMS}")
    parts.append(
        f"""sided AS (
  SELECT model, site, dxy / dxx AS b, yb - dxy / dxx * xb AS a, rss / (total - 4) AS s2, xb, sw, dxx,
    1 / sw + xb * xb / dxx AS va, 1 / dxx AS vb
  FROM cross{last} JOIN rest{last} USING (model, s) JOIN sizes USING (model))"""
    )
    return ",\n".join(parts)


def _reml_terms(sites: tuple[str, str], name: str) -> str:
    return f"""pair AS (
  SELECT p.model, p.a AS a0, q.a - p.a AS da, p.b AS b0, q.b - p.b AS db, p.va * p.s2 AS va, (p.va + q.va) * p.s2 AS vda,
    p.vb * p.s2 AS vb, (p.vb + q.vb) * p.s2 AS vdb
  FROM sided p JOIN sided q USING (model) WHERE p.site = '{sites[0]}' AND q.site = '{sites[1]}'),
terms AS (
  SELECT model, 1 AS position, '(intercept)' AS term, a0 AS est, sqrt(va) AS se FROM pair
  UNION ALL SELECT model, 2, 'site', da, sqrt(vda) FROM pair
  UNION ALL SELECT model, 3, '{name}', b0, sqrt(vb) FROM pair
  UNION ALL SELECT model, 4, 'site:{name}', db, sqrt(vdb) FROM pair),
tested AS (SELECT *, {z_p('est / se')} AS p FROM terms)"""


# Distinct items per subject, hour and category against a 0/1 mark of each category in turn.
CATEGORY_ROWS = """v AS (
  SELECT m.category AS model, site, subject, CAST(c.category = m.category AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM (
    SELECT site, subject, hour, category, count(DISTINCT item) AS y FROM obs GROUP BY ALL) c, categories m)"""


def _age_rows() -> str:
    """The four hourly measures stacked."""
    moved = [
        ("item_transitions", "item", "site, subject, age, hour"),
        ("category_transitions", "category", "subject, hour"),
    ]
    parts = []
    for name, column, keys in moved:
        steps = MOVE_STEPS.format(col=column)
        for cte in ("frames", "steps", "moves"):
            steps = steps.replace(f"{cte} AS (", f"{cte}_{column} AS (").replace(f"FROM {cte}", f"FROM {cte}_{column}")
        parts.append(steps)
    stacked = [
        f"SELECT '{name}_per_hour' AS model, site, subject, age, count(DISTINCT {column}) AS y FROM obs GROUP BY site, subject, age, hour"
        for name, column in (("items", "item"), ("categories", "category"))
    ]
    stacked += [
        f"""SELECT '{name}', m.site, m.subject, m.age, n_transitions / CAST(n_values AS DOUBLE) FROM moves_{column} m JOIN (
    SELECT {keys}, count(DISTINCT {column}) AS n_values FROM obs GROUP BY ALL) d USING ({keys}) WHERE n_transitions > 0"""
        for name, column, keys in moved
    ]
    rows = " UNION ALL ".join(stacked)
    return ",\n".join([*parts, f"v AS (SELECT model, site, subject, CAST(age AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM ({rows}))"])


CATEGORY_FIT = (EV_HOUR, CATEGORIES, POINTS, CATEGORY_ROWS, _reml_sql(), _reml_terms(EVENTS_DOMAIN.sites, "target"))
AGE_FIT = (EV_HOUR, POINTS, _age_rows(), _reml_sql(), _reml_terms(EVENTS_DOMAIN.sites, "age"))
REML_OUT = """SELECT model, CAST(position AS BIGINT) AS position, term, round(est, 6) AS estimate, round(se, 6) AS std_error,
  round(est / se, 6) AS statistic, round(p, 6) AS p_value FROM tested"""

COEF = ["position", "term", "estimate", "std_error", "statistic", "p_value"]

QUERIES = {
    "rank_sum": query(
        lambda s, d: models.rank_sum(
            _daily(s, d), [], "site", ORDERS_DOMAIN.sites, "n_items"
        ),
        _rank_sum_sql(with_ctes(OBS_ORDERS, DAILY)[5:].rstrip(), "SELECT site, n AS y FROM per WHERE site IN ('ASIA', 'EUROPE')", "", "ASIA", "EUROPE")
        + "SELECT " + RANK_OUT,
        6,
    ),
    "rank_sum_by_category": query(
        _rank_by_category,
        _rank_sum_sql(with_ctes(EV_DAY, SHARES)[5:].rstrip(), "SELECT category, site, y FROM shares", "category", "A", "B")
        + "SELECT category, " + RANK_OUT,
        6,
    ),
    "holm": query(
        lambda s, d: holm(_rank_by_category(s, d), "p_value", [], "category").select("category", "p_value", "p_adjusted"),
        _rank_sum_sql(with_ctes(EV_DAY, SHARES)[5:].rstrip(), "SELECT category, site, y FROM shares", "category", "A", "B")
        + """SELECT category, round(p, 6) AS p_value, round(max(sp) OVER (ORDER BY o), 6) AS p_adjusted FROM (
  SELECT category, p, least(1, p * (count(*) OVER () - row_number() OVER w + 1)) AS sp, row_number() OVER w AS o
  FROM out WINDOW w AS (ORDER BY p, category))""",
        6,
    ),
    "variance_ratio": query(
        lambda s, d: models.variance_ratio(_daily(s, d), "site", ORDERS_DOMAIN.sites, "n_items"),
        with_ctes(OBS_ORDERS, DAILY, POINTS) + f""", q AS (
  SELECT var_samp(n) FILTER (site = 'ASIA') / var_samp(n) FILTER (site = 'EUROPE') AS f,
    count(*) FILTER (site = 'ASIA') - 1.0 AS df1, count(*) FILTER (site = 'EUROPE') - 1.0 AS df2 FROM per),
l AS (SELECT *, {f_lower('f', 'df1', 'df2')} AS lower FROM q)
SELECT round(f, 6) AS f, CAST(df1 AS DOUBLE) AS df1, CAST(df2 AS DOUBLE) AS df2, round(2 * least(lower, 1 - lower), 6) AS p_value FROM l""",
        6,
    ),
    "pearson": query(
        lambda s, d: models.pearson(
            report.subject_totals(obs_events(s, d, "day")), "age", "n_frames"
        ),
        with_ctes(EV_DAY, POINTS) + f""", v AS (SELECT subject, age, count(DISTINCT frame) AS f FROM obs GROUP BY ALL),
q AS (SELECT corr(age, f) AS r, count(*) AS n FROM v),
t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2.0 AS df FROM q)
SELECT round(r, 6) AS r, n, round(t, 6) AS t, round({t_p('t', 'df')}, 6) AS p_value,
  round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) AS low,
  round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) AS high FROM t""",
        6,
    ),
    "linear_by_category": query(
        lambda s, d: _share_coefs(s, d).select("category", *COEF),
        with_ctes(EV_DAY, POINTS, AGE_SHARES) + """SELECT category, CAST(position AS BIGINT) AS position, term,
  round(est, 6) AS estimate, round(se, 6) AS std_error, round(t, 6) AS statistic, round(p, 6) AS p_value FROM tested""",
        6,
    ),
    "vif": query(
        lambda s, d: _share_coefs(s, d).where("term <> '(intercept)'").select("category", "term", "vif"),
        with_ctes(EV_DAY, POINTS, AGE_SHARES)
        + "SELECT category, term, round(vif, 6) AS vif FROM terms WHERE position > 1",
        6,
    ),
    "tidy_coefficients": query(
        lambda s, d: models.tidy(_share_coefs(s, d), ["category"], "term").select(
            "category", "term", "estimate", "p_value", "p_adjusted", "p_text"
        ),
        with_ctes(EV_DAY, POINTS, AGE_SHARES, ADJUSTED) + """SELECT category, term, round(est, 6) AS estimate,
  round(p, 6) AS p_value, round(padj, 6) AS p_adjusted,
  CASE WHEN padj < 0.001 THEN '< 0.001' ELSE '= ' || regexp_replace(CAST(round(padj, 3) AS VARCHAR), '\\.0$', '') END AS p_text
FROM adjusted WHERE term <> '(intercept)'""",
        6,
    ),
    "tidy_coefficients_weak_dropped": query(
        lambda s, d: models.tidy(_share_coefs(s, d), ["category"], "term", 0.5).select(
            "category", "term", "p_value", "p_adjusted"
        ),
        with_ctes(EV_DAY, POINTS, AGE_SHARES, ADJUSTED) + """SELECT category, term, round(p, 6) AS p_value,
  round(padj, 6) AS p_adjusted FROM adjusted WHERE term <> '(intercept)' AND p < 0.5""",
        6,
    ),
    "predict_grid_by_category": query(
        _share_predict,
        with_ctes(EV_DAY, POINTS, AGE_SHARES) + """SELECT category, site, age, round(f, 6) AS n_frames, round(p, 6) AS predicted,
  round(p - h, 6) AS conf_low, round(p + h, 6) AS conf_high FROM (
  SELECT ab.category, ab.site, g.age, m.f, ay + ab.by * g.age + cf * (m.f - af - bf * g.age) AS p,
    1.959963984540054 * sqrt(s2 * (va + vb * (g.age * g.age - 2 * g.age * mx) + (m.f - af - bf * g.age) ** 2 / rff)) AS h
  FROM ab JOIN k USING (category) JOIN (SELECT category, avg(f) AS f FROM v GROUP BY category) m USING (category)
  JOIN (SELECT DISTINCT category, age FROM v) g USING (category))""",
        6,
    ),
    "linear_site_age": query(
        lambda s, d: models.coefficients(_totals_fit(s, d), "model").select(*COEF),
        with_ctes(OBS_ORDERS, POINTS, TOTALS) + f"""SELECT CAST(position AS BIGINT) AS position, term, round(est, 6) AS estimate,
  round(sqrt(var), 6) AS std_error, round(est / sqrt(var), 6) AS statistic,
  round({t_p('est / sqrt(var)', 'df')}, 6) AS p_value FROM terms""",
        6,
    ),
    "predict_grid": query(
        _totals_predict,
        with_ctes(OBS_ORDERS, TOTALS) + """SELECT site, age, round(p, 6) AS predicted, round(p - h, 6) AS conf_low, round(p + h, 6) AS conf_high FROM (
  SELECT site, g.age, a + b * g.age AS p, 1.959963984540054 * sqrt(s2 * (1 / n + (g.age - mx) ** 2 / sxx)) AS h
  FROM c, k, (SELECT DISTINCT age FROM v) g)""",
        6,
    ),
    "random_intercept": query(
        lambda s, d: models.coefficients(_category_fit(s, d), "model", normal=True).select("model", *COEF),
        with_ctes(*CATEGORY_FIT) + REML_OUT,
        6,
    ),
    "random_intercept_tidy": query(
        lambda s, d: models.tidy(
            models.coefficients(_category_fit(s, d), "model", normal=True).where("term <> '(intercept)'"),
            [], "model",
        ).select("model", "term", "estimate", "std_error", "p_adjusted", "p_text"),
        with_ctes(*CATEGORY_FIT) + """, scaled AS (
  SELECT *, least(1, p * (count(*) OVER () - row_number() OVER w + 1)) AS sp, row_number() OVER w AS o FROM tested
  WHERE term <> '(intercept)' WINDOW w AS (ORDER BY p, model)),
adjusted AS (SELECT *, max(sp) OVER (ORDER BY o ROWS UNBOUNDED PRECEDING) AS padj FROM scaled)
SELECT model, term, round(est, 6) AS estimate, round(se, 6) AS std_error, round(padj, 6) AS p_adjusted,
  CASE WHEN padj < 0.001 THEN '< 0.001' ELSE '= ' || regexp_replace(CAST(round(padj, 3) AS VARCHAR), '\\.0$', '') END AS p_text
FROM adjusted""",
        6,
    ),
    "random_intercept_age": query(
        lambda s, d: models.coefficients(_age_fit(s, d), "model", normal=True).select("model", *COEF),
        with_ctes(*AGE_FIT) + REML_OUT,
        6,
    ),
    "random_intercept_predict": query(
        _age_predict,
        with_ctes(*AGE_FIT) + """SELECT model, site, age, round(p, 6) AS predicted, round(p - h, 6) AS conf_low, round(p + h, 6) AS conf_high FROM (
  SELECT f.model, site, age, a + b * age AS p, 1.959963984540054 * sqrt(s2 * (1 / sw + (age - xb) ** 2 / dxx)) AS h
  FROM sided f JOIN (SELECT DISTINCT model, CAST(x AS BIGINT) AS age FROM v) g ON f.model = g.model)""",
        6,
    ),
}
