"""Tests and regressions from distributed sufficient statistics.

Spark aggregates the data to a few sums per model; the closing algebra runs on those
summary rows only.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.domain import Domain
from framewise.functions.tails import f_p, t_p, z_p
from framewise.functions.text import p_text
from framewise.operators.joins import null_safe_join
from framewise.operators.ordered import holm, running_total
from framewise.plans import rates

NORMAL_975 = 1.959963984540054


# ---------------------------------------------------------------- two-sample tests


def rank_sum(
    df: DataFrame,
    family: list[str],
    sample: str,
    levels: tuple[str, str],
    value: str,
    width: float | None = None,
) -> DataFrame:
    """Two-sample rank-sum test per family: normal approximation, ties and continuity
    corrected.

    Equal values collapse to one row first; the rank of a value is the running total of
    the counts below it, taken in slices of about equal row counts (or of ``width``).
    """
    known = df.where(F.col(sample).isin(*levels) & F.col(value).isNotNull())
    counts = (
        known.groupBy(*family, value)
        .agg(*[F.count_if(F.col(sample) == s).alias(f"_c{i}") for i, s in enumerate(levels)])
        .withColumn("_t", F.col("_c0") + F.col("_c1"))
    )
    placed = running_total(counts, family, value, "_t", width, known)
    rank = F.col("before") + (F.col("_t") + 1) / 2
    t = F.col("_t").cast("double")
    sums = placed.groupBy(*family).agg(
        F.sum("_c0").cast("double").alias("n1"),
        F.sum("_c1").cast("double").alias("n2"),
        F.sum(F.col("_c0") * rank).alias("_r1"),
        F.sum(t * t * t - t).alias("_ties"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    total = n1 + n2
    w = F.col("_r1") - n1 * (n1 + 1) / 2
    off = F.col("w") - n1 * n2 / 2
    spread = F.sqrt(
        n1 * n2 / 12 * (total + 1 - F.try_divide(F.col("_ties"), total * (total - 1)))
    )
    out = sums.withColumn("w", w).withColumn(
        "z", F.try_divide(off - F.signum(off) * 0.5, spread)
    )
    out = out.withColumn("p_value", z_p("z"))
    return out.select(
        *family, n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), "w", "z", "p_value"
    )


def variance_ratio(df: DataFrame, sample: str, levels: tuple[str, str], value: str) -> DataFrame:
    """F test of equal variances of two samples."""
    parts = [F.when(F.col(sample) == s, F.col(value)) for s in levels]
    sums = df.agg(
        *[F.var_samp(p).alias(f"_v{i}") for i, p in enumerate(parts)],
        *[(F.count(p) - 1).cast("double").alias(f"df{i + 1}") for i, p in enumerate(parts)],
    )
    out = sums.withColumn("f", F.try_divide("_v0", "_v1"))
    return out.select("f", "df1", "df2", f_p("f", "df1", "df2").alias("p_value"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation with t statistic, p-value and 95% interval (Fisher transform)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    base = df.where(both).agg(
        F.corr(x, y).alias("r"), F.count(F.lit(1)).cast("double").alias("n")
    )
    r, n = F.col("r"), F.col("n")
    out = base.withColumn("df", n - 2).withColumn(
        "t", r * F.sqrt(F.try_divide(n - 2, 1 - r * r))
    )
    half = F.lit(NORMAL_975) / F.sqrt(n - 3)
    return out.select(
        "r",
        n.cast("long").alias("n"),
        "t",
        t_p("t", "df").alias("p_value"),
        F.tanh(F.atanh(r) - half).alias("low"),
        F.tanh(F.atanh(r) + half).alias("high"),
    )


# ---------------------------------------------------------------- regressions


def site_by(name: str, sites: tuple[str, str], extra: tuple[str, ...] = ()) -> dict[str, Column]:
    """Terms of ``site * name + extra``: the first site is the baseline."""
    site = F.when(F.col("site") == sites[1], 1.0).when(F.col("site") == sites[0], 0.0)
    terms = {"(intercept)": F.lit(1.0), "site": site, name: F.col(name).cast("double")}
    terms.update({e: F.col(e).cast("double") for e in extra})
    terms[f"site:{name}"] = site * F.col(name).cast("double")
    return terms


FIT = (
    "terms array<string>, beta array<double>, cov array<double>, n double, df double, "
    "sigma2 double, tau2 double, vif array<double>"
)


def _design(df: DataFrame, keep: list[str], y: str, terms: dict[str, Column]) -> DataFrame:
    names = [f"_x{i}" for i in range(len(terms))]
    cols = [t.cast("double").alias(n) for n, t in zip(names, terms.values())]
    return df.select(*keep, F.col(y).cast("double").alias("_y"), *cols).dropna(subset=["_y", *names])


def _comoments(values: list[Column]) -> dict[str, Column]:
    """Means ``_m{i}`` and centred sums of products ``_c{i}_{j}`` of some columns.

    Covariances are merged around the means, so large means do not cancel digits.
    """
    n = F.count(F.lit(1)).cast("double")
    sums = {f"_m{i}": F.avg(v) for i, v in enumerate(values)}
    sums.update(
        {f"_c{i}_{j}": n * F.covar_pop(values[i], values[j]) for i in range(len(values)) for j in range(i, len(values))}
    )
    return sums | {"_n": n}


def _named(sums: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in sums.items()]


def _matrices(rows: pd.DataFrame, k: int, prefix: str = "_c") -> np.ndarray:
    """One symmetric k x k matrix per row."""
    m = np.empty((len(rows), k, k))
    for i in range(k):
        for j in range(i, k):
            m[:, i, j] = m[:, j, i] = rows[f"{prefix}{i}_{j}"].to_numpy()
    return m


def _usable(xx: np.ndarray) -> list[int]:
    """Columns that do not depend on earlier ones (later duplicates get no estimate)."""
    scale = np.sqrt(np.clip(np.diag(xx), 1e-300, None))
    c = xx / np.outer(scale, scale)
    kept: list[int] = []
    for j in range(len(c)):
        if c[j, j] <= 0:
            continue
        rest = c[j, j]
        if kept:
            rest -= c[j, kept] @ np.linalg.solve(c[np.ix_(kept, kept)], c[kept, j])
        if rest > 1e-10:
            kept.append(j)
    return kept


def _inflation(centred: np.ndarray) -> np.ndarray:
    """Variance inflation per term (the constant has none): diagonal of the inverse
    correlation matrix of the predictors, from their centred sums of products."""
    sd = np.sqrt(np.diag(centred))
    return np.concatenate([[np.nan], np.diag(np.linalg.inv(centred / np.outer(sd, sd)))])


def _spread_out(kept: list[int], k: int, values: np.ndarray) -> np.ndarray:
    out = np.full((k,) * values.ndim, np.nan)
    out[np.ix_(*[kept] * values.ndim)] = values
    return out


def _fit_row(names, kept, beta, cov, n, sigma2, tau2, centred) -> dict:
    k = len(names)
    full = len(kept) == k
    return {
        "terms": list(names),
        "beta": _spread_out(kept, k, beta).tolist(),
        "cov": _spread_out(kept, k, cov).ravel().tolist(),
        "n": n,
        "df": n - len(kept),
        "sigma2": sigma2,
        "tau2": tau2,
        "vif": (_inflation(centred) if full and k > 2 else np.full(k, np.nan)).tolist(),
    }


def linear_fit(df: DataFrame, y: str, terms: dict[str, Column], family: str) -> DataFrame:
    """Least squares per family: one pass to means and centred sums of products, solved per
    summary row.  The first term is the constant."""
    k, names = len(terms), list(terms)
    values = [*[F.col(f"_x{i}") for i in range(1, k)], F.col("_y")]
    sums = _design(df, [family], y, terms).groupBy(family).agg(*_named(_comoments(values)))

    def solve(batches):
        for batch in batches:
            rows = []
            for (_, r), both in zip(batch.iterrows(), _matrices(batch, k)):
                xx = both[:-1, :-1]
                kept, n = _usable(xx), r["_n"]
                mean, xy = np.array([r[f"_m{i}"] for i in kept], float), both[kept, -1]
                square = xx[np.ix_(kept, kept)]
                scale = np.sqrt(np.outer(np.diag(square), np.diag(square)))
                inverse = np.linalg.inv(square / scale) / scale
                slope, shift = inverse @ xy, inverse @ mean
                free = n - len(kept) - 1
                sigma2 = max(both[-1, -1] - slope @ xy, 0.0) / free if free > 0 else np.nan
                beta = np.concatenate([[r[f"_m{k - 1}"] - mean @ slope], slope])
                cov = np.block([[np.array([[1 / n + mean @ shift]]), -shift[None]], [-shift[:, None], inverse]])
                fit = _fit_row(names, [0, *[i + 1 for i in kept]], beta, sigma2 * cov, n, sigma2, 0.0, xx)
                rows.append({family: r[family], **fit})
            yield pd.DataFrame(rows, columns=[family, *[c.split()[0] for c in FIT.split(", ")]])

    return sums.mapInPandas(solve, f"{family} {sums.schema[family].dataType.simpleString()}, {FIT}")


class _Profile:
    """The restricted likelihood of one family as a function of the variance ratio theta.

    Variables are the constant, the predictors and the response, centred at the family's means.
    With weight w = n / (1 + n theta) for a subject of n rows, their weighted products are the
    sums within subjects plus w times the products of the subjects' means: nothing is subtracted.
    """

    def __init__(self, size: np.ndarray, count: np.ndarray, within: np.ndarray, between: np.ndarray):
        self.size, self.count, self.within, self.between = size, count, within, between
        self.rows, self.k = size @ count, within.shape[0] - 1

    def solve(self, theta: float) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
        weight = self.size / (1.0 + self.size * theta)
        both = self.within + np.tensordot(weight, self.between, 1)
        scale = np.sqrt(np.diag(both)[:-1])
        unit = np.linalg.inv(both[:-1, :-1] / np.outer(scale, scale))
        inverse = unit / np.outer(scale, scale)
        beta = inverse @ both[:-1, -1]
        rest = max(both[-1, -1] - beta @ both[:-1, -1], 1e-300)
        return weight, inverse, rest, beta

    def deviance(self, theta: float) -> float:
        _, inverse, rest, beta = self.solve(theta)
        free = self.rows - self.k
        return free * np.log(rest / free) + self.count @ np.log1p(self.size * theta) - np.linalg.slogdet(inverse)[1]

    def slope(self, theta: float) -> float:
        """Derivative of the deviance; the fixed effects are at their best, so theirs is zero."""
        weight, inverse, rest, beta = self.solve(theta)
        residual = np.append(-beta, 1.0)
        spread = np.einsum("i,gij,j->g", residual, self.between, residual)
        leverage = np.einsum("ij,gij->g", inverse, self.between[:, :-1, :-1])
        return self.count @ weight - weight**2 @ ((self.rows - self.k) / rest * spread + leverage)

    def best(self) -> float:
        """The theta >= 0 of least deviance: a scan, then bisection on the derivative.

        The scan widens while its least value is at an end; theta = 0 is compared on its own.
        """
        first, last = -12.0, 8.0
        while True:
            logs = np.arange(first, last + 0.125, 0.25)
            at = int(np.argmin([self.deviance(np.exp(s)) for s in logs]))
            if at == len(logs) - 1 and last < 100.0:
                last += 8.0
            elif at == 0 and first > -60.0:
                first -= 8.0
            else:
                break
        low, high = logs[max(at - 1, 0)], logs[min(at + 1, len(logs) - 1)]
        for _ in range(60):
            middle = (low + high) / 2.0
            if self.slope(np.exp(middle)) < 0:
                low = middle
            else:
                high = middle
        theta = float(np.exp((low + high) / 2.0))
        return theta if self.deviance(theta) < self.deviance(0.0) else 0.0


def _best_theta(parts: dict) -> float:
    """The variance ratio of one family from plain sums, not centred.

    ``xx, xy, yy`` are products summed over rows; ``sxx, sxy, syy`` are products of the subjects'
    sums, added up over the ``count`` subjects of each ``size``.
    """

    def products(xx: np.ndarray, xy: np.ndarray, yy: float) -> np.ndarray:
        return np.block([[xx, xy[:, None]], [xy[None, :], np.array([[yy]])]])

    size = parts["size"]
    between = np.array([products(*p) for p in zip(parts["sxx"], parts["sxy"], parts["syy"])]) / (size**2)[:, None, None]
    within = products(parts["xx"], parts["xy"], parts["yy"]) - np.tensordot(size, between, 1)
    return _Profile(size, parts["count"], within, between).best()


def random_intercept_fit(
    df: DataFrame, y: str, terms: dict[str, Column], family: str, subject: str = "subject"
) -> DataFrame:
    """Regression with one random intercept per subject, by restricted likelihood.

    Two aggregations: means and centred sums of products per subject, then the same of the
    subjects' means over all subjects with the same number of rows.  Both merge around means, so
    large means cost no digits.  The likelihood depends on the data only through that second table,
    whose length per family is the number of different subject sizes (at most about the square
    root of twice the row count).  A family without residual degrees of freedom has no estimate.
    """
    k, names = len(terms), list(terms)
    rows = _design(df, [family, subject], y, terms)
    values = [*[F.col(f"_x{i}") for i in range(1, k)], F.col("_y")]
    per_subject = rows.groupBy(family, subject).agg(*_named(_comoments(values)))
    means = {c: v for c, v in _comoments([F.col(f"_m{i}") for i in range(k)]).items()}
    count = means.pop("_n")
    by_size = per_subject.groupBy(family, F.col("_n").alias("_size")).agg(
        count.alias("_count"),
        *_named(means),
        *[F.sum(f"_c{i}_{j}").alias(f"_w{i}_{j}") for i in range(k) for j in range(i, k)],
    )

    def fit(sizes: pd.DataFrame) -> pd.DataFrame:
        size, count = (sizes[c].to_numpy(float) for c in ("_size", "_count"))
        n = size @ count
        mean = sizes[[f"_m{i}" for i in range(k)]].to_numpy(float)
        centre = (size * count) @ mean / n
        off = mean - centre
        within = np.zeros((k + 1, k + 1))
        within[1:, 1:] = _matrices(sizes, k, "_w").sum(axis=0)
        between = np.empty((len(sizes), k + 1, k + 1))
        between[:, 0, 0] = count
        between[:, 0, 1:] = between[:, 1:, 0] = count[:, None] * off
        between[:, 1:, 1:] = _matrices(sizes, k) + count[:, None, None] * off[:, :, None] * off[:, None, :]
        centred = within[1:, 1:] + np.tensordot(size, between[:, 1:, 1:], 1)
        kept = [0, *[i + 1 for i in _usable(centred[:-1, :-1])]]
        if n > len(kept):
            used = [*kept, k]
            profile = _Profile(size, count, within[np.ix_(used, used)], between[:, used][:, :, used])
            theta = profile.best()
            _, inverse, rest, beta = profile.solve(theta)
            sigma2 = rest / (n - len(kept))
            # back from centred predictors to the constant at zero
            back = np.eye(len(kept))
            back[0, 1:] = -centre[[i - 1 for i in kept[1:]]]
            beta, cov = back @ beta, sigma2 * back @ inverse @ back.T
            beta[0] += centre[-1]
        else:
            theta = sigma2 = np.nan
            beta, cov = np.full(len(kept), np.nan), np.full((len(kept), len(kept)), np.nan)
        row = _fit_row(names, kept, beta, cov, n, sigma2, theta * sigma2, centred[:-1, :-1])
        return pd.DataFrame([{family: sizes[family].iloc[0], **row}])

    kind = by_size.schema[family].dataType.simpleString()
    return by_size.groupBy(family).applyInPandas(fit, f"{family} {kind}, {FIT}")


def coefficients(fit: DataFrame, family: str, normal: bool = False) -> DataFrame:
    """One row per term: estimate, standard error, statistic and two-sided p-value.

    ``normal=True`` refers the statistic to the normal law (random-intercept fits).
    """
    width = F.size("terms")
    rows = fit.select(
        family,
        "terms",
        "beta",
        "cov",
        "vif",
        "df",
        F.explode(F.sequence(F.lit(0), width - 1)).alias("_i"),
        width.alias("_k"),
    )
    i = F.col("_i")
    known = F.nanvl(F.get("beta", i), F.lit(None))
    error = F.sqrt(F.nanvl(F.get("cov", i * F.col("_k") + i), F.lit(None)))
    rows = rows.select(
        family,
        (i + 1).alias("position"),
        F.get("terms", i).alias("term"),
        known.alias("estimate"),
        error.alias("std_error"),
        F.try_divide(known, error).alias("statistic"),
        "df",
        F.nanvl(F.get("vif", i), F.lit(None)).alias("vif"),
    )
    p = z_p("statistic") if normal else t_p("statistic", "df")
    return rows.withColumn("p_value", p)


def tidy(
    coefs: DataFrame, family: list[str], tests: str, p_below: float | None = None
) -> DataFrame:
    """Adjust p-values within ``family`` (intercepts included), then drop intercepts and,
    on request, weak terms, and add the report text."""
    adjusted = holm(coefs, "p_value", family, tests)
    rows = adjusted.where(F.col("term") != "(intercept)")
    if p_below is not None:
        rows = rows.where(F.col("p_value") < p_below)
    return rows.withColumn("p_text", p_text(F.col("p_adjusted")))


def predict(fit: DataFrame, grid: DataFrame, terms: dict[str, Column], family: str) -> DataFrame:
    """Fitted value and 95% interval at every grid row of the family."""
    vector = F.array(*[t.cast("double") for t in terms.values()])
    rows = null_safe_join(grid.withColumn("_x", vector), fit.select(family, "beta", "cov"), [family], "inner")

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)

    k = len(terms)
    spread = F.aggregate(
        F.zip_with(
            F.sequence(F.lit(0), F.lit(k - 1)),
            F.col("_x"),
            lambda i, v: v * dot(F.slice(F.col("cov"), i * k + 1, F.lit(k)), F.col("_x")),
        ),
        F.lit(0.0),
        lambda s, v: s + v,
    )
    half = F.lit(NORMAL_975) * F.sqrt(spread)
    fitted = dot(F.col("beta"), F.col("_x"))
    return rows.select(
        *grid.columns,
        fitted.alias("predicted"),
        (fitted - half).alias("conf_low"),
        (fitted + half).alias("conf_high"),
    )


def prediction_grid(df: DataFrame, sites: tuple[str, str], family: str, means: tuple[str, ...] = ()) -> DataFrame:
    """Every site at each distinct age of the family; other predictors at their mean.

    Ages unfold beside the literal list of sites; the means come from one aggregate row
    per family.
    """
    ages = df.select(family, "age").distinct()
    grid = ages.select(family, F.explode(F.array(*[F.lit(s) for s in sites])).alias("site"), "age")
    if not means:
        return grid
    return null_safe_join(grid, df.groupBy(family).agg(*[F.avg(m).alias(m) for m in means]), [family], "inner")


# ---------------------------------------------------------------- model inputs


def category_model_rows(frame: DataFrame, domain: Domain) -> DataFrame:
    """The model frame once per category, with that category's 0/1 ``target`` column."""
    rows = frame.select("site", "subject", "category", "n_items")
    rows = rows.select(*rows.columns, domain.explode_categories().alias("model"))
    return rows.withColumn("target", (F.col("category") == F.col("model")).cast("double"))


def age_model_rows(view: DataFrame) -> DataFrame:
    """The four hourly measures stacked as ``model, site, subject, age, y``."""
    measures = {
        "items_per_hour": rates.per_hour(view, "item"),
        "categories_per_hour": rates.per_hour(view, "category"),
        "item_transitions": rates.transition_rate(view, "item"),
        "category_transitions": rates.transition_rate(view, "category"),
    }
    stacked = [
        m.select(F.lit(name).alias("model"), "site", "subject", "age", F.col("y").cast("double").alias("y"))
        for name, m in measures.items()
    ]
    return reduce(DataFrame.unionByName, stacked)
