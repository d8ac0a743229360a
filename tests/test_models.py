import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.functions import tails
from framewise.plans import models

SITES = ("T", "R")


def data(seed, subjects=24, spread=1.5):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(subjects):
        site, age, shift = SITES[s % 2], float(rng.integers(0, 48)), rng.normal(0, spread)
        for _ in range(rng.integers(1, 9)):
            y = 2 + 0.1 * age + (s % 2) * (1 - 0.05 * age) + shift + rng.normal(0, 1)
            rows.append(("m", site, s, age, float(rng.integers(1, 600)), float(y)))
    return rows


DDL = "model string, site string, subject int, age double, n_frames double, y double"


def design(rows, extra=False):
    site = np.array([r[1] == "R" for r in rows], float)
    age, n = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    columns = [np.ones(len(rows)), site, age] + ([n] if extra else []) + [site * age]
    return np.column_stack(columns), np.array([r[5] for r in rows])


def coef(df, **options):
    return {r["term"]: r for r in models.coefficients(df, "model", **options).collect()}


def test_least_squares_against_dense_algebra(spark):
    rows = data(1)
    df = spark.createDataFrame(rows, DDL).unionByName(spark.createDataFrame([("m", "T", 1, None, 1.0, 1.0)], DDL))
    terms = models.site_by("age", SITES, ("n_frames",))
    got = coef(models.linear_fit(df, "y", terms, "model"))
    x, y = design(rows, extra=True)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    free = len(y) - x.shape[1]
    sigma2 = ((y - x @ beta) ** 2).sum() / free
    error = np.sqrt(sigma2 * np.diag(np.linalg.inv(x.T @ x)))
    for i, name in enumerate(terms):
        assert got[name]["estimate"] == pytest.approx(beta[i], rel=1e-8)
        assert got[name]["std_error"] == pytest.approx(error[i], rel=1e-8)
        assert got[name]["p_value"] == pytest.approx(tails.t_two_sided(beta[i] / error[i], free), abs=1e-9)
    corr = np.corrcoef(x[:, 1:].T)
    for i, name in enumerate(list(terms)[1:]):
        assert got[name]["vif"] == pytest.approx(np.linalg.inv(corr)[i, i], rel=1e-7)


@pytest.mark.parametrize("far", [1e4, 1e6])
def test_least_squares_far_from_zero(spark, far):
    rows = data(1)
    terms = {"(intercept)": F.lit(1.0), "age": F.col("age"), "n_frames": F.col("n_frames")}
    near = spark.createDataFrame(rows, DDL)
    moved = near.withColumns({"age": F.col("age") + far, "y": F.col("y") + far})
    want, got = (coef(models.linear_fit(df, "y", terms, "model")) for df in (near, moved))
    for name in ("age", "n_frames"):
        for field in ("estimate", "std_error", "p_value", "vif"):
            assert got[name][field] == pytest.approx(want[name][field], rel=1e-6, abs=1e-12)
    x = np.column_stack([np.ones(len(rows)), [r[3] for r in rows], [r[4] for r in rows]])
    beta = np.linalg.lstsq(x, np.array([r[5] for r in rows]), rcond=None)[0]
    assert got["(intercept)"]["estimate"] == pytest.approx(beta[0] + far - beta[1] * far, rel=1e-9)


def test_dependent_columns_get_no_estimate(spark):
    rows = [r for r in data(2) if r[1] == "T"]
    got = coef(models.linear_fit(spark.createDataFrame(rows, DDL), "y", models.site_by("age", SITES), "model"))
    assert got["site"]["estimate"] is None and got["site:age"]["p_value"] is None
    assert got["age"]["estimate"] is not None


def dense_reml(rows, theta):
    x, y = design(rows)
    subject = np.array([r[2] for r in rows])
    v = np.eye(len(y)) + theta * (subject[:, None] == subject[None, :])
    vi = np.linalg.inv(v)
    a = x.T @ vi @ x
    beta = np.linalg.solve(a, x.T @ vi @ y)
    free = len(y) - x.shape[1]
    sigma2 = (y - x @ beta) @ vi @ (y - x @ beta) / free
    deviance = free * np.log(sigma2) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1]
    return deviance, beta, np.sqrt(sigma2 * np.diag(np.linalg.inv(a))), sigma2


@pytest.mark.parametrize("seed, spread", [(3, 1.5), (4, 0.4), (5, 0.0)])
def test_random_intercept_against_dense_likelihood(spark, seed, spread):
    rows = data(seed, spread=spread)
    fit = models.random_intercept_fit(spark.createDataFrame(rows, DDL), "y", models.site_by("age", SITES), "model")
    row = fit.first()
    theta = row["tau2"] / row["sigma2"]
    deviance, beta, error, sigma2 = dense_reml(rows, theta)
    grid = [0.0, *np.exp(np.linspace(-9, 4, 400))]
    assert deviance <= min(dense_reml(rows, t)[0] for t in grid) + 1e-6
    got = coef(fit, normal=True)
    assert row["sigma2"] == pytest.approx(sigma2, rel=1e-7)
    for i, name in enumerate(models.site_by("age", SITES)):
        assert got[name]["estimate"] == pytest.approx(beta[i], rel=1e-6, abs=1e-9)
        assert got[name]["std_error"] == pytest.approx(error[i], rel=1e-6)
        assert got[name]["p_value"] == pytest.approx(tails.normal_two_sided(beta[i] / error[i]), abs=1e-9)


@pytest.mark.parametrize("far", [1e4, 1e6])
def test_random_intercept_far_from_zero(spark, far):
    rows = data(3)
    near = spark.createDataFrame(rows, DDL)
    moved = near.withColumns({"age": F.col("age") + far, "y": F.col("y") + far})
    terms = models.site_by("age", SITES)
    a, b = (coef(models.random_intercept_fit(df, "y", terms, "model"), normal=True) for df in (near, moved))
    for name in ("age", "site:age"):
        for what in ("estimate", "std_error", "p_value"):
            # at 1e6 the site and its product with age differ by 4e-10 of their variance
            assert b[name][what] == pytest.approx(a[name][what], rel=1e-6 if far < 1e6 else 5e-6, abs=1e-9)
    slope, inter = a["age"]["estimate"], a["site:age"]["estimate"]
    assert b["site"]["estimate"] == pytest.approx(a["site"]["estimate"] - inter * far, rel=5e-6)
    assert b["(intercept)"]["estimate"] == pytest.approx(a["(intercept)"]["estimate"] + far - slope * far, rel=5e-6)


def test_a_family_of_null_is_predicted(spark):
    df = spark.createDataFrame(data(4), DDL).withColumn("model", F.lit(None).cast("string"))
    terms = models.site_by("age", SITES)
    grid = models.prediction_grid(df, SITES, "model", ("n_frames",))
    assert grid.count() == 2 * df.select("age").distinct().count()
    assert models.predict(models.linear_fit(df, "y", terms, "model"), grid, terms, "model").count() == grid.count()


def test_prediction_grid_and_interval(spark):
    rows = data(6)
    df = spark.createDataFrame(rows, DDL)
    terms = models.site_by("age", SITES, ("n_frames",))
    grid = models.prediction_grid(df, SITES, "model", ("n_frames",))
    assert grid.count() == 2 * len({r[3] for r in rows})
    out = models.predict(models.linear_fit(df, "y", terms, "model"), grid, terms, "model").collect()
    x, y = design(rows, extra=True)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    cov = ((y - x @ beta) ** 2).sum() / (len(y) - 5) * np.linalg.inv(x.T @ x)
    mean = np.mean([r[4] for r in rows])
    for r in out:
        s = float(r["site"] == "R")
        point = np.array([1, s, r["age"], mean, s * r["age"]])
        half = 1.959963984540054 * np.sqrt(point @ cov @ point)
        assert r["predicted"] == pytest.approx(point @ beta, rel=1e-7)
        assert r["conf_high"] - r["predicted"] == pytest.approx(half, rel=1e-7)


def test_rank_sum_against_counting(spark):
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 12, 40), rng.integers(2, 14, 33)
    rows = [("T", float(v)) for v in a] + [("R", float(v)) for v in b]
    out = models.rank_sum(spark.createDataFrame(rows, "site string, y double"), [], "site", SITES, "y", 3.0).first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert out["w"] == u and (out["n1"], out["n2"]) == (40, 33)
    n = 73
    ties = sum(c ** 3 - c for c in np.unique(np.concatenate([a, b]), return_counts=True)[1])
    sigma = np.sqrt(40 * 33 / 12 * (n + 1 - ties / (n * (n - 1))))
    off = u - 40 * 33 / 2
    assert out["z"] == pytest.approx((off - np.sign(off) * 0.5) / sigma)
    assert out["p_value"] == pytest.approx(tails.normal_two_sided(out["z"]))


def test_rank_sum_of_equal_values_has_no_p(spark):
    df = spark.createDataFrame([("T", 1.0), ("R", 1.0)], "site string, y double")
    assert models.rank_sum(df, [], "site", SITES, "y", 1.0).first()["p_value"] is None


def test_pearson_and_variance_ratio(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=50)
    y = 0.6 * x + rng.normal(size=50)
    df = spark.createDataFrame([(SITES[i % 2], float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "site string, x double, y double")
    out = models.pearson(df, "x", "y").first()
    r = np.corrcoef(x, y)[0, 1]
    t = r * np.sqrt(48 / (1 - r * r))
    assert out["r"] == pytest.approx(r) and out["p_value"] == pytest.approx(tails.t_two_sided(t, 48))
    assert out["low"] == pytest.approx(np.tanh(np.arctanh(r) - 1.959963984540054 / np.sqrt(47)))
    f = models.variance_ratio(df, "site", SITES, "y").first()
    ratio = np.var(y[::2], ddof=1) / np.var(y[1::2], ddof=1)
    assert f["f"] == pytest.approx(ratio) and f["p_value"] == pytest.approx(tails.f_two_sided(ratio, 24, 24))


def test_tidy_adjusts_before_dropping(make):
    coefs = make("model string, term string, estimate double, p_value double",
                 ("m", "(intercept)", 1.0, 0.00001), ("m", "site", -0.5, 0.02), ("m", "age", 0.1, 0.3), ("m", "site:age", 0.0, 0.04))
    rows = {r["term"]: r for r in models.tidy(coefs, ["model"], "term", 0.1).collect()}
    assert set(rows) == {"site", "site:age"}
    assert rows["site"]["p_adjusted"] == pytest.approx(0.06) and rows["site"]["p_text"] == "= 0.06"
    assert rows["site:age"]["p_adjusted"] == pytest.approx(0.08)


def test_category_model_rows(make, values):
    from framewise.domain import Domain

    frame = make("site string, subject int, category string, n_items int", ("T", 1, "C", 2), ("T", 1, "S", 1))
    out = models.category_model_rows(frame, Domain(sites=SITES, categories=("C", "S")))
    assert values(out, "model", "category", "target") == [("C", "C", 1.0), ("C", "S", 0.0), ("S", "C", 0.0), ("S", "S", 1.0)]
    assert out.agg(F.sum("target")).first()[0] == 2.0


def test_random_intercept_without_residual_degrees_has_no_estimate(spark):
    rows = [r for r in data(3) if r[2] < 4]
    firsts = list({r[2]: r for r in rows}.values())
    fit = models.random_intercept_fit(spark.createDataFrame(firsts, DDL), "y", models.site_by("age", SITES), "model")
    got = coef(fit, normal=True)
    assert len(got) == 4 and all(r["estimate"] is None and r["std_error"] is None for r in got.values())


def test_variance_ratio_beyond_the_first_scan():
    """Subjects far apart with hardly any noise inside: the optimum lies above e^8."""
    rng = np.random.default_rng(4)
    m, n = 40, 5
    y = rng.normal(0, 1000, m)[:, None] + rng.normal(0, 1, (m, n))
    sums = y.sum(1)
    parts = {
        "size": np.array([float(n)]), "count": np.array([float(m)]), "n": float(m * n),
        "xx": np.array([[float(m * n)]]), "xy": np.array([y.sum()]), "yy": float((y * y).sum()),
        "sxx": np.array([[[float(m * n * n)]]]), "sxy": np.array([[n * sums.sum()]]), "syy": np.array([(sums * sums).sum()]),
    }
    inside = ((y - y.mean(1, keepdims=True)) ** 2).sum() / (m * (n - 1))
    between = n * y.mean(1).var(ddof=1)
    assert models._best_theta(parts) == pytest.approx((between / inside - 1) / n, rel=1e-4)
