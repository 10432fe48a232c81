"""Closed-form statistics against published values and plain formulas."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import special
from lectern.functions.special import Spark
from lectern.operators import mixed, stats


def one(spark, expr):
    c = F.expr(expr) if isinstance(expr, str) else expr
    return spark.range(1).select(c.alias("v")).first().v


@pytest.mark.parametrize("z", [0.3, 1.0, 1.96, 3.0, 4.5, 6.8, 9.0, 12.0])
def test_normal_tail(spark, z):
    assert one(spark, special.normal_two_sided(Spark, f"{z}D")) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-10)


@pytest.mark.parametrize(("df", "x", "p"), [(3, 47.3324996762, 2.9532413e-10), (3, 5.8561151079, 0.1188242812), (1, 3.841458820694124, 0.05), (24, 36.41502850180731, 0.05)])
def test_chi_square_tail(spark, df, x, p):
    assert one(spark, special.chi2_upper(Spark, df, f"{x}D")) == pytest.approx(p, rel=1e-7)


@pytest.mark.parametrize(("f", "a", "b", "p"), [(18.6, 2, 6, 0.0026791838134430724), (1.0, 5, 5, 0.5), (4.964602743730711, 1, 10, 0.05)])
def test_f_tail(spark, f, a, b, p):
    assert one(spark, special.f_upper(Spark, f"{f}D", str(a), str(b))) == pytest.approx(p, rel=1e-8)


def row(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


@pytest.mark.parametrize(("x", "n", "low", "high"), [(49, 60, 0.7008024625, 0.8944220311), (5, 40, 0.0545950025, 0.2611211984), (0, 10, 0.0, 0.2775327999), (0, 0, 0.0, 1.0)])
def test_wilson(spark, x, n, low, high):
    r = row(spark, x=x, n=n).select(*stats.wilson("x", "n")).first()
    assert r[0] == pytest.approx(low, abs=1e-9) and r[1] == pytest.approx(high, abs=1e-9)


def test_wilson_stays_inside(spark):
    df = spark.createDataFrame([(x, n) for n in (1, 2, 7, 50) for x in range(n + 1)], ["x", "n"])
    low, high = stats.wilson("x", "n")
    for r in df.select("x", "n", low.alias("l"), high.alias("h")).collect():
        assert 0 <= r.l <= r.x / r.n + 1e-12 and r.x / r.n - 1e-12 <= r.h <= 1


@pytest.mark.parametrize(("a", "low", "high"), [((49, 60, 5, 40), 0.5459526813, 0.7841354772), ((28, 45, 18, 55), 0.1302215855, 0.4385690759), ((28, 45, 27, 45), -0.1432511947, 0.1860029429)])
def test_newcombe(spark, a, low, high):
    df = row(spark, xa=a[0], na=a[1], xb=a[2], nb=a[3])
    r = df.select(*stats.newcombe("xa", "na", "xb", "nb")).first()
    assert r[0] == pytest.approx(low, abs=1e-7) and r[1] == pytest.approx(high, abs=1e-7)
    s = df.select(*stats.newcombe("xb", "nb", "xa", "na")).first()
    assert s[0] == pytest.approx(-r[1]) and s[1] == pytest.approx(-r[0])


def kappa(spark, a, b, weighted=False):
    from lectern.plans import agreement

    df = spark.createDataFrame([("k", int(x), int(y)) for x, y in zip(a, b)], "key string, a int, b int")
    return (agreement.weighted_kappa if weighted else agreement.kappa)(df, ["key"]).first().kappa


def test_kappa(spark):
    assert kappa(spark, "1110001010", "1100011010") == pytest.approx(0.6)
    assert kappa(spark, [1, 1, 1], [1, 1, 1]) == 1.0
    assert kappa(spark, (-2, -1, 0, 1, 2, 2, 0, -1), (-2, 0, 0, 1, 1, 2, 0, -2), True) == pytest.approx(0.8965517241)
    # weights go by the place among the labels that occur
    assert kappa(spark, (-2, -2, 2, 2, -1), (-2, 2, 2, 2, -1), True) == pytest.approx(0.5)


def naive_logit_loss(beta, u, var, x, g, y):
    eta = x @ beta + u[g]
    return (np.logaddexp(0, eta) - y * eta).sum() + 0.5 * (u * u).sum() / var


def test_mixed_logit_counts_as_rows():
    rng = np.random.default_rng(4)
    n, k = 1500, 12
    g = rng.integers(0, k, n)
    x = np.column_stack([np.ones(n), rng.integers(0, 2, n)])
    true_u = rng.normal(0, 0.7, k)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ [-0.5, 0.8] + true_u[g])))).astype(float)
    rows = mixed.fit(x, g, np.ones(n), y)
    key, at = np.unique(np.column_stack([g, x[:, 1]]), axis=0, return_inverse=True)
    cells = mixed.fit(np.column_stack([np.ones(len(key)), key[:, 1]]), key[:, 0].astype(int), np.bincount(at).astype(float), np.bincount(at, y))
    assert np.allclose(rows["beta"], cells["beta"], atol=1e-8) and rows["var"] == pytest.approx(cells["var"], abs=1e-8)
    assert abs(rows["beta"][1] - 0.8) < 0.4
    # the intercepts are the penalised optimum given the rest
    base = naive_logit_loss(rows["beta"], rows["u"], rows["var"], x, g, y)
    for d in (-0.05, 0.05):
        moved = rows["u"].copy()
        moved[3] += d
        assert naive_logit_loss(rows["beta"], moved, rows["var"], x, g, y) > base


def test_auroc():
    assert mixed.auroc(np.array([0.1, 0.4, 0.35, 0.8]), np.ones(4), np.array([0, 0, 1, 1.0])) == 0.75
    assert math.isnan(mixed.auroc(np.array([0.1]), np.ones(1), np.ones(1)))
    assert mixed.auroc(np.array([0.5, 0.5]), np.array([2.0, 2.0]), np.array([1.0, 1.0])) == 0.5


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=2, max_size=6))
def test_icc_bounds(values):
    var = np.var(values) + 1e-4
    assert 0 < var / (var + math.pi**2 / 3) < 1


@pytest.mark.parametrize("p", [1e-6, 0.01, 0.025, 0.3, 0.5, 0.95, 0.975, 0.99999])
def test_normal_quantile(spark, p):
    from statistics import NormalDist

    assert one(spark, special.normal_quantile(Spark, f"{p!r}D")) == pytest.approx(NormalDist().inv_cdf(p), rel=2e-9, abs=2e-9)


def test_normal_quantile_outside(spark):
    assert one(spark, special.normal_quantile(Spark, "0D")) is None and one(spark, special.normal_quantile(Spark, "1D")) is None


def test_multiplicity_rules(spark):
    """Step-up and step-down control on textbook p values."""
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205]
    m = len(p)
    up = max(k for k in range(1, m + 1) if p[k - 1] <= 0.1 * k / m)
    down = next(k for k in range(1, m + 1) if p[k - 1] > 0.05 / (m - k + 1)) - 1
    assert (up, down) == (7, 1)
