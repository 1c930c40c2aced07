"""Statistics against numpy."""

import math

import numpy as np
import pandas as pd
import pytest

from ledgerlark.functions import tdist
from ledgerlark.operators import report, stats


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(11)
    n = 400
    q = np.array([f"{2019 + i // 4}Q{i % 4 + 1}" for i in range(8)])[rng.integers(0, 8, n)]
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    y = 0.3 * x1 - 0.1 * x2 + rng.normal(size=n)
    df = pd.DataFrame({"ticker": [f"T{i % 7}" for i in range(n)], "i": range(n), "filing_quarter": q, "x1": x1, "x2": x2, "y": y})
    df.loc[5, "x1"] = np.nan
    return df


@pytest.fixture(scope="module")
def panel(spark, frame):
    return spark.createDataFrame(frame)


def hac(X, u, lags):
    g = X * u[:, None]
    S = g.T @ g
    for k in range(1, lags + 1):
        G = g[k:].T @ g[:-k]
        S += (1 - k / (lags + 1)) * (G + G.T)
    return S


def test_ols_with_hac_errors(panel, frame):
    coefs, fit = stats.ols(panel, "y", ["x1"], ["x2"], order=["ticker", "i"])
    df = frame.dropna(subset=["x1", "x2", "y"]).sort_values(["ticker", "i"])
    Z = (df[["x1", "x2"]] - df[["x1", "x2"]].mean()) / (df[["x1", "x2"]].std() + 1e-12)
    d = pd.get_dummies(df["filing_quarter"], drop_first=True).astype(float)
    X = np.column_stack([np.ones(len(df)), Z, d])
    beta = np.linalg.lstsq(X, df["y"], rcond=None)[0]
    u = (df["y"] - X @ beta).to_numpy()
    inv = np.linalg.inv(X.T @ X)
    se = np.sqrt(np.diag(inv @ hac(X, u, 5) @ inv))
    got = coefs.toPandas()
    assert list(got["term"]) == ["const", "x1", "x2", *[f"q_{c}" for c in d.columns]]
    np.testing.assert_allclose(got["coef"], beta, atol=1e-9)
    np.testing.assert_allclose(got["std_err"], se, atol=1e-9)
    r = fit.first()
    assert r["n"] == 399 and r["r_squared"] == pytest.approx(1 - u @ u / ((df["y"] - df["y"].mean()) ** 2).sum())


def test_ols_needs_rows(panel):
    with pytest.raises(ValueError):
        stats.ols(panel.limit(11), "y", ["x1"], ["x2"], order=["i"])
    with pytest.raises(ValueError):
        stats.ols(panel, "y", ["absent"])


def test_newey_west(spark):
    y = np.random.default_rng(2).normal(0.3, 1, 40)
    got = stats.newey_west(spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "i int, v double"), "v", ["i"]).first()
    se = math.sqrt(hac(np.ones((40, 1)), y - y.mean(), 5)[0, 0]) / 40
    assert got["se"] == pytest.approx(se) and got["t_stat"] == pytest.approx(y.mean() / se)
    assert stats.newey_west_array(y, 5)[0] == pytest.approx(got["t_stat"])
    few = stats.newey_west(spark.createDataFrame([(1, 1.0), (2, 2.0)], "i int, v double"), "v", ["i"]).first()
    assert few["t_stat"] is None


def test_fama_macbeth(panel, frame):
    got = {r["variable"]: r for r in stats.fama_macbeth(panel, "y", ["x1", "x2"]).collect()}
    slopes = []
    for _, g in sorted(frame.dropna().groupby("filing_quarter")):
        if len(g) >= 10:
            Z = (g[["x1", "x2"]] - g[["x1", "x2"]].mean()) / g[["x1", "x2"]].std(ddof=0)
            slopes.append(np.linalg.lstsq(np.column_stack([np.ones(len(g)), Z]), g["y"], rcond=None)[0][1:])
    s = np.array(slopes)
    assert got["x1"]["mean_coef"] == pytest.approx(s[:, 0].mean(), abs=1e-6) and got["x2"]["std_coef"] == pytest.approx(s[:, 1].std(ddof=1), abs=1e-6)
    assert got["x1"]["n_periods"] == len(s) and 0 <= got["x1"]["p_value"] <= 1


def test_periods_under_ten_rows_are_skipped(spark):
    rows = [("a", float(i), float(i * i)) for i in range(9)] + [("b", float(i), float(i * i)) for i in range(10)]
    assert [r["period"] for r in stats.period_slopes(spark.createDataFrame(rows, "q string, x double, y double"), "y", ["x"], "q").collect()] == ["b"]


def test_quantile_bins(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 7)], "x double")
    assert [r["quantile"] for r in stats.quantile_bin(df, "x", 3).orderBy("x").collect()] == [1, 1, 2, 2, 3, 3]
    assert [r["quantile"] for r in stats.quantile_bin(df, "x", 3).orderBy("x").collect()] == [1, 1, 2, 2, 3, 3]
    tied = spark.createDataFrame([(0.0,)] * 5 + [(1.0,)], "x double")
    with pytest.raises(ValueError):
        stats.quantile_bin(tied, "x", 3)
    assert {r["quantile"] for r in stats.quantile_bin(tied, "x", 3, on_ties="merge").collect()} == {1}


def test_event_study(panel, frame, spark):
    s = stats.event_study(panel, "x1", "y")
    df = frame.dropna(subset=["x1", "y"])
    q = pd.qcut(df["x1"], 3, labels=[1, 2, 3])
    np.testing.assert_allclose(s.quantile_means, df.groupby(q, observed=True)["y"].mean().to_numpy())
    assert s.quantile_counts == df.groupby(q, observed=True)["y"].count().tolist() and s.spread == pytest.approx(s.quantile_means[2] - s.quantile_means[0])
    assert 0 <= s.p_value <= 1
    assert stats.event_study(panel.limit(14), "x1", "y").quantile_means == []
    w = stats.event_study(panel.drop("filing_quarter"), "x1", "y")
    a, b = df["y"][q == 3], df["y"][q == 1]
    assert w.t_stat == pytest.approx((a.mean() - b.mean()) / math.sqrt(a.var() / len(a) + b.var() / len(b)))
    assert report.event_study_table(s, panel).count() == 3


def test_correlation_uses_pairs_and_skips_nan(panel, frame):
    got = {(r["feature_a"], r["feature_b"]): r["corr"] for r in stats.correlation(panel, ["x1", "y", "absent"]).collect()}
    assert got["x1", "y"] == pytest.approx(frame["x1"].corr(frame["y"])) and len(got) == 3


def test_histogram_covers_all_rows(panel, frame):
    h = stats.histogram(panel, "x1", 10).orderBy("bin").collect()
    want, edges = np.histogram(frame["x1"].dropna(), 10)
    assert [r["n"] for r in h] == want.tolist() and h[0]["low"] == pytest.approx(edges[0]) and h[-1]["high"] == pytest.approx(edges[-1])


def test_t_distribution():
    for t in (0.1, 1.0, 2.5, 30.0):
        assert tdist.two_sided_p(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), abs=1e-12)
        assert tdist.two_sided_p(-t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-12)
    assert tdist.quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert math.isnan(tdist.two_sided_p(math.nan, 3))


def test_reports_on_missing_columns(spark):
    df = spark.createDataFrame([("A",)], "ticker string")
    assert report.sector_breakdown(df).count() == 0 and report.summary_stats(df).count() == 0


def test_stars(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0.005,), (0.03,), (0.07,), (0.5,)], "p double")
    assert [r[0] for r in df.select(stats.stars(F.col("p"))).collect()] == ["***", "**", "*", ""]


def test_exact_quantiles_of_many_rows(spark, monkeypatch):
    """The narrowing beyond SMALL rows, with ties, a value that half the rows hold, and a heavy tail."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.pareto(1.0, 3000), np.full(4000, 2.5), rng.normal(size=1000)])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    shares = [0.0, 0.1, 1 / 3, 0.5, 2 / 3, 0.977, 1.0]
    want = np.quantile(x, shares)
    assert stats.exact_quantiles(df, "x", shares) == pytest.approx(want)
    monkeypatch.setattr(stats, "SMALL", 50)
    monkeypatch.setattr(stats, "ACCURACY", 100)
    assert stats.exact_quantiles(df, "x", shares) == pytest.approx(want)
    got = stats.summary(df, ["x"]).first()
    assert (got["p25"], got["median"], got["p75"]) == pytest.approx(tuple(np.quantile(x, [0.25, 0.5, 0.75])))
    assert stats.exact_quantiles(df.where("x > 1e300"), "x", [0.5]) == []


def test_correlated_features_are_the_fixed_ones():
    names = report.CORRELATED
    assert len(names) == 16 and names.index("stat_1a_vocabulary_richness") == names.index("stat_1a_fog_index") + 1 and "trailing_vol_63d" not in names
