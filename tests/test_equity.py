"""Windows against pandas, as-of joins, rolling totals against brute force."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import deltas, equity, rolling


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(3)
    days = pd.bdate_range("2020-01-01", periods=150)
    return pd.DataFrame(np.exp(np.cumsum(rng.normal(0, 0.02, (150, 3)), 0)) * 50, index=days, columns=["SPY", "AAA", "BBB"])


@pytest.fixture(scope="module")
def prices(spark, wide):
    rows = [(d.date(), t, float(wide.loc[d, t])) for d in wide.index for t in wide.columns]
    return spark.createDataFrame(rows, "dt date, ticker string, close double")


def pivot(df, value):
    p = df.select("dt", "ticker", value).toPandas()
    p["dt"] = pd.to_datetime(p["dt"])
    return p.pivot(index="dt", columns="ticker", values=value)


@pytest.mark.parametrize("w", [1, 5])
def test_forward_returns(prices, wide, w):
    lr = np.log(wide / wide.shift(1))
    want = lr.rolling(w, min_periods=w).sum().shift(-w)
    got = pivot(equity.compute_returns(prices, (w,)), f"ret_{w}d")
    np.testing.assert_allclose(got[["AAA", "BBB", "SPY"]].to_numpy(float), want[["AAA", "BBB", "SPY"]].to_numpy(), atol=1e-12)


def test_abnormal_returns(prices, wide):
    lr = np.log(wide / wide.shift(1))
    er = lr[["AAA", "BBB"]].sub(lr["SPY"], axis=0)
    want = er.rolling(5, min_periods=5).sum().shift(-5)
    got = pivot(equity.compute_abnormal_returns(prices, (5,)), "abret_5d")
    assert list(got.columns) == ["AAA", "BBB"]
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(), atol=1e-12)


def test_volatility(prices, wide):
    lr = np.log(wide / wide.shift(1))
    trailing = lr.rolling(20, min_periods=10).std() * math.sqrt(252)
    out = equity.compute_realized_vol(prices, 20)
    np.testing.assert_allclose(pivot(out, "trailing_vol_20d")[list(wide)].to_numpy(float), trailing.to_numpy(), atol=1e-10)
    np.testing.assert_allclose(pivot(out, "forward_vol_20d")[list(wide)].to_numpy(float), trailing.shift(-20).to_numpy(), atol=1e-10)


def test_fill_and_valid_prices(spark):
    at = lambda h: dt.datetime(2024, 1, 5, h)
    d = lambda i: dt.date(2024, 1, i)
    rows = [(d(1), "A", 1.0, 1, at(1)), (d(1), "A", 2.0, 2, at(2)), (d(3), "A", None, 3, at(3)), (d(2), "B", 5.0, 1, at(1)), (d(3), "B", float("nan"), 1, at(1)), (d(3), "C", 7.0, 1, None), (None, "C", 1.0, 1, at(1)), (d(3), None, 1.0, 1, at(1))]
    p = equity.valid_prices(spark.createDataFrame(rows, "dt date, ticker string, close double, batch_id long, loaded_at timestamp"))
    assert {tuple(r) for r in p.collect()} == {(d(1), "A", 2.0), (d(2), "B", 5.0), (d(3), "C", 7.0)}
    full = {(r["dt"], r["ticker"]): r["close"] for r in equity.dense_prices(p).collect()}
    assert full[d(3), "A"] == 2.0 and full[d(1), "C"] == 7.0 and len(full) == 9
    kept = {(r["dt"], r["ticker"]): r["close"] for r in equity.dense_prices(p, backfill=False).collect()}
    assert kept[d(1), "C"] is None


def test_next_trading_day_and_link(spark, prices, wide):
    days = [x.date() for x in wide.index]
    sat = dt.date(2020, 1, 4)
    rows = [(1, "AAA", days[3]), (2, "AAA", sat), (3, "AAA", dt.date(2030, 1, 1)), (4, "ZZZ", days[3]), (5, "BBB", None), (6, "BBB", dt.date(2019, 12, 1))]
    got = {r["i"]: r for r in equity.link_equity(spark.createDataFrame(rows, "i int, ticker string, filing_date date"), prices, (1,), 20).collect()}
    assert got[1]["event_date"] == days[3] and got[2]["event_date"] == dt.date(2020, 1, 6) and got[3]["event_date"] is None
    assert got[4]["event_date"] is None and got[5]["event_date"] is None and got[6]["event_date"] == days[0]
    lr = np.log(wide / wide.shift(1))
    assert got[1]["abret_1d"] == pytest.approx(lr["AAA"].iloc[4] - lr["SPY"].iloc[4])


def test_no_benchmark_gives_raw_returns(prices, wide):
    got = pivot(equity.compute_abnormal_returns(prices.where("ticker <> 'SPY'"), (1,)), "abret_1d")
    np.testing.assert_allclose(got["AAA"].to_numpy(float)[:-1], np.log(wide / wide.shift(1))["AAA"].to_numpy()[1:], atol=1e-12)


def test_deltas(spark):
    rows = [(1, "A", "10-K", dt.date(2020, 1, 1), 5), (2, "A", "10-K", dt.date(2021, 1, 1), 9), (3, "A", "10-Q", dt.date(2020, 5, 1), 1), (4, "A", "10-K", None, 10)]
    df = spark.createDataFrame(rows, "i int, ticker string, filing_type string, filing_date date, x int")
    assert {r["i"]: r["delta_x"] for r in deltas.deltas(df, ("x", "absent"), "i").collect()} == {1: None, 2: 4, 3: None, 4: 1}


def test_rolling_totals_match_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["A", "A", "B", None]), rnd.choice([None] + [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(0, 90, 3)]), rnd.choice([None, float("nan"), 1.0, -2.5]), dt.datetime(2024, 1, 1, i % 20)) for i in range(200)]
    rows += [(7, "B", dt.date(2024, 1, 5), 99.0, dt.datetime(2025, 1, 1)), (None, "B", dt.date(2024, 1, 9), 3.0, None), (None, "B", dt.date(2024, 1, 9), 3.0, None)]
    df = spark.createDataFrame(rows, "id long, e string, d date, x double, loaded_at timestamp").withColumn("day", F.lit("clash"))
    got = {(r["e"], r["day"]): (r["total_7d_x"], r["avg_30d_x"]) for r in rolling.rolling_totals(rolling.valid_rows(df, "id", "loaded_at", ["e", "d", "x"]), "e", "d", ["x"], [7, 30]).collect()}
    best = {}
    for r in rows:
        if r[0] is not None and (r[0] not in best or r[4] > best[r[0]][4]):
            best[r[0]] = r
    valid = [r for r in [*best.values(), *[r for r in rows if r[0] is None]] if r[1] and r[2]]
    want = {}
    for e in {r[1] for r in valid}:
        mine = [r for r in valid if r[1] == e]
        first, last = min(r[2] for r in mine), max(r[2] for r in mine)
        for k in range((last - first).days + 1):
            day = first + dt.timedelta(days=k)
            tot = lambda n, day=day, mine=mine: sum(r[3] for r in mine if 0 <= (day - r[2]).days < n and r[3] is not None and not math.isnan(r[3]))
            want[e, day] = (pytest.approx(tot(7)), pytest.approx(tot(30) / 30))
    assert got == want


def test_rolling_totals_of_nothing(spark):
    df = spark.createDataFrame([], "e string, d date, x double")
    assert rolling.rolling_totals(df, "e", "d", ["x"], [7]).count() == 0
