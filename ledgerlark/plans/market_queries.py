"""Queries of the price, window, as-of and change families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators import deltas, equity
from ledgerlark.plans import base
from ledgerlark.plans.base import FILINGS, PRICES

WINDOWS = (1, 5, 21, 63)


def _r(df: DataFrame, keys: list[str], digits: int = 8) -> DataFrame:
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in df.columns if c not in keys])


def q_valid_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.prices(spark, sf_dir)


def q_trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equity.trading_days(base.prices(spark, sf_dir))


def q_log_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(equity.log_returns(base.prices(spark, sf_dir)).drop("close"), ["dt", "ticker"])


def q_pct_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(equity.pct_change(base.prices(spark, sf_dir)).drop("close"), ["dt", "ticker"])


def q_forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(equity.compute_returns(base.prices(spark, sf_dir), WINDOWS), ["dt", "ticker"])


def q_abnormal_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(equity.compute_abnormal_returns(base.prices(spark, sf_dir), WINDOWS), ["dt", "ticker"])


def q_raw_returns_without_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7 where the benchmark is absent: raw returns."""
    return _r(equity.compute_abnormal_returns(base.prices(spark, sf_dir).where("ticker <> 'SPY'"), WINDOWS), ["dt", "ticker"])


def q_realized_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(equity.compute_realized_vol(base.prices(spark, sf_dir)), ["dt", "ticker"])


def q_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equity.dense_prices(base.prices(spark, sf_dir))


def q_next_trading_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.filings(spark, sf_dir, "filing_date").where("filing_date is not null")
    return equity.next_trading_day(rows, "filing_date", base.prices(spark, sf_dir)).select("filing_id", "filing_date", "event_date")


def q_link_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.filings(spark, sf_dir, "ticker", "filing_date")
    rows = equity.link_equity(rows, base.prices(spark, sf_dir))
    keys = ["filing_id", "ticker", "event_date"]
    return _r(rows.drop("filing_date"), keys)


def q_quarter_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(equity.quarterly_return(base.prices(spark, sf_dir)), ["quarter"])


def q_missing_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlark.operators.report import missing_tickers

    return missing_tickers(base.filings(spark, sf_dir, "ticker").where("ticker is not null"), base.prices(spark, sf_dir))


def q_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.filings(spark, sf_dir, "ticker", "filing_type", "filing_date", "word_count", "item_1a_len", "mda_len")
    rows = deltas.deltas(rows, ("word_count", "item_1a_len", "mda_len", "not_there"), tie="filing_id")
    return rows.select("filing_id", "delta_word_count", "delta_item_1a_len", "delta_mda_len")


_LR = "r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY dt)) AS lr FROM p)"
_ER = """e AS (SELECT r.dt, r.ticker, r.lr, r.lr - b.lr AS er FROM r LEFT JOIN (SELECT dt, lr FROM r WHERE ticker = 'SPY') b ON r.dt = b.dt WHERE r.ticker <> 'SPY')"""


def _fwd(v: str, name: str) -> str:
    cell = "round(CASE WHEN count({v}) OVER w{w} = {w} THEN sum({v}) OVER w{w} END, 8) AS {name}_{w}d"
    return ", ".join(cell.format(v=v, w=w, name=name) for w in WINDOWS)


_FRAMES = "WINDOW " + ", ".join(f"w{w} AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND {w} FOLLOWING)" for w in WINDOWS)
_VOL = """round(CASE WHEN count(lr) OVER wb >= 31 THEN stddev_samp(lr) OVER wb * sqrt(252) END, 8) AS trailing_vol_63d,
  round(CASE WHEN lead(dt, 63) OVER (PARTITION BY ticker ORDER BY dt) IS NOT NULL AND count(lr) OVER w63 >= 31 THEN stddev_samp(lr) OVER w63 * sqrt(252) END, 8) AS forward_vol_63d"""
_BACK = ", wb AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"
_NEXT = "(SELECT min(dt) FROM p WHERE p.dt >= f.filing_date)"

NAMES = (
    "q_valid_prices q_trading_days q_log_returns q_pct_change q_forward_returns q_abnormal_returns q_raw_returns_without_benchmark q_realized_vol q_fill q_next_trading_day q_link_equity "
    "q_quarter_return q_missing_prices q_delta"
).split()
QUERIES = {n: globals()[n] for n in NAMES}
SQL = {
    "q_valid_prices": f"WITH {PRICES} SELECT * FROM p",
    "q_trading_days": f"WITH {PRICES} SELECT DISTINCT dt FROM p",
    "q_log_returns": f"WITH {PRICES}, {_LR} SELECT dt, ticker, round(lr, 8) AS lr FROM r",
    "q_pct_change": f"WITH {PRICES} SELECT dt, ticker, round(close / lag(close) OVER (PARTITION BY ticker ORDER BY dt) - 1, 8) AS pct FROM p",
    "q_forward_returns": f"WITH {PRICES}, {_LR} SELECT dt, ticker, {_fwd('lr', 'ret')} FROM r {_FRAMES}",
    "q_abnormal_returns": f"WITH {PRICES}, {_LR}, {_ER} SELECT dt, ticker, {_fwd('er', 'abret')} FROM e {_FRAMES}",
    "q_raw_returns_without_benchmark": f"WITH {PRICES}, {_LR} SELECT dt, ticker, {_fwd('lr', 'abret')} FROM r WHERE ticker <> 'SPY' {_FRAMES}",
    "q_realized_vol": f"WITH {PRICES}, {_LR} SELECT dt, ticker, {_VOL} FROM r {_FRAMES}{_BACK}",
    "q_fill": f"""WITH {PRICES}, g AS (SELECT dt, ticker, close FROM (SELECT DISTINCT dt FROM p) CROSS JOIN (SELECT DISTINCT ticker FROM p) LEFT JOIN p USING (dt, ticker))
SELECT dt, ticker, coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close FROM g""",
    "q_next_trading_day": f"WITH {FILINGS}, {PRICES} SELECT filing_id, filing_date, {_NEXT} AS event_date FROM f WHERE filing_date IS NOT NULL",
    "q_link_equity": f"""WITH {FILINGS}, {PRICES}, {_LR}, {_ER}, m AS (SELECT dt, ticker, {_fwd('er', 'abret')}, {_VOL} FROM e {_FRAMES}{_BACK}),
d AS (SELECT filing_id, ticker, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.ticker = f.ticker) THEN {_NEXT} END AS event_date FROM f)
SELECT filing_id, d.ticker, event_date, {", ".join(f"abret_{w}d" for w in WINDOWS)}, trailing_vol_63d, forward_vol_63d FROM d LEFT JOIN m ON m.ticker = d.ticker AND m.dt = d.event_date""",
    "q_quarter_return": f"""WITH {PRICES}, q AS (SELECT year(dt) || 'Q' || quarter(dt) AS quarter, arg_max(close, dt) AS c FROM p WHERE ticker = 'SPY' GROUP BY 1),
x AS (SELECT quarter, c / lag(c) OVER (ORDER BY quarter) - 1 AS v FROM q) SELECT quarter, round(v, 8) AS quarter_return FROM x WHERE v IS NOT NULL""",
    "q_missing_prices": f"WITH {FILINGS}, {PRICES} SELECT DISTINCT ticker FROM f WHERE ticker IS NOT NULL EXCEPT SELECT ticker FROM p",
    "q_delta": f"""WITH {FILINGS} SELECT filing_id, {", ".join(f"{c} - lag({c}) OVER w AS delta_{c}" for c in ("word_count", "item_1a_len", "mda_len"))}
FROM f WINDOW w AS (PARTITION BY ticker, filing_type ORDER BY filing_date ASC NULLS LAST, filing_id)""",
}
