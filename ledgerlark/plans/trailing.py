"""Queries of problem 6 over feature_panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators import rolling

VALUES = ["abret_21d", "trailing_vol_63d", "forward_vol_63d"]
DAYS = [7, 30]


def trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = spark.read.parquet(f"{sf_dir}/feature_panel.parquet")
    events = rolling.valid_rows(panel, "panel_id", "loaded_at", ["ticker", "event_date", *VALUES])
    return rolling.rolling_totals(events, "ticker", "event_date", VALUES, DAYS)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("total_30d_abret_21d") < -0.30005
    wild = F.col("avg_30d_trailing_vol_63d") > 0.040001
    calmer = F.col("total_7d_forward_vol_63d") - F.col("total_7d_trailing_vol_63d") < 0.00005
    return trailing(spark, sf_dir).where(low & wild & calmer).select("ticker", F.date_format("day", "yyyy-MM-dd").alias("day_"))


def p6_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trailing(spark, sf_dir)
    return rows.select("ticker", F.date_format("day", "yyyy-MM-dd").alias("day_"), *[F.round(F.col(c) + F.lit(0.0), 6).alias(c) for c in rows.columns[2:]])


_BASE = """
WITH v AS (
  SELECT ticker, event_date, abret_21d, trailing_vol_63d, forward_vol_63d FROM (
    SELECT *, row_number() OVER (PARTITION BY panel_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM feature_panel)
  WHERE rn = 1 OR panel_id IS NULL),
d AS (
  SELECT ticker, event_date AS day,
    sum(CASE WHEN abret_21d IS NULL OR isnan(abret_21d) THEN 0 ELSE abret_21d END) AS a,
    sum(CASE WHEN trailing_vol_63d IS NULL OR isnan(trailing_vol_63d) THEN 0 ELSE trailing_vol_63d END) AS t,
    sum(CASE WHEN forward_vol_63d IS NULL OR isnan(forward_vol_63d) THEN 0 ELSE forward_vol_63d END) AS f
  FROM v WHERE ticker IS NOT NULL AND event_date IS NOT NULL GROUP BY ALL),
c AS (
  SELECT ticker, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY ticker),
x AS (
  SELECT c.ticker, c.day, coalesce(a, 0) AS a, coalesce(t, 0) AS t, coalesce(f, 0) AS f
  FROM c LEFT JOIN d ON c.ticker = d.ticker AND c.day = d.day),
w AS (
  SELECT ticker, day,
    sum(a) OVER w7 AS a7, sum(t) OVER w7 AS t7, sum(f) OVER w7 AS f7, sum(a) OVER w30 AS a30, sum(t) OVER w30 AS t30, sum(f) OVER w30 AS f30
  FROM x WINDOW
    w7 AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
    w30 AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
"""

QUERIES = {"p6_found": p6_found, "p6_rolling": p6_rolling}
SQL = {
    "p6_found": _BASE + "SELECT ticker, strftime(day, '%Y-%m-%d') AS day_ FROM w WHERE a30 < -0.30005 AND t30 / 30 > 0.040001 AND f7 - t7 < 0.00005",
    "p6_rolling": _BASE + "SELECT ticker, strftime(day, '%Y-%m-%d') AS day_, " + ", ".join(
        [f"round({k}{n}, 6) + 0.0 AS total_{n}d_{v}" for n in DAYS for k, v in zip("atf", VALUES)] + [f"round({k}{n} / {n}, 6) + 0.0 AS avg_{n}d_{v}" for n in DAYS for k, v in zip("atf", VALUES)]
    ) + " FROM w",
}
