"""The valid rows of the project's tables, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators import equity, rolling


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filings(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Filings in their latest delivery, with filing_id and the columns named."""
    df = table(spark, sf_dir, "filings_df").where("filing_id is not null")
    return rolling.valid_rows(df, "filing_id", "loaded_at", ["filing_id", *columns])


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equity.valid_prices(table(spark, sf_dir, "prices"))


def panel(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Valid rows of the feature panel; NaN as NULL."""
    rows = rolling.valid_rows(table(spark, sf_dir, "feature_panel"), "panel_id", "loaded_at", ["panel_id", *columns])
    numeric = {c for c, t in rows.dtypes if t == "double"}
    return rows.select(*[F.nullif(F.col(c), F.lit(float("nan"))).alias(c) if c in numeric else c for c in rows.columns])


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lexicon")


FILINGS = """f AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY filing_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM filings_df WHERE filing_id IS NOT NULL) WHERE rn = 1)"""
PRICES = """p AS (SELECT dt, ticker, close FROM (
  SELECT *, row_number() OVER (PARTITION BY dt, ticker ORDER BY loaded_at DESC NULLS LAST, batch_id DESC NULLS LAST, close DESC) AS rn
  FROM prices WHERE dt IS NOT NULL AND ticker IS NOT NULL AND close IS NOT NULL AND NOT isnan(close)) WHERE rn = 1)"""
_NUM = ("abret_1d", "abret_5d", "abret_21d", "abret_63d", "trailing_vol_63d", "forward_vol_63d", "stat_1a_fog_index", "lm_1a_net_sentiment")
PANEL = "v AS (SELECT * REPLACE (" + ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" for c in _NUM) + """) FROM (
  SELECT *, row_number() OVER (PARTITION BY panel_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM feature_panel) WHERE rn = 1 OR panel_id IS NULL)"""
NUMERIC = list(_NUM)
