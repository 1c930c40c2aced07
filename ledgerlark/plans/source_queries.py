"""Queries of the readers and writers: each writes files of its own in the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.config import CATEGORIES
from ledgerlark.functions import lexicon
from ledgerlark.operators import model
from ledgerlark.plans import base, oracles, text_queries
from ledgerlark.plans.base import PANEL, PRICES
from ledgerlark.sources import demo, files, scratch


def q_lexicon_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon as a CSV of flags, read again."""
    rows = base.lexicon(spark, sf_dir).where("word is not null and category is not null").groupBy(F.upper(F.trim("word")).alias("Word"))
    flags = rows.agg(*[F.max(F.when(lexicon.category_name("category") == k, 2009).otherwise(0)).alias(files.FLAG_NAMES[k][0]) for k in CATEGORIES])
    path = scratch.new_path(spark, "lexicon") + ".csv"
    files.save_csv(flags, path)
    return files.read_lexicon(spark, path)


def q_panel_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel as a table by sector, read again."""
    path = files.save_parquet(base.panel(spark, sf_dir, "sector", "ticker", "abret_21d"), scratch.new_path(spark, "panel"), ("sector",))
    return files.load_parquet(spark, path).groupBy("sector").agg(F.count("*").alias("n"), F.round(F.sum("abret_21d") + F.lit(0.0), 6).alias("total"))


def q_prices_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV stands in for the absent Parquet table."""
    path = scratch.new_path(spark, "prices")
    files.save_csv(base.prices(spark, sf_dir), path + ".csv")
    rows = files.load_first(spark, [path + ".parquet", path + ".csv"], "dt date, ticker string, close double")
    return rows.groupBy("ticker").agg(F.count("*").alias("n"), F.min("dt").alias("first"), F.max("dt").alias("last"), F.round(F.sum("close"), 4).alias("total"))


def q_model_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3, K4, K5, M7: annual filings are scored and cached first, then all of them with the cache."""
    rows, make = text_queries.scored_filings(spark, sf_dir)
    path = scratch.new_path(spark, "cache")
    schema = "cache_key string, " + ", ".join(f"{c} {'long' if c == 'n_sentences' else 'double'}" for c in model.AGGREGATES)
    _, fresh = model.batch_sentiment(rows.where("filing_type = '10-K'"), ["filing_id"], "mda_text", make, files.load_cache(spark, path, schema))
    files.append_cache(fresh, path)
    got, fresh = model.batch_sentiment(rows, ["filing_id"], "mda_text", make, files.load_cache(spark, path, schema))
    return text_queries.rounded_scores(got)


def q_demo_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by ticker of the made-up panel, its span, and how many figures lie in their ranges."""
    inside = [F.col(c).between(*r) for c, r in demo.FIGURES.items()]
    rows = demo.demo_panel(spark).groupBy("ticker", "sector").agg(F.count("*").alias("n"), F.min("filing_date").alias("first"), F.max("filing_date").alias("last"), F.count_distinct("filing_quarter").alias("quarters"), F.sum(sum(c.cast("long") for c in inside)).alias("inside"))
    return rows


NAMES = "q_lexicon_csv q_panel_store q_prices_csv q_model_cached q_demo_panel".split()
QUERIES = {n: globals()[n] for n in NAMES}
SQL = {
    "q_lexicon_csv": "SELECT DISTINCT upper(trim(word)) AS word, regexp_replace(lower(category), '^(strong|weak)[ _-]?modal$', '\\1_modal') AS category FROM lexicon WHERE word IS NOT NULL AND category IS NOT NULL",
    "q_panel_store": f"WITH {PANEL} SELECT sector, count(*) AS n, round(sum(abret_21d) + 0.0, 6) AS total FROM v GROUP BY sector",
    "q_prices_csv": f"WITH {PRICES} SELECT ticker, count(*) AS n, min(dt) AS first, max(dt) AS last, round(sum(close), 4) AS total FROM p GROUP BY ticker",
    "q_model_cached": oracles.model_score(text_queries._SENTENCES.format(c="mda_text")),
    "q_demo_panel": f"""SELECT 'TK' || lpad(t::VARCHAR, 2, '0') AS ticker, (['Technology', 'Healthcare', 'Financials', 'Consumer', 'Industrials', 'Energy'])[t % 6 + 1] AS sector,
  12::BIGINT AS n, DATE '2018-03-15' AS first, DATE '2023-12-15' AS last, 12::BIGINT AS quarters, {12 * len(demo.FIGURES)}::BIGINT AS inside FROM range(10) r(t)""",
}
