"""Made-up panels and filings, the same in every run (values are hashes of the row's key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions import dates

SECTORS = ("Technology", "Healthcare", "Financials", "Consumer", "Industrials", "Energy")
# The figures of the demo panel, and the ranges they lie in.
FIGURES = {
    "stat_1a_fog_index": (14, 24), "stat_1a_vocabulary_richness": (0.3, 0.7), "lm_1a_negative_pct": (0.02, 0.12), "lm_1a_positive_pct": (0.005, 0.04), "lm_1a_uncertainty_pct": (0.01, 0.06),
    "lm_1a_net_sentiment": (-0.1, 0.02), "lm_mda_negative_pct": (0.01, 0.08), "lm_mda_net_sentiment": (-0.07, 0.02), "fb_1a_finbert_net_sentiment": (-0.6, 0.2), "fb_mda_finbert_net_sentiment": (-0.5, 0.3),
    "fb_1a_finbert_negative_pct": (0.2, 0.7), "fb_1a_finbert_positive_pct": (0.05, 0.3), "trailing_vol_63d": (0.15, 0.55), "forward_vol_63d": (0.15, 0.55),
}
COUNTS = {"stat_1a_word_count": (3000, 15000), "stat_mda_word_count": (5000, 25000)}
RETURNS = {"abret_1d": 0.015, "abret_5d": 0.03, "abret_21d": 0.06, "abret_63d": 0.1}


def _uniform(name: str, *key: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(name), *key), F.lit(1_000_003)) / 1_000_003


def demo_panel(spark: SparkSession, tickers: int = 10, years: int = 6, first_year: int = 2018) -> DataFrame:
    """Two rows for each ticker and year, a 10-Q of March and a 10-K of December, with all figures and both texts."""
    rows = spark.range(tickers).select(F.col("id").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(years - 1))).alias("y")).select("t", "y", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    key = ("t", "y", "k")
    between = lambda n, low, high: F.lit(low) + _uniform(n, *key) * (high - low)
    # the sum of twelve uniform values less six is close to a normal one
    normal = lambda n, sd: sum((_uniform(f"{n}{i}", *key) for i in range(12)), F.lit(-6.0)) * sd
    rows = rows.withColumns({
        "ticker": F.concat(F.lit("TK"), F.lpad(F.col("t").cast("string"), 2, "0")), "filing_type": F.when(F.col("k") == 1, "10-K").otherwise("10-Q"),
        "filing_date": F.make_date((F.col("y") + first_year).cast("int"), (F.col("k") * 9 + 3).cast("int"), F.lit(15)),
        "sector": F.element_at(F.array(*[F.lit(s) for s in SECTORS]), (F.col("t") % len(SECTORS) + 1).cast("int")),
    })
    figures = {n: F.floor(between(n, *r)).cast("long") for n, r in COUNTS.items()} | {n: F.round(between(n, *r), 4) for n, r in FIGURES.items()} | {n: F.round(normal(n, sd), 4) for n, sd in RETURNS.items()}
    texts = {
        "item_1a_text": F.concat(F.lit("Made-up risks of "), "ticker", F.lit(": demand may fall, claims could arise, and rules might change.")),
        "mda_text": F.concat(F.lit("Made-up discussion of "), "ticker", F.lit(": sales improved while costs rose.")),
    }
    return rows.select("ticker", "filing_type", "filing_date", dates.quarter_label("filing_date").alias("filing_quarter"), "sector", *[c.alias(n) for n, c in figures.items()], *[c.alias(n) for n, c in texts.items()])


def demo_filings(spark: SparkSession, tickers: int = 50, years: int = 6, last_quarters: int = 3, first_year: int = 2018) -> DataFrame:
    """A 10-K for each ticker and year, and three 10-Qs of the last year."""
    one = lambda f, y, m, d: F.struct(F.lit(f).alias("filing_type"), F.make_date(F.lit(y), F.lit(m), F.lit(d)).alias("filing_date"))
    dates_ = [one("10-K", first_year + y, 2, 15) for y in range(years)] + [one("10-Q", first_year + years - 1, 3 * q + 5, 10) for q in range(last_quarters)]
    rows = spark.range(tickers).select(F.concat(F.lit("TK"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("ticker"), F.explode(F.array(*dates_)).alias("f")).select("ticker", "f.*")
    n = (F.lit(5000) + _uniform("n", "ticker", "filing_date") * 10000).cast("long")
    return rows.withColumns({"word_count": n, "item_1a_len": n * 4, "mda_len": n * 2, "item_1a_text": F.lit("Demand may decline. Losses could follow."), "mda_text": F.lit("Revenue improved. Costs were stable.")})
