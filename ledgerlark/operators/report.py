"""Descriptive results behind the reference's tables, charts and dashboard (A, O, P, R families)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import dates
from ledgerlark.operators import equity, stats

# Prefixes of the feature columns.
NUMERIC_PREFIXES = ("lm_", "fb_", "stat_", "delta_", "abret_", "trailing_", "forward_")
# Features of the default correlation matrix.
CORRELATED = (
    "lm_1a_negative_pct", "lm_1a_positive_pct", "lm_1a_uncertainty_pct", "lm_1a_net_sentiment", "lm_mda_negative_pct", "lm_mda_net_sentiment", "fb_1a_finbert_net_sentiment",
    "fb_mda_finbert_net_sentiment", "stat_1a_fog_index", "stat_1a_vocabulary_richness", "stat_1a_word_count", "abret_1d", "abret_5d", "abret_21d", "abret_63d", "forward_vol_63d",
)


def numeric_features(df: DataFrame, prefixes: tuple[str, ...] = NUMERIC_PREFIXES, without: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns by prefix, without those that contain one of the words."""
    return [c for c, t in df.dtypes if t in ("int", "bigint", "float", "double") and c.startswith(prefixes) and not any(w in c for w in without)]


def summary_stats(df: DataFrame, digits: int = 4) -> DataFrame:
    """A1."""
    cols = numeric_features(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "feature string, mean double, median double, std double, min double, max double, p25 double, p75 double")
    rows = stats.summary(df, cols)
    return rows.select("feature", *[F.round(c, digits).alias(c) for c in ("mean", "median", "std", "min", "max", "p25", "p75")])


def sector_breakdown(df: DataFrame, columns: list[str] | None = None, digits: int = 4) -> DataFrame:
    """A2: means by sector; an empty result without a sector column."""
    if "sector" not in df.columns:
        return df.sparkSession.createDataFrame([], "sector string")
    cols = columns or numeric_features(df, ("lm_", "fb_"), ("count", "total", "n_sent"))
    return df.groupBy("sector").agg(*[F.round(F.avg(stats.missing_to_null(c)), digits).alias(c) for c in cols])


def quarter_means(df: DataFrame, column: str) -> DataFrame:
    """A3: (quarter, avg_sentiment), in order."""
    return df.where("filing_quarter is not null").groupBy(F.col("filing_quarter").alias("quarter")).agg(F.avg(stats.missing_to_null(column)).alias("avg_sentiment")).orderBy("quarter")


def sentiment_and_market(df: DataFrame, column: str, prices: DataFrame) -> DataFrame:
    """Quarter means beside the benchmark's return of the quarter."""
    return quarter_means(df, column).join(equity.quarterly_return(prices), "quarter", "left")


def coverage(df: DataFrame, types: tuple[str, ...] = ("10-K", "10-Q")) -> DataFrame:
    """Filings by year, a column for each type, 0 where there are none."""
    rows = df.withColumn("filing_year", dates.year("filing_date")).where("filing_year is not null").groupBy("filing_year").pivot("filing_type", list(types)).count()
    return rows.na.fill(0).orderBy("filing_year")


def filings_per_ticker(df: DataFrame, filing_type: str | None = None) -> DataFrame:
    """(ticker, n), fewest first."""
    rows = df if filing_type is None else df.where(F.col("filing_type") == filing_type)
    return rows.groupBy("ticker").agg(F.count("*").alias("n")).orderBy("n", "ticker")


def date_range(df: DataFrame) -> DataFrame:
    """A9."""
    return df.agg(F.min("filing_date").alias("first_date"), F.max("filing_date").alias("last_date"), F.min(dates.year("filing_date")).alias("first_year"), F.max(dates.year("filing_date")).alias("last_year"))


def completeness(df: DataFrame, columns: dict[str, str], least: int = 50) -> DataFrame:
    """A10: for each named count, how many rows exceed `least` and their share."""
    cells = [F.struct(F.lit(k).alias("part"), F.count_if(F.coalesce(c, F.lit(0)) > least).alias("complete"), F.avg((F.coalesce(c, F.lit(0)) > least).cast("double")).alias("share")) for k, c in columns.items()]
    return df.agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def kpis(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of rows and means."""
    return df.agg(F.count("*").alias("n"), *[F.avg(stats.missing_to_null(c)).alias(f"avg_{c}") for c in columns])


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """A14."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def dashboard_filter(df: DataFrame, ticker: str | None = None, types: list[str] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """P10: all conditions reach the scan; without a ticker all of them are shown."""
    if ticker is not None:
        df = df.where(F.col("ticker") == ticker)
    if types:
        df = df.where(F.col("filing_type").isin(*types))
    if first is not None:
        df = df.where(F.col("filing_year") >= first)
    return df.where(F.col("filing_year") <= last) if last is not None else df


def history(df: DataFrame, columns: list[str]) -> DataFrame:
    """Newest first."""
    return df.select("ticker", "filing_type", dates.day_label("filing_date").alias("filing_date"), *[c for c in columns if c in df.columns]).orderBy(F.col("filing_date").desc_nulls_last(), "filing_type")


def missing_tickers(universe: DataFrame, seen: DataFrame) -> DataFrame:
    """U1."""
    return universe.select("ticker").distinct().join(seen.select("ticker").distinct(), "ticker", "left_anti")


def top_coefficients(coefs: DataFrame, n: int = 15) -> DataFrame:
    """The n greatest coefficients by size, without the constant and the quarters, with stars."""
    rows = coefs.where((F.col("term") != "const") & ~F.col("term").startswith("q_"))
    return rows.withColumn("stars", stats.stars(F.col("p"))).orderBy(F.abs("coef").desc(), "term").limit(n)


def event_study_table(study: stats.EventStudy, df: DataFrame) -> DataFrame:
    """One row for each quantile, means in per cent, with the stars of the spread."""
    n = len(study.quantile_means)
    name = lambda i: "Q1 (low)" if i == 0 else f"Q{n} (high)" if i == n - 1 else f"Q{i + 1}"
    rows = [(name(i), m * 100, c, study.p_value) for i, (m, c) in enumerate(zip(study.quantile_means, study.quantile_counts))]
    out = df.sparkSession.createDataFrame(rows, "label string, mean_pct double, n long, p double")
    return out.withColumn("stars", F.when(F.isnan("p"), "").otherwise(stats.stars(F.col("p")))).drop("p")


def in_order(df: DataFrame, *columns: str) -> DataFrame:
    """O1, O2: sorted by the columns, missing values last (the reference's order is ticker, type, date)."""
    names = columns or ("ticker", "filing_type", "filing_date")
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in names if c in df.columns])


def text_samples(df: DataFrame, column: str, by: str, order: list[str], least: int = 200) -> DataFrame:
    """For each value of `by` the first row whose text is longer than `least`."""
    long = df.where(F.length(column) > least)
    key = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in order])
    return long.groupBy(by).agg(*[F.min_by(c, key).alias(c) for c in df.columns if c != by])


def scatter(df: DataFrame, x: str, y: str, hue: str) -> DataFrame:
    """The rows with both figures, with the column that colours them."""
    return stats.complete(df, [x, y], [hue])


def word_count_distribution(df: DataFrame, column: str, bins: int = 40) -> tuple[DataFrame, DataFrame]:
    """Histogram of the positive counts, and their median and mean."""
    rows = df.where(F.col(column) > 0)
    return stats.histogram(rows, column, bins), rows.agg(F.avg(column).alias("mean")).withColumn("median", F.lit(next(iter(stats.exact_quantiles(rows, column, [0.5])), None)).cast("double"))


def sentiment_beside_price(panel: DataFrame, prices: DataFrame, column: str, ticker: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A ticker's sentiment by filing date and its price series, two results; of all tickers without one named."""
    one = F.lit(True) if ticker is None else F.col("ticker") == ticker
    own = panel.where(one & F.col("ticker").isNotNull() & F.col(column).isNotNull()).select("ticker", "filing_date", column)
    return own.orderBy("ticker", "filing_date"), prices.where(one).select("ticker", "dt", "close").orderBy("ticker", "dt")
