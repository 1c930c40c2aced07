"""Change of a filing's figures against the previous filing of the same ticker and type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.config import DELTA_COLUMNS


def deltas(df: DataFrame, columns: tuple[str, ...] = DELTA_COLUMNS, tie: str | None = None) -> DataFrame:
    """Adds delta_<column> for the columns that exist; NULL for a first filing; rows without date come last.

    Filings of one day follow each other in the order of `tie`. A ticker and type has a few filings a year, so its
    window is small whatever the number of tickers."""
    order = [F.col("filing_date").asc_nulls_last()] + ([F.col(tie)] if tie else [])
    w = Window.partitionBy("ticker", "filing_type").orderBy(*order)
    there = [c for c in columns if c in df.columns]
    return df.withColumns({f"delta_{c}": F.col(c) - F.lag(c).over(w) for c in there})
