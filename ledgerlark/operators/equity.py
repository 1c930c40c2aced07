"""Market operators on long prices (dt, ticker, close): returns, volatility, fills, next trading day, linking of filings.

Windows are partitioned by ticker; all windows of one ticker share one sort. A ticker has one row per trading day
(about 250 a year), so a ticker's rows are bounded by the calendar, whatever the number of deliveries: those are merged
by a plain aggregate before any window is opened."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.config import DEFAULT


def valid_prices(prices: DataFrame) -> DataFrame:
    """(dt, ticker, close): for each day and ticker the close loaded last; rows without day, ticker or close don't count.

    Ties go to the greater batch, then to the greater close. NaN counts as missing."""
    rows = prices.where(F.col("dt").isNotNull() & F.col("ticker").isNotNull() & F.col("close").isNotNull() & ~F.isnan("close"))
    order = F.struct(F.coalesce("loaded_at", F.timestamp_seconds(F.lit(0))), F.coalesce("batch_id", F.lit(-1)), "close")
    return rows.groupBy("dt", "ticker").agg(F.max_by("close", order).alias("close"))


def by_ticker() -> Window:
    return Window.partitionBy("ticker").orderBy("dt")


def log_returns(prices: DataFrame) -> DataFrame:
    """Adds lr, the log of the close over the one before; NULL on the first row and where a close isn't positive."""
    return prices.withColumn("lr", F.ln(F.try_divide(F.col("close"), F.lag("close").over(by_ticker()))))


def pct_change(prices: DataFrame) -> DataFrame:
    """W8."""
    return prices.withColumn("pct", F.try_divide(F.col("close"), F.lag("close").over(by_ticker())) - 1)


def forward_sum(value: str, w: int) -> Column:
    """The sum over the next w rows, NULL unless all w are there."""
    frame = by_ticker().rowsBetween(1, w)
    return F.when(F.count(value).over(frame) == w, F.sum(value).over(frame))


def compute_returns(prices: DataFrame, windows: tuple[int, ...] = DEFAULT.return_windows) -> DataFrame:
    """(dt, ticker, ret_<w>d)."""
    return log_returns(prices).select("dt", "ticker", *[forward_sum("lr", w).alias(f"ret_{w}d") for w in windows])


def excess_returns(prices: DataFrame, benchmark: str = DEFAULT.benchmark) -> DataFrame:
    """(dt, ticker, close, lr, er): log return over the benchmark's of that day; NULL where the benchmark has none.

    Without any benchmark row the raw return is used. The benchmark has one row for each day, so it is joined by day
    (Spark sees its size and picks the join)."""
    rows = log_returns(prices)
    bench = log_returns(prices.where(F.col("ticker") == benchmark)).select("dt", F.col("lr").alias("_b"))
    there = F.broadcast(prices.where(F.col("ticker") == benchmark).agg((F.count("*") > 0).alias("_has")))  # one row
    rows = rows.where(F.col("ticker") != benchmark).join(bench, "dt", "left").crossJoin(there)
    return rows.select("dt", "ticker", "close", "lr", F.when(F.col("_has"), F.col("lr") - F.col("_b")).otherwise(F.col("lr")).alias("er"))


def compute_abnormal_returns(prices: DataFrame, windows: tuple[int, ...] = DEFAULT.return_windows, benchmark: str = DEFAULT.benchmark) -> DataFrame:
    """(dt, ticker, abret_<w>d) without the benchmark."""
    return excess_returns(prices, benchmark).select("dt", "ticker", *[forward_sum("er", w).alias(f"abret_{w}d") for w in windows])


def trailing_vol(n: int = DEFAULT.vol_window, annualize: bool = True, value: str = "lr") -> Column:
    """Sample deviation of the last n log returns, at least n // 2 of them."""
    frame = by_ticker().rowsBetween(-(n - 1), 0)
    scale = math.sqrt(DEFAULT.trading_days) if annualize else 1.0
    return F.when(F.count(value).over(frame) >= max(2, n // 2), F.stddev_samp(value).over(frame) * scale)


def forward_vol(n: int = DEFAULT.vol_window, annualize: bool = True, value: str = "lr") -> Column:
    """The deviation over the next n rows, NULL on the last n rows."""
    frame = by_ticker().rowsBetween(1, n)
    scale = math.sqrt(DEFAULT.trading_days) if annualize else 1.0
    there = F.lead("dt", n).over(by_ticker()).isNotNull() & (F.count(value).over(frame) >= max(2, n // 2))
    return F.when(there, F.stddev_samp(value).over(frame) * scale)


def compute_realized_vol(prices: DataFrame, n: int = DEFAULT.vol_window, annualize: bool = True) -> DataFrame:
    """(dt, ticker, trailing_vol_<n>d, forward_vol_<n>d)."""
    return log_returns(prices).select("dt", "ticker", trailing_vol(n, annualize).alias(f"trailing_vol_{n}d"), forward_vol(n, annualize).alias(f"forward_vol_{n}d"))


def dense_prices(prices: DataFrame, backfill: bool = True) -> DataFrame:
    """A row for each ticker and each day on which any ticker traded, gaps filled forward, then backward.

    Backward filling puts a later close on days before a ticker is listed; backfill=False leaves them NULL."""
    days = prices.agg(F.sort_array(F.collect_set("dt")).alias("_days"))  # one row, as long as the trading calendar
    grid = prices.select("ticker").distinct().crossJoin(F.broadcast(days)).select("ticker", F.explode("_days").alias("dt")).join(prices.select("dt", "ticker", "close"), ["dt", "ticker"], "left")
    before = by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    # before its first close a ticker's next close is that first one; a frame from each row to the end would be quadratic
    first = F.first("close", True).over(by_ticker().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    filled = F.last("close", True).over(before)
    return grid.select("dt", "ticker", F.coalesce(filled, first).alias("close") if backfill else filled.alias("close"))


def trading_days(prices: DataFrame) -> DataFrame:
    """The distinct days, in order."""
    return prices.select("dt").where("dt is not null").distinct().orderBy("dt")


def calendar(days: DataFrame, dates: DataFrame) -> DataFrame:
    """(day, event_date): the first trading day on or after each calendar day from the first to the last known one.

    days: (dt); dates: (day). One row per calendar day, so the single-partition window is small for any data volume."""
    span = days.select(F.col("dt").alias("d")).unionByName(dates.select(F.col("day").alias("d"))).agg(F.min("d").alias("a"), F.max("d").alias("b"))
    spine = span.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    rows = spine.join(days.select(F.col("dt").alias("day"), F.col("dt").alias("_t")).distinct(), "day", "left")
    return rows.select("day", F.last("_t", True).over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0)).alias("event_date"))


def next_trading_day(df: DataFrame, day: str, prices: DataFrame, name: str = "event_date") -> DataFrame:
    """Adds the first trading day on or after a date column; NULL after the last one."""
    days = prices.select("dt").where("dt is not null").distinct()
    spine = calendar(days, df.where(F.col(day).isNotNull()).select(F.col(day).alias("day")).distinct())
    return df.join(spine.withColumnsRenamed({"day": day, "event_date": name}), day, "left")


def link_equity(filings: DataFrame, prices: DataFrame, windows: tuple[int, ...] = DEFAULT.return_windows, vol: int = DEFAULT.vol_window, benchmark: str = DEFAULT.benchmark) -> DataFrame:
    """B1 (J1 to J4): adds event_date, abret_<w>d, trailing_vol_<n>d and forward_vol_<n>d to (ticker, filing_date) rows.

    A ticker without any price keeps its row with all of them NULL. One join carries all windows."""
    ab = excess_returns(prices, benchmark)
    market = ab.select(
        "dt", "ticker", *[forward_sum("er", w).alias(f"abret_{w}d") for w in windows],
        trailing_vol(vol).alias(f"trailing_vol_{vol}d"), forward_vol(vol).alias(f"forward_vol_{vol}d"),
    )
    known = prices.select("ticker").distinct().withColumn("_known", F.lit(True))
    rows = next_trading_day(filings, "filing_date", prices).join(known, "ticker", "left")
    rows = rows.withColumn("event_date", F.when(F.col("_known"), F.col("event_date"))).drop("_known")
    return rows.join(market.withColumnRenamed("dt", "event_date"), ["event_date", "ticker"], "left")


def quarterly_return(prices: DataFrame, ticker: str = DEFAULT.benchmark) -> DataFrame:
    """(quarter, quarter_return) from the last close of each quarter; the first quarter has none."""
    last = prices.where((F.col("ticker") == ticker) & F.col("close").isNotNull()).groupBy(F.date_format("dt", "yyyy'Q'q").alias("quarter")).agg(F.max_by("close", "dt").alias("c"))
    rows = last.withColumn("p", F.lag("c").over(Window.orderBy("quarter")))  # one row per quarter
    return rows.where("p is not null").select("quarter", (F.col("c") / F.col("p") - 1).alias("quarter_return"))
