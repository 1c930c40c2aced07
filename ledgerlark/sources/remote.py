"""What comes from outside: attempts with growing pauses, files landed in pieces, lexicon and prices.

The transport is a callable that the caller passes in, so that plans and tests need no network."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterable
from typing import TypeVar

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ledgerlark.config import DEFAULT
from ledgerlark.operators import equity
from ledgerlark.sources import edgar, files

T = TypeVar("T")
#: Attempts of a request.
ATTEMPTS = 3


def attempt(call: Callable[[], T], times: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> T:
    """The result of a call that may fail; waits 1, 2, 4, ... seconds after failures and raises the last one."""
    for k in range(times):
        try:
            return call()
        except Exception:
            if k == times - 1:
                raise
            sleep(float(1 << k))
    raise ValueError("no attempts")


def land(pieces: Callable[[str], Iterable[bytes]], url: str, path: str, least: int = edgar.LANDED_BYTES) -> bool:
    """Writes a document piece by piece; True if it is there. A file over `least` bytes isn't fetched again.

    The pieces go to a file beside the target, which takes its name when all are there, so a broken request leaves none."""
    if os.path.exists(path) and os.path.getsize(path) > least:
        return True
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = path + ".part"
    try:
        with open(part, "wb") as f:
            for piece in pieces(url):
                f.write(piece)
        os.replace(part, path)
        return True
    except Exception:
        if os.path.exists(part):
            os.remove(part)
        return False


def outcomes(spark: SparkSession, done: dict[str, bool]) -> DataFrame:
    """(path, landed) of what ``edgar.fetch`` did, failures included."""
    return spark.createDataFrame(list(done.items()), "path string, landed boolean")


def lexicon_from(spark: SparkSession, get: Callable[[str], bytes], url: str, path: str) -> DataFrame:
    """The lexicon of a saved copy, which is fetched first where it is absent; RuntimeError if that fails."""
    if not os.path.exists(path):
        try:
            content = get(url)
        except Exception as e:
            raise RuntimeError(f"the lexicon can't be fetched: {e}") from e
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "wb") as f:
            f.write(content)
    return files.read_lexicon(spark, path)


def prices_from(
    spark: SparkSession, get: Callable[[list[str], str, str], pd.DataFrame], tickers: list[str], start: str = DEFAULT.start_date, end: str = DEFAULT.end_date,
    benchmark: str | None = DEFAULT.benchmark, sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """(dt, ticker, close) with gaps filled; the benchmark is added, and after failed attempts there are no rows.

    get: a wide table with a column Date and one for each ticker."""
    wanted = [*tickers, *([benchmark] if benchmark and benchmark not in tickers else [])]
    try:
        wide = attempt(lambda: get(wanted, start, end), sleep=sleep)
    except Exception:
        return spark.createDataFrame([], "dt date, ticker string, close double")
    return equity.dense_prices(files.melt_prices(spark.createDataFrame(wide)))
