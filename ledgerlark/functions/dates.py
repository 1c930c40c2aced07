"""Date functions: lenient dates, years, quarter labels, quarter ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_date(c: Column | str) -> Column:
    """NULL where the value is no date."""
    return _c(c).try_cast("date")


def year(c: Column | str) -> Column:
    """D2."""
    return F.year(_c(c)).cast("long")


def quarter_label(c: Column | str, missing: str | None = "NaT") -> Column:
    """D3: 2022Q1; a missing date is the label `missing`, a group of its own as in the reference."""
    q = F.date_format(_c(c), "yyyy'Q'q")
    return F.coalesce(q, F.lit(missing)) if missing is not None else q


def quarter_end(c: Column | str) -> Column:
    """The last day of the quarter."""
    return F.last_day(F.add_months(F.trunc(_c(c), "quarter"), 2))


def day_label(c: Column | str) -> Column:
    """D5."""
    return F.date_format(_c(c), "yyyy-MM-dd")
