import datetime as dt

import pytest

FILINGS = "filing_id long, ticker string, item_1a_text string, mda_text string, loaded_at timestamp"


@pytest.fixture(scope="session")
def filings(spark):
    """A filings table from (filing_id, item_1a_text[, mda_text[, day of loading]]), with extra columns that clash."""

    def make(rows):
        out = []
        for r in rows:
            i, a, m, d = (*r, None, None)[:4] if len(r) < 4 else r
            out.append((i, "T", a, m, dt.datetime(2024, 1, d) if d else None, "clash", "clash"))
        return spark.createDataFrame(out, FILINGS + ", text string, section string")

    return make
