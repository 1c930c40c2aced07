"""Submission indexes as landed JSON: ticker map, filings to fetch, URLs, what is already there.

The network lies outside the plan: a fetcher (any callable of URL and target) takes the rows of ``to_fetch``."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.config import DEFAULT

TICKERS = "map<string,struct<ticker:string,cik_str:bigint>>"
BLOCK = "struct<form:array<string>,filingDate:array<string>,accessionNumber:array<string>,primaryDocument:array<string>>"
SUBMISSION = f"struct<filings:struct<recent:{BLOCK},files:array<struct<name:string>>>>"
#: Bytes over which a landed file counts as there, and seconds between two requests.
LANDED_BYTES, PAUSE = 1000, 0.11


def ticker_map(landed: DataFrame, value: str = "value") -> DataFrame:
    """(ticker, cik) of the landed ticker JSON; of a ticker that occurs twice the last entry counts."""
    rows = landed.select(F.explode(F.from_json(value, TICKERS)).alias("k", "v"))
    rows = rows.where("v.ticker is not null").select(F.upper("v.ticker").alias("ticker"), F.col("v.cik_str").alias("cik"), F.col("k").try_cast("int").alias("n"))
    return rows.groupBy("ticker").agg(F.max_by("cik", F.coalesce("n", F.lit(-1))).alias("cik"))


def _zip(b: str) -> Column:
    n = F.least(*[F.size(f"{b}.{x}") for x in ("form", "filingDate", "accessionNumber", "primaryDocument")])
    rows = F.arrays_zip(F.col(f"{b}.form").alias("form"), F.col(f"{b}.filingDate").alias("day"), F.col(f"{b}.accessionNumber").alias("accession"), F.col(f"{b}.primaryDocument").alias("document"))
    return F.slice(rows, 1, F.greatest(n, F.lit(0)))


def filing_rows(recent: DataFrame, older: DataFrame | None = None, value: str = "value") -> DataFrame:
    """(cik, form, day, accession, document) of landed submissions (cik, value) and of their older pages."""
    a = recent.select("cik", F.from_json(value, SUBMISSION).alias("j")).select("cik", F.col("j.filings.recent").alias("b"))
    if older is not None:
        a = a.unionByName(older.select("cik", F.from_json(value, BLOCK).alias("b")))
    rows = a.where("b is not null").select("cik", F.explode(_zip("b")).alias("r"))
    return rows.select("cik", "r.form", "r.day", "r.accession", "r.document")


def older_pages(recent: DataFrame, value: str = "value") -> DataFrame:
    """(cik, name) of the older pages, whatever their dates."""
    return recent.select("cik", F.explode(F.from_json(value, SUBMISSION)["filings"]["files"]["name"]).alias("name"))


def select_filings(rows: DataFrame, form: str, start: str = DEFAULT.start_date, end: str = DEFAULT.end_date) -> DataFrame:
    """One form exactly, days between start and end as text, with a primary document."""
    return rows.where((F.col("form") == form) & F.col("day").between(start, end) & (F.coalesce("document", F.lit("")) != ""))


def cik_text(cik: Column | str) -> Column:
    return F.format_string("%010d", F.col(cik).cast("long") if isinstance(cik, str) else cik.cast("long"))


def document_url(base: str, cik: Column, accession: Column, document: Column) -> Column:
    """S3."""
    return F.concat(F.lit(base.rstrip("/") + "/"), cik.cast("string"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), document)


def each_form(forms: tuple[str, ...]) -> Column:
    """A row for each form, to select beside the tickers."""
    return F.explode(F.array(*[F.lit(f) for f in forms])).alias("filing_type")


def to_fetch(tickers: DataFrame, forms: tuple[str, ...], ciks: DataFrame, rows: DataFrame, landed: DataFrame, base: str, folder: str, start: str = DEFAULT.start_date, end: str = DEFAULT.end_date) -> DataFrame:
    """(ticker, filing_type, url, path) of all tickers times forms that aren't landed yet.

    landed: (path, length); a file of LANDED_BYTES or less is fetched again."""
    plan = tickers.select(F.upper("ticker").alias("ticker")).distinct().select("ticker", each_form(forms))
    plan = plan.join(ciks, "ticker").join(rows.withColumnRenamed("form", "filing_type"), ["cik", "filing_type"])
    plan = plan.where(F.col("day").between(start, end) & (F.coalesce("document", F.lit("")) != ""))
    ext = F.coalesce(F.nullif(F.regexp_extract("document", "(\\.[A-Za-z0-9]+)$", 1), F.lit("")), F.lit(".htm"))
    path = F.concat_ws("/", F.lit(folder), "ticker", "filing_type", F.concat("day", F.lit("_"), "accession", ext))
    plan = plan.select("ticker", "filing_type", document_url(base, F.col("cik"), F.col("accession"), F.col("document")).alias("url"), path.alias("path"))
    there = landed.where(F.col("length") > LANDED_BYTES).select("path").distinct()
    return plan.join(there, "path", "left_anti").select("ticker", "filing_type", "url", "path").distinct()


def fetch(plan: DataFrame, get: Callable[[str, str], bool], pause: float = PAUSE) -> dict[str, bool]:
    """One request after the other, as the source's limit asks; rows come to the driver one by one."""
    done = {}
    for r in plan.toLocalIterator():
        try:
            done[r["path"]] = bool(get(r["url"], r["path"]))
        except Exception:  # a failed request is a failed file
            done[r["path"]] = False
        time.sleep(pause)
    return done
