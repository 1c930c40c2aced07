"""Filings as text: HTML to lines, table lines, sections, names from paths."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerlark.config import DEFAULT
from ledgerlark.functions import text
from ledgerlark.functions.dates import to_date

DASH = "[.\\s\\-–—]*"
# The header patterns of annual and quarterly filings.
HEADERS = {
    "1a": f"item\\s*1a{DASH}risk\\s*factors",
    "1b": f"item\\s*1b{DASH}",
    "2": f"item\\s*2{DASH}(properties|unregistered)",
    "7": f"item\\s*7{DASH}management",
    "7a": f"item\\s*7a{DASH}",
    "8": f"item\\s*8{DASH}financial\\s*statements",
    "q_mda": f"item\\s*2{DASH}management",
    "q_3": f"item\\s*3{DASH}",
    "q_risk": f"item\\s*1a{DASH}risk\\s*factors",
    "q_2u": f"item\\s*2{DASH}unregistered",
}
# Which header begins each section of a form, and which ones end it.
RULES = {
    "10-K": {"item_1a": ("1a", ("1b", "2", "7")), "mda": ("7", ("7a", "8"))},
    "10-Q": {"item_1a": ("q_risk", ("q_2u",)), "mda": ("q_mda", ("q_3",))},
}
# Fixed value: two amounts side by side; $12.50 counts as two, because the first may end anywhere.
MONEY = "(?:(?:\\$\\s*[\\d,]+)|(?:[\\d,]+\\.\\d{2})){2,}"
# Elements whose text is left out.
NOISE = ("script", "style", "ix:nonfraction", "ix:nonnumeric", "ix:header")


class _Text(HTMLParser):
    """Text nodes, one a line, outside the noise elements (counted, as they nest)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.out = 0, []

    def handle_starttag(self, tag: str, attrs) -> None:
        self.depth += tag in NOISE

    def handle_endtag(self, tag: str) -> None:
        self.depth -= tag in NOISE and self.depth > 0

    def handle_data(self, data: str) -> None:
        if not self.depth:
            self.out.append(data)


def plain_text(raw: str | None) -> str:
    """N1, N2 for one document."""
    if not raw:
        return ""
    p = _Text()
    p.feed(raw)
    p.close()
    lines = (line.strip() for line in "\n".join(p.out).splitlines())
    return "\n".join(line for line in lines if line)


@F.pandas_udf(StringType())
def _plain(raw: pd.Series) -> pd.Series:
    return raw.map(plain_text)


def html_text(c: Column | str) -> Column:
    """The text of HTML, one text node a line, blank lines off (an Arrow UDF over the standard parser)."""
    return _plain(F.col(c) if isinstance(c, str) else c)


def html_text_fast(c: Column | str) -> Column:
    """N2 as an expression: comments, script and style off, tags to line breaks, common entities; no nesting of ix tags."""
    t = F.regexp_replace(text.text_of(c), "(?s)<!--.*?-->", "")
    for tag in NOISE:
        t = F.regexp_replace(t, f"(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>", "")
    t = F.regexp_replace(t, "(?s)<[^>]+>", "\n")
    for e, v in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = F.replace(t, F.lit(e), F.lit(v))
    return F.array_join(lines(t), "\n")


def lines(c: Column | str) -> Column:
    """Stripped lines that aren't empty."""
    return F.filter(F.transform(F.split(text.text_of(c), "\\r\\n|\\n|\\r"), text.strip), lambda x: x != "")


def is_table_line(line: Column) -> Column:
    """Mostly numeric and short, or with amounts side by side (the money pattern backtracks inside $12.50)."""
    solid = F.regexp_replace(line, "\\s", "")
    numeric = F.length(F.regexp_replace(solid, "[^0-9$%,.()\\-]", ""))
    return ((F.length(solid) > 0) & (numeric / F.greatest(F.lit(1), F.length(solid)) > 0.6) & (F.length(line) < 120)) | line.rlike(MONEY)


def remove_table_lines(c: Column | str) -> Column:
    """N3 on a text."""
    return F.array_join(F.filter(lines(c), lambda x: ~is_table_line(x)), "\n")


def extract_section(rows: Column, start: str, ends: tuple[str, ...], min_chars: int = DEFAULT.section_min_chars) -> Column:
    """N4 over an array of lines: from the line after the first start match to the first end match that comes after
    min_chars of content, or to the end; table lines off; '' under min_chars. One fold over the lines, no shuffle."""
    begin = f"(?iU){start}"
    stop = "(?iU)" + "|".join(f"(?:{e})" for e in ends)
    indexed = F.transform(rows, lambda v, i: F.struct(i.alias("i"), v.alias("v")))
    zero = F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        longer = F.struct(acc["s"].alias("s"), acc["e"].alias("e"), (acc["n"] + F.length(x["v"]) + 1).alias("n"))
        begun = F.struct(x["i"].alias("s"), F.lit(-1).alias("e"), F.lit(0).alias("n"))
        ended = F.struct(acc["s"].alias("s"), x["i"].alias("e"), acc["n"].alias("n"))
        enough = F.greatest(acc["n"] - 1, F.lit(0)) >= min_chars
        return (
            F.when(acc["e"] >= 0, acc).when((acc["s"] < 0) & x["v"].rlike(begin), begun).when(acc["s"] < 0, acc).when(x["v"].rlike(stop) & enough, ended).otherwise(longer)
        )

    def cut(acc: Column) -> Column:
        size = F.when(acc["e"] < 0, F.size(rows)).otherwise(acc["e"]) - acc["s"] - 1
        body = F.filter(F.slice(rows, acc["s"] + 2, F.greatest(size, F.lit(0))), lambda v: ~is_table_line(v))
        whole = F.array_join(body, "\n")
        return F.when((acc["s"] >= 0) & (F.length(whole) >= min_chars), whole).otherwise("")

    return F.aggregate(indexed, zero, step, cut)


def infer_date(path: Column | str) -> Column:
    """The date that the file name begins with."""
    p = F.col(path) if isinstance(path, str) else path
    return to_date(F.nullif(F.regexp_extract(p, "(?:^|/)(\\d{4}-\\d{2}-\\d{2})[^/]*$", 1), F.lit("")))


def infer_ticker(path: Column | str) -> Column:
    """The folder before the last 10-K or 10-Q part, upper case, '' if there is none."""
    p = F.col(path) if isinstance(path, str) else path
    return F.upper(F.regexp_extract(p, "^(?:.*/)?([^/]+)/10-[KQ](?:/|$)", 1))


def infer_type(path: Column | str) -> Column:
    """The first 10-K or 10-Q part, else unknown."""
    p = F.col(path) if isinstance(path, str) else path
    return F.coalesce(F.nullif(F.regexp_extract(p, "(?:^|/)(10-[KQ])(?=/|$)", 1), F.lit("")), F.lit("unknown"))


def parse_filings(raw: DataFrame, fast: bool = False) -> DataFrame:
    """Filings from (path, content text): type, ticker and date from the path, both sections, counts.

    Unknown types and rows without ticker are dropped (P4, P5); an empty file keeps its row with empty sections (N11)."""
    rows = raw.select(infer_ticker("path").alias("ticker"), infer_type("path").alias("filing_type"), infer_date("path").alias("filing_date"), "content")
    rows = rows.where(F.col("filing_type").isin(*DEFAULT.forms) & (F.col("ticker") != ""))
    plain = html_text_fast("content") if fast else html_text("content")
    rows = rows.withColumn("_lines", lines(plain)).drop("content")

    def section(name: str) -> Column:
        c = F.lit("")
        for form, rule in RULES.items():
            start, ends = rule[name]
            c = F.when(F.col("filing_type") == form, extract_section(F.col("_lines"), HEADERS[start], tuple(HEADERS[e] for e in ends))).otherwise(c)
        return c

    rows = rows.withColumns({"item_1a_text": section("item_1a"), "mda_text": section("mda")})
    return rows.select(
        "ticker", "filing_type", "filing_date", (text.word_count("item_1a_text") + text.word_count("mda_text")).alias("word_count"),
        F.length("item_1a_text").cast("long").alias("item_1a_len"), F.length("mda_text").cast("long").alias("mda_len"), "item_1a_text", "mda_text",
    )


def parse_directory(spark: SparkSession, path: str) -> DataFrame:
    """N12 on a directory tree; sort by ticker and date for the reference's order."""
    from ledgerlark.sources.files import read_filings

    return parse_filings(read_filings(spark, path))
