"""Parsing of filings: sections, table lines, HTML, paths."""

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import sections
from ledgerlark.sources import files

RISK = "Our operations face risks that could hurt results. " * 8
MDA = "Revenue increased because customers ordered more. " * 8
K = f"""<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><p>ITEM 1A.
 RISK FACTORS</p><p>short</p><h1>Item 1A. Risk Factors</h1><p>{RISK}</p><p>Item 1B. Unresolved</p><p>Item 7. Management's Discussion</p><p>{MDA}</p>
<p>Item 7A.</p><p>Item 8. Financial Statements</p><script>var x = "Item 7. Management";</script></body></html>"""
Q = f"<p>Item 2. Management's</p><p>{MDA}</p><p>Item 3. Quantitative</p><p>Part II Item 1A. Risk Factors</p><p>{RISK}</p><p>Item 2. Unregistered</p>"


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "line, dropped",
    [("we paid a fee of $12.50 then", True), ("we paid a fee of $1.25 then", False), ("a loan of $7.3 million", False), ("between $1 and $2 a share", False), ("$2.40    $3.15", True), ("Net rents 8,150 9,420", False), ("1" * 130 + "x" * 3, False), ("words only", False)],
)
def test_table_lines(spark, line, dropped):
    assert (one(spark, sections.remove_table_lines("t"), line) == "") is dropped


def test_extract_section_rules(spark):
    def cut(lines, n=20):
        rows = F.array(*[F.lit(x) for x in lines])
        return spark.range(1).select(sections.extract_section(rows, "begin", ("end",), n).alias("x")).first()["x"]

    body = "some words of content here"
    assert cut(["begin", body, "end", "after"]) == body
    assert cut(["begin", "x", "end", body]) == "x\nend\n" + body  # the end came too early
    assert cut(["begin", body]) == body  # no end
    assert cut(["no start", body]) == ""
    assert cut(["begin", "few"]) == ""
    assert cut(["begin here too", body, "END now"]) == body


def test_parse_annual_and_quarterly(spark, tmp_path):
    for form, doc in (("10-K", K), ("10-Q", Q)):
        d = tmp_path / "acme" / form
        d.mkdir(parents=True)
        (d / "2022-03-15_0001.HTM").write_text(doc)
    (tmp_path / "acme" / "10-K" / "2021-01-01_2.txt").write_text("")
    (tmp_path / "acme" / "8-K").mkdir()
    (tmp_path / "acme" / "8-K" / "2021-01-01_3.htm").write_text(K)
    (tmp_path / "acme" / "10-K" / "note.pdf").write_text("x")
    rows = {(r["filing_type"], str(r["filing_date"])): r for r in sections.parse_directory(spark, str(tmp_path)).collect()}
    assert set(rows) == {("10-K", "2022-03-15"), ("10-Q", "2022-03-15"), ("10-K", "2021-01-01")}
    for form in ("10-K", "10-Q"):
        r = rows[form, "2022-03-15"]
        assert r["ticker"] == "ACME" and r["item_1a_text"] == RISK.strip() and r["mda_text"] == MDA.strip()
        assert r["word_count"] == len(RISK.split()) + len(MDA.split()) and r["mda_len"] == len(MDA.strip())
    assert rows["10-K", "2021-01-01"]["word_count"] == 0
    manifest = files.manifest(files.list_filings(spark, str(tmp_path))).collect()
    assert len(manifest) == 4 and {r["filing_type"] for r in manifest} == {"10-K", "10-Q", "unknown"}


def test_html_text(spark):
    doc = "<p>a <b>b</b> &amp; c</p><ix:header>x<ix:nonNumeric>y</ix:nonNumeric>z</ix:header><p>d</p><!-- e -->"
    assert one(spark, sections.html_text("t"), doc) == "a\nb\n& c\nd"
    assert one(spark, sections.html_text_fast("t"), "<style>x</style><p>a<br>b &amp;amp;</p>") == "a\nb &amp;"
    assert one(spark, sections.html_text("t"), None) == ""


@pytest.mark.parametrize(
    "path, ticker, kind, day",
    [("/d/10-K/x/10-Q/f.htm", "X", "10-K", None), ("file:/a/ibm/10-K/2022-03-15_1.htm", "IBM", "10-K", "2022-03-15"), ("foo.htm", "", "unknown", None), ("/a/b/10-K/A/2022-13-45_x.htm", "B", "10-K", None)],
)
def test_paths(spark, path, ticker, kind, day):
    r = spark.createDataFrame([(path,)], "p string").select(sections.infer_ticker("p"), sections.infer_type("p"), sections.infer_date("p").cast("string")).first()
    assert tuple(r) == (ticker, kind, day)


def test_bad_bytes_become_replacement_characters(spark):
    df = spark.createDataFrame([(bytearray(b"a\xff\xc3\xa9"),)], "c binary")
    assert df.select(files.decode("c")).first()[0] == "a�é"
