import json

import pytest

from ledgerlark.plans import panel
from ledgerlark.sources import demo, edgar, files, remote


def test_submissions(spark):
    recent = {"filings": {"recent": {"form": ["10-K", "10-K/A", "10-Q", "10-K"], "filingDate": ["2020-02-01", "2020-03-01", "2020-05-01", "2030-01-01"], "accessionNumber": ["0-1", "0-2", "0-3", "0-4"], "primaryDocument": ["a.htm", "b.htm", "", "d.htm"]}, "files": [{"name": "p2.json"}]}}
    older = {"form": ["10-K", "10-K"], "filingDate": ["2015-02-01", "2016-02-01"], "accessionNumber": ["9-1"], "primaryDocument": ["o.htm", "p.htm"]}
    r = spark.createDataFrame([(7, json.dumps(recent)), (8, "no json")], "cik long, value string")
    o = spark.createDataFrame([(7, json.dumps(older))], "cik long, value string")
    rows = edgar.filing_rows(r, o)
    assert rows.count() == 5  # the older page is cut to its shortest array
    got = edgar.select_filings(rows, "10-K", "2015-01-01", "2024-12-31").collect()
    assert {(x["day"], x["document"]) for x in got} == {("2020-02-01", "a.htm"), ("2015-02-01", "o.htm")}
    assert [x["name"] for x in edgar.older_pages(r).collect()] == ["p2.json"]


def test_plan_of_downloads(spark):
    tickers = edgar.ticker_map(spark.createDataFrame([('{"0":{"ticker":"abc","cik_str":1},"1":{"ticker":"ABC","cik_str":2}}',)], "value string"))
    assert [tuple(r) for r in tickers.collect()] == [("ABC", 2)]
    rows = spark.createDataFrame([(2, "10-K", "2020-01-02", "0-1", "x.txt"), (2, "10-K", "2021-01-02", "0-2", "noext"), (2, "10-Q", "2020-06-02", "0-3", "")], "cik long, form string, day string, accession string, document string")
    forms = ("10-K", "10-Q")
    landed = spark.createDataFrame([("d/ABC/10-K/2020-01-02_0-1.txt", 1000)], "path string, length long")
    plan = edgar.to_fetch(spark.createDataFrame([("abc",)], "ticker string"), forms, tickers, rows, landed, "https://h/", "d")
    assert {(r["url"], r["path"]) for r in plan.collect()} == {("https://h/2/01/x.txt", "d/ABC/10-K/2020-01-02_0-1.txt"), ("https://h/2/02/noext", "d/ABC/10-K/2021-01-02_0-2.htm")}
    more = edgar.to_fetch(spark.createDataFrame([("abc",)], "ticker string"), forms, tickers, rows, landed.selectExpr("path", "1001L as length"), "https://h/", "d")
    assert more.count() == 1
    done = edgar.fetch(more, lambda url, path: url.endswith("noext"), pause=0)
    assert list(done.values()) == [True]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("A", 1.5)], "ticker string, x double")
    p = files.save_parquet(df, str(tmp_path / "t"))
    assert p.endswith(".parquet") and files.load_parquet(spark, str(tmp_path / "t")).count() == 1
    with pytest.raises(FileNotFoundError):
        files.load_parquet(spark, str(tmp_path / "absent"))
    files.save_csv(df, str(tmp_path / "c.csv"))
    schema = "ticker string, x double"
    assert files.load_first(spark, [str(tmp_path / "no.parquet"), str(tmp_path / "c.csv")], schema).first()["x"] == 1.5
    assert files.load_first(spark, [str(tmp_path / "no.parquet")], schema).count() == 0
    assert files.load_cache(spark, str(tmp_path / "cache"), schema).count() == 0
    files.append_cache(df, str(tmp_path / "cache"))
    files.append_cache(df, str(tmp_path / "cache"))
    assert files.load_cache(spark, str(tmp_path / "cache"), schema).count() == 2
    assert spark.createDataFrame([("1a_A B/2",)], "s string").select(files.cache_name("s")).first()[0] == "1a_A_B_2"


def test_melt_prices(spark):
    wide = spark.createDataFrame([("2024-01-02", 1.0, None), ("2024-01-03", float("nan"), 2.0)], "Date string, AAA double, SPY double")
    assert {(str(r["dt"]), r["ticker"], r["close"]) for r in files.melt_prices(wide).collect()} == {("2024-01-02", "AAA", 1.0), ("2024-01-03", "SPY", 2.0)}


def test_demo_data(spark):
    p = demo.demo_panel(spark)
    assert p.count() == 120 and p.exceptAll(demo.demo_panel(spark)).count() == 0
    f = demo.demo_filings(spark)
    assert f.where("filing_type = '10-K'").count() == 300 and f.where("filing_type = '10-Q'").count() == 150


def test_panel_from_disk(spark, tmp_path):
    d = tmp_path / "filings" / "abc" / "10-K"
    d.mkdir(parents=True)
    body = "Our losses may rise because customers decline to buy. " * 10
    for day in ("2020-01-04", "2021-01-04"):
        (d / f"{day}_1.htm").write_text(f"<p>Item 1A. Risk Factors</p><p>{body}</p><p>Item 1B. x</p><p>Item 7. Management</p><p>{body}</p><p>Item 8. Financial Statements</p>")
    (tmp_path / "lm.csv").write_text("Word,Negative,Positive,Uncertainty\nlosses,1,0,0\ndecline,1,0,0\nrise,0,1,0\n")
    days = spark.sql("select explode(sequence(date'2020-01-01', date'2021-06-01')) as dt").crossJoin(spark.sql("select explode(array('ABC', 'SPY')) as ticker"))
    prices = files.save_parquet(days.selectExpr("dt", "ticker", "100d + dayofyear(dt) as close"), str(tmp_path / "prices"))
    sectors = spark.createDataFrame([("ABC", "Energy")], "ticker string, sector string")
    out = panel.build_from_disk(spark, str(tmp_path / "filings"), prices, str(tmp_path / "lm.csv"), str(tmp_path / "panel"), sectors)
    rows = spark.read.parquet(out).orderBy("filing_date").collect()
    assert [r["filing_quarter"] for r in rows] == ["2020Q1", "2021Q1"] and rows[0]["lm_1a_negative_count"] == 20 and rows[0]["sector"] == "Energy"
    assert rows[0]["delta_lm_1a_net_sentiment"] is None and rows[1]["delta_lm_1a_net_sentiment"] == 0 and str(rows[0]["event_date"]) == "2020-01-04"
    assert rows[0]["abret_21d"] == pytest.approx(0)
    panel.register(spark, {"panel": spark.read.parquet(out)})
    assert spark.sql("select count(*) as n from panel").first()["n"] == 2


def test_attempts_and_landing(spark, tmp_path):
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return 7

    assert remote.attempt(flaky, sleep=waits.append) == 7 and waits == [1.0, 2.0]
    with pytest.raises(OSError):
        remote.attempt(lambda: (_ for _ in ()).throw(OSError("down")), sleep=waits.append)
    target = str(tmp_path / "a" / "b.htm")
    assert remote.land(lambda url: [b"x" * 600, b"y" * 600], "u", target) and (tmp_path / "a" / "b.htm").stat().st_size == 1200
    assert remote.land(lambda url: 1 / 0, "u", target)  # it is there already

    def broken(url):
        yield b"x"
        raise OSError("cut")

    assert not remote.land(broken, "u", str(tmp_path / "c.htm")) and not list(tmp_path.glob("c.htm*"))
    assert {tuple(r) for r in remote.outcomes(spark, {"p": True, "q": False}).collect()} == {("p", True), ("q", False)}


def test_lexicon_is_fetched_once(spark, tmp_path):
    path = str(tmp_path / "l" / "lm.csv")
    got = remote.lexicon_from(spark, lambda url: b"Word,Negative,Positive,Uncertainty\nloss,1,0,0\n", "u", path)
    assert [tuple(r) for r in got.collect()] == [("LOSS", "negative")]
    assert remote.lexicon_from(spark, lambda url: 1 / 0, "u", path).count() == 1
    with pytest.raises(RuntimeError):
        remote.lexicon_from(spark, lambda url: 1 / 0, "u", str(tmp_path / "absent.csv"))


def test_prices_after_failures(spark):
    import pandas as pd

    def get(tickers, start, end):
        assert tickers == ["A", "SPY"]
        return pd.DataFrame({"Date": ["2024-01-02", "2024-01-03"], "A": [1.0, None], "SPY": [None, 5.0]})

    got = {(str(r["dt"]), r["ticker"]): r["close"] for r in remote.prices_from(spark, get, ["A"]).collect()}
    assert got == {("2024-01-02", "A"): 1.0, ("2024-01-03", "A"): 1.0, ("2024-01-02", "SPY"): 5.0, ("2024-01-03", "SPY"): 5.0}
    assert remote.prices_from(spark, lambda *a: 1 / 0, ["A"], sleep=lambda s: None).count() == 0


def test_panel_or_the_made_up_one(spark, tmp_path):
    made_up = files.load_panel(spark, [str(tmp_path / "no.parquet")])
    assert made_up.count() == 120 and len(made_up.columns) == 27
    p = files.save_parquet(made_up, str(tmp_path / "panel"))
    assert files.load_panel(spark, [str(tmp_path / "no.csv"), p]).exceptAll(made_up).count() == 0
