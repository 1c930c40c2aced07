import datetime as dt

from ledgerlark.streaming import landing


def test_stream_of_landed_files(spark, tmp_path):
    d = tmp_path / "in" / "abc" / "10-K"
    d.mkdir(parents=True)
    body = "Our losses may rise because customers decline to buy. " * 10
    (d / "2020-01-04_1.htm").write_text(f"<p>Item 1A. Risk Factors</p><p>{body}</p><p>Item 1B. x</p>")
    lex = spark.createDataFrame([("LOSSES", "negative")], "word string, category string")
    for n in (1, 2):
        q = landing.write(landing.scored(landing.stream_parsed(spark, str(tmp_path / "in")), lex).select("ticker", "lm_1a_negative_count"), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
        (d / "2021-01-04_2.htm").write_text(f"<p>Item 1A. Risk Factors</p><p>{body}</p>")


def test_redeliveries_and_daily_counts(spark, tmp_path):
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    schema = "filing_id long, filing_type string, loaded_at timestamp"
    rows = [(1, "10-K", at(1, 1)), (1, "10-K", at(1, 5)), (2, "10-Q", at(2, 1)), (3, "10-K", at(9, 1))]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "t"))
    s = landing.first_deliveries(landing.stream_table(spark, str(tmp_path / "t"), schema))
    landing.write(s, str(tmp_path / "o1"), str(tmp_path / "c1")).awaitTermination()
    assert sorted(r["filing_id"] for r in spark.read.parquet(str(tmp_path / "o1")).collect()) == [1, 2, 3]
    c = landing.daily_counts(landing.stream_table(spark, str(tmp_path / "t"), schema))
    landing.write(c, str(tmp_path / "o2"), str(tmp_path / "c2")).awaitTermination()
    assert {(r["day"].day, r["filing_type"], r["n"]) for r in spark.read.parquet(str(tmp_path / "o2")).collect()} >= {(1, "10-K", 2), (2, "10-Q", 1)}
