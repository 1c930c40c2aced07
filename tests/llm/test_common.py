import datetime as dt

from ledgerlark.llm import common


def test_written_tables_live_in_the_shared_folder(spark):
    df = common.written(spark.range(5), "t")
    assert df.count() == 5 and common.shared_dir(spark).startswith("file:") and all("ledgerlark" in p for p in df.inputFiles())
    common.drop_written(spark)
    assert common.written(spark.range(0), "t").count() == 0


def test_latest(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    df = spark.createDataFrame([(1, at(1), "a"), (1, at(3), "b"), (1, None, "c"), (2, None, "x"), (2, None, "y")], "k int, loaded_at timestamp, v string")
    assert {tuple(r) for r in common.latest(df, ["k"], ["v"]).collect()} == {(1, "b"), (2, "y")}


def test_sections_without_load_time(spark):
    df = spark.createDataFrame([(1, "a", "   "), (2, None, "b"), (None, "c", "c")], "filing_id long, item_1a_text string, mda_text string")
    assert {(r["filing_id"], r["section"]) for r in common.sections(df).collect()} == {(1, "item_1a"), (2, "mda")}
