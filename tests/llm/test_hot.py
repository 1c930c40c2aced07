"""A third of all rows hold the same key or the same text."""

from pyspark.sql import functions as F

from ledgerlark.llm import common, p1_lookalike, p2_near, p7_garbled, p8_packing, p10_spans

N = 3000


def test_filings_with_a_hot_text(spark):
    i = F.col("id")
    own = F.concat_ws(" ", F.lit("filing"), *[F.concat(F.lit("w"), F.pmod(F.xxhash64(i, F.lit(k)), F.lit(5000)).cast("string")) for k in range(40)])
    hot = F.lit("the same risk factors text in a third of all rows, word for word, café and all " * 3)
    t = F.when(i % 3 == 0, hot).otherwise(own)
    rows = spark.range(N).select(i.alias("filing_id"), F.lit("HOT").alias("ticker"), t.alias("item_1a_text"), F.lit(None).cast("string").alias("mda_text"), F.current_timestamp().alias("loaded_at"))
    odd = spark.createDataFrame([(10**6, "HOT", ("the same risk factors text in a third of all rows, word for word, café and all " * 3), None)], "filing_id long, ticker string, item_1a_text string, mda_text string").withColumn("loaded_at", F.current_timestamp())
    table = rows.unionByName(odd)
    assert p1_lookalike.found_pairs(table).count() == N // 3
    members, pairs = p2_near.near(common.sections(table))
    assert members.count() == N + 1 and pairs.count() == 0
    assert p7_garbled.found(common.sections(table)).count() == 0


def test_documents_with_a_hot_chunk(spark):
    """Boilerplate shorter than a span in a third of the documents gives no pairs and no quadratic work."""
    i = F.col("id")
    own = lambda k: F.concat_ws(" ", *[F.sha2(F.concat(i.cast("string"), F.lit(f"{k}{j}")), 256) for j in range(4)])
    boiler = "".join(f"clause {k} of the standard terms; " for k in range(9))[:260]
    text = F.when(i % 3 == 0, F.concat(own("a"), F.lit(boiler), own("b"))).otherwise(own("c"))
    docs = spark.range(N).select(i.alias("doc_id"), text.alias("text"))
    assert p10_spans.document_pairs(docs).count() == 0
    shared = spark.createDataFrame([(10**6, "x" * 7 + boiler + "y" * 60), (10**6 + 1, "z" + boiler + "y" * 60)], "doc_id long, text string")
    assert [tuple(r) for r in p10_spans.document_pairs(docs.unionByName(shared)).collect()] == [(10**6, 10**6 + 1)]


def test_packing_of_one_length(spark):
    counts = spark.range(N).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 700).otherwise(F.col("id") % 50 + 1).cast("long").alias("tokens"))
    rows = p8_packing.pack(counts).groupBy("container_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    r = rows.agg(F.max("t").alias("t"), F.sum("n").alias("n"), F.count("*").alias("c")).first()
    assert r["t"] <= 2048 and r["n"] == N and r["c"] <= 520
