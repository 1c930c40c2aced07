"""Streams over landed filings and filing tables: the text transforms are stateless; daily counts keep a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlark.functions import lexicon, text
from ledgerlark.operators.sections import parse_filings
from ledgerlark.sources.files import decode


def stream_raw(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """Landed files as (path, content), picked up as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(path)
    return rows.where(F.lower("path").rlike("\\.(html?|txt)$")).select("path", F.coalesce(decode("content"), F.lit("")).alias("content"))


def stream_parsed(spark: SparkSession, path: str) -> DataFrame:
    """Landed files as parsed filings."""
    return parse_filings(stream_raw(spark, path))


def stream_table(spark: SparkSession, path: str, schema: StructType | str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def scored(filings: DataFrame, lex: DataFrame) -> DataFrame:
    """Adds text statistics and lexicon scores to a stream (or a table) of filings; lex is a plain table."""
    rows = filings.withColumn("_s", text.text_stats("item_1a_text"))
    rows = rows.withColumns({f"stat_1a_{n}": F.col(f"_s.{n}") for n in ("word_count", "fog_index")}).drop("_s")
    return lexicon.score_columns(rows, lex, "item_1a_text", "lm_1a_")


def first_deliveries(filings: DataFrame, key: str = "filing_id", at: str = "loaded_at", late: str = "120 days") -> DataFrame:
    """A filing delivered again within the watermark counts once."""
    return filings.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def daily_counts(filings: DataFrame, at: str = "loaded_at", late: str = "1 day") -> DataFrame:
    """(day, filing_type, n) of deliveries in tumbling days; rows later than the watermark are dropped."""
    rows = filings.withWatermark(at, late).groupBy(F.window(at, "1 day"), "filing_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("day"), "filing_type", "n")


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", once: bool = True):
    """Starts a Parquet sink; once: processes what is there and stops."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode)
    return (w.trigger(availableNow=True) if once else w).start()
