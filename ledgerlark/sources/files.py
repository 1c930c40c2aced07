"""Readers and writers of files: filings, lexicon tables, prices, panels, manifests, the model cache."""

from __future__ import annotations

import os
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.config import CATEGORIES

# Column names of the word and of each category in the lexicon's vintages.
WORD_NAMES = ("Word", "WORD", "word")
FLAG_NAMES = {
    "negative": ("Negative", "NEGATIVE"), "positive": ("Positive", "POSITIVE"), "uncertainty": ("Uncertainty", "UNCERTAINTY"), "litigious": ("Litigious", "LITIGIOUS"),
    "strong_modal": ("StrongModal", "Strong_Modal", "STRONG_MODAL"), "weak_modal": ("WeakModal", "Weak_Modal", "WEAK_MODAL"), "constraining": ("Constraining", "CONSTRAINING"),
}


def list_filings(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime, content) of .htm, .html and .txt files below a folder, any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.unionByName(_empty_files(files))
    return files.where(F.lower("path").rlike("\\.(html?|txt)$"))


def _empty_files(files: DataFrame) -> DataFrame:
    """The files without bytes, which Spark's scan leaves out; the list of names is the one its file index holds anyway."""
    names = [re.sub("^file:/+", "file:/", unquote(p)) for p in files.inputFiles()]
    listed = files.sparkSession.createDataFrame([(n,) for n in names], "path string")
    rows = listed.join(files.select(F.regexp_replace("path", "^file:/+", "file:/").alias("path")), "path", "left_anti")
    empty = {"modificationTime": F.lit(None).cast("timestamp"), "length": F.lit(0).cast("long"), "content": F.lit(b"").cast("binary")}
    return rows.select("path", *[c.alias(n) for n, c in empty.items()])


def decode(content: Column | str) -> Column:
    """UTF-8 with U+FFFD for bad bytes."""
    c = F.col(content) if isinstance(content, str) else content
    return F.make_valid_utf8(c.cast("string"))


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    """(path, content)."""
    return list_filings(spark, path).select("path", F.coalesce(decode("content"), F.lit("")).alias("content"))


def find_col(columns: list[str], candidates: tuple[str, ...]) -> str | None:
    """The first candidate that is a column."""
    return next((c for c in candidates if c in columns), None)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (word, category) of a lexicon CSV; comma, or tab where that gives more than three columns.

    A word belongs to a category when its flag is above 0; a category without a column has no words."""
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    df = spark.read.option("header", True).csv(path)
    if len(df.columns) <= 3:
        tab = spark.read.option("header", True).option("sep", "\t").csv(path)
        df = tab if len(tab.columns) > 3 else df
    word = find_col(df.columns, WORD_NAMES) or df.columns[0]
    flags = {k: c for k in CATEGORIES if (c := find_col(df.columns, FLAG_NAMES[k]))}
    member = [F.when(F.coalesce(F.nanvl(F.col(f"`{c}`").try_cast("double"), F.lit(0.0)), F.lit(0.0)) > 0, F.lit(k)) for k, c in flags.items()]
    rows = df.where(F.col(f"`{word}`").isNotNull()).select(F.upper(F.trim(f"`{word}`")).alias("word"), F.explode(F.array_compact(F.array(*member))).alias("category"))
    return rows.distinct()


def melt_prices(wide: DataFrame, day: str = "Date") -> DataFrame:
    """(dt, ticker, close) of a table with a column for each ticker; missing closes are left out."""
    tickers = [c for c in wide.columns if c != day]
    long = wide.unpivot([day], tickers, "ticker", "close")
    return long.select(F.col(day).cast("date").alias("dt"), "ticker", F.col("close").cast("double").alias("close")).where("close is not null and not isnan(close)")


def with_suffix(path: str) -> str:
    return path if path.endswith(".parquet") else path + ".parquet"


def save_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    """K1: writes a table; the suffix is added where missing."""
    path = with_suffix(path)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Reads a table; FileNotFoundError where there is none."""
    path = with_suffix(path)
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def load_panel(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first panel that exists, Parquet or CSV with its types told from the values, else the made-up one."""
    from ledgerlark.sources.demo import demo_panel

    for p in paths:
        if exists(spark, p):
            return spark.read.option("header", True).option("inferSchema", True).csv(p) if p.endswith(".csv") else spark.read.parquet(p)
    return demo_panel(spark)


def load_first(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first table that exists, Parquet or CSV, else an empty one with the schema."""
    for p in paths:
        if exists(spark, p):
            return spark.read.schema(schema).option("header", True).csv(p) if p.endswith(".csv") else spark.read.parquet(p)
    return spark.createDataFrame([], schema)


def manifest(files: DataFrame) -> DataFrame:
    """K2, X11: (ticker, filing_type, filepath, file_size_kb) of listed files."""
    from ledgerlark.operators.sections import infer_ticker, infer_type

    return files.select(infer_ticker("path").alias("ticker"), infer_type("path").alias("filing_type"), F.col("path").alias("filepath"), F.round(F.col("length") / 1024, 1).alias("file_size_kb"))


def save_csv(df: DataFrame, path: str) -> None:
    """K2."""
    df.write.mode("overwrite").option("header", True).csv(path)


def cache_name(identifier: Column | str) -> Column:
    """K5: an identifier as a file name."""
    c = F.col(identifier) if isinstance(identifier, str) else identifier
    return F.regexp_replace(c, "(?U)[^\\w\\-]", "_")


def load_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """K4: the cached results; none where the cache is absent or can't be read."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(path)


def append_cache(results: DataFrame, path: str) -> None:
    """K3."""
    results.write.mode("append").parquet(path)
