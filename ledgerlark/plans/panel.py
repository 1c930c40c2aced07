"""The feature panel (B1 to B3): text statistics, lexicon and model sentiment, changes, market figures, labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.config import DEFAULT
from ledgerlark.functions import dates, lexicon, text
from ledgerlark.operators import deltas, equity, model
from ledgerlark.sources import files

SECTIONS = {"1a": "item_1a_text", "mda": "mda_text"}


def with_text(filings: DataFrame, least: int = DEFAULT.panel_min_chars) -> DataFrame:
    """Filings with more than `least` characters in either section."""
    long = [F.length(text.text_of(c)) > least for c in SECTIONS.values()]
    return filings.where(long[0] | long[1])


def text_columns(df: DataFrame) -> DataFrame:
    """stat_<section>_<figure>."""
    for s, c in SECTIONS.items():
        df = df.withColumn("_s", text.text_stats(c))
        names = ("word_count", "sentence_count", "avg_sentence_length", "fog_index", "vocabulary_richness", "char_count")
        df = df.withColumns({f"stat_{s}_{n}": F.col(f"_s.{n}") for n in names}).drop("_s")
    return df


def lexicon_columns(df: DataFrame, lex: DataFrame, keys: tuple[str, ...] = ("filing_id",)) -> DataFrame:
    """L4: lm_<section>_<metric>."""
    for s, c in SECTIONS.items():
        df = lexicon.score_columns(df, lex, c, f"lm_{s}_", keys=keys)
    return df


def labels(df: DataFrame, sectors: DataFrame) -> DataFrame:
    """Sector (Unknown where missing), filing_year, filing_quarter (NaT where missing)."""
    one = sectors.where("ticker is not null").groupBy("ticker").agg(F.max("sector").alias("sector"))
    df = df.join(one, "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    return df.withColumns({"filing_year": dates.year("filing_date"), "filing_quarter": dates.quarter_label("filing_date")})


def build_feature_panel(
    filings: DataFrame, prices: DataFrame, lex: DataFrame, sectors: DataFrame, scorer: Callable | None = None, keys: tuple[str, ...] = ("filing_id",), tie: str | None = "filing_id",
    windows: tuple[int, ...] = DEFAULT.return_windows, vol: int = DEFAULT.vol_window,
) -> DataFrame:
    """B2: one row for each filing with text. The texts are dropped before anything is shuffled, but for the model."""
    rows = lexicon_columns(text_columns(with_text(filings)), lex, keys)
    if scorer is not None:
        rows = model.model_columns(rows, list(keys), {"fb_1a_": "item_1a_text", "fb_mda_": "mda_text"}, scorer)
    rows = rows.drop(*SECTIONS.values())
    rows = deltas.deltas(rows, tie=tie)
    return labels(equity.link_equity(rows, prices, windows, vol), sectors)


def build_from_disk(spark: SparkSession, filings_dir: str, prices_path: str, lexicon_path: str, out: str, sectors: DataFrame, scorer: Callable | None = None) -> str:
    """Parses the filings of a folder and writes the panel."""
    from ledgerlark.operators.sections import parse_directory

    filings = parse_directory(spark, filings_dir).withColumn("filing_key", F.concat_ws("_", "ticker", F.col("filing_date").cast("string"), "filing_type"))
    panel = build_feature_panel(filings, files.load_parquet(spark, prices_path), files.read_lexicon(spark, lexicon_path), sectors, scorer, ("filing_key",), "filing_key")
    return files.save_parquet(panel, out)


def register(spark: SparkSession, frames: dict[str, DataFrame]) -> None:
    """The frames as temporary views, for spark.sql."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
