"""Shared inputs of the text operators: filing sections, documents, written intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.sources.scratch import drop_written, shared_dir, written

SECTIONS = (("item_1a", "item_1a_text"), ("mda", "mda_text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def has_text(c: Column | str) -> Column:
    """True where a section or document holds more than blanks."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).rlike(r"(?U)\S")


def sections(filings: DataFrame, **more: Column) -> DataFrame:
    """One row (filing_id, loaded_at, section, text, *more) for each delivered section that holds text.

    Rows without filing_id, NULL, empty and blank sections give nothing. Deliveries are not merged here, so the
    texts need no shuffle; ``latest`` merges the narrow results instead. more: columns of the filing by name."""
    has_time = "loaded_at" in filings.columns
    base = filings.where(F.col("filing_id").isNotNull()).select(
        F.col("filing_id").cast("long").alias("filing_id"),
        (F.col("loaded_at").cast("timestamp") if has_time else F.lit(None).cast("timestamp")).alias("loaded_at"),
        F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.col(c).alias("text")) for s, c in SECTIONS])).alias("s"),
        *[c.alias(n) for n, c in more.items()],
    )
    return base.select("filing_id", "loaded_at", "s.section", "s.text", *more).where(has_text("text"))


def latest(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The values of the row with the latest loaded_at for each key; ties go to the greatest values."""
    top = F.max(F.struct(F.coalesce("loaded_at", F.timestamp_seconds(F.lit(0))).alias("at"), *values)).alias("top")
    return df.groupBy(*keys).agg(top).select(*keys, *[F.col(f"top.{v}").alias(v) for v in values])


def batches(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """mapInPandas with a function of one Arrow batch."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                yield f(pdf)

    return df.mapInPandas(run, schema)


def arrow_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch: columns that only pass through aren't converted, nested ones are built at once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                yield f(batch)

    return df.mapInArrow(run, schema)


def structs(rows: list[list[tuple] | None], fields: list[tuple[str, pa.DataType]]) -> pa.Array:
    """An Arrow array of lists of structs from lists of tuples."""
    offsets, flat = [0], []
    for r in rows:
        flat += r or []
        offsets.append(len(flat))
    cols = list(zip(*flat)) if flat else [[]] * len(fields)
    values = pa.StructArray.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])
    missing = pa.array([r is None for r in rows], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=missing)


#: Parts that a hot key is split into.
SALTS = 16


def join_salted(many: DataFrame, few: DataFrame, key: str, by: str, salts: int = SALTS) -> DataFrame:
    """The inner join on one key of `many` rows, where a key may be hot, with `few` that have each key about once: the rows
    of a key are spread by the hash of another column, and the few repeated for each part."""
    salt = F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")
    few = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.withColumn("_salt", salt).join(few, [key, "_salt"]).drop("_salt")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows over all cores, before each becomes many: a small table has few splits, and AQE would merge them."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)
