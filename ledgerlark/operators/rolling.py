"""Problem 6: totals and averages over trailing periods for each entity and day, days without activity included.

Daily totals are exploded onto every day whose windows they lie in, grouped by entity and day, and joined with the
calendar of the entity. Rows are added up per entity and day before anything is exploded, and the daily totals of one
entity and month are brought together first, so that the exploded rows are mostly added up before they are shuffled;
a hot entity is spread over its months.

Results: NULL and NaN add 0. Events without entity or day don't count; an entity without any event has no rows. Of rows
with one id only the one with the latest load time is valid (ties: the greatest values); rows without an id all count.
The calendar of an entity runs from its first to its last event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_rows(df: DataFrame, row_id: str, loaded: str, columns: list[str]) -> DataFrame:
    """The valid row of each id with the columns named; rows without an id stay as they are."""
    top = df.where(F.col(row_id).isNotNull()).groupBy(row_id).agg(F.max(F.struct(F.coalesce(loaded, F.timestamp_seconds(F.lit(0))).alias("_at"), *columns)).alias("_top"))
    return top.select(*[F.col(f"_top.{c}").alias(c) for c in columns]).unionByName(df.where(F.col(row_id).isNull()).select(*columns))


def rolling_totals(events: DataFrame, entity: str, day: str, values: list[str], days: list[int]) -> DataFrame:
    """(entity, day, total_<n>d_<value>, avg_<n>d_<value>) for each value and each period of n days."""
    longest = max(days)
    zero = {v: F.coalesce(F.nanvl(F.col(v).cast("double"), F.lit(0.0)), F.lit(0.0)) for v in values}
    known = events.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
    known = known.select(F.col(entity).alias("_e"), F.col(day).cast("date").alias("_d"), *[zero[v].alias(f"_v{i}") for i, v in enumerate(values)])
    daily = known.groupBy("_e", "_d").agg(*[F.sum(f"_v{i}").alias(f"_v{i}") for i in range(len(values))])
    spark = events.sparkSession  # a fixed number of partitions: AQE would merge the few rows before they become many
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    near = daily.withColumn("_m", F.trunc("_d", "month")).repartition(parts, "_e", "_m")
    shifted = near.select("_e", "_d", *[f"_v{i}" for i in range(len(values))], F.explode(F.sequence(F.lit(0), F.lit(longest - 1))).alias("_k"))
    sums = [
        F.sum(F.when(F.col("_k") < n, F.col(f"_v{i}")).otherwise(0.0)).alias(f"total_{n}d_{v}") for n in days for i, v in enumerate(values)
    ]
    reached = shifted.groupBy("_e", F.date_add("_d", F.col("_k")).alias("_day")).agg(*sums)
    span = daily.groupBy("_e").agg(F.min("_d").alias("_first"), F.max("_d").alias("_last"))
    calendar = span.repartition(parts, F.xxhash64("_e")).select("_e", F.explode(F.sequence("_first", "_last")).alias("_day"))
    # sizes are only known before the days are exploded, so a broadcast would be chosen wrongly
    rows = calendar.join(reached.hint("merge"), ["_e", "_day"], "left")
    total = {(n, v): F.coalesce(f"total_{n}d_{v}", F.lit(0.0)) for n in days for v in values}
    return rows.select(
        F.col("_e").alias(entity), F.col("_day").alias("day"),
        *[c.alias(f"total_{n}d_{v}") for (n, v), c in total.items()], *[(c / n).alias(f"avg_{n}d_{v}") for (n, v), c in total.items()],
    )
