"""Status snapshots: value counts of several columns, stacked, from one scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status_counts(df: DataFrame, columns: Sequence[str], tags: str) -> DataFrame:
    """status_name, status_value (null as 'null'; '' stays), rcd_count and tags; partial sums meet in one small shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("status_name"), F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("status_value")) for c in columns])
    counted = df.select(F.explode(pairs).alias("x")).groupBy("x.status_name", "x.status_value").agg(F.count("*").alias("rcd_count"))
    return counted.withColumn("tags", F.lit(tags))


def append_snapshot(df: DataFrame, columns: Sequence[str], tags: str, path: str, mode: str = "append") -> None:
    """Adds one snapshot, stamped with the time, to the history at path; an empty table adds nothing."""
    if df.isEmpty():
        return
    rows = status_counts(df, columns, tags).withColumn("created_at", F.localtimestamp())
    rows.write.mode(mode).parquet(path)


def read_history(history: DataFrame, limit: int = 3000) -> DataFrame:
    """The latest rows of a history, '' shown as 'empty'."""
    latest = history.orderBy(F.col("created_at").desc(), "status_name", "status_value").limit(limit)
    return latest.withColumn("status_value", F.when(F.col("status_value") == "", "empty").otherwise(F.col("status_value")))
