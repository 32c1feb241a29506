"""The snapshot job over arriving files: each micro-batch's counts are added to a history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from siltbed.operators.snapshot import append_snapshot


def run_snapshots(spark: SparkSession, source: str, schema: StructType, columns: Sequence[str], tags: str, history: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Counts what has arrived at source since the last batch; once if `every` is not given, else at that interval.

    A batch has a folder of its own (batch=number), so one that is run again after a failure is not counted twice.
    """

    def batch(df: DataFrame, number: int) -> None:
        append_snapshot(df, columns, tags, f"{history}/batch={number}", "overwrite")

    writer = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
