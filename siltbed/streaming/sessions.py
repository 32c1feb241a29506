"""Sessions over a stream: event-time windows that end after a gap, with a watermark and counted late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from siltbed.session import state_partitions


def sessions(rows: DataFrame, key: str, at: str, gap: str, *measures, late: str | None = None) -> DataFrame:
    """key, start, end and measures of each session: a key's rows with less than gap between one and the next.

    In a stream, a session is given once it can't grow any more, when the watermark, `late` behind the latest time
    seen, has passed its end; rows that come later than that are dropped and counted. Rows without a time are left out.
    """
    rows = rows.where(F.col(at).isNotNull())
    rows = rows.withWatermark(at, late) if late else rows
    found = rows.groupBy(key, F.session_window(at, gap).alias("w")).agg(*measures)
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in found.columns if c not in (key, "w")])


def run_sessions(spark: SparkSession, source: str, schema: StructType, key: str, at: str, gap: str, late: str, measures, out: str, checkpoint: str, files: int | None = None, partitions: int | None = None) -> StreamingQuery:
    """Adds the sessions of the files that have arrived at source to the Parquet files in out, each once.

    State has `partitions` parts from the first start on.
    """
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)
    found = sessions(stream, key, at, gap, *measures, late=late)
    writer = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    with state_partitions(spark, partitions):
        return writer.trigger(availableNow=True).start()


def late_rows(query: StreamingQuery) -> int:
    """How many rows, summed up by key and session within a batch, a run has dropped as too late."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
