"""Keyed incremental snapshots: a stream's state holds each record's last status, and only changes are counted.

A record that changes emits -1 for its old status and +1 for its new one. A micro-batch adds its changes to the counts
of the batch before, so no snapshot scans history, and one that is run again overwrites its own counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from siltbed.session import state_partitions

COUNTS = "status_name string, status_value string, rcd_count long"
_CHANGES = "status_name string, status_value string, change long, late long"
#: Buckets that keys are dealt to by their hash: a call per bucket and micro-batch, not per key. A checkpoint holds for one number.
BUCKETS = 512


def _packed(rows: pd.DataFrame) -> bytes:
    table, out = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as to:
        to.write_table(table)
    return out.getvalue().to_pybytes()


def _latest(rows: pd.DataFrame, names: Sequence[str]) -> pd.DataFrame:
    """The last row of each key."""
    return rows.sort_values(["at", "tie", *names]).drop_duplicates("key", keep="last")


def _later(rows: pd.DataFrame, held: pd.DataFrame) -> pd.Series:
    """Which rows are later than the held ones beside them."""
    at, tie = held["at"].to_numpy(), held["tie"].to_numpy()
    return (rows["at"] > at) | ((rows["at"] == at) & (rows["tie"] > tie))


def status_changes(rows: DataFrame, key: str, at: str, tie: str, columns: Sequence[str]) -> DataFrame:
    """status_name, status_value, change (a sum of +1 and -1) and late from a stream of a record's statuses over time.

    A record's status is that of its latest row, by at and then tie, a number, and within a batch then by the greatest
    statuses; a null status is 'null'. Rows that are
    no later than what the state holds, late or repeated ones, change nothing and are counted by `late`, in a row without a
    status. Rows without key, at or tie are left out; keys are of a simple type. State is a table per bucket of keys, with a
    row per key: its time, its tie, its statuses.
    """
    wide = rows.dropna(subset=[key, at, tie]).select(
        F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket"), F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(tie).cast("long").alias("tie"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(f"s{i}") for i, c in enumerate(columns)],
    )
    names = [f"s{i}" for i in range(len(columns))]

    def change(_: Any, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pa.ipc.open_stream(bytes(state.get[0])).read_all().to_pandas() if state.exists else None
        known = None if held is None else pd.Index(held["key"])
        best, late = None, 0
        for part in parts:
            part = part[["key", "at", "tie", *names]]
            if held is not None:
                place = known.get_indexer(part["key"])
                late += int((~_later(part[place >= 0], held.iloc[place[place >= 0]])).sum())
            best = _latest(part if best is None else pd.concat([best, part]), names)
        place = np.full(len(best), -1) if held is None else known.get_indexer(best["key"])
        new, of_held = best[place < 0], best[place >= 0]
        gone = place[:0]
        if len(of_held):
            later = _later(of_held, held.iloc[place[place >= 0]]).to_numpy()
            of_held, gone = of_held[later], place[place >= 0][later]
        out = []
        for i, c in enumerate(columns):
            counts = pd.concat([new, of_held])[f"s{i}"].value_counts()
            if len(gone):
                counts = counts.sub(held[f"s{i}"].iloc[gone].value_counts(), fill_value=0)
            out += [(c, value, int(n), 0) for value, n in counts.items() if n]
        if len(new) or len(gone):
            stays = [] if held is None else [held.drop(held.index[gone])]
            state.update((_packed(pd.concat([*stays, of_held, new], ignore_index=True)),))
        if late:
            out.append((None, None, 0, late))
        yield pd.DataFrame(out, columns=["status_name", "status_value", "change", "late"])

    return wide.groupBy("bucket").applyInPandasWithState(change, _CHANGES, "held binary", "append", GroupStateTimeout.NoTimeout)


def run_changes(
    spark: SparkSession, source: str, schema: StructType, key: str, at: str, tie: str, columns: Sequence[str], history: str, checkpoint: str, files: int | None = None, every: str | None = None, partitions: int | None = None
) -> StreamingQuery:
    """Follows the files at source; `history` gets a folder batch=number with the counts after each micro-batch.

    A batch has `files` files at most, if given. It runs once over what has arrived, or at the interval `every`. With
    the same checkpoint it goes on where it stopped. A history's batch has the whole counts, a row per status, and a
    row without a status for the late rows so far. State has `partitions` parts from the first start on.
    """
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)

    def batch(df: DataFrame, number: int) -> None:
        session = df.sparkSession
        counts = df.groupBy("status_name", "status_value").agg(F.sum(F.col("change") + F.col("late")).alias("rcd_count"))
        if number:
            counts = counts.unionByName(session.read.schema(COUNTS).parquet(f"{history}/batch={number - 1}"))
        counts = counts.groupBy("status_name", "status_value").agg(F.sum("rcd_count").alias("rcd_count")).where("rcd_count <> 0")
        counts.coalesce(1).write.mode("overwrite").parquet(f"{history}/batch={number}")

    writer = status_changes(stream, key, at, tie, columns).writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint)
    with state_partitions(spark, partitions):
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def latest_counts(spark: SparkSession, history: str) -> DataFrame:
    """status_name, status_value and rcd_count after the last batch."""
    every = spark.read.schema(f"{COUNTS}, batch int").parquet(history)
    last = every.agg(F.max("batch")).first()[0]
    return every.where((F.col("batch") == last) & F.col("status_name").isNotNull()).drop("batch")


def late_rows(spark: SparkSession, history: str) -> int:
    """How many rows came late or again so far."""
    every = spark.read.schema(f"{COUNTS}, batch int").parquet(history)
    return every.groupBy("batch").agg(F.coalesce(F.sum(F.when(F.col("status_name").isNull(), F.col("rcd_count"))), F.lit(0))).orderBy(F.desc("batch")).first()[1]
