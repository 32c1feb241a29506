"""As-of alignment: for each row, the last known values at or before its time.

Both sides are merged in sampled ranges of key and time, so one hot key is spread over many tasks. A range carries
values forward in one sweep over its sorted rows. What it does not know, the rows of its first key before any value,
it leaves open, and each range tells its last known value; those, a row per range, are carried across the borders.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltbed.session import written

#: What a row of the merged sides is, and what a row of the swept ranges is.
KNOWN, ASKED = 0, 1
ROW, BORDER = 0, 1


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, key, side, row, value) of one range in order: the asked rows with their values, then the border."""
    before: pa.Table | None = None  # the last known row of the key at hand, or else the last row
    first_key, part, in_first, schema = None, None, True, None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if before is None:
            first_key, part, skip = t["key"][0], t["part"][0], 0
        else:
            t, skip = pa.concat_tables([before, t]), 1
        t = t.combine_chunks()
        schema, n = batch.schema, t.num_rows
        at, key = np.arange(n), t["key"].combine_chunks()
        new = np.zeros(n, bool)
        new[1:] = compute.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        begin = np.maximum.accumulate(np.where(new, at, 0))
        side = t["side"].to_numpy()
        last = np.maximum.accumulate(np.where(side == KNOWN, at, -1))
        known = last >= begin
        asked = np.flatnonzero((side == ASKED) & (at >= skip))
        is_open = ~known & in_first & (np.cumsum(new) == 0)
        values = t["value"].take(pa.array(last[asked], mask=~known[asked]))
        yield _out(len(asked), ROW, part, is_open[asked], t["key"].take(pa.array(asked)), None, t["row"].take(pa.array(asked)), known[asked], values)
        in_first = in_first and not new.any()
        before = t.slice(int(last[-1]) if known[-1] else n - 1, 1)
    if before is not None:
        known = before["side"][0].as_py() == KNOWN
        yield _out(1, BORDER, part, np.array([False]), pa.array([first_key.as_py()]), before["key"], pa.nulls(1, schema.field("row").type), np.array([known]), before["value"] if known else pa.nulls(1, schema.field("value").type))


def _out(n: int, kind: int, part: pa.Scalar, is_open: np.ndarray, key, last_key, row, known: np.ndarray, value) -> pa.RecordBatch:
    flat = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    columns = {
        "kind": pa.array(np.full(n, kind, np.int32)), "part": pa.array(np.full(n, part.as_py(), np.int32)), "open": pa.array(is_open), "key": flat(key).cast(pa.string()),
        "last_key": pa.nulls(n, pa.string()) if last_key is None else flat(last_key).cast(pa.string()), "row": flat(row), "known": pa.array(known), "value": flat(value),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, values: Sequence[str], ranges: int | None = None) -> DataFrame:
    """left's columns and values, those of the last row of right with the same by and a time at or before left's.

    Both sides have the columns by and at; values are columns of right that left has not. Where no such row is, values
    are null. Of right's rows with the same by and time, the one with the greatest values counts, in the order of
    values. A null in by or at matches nothing, as in a join. Every row of left comes back once, repeated rows too.
    """
    clash = set(values) & set(left.columns)
    if clash:
        raise ValueError(f"left has {sorted(clash)} already")
    spark = left.sparkSession
    key = F.to_json(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)])).alias("key")
    known = right.dropna(subset=[*by, at]).select(key, F.col(at).alias("at"), F.lit(KNOWN).alias("side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("row"), F.struct(*values).alias("value"))
    asked = left.select(key, F.col(at).alias("at"), F.lit(ASKED).alias("side"), F.struct(*left.columns).alias("row"), F.lit(None).cast(known.schema["value"].dataType).alias("value"))
    both = known.unionByName(asked)
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartitionByRange(n, "key", "at").sortWithinPartitions("key", "at", "side", "value")
    both = both.select(F.spark_partition_id().alias("part"), "key", "side", "row", "value")
    row, value = (both.schema[c].dataType for c in ("row", "value"))
    kinds = f"kind int, part int, open boolean, key string, last_key string, row {row.simpleString()}, known boolean, value {value.simpleString()}"
    swept = written(both.mapInArrow(_sweep, kinds))

    borders = swept.where(F.col("kind") == BORDER)
    told = borders.where("known").select(F.col("last_key").alias("key"), "part", F.lit(1).alias("asks"), F.struct("value").alias("v"))
    asking = borders.select("key", "part", F.lit(0).alias("asks"), F.lit(None).cast(told.schema["v"].dataType).alias("v"))
    earlier = Window.partitionBy("key").orderBy("part", "asks").rowsBetween(Window.unboundedPreceding, -1)
    carried = told.unionByName(asking).withColumn("carried", F.last("v", ignorenulls=True).over(earlier)).where("asks = 0 AND carried IS NOT NULL").select("part", "carried")
    found = swept.where(F.col("kind") == ROW)
    done = found.where("NOT open").select("row", F.when(F.col("known"), F.col("value")).alias("value"))
    rest = found.where("open").join(F.broadcast(carried), "part", "left").select("row", F.col("carried.value").alias("value"))  # a row per range
    return done.unionByName(rest).select("row.*", *[F.col(f"value.{c}").alias(c) for c in values])
