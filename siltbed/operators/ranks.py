"""A rank directory: rows in ranges of a sort order, with the number of rows before each range.

Ranges come from Spark's sampled range partitioning, with a hash of the row behind the sort keys, so that rows with
one hot key are spread too. Row numbers, pages and percent ranks follow from the directory, a row per range, without
a window over the whole table.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.session import scratch_folder


class Directory:
    """The sorted ranges in a folder; `starts` has the first row number (from 0) of each range, and `total` all rows."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.schema = spark, path, None
        sizes = {r.range: r["count"] for r in spark.read.parquet(f"{path}/sizes").collect()}
        self.starts, self.total = [], 0
        for i in range(max(sizes, default=-1) + 1):
            self.starts.append(self.total)
            self.total += sizes.get(i, 0)

    @classmethod
    def build(cls, df: DataFrame, *order: Column | str, path: str | None = None, ranges: int | None = None) -> Directory:
        """Sorts df into ranges and writes them; order may have descending columns and places of nulls.

        What comes to the driver is a count per range. Rows that are equal in all columns are numbered next to each other.
        """
        spark = df.sparkSession
        path = path or scratch_folder(spark)
        n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
        keys = [*order, F.xxhash64(*df.columns)]
        rows = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
        rows = rows.select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"))
        rows.write.partitionBy("range").parquet(f"{path}/rows")
        schema = rows.schema
        stored = spark.read.schema(schema).parquet(f"{path}/rows")
        stored.groupBy("range").count().coalesce(1).write.parquet(f"{path}/sizes")
        made = cls(spark, path)
        made.schema = schema
        return made

    def rows(self) -> DataFrame:
        reader = self.spark.read if self.schema is None else self.spark.read.schema(self.schema)
        return reader.parquet(f"{self.path}/rows")

    def numbered(self, rows: DataFrame | None = None) -> DataFrame:
        """The rows with `number`, their place in the whole order from 0."""
        starts = self.spark.createDataFrame(list(enumerate(self.starts)), "range int, start long")
        rows = self.rows() if rows is None else rows
        return rows.join(F.broadcast(starts), "range").withColumn("number", F.col("start") + F.col("place")).drop("range", "place", "start")

    def ranges_of(self, first: int, last: int) -> list[int]:
        """The ranges that hold the rows from number first up to, without, last."""
        if first >= min(last, self.total) or last <= 0:
            return []
        return list(range(max(0, bisect_right(self.starts, max(first, 0)) - 1), bisect_right(self.starts, min(last, self.total) - 1)))

    def page(self, number: int, size: int) -> DataFrame:
        """Page `number` (from 0) in order, with the rows' numbers; reads the folders of its ranges alone."""
        first = number * size
        rows = self.rows().where(F.col("range").isin(self.ranges_of(first, first + size)))
        return self.numbered(rows).where(F.col("number").between(first, first + size - 1)).orderBy("number")


def running_sum(df: DataFrame, value: str, *order: Column | str) -> DataFrame:
    """df with `total`, the sum of a column of whole numbers up to each row in a total order; nulls add nothing.

    Sums are taken within ranges and over the ranges' sums, a row per range, which come to the driver.
    """
    index = Directory.build(df, *order)
    rows = index.rows()
    sums = dict(rows.groupBy("range").agg(F.coalesce(F.sum(value), F.lit(0))).collect())
    before = list(enumerate(accumulate((sums.get(i, 0) for i in range(len(index.starts) - 1)), initial=0)))
    starts = df.sparkSession.createDataFrame(before, "range int, before long")
    within = F.sum(value).over(Window.partitionBy("range").orderBy("place"))
    rows = rows.withColumn("within", F.coalesce(within, F.lit(0))).join(F.broadcast(starts), "range")
    return rows.select(*df.columns, (F.col("before") + F.col("within")).alias("total"))


def _last(most: float, n: Column) -> Column:
    """The greatest place p (from 0) among n with p / (n - 1) <= most, in doubles as percent_rank() has it; -1 if none."""
    about = F.floor(most * (n - 1)).cast("long")
    fits = lambda p: (p <= n - 1) & ((p <= 0) | (p / F.greatest(n - 1, F.lit(1)) <= most))
    return F.coalesce(F.get(F.filter(F.array(about + 1, about, about - 1), fits), F.lit(0)), F.lit(-1).cast("long"))


def _last_below(least: float, n: Column) -> Column:
    """The greatest place p among n with p / (n - 1) < least; -1 if none."""
    about = F.floor(least * (n - 1)).cast("long")
    below = lambda p: (p >= 0) & (p <= n - 1) & (p / F.greatest(n - 1, F.lit(1)) < least)
    return F.coalesce(F.get(F.filter(F.array(about + 1, about, about - 1), below), F.lit(0)), F.lit(-1).cast("long"))


def between_percents(df: DataFrame, by: str, order: str, low: float, high: float) -> DataFrame:
    """Rows of each series whose percent rank is from low to high, in percent, ties included, nulls first.

    The keys at the two ends of each series are looked up by their row numbers; the rows between them follow by
    comparing keys. A null series is one of its own.
    """
    index = Directory.build(df.select(F.col(by).alias("by"), F.col(order).alias("key")), "by", "key")
    numbered = index.numbered()
    series = numbered.groupBy("by").agg(F.min("number").alias("begin"), F.count("*").alias("n"))
    # the last place below the range, the one behind it, and the last one inside
    below = F.when(F.lit(low) <= 0, F.lit(-1).cast("long")).otherwise(_last_below(low / 100, F.col("n")))
    series = series.withColumn("below", below).withColumn("last", _last(high / 100, F.col("n")))
    wanted = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(p).alias("place")) for kind, p in (("below", "below"), ("last", "last"))])
    at = series.select(F.col("by").alias("of"), "begin", F.explode(wanted).alias("x")).where("x.place >= 0").select("of", "x.kind", (F.col("begin") + F.col("x.place")).alias("number"))
    ends = numbered.join(at, "number").groupBy("of").agg(*[F.first(F.when(F.col("kind") == k, F.struct("key")), True).alias(k) for k in ("below", "last")])
    value = F.struct(F.col(order).alias("key"))
    out = df.join(ends, F.col(by).eqNullSafe(F.col("of"))).where(F.col("last").isNotNull() & (value <= F.col("last")) & (F.col("below").isNull() | (value > F.col("below"))))
    return out.select(*[df[c] for c in df.columns])
