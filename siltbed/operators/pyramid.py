"""A pyramid of summaries of a history: minutes, hours and days that are added to and merged, never counted again.

A cell has a count, a sketch of the distinct keys and a sketch of a value's quantiles, for one kind and one span of
time. A batch's minutes come from its rows, its hours from its minutes, its days from its hours. A range is answered
from the fewest cells: the days inside it, the hours beside them, the minutes beside those.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Levels by name: how many seconds a cell spans, the widest first. Each is a multiple of the next.
LEVELS = {"day": 86_400, "hour": 3_600, "minute": 60}
#: Logarithm of the registers of a distinct sketch (a standard error of some 1.6 %), and the size of a quantile sketch
#: (ranks within some 1.7 % at 99 % confidence).
REGISTERS, SIZE = 12, 200


def spans(start: int, end: int) -> list[tuple[str, int, int]]:
    """(level, from, to) in seconds: the widest cells that make up a range of whole minutes, few ranges of each level."""
    if start % 60 or end % 60:
        raise ValueError("a range has whole minutes")
    out, edges = [], [(start, end)]
    for name, width in LEVELS.items():
        rest = []
        for a, b in edges:
            first, last = -(-a // width) * width, b // width * width
            if first < last:
                out.append((name, first, last))
                rest += [(a, first), (last, b)]
            else:
                rest.append((a, b))
        edges = [(a, b) for a, b in rest if a < b]
    return out


class Pyramid:
    """Cells in a folder, by level and batch; `by` are the columns that tell kinds apart."""

    def __init__(self, spark: SparkSession, path: str, by: Sequence[str]) -> None:
        self.spark, self.path, self.by = spark, path, list(by)

    def add(self, rows: DataFrame, batch: int, at: str, key: str, value: str) -> None:
        """Adds rows (by, a timestamp, a key, a number) as a batch; the same number again replaces it. Rows without a time are left out."""
        start = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / 1_000_000 / 60) * 60
        rows = rows.where(F.col(at).isNotNull())
        measures = [F.count("*").alias("n"), F.hll_sketch_agg(F.col(key).cast("string"), REGISTERS).alias("keys"), F.kll_sketch_agg_double(F.col(value).cast("double"), SIZE).alias("vals")]
        cells = rows.groupBy(*self.by, start.cast("long").alias("start")).agg(*measures)
        for level in reversed(LEVELS):
            at_path = f"{self.path}/level={level}/batch={batch}"
            if level != "minute":
                width = LEVELS[level]
                cells = cells.groupBy(*self.by, (F.floor(F.col("start") / width) * width).cast("long").alias("start")).agg(*self._merged())
            cells.write.mode("overwrite").parquet(at_path)
            cells = self.spark.read.schema(cells.schema).parquet(at_path)

    @staticmethod
    def _merged() -> list[Column]:
        return [F.sum("n").alias("n"), F.hll_union_agg("keys").alias("keys"), F.kll_merge_agg_double("vals").alias("vals")]

    def cells(self, start: datetime, end: datetime) -> DataFrame:
        """The cells that make up a range from start up to, without, end, both whole minutes in UTC: all that a summary reads."""
        a, b = (int(t.replace(tzinfo=timezone.utc).timestamp()) for t in (start, end))
        every = self.spark.read.parquet(self.path)
        wanted = F.lit(False)
        for level, low, high in spans(a, b):
            wanted = wanted | ((F.col("level") == level) & (F.col("start") >= low) & (F.col("start") < high))
        return every.where(wanted)

    def summary(self, start: datetime, end: datetime, quantiles: Sequence[float] = (0.5,)) -> DataFrame:
        """by, n, keys (about how many distinct) and a column q<percent> (about the value there) for each kind with rows in the range."""
        found = self.cells(start, end).groupBy(*self.by).agg(*self._merged())
        at = [F.kll_sketch_get_quantile_double("vals", F.lit(float(q))).alias(f"q{round(100 * q)}") for q in quantiles]
        return found.select(*self.by, "n", F.hll_sketch_estimate("keys").alias("keys"), *at)
