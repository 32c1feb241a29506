"""Substring search on a stored trigram index.

Texts are stored in blocks of a few rows. The index lists, for each three characters of the lower-cased texts, the
blocks that have them, in lists cut by ranges of blocks, sorted by trigram. A search reads the lists of the pattern's
rarest trigrams, intersects them, and compares the texts of what is left. New documents are added as a segment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a block are 2 ** ROWS; a list has the blocks of a range of 2 ** RANGE.
ROWS, RANGE = 5, 12
#: So many of a pattern's trigrams, those in the fewest blocks, are intersected.
RAREST = 3
#: Up to so many blocks are named in the scan, which then skips the rest of the files; more are joined.
NAMED = 1000
#: Bytes of a row group of the stored texts.
GROUP = 1 << 20
#: Characters whose lower case depends on their neighbours, or is two characters.
UNSTEADY = "Σİ"


def _codes(text: str) -> np.ndarray:
    """A number for each three characters of a text."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:] if len(c) > 2 else c[:0]


def _of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, block) from rows (block, low) in the order of blocks; a block on two batches is told twice."""
    for batch in batches:
        block = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            texts = batch.column(1)[a:b].drop_null().to_pylist()
            if texts:
                grams = np.unique(_codes("\0\0".join(texts) + "\0\0"))  # so a short pattern begins one too
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(np.full(len(grams), block[a]))], ["gram", "block"])


class Index:
    """The index at a folder; text_col is the column that is searched."""

    def __init__(self, spark: SparkSession, path: str, text_col: str = "text") -> None:
        self.spark, self.path, self.text_col = spark, path, text_col

    def add(self, docs: DataFrame, segment: int) -> None:
        """Adds documents, all their columns, as a segment. The same number again replaces the segment, so a repeated call adds nothing twice."""
        number = F.monotonically_increasing_id()
        at = f"{self.path}/texts/segment={segment}"
        docs.withColumn("block", F.shiftright(number, ROWS)).write.mode("overwrite").option("parquet.block.size", GROUP).parquet(at)
        kept = self.spark.read.parquet(at).select("block", F.lower(self.text_col).alias("low"))
        found = kept.mapInArrow(_of_blocks, "gram long, block long")
        part = F.shiftright("block", RANGE)
        lists = found.groupBy("gram", part.alias("part")).agg(F.sort_array(F.collect_set(F.col("block").bitwiseAND((1 << RANGE) - 1).cast("int"))).alias("blocks"))
        lists = lists.repartitionByRange("gram", "part").sortWithinPartitions("gram", "part")
        lists.write.mode("overwrite").option("parquet.block.size", GROUP).parquet(f"{self.path}/grams/segment={segment}")

    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/texts")

    def _lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/grams")

    def _lower(self, text: str) -> str:
        return self.spark.range(1).select(F.lower(F.lit(text))).first()[0]

    def _blocks(self, pattern: str, ci: bool) -> DataFrame | None:
        """segment and block of the blocks that may have the pattern; None for all."""
        # where case counts, lower-cased parts of the pattern stand in the lower-cased text, but for unsteady characters
        parts = [self._lower(p) for p in ([pattern] if ci else re.split(f"[{UNSTEADY}]", pattern))]
        grams = sorted({int(g) for p in parts for g in _codes(p)})
        block = lambda b: (F.shiftleft("part", RANGE) + b).alias("block")
        if grams:
            sizes = dict(self._lists().where(F.col("gram").isin(grams)).groupBy("gram").agg(F.sum(F.size("blocks"))).collect())
            if len(sizes) < len(grams):
                return self._lists().where("false").select("segment", F.col("part").alias("block"))
            rare = sorted(grams, key=sizes.__getitem__)[:RAREST]
            lists = self._lists().where(F.col("gram").isin(rare)).groupBy("segment", "part").agg(F.collect_list("blocks").alias("lists")).where(F.size("lists") == len(rare))
            both = F.aggregate(F.slice("lists", 2, len(rare)), F.get("lists", F.lit(0)), F.array_intersect)
            return lists.select("segment", "part", F.explode(both).alias("b")).select("segment", block(F.col("b")))
        part = max(parts, key=len)
        if not part:
            return None
        low = ord(part[0]) << 42 | (ord(part[1]) << 21 if len(part) > 1 else 0)
        high = low + (1 << (42 if len(part) == 1 else 21))
        lists = self._lists().where((F.col("gram") >= low) & (F.col("gram") < high))
        return lists.select("segment", "part", F.explode("blocks").alias("b")).select("segment", block(F.col("b"))).distinct()

    def candidates(self, pattern: str, ci: bool = False) -> DataFrame:
        """The documents of the blocks that may have the pattern: what a search reads and compares."""
        blocks = self._blocks(pattern, ci)
        if blocks is None:
            return self.texts()
        named = blocks.limit(NAMED + 1).collect()
        if len(named) > NAMED:
            return self.texts().join(blocks, ["segment", "block"], "left_semi")
        of: dict[int, list[int]] = {}
        for r in named:
            of.setdefault(r.segment, []).append(r.block)
        here = F.lit(False)
        for segment, some in of.items():
            here = here | ((F.col("segment") == segment) & F.col("block").isin(some))
        return self.texts().where(here)

    def search(self, pattern: str, ci: bool = False) -> DataFrame:
        """The documents whose text has the pattern, taken as it is; with ci, in the lower case of both. An empty one is in every text but null."""
        return self.candidates(pattern, ci).where(_has(F.col(self.text_col), pattern, ci)).drop("segment", "block")


def _has(text: Column, pattern: str, ci: bool) -> Column:
    return F.contains(F.lower(text), F.lower(F.lit(pattern))) if ci else F.contains(text, F.lit(pattern))
