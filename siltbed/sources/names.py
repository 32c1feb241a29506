"""A large store of names with a Bloom filter, against which uploads are checked.

The filter is a table kept with the store: blocks of 256 bits, in which each name sets one bit in each of eight parts,
all told by one hash. It is built by a grouped bit_or, summed up before the shuffle, and added to by the same.
An upload's names are looked up by their blocks; only those that may be there are joined with the store's names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.session import written

#: Bits of the filter for each name that it is made for; about 0.3 % of other names pass then.
BITS = 16
#: Odd factors that place a name's bit in each part of a block; fixed values of the split-block filter in the Parquet format.
FACTORS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
LANES = ("b0", "b1", "b2", "b3")
#: Up to so many possible names are sent to every worker; more are joined by a shuffle.
MOST = 100_000


def _block(name: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(blocks)).alias("block")


def _masks(name: Column) -> list[Column]:
    """Four longs, of two 32-bit parts each, with the bits of a name."""
    h = F.xxhash64(F.lit(1), name).bitwiseAND(0x7FFFFFFF)
    bit = lambda f: F.shiftrightunsigned((h * f).bitwiseAND(0xFFFFFFFF), 27)
    one = F.lit(1).cast("long")
    mask = lambda i: F.call_function("shiftleft", one, bit(FACTORS[2 * i]).cast("int")).bitwiseOR(F.call_function("shiftleft", one, (bit(FACTORS[2 * i + 1]) + 32).cast("int")))
    return [mask(i).alias(lane) for i, lane in enumerate(LANES)]


class NameStore:
    """Names in a folder, in numbered batches, and a filter made for `expected` names."""

    def __init__(self, spark: SparkSession, path: str, expected: int) -> None:
        self.spark, self.path = spark, path
        self.blocks = max(1, expected * BITS // 256)

    def add(self, names: DataFrame, batch: int) -> None:
        """Stores the distinct names (name) of batch 0, 1, ...; a batch that is written again replaces itself."""
        names.select("name").where("name IS NOT NULL").distinct().write.mode("overwrite").parquet(f"{self.path}/names/batch={batch}")
        new = self.spark.read.parquet(f"{self.path}/names/batch={batch}")
        bits = new.select(_block(F.col("name"), self.blocks), *_masks(F.col("name")))
        if batch:
            bits = bits.unionByName(self._filter(batch - 1))
        merged = bits.groupBy("block").agg(*[F.bit_or(b).alias(b) for b in LANES])
        merged.write.mode("overwrite").parquet(f"{self.path}/filter/{batch}")
        self.last = batch

    def _filter(self, batch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/filter/{batch}")

    def names(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/names").select("name")

    def possible(self, names: DataFrame) -> DataFrame:
        """Of distinct names (name), those that may be in the store: all that are, and few others."""
        asked = names.select("name", _block(F.col("name"), self.blocks), *[m.alias(f"m{i}") for i, m in enumerate(_masks(F.col("name")))])
        hit = [F.col(b).bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}") for i, b in enumerate(LANES)]
        return asked.join(self._filter(self.last), "block").where(hit[0] & hit[1] & hit[2] & hit[3]).select("name")

    def existing(self, names: DataFrame) -> DataFrame:
        """The distinct names (name) that are in the store. Few possible ones are sent to where the store's names are."""
        possible = written(self.possible(names.select("name").where("name IS NOT NULL").distinct()))
        if possible.limit(MOST + 1).count() > MOST:
            return possible.join(self.names(), "name", "left_semi")
        return self.names().join(F.broadcast(possible), "name", "left_semi").distinct()
