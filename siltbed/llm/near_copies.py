"""Near copies by the Jaccard similarity of word shingles: SimHash groups first, an exact join for the pairs it loses.

Texts are near copies if their sets of five-word shingles have Jaccard similarity 0.8 or more. Equal fingerprints and
those within operator 8's bits are candidates first, which joins large groups in rows that grow with their members. A
budget of bits can't find all such pairs, so the rest comes from prefix filtering: in any one order of shingles, two
sets that similar share a shingle among the first n - ceil(0.8 n) + 1 of each.

The order is by hash, but shingles that more than HOT sets have come last, so a passage that many texts share makes no
candidates of them, unless little else is in a text. For that a longer run of each set's shingles is stored, and a
shingle comes last only if every set has enough others in its run. Shingles whose holders are in one component already
are dropped before pairs are made. A pair must pass exact bounds: within the join, so that no row is made of others,
the place of the first common shingle and, where more than HOT sets share it, 1024 parity bits, whose differing bits
are no more than the differing shingles; then a bitmap as large as the sets. Only then are the sets read again and
compared.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StructType

from siltbed.llm.common import cut, drop, stored
from siltbed.llm.components import components
from siltbed.llm.simhash import fingerprint_links, fingerprint_of, shingle_hashes

#: Words of a shingle; a shorter text is one shingle.
SIZE = 5
#: A shingle in the runs of more sets is put last in the order, if it can be.
HOT = 16
#: At most so many keys, of some 50 bytes, are broadcast; more are joined by a shuffle.
MOST_KEYS = 200_000
#: Longs of the bitmap that is compared where pairs are made.
FOLD = 16
_FOLDS = [f"f{i}" for i in range(FOLD)]


def _set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, SIZE))


def bitmap(hashes: np.ndarray) -> bytes:
    """Parities of the distinct hashes per bucket; as many buckets, a power of two, as twice the hashes or more."""
    size = max(64, 1 << (2 * len(hashes)).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """A number that two sets differ by at least; the larger bitmap is folded to the size of the smaller."""
    x, y = (np.frombuffer(z, np.uint64) for z in (a, b))
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def folded(hashes: np.ndarray) -> list[int]:
    """Parities of the distinct hashes in FOLD * 64 buckets, as longs."""
    counts = np.bincount((hashes & np.uint64(64 * FOLD - 1)).astype(np.int64), minlength=64 * FOLD)
    return np.packbits(counts & 1, bitorder="little").view(np.int64).tolist()


_READ = StructType().add("fp", LongType()).add("g", LongType()).add("n", IntegerType()).add("run", ArrayType(LongType())).add("bits", BinaryType())
for _f in _FOLDS:
    _READ = _READ.add(_f, LongType())


@F.pandas_udf(_READ)
def _read(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        h = shingle_hashes(t, SIZE)
        s = np.unique(h)
        g = np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)
        run = s[: len(s) - -(-4 * len(s) // 5) + 1 + len(s) // 8 + 8]
        rows.append((fingerprint_of(h), int(g), len(s), run.view(np.int64), bitmap(s), *folded(s)))
    return pd.DataFrame(rows, columns=["fp", "g", "n", "run", "bits", *_FOLDS])


@F.pandas_udf(ArrayType(LongType()))
def _shingles(texts: pd.Series) -> pd.Series:
    return pd.Series([_set(t).view(np.int64) for t in texts])


@F.pandas_udf(BooleanType())
def _may_be_near(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """Whether n + m less what differs leaves enough in common: half of that is to be 4/9 of n + m or more."""
    return pd.Series([9 * (k - differing(x, y)) >= 8 * k for x, y, k in zip(a, b, n + m, strict=True)], dtype=bool)


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (u, v) of sets (g, key, n, bits) with Jaccard similarity 0.8 or more; docs has key and text."""
    side = lambda to, bits, n: sets.select(F.col("g").alias(to), F.col("bits").alias(bits), F.col("n").alias(n))
    pairs = pairs.join(side("u", "a", "n"), "u").join(side("v", "b", "m"), "v").where("5 * least(n, m) >= 4 * greatest(n, m)")
    pairs = stored(pairs.where(_may_be_near("a", "b", "n", "m")).select("u", "v"))
    ids = pairs.select(F.explode(F.array("u", "v")).alias("g")).distinct()
    wanted = cut(sets.select("g", "key").join(ids, "g", "left_semi"))
    few = wanted.count() <= MOST_KEYS
    full = docs.join(F.broadcast(wanted) if few else wanted, "key").dropDuplicates(["g"])
    full = stored(full.select("g", _shingles("text").alias("shingles")))
    both = pairs.join(full.select(F.col("g").alias("u"), F.col("shingles").alias("a")), "u").join(full.select(F.col("g").alias("v"), F.col("shingles").alias("b")), "v")
    return both.where(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("u", "v")


def _in_prefix(sets: DataFrame, hot: int) -> DataFrame:
    """g, t and pos of the shingles in each set's prefix that others have in their runs; pos counts from 0 in the order."""
    every = sets.where("n > 0").select("g", F.posexplode("run").alias("pos", "t"))
    shared = stored(every.groupBy("t").agg(F.count("*").alias("holders")).where("holders > 1").select("t", (F.col("holders") > hot).alias("hot")))
    length = F.col("n") - F.ceil(4 * F.col("n") / 5).cast("int") + 1
    held = stored(every.join(shared, "t"))
    held = held.join(sets.select("g", length.alias("length"), F.size("run").alias("stored")), "g")
    short = held.groupBy("g").agg(F.first("length").alias("length"), F.first("stored").alias("stored"), F.count_if("hot").alias("k")).where("stored - k < length AND k > 0").select("g")
    needed = stored(held.where("hot").join(short, "g", "left_semi").select("t").distinct().withColumn("stays", F.lit(True)))
    held = held.join(needed, "t", "left").withColumn("last", F.col("hot") & F.col("stays").isNull())
    before = F.count_if("last").over(Window.partitionBy("g").orderBy("pos"))
    return held.withColumn("pos", F.col("pos") - before.cast("int")).where("NOT last AND pos < length").select("g", "t", "pos")


def _pairs(held: DataFrame, folds: list[str]) -> DataFrame:
    """(u, v) of sets (g, t, pos, n, root and folds) that share a shingle and may be near; all is tested before a row is made."""
    renamed = {"g": "v", "n": "m", "root": "r", "pos": "at"} | {f: f"o{f}" for f in folds}
    other = held.select("t", *[F.col(c).alias(to) for c, to in renamed.items()])
    both = F.col("n") + F.col("m")
    most = 1 + F.least(F.col("n") - F.col("pos") - 1, F.col("m") - F.col("at") - 1)  # in common, if this is the first
    apart = reduce(lambda a, b: a + b, [F.bit_count(F.col(f).bitwiseXOR(F.col(f"o{f}"))) for f in folds], F.lit(0))
    near = (9 * most >= 4 * both) & (9 * apart <= both)
    return held.withColumnRenamed("g", "u").join(other, "t").where("root < r AND 5 * least(n, m) >= 4 * greatest(n, m)").where(near).select("u", "v")


def first_copies(docs: DataFrame, key_col: str = "key", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """key and first, the least key of the texts that are reached by near copies, a row per distinct key and text.

    A key stands for one text. Texts without words are copies of each other. An empty table gives an empty table.
    """
    docs = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"))
    rows = stored(docs.select("key", _read("text").alias("x")).select("key", "x.*"))
    nodes = stored(rows.groupBy("g").agg(F.min("key").alias("key"), F.min("fp").alias("fp")))
    keys = stored(rows.select("key", "g").distinct())
    sets = stored(rows.join(nodes.select("key"), "key", "left_semi").dropDuplicates(["g"]))
    drop(rows)

    fps = cut(nodes.groupBy("fp").agg(F.min("g").alias("at")))
    near = fps.join(components(fingerprint_links(fps.select("fp"))).withColumnRenamed("id", "fp"), "fp", "left")
    near = cut(near.withColumn("root", F.coalesce("root", "fp")))
    centre = cut(near.groupBy("root").agg(F.min("at").alias("v")))
    guess = nodes.join(near, "fp").join(centre, "root").select(F.col("g").alias("u"), "v").where("u <> v")
    sure = cut(_verified(guess, sets, docs))
    label = sure.select(F.col("u").alias("g"), F.col("v").alias("root"))  # v is its group's least: these are components already

    found = _in_prefix(sets, hot).join(label, "g", "left").withColumn("root", F.coalesce("root", "g"))
    found = stored(found.join(sets.select("g", "n"), "g"))
    holders = [F.bit_xor(F.xxhash64("g")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "g")).alias("y")]
    mixed = found.groupBy("t").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("k"), *holders).where("a <> b")
    # of shingles that the same sets have, only the first in the order can be a pair's first; the order is by unsigned hash
    turned = lambda c: F.col(c).bitwiseXOR(F.lit(-(2**63)))
    mixed = mixed.groupBy("k", "x", "y").agg(F.min(turned("t")).alias("first"))
    mixed = stored(mixed.select(turned("first").alias("t"), (F.col("k") > hot).alias("many")))
    held = stored(found.join(mixed, "t"))
    drop(found, mixed)
    # a shingle that few sets have makes few pairs a set
    few, many = held.where("NOT many").drop("many"), held.where("many").drop("many")
    pairs = _pairs(few, []).unionByName(_pairs(many.join(sets.select("g", *_FOLDS), "g"), _FOLDS))
    rest = _verified(pairs.distinct(), sets, docs)

    root = components(sure.unionByName(rest)).withColumnRenamed("id", "g")
    all_nodes = cut(nodes.join(root, "g", "left").select("g", "key", F.coalesce("root", "g").alias("root")))
    least = cut(all_nodes.groupBy("root").agg(F.min("key").alias("first")))
    out = stored(keys.join(all_nodes.select("g", "root").join(least, "root").select("g", "first"), "g").select("key", "first"))
    drop(nodes, keys, sets, held)
    return out
