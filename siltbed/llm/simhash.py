"""Operator 8: SimHash near-dedup by a binary trie self-join.

Two fingerprints within 4 bits agree on one of five blocks of bits. For each block, fingerprints that agree on it form
a bucket; a bucket of more than BUCKET is dealt again by five blocks of its other bits, and so on, so rows grow by a
factor of five per level and not with pairs. In a bucket fingerprints are the leaves of a binary trie (a sorted array,
whose nodes are ranges), and pairs of nodes go down together, adding up differing bits, until the budget is exceeded,
few leaves are left, or all leaves of both are known to be linked. Of each bucket only a spanning forest of its links
comes back, so a group of near copies costs as many rows as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from siltbed.llm.common import cut, table
from siltbed.llm.components import components

SEED = 42
BITS = 4
#: A bucket of more fingerprints is dealt again, if fewer than LEVELS blocks of bits are fixed in it.
BUCKET, LEVELS = 2048, 4
#: Pairs of nodes with at most so many pairs of leaves are compared at once.
LEAVES = 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, size: int = 4) -> np.ndarray:
    """A uint64 hash of each run of size words, or of all words of a shorter text; no words give none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes.split() knows ASCII blanks alone
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(words))
    bounds = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in bounds), np.uint64, len(words) - k + 1)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The signed 64-bit fingerprint of shingle hashes; none give 0."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: str | None, size: int = 4) -> int:
    """The signed 64-bit fingerprint of one text; no words give 0."""
    return fingerprint_of(shingle_hashes(text, size))


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each linked one of n to the least one it reaches."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            at = np.flatnonzero(label != np.arange(n))
            return at, label[at]
        label = new


def trie_links(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, label: np.ndarray, budget: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions in v (uint64) within budget bits, of the same range [lo, hi), in each of which v is sorted.

    Of positions with one label, which are linked already, not all pairs are found.
    """
    parts = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))  # ranges of one label have one number
    a0, a1, b0, b1 = lo, hi, lo, hi
    e, own = np.zeros(len(lo), np.int8), np.ones(len(lo), bool)
    found_a, found_b = [], []
    for depth in range(65):
        few = ((a1 - a0) * (b1 - b0) <= LEAVES) | (depth == 64)
        if few.any():
            pairs = ((a1 - a0) * (b1 - b0))[few]
            job = np.repeat(np.flatnonzero(few), pairs)
            k = np.arange(len(job)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            nb = (b1 - b0)[job]
            x, y = a0[job] + k // nb, b0[job] + k % nb
            near = (np.bitwise_count(v[x] ^ v[y]) <= budget) & ((x < y) | ~own[job])
            found_a.append(x[near])
            found_b.append(y[near])
        a0, a1, b0, b1, e, own = (z[~few] for z in (a0, a1, b0, b1, e, own))
        if not len(a0):
            break
        ones = np.concatenate(([0], np.cumsum((v >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)))
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        cross = ~own
        sides = [
            (a0, am, b0, bm, e, own),
            (am, a1, bm, b1, e, own),
            (a0, am, bm, b1, e + 1, np.zeros_like(own)),
            tuple(z[cross] for z in (am, a1, b0, bm, e + 1, own)),
        ]
        a0, a1, b0, b1, e, own = (np.concatenate(z) for z in zip(*sides, strict=True))
        go = (a1 > a0) & (b1 > b0) & (e <= budget)
        a0, a1, b0, b1, e, own = (z[go] for z in (a0, a1, b0, b1, e, own))
        linked = (parts[a0] == parts[a1 - 1]) & (parts[b0] == parts[b1 - 1]) & (label[a0] == label[b0])
        a0, a1, b0, b1, e, own = (z[~linked] for z in (a0, a1, b0, b1, e, own))
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _bucket_links(g: pd.DataFrame, budget: int) -> pd.DataFrame:
    """A spanning forest of the links in each bucket of g; near leaves are linked first, so that dense parts are pruned."""
    keys = g[["path", "value"]].to_numpy()
    start = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
    end = np.append(start[1:], len(g))
    some = end - start > 1
    v, label = g["turned"].to_numpy().view(np.uint64), np.arange(len(g))
    for most in sorted({min(1, budget), min(2, budget), budget}):
        a, b = trie_links(v, start[some], end[some], label, most)
        at, to = _forest(np.concatenate((a, np.arange(len(g)))), np.concatenate((b, label)), len(g))
        label = np.arange(len(g))
        label[at] = to
    fp = g["fp"].to_numpy()
    return pd.DataFrame({"u": fp[at], "v": fp[to]})


def _join_buckets(budget: int, bucket: int):
    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by bucket (path, value) and turned fingerprint."""
        rest: list[pd.DataFrame] = []
        for batch in batches:
            rest.append(batch)
            if sum(map(len, rest)) < 4 * bucket:
                continue
            g = pd.concat(rest, ignore_index=True)
            keys = g[["path", "value"]].to_numpy()
            last = np.flatnonzero((keys != keys[-1]).any(axis=1))
            at = last[-1] + 1 if len(last) else 0
            rest = [g.iloc[at:]]
            if at:
                yield _bucket_links(g.iloc[:at], budget)
        if rest and sum(map(len, rest)):
            yield _bucket_links(pd.concat(rest, ignore_index=True), budget)

    return links


def _dealt(rows: DataFrame, fixed: int, budget: int) -> DataFrame:
    """rows (fp, path, turned), of which the first `fixed` bits of turned are a bucket's, by budget + 1 blocks of the others."""
    rest, blocks = 64 - fixed, budget + 1
    sizes = [rest // blocks + (i < rest % blocks) for i in range(blocks)]
    mask = (1 << rest) - 1
    low, out, shift = F.col("turned").bitwiseAND(F.lit(mask if mask < 1 << 63 else -1)), [], 0
    for i, w in enumerate(sizes):
        turned = low if not shift else F.shiftleft(low, shift).bitwiseOR(F.shiftrightunsigned(low, rest - shift))
        if fixed:
            turned = turned.bitwiseAND(F.lit(mask)).bitwiseOR(F.col("turned").bitwiseAND(F.lit(~mask)))
        # widths differ by one, and a bucket's key has as many bits as its path says
        out.append(F.struct((F.col("path") * blocks + i + 1).alias("path"), F.shiftrightunsigned(turned, rest - w).alias("value"), turned.alias("turned"), F.lit(fixed + w).alias("fixed")))
        shift += w
    return rows.select("fp", F.explode(F.array(*out)).alias("x")).select("fp", "x.*")


def buckets(fps: DataFrame, budget: int = BITS, bucket: int = BUCKET, levels: int = LEVELS) -> DataFrame:
    """fp, path, value and turned: every two of the distinct fingerprints fps (fp) within budget bits share a (path, value).

    turned is fp with its bits in the path's order. Buckets of one are left out.
    """
    small, large = None, {0: fps.select("fp", F.lit(0).cast("long").alias("path"), F.col("fp").alias("turned"))}
    for level in range(levels):
        dealt = None
        for fixed, rows in large.items():
            part = _dealt(rows, fixed, budget)
            dealt = part if dealt is None else dealt.unionByName(part)
        dealt = cut(dealt)
        counts = dealt.groupBy("path", "value").count().where("count > 1")
        dealt = dealt.join(counts, ["path", "value"])
        last = level + 1 == levels
        done = (dealt if last else dealt.where(F.col("count") <= bucket)).select("fp", "path", "value", "turned")
        small = done if small is None else small.unionByName(done)
        if last:
            break
        more = cut(dealt.where(F.col("count") > bucket).select("fp", "path", "turned", "fixed"))
        large = {r["fixed"]: more.where(F.col("fixed") == r["fixed"]).drop("fixed") for r in more.select("fixed").distinct().collect()}
        if not large:
            break
    return small


def fingerprint_links(fps: DataFrame, budget: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) that join, directly or by others, every two of the distinct fingerprints fps (fp) within budget bits."""
    b = buckets(fps, budget, bucket)
    # the top bit is flipped for sorting, so that signed order is unsigned order
    b = b.repartition("path", "value").sortWithinPartitions("path", "value", F.col("turned").bitwiseXOR(F.lit(-(2**63))))
    return b.mapInPandas(_join_buckets(budget, bucket), "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reached), a row per input row.

    Null and empty texts have fingerprint zero and link like any other. Rows that share an id are rows of one document
    for component_id; a null id is never the smallest, and a component of null ids alone has a null component_id.
    Other columns are dropped. An empty table gives an empty table.
    """
    d = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col)).alias("fp")))
    fps = cut(d.groupBy("fp").agg(F.min("doc_id").alias("first")))
    root = components(fingerprint_links(fps.select("fp"))).withColumnRenamed("id", "fp")
    fps = fps.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = cut(fps.groupBy("root").agg(F.min("first").alias("component_id")))  # so that the join's hot roots can be split
    fps = fps.join(least, "root").select("fp", "component_id")
    return d.join(fps, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
