"""Operator 5: cross-entropy difference of a target and a background n-gram model.

Both models have one vocabulary, the 256 bytes of UTF-8, and are smoothed alike: four-byte counts, backed by three-byte
counts, backed by single bytes. The background counts every document, the target those of the target, and the
background's counts are scaled to the target's number of tokens, so that smoothing weighs the same in both. A document
is scored by what all others say: its own counts are taken out of both models first, so a document of the target is
judged like any other. The score is the mean over its tokens of target loss minus background loss; lower is closer.

The models live in tables, never on the driver: their rows grow with the corpus. Documents are dealt into blocks of a
bounded number of characters. A block asks for the n-grams it holds, each once per batch; the requests summed up by
n-gram are the counts, and joined with the models they are the answers, which each block's documents are scored by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm.common import stored, table

#: Tokens of an n-gram.
ORDER = 4
#: The target's ids are broadcast if they have at most so many bytes; else they are joined by a shuffle.
MOST_BYTES = 64 << 20
#: Weight of the shorter context in each order's estimate.
PRIOR = 5.0
#: A block's texts have at most so many characters, as a power of two; a longer text has a block of its own.
BLOCK_BITS = 24
#: Texts of up to 2**SHORT_BITS characters share blocks; longer ones share them with those up to eight times as long.
SHORT_BITS = 13
#: n-grams of texts of about so many bytes are counted at once.
CHUNK = 1 << 21
#: Columns of a model: counts of the four bytes, of their first three as a context, and of their last three.
COUNTS = ("b4", "t4", "b_context", "t_context", "b3", "t3")


def _encoded(texts: pd.Series) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as bytes, in lists of about CHUNK bytes, with the place of the first."""
    at, part, size = 0, [], 0
    for i, text in enumerate(texts):
        part.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(part[-1])
        if size >= CHUNK:
            yield at, part
            at, part, size = i + 1, [], 0
    if part:
        yield at, part


def _own(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner (index), code and count of each distinct n-gram of each text, sorted; a text is led by line ends."""
    lead = b"\n" * (ORDER - 1)
    b = np.frombuffer(b"".join(lead + t for t in texts) + lead, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes + len(lead)) - sizes - len(lead)
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner] + starts[owner]
    key = owner
    for i in range(ORDER):
        key = key << 8 | b[at + i]
    key, n = np.unique(key, return_counts=True)
    return key >> (8 * ORDER), key & ((1 << 8 * ORDER) - 1), n


def _summed(code: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of counts by code, sorted by code."""
    by = np.argsort(code, kind="stable")
    code = code[by]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    return code[first], *(np.add.reduceat(c[by], first) if len(first) else c for c in counts)


def _ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for block, g in batch.groupby("block"):
            chosen = g["is_target"].to_numpy(bool)
            total: tuple[np.ndarray, ...] = (np.zeros(0, np.int64),) * 3
            for at, part in _encoded(g["text"]):
                owner, code, n = _own(part)
                new = _summed(code, n, n * chosen[owner + at])
                total = _summed(*(np.concatenate(x) for x in zip(total, new, strict=True)))
            yield pd.DataFrame({"code": total[0], "block": block, "background": total[1], "target": total[2]})


def model(counts: DataFrame) -> DataFrame:
    """code and COUNTS for every n-gram of counts (code, background, target)."""
    both = lambda name: (F.sum("background").alias(f"b{name}"), F.sum("target").alias(f"t{name}"))
    context = stored(counts.groupBy(F.shiftright("code", 8).alias("before")).agg(*both("_context")))
    low = stored(counts.groupBy(F.col("code").bitwiseAND(0xFFFFFF).alias("abc")).agg(*both("3")))
    high = counts.select("code", F.col("background").alias("b4"), F.col("target").alias("t4"), F.shiftright("code", 8).alias("before"), F.col("code").bitwiseAND(0xFFFFFF).alias("abc"))
    return high.join(context, "before").join(low, "abc").select("code", *COUNTS)


def _low_counts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Background and target counts of two bytes before a token, and of single tokens: 65,536 and 256 rows at most."""
    both = [F.sum("background").alias("b"), F.sum("target").alias("t")]
    pairs, last = np.zeros((2, 1 << 16)), np.zeros((2, 256))
    for r in counts.groupBy(F.shiftright("code", 8).bitwiseAND(0xFFFF).alias("ab")).agg(*both).collect():
        pairs[:, r["ab"]] = r["b"], r["t"]
    for r in counts.groupBy(F.col("code").bitwiseAND(0xFF).alias("c")).agg(*both).collect():
        last[:, r["c"]] = r["b"], r["t"]
    return pairs, last


def _losses(c4: np.ndarray, context: np.ndarray, c3: np.ndarray, c2: np.ndarray, c1: np.ndarray, c0: np.ndarray) -> np.ndarray:
    p1 = (c1 + 1) / (c0 + 256)
    p3 = (c3 + PRIOR * p1) / (c2 + PRIOR)
    return -np.log((c4 + PRIOR * p3) / (context + PRIOR))


def _scorer(pairs: np.ndarray, last: np.ndarray):
    everything = last.sum(axis=1)
    scale = (everything[1] / everything[0] if everything[0] else 0.0, 1.0)

    def runs(key: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The sum of n over each run of key, for every place."""
        new = np.append(True, key[1:] != key[:-1])
        return np.add.reduceat(n, np.flatnonzero(new))[np.cumsum(new) - 1]

    def differences(owner, code, n, chosen, answers) -> np.ndarray:
        own_context = runs(owner << 24 | code >> 8, n)
        key3 = owner << 24 | code & 0xFFFFFF
        by = np.argsort(key3, kind="stable")
        own3, own2 = np.empty_like(n), np.empty_like(n)
        own3[by], own2[by] = runs(key3[by], n[by]), runs(key3[by] >> 8, n[by])
        key1 = owner << 8 | code & 0xFF
        own1 = np.bincount(key1, n)[key1]
        own0 = np.bincount(owner, n)[owner]
        out = 0.0
        for model, sign in ((0, -1), (1, 1)):
            mine = 1.0 if model == 0 else chosen[owner]
            counts = [answers[c] for c in COUNTS[model::2]] + [pairs[model][code >> 8 & 0xFFFF], last[model][code & 0xFF], everything[model]]
            left = [(x - mine * o) * scale[model] for x, o in zip(counts, (n, own_context, own3, own2, own1, own0), strict=True)]
            out = out + sign * _losses(*left)
        return out

    def score(key: tuple, texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        answers = answers.drop_duplicates("code").sort_values("code")
        code = answers["code"].to_numpy()
        sums, sizes = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        flags = texts["is_target"].to_numpy(bool)
        for start, part in _encoded(texts["text"]):
            owner, own, n = _own(part)
            if not len(own):
                continue
            at = np.minimum(np.searchsorted(code, own), len(code) - 1)
            if not len(code) or (code[at] != own).any():
                raise RuntimeError("the documents read differently the second time; pass steady=False")
            found = {c: answers[c].to_numpy()[at] for c in COUNTS}
            d = differences(owner, own, n, flags[start : start + len(part)].astype(float), found)
            sums[start : start + len(part)] = np.bincount(owner, n * d, len(part))
            sizes[start : start + len(part)] = np.bincount(owner, n, len(part))
        mean = pd.Series([s / n if n else None for s, n in zip(sums.tolist(), sizes.tolist(), strict=True)], dtype=object)
        return pd.DataFrame({"doc_id": texts["doc_id"].to_numpy(), "n_tokens": sizes, "score": mean})

    return score


def score(docs: DataFrame, in_target: DataFrame, id_col: str = "doc_id", text_col: str = "text", steady: bool = False, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, n_tokens and score, a row per input row; in_target (doc_id) names the target's documents.

    An id named twice counts once; null ids are never of the target. Repeated documents count as often as they occur,
    and only the row's own counts are taken out for its score, so a copy speaks for it. Null and empty texts have no
    tokens and a null score. Without a target both models are the uniform one that smoothing leaves, and scores are 0.
    Other columns are dropped; an empty table gives an empty table.

    The documents are read twice and must come alike, in the same partitions, as from files. Give steady for such
    documents alone; others are written to the shared folder first.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    flag = in_target.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn("is_target", F.lit(True))
    few = (flag.agg(F.sum(F.octet_length(F.col("doc_id").cast("string")) + 24)).first()[0] or 0) <= most_bytes
    d = d.join(F.broadcast(flag) if few else flag, "doc_id", "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))
    d = (d if steady and few else stored(d)).withColumn("row", F.monotonically_increasing_id())
    # texts of like length form blocks by their places, so a block is bounded in characters, not only in rows
    longer = F.ceil((F.log2(F.coalesce(F.length("text"), F.lit(0)) + 1) - SHORT_BITS) / 3)
    bits = F.least(SHORT_BITS + 3 * F.greatest(longer, F.lit(0)), F.lit(BLOCK_BITS)).cast("int")
    place = F.col("row").bitwiseAND((1 << 33) - 1)
    d = d.withColumn("bits", bits).withColumn("place", place)
    d = d.select("doc_id", "text", "is_target", F.xxhash64(F.shiftright("row", 33), "bits", F.expr(f"shiftright(place, {BLOCK_BITS} - bits)")).alias("block"))

    asked = stored(d.where("text <> ''").select("text", "block", "is_target").mapInPandas(_ask, "code long, block long, background long, target long"))
    counts = stored(asked.groupBy("code").agg(F.sum("background").alias("background"), F.sum("target").alias("target")))
    # a block that asks twice, from two batches, gets the same answer twice
    answers = asked.select("code", "block").join(model(counts), "code").select("block", "code", *COUNTS)
    id_type = d.schema["doc_id"].dataType.simpleString()
    by_block = d.groupBy("block").cogroup(answers.groupBy("block"))
    return by_block.applyInPandas(_scorer(*_low_counts(counts)), f"doc_id {id_type}, n_tokens long, score double")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good: Column = F.col("quality") == 1
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(good), steady=True)
