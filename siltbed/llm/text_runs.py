"""Operator 12: runs of repeated words by the grouping phase of a suffix sorter.

The first phase of Baier's suffix sorter groups suffixes by their longest Lyndon prefix, which is the Lyndon array
itself. It is run under an order of the words and under its inverse: every run has a Lyndon root, the longest at its
place, under one of the two. Roots are extended to both sides by longest common extensions, and those that reach
twice their length are runs.

Words that cannot be in a run of interest are set aside first, exactly: in a run of at least m words, twice its period
or more, each word lies in some m // 2 consecutive words that the text has twice. The windows that reach back to the
run's start, or forward to its end, are repeated one period on, or back. What is left falls into stretches.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm.common import let, table, words

#: Least words of a run.
LEAST = 12
#: An odd factor of the hash that finds repeated windows; equal hashes of other windows cost time alone.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: About so many bytes of text are read before rows are handed on.
BYTES = 8_000_000
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def lyndon_lengths(ranks: list[int]) -> list[int]:
    """The length of the longest Lyndon word at each place, by groups of suffixes with equal Lyndon prefixes.

    A group is an interval of `order`, named by where it starts. Groups are taken from the highest down. Each member
    is hung on the last place before it whose group is lower; that place's prefix grows by the group's, as often as
    members hang on it, and it moves up to the end of its group, from where equal ones form a new group.
    """
    n = len(ranks)
    order = sorted(range(n), key=ranks.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * (n + 1)
    start = 0
    for k, i in enumerate(order):
        if k and ranks[i] != ranks[order[k - 1]]:
            start = k
        place[i], group[i] = k, start
        size[start] += 1
    length, before = [1] * n, list(range(-1, n - 1))
    end = n
    while end:
        start = group[order[end - 1]]
        members = order[start:end]
        grown = length[members[0]]
        hung: dict[int, int] = {}
        for i in members:
            j = before[i]
            if j >= 0 and group[j] >= start:
                path = [i]
                while j >= 0 and group[j] >= start:  # what lies between j and before[j] is not lower, and never will be
                    path.append(j)
                    j = before[j]
                for k in path:
                    before[k] = j
            if j >= 0:
                hung[j] = hung.get(j, 0) + 1
        for times in sorted(set(hung.values()), reverse=True):
            moved: dict[int, list[int]] = {}
            for j, k in hung.items():
                if k == times:
                    g = group[j]
                    size[g] -= 1
                    at, last = place[j], g + size[g]
                    other = order[last]
                    order[at], order[last], place[other], place[j] = other, j, at, last
                    moved.setdefault(g, []).append(j)
                    length[j] += times * grown
            for g, some in moved.items():
                new = g + size[g]
                size[new] = len(some)
                for j in some:
                    group[j] = new
        end = start
    return length


def _common(text: bytes, i: int, j: int, n: int) -> int:
    """How far the four-byte words of text from i and from j > i on are equal."""
    equal = lambda k, m: text[4 * (i + k) : 4 * (i + k + m)] == text[4 * (j + k) : 4 * (j + k + m)]
    k, m = 0, 1
    while j + k < n and equal(k, m := min(m, n - j - k)):
        k += m
        m *= 2
    most = min(m, n - j - k)  # fewer than that are equal from k on, if any are left
    while most > 1:
        m = most // 2
        if equal(k, m):
            k += m
            most -= m
        else:
            most = m
    return k


def runs_of(ranks: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal repetitions of at least `least` words, by start and period."""
    n, top, found = len(ranks), max(ranks, default=0), set()
    ahead, back = array("I", ranks).tobytes(), array("I", ranks[::-1]).tobytes()
    for side in (ranks, [top - r for r in ranks]):
        seen: dict[int, int] = {}  # where the last run of a period ends
        for i, p in enumerate(lyndon_lengths(side)):
            j = i + p
            if 2 * p > n or j <= seen.get(p, 0):  # a root inside a run of its period is that run's
                continue
            right = _common(ahead, i, j, n)
            left = _common(back, n - j, n - i, n)
            if left + right >= p:
                seen[p] = j + right
                if p + left + right >= least:
                    found.add((i - left, p, p + left + right))
    return [(start, length, p) for start, p, length in sorted(found)]


def stretches(w: list[bytes], least: int) -> list[tuple[int, int]]:
    """Ranges of words that all lie in windows of least // 2 words that w has twice; at least `least` long."""
    n, k = len(w), max(1, least // 2)
    if n < least:
        return []
    h = np.fromiter(map(hash, w), np.int64, n).view(np.uint64)
    windows = h[: n - k + 1].copy()
    for j in range(1, k):
        windows *= FACTOR
        windows += h[j : n - k + 1 + j]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    at = np.searchsorted(twice, windows)
    held = np.flatnonzero(twice[np.minimum(at, len(twice) - 1)] == windows)
    first = np.flatnonzero(np.diff(held, prepend=-k - 1) > k)
    last = np.append(first[1:], len(held)) - 1
    return [(a, b + k) for a, b in zip(held[first].tolist(), held[last].tolist(), strict=True) if b + k - a >= least]


def runs_of_words(w: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    out = []
    for a, b in stretches(w, least):
        ids: dict[bytes, int] = {}
        out += [(a + start, length, p) for start, length, p in runs_of([ids.setdefault(x, len(ids)) for x in w[a:b]], least)]
    return out


def collapsed(w: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one blank, without those that stand in a run behind its first period."""
    if runs:
        edge = np.zeros(len(w) + 1, np.int32)
        for start, length, p in runs:
            edge[start + p] += 1
            edge[start + length] -= 1
        w = [w[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
    return b" ".join(w)


def find_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start and period) and collapsed, a row per input row.

    A run is a stretch of words with a smallest period q, at least `least` (2 or more) words and 2 q long, that no
    neighbouring word extends. collapsed keeps of each run its first period, and what no run holds, joined by blanks.
    Words stand between ASCII blanks; null and empty texts have none, no runs and an empty collapsed text. Repeated
    rows and null ids stay; other columns are dropped; an empty table gives an empty table. No shuffle; memory is that
    of a text's words. Time is linear in repeated parts but for the extensions, which compare bytes.
    """
    if least < 2:
        raise ValueError("least must be 2 or more")
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            begun, total = 0, 0
            sizes = compute.binary_length(texts).fill_null(0).to_pylist()
            for end, size in enumerate(sizes, 1):
                total += size
                if total < BYTES and end < len(sizes):
                    continue
                n, found, rest = [], [], []
                for text in texts[begun:end].to_pylist():
                    w = (text or b"").split()
                    runs = runs_of_words(w, least)
                    n.append(len(w))
                    found.append([{"start": a, "length": b, "period": c} for a, b, c in runs])
                    rest.append(collapsed(w, runs))
                columns = [pa.array(n, pa.int64()), pa.array(found, pa.list_(_RUN)), pa.array(rest, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0)[begun:end], *columns], ["doc_id", "n_words", "runs", "collapsed"])
                begun, total = end, 0

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_words bigint, runs {RUNS}, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The contract's text: a tenth of the documents, told by a checksum of their ids, repeat their words from some place on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))

    def repeating(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10).cast("long")
        a = g % n
        return let(F.struct(n.alias("n"), a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).cast("long").alias("p")), lambda x: F.array_join(
            F.transform(F.sequence(F.lit(0).cast("long"), x["n"] - 1), lambda i: F.get(w, F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]).cast("int"))), " "
        ))

    return F.when(h % 10 == 0, let(words(text), lambda w: F.when(F.size(w) > 0, repeating(w)))).otherwise(text)


def op12_text_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    found = find_runs(d.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.withColumn("b", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"),
        F.expr("(1000 * b.length) div -b.period").alias("exponent_milli"), digest(text).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
