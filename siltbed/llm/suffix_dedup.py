"""Operator 4: repeated byte strings by two-stage suffix sorting.

Equal strings of LENGTH bytes have the same least K-gram (by a content hash) at the same place, their anchor. Each text is
cut into segments, the runs of string starts with one anchor, so equal strings meet under their anchor's hash, and
an anchor that occurs once in the corpus is done with. In a run with a period each period begins a segment like the one
before, and they are one row with a number of times. Equal segments are summed up; what is left is dealt out by
anchor and sorted per batch of anchors: suffixes smaller than their successors are sorted directly, the others are
induced from them bucket by bucket, and neighbours with a common prefix of LENGTH are repeats. A segment that occurs
more than once is entered twice.

An anchor with more than HOT different segments is not gathered in one task. Its strings are split in two by how far
in front the anchor lies in them; all strings of a half share more bytes around the anchor, and are dealt by these as
well. Halves that are still too large are split again, down to one string each, so every group that is sorted is small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm.common import stored, table

LENGTH, K = 400, 50
#: A group of more different segments is split by the bytes around its anchor.
HOT = 1024
#: Bytes that a batch of texts, and a batch of segments to be sorted, have at least, if there are so many.
TEXTS, SORTED = 2_000_000, 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_END = 0xFF  # in no UTF-8 text
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def _gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k bytes of b."""
    up, down = _power(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: len(b) - k + 1]
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def segments(texts: list[bytes], length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """Of each segment text (its index), key (the anchor's hash), lo (first start, in the text), n (starts), place (in the texts laid end to end) and pos (the anchor's, from there)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    b = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if not (sizes >= length).any():
        return none, none, none, none, none, none
    h = _gram_hashes(b, k)
    low = np.uint64((1 << 31) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, w = length - k + 1, 1
    while 2 * w <= width:
        least = np.minimum(least[:-w], least[w:])
        w *= 2
    if w < width:
        least = np.minimum(least[: len(least) - (width - w)], least[width - w :])
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    at = np.flatnonzero(ends[owner] - np.arange(len(least)) >= length)
    anchor, own = (least[at] & low).astype(np.int64), owner[at]
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1]))))
    n = np.diff(np.append(first, len(at)))
    place, own = at[first], own[first]
    return own, h[anchor[first]].view(np.int64), place - (ends - sizes)[own], n, place, anchor[first] - place


def _grouped(batches: Iterator[pd.DataFrame], size, least: int) -> Iterator[pd.DataFrame]:
    """Batches cut so that each but the last has about `least` by the row size."""
    for batch in batches:
        part = np.cumsum(size(batch)) // least
        for p in np.unique(part):
            yield batch[part == p]


def _find_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for g in _grouped(batches, lambda x: x["text"].str.len().fillna(0).to_numpy(), TEXTS):
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in g["text"]]
        own, key, lo, n, place, pos = segments(texts)
        data = b"".join(texts)
        new = ~_like_the_last(data, own, key, n, place, pos)
        times = np.diff(np.append(np.flatnonzero(new), len(own)))
        own, key, lo, n, place, pos = (x[new] for x in (own, key, lo, n, place, pos))
        view = memoryview(data)
        digests = (xxhash.xxh3_64_intdigest(view[p : p + m + LENGTH - 1]) for p, m in zip(place.tolist(), n.tolist(), strict=True))
        seg = np.fromiter(digests, np.uint64, len(own)).view(np.int64)
        kinds = {"lo": lo, "n": n, "pos": pos, "times": times}
        yield pd.DataFrame({"doc_id": g["doc_id"].to_numpy()[own], "h": g["h"].to_numpy()[own], "key": key, "seg": seg} | {c: x.astype(np.int32) for c, x in kinds.items()})


def _like_the_last(data: bytes, own: np.ndarray, key: np.ndarray, n: np.ndarray, place: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which segments have the bytes of the one before, as in a run with a period: the text is equal n bytes on, all along."""
    like = np.zeros(len(own), bool)
    like[1:] = (own[1:] == own[:-1]) & (key[1:] == key[:-1]) & (n[1:] == n[:-1]) & (pos[1:] == pos[:-1])
    b = np.frombuffer(data, np.uint8)
    for step in np.unique(n[like]).tolist():
        rows = np.flatnonzero(like & (n == step))
        first = int(place[rows[0]]) - step
        end = int(place[rows[-1]]) + step + LENGTH - 1
        differ = np.zeros(end - step - first + 1, np.int32)
        np.cumsum(b[first : end - step] != b[first + step : end], out=differ[1:])
        at = place[rows] - step - first
        like[rows] = differ[at + step + LENGTH - 1] == differ[at]
    return like


def suffix_order(data: bytes, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The wanted positions of data (default: all), ordered by the first depth bytes from there, by two-stage sorting.

    Besides the wanted ones, those are sorted that they are induced from: what follows them up to the next suffix that
    is smaller than its successor.
    """
    t = np.frombuffer(data, np.uint8)
    n = len(t)
    wanted = np.ones(n, bool) if wanted is None else wanted
    step = np.zeros(n, np.int8)  # 1: smaller than its successor, -1: greater
    step[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1])
    step[-1] = -1
    known = np.flatnonzero(step)
    small = step[known[np.searchsorted(known, np.arange(n))]] > 0  # equal bytes: as the next that differ
    smalls = np.append(np.flatnonzero(small), n)
    next_small = smalls[np.searchsorted(smalls, np.flatnonzero(wanted))]
    direct = np.unique(next_small[next_small < n])
    direct = np.array(sorted(direct.tolist(), key=lambda i: data[i : i + depth]), np.int64)
    cuts = np.searchsorted(t[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[-1]].append(np.array([n - 1]))
    order = []
    for c in range(256):
        level = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        bucket = []
        while len(level):
            bucket.append(level)
            before = level[level > 0] - 1
            level = before[~small[before] & (t[before] == c)]
        bucket.append(direct[cuts[c] : cuts[c + 1]])
        done = np.concatenate(bucket)
        order.append(done)
        before = done[done > 0] - 1
        before = before[~small[before] & (t[before] > c)]
        if len(before):
            firsts = t[before]
            by = np.argsort(firsts, kind="stable")
            values, at = np.unique(firsts[by], return_index=True)
            for v, part in zip(values, np.split(before[by], at[1:]), strict=True):
                waiting[v].append(part)
    order = np.concatenate(order)
    return order[wanted[order]]


def repeated_starts(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part, which of its starts begin a string of `length` bytes that another start, of any part, begins too."""
    data = bytes([_END]).join(parts) + bytes([_END])
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    begin = np.cumsum(sizes + 1) - sizes - 1
    is_start = np.zeros(len(data), bool)
    for b, s in zip(begin, sizes, strict=True):
        is_start[b : b + s - length + 1] = True
    order = suffix_order(data, length, is_start)
    a, b = order[:-1], order[1:]
    t = np.frombuffer(data + bytes(8), np.uint8)
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(t, 8)).view(np.uint64)[:, 0]
    for at in (*range(0, length - 8, 8), length - 8):  # the common prefix, eight bytes at a time, while it lasts
        same = words[a + at] == words[b + at]
        a, b = a[same], b[same]
    found = np.zeros(len(data), bool)
    found[a] = found[b] = True
    return [found[b : b + max(s - length + 1, 0)] for b, s in zip(begin, sizes, strict=True)]


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last place of each run of set flags."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()


def _sort_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Different parts come sorted by group."""

    def found(g: pd.DataFrame) -> pd.DataFrame:
        parts = [p for p, m in zip(g["part"], g["m"], strict=True) for _ in range(min(m, 2))]
        flags = repeated_starts(parts, LENGTH)
        first = np.cumsum(np.minimum(g["m"], 2)) - np.minimum(g["m"], 2)
        runs = [_runs(flags[i]) for i in first]
        return pd.DataFrame({"group": g["group"], "own": g["own"], "a": [r[0] for r in runs], "b": [r[1] for r in runs]})

    rest: list[pd.DataFrame] = []
    size = 0
    for batch in _grouped(batches, lambda x: x["part"].str.len().to_numpy(), SORTED):
        rest.append(batch)
        size += batch["part"].str.len().sum()
        if size < SORTED:
            continue
        g = pd.concat(rest, ignore_index=True)
        other = np.flatnonzero(g["group"].to_numpy() != g["group"].iloc[-1])
        at = other[-1] + 1 if len(other) else 0
        rest = [g.iloc[at:]]
        size = g["part"].iloc[at:].str.len().sum()
        if at:
            yield found(g.iloc[:at])
    if rest and sum(map(len, rest)):
        yield found(pd.concat(rest, ignore_index=True))


#: A part of a segment: that segment's key and seg, the first start in it, the group it is dealt to, its own hash, its
#: bytes, the anchor's place in them, and least and most bytes before the anchor in the group's strings.
PART = "key long, seg long, base int, m long, group long, own long, part binary, pos int, least int, most int"


def _halves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parts split by the bytes before the anchor; a half goes to the group of those with the same bytes around it."""
    for g in _grouped(batches, lambda x: x["part"].str.len().to_numpy(), TEXTS):
        rows = []
        for r in g.itertuples(index=False):
            middle = (r.least + r.most) // 2
            n = len(r.part) - LENGTH + 1
            for least, most in ((r.least, middle), (middle + 1, r.most)):
                first, last = max(r.pos - most, 0), min(r.pos - least, n - 1)
                if first > last:
                    continue
                part, shared = r.part[first : last + LENGTH], r.part[r.pos - least : r.pos - most + LENGTH]
                group = xxhash.xxh3_64_intdigest(b"%d %d %d " % (r.group, least, most) + shared)
                rows.append((r.key, r.seg, r.base + first, r.m, group, xxhash.xxh3_64_intdigest(part), part, r.pos - first, least, most))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in PART.split(", ")])
        for c in ("group", "own"):
            out[c] = out[c].astype(np.uint64).to_numpy().view(np.int64)
        yield out


def _split_hot(parts: DataFrame, hot: int) -> DataFrame:
    """parts with hot groups split until none has over hot different parts; one string each at the last."""
    done = None
    for _ in range((LENGTH - K + 1).bit_length() + 1):
        variants = parts.groupBy("group", "own").agg(F.first("least").alias("least"), F.first("most").alias("most"))
        large = variants.where("least < most").groupBy("group").count().where(F.col("count") > hot).select("group")
        large = stored(large)
        if large.isEmpty():
            break
        small = parts.join(large, "group", "left_anti")
        done = small if done is None else done.unionByName(small)
        parts = stored(parts.join(large, "group", "left_semi").mapInPandas(_halves, PART))
    return parts if done is None else done.unionByName(parts)


def _cut_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text, found in zip(batch["text"], batch["found"], strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            gone = np.zeros(len(data) + 1, np.int32)
            for x in () if found is None else found:
                # the next of equal segments begins before the last one's strings end
                a, b = np.asarray(x["a"], np.int64) + x["lo"], np.asarray(x["b"], np.int64) + x["lo"] + x["n"] * (x["times"] - 1) + LENGTH
                np.add.at(gone, a, 1)
                np.add.at(gone, b, -1)
            flags = np.cumsum(gone)[: len(data)] > 0
            starts, lasts = _runs(flags)
            kept = np.frombuffer(data, np.uint8)[~flags].tobytes()
            rows.append((len(data), int(flags.sum()), starts, [x + 1 for x in lasts], kept))
        out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "starts", "ends", "kept"])
        out.insert(0, "doc_id", batch["doc_id"].to_numpy())
        yield out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, starts and ends (of the maximal removed runs, in bytes) and kept (the remaining bytes).

    A row per input row; null and empty texts have no bytes. Rows with the same id and text repeat each other like any
    two. Null ids stay; other columns are dropped; an empty table gives an empty table. A text of any length is read
    whole.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    doc = F.struct("doc_id", "h").alias("doc")
    at = stored(d.mapInPandas(_find_segments, f"doc_id {kind}, h long, key long, seg long, lo int, n int, pos int, times int").select(doc, "key", "seg", "lo", "n", "pos", "times"))
    keys = stored(at.groupBy("key").agg(F.sum("times").alias("total")).where("total > 1").select("key"))  # so that the join's hot keys can be split
    at = stored(at.join(keys, "key", "left_semi"))

    segs = at.groupBy("key", "seg").agg(F.sum("times").alias("m"), F.min(F.struct("doc", "lo", "n", "pos")).alias("x"))
    segs = segs.groupBy("x.doc").agg(F.collect_list(F.struct("key", "seg", "m", "x.lo", "x.n", "x.pos")).alias("segs"))
    whole = d.select(doc, F.col("text").cast("binary").alias("data"))
    part = lambda s: F.struct(*[s[c].alias(c) for c in ("key", "seg", "m", "pos")], F.substring("data", s["lo"] + 1, s["n"] + (LENGTH - 1)).alias("part"))
    parts = stored(whole.join(segs, "doc").select(F.explode(F.transform("segs", part)).alias("s")).select("s.*"))  # repeated rows give a part once each
    parts = parts.select("key", "seg", F.lit(0).alias("base"), "m", F.col("key").alias("group"), F.col("seg").alias("own"), "part", "pos", F.lit(0).alias("least"), F.lit(LENGTH - K).alias("most"))
    parts = _split_hot(parts, hot)
    origin = F.struct("key", "seg", "base")
    many = (F.max("m") > 1) | (F.min(origin) != F.max(origin))
    each = parts.groupBy("group", "own").agg(F.when(many, 2).otherwise(1).alias("m"), F.first("part").alias("part"))
    found = each.repartition("group").sortWithinPartitions("group").mapInPandas(_sort_segments, "group long, own long, a array<int>, b array<int>").where(F.size("a") > 0)
    shifted = lambda c: F.transform(c, lambda i: i + F.col("base")).alias(c)
    found = parts.select("key", "seg", "base", "group", "own").distinct().join(stored(found), ["group", "own"]).select("key", "seg", shifted("a"), shifted("b"))

    hits = at.join(found, ["key", "seg"]).groupBy("doc").agg(F.collect_set(F.struct("lo", "n", "times", "a", "b")).alias("found"))
    out = d.select(doc, "text").join(hits, "doc", "left").select(F.col("doc.doc_id").alias("doc_id"), "text", "found")
    return out.mapInPandas(_cut_texts, f"doc_id {kind}, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept binary")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
