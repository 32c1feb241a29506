"""Whole results of the pipeline, stage by stage, against plain Python on a small corpus with planted cases."""

import collections
import random
import re

import pytest

import corpus_pipeline
from siltbed.llm import line_quality

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return [w for w in re.split(f"[{BLANKS}]+", t or "") if w]


def judged(t):
    """The lines that pass, or None for a rejected text."""
    w = words(t)
    runs = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    if len(w) < 10 or 100 * len(repeated) > 20 * len(w):
        return None

    def fails(x):
        bars = len(re.findall(line_quality.SEPARATORS, x))
        return (
            not re.search(line_quality.SENTENCE_END, x, re.ASCII)
            or (bars >= 3 and bars * 4 >= len(words(x)))
            or len(re.findall(line_quality.SYMBOLS, x)) * 10 > len(x)
            or (len(x) <= line_quality.BOILERPLATE_CHARS and any(p in x.lower() for p in line_quality.BOILERPLATE))
        )

    lines = [x for x in (t or "").split("\n") if words(x)]
    lost = sum(len(x) for x in lines if fails(x))
    return "\n".join(x for x in lines if not fails(x)) if 2 * lost <= sum(map(len, lines)) else None


def within_one(a, b):
    if max(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
        return a == b
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    q = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    return p + q >= max(len(a), len(b)) - 1


def without_repeats(rows):
    """Lines that no earlier line equals or is near to; near lines share their first or their last word."""
    seen, ends, out = set(), collections.defaultdict(list), {}
    for i, t in sorted(rows.items()):
        kept = []
        for x in t.split("\n"):
            w = tuple(words(x))
            if not w:
                kept.append((x, False))
                continue
            if w not in seen and not any(within_one(w, v) for e in (("first", w[0]), ("last", w[-1])) for v in ends[e]):
                kept.append((x, True))
            if w not in seen:
                seen.add(w)
                ends["first", w[0]].append(w)
                ends["last", w[-1]].append(w)
        if any(k for _, k in kept):
            out[i] = "\n".join(x for x, _ in kept)
    return out


def first_of_copies(rows):
    sets = {}
    for i, t in rows.items():
        w = words(t.translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in rows:
        for j in rows:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: t for i, t in rows.items() if root[i] == i}


def clean(rows, items):
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    windows = {tuple(w[k : k + 13]) for w in map(split, items) if w for k in range(max(1, len(w) - 12))}
    lengths = {len(w) for w in windows}
    out = {}
    for i, t in rows.items():
        w = split(t)
        hit = {j for n in lengths for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for j in range(k, k + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            out[i] = t
    return out


def targets(size):
    """150% of all sizes by weights 5, 2, 1 of the sources in order, twice a source's size at most."""
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}
    total, target, free = 1.5 * sum(size.values()), {}, set(size)
    while True:
        left = total - sum(target.values())
        shares = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if shares[s] > 2 * size[s]]
        if not over:
            return target | shares
        target |= {s: 2.0 * size[s] for s in over}
        free -= set(over)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest documents and, planted: near copies with whole new lines, exact copies and passages of the benchmark."""
    at, r = str(tmp_path_factory.mktemp("planted")), random.Random(6)
    docs = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [x.text for x in bench.collect()]
    new = lambda k: " ".join(f"{r.choice('bdfgklmnprst')}{r.choice('aeiou')}{r.randrange(500)}" for _ in range(k))
    texts = []
    for _ in range(12):
        # the copy's lines differ in two words each, too many for the line stage
        lines = [new(40).split() for _ in range(3)]
        copy = [list(w) for w in lines]
        for w in copy:
            for j in r.sample(range(1, 6), 2):
                w[j] = new(1)
        texts += ["\n".join(" ".join(w) + "." for w in x) for x in (lines, copy)]
    texts += [texts[0], "", None, texts[3].upper(), *(f"{x}.\n{new(20)}." for x in items[:10]), *(new(30 * k) + f". {items[10]} then {new(30 * k)}." for k in (1, 40))]
    docs += [(10_000_000 + i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{at}/documents.parquet")
    bench.write.parquet(f"{at}/benchmark.parquet")
    return at, docs, items


def test_pipeline(spark, folder):
    at, docs, items = folder
    assert len({d[0] for d in docs}) == len(docs)
    rows = {i: t for i, t, *_ in docs}
    want = [{i: c for i, t in rows.items() if (c := judged(t)) is not None}]
    want.append(without_repeats(want[-1]))
    want.append(first_of_copies(want[-1]))
    want.append(clean(want[-1], items))
    left = [len(rows), *map(len, want)]
    assert all(a > b for a, b in zip(left, left[1:])), left  # every stage has something to drop

    d = spark.read.parquet(f"{at}/documents.parquet")
    for k, ((name, stage), rest) in enumerate(zip(corpus_pipeline.STAGES, want)):
        out = stage(spark, d, at)
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        out.write.parquet(f"{at}/after{k}")
        d = spark.read.parquet(f"{at}/after{k}")
        got = d.collect()
        assert len(got) == len({x.doc_id for x in got}) and {x.doc_id: x.text for x in got} == rest, name
        assert all(x.n_chars == len(x.text) for x in got)

    mix = corpus_pipeline.STAGES[-1][1](spark, d, at).collect()
    known = {x.doc_id: x for x in got}
    size, taken = collections.Counter(), collections.Counter()
    for x in got:
        size[x.source] += len(words(x.text))
    for x in mix:
        assert (x.text, x.source, x.lang) == (known[x.doc_id].text, known[x.doc_id].source, known[x.doc_id].lang)
        taken[x.source] += len(words(x.text))
    assert len({(x.doc_id, x["pass"]) for x in mix}) == len(mix) and max(collections.Counter(x.doc_id for x in mix).values()) <= 2
    longest = max(len(words(x.text)) for x in got)
    assert all(abs(taken[s] - t) <= longest for s, t in targets(size).items())
    for shard in {x.shard for x in mix}:
        places = sorted(x.place for x in mix if x.shard == shard)
        assert len(set(places)) == len(places)
    whole = corpus_pipeline.run(spark, at).collect()
    assert sorted(map(tuple, whole), key=repr) == sorted(map(tuple, mix), key=repr)
