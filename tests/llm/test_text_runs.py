"""Lyndon arrays and runs against their definitions."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from siltbed.llm import text_runs
from siltbed.llm.text_runs import op12_text_runs
from tests.llm.test_operators import EDGES, docs

SF = "/root/testdata/sf0.001"


def lyndon(s):
    """A Lyndon word is smaller than all its proper suffixes."""
    return [max(j - i for j in range(i + 1, len(s) + 1) if all(s[i:j] < s[k:j] for k in range(i + 1, j))) for i in range(len(s))]


def runs(w, least):
    """For each period, smallest first, the stretches of words equal to the word a period on."""
    out = set()
    for p in range(1, len(w) // 2 + 1):
        same = [w[i] == w[i + p] for i in range(len(w) - p)] + [False]
        start = 0
        for i, x in enumerate(same):
            if not x:
                a, b = start, i + p
                start = i + 1
                if b - a >= 2 * p and not any(x <= a and b <= y for x, y, q in out if p % q == 0):
                    out.add((a, b, p))
    return sorted((a, b - a, p) for a, b, p in out if b - a >= least)


def in_order(found):
    return sorted(found, key=lambda r: (r[0], r[2]))


def strings():
    r = random.Random(3)
    yield from (list(t) for n in range(1, 9) for t in itertools.product(range(2), repeat=n))
    for _ in range(300):
        k = r.randrange(1, 5)
        yield [r.randrange(k) for _ in range(r.randrange(1, 60))]
    a, b = [0], [0, 1]
    for _ in range(6):
        a, b = b, b + a
    yield b
    yield [bin(i).count("1") % 2 for i in range(64)]


def test_lyndon_array():
    assert all(text_runs.lyndon_lengths(s) == lyndon(s) for s in strings())


@pytest.mark.parametrize("least", [2, 3, 5, 12])
def test_runs(least):
    for s in strings():
        want = runs(s, least)
        assert text_runs.runs_of(s, least) == in_order(want)
        assert text_runs.runs_of_words([b"%d" % x for x in s], least) == in_order(want)


def test_long_periodic_text():
    for p in (1, 7, 1000):
        w = [b"%d" % (i % p) for i in range(60_000)]
        assert text_runs.runs_of_words([b"x", *w, b"y"]) == [(1, 60_000, p)]


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = in_order(runs(w, 12))
    dropped = {i for a, b, p in found for i in range(a + p, a + b)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    more = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *more, sha("".join(f"{a},{b},{p}\n" for a, b, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_the_query(spark, tmp_path):
    """All short texts of the smallest table, and edge cases, under ids that are planted and others."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 6000]
    ids = [i for i in range(3000, 4000) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows += [*EDGES, *zip(ids, (t for _, t in rows), strict=False), (ids[0], ""), (ids[1], None), (ids[2], "x"), (ids[3], "a b c d " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(repr, map(tuple, op12_text_runs(spark, str(tmp_path)).collect())))
    assert got == sorted(repr(expected(*r)) for r in rows)


def test_edges(spark):
    assert text_runs.find_runs(docs(spark, [])).count() == 0
    got = {r.doc_id: (r.n_words, r.collapsed, [tuple(x) for x in r.runs]) for r in text_runs.find_runs(docs(spark, EDGES)).collect()}
    assert got[1] == got[2] == got[3] == (0, "", []) and got[None] == (2, "a b", []) and got[5] == (5000, "ab", [(0, 5000, 1)])
    with pytest.raises(ValueError):
        text_runs.find_runs(docs(spark, []), least=1)
