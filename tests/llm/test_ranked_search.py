"""Ranked search against sums over all postings."""

import math
import random
import re
from collections import Counter

import pytest

from siltbed.llm import ranked_search
from tests.llm.test_operators import EDGES, docs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(rows, items, k=10):
    """(item_id, rank, doc_id, score) by the contract; ids are distinct."""
    held = [(i, Counter(terms(t))) for i, t in rows]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = set()
    for item, q in asked.items():
        scores = []
        for i, c, n in held:
            m = 100 - 90 + 90 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in q if t in c)
            if s:
                scores.append((-s, i is None, i))
        out |= {(item, r, x[2], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)}
    return out


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{int(40 ** (r.random() * 1.6))}" for _ in range(2000)]
    texts = [" ".join(r.choices(vocabulary, k=int(10 ** r.uniform(0, 2.3)))) for _ in range(n)]
    same = r.randrange(n)
    texts = [texts[same] if r.random() < 0.2 else t for t in texts]  # a fifth are copies, which tie
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([1, 2, 5, 30])))) for i in range(25)]
    return list(enumerate(texts)), [*items, (25, texts[same]), (26, "absent"), (27, None), (28, "")]


@pytest.mark.parametrize("first,levels,few,most", [(128, 2, 1000, 200_000), (2, 1, 0, 200_000), (2, 1, 5, 10), (4, 3, 0, 0)])
def test_every_way_gives_the_ranking(spark, monkeypatch, first, levels, few, most):
    monkeypatch.setattr(ranked_search, "FIRST", first)
    monkeypatch.setattr(ranked_search, "LEVELS", levels)
    monkeypatch.setattr(ranked_search, "FEW", few)
    monkeypatch.setattr(ranked_search, "STEP", 1000 if first > 2 else 50_000)
    rows, items = corpus(5, 700)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = ranked_search.search(d, spark.createDataFrame(items, "item_id long, text string"), most=most).collect()
    assert set(map(tuple, got)) == ranked(rows, items) and len(got) == len(ranked(rows, items))


def test_edges(spark):
    """Nulls, empty texts, repeated rows and items, clashing columns, ids of strings, case of A-Z alone."""
    items = [("a", "X y"), ("a", "Z"), (None, "ab"), ("b", None), ("c", ""), ("d", "AB ab"), ("e", "É"), ("f", "é")]
    asked = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in items], "item_id string, text string, row int, t int, score int")
    rows = [*EDGES, (6, "é X"), (7, "1x y"), (8, "ab-ab_Ab"), (9, "y z")]
    got = sorted(map(repr, map(tuple, ranked_search.search(docs(spark, rows), asked, k=20).collect())))
    assert got == sorted(map(repr, map(tuple, ranked(rows, items, 20))))
    assert ranked_search.search(docs(spark, []), asked).count() == 0
    assert ranked_search.search(docs(spark, rows), asked.limit(0)).count() == 0
    assert ranked_search.search(docs(spark, EDGES[:2]), asked).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("siltbed_index")]
