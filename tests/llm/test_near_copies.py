"""Near copies against brute-force Jaccard, with passages that many texts share."""

import random

import numpy as np
import pytest

from siltbed.llm import components, near_copies


def sets_of(texts):
    return [set(near_copies._set(t).tolist()) for t in texts]


def test_bitmaps():
    r = np.random.default_rng(1)
    for n, m, common in ((10, 12, 9), (500, 600, 480), (500, 600, 0), (3000, 2000, 1500), (0, 5, 0)):
        x = r.integers(0, 1 << 63, n + m - common).astype(np.uint64)
        a, b = x[:n], x[n - common :]
        assert near_copies.differing(near_copies.bitmap(a), near_copies.bitmap(b)) <= n + m - 2 * common
    x = r.integers(0, 1 << 63, 2000).astype(np.uint64)
    assert near_copies.differing(near_copies.bitmap(x[:900]), near_copies.bitmap(x[900:])) > 800


@pytest.mark.parametrize("hot", [16, 2, 1000])
def test_first_copies(spark, hot):
    """Texts that are mostly, partly or not made of common passages, and copies of them with words replaced."""
    r = random.Random(3)
    word = lambda: f"w{r.randrange(2000)}"
    passages = [" ".join(word() for _ in range(60)) for _ in range(4)]
    texts = []
    for i in range(120):
        parts = [r.choice(passages) for _ in range(r.randrange(0, 4))] + [" ".join(word() for _ in range(r.choice([0, 3, 20, 100])))]
        r.shuffle(parts)
        texts.append(" ".join(parts))
    for t in texts[:60]:
        w = t.split() or ["x"]
        for _ in range(r.randrange(1, 5)):
            w[r.randrange(len(w))] = "new"
        texts.append(" ".join(w))
    rows = list(enumerate([*texts, "", None]))
    s = sets_of([t for _, t in rows])
    root = list(range(len(rows)))
    for _ in range(12):
        root = [min(root[j] for j, b in enumerate(s) if len(a & b) >= 0.8 * len(a | b)) for a in s]
    d = spark.createDataFrame(rows, "key long, text string").repartition(5)
    got = {x.key: x.first for x in near_copies.first_copies(d, hot=hot).collect()}
    assert got == dict(enumerate(root))


def test_template_texts_make_few_pairs(spark, monkeypatch):
    """Texts of 7 out of 14 shared paragraphs, some of them copied with a word changed: the pairs made grow like the texts, not their square."""
    r = random.Random(7)
    paragraphs = [[f"w{p}x{i}" for i in range(30)] for p in range(14)]
    made = {}
    for m in (150, 600):
        texts = [sum((paragraphs[p] for p in sorted(r.sample(range(14), 7))), [f"own{i}"]) for i in range(m)]
        for i in range(0, m, 20):
            texts[i] = [*texts[i + 1][:100], "changed", *texts[i + 1][101:]]
        rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
        counted, whole = [], near_copies._verified
        monkeypatch.setattr(near_copies, "_verified", lambda pairs, *rest, of=whole, n=counted: n.append(pairs.count()) or of(pairs, *rest))
        got = {x.key: x.first for x in near_copies.first_copies(spark.createDataFrame(rows, "key long, text string").repartition(4)).collect()}
        monkeypatch.setattr(near_copies, "_verified", whole)
        sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
        root = list(range(m))

        def at(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for i in range(m):
            for j in range(i):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    a, b = sorted((at(i), at(j)))
                    root[b] = a
        assert got == {i: at(i) for i in range(m)}
        made[m] = sum(counted)
    assert made[600] < 0.05 * 600 * 600 and made[600] < 8 * made[150] + 500, made


def test_components_of_links_to_roots_take_no_round(spark, monkeypatch):
    """Rounds leave plans and threads in the driver, so there is none where each id is linked to its root, and no closing one."""
    rounds, star = [], components._star
    monkeypatch.setattr(components, "_star", lambda links, large: rounds.append(large) or star(links, large))
    of = lambda links: {x.id: x.root for x in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert of([(5, 1), (1, 7), (7, 1), (-3, 4), (4, None), (6, 6)]) == {5: 1, 7: 1, 4: -3} and not rounds
    assert of([]) == {} and not rounds
    assert of([(2, 1), (2, 3)]) == {2: 1, 3: 1} and len(rounds) == 2
    r = random.Random(5)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    root = {x: x for pair in links for x in pair}
    for _ in range(400):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert of(links) == {k: v for k, v in root.items() if k != v}


def test_a_passage_is_joined_by_its_first_shingle(spark, monkeypatch):
    """Texts of one passage and few own words: shingles with equal holders make the same pairs, so one of them is joined."""
    passage = [f"p{i}" for i in range(300)]
    texts = [" ".join([*passage, *(f"own{i}x{j}" for j in range(70 + i % 3))]) for i in range(20)]
    joined, whole = [], near_copies._pairs
    monkeypatch.setattr(near_copies, "_pairs", lambda held, folds: joined.append(held.select("t").distinct().count()) or whole(held, folds))
    d = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    s = sets_of(texts)
    near = {(i, j) for i in range(20) for j in range(i) if len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])}
    got = {x.key: x.first for x in near_copies.first_copies(d).collect()}
    assert not near and got == {i: i for i in range(20)}
    monkeypatch.setattr(near_copies, "_pairs", whole)
    prefixes = [set(sorted(x)[: len(x) - -(-4 * len(x) // 5) + 1]) for x in s]
    shared = {t for t in set.union(*prefixes) if sum(t in x for x in prefixes) > 1}
    assert len({frozenset(i for i, x in enumerate(prefixes) if t in x) for t in shared}) >= sum(joined) < len(shared), (joined, len(shared))
