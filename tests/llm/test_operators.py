"""Small tables with nulls, empty texts, ties, repeated rows and clashing names, against plain Python."""

import collections
import hashlib
import random
import time

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from siltbed.llm import decontaminate, line_dedup, line_quality, lm_score, mixing, simhash, suffix_dedup, token_counts, url_rules, warc
from siltbed.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words long, key string, h long, size long, w string"
CLASH = ("en", "s", 1, "kept", 5, "k", 7, 8, "w")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *CLASH) for i, t in rows], SCHEMA).repartition(3)


def prose(n, seed):
    r = random.Random(seed)
    return [" ".join(r.choice("the of and a tion ing stone river under Été cold long".split()) + str(r.randrange(40)) for _ in range(r.randrange(5, 120))) + "." for _ in range(n)]


EDGES = [(1, None), (2, ""), (None, "a b"), (3, " \n\t "), (4, "x"), (4, "x"), (4, "y z"), (5, "ab " * 5000)]


@pytest.mark.parametrize("f", [line_quality.line_first_clean, line_dedup.dedup_lines, simhash.simhash_components, suffix_dedup.remove_repeats, mixing.mix])
def test_edges(spark, f):
    assert f(docs(spark, EDGES)).count() == len(EDGES)
    assert f(docs(spark, [])).count() == 0


def test_edges_of_the_others(spark):
    d, none = docs(spark, EDGES), docs(spark, [])
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "y z")], "item_id long, text string")
    got = {(r.doc_id, r.n_words): r for r in decontaminate.decontaminate(d, bench).collect()}
    assert got[4, 1].n_hit == 1 and got[4, 1].n_items == 0 and got[4, 2].item_ids == ["3"] and not got[1, 0].contaminated and got[None, 2].n_hit == 0
    assert decontaminate.decontaminate(none, bench).count() == 0 and decontaminate.decontaminate(d, bench.limit(0)).count() == len(EDGES)
    pieces = token_counts.read_pieces(token_counts.VOCABULARY)
    assert token_counts.piece_counts(d, pieces).count() == len(EDGES) and token_counts.piece_counts(none, pieces).count() == 0
    target = spark.createDataFrame([(5,), (5,), (None,)], "doc_id long")
    scored = {(r.doc_id, r.n_tokens): r.score for r in lm_score.score(d, target).collect()}
    assert len(scored) == len(EDGES) - 1 and scored[1, 0] is None and scored[5, 15000] < scored[4, 1]
    assert lm_score.score(none, target).count() == 0


def test_url_rules(spark):
    rules = [("com", "/", "allow"), ("a.com", "/x", "block"), ("a.com", "/x", "allow"), ("b.a.com", "/x/y", "allow"), (None, "/", "block"), ("", "/", "block"), ("org", None, "block")]
    urls = ["http://A.com/x", "http://b.a.com/x/y?q", "http://b.a.com/x", "http://aa.com/x", "x", None, "", "http://com", "https://c.b.a.com/x/yz#f", "http://org/", "http://a.com/x", "http://a.com:80/x"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h"), (None, urls[0], "h")], "page_id long, url string, host string")

    def one(url):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fit = [(len(h + p), a, h + p) for h, p, a in rules if h and p and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, "allow", None))
        return host, path, best[2], best[1]

    got = url_rules.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, action string")).collect()
    assert len(got) == len(urls) + 2
    assert all((r.host, r.path, r.rule, r.verdict) == one(urls[r.page_id or 0]) for r in got)
    empty = spark.createDataFrame([], "host string, path string, action string")
    assert {r.verdict for r in url_rules.filter_urls(pages, empty).collect()} == {"allow"}
    assert url_rules.filter_urls(pages.limit(0), empty).count() == 0


def test_many_path_rules(spark):
    """A host with 100,000 rules, some nested in others, and urls whose longest rule is known; ties of length go to block."""
    rules = spark.range(100_000).select(F.lit("a.com").alias("host"), F.format_string("/%05d/", "id").alias("path"), F.when(F.col("id") % 2 == 0, "block").otherwise("allow").alias("action"))
    more = [("a.com", "/0000", "allow"), ("a.com", "/00007/x", "block"), ("b.a.com", "/00008", "allow"), ("a.com", "/00008/y", "block"), ("com", "", "block")]
    rules = rules.unionByName(spark.createDataFrame(more, "host string, path string, action string"))
    urls = {1: "/00007/xy", 2: "/00007/y", 3: "/0000", 4: "/00008/y", 5: "/99999/", 6: "/99999", 7: ""}
    pages = spark.createDataFrame([(i, "http://b.a.com" + u) for i, u in urls.items()], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.filter_urls(pages, rules, default="none").collect()}
    want = {1: ("a.com/00007/x", "block"), 2: ("a.com/00007/", "allow"), 3: ("a.com/0000", "allow"), 4: ("a.com/00008/y", "block"), 5: ("a.com/99999/", "allow"), 6: ("com", "block"), 7: ("com", "block")}
    assert got == want


def test_line_quality(spark):
    text = "One two three four five six seven eight.\nOne two three four five six seven eight.\nAll rights reserved. Copyright.\na | b | c | d\nend"
    r = line_quality.line_first_clean(docs(spark, [(1, text)])).first()
    assert (r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (1, 16, True, False)
    assert r.clean_text == "\n".join(text.split("\n")[:2])


def near(a, b):
    if a == b or max(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
        return a == b
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    q = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    return p + q >= max(len(a), len(b)) - 1


def test_line_dedup(spark):
    r = random.Random(3)
    base = [[r.choice("abcdefg") for _ in range(r.randrange(1, 18))] for _ in range(40)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(r.randrange(0, 6)):
            w = list(r.choice(base))
            for _ in range(r.randrange(0, 3)):
                k = r.randrange(len(w) + 1)
                w[k : k + r.randrange(2)] = [r.choice("abcdefg")] * r.randrange(2)
            lines.append(" ".join(w))
        rows.append((d, "\n".join(lines)))
    places = [(d, i, tuple(x.split())) for d, t in rows for i, x in enumerate(t.split("\n")) if x.split()]
    kept = collections.defaultdict(list)
    for j, (d, i, w) in enumerate(places):
        if not any(near(w, v) for _, _, v in places[:j]):
            kept[d].append(i)
    got = line_dedup.dedup_lines(docs(spark, rows)).collect()
    assert len(got) == 60 and all(r.kept_lines == kept[r.doc_id] for r in got)


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    texts = prose(60, 1)
    rows = list(enumerate([*texts, *(t + " end" for t in texts[:30]), texts[0], None, "", "É É É É"]))
    got = {r.doc_id: r for r in simhash.simhash_components(docs(spark, rows)).collect()}
    assert all(int(got[i].fingerprint, 16) == plain_fingerprint(t) for i, t in rows)
    fps = [int(got[i].fingerprint, 16) for i, _ in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(fps):
            root[i] = min(root[j] for j, b in enumerate(fps) if (a ^ b).bit_count() <= 4)
    assert [got[i].component_id for i, _ in rows] == root


@pytest.mark.parametrize("bucket", [2048, 4])
def test_simhash_buckets(spark, bucket):
    r = random.Random(2)
    centres = [r.getrandbits(64) for _ in range(5)]
    fps = {c ^ sum(1 << b for b in set(r.choices(range(64), k=r.randrange(4)))) for c in centres for _ in range(80)}
    fps |= {r.getrandbits(64) for _ in range(100)}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = {r.id: r.root for r in components(simhash.fingerprint_links(df, bucket=bucket)).collect()}
    signed = sorted(x.fp for x in df.collect())
    root = {x: x for x in signed}
    for _ in range(20):
        root = {x: min(root[y] for y in signed if ((x ^ y) & (1 << 64) - 1).bit_count() <= 4) for x in signed}
    assert all(found.get(x, x) == root[x] for x in signed)


def test_simhash_large_buckets(spark):
    """Rows dealt out grow with the fingerprints of one bucket, not with their pairs; a dense ball is walked in short time."""
    made = []
    for n in (50_000, 200_000):
        r = np.random.default_rng(n)
        fps = np.unique(r.integers(0, 1 << 51, n))
        df = spark.createDataFrame(pd.DataFrame({"fp": fps}))
        made.append(simhash.buckets(df).count() / len(fps))
    assert made[1] < 1.3 * made[0] and made[1] < 60
    near = np.zeros(60_000, np.int64)
    for _ in range(4):
        near ^= np.where(r.random(len(near)) < 0.9, 1 << r.integers(0, 63, len(near)), 0)
    near = np.unique(near)
    found = components(simhash.fingerprint_links(spark.createDataFrame(pd.DataFrame({"fp": near}))))
    assert found.where(f"root = {near.min()}").count() == len(near) - 1


@pytest.mark.parametrize("hot", [1024, 8, 1])
def test_suffix_dedup(spark, hot):
    r = random.Random(4)
    shared = ["".join(r.choice("abc é") for _ in range(n)) for n in (380, 400, 450, 900)]
    texts = ["".join(r.choice("xyz ") for _ in range(r.randrange(300))) + r.choice(shared) + "".join(r.choice("xyz ") for _ in range(r.randrange(300))) for _ in range(25)]
    texts += ["".join(r.choice("uvw ") for _ in range(r.randrange(300))) + shared[-1] + "".join(r.choice("uvw ") for _ in range(r.randrange(300))) for _ in range(40)]
    texts += [None, "", "q" * 900, "pq" * 300, texts[0], texts[0]]
    for p in (1, 2, 7, 100, 349, 350, 351, 352, 399, 400, 401):  # runs with a period, of many lengths, and broken ones
        unit = "".join(r.choice("klm é") for _ in range(p))
        for n in (399, 400, 400 + p - 1, 400 + p, 400 + 2 * p, 1500):
            texts.append("".join(r.choice("xyz ") for _ in range(r.randrange(60))) + (unit * (n // len(unit) + 1))[:n] + r.choice(["", "!", "!" + unit * 4]))
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + 400] for d in data for i in range(len(d) - 399))
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs(spark, list(enumerate(texts))), hot=hot).collect()}
    for k, d in enumerate(data):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - 399):
            if seen[d[i : i + 400]] > 1:
                gone[i : i + 400] = True
        assert got[k].n_removed == gone.sum() and bytes(got[k].kept) == np.frombuffer(d, np.uint8)[~gone].tobytes()


@pytest.mark.parametrize("unit", ["a", "abcdefg", "é"])
def test_long_runs(unit):
    """A long run with a period gives few segments, in time linear in its bytes."""
    text = "start " + unit * (10_000_000 // len(unit.encode())) + " end"
    began = time.time()
    (found,) = suffix_dedup._find_segments([pd.DataFrame({"doc_id": [1], "h": [2], "text": [text]})])
    assert len(found) < 2000 and time.time() - began < 20
    assert (found["n"] * found["times"]).sum() == len(text.encode()) - 399


def test_suffix_order():
    r = random.Random(1)
    for _ in range(200):
        d = bytes(r.choice(b"ab\xff") for _ in range(r.randint(1, 60)))
        o = suffix_dedup.suffix_order(d, 100).tolist()
        assert o == sorted(range(len(d)), key=lambda i: d[i:])


@pytest.mark.parametrize("most", [1000, 0])
def test_decontamination(spark, most):
    texts = prose(30, 7)
    items = [(1, " ".join(texts[0].split()[:20])), (2, "Under THE"), (3, "zzz"), (4, texts[1]), (10, texts[0].upper())]
    rows = list(enumerate([*texts, texts[0] + " " + texts[1], "under the under the under"]))
    split = lambda t: [w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)).split()]
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), most_literals=most).collect()}
    for i, t in rows:
        w, hit, ids = split(t), set(), set()
        for k, x in items:
            v = split(x)
            n = min(13, len(v))
            windows = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)}
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    ids.add(str(k))
        assert (got[i].n_words, got[i].n_hit, got[i].item_ids) == (len(w), len(hit), sorted(ids))


def test_near_matches(spark):
    d = spark.createDataFrame([(1, "p q alpha beta gamma delta r".split()), (2, "alpha beta x gamma delta".split()), (3, "alpha delta".split())], "key long, w array<string>")
    items = spark.createDataFrame([("i", "alpha beta gamma delta".split())], "item_id string, w array<string>")
    got = {(r.key, r.kind) for r in decontaminate.find_matches(d, items, slack=1).collect()}
    assert (1, "exact") in got and (2, "near") in got and not any(k == 3 for k, _ in got)


def test_mixing(spark):
    r = random.Random(5)
    rows = [(i, "w " * r.randrange(1, 60), ["a", "b", "c", None][min(3, int(r.expovariate(1)))]) for i in range(4000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d).toPandas()
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    names, weight = ["a", "b", "c", None], dict(zip(["a", "b", "c", None], (5, 2, 1, 5)))
    total, target, free = 1.5 * sum(size.values()), {}, list(names)
    while True:
        left = total - sum(target.values())
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s]]
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        free = [s for s in free if s not in over]
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    for s in names:
        g = got[got.source.isna() if s is None else got.source == s]
        assert abs(g.target.iloc[0] - target[s]) < 1e-6 * target[s] and abs(g.taken.sum() - target[s]) <= 60
    assert (got.taken <= 2 * got["size"]).all()
    assert mixing.mix(d.repartition(7)).toPandas().sort_values("doc_id").taken.tolist() == got.sort_values("doc_id").taken.tolist()


def test_splitting_tree(spark):
    quotas = spark.createDataFrame([("a", 700), ("b", 60), ("c", 1)], "src string, quota long")
    tree = mixing.splitting_tree(quotas, 8, 1).toPandas()
    for src, n in (("a", 700), ("b", 60), ("c", 1)):
        t = tree[tree.src == src].sort_values("shard")
        assert t["first"].tolist() == [1, *(t["last"].tolist()[:-1] + np.ones(7, int)).tolist()] and t["last"].iloc[-1] == n
    sizes = (tree["last"] - tree["first"] + 1).groupby(tree.shard).sum()
    assert sizes.max() - sizes.min() <= 3


def test_uneven_shards(spark):
    quotas = spark.createDataFrame([("a", 700), ("b", 0), ("c", 11)], "src string, quota long")
    tree = mixing.splitting_tree(quotas, 12, 1).toPandas()
    assert sorted(tree.shard.unique()) == list(range(12))
    sizes = tree["last"] - tree["first"] + 1
    assert sizes.groupby(tree.src).sum().to_dict() == {"a": 700, "b": 0, "c": 11}
    assert sizes.groupby(tree.shard).sum().between(58, 61).all()
    assert mixing.splitting_tree(quotas, 1, 1).toPandas()["last"].tolist() == [700, 0, 11]
    with pytest.raises(ValueError):
        mixing.splitting_tree(quotas, 0, 1)


def test_write_shards(spark, tmp_path):
    r = random.Random(6)
    rows = [(i, "w " * r.randrange(1, 30), r.choice(["a", "a", "a", "b", None])) for i in range(800)] + [(None, "x y", "a"), (None, "z", "a")]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=3, also=("text",))
    mixing.write_shards(mixed, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards")).toPandas()
    drawn = collections.Counter((x.doc_id, x.text, d["pass"], d["shard"]) for x in mixed.collect() for d in x.draws)
    ids = [None if pd.isna(i) else int(i) for i in back.doc_id]
    assert collections.Counter(zip(ids, back.text, back["pass"], back.shard, strict=True)) == drawn
    passes = collections.Counter((i, t, p) for (i, t, p, _), n in drawn.items() for _ in range(n) if i is not None)
    assert max(passes.values()) == 1 and set(back.shard) == {0, 1, 2}
    assert all((rows[i][0], rows[i][1]) == (i, t) for i, t in zip(ids, back.text, strict=True) if i is not None)
    in_order = back[back.shard == 0].sort_values("place").doc_id.dropna().tolist()
    assert in_order != sorted(in_order)


def test_warc_round_trip(spark, tmp_path):
    page = "<title>T &amp; t</title><script>x<</script><p>One <b>two</b><br>three<!-- c --></p><a href='/u'>l</a>"
    pages = spark.createDataFrame([(1, "http://a/", page), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    made = warc.derivatives(warc.responses(pages))
    got = made.orderBy("page_id", "warc_type").collect()
    assert [r.warc_type for r in got[:2]] == ["conversion", "metadata"] and len(got) == 6
    assert bytes(got[0].block).decode() == "T & t\nOne two\nthree\nl" and got[0].refers_to == got[1].refers_to
    assert f"conversion-record-id: {got[0].record_id}" in bytes(got[1].block).decode()
    members = warc.with_members(made).collect()
    (tmp_path / "a.warc.gz").write_bytes(b"".join(bytes(r.member) for r in members))
    back = warc.read_warc(spark, str(tmp_path / "a.warc.gz")).collect()
    assert [(r.record_id, bytes(r.block), r.headers) for r in back] == [(r.record_id, bytes(r.block), r.headers) for r in members]
    assert warc.derivatives(made).count() == 0


def test_token_counts(spark):
    pieces = [b" ab", b" a", b"b", b"bc", b"cd", b"d"]
    a = token_counts.Automaton(pieces)
    assert [a[w] for w in (b"ab", b"abc", b"abcd", b"abd", b"x", b"abbcd")] == [1, -1, 2, 2, -1, 3]
    whole = token_counts.read_pieces(token_counts.VOCABULARY)
    known, b = set(whole), token_counts.Automaton(whole)
    for w in " ".join(prose(20, 9)).encode().split():
        rest, n = b" " + w, 0
        while rest:
            k = next(j for j in range(len(rest), 0, -1) if rest[:j] in known)
            rest, n = rest[k:], n + 1
        assert b[w] == n


def test_lm_score_separates(spark):
    texts = prose(200, 11)
    rows = [(i, t if i % 2 else t.upper()) for i, t in enumerate(texts)]
    target = spark.createDataFrame([(i,) for i in range(1, 150, 2)], "doc_id long")
    got = lm_score.score(docs(spark, rows), target).toPandas().set_index("doc_id").score
    assert got[got.index % 2 == 1].max() < got[got.index % 2 == 0].min()


@pytest.mark.parametrize("most", [0, 10_000])
def test_lm_score(spark, most):
    """Scores against the same models, without the document itself, built from dictionaries."""
    rows = [(i, t) for i, t in enumerate(prose(40, 12))] + [(None, "a tion"), (3, "again"), (70, "é"), (71, None), (72, ""), (73, "again"), (73, "again")]
    named = {*range(0, 40, 3), 73}
    target = spark.createDataFrame([(i,) for i in [*named, 0, None]], "doc_id long")

    def grams(t, n):
        b = b"\n" * 3 + (t or "").encode()
        return [b[i - n + 1 : i + 1] for i in range(3, len(b))]

    def loss(texts, scale):
        n = {k: collections.Counter(g for t in texts for g in grams(t, k)) for k in (1, 3, 4)}
        ab, context = (collections.Counter() for _ in range(2))
        for k, c in ((3, ab), (4, context)):
            for g, m in n[k].items():
                c[g[:-1]] += m
        total = sum(n[1].values())

        def of(g):
            p = (scale * n[1][g[-1:]] + 1) / (scale * total + 256)
            p = (scale * n[3][g[-3:]] + lm_score.PRIOR * p) / (scale * ab[g[-3:-1]] + lm_score.PRIOR)
            return -np.log((scale * n[4][g] + lm_score.PRIOR * p) / (scale * context[g[:-1]] + lm_score.PRIOR))

        return of

    tokens = lambda some: sum(len(grams(t, 1)) for t in some)
    scale = tokens(t for i, t in rows if i in named) / tokens(t for _, t in rows)
    want = []
    for j, (i, t) in enumerate(rows):
        rest = rows[:j] + rows[j + 1 :]
        of_target, of_all = loss([x for k, x in rest if k in named], 1), loss([x for _, x in rest], scale)
        want.append((i, len(grams(t, 4)), np.mean([of_target(g) - of_all(g) for g in grams(t, 4)]) if t else None))
    got = [tuple(r) for r in lm_score.score(docs(spark, rows), target, most_bytes=most).collect()]
    by = lambda r: (r[0] is None, r[0] or 0, r[1])
    for g, w in zip(sorted(got, key=by), sorted(want, key=by), strict=True):
        assert g[:2] == w[:2] and (g[2] == w[2] if w[2] is None else abs(g[2] - w[2]) < 1e-9)


def test_lm_score_random_target(spark):
    """A target named at random is not told apart from the rest, as it would be by models that have counted it."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text <> ''").dropDuplicates(["text"])
    got = lm_score.score(d, d.where("pmod(xxhash64(doc_id, 5), 6) = 0")).toPandas().dropna()
    chosen = d.where("pmod(xxhash64(doc_id, 5), 6) = 0").select("doc_id").toPandas().doc_id
    inside = got.doc_id.isin(chosen)
    ranks = got.score.rank()
    auc = (ranks[inside].sum() - inside.sum() * (inside.sum() + 1) / 2) / (inside.sum() * (~inside).sum())
    assert 0.45 < auc < 0.55, auc


def test_edges_by_values(spark):
    """What each operator returns for nulls, empty and blank texts, repeated rows and ids, and a long text of one word."""
    d = docs(spark, EDGES)
    of = lambda df, *columns: sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    want = lambda f: sorted(repr((i, *f(t))) for i, t in EDGES)

    words = lambda t: len((t or "").split())
    lines = lambda t: sum(bool(x.split()) for x in (t or "").split("\n"))
    cut = suffix_dedup.remove_repeats(d)
    assert of(cut, "doc_id", "n_bytes", "n_removed", "starts", "ends") == want(lambda t: (len(t or ""), 15000, [0], [15000]) if words(t) > 9 else (len(t or ""), 0, [], []))
    assert {bytes(r.kept) for r in cut.collect() if r.n_removed} == {b""}
    judged = line_quality.line_first_clean(d)
    assert of(judged, "doc_id", "n_words", "word_chars", "n_repeat_words", "base_failed", "kept") == want(lambda t: (words(t), len("".join((t or "").split())), 5000 if words(t) > 9 else 0, True, False))
    # the two rows (4, "x") are one document; no line is near another
    kept = line_dedup.dedup_lines(d)
    assert of(kept, "doc_id", "n_lines", "n_removed") == want(lambda t: (lines(t), 0))
    found = simhash.simhash_components(d)
    assert of(found, "doc_id", "fingerprint") == want(lambda t: (f"{plain_fingerprint(t):016x}",))
    assert {r.component_id for r in found.collect() if int(r.fingerprint, 16) == 0} == {1}
    mixed = mixing.mix(d)
    assert of(mixed, "doc_id", "size") == want(lambda t: (words(t),))
    assert all(0 <= r.taken <= 2 * r["size"] for r in mixed.collect()) and abs(sum(r.taken for r in mixed.collect()) - 1.5 * 5006) <= 5000
