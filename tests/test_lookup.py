"""Incremental snapshots, as-of alignment, facets under filters and rank directories against plain Python."""

import glob
import os
import random
import shutil
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltbed.operators import asof, grid, ranks, substring
from siltbed.streaming import changes

DAY = datetime(2024, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().toString()


# ---------------------------------------------------------------- changes


def rows_over_time(seed, n, keys):
    r = random.Random(seed)
    out = [(r.randrange(keys), DAY + timedelta(minutes=r.randrange(500)), i, r.choice("abc"), r.choice(["x", None, ""])) for i in range(n)]
    r.shuffle(out)
    return out


KINDS = "k long, at timestamp, tie long, s string, t string"


def counts_of(rows):
    last = {}
    for r in rows:
        if r[0] is not None and r[1] is not None:
            last[r[0]] = max(last.get(r[0], r[1:]), r[1:], key=lambda x: x[:2])
    return Counter(p for x in last.values() for p in (("s", x[2] or "null"), ("t", "null" if x[3] is None else x[3])))


def put(spark, rows, source, number):
    """One file, named by its number, so that files come in this order."""
    at = f"{source}-{number}"
    spark.createDataFrame(rows, KINDS).coalesce(1).write.parquet(at)
    os.makedirs(source, exist_ok=True)
    (part,) = glob.glob(f"{at}/*.parquet")
    shutil.move(part, f"{source}/{number:03}.parquet")


def follow(spark, at):
    schema = spark.createDataFrame([], KINDS).schema
    changes.run_changes(spark, f"{at}/in", schema, "k", "at", "tie", ["s", "t"], f"{at}/out", f"{at}/cp", files=1).awaitTermination()
    return {(r.status_name, r.status_value): r.rcd_count for r in changes.latest_counts(spark, f"{at}/out").collect()}


def test_changes_over_batches_restarts_and_repeats(spark, tmp_path):
    at, rows = str(tmp_path), [*rows_over_time(1, 240, 25), (None, DAY, 1, "a", "x"), (3, None, 1, "a", "x")]
    for i in range(4):
        put(spark, rows[i * 40 : i * 40 + 40], f"{at}/in", i)
    assert follow(spark, at) == counts_of(rows[:160])
    os.remove(f"{at}/cp/commits/3")  # the last batch ran, but was not committed: it is run again
    for p in glob.glob(f"{at}/cp/commits/.3*"):
        os.remove(p)
    assert follow(spark, at) == counts_of(rows[:160])
    for i in range(4):  # what was read is gone, and only the last counts are left
        os.remove(f"{at}/in/{i:03}.parquet")
    for i in range(3):
        shutil.rmtree(f"{at}/out/batch={i}")
    put(spark, rows[160:], f"{at}/in", 4)
    assert follow(spark, at) == counts_of(rows)
    before = changes.late_rows(spark, f"{at}/out")
    put(spark, rows[:40], f"{at}/in", 5)  # rows that were there before change nothing
    assert follow(spark, at) == counts_of(rows)
    assert changes.late_rows(spark, f"{at}/out") == before + 40 > 40


def test_state_is_kept_by_bucket(spark, tmp_path):
    """State grows by keys, not by calls: a row per bucket, also where a bucket comes in many parts; late rows are counted one by one."""
    at, rows = str(tmp_path), rows_over_time(4, 6000, 2500)
    for i in range(2):
        put(spark, rows[i * 3000 : i * 3000 + 3000], f"{at}/in", i)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "4")
    try:
        assert follow(spark, at) == counts_of(rows)
    finally:
        spark.conf.set(name, before)
    held = spark.read.format("statestore").load(f"{at}/cp").count()
    assert 0 < held <= changes.BUCKETS < len({r[0] for r in rows})
    last = {}
    for r in rows[:3000]:
        last[r[0]] = max(last.get(r[0], r[1:3]), r[1:3])
    assert changes.late_rows(spark, f"{at}/out") == sum(r[0] in last and r[1:3] <= last[r[0]] for r in rows[3000:]) > 0


# ---------------------------------------------------------------- as of


def test_asof(spark):
    r = random.Random(2)
    key = lambda: "hot" if r.random() < 0.7 else r.choice(["a", "b", None, ""])
    right = [(key(), r.choice([None, *range(400)]), r.choice([None, *range(9)])) for _ in range(300)]
    left = [(key(), r.choice([None, *range(-5, 420)]), i % 50) for i in range(500)]
    right += [("one", 5, 1)]
    left += [("one", t, 0) for t in range(300)] + [("none", 1, 0)]
    best = lambda v: (v is not None, v or 0)  # noqa: E731  a null is the least value

    def found(k, t):
        known = [x for x in right if k is not None and t is not None and x[0] == k and x[1] is not None and x[1] <= t]
        return max(known, key=lambda x: (x[1], best(x[2])))[1:][::-1] if known else (None, None)

    want = sorted(repr((k, t, n, *found(k, t))) for k, t, n in left)
    ldf = spark.createDataFrame(left, "key string, at long, part int").repartition(3)
    rdf = spark.createDataFrame(right, "key string, at long, value int").withColumn("since", F.col("at"))
    for ranges in (1, 7, 60):
        got = asof.asof(ldf, rdf, ["key"], "at", ["value", "since"], ranges)
        assert sorted(repr(tuple(x)) for x in got.collect()) == want
    assert {(x.value, x.since) for x in asof.asof(ldf, rdf.limit(0), ["key"], "at", ["value", "since"]).collect()} == {(None, None)}
    assert asof.asof(ldf.limit(0), rdf, ["key"], "at", ["value"]).count() == 0
    with pytest.raises(ValueError):
        asof.asof(ldf, rdf.withColumn("part", F.lit(1)), ["key"], "at", ["part"])


def test_a_hot_key_is_spread(spark):
    """Nine tenths of the rows have one key; no range gets more than a few of the ranges' mean."""
    left = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), F.col("id").alias("at"))
    key = F.to_json(F.struct(F.col("key").alias("k0")))
    sizes = [r["count"] for r in left.repartitionByRange(16, key, "at").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 3 * 20_000 / 16
    got = asof.asof(left, left.where("at % 1000 = 1").withColumn("known", F.col("at")), ["key"], "at", ["known"], 16).where("key = 'hot'")
    assert got.where("NOT known <=> CASE WHEN at >= 1 THEN (at - 1) div 1000 * 1000 + 1 END").count() == 0


# ---------------------------------------------------------------- facets


def test_cross_facets(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.choice([1, 2, None]), r.choice([True, False]), i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "x string, y int, z boolean, w int")
    tests = {"x": lambda t: t[0] == "a", "y": lambda t: t[1] is not None and t[1] > 1, "z": lambda t: t[2], "w": lambda t: True}
    want = Counter()
    for i, c in enumerate(tests):
        for t in rows:
            if t[3] < 2 and all(f(t) for k, f in tests.items() if k != c):
                want[c, None if t[i] is None else str(t[i]).lower() if c == "z" else str(t[i])] += 1
    got = grid.cross_facets(df, {"x": F.col("x") == "a", "y": F.col("y") > 1, "z": F.col("z"), "w": None}, [F.col("w") < 2])
    assert {(t.facet, t.value): t.n for t in got.collect()} == want
    assert grid.cross_facets(df.limit(0), {"x": None}).count() == 0
    with pytest.raises(ValueError):
        grid.cross_facets(df, dict.fromkeys(map(str, range(63))))


def test_facets_scan_once(spark, tmp_path):
    spark.range(10).select("id", (F.col("id") % 2).alias("b")).write.parquet(str(tmp_path / "t"))
    got = grid.cross_facets(spark.read.parquet(str(tmp_path / "t")), {"id": F.col("id") > 3, "b": F.col("b") == 1})
    assert plan_of(got).split("== Physical Plan ==")[1].count("FileScan") == 1


# ---------------------------------------------------------------- ranks


def test_directory(spark):
    r = random.Random(4)
    rows = [(i, 7 if r.random() < 0.6 else r.choice([None, *range(20)])) for i in range(3000)]
    order = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0)))
    df = spark.createDataFrame(rows, "id long, v int").repartition(5)
    index = ranks.Directory.build(df, F.desc_nulls_last("v"), ranges=12)
    got = sorted((x.number, x.id, x.v) for x in index.numbered().collect())
    assert [n for n, _, _ in got] == list(range(3000)) and [v for _, _, v in got] == [v for _, v in order] and sorted(i for _, i, _ in got) == list(range(3000))
    sizes = [b - a for a, b in zip(index.starts, [*index.starts[1:], index.total])]
    assert max(sizes) < 3 * 3000 / 12  # the hot key is in several ranges
    assert "SinglePartition" not in plan_of(index.numbered())
    for page in (0, 3, 29, 30):
        rows_of = index.page(page, 100).collect()
        assert [x.number for x in rows_of] == list(range(page * 100, min(page * 100 + 100, 3000)))
        assert [(x.id, x.v) for x in rows_of] == [(i, v) for n, i, v in got if page * 100 <= n < page * 100 + 100]
        assert len(index.ranges_of(page * 100, page * 100 + 100)) <= 3
    again = ranks.Directory(spark, index.path)
    assert (again.starts, again.total) == (index.starts, 3000) and again.page(3, 100).count() == 100
    none = ranks.Directory.build(df.limit(0), "v")
    assert none.total == 0 and none.page(0, 10).count() == none.numbered().count() == 0


def test_percents(spark):
    r = random.Random(5)
    rows = [(s, r.choice([None, *range(40)]), i) for s, k in (("a", 900), ("b", 7), ("c", 1), (None, 60)) for i in range(k)]
    df = spark.createDataFrame(rows, "s string, v int, id int").repartition(4)

    def want(low, high):
        for s in {x[0] for x in rows}:
            own = [x for x in rows if x[0] == s]
            key = lambda x: (x[1] is not None, x[1] or 0)
            for x in own:
                before = sum(key(y) < key(x) for y in own)
                if low / 100 <= (before / (len(own) - 1) if len(own) > 1 else 0) <= high / 100:
                    yield x

    for low, high in ((0, 50), (25, 75), (0, 0), (100, 100), (33.3, 66.6), (0, 100), (60, 40)):
        got = ranks.between_percents(df, "s", "v", low, high)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want(low, high))), (low, high)
    assert ranks.between_percents(df.limit(0), "s", "v", 0, 50).count() == 0


# ---------------------------------------------------------------- substrings


def test_substrings(spark, tmp_path):
    r = random.Random(6)
    words = ["Thand", "THE", "ñandú", "ciónñ", "100%_", "a_b", "ΟΔΟΣ", "İz", "ß", "x", "𝄞🙂", "the", "\0"]
    texts = [None, "", "a", "ab", "abc", *[" ".join(r.choices(words[:9] if i % 7 else words, k=r.randrange(1, 25))) for i in range(900)], "the zyxwv 100%_"]
    rows = [(i, t, "kept") for i, t in enumerate(texts)] + [(5, texts[5], "kept")]
    d = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(3)
    index = substring.Index(spark, str(tmp_path / "index"))
    index.add(d.where("doc_id < 500"), 0)
    index.add(d.where("doc_id >= 500"), 1)
    index.add(d.where("doc_id >= 500"), 1)  # again, as a retried job would
    read = {}
    for p in ["", "a", "ab", "abc", "%", "_", "%_", "a_b", "thand", "Thand", "THE Thand ñandú", "ñ", "É", "Σ", "ΔΟΣ", "ΟΔΟΣ İz", "İ", "ς", "i̇z", "🙂", "𝄞🙂", "absent words", "zz", "\0", "THAND THE", "e zyx", texts[700]]:
        for ci in (False, True):
            has = F.contains(F.lower("text"), F.lower(F.lit(p))) if ci else F.contains("text", F.lit(p))
            got, want = (sorted(map(repr, map(tuple, x.select("doc_id", "text", "part").collect()))) for x in (index.search(p, ci), d.where(has)))
            assert got == want, (p, ci)
            read[p, ci] = index.candidates(p, ci).count()
    assert read["absent words", True] == 0 and read["zz", True] == 0
    assert read["e zyx", False] == read["e zyx", True] <= 1 << substring.ROWS and read["", False] == len(rows)
    assert read["𝄞🙂", False] < len(rows)
    index.add(d.limit(0), 2)
    assert index.search("thand", True).count() == d.where("contains(lower(text), 'thand')").count()


def test_many_blocks_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(substring, "NAMED", 2)
    d = spark.range(3000).select("id", F.concat(F.lit("row "), F.col("id").cast("string")).alias("text"))
    index = substring.Index(spark, str(tmp_path / "index"))
    index.add(d, 0)
    assert index.search("row", False).count() == 3000 and index.search("99", True).count() == d.where("text LIKE '%99%'").count()
