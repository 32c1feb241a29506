"""Variants, sessions, pyramids and pages against plain Python."""

import glob
import json
import os
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltbed.operators import pyramid, variants
from siltbed.sources import ingest, pages
from siltbed.streaming import sessions

DAY = datetime(2024, 1, 1)


# ---------------------------------------------------------------- variants


def walked(value, path="$"):
    kinds = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}
    yield path, kinds.get(type(value), "number")
    for k, v in value.items() if isinstance(value, dict) else ((None, v) for v in value) if isinstance(value, list) else ():
        yield from walked(v, f"{path}[*]" if k is None else f"{path}.{k}")


def test_paths_and_values(spark):
    r = random.Random(1)
    leaf = lambda: r.choice([1, -2.5, "x", "7", True, None, 10**12, "", [], {}])
    make = lambda d: leaf() if d == 0 or r.random() < 0.3 else {k: make(d - 1) for k in r.sample("abc", 2)} if r.random() < 0.6 else [make(d - 1) for _ in range(r.randrange(4))]
    values = [make(4) for _ in range(150)]
    texts = [json.dumps(v) for v in values] + [None, "", "{", "nope", '{"a": }']
    df = variants.parsed(spark.createDataFrame(list(enumerate(texts)), "id long, j string").repartition(3), "j")
    assert {(x.path, x.kind): x.n for x in variants.paths(df, "v").collect()} == Counter(p for v in values for p in walked(v))
    assert [x.v_broken for x in df.orderBy("id").collect()] == [False] * 151 + [True] * 4
    got = variants.extracted(df, "v", {"n": ("$.a", "bigint"), "s": ("$.b", "string")}).orderBy("id").collect()
    for v, x in zip(values, got):
        a = v.get("a") if isinstance(v, dict) else None
        assert x.n == (int(a) if isinstance(a, (int, float)) or a == "7" else None)
    assert variants.paths(df.limit(0), "v").count() == 0
    deep = spark.createDataFrame([("[" * 20 + "]" * 20,)], "j string")
    with pytest.raises(ValueError):
        variants.paths(variants.parsed(deep, "j"), "v", 5)


# ---------------------------------------------------------------- sessions


def test_sessions_of_a_stream_and_late_rows(spark, tmp_path):
    at, kinds = str(tmp_path), "k string, at timestamp, v long"
    minute = lambda *ms: [DAY + timedelta(minutes=m) for m in ms]
    batches = [
        [("a", t, 1) for t in minute(0, 5, 30)] + [("b", t, 1) for t in minute(2)],
        [("a", t, 1) for t in minute(38, 70)] + [(None, t, 1) for t in minute(50)],
        [("a", t, 1) for t in minute(1)] + [("b", t, 1) for t in minute(66)] + [("b", None, 1)],  # a's row is too late: the watermark is 55
        [("end", t, 0) for t in minute(900)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(f"{at}/in")
        q = sessions.run_sessions(spark, f"{at}/in", spark.createDataFrame([], kinds).schema, "k", "at", "10 minutes", "15 minutes", [F.sum("v").alias("v")], f"{at}/out", f"{at}/cp", 1)
        q.awaitTermination()
        late = sessions.late_rows(q)
        assert late == (1 if rows is batches[2] else 0)
    got = {(x.k, x.start, x.end, x.v) for x in spark.read.parquet(f"{at}/out").collect()}
    span = lambda a, b: tuple(minute(a, b))
    assert got == {("a", *span(0, 15), 2), ("a", *span(30, 48), 2), ("a", *span(70, 80), 1), ("b", *span(2, 12), 1), ("b", *span(66, 76), 1), (None, *span(50, 60), 1)}


# ---------------------------------------------------------------- pyramids


def test_spans():
    r = random.Random(2)
    for _ in range(300):
        a = r.randrange(0, 5000) * 60
        b = a + r.randrange(0, 6000) * 60
        found = pyramid.spans(a, b)
        cells = sorted((x, w) for level, low, high in found for w in [pyramid.LEVELS[level]] for x in range(low, high, w))
        assert [x for x, _ in cells] == [a + sum(w for _, w in cells[:i]) for i in range(len(cells))] and a + sum(w for _, w in cells) == b
        assert sum(w == 3600 for _, w in cells) <= 46 and sum(w == 60 for _, w in cells) <= 118
    with pytest.raises(ValueError):
        pyramid.spans(1, 60)


def test_pyramid(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.choice(["x", "y", None]), DAY + timedelta(seconds=r.randrange(4 * 86_400)), r.randrange(500), r.choice([None, r.random()])) for _ in range(6000)]
    df = spark.createDataFrame([*rows, ("x", None, 1, 1.0)], "kind string, at timestamp, who long, v double")
    cells = pyramid.Pyramid(spark, str(tmp_path / "p"), ["kind"])
    cells.add(df.where("who < 200"), 0, "at", "who", "v")
    cells.add(df.where("who >= 200"), 1, "at", "who", "v")
    cells.add(df.where("who >= 200"), 1, "at", "who", "v")
    a, b = DAY + timedelta(hours=5, minutes=20), DAY + timedelta(days=3, hours=2, minutes=1)
    got = {x.kind: x for x in cells.summary(a, b, [0.25, 0.5]).collect()}
    for kind in ("x", "y", None):
        own = [x for x in rows if x[0] == kind and a <= x[1] < b]
        vs = sorted(x[3] for x in own if x[3] is not None)
        assert got[kind].n == len(own) and abs(got[kind].keys - len({x[2] for x in own})) <= 0.05 * len({x[2] for x in own})
        for q in (25, 50):
            assert abs(sum(v <= got[kind][f"q{q}"] for v in vs) / len(vs) - q / 100) < 0.04
    read = cells.cells(a, b)
    assert {x.level for x in read.select("level").distinct().collect()} == {"day", "hour", "minute"}
    minutes = 40 + 1  # to 06:00, and from 02:00
    assert read.where("level = 'minute'").select("start").distinct().count() <= minutes and read.where("level = 'day'").select("start").distinct().count() == 2
    assert read.count() <= 3 * 2 * (2 + 18 + 2 + minutes) and cells.summary(b, b).count() == 0


# ---------------------------------------------------------------- pages

KINDS = "k long, s string, d date, t timestamp, x decimal(10,2), b boolean"


def test_pages(spark, tmp_path):
    rows = [(i, r"é \" {" if i % 3 else None, DAY.date(), DAY + timedelta(seconds=i), None, i % 2 == 0) for i in range(950)]
    d = spark.createDataFrame(rows, KINDS).repartition(5)
    at = str(tmp_path / "p")
    pages.export(d, at, "k", 100)
    same = lambda a, b: sorted(map(repr, map(tuple, a.collect()))) == sorted(map(repr, map(tuple, b.collect())))
    assert same(pages.read_pages(spark, at, KINDS), d) and same(pages.read_pages(spark, at, "s string, k long", 3), d.select("s", "k"))
    for where, read in (("k = 5", 1), ("k >= 300 AND k < 400", 1), ("k > 899", 1), ("k < 0", 0), ("k <= 99 OR k = 3", 10), ("s IS NULL", 10), ("450 < k", 6)):
        found = pages.read_pages(spark, at, KINDS, 1).where(where)
        assert same(found, d.where(where)) and found.rdd.getNumPartitions() <= max(read, 1), where


def test_broken_pages(spark, tmp_path):
    at = str(tmp_path / "p")
    pages.export(spark.range(50).select(F.col("id").alias("k")), at, "k", 10)
    path = lambda i: glob.glob(f"{at}/pages/page={i}/part-*")[0]
    for i, body in ((1, "{"), (2, '{"page": 2, "rows": []}')):
        with open(path(i), "w") as f:
            f.write(body)
    os.remove(path(3))
    for crc in glob.glob(f"{at}/pages/page=*/.*crc"):
        os.remove(crc)
    got = pages.read_pages(spark, at, "k long", errors=True).collect()
    assert sorted(x.k for x in got if x.page_error is None) == [*range(10), *range(40, 50)]
    assert sorted(x.page_error[:7] for x in got if x.page_error) == ["page 1:", "page 2:", "page 3:"]
    with pytest.raises(Exception, match="page [123]"):
        pages.read_pages(spark, at, "k long").collect()


def test_a_database_read_in_parts(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/parts;create=true"
    spark.range(100).select(F.when(F.col("id") != 7, F.col("id")).alias("K"), F.col("id").cast("string").alias("S")).write.format("jdbc").options(url=url, dbtable="T").save()
    got = ingest.read_table_parts(spark, url, "T", "K", 4)
    assert got.rdd.getNumPartitions() == 4 and {x.S for x in got.collect()} == set(map(str, range(100)))
    spark.range(0).select(F.col("id").alias("K")).write.format("jdbc").options(url=url, dbtable="E").save()
    assert ingest.read_table_parts(spark, url, "E", "K", 4).count() == 0
