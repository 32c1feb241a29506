"""Edited tables, the store of names and upload checks against plain Python."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from siltbed.functions import scalars
from siltbed.sources import edits, ingest, names


def state(table):
    return {r.k: (r.a, r.b) for r in table.read().collect()}


def test_edits_replayed(spark, tmp_path):
    """Random batches, some run twice, some lost after their rows were written, against a dict."""
    r = random.Random(1)
    want = {k: (f"a{k}", k) for k in range(60)}
    df = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    table = edits.EditedTable.create(df([(k, *v) for k, v in want.items()], "k long, a string, b long"), str(tmp_path / "t"), "k")
    for batch in range(9):
        kind = batch % 4
        keys = r.sample(sorted(want), 12)
        if kind == 0:
            rows = [(1000 + 20 * batch + i, r.choice(["x", None])) for i in range(10)]
            want |= {k: (a, None) for k, a in rows}
            run = lambda: table.insert(df(rows, "k long, a string"), batch)  # noqa: B023, E731
        elif kind == 1:
            rows = [(k, r.choice([None, r.randrange(100)]), i) for i, k in enumerate(keys + keys[:5])]
            for k, b, _ in rows:
                want[k] = (want[k][0], b)
            run = lambda: table.update(df(rows, "k long, b long, seq int"), batch, "seq")  # noqa: B023, E731
        elif kind == 2:
            want |= {k: ("deleted", want[k][1]) for k in keys}
            run = lambda: table.delete(df([(k,) for k in keys], "k long"), batch, {"a": "deleted"})  # noqa: B023, E731
        else:
            want = {k: v for k, v in want.items() if k not in keys}
            run = lambda: table.delete(df([(k,) for k in keys], "k long"), batch)  # noqa: B023, E731
        run()
        if batch in (2, 5):  # the rows are there, the mark is not: nothing counts until it is run again
            shutil.rmtree(f"{table.path}/marks/kind=batch/number={batch}")
            assert state(table) != want
        run()
        assert state(table) == want, batch
        if batch == 4:
            table.compact()
            assert table._deltas() is None and state(table) == want
            assert run() == 0 and state(table) == want  # in the base already
    again = edits.EditedTable(spark, table.path, "k")
    again.compact()
    assert state(again) == want


def test_edits_refused(spark, tmp_path, monkeypatch):
    d = spark.createDataFrame([(1, "a"), (2, None)], "k long, a string")
    table = edits.EditedTable.create(d, str(tmp_path / "t"), "k")
    row = lambda *r: spark.createDataFrame([r], "k long, a string")
    for rows in (row(1, "x"), row(None, "x"), row(7, "x").unionByName(row(7, "y"))):
        with pytest.raises(ValueError):
            table.insert(rows, 0)
    for f in (lambda: table.update(row(9, "x"), 0), lambda: table.delete(row(9, "x"), 0), lambda: table.delete(row(9, "x"), 0, {"a": "deleted"})):
        with pytest.raises(LookupError):
            f()
    with pytest.raises(ValueError):
        table.update(row(1, "x").withColumn("z", F.lit(1)), 0)
    assert {x.k for x in table.read().collect()} == {1, 2}
    ask = lambda batch, **x: edits.serve(table, {"request_type": "db_opr", **x}, batch)
    with pytest.raises(LookupError):
        ask(0, action="delete", conditions=[("a", "=", "none")])
    with pytest.raises(ValueError):
        ask(0, action="drop")
    monkeypatch.setattr(edits, "MOST", 0)
    assert ask(0, action="update", conditions=[("a", "=", "a")], resource_info={"a": "b"}) == 1
    assert ask(0, action="count", conditions=[("a", "=", "b")]).first().n == 1


def test_name_store(spark, tmp_path, monkeypatch):
    store = names.NameStore(spark, str(tmp_path / "s"), 20_000)
    of = lambda a, b: spark.range(a, b).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    store.add(of(0, 12_000).unionByName(spark.createDataFrame([(None,), ("",), ("n1",)], "name string")), 0)
    store.add(of(8_000, 20_000), 1)
    store.add(of(8_000, 20_000), 1)
    assert store.possible(of(0, 20_000)).count() == 20_000
    passed = store.possible(of(20_000, 120_000)).count()
    assert passed <= 0.01 * 100_000, passed
    asked = of(19_990, 20_500).unionByName(spark.createDataFrame([("",), (None,), ("n5",), ("n5",)], "name string"))
    want = {"", "n5", *[f"n{i}" for i in range(19_990, 20_000)]}
    assert sorted(r.name for r in store.existing(asked).collect()) == sorted(want)
    monkeypatch.setattr(names, "MOST", 1)
    assert sorted(r.name for r in store.existing(asked).collect()) == sorted(want)


def test_check_with_a_hot_name(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["hot", "hot", "a", "b", None, "bad!"]), i % 4) for i in range(400)]
    seen, want = {"b"}, {}
    for i, n, bad in rows:
        wrong = bad == 3 or n == "bad!"
        want[i] = "error" if wrong else "duplicate" if n in seen else "created"
        if not wrong:
            seen.add(n)
    df = spark.createDataFrame(rows, "i long, name string, bad int").repartition(4)
    rules = {"name": F.col("name").isNull() | scalars.is_name(F.col("name")), "bad": F.col("bad") != 3}
    out = ingest.check(df, rules, "name", "i", spark.createDataFrame([("b",), ("b",), (None,)], "name string"))
    assert {x.i: x.outcome for x in out.collect()} == want
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
