import numpy as np
import pytest
from pyspark.sql import functions as F

from siltbed.functions import scalars
from siltbed.functions.predicates import Condition, Group, chain, tree
from siltbed.operators import charts, documents, records, snapshot
from siltbed.schemas import DOCUMENTS
from siltbed.sources import ingest
from siltbed.streaming.snapshots import run_snapshots


def test_chain_precedence_blanks_and_errors(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, s string")
    keep = lambda *cs: [r.k for r in df.where(chain(df, cs)).orderBy("k").collect()]
    assert keep(Condition("k", "=", "1", "OR"), Condition("k", "=", "2", "OR"), Condition("s", "=", "z")) == [1]
    assert keep(Condition("s", "<>", "a")) == [2]
    assert keep(Condition("s", "=", "  ")) == [1, 2, 3]
    assert keep(Condition("k", "=", "x")) == []
    for bad in (Condition("q", "=", "1"), Condition("k", "~", "1"), Condition("k", "=", "1", "XOR")):
        with pytest.raises(ValueError):
            chain(df, [bad])
    assert df.where(tree(df, Group("OR", ()))).count() == 0


def test_file_sizes(spark):
    sizes = [0, 1023, 1024, 1536, 1 << 30, 1 << 40]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i int, s long").orderBy("i").select(scalars.file_size(F.col("s")).alias("x")).collect()
    assert [r.x for r in rows] == ["0 Bytes", "1023 Bytes", "1 KB", "1.5 KB", "1 GB", None]


def test_names(spark):
    df = spark.createDataFrame([("a_1",), ("a\n",), ("",), (None,)], "s string")
    assert [r.x for r in df.select(scalars.is_name(F.col("s")).alias("x")).collect()] == [True, False, False, None]


def test_history_and_stream(spark, tmp_path):
    rows = [("a",), ("",), (None,), ("null",)]
    source, history = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame(rows, "s string")
    df.write.parquet(source)
    run_snapshots(spark, source, df.schema, ["s"], "t", history, str(tmp_path / "cp")).awaitTermination()
    got = {r.status_value: r.rcd_count for r in snapshot.read_history(spark.read.parquet(history)).collect()}
    assert got == {"a": 1, "empty": 1, "null": 2}


def test_insert_and_soft_delete(spark):
    d = documents.generate(spark.range(5))
    assert [f.name for f in d.schema] == DOCUMENTS.names
    with pytest.raises(LookupError):
        documents.soft_delete(d, 99)
    with pytest.raises(ValueError):
        documents.insert(d, d.withColumn("x", F.lit(1)))
    twice = documents.soft_delete(documents.soft_delete(d, 2), 2)
    assert [r.doc_id for r in twice.where("doc_status = 'deleted'").orderBy("doc_id").collect()] == [2, 4]


def test_downsample(spark):
    """Points of series of several sizes, one of them null, against the walk over each whole series."""
    r = np.random.default_rng(4)
    sizes = {"a": 5000, "b": 51, "c": 50, "d": 2, None: 700, "one x": 300}
    rows = [(s, None if s == "one x" else float(i), float(v)) for s, k in sizes.items() for i, v in zip(r.permutation(k), r.normal(size=k))]
    rows = [(s, 7.0 if x is None else x, y) for s, x, y in rows]
    bad = [("a", None, 1.0), ("a", 1.0, None), ("b", float("nan"), 1.0), ("null alone", None, None)]
    d = spark.createDataFrame(rows + bad, "s string, t double, v double").repartition(4)
    got = {}
    for g in charts.downsample(d, "s", "t", "v", 50, cell_rows=100).collect():
        got.setdefault(g.s, []).append((g.t, g.v))
    assert set(got) == set(sizes)
    for s in sizes:
        p = np.array(sorted((x, y) for k, x, y in rows if k == s))
        assert sorted(got[s]) == [tuple(q) for q in p[charts.largest_triangles(p[:, 0], p[:, 1], 50)]], s
    twice = spark.createDataFrame([("x", 1.0, 2.0)] * 2, "s string, t double, v double")
    assert charts.downsample(twice, "s", "t", "v", 5).count() == 2 and charts.downsample(twice.limit(0), "s", "t", "v", 5).count() == 0


def test_largest_triangles():
    x = np.arange(1000.0)
    y = np.sin(x / 50)
    y[500] = 10
    kept = charts.largest_triangles(x, y, 50)
    assert len(kept) == 50 and kept[0] == 0 and kept[-1] == 999 and 500 in kept and (np.diff(kept) > 0).all()
    assert len(charts.largest_triangles(x[:3], y[:3], 50)) == 3


def test_ingest(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,v\nx,1\n")
    (tmp_path / "a.json").write_text('[{"name": "x"}, {"name": "y"}]')
    (tmp_path / "a.txt").write_text("x\ny\n")
    assert [ingest.read(spark, str(tmp_path / f"a.{k}")).count() for k in ("csv", "json", "txt")] == [1, 2, 2]
    files = spark.createDataFrame([("a.JSON", 5), ("b.exe", 5), ("c.csv", 11 << 20)], "path string, length long")
    assert [r.ok for r in ingest.gate(files).orderBy("path").collect()] == [True, False, False]
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c d")], "i int, name string")
    out = ingest.check(rows, {"bad": scalars.is_name(F.col("name"))}, "name", "i", spark.createDataFrame([("b",)], "name string"))
    assert [r.outcome for r in out.orderBy("i").collect()] == ["created", "duplicate", "duplicate", "error"]


def test_predicates_without_case(spark):
    df = spark.createDataFrame([(9, "b"), (10, "B"), (100, "c\\")], "k long, s string")
    keep = lambda *cs: [r.k for r in df.where(chain(df, cs, ci=True)).orderBy("k").collect()]
    assert keep(Condition("k", ">=", "10")) == [10, 100] and keep(Condition("k", "between", "10", "AND", "11")) == [10]
    assert keep(Condition("s", "between", "B", "AND", "Bz")) == [9, 10] and keep(Condition("s", "LIKE", "%\\")) == [100]
    assert keep(Condition("s", "IN", ["B"])) == [9, 10] and keep(Condition("k", "IN", ["9", "x"])) == [9]


def test_stream_batch_again(spark, tmp_path):
    """A stream that goes on from its checkpoint counts new files alone; a batch run again does not count twice."""
    source, history, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    df = spark.createDataFrame([("a",), ("b",)], "s string")
    run = lambda: run_snapshots(spark, source, df.schema, ["s"], "t", history, checkpoint).awaitTermination()
    df.write.parquet(source)
    run()
    df.where("s = 'a'").write.mode("append").parquet(source)
    run()
    for commit in (tmp_path / "cp" / "commits").glob("1*"):  # as if it had failed after the batch was written
        commit.unlink()
    for crc in (tmp_path / "cp" / "commits").glob(".1*"):
        crc.unlink()
    run()
    got = spark.read.parquet(history).groupBy("status_value").sum("rcd_count").collect()
    assert {r[0]: r[1] for r in got} == {"a": 2, "b": 1}


def test_jdbc_table(spark):
    url = "jdbc:derby:memory:siltbed;create=true"
    spark.range(5).select(F.col("id").cast("int").alias("K"), F.lit("x").alias("S")).write.jdbc(url, "NUMBERS", mode="overwrite", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    read = ingest.read_table(spark, url, "NUMBERS", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").where("K > 2").select("K")
    assert sorted(r.K for r in read.collect()) == [3, 4]
    assert "PushedFilters: [*IsNotNull(K), *GreaterThan(K,2)]" in read._jdf.queryExecution().toString()


def test_requests(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, s string")
    ask = lambda **r: records.respond(spark, {"request_type": "db_opr", "resource_name": "t", **r}, {"t": df})
    assert [tuple(r) for r in ask(action="query", conditions=[("k", ">", "1")], resource_info=["s"]).collect()] == [("b",)]
    assert records.json_rows(df.limit(0)).count() == 0
    for bad in ({"action": "drop"}, {"action": "query", "resource_name": "u"}, {"action": "query", "request_type": "x"}):
        with pytest.raises(ValueError):
            ask(**bad)
