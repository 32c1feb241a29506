"""Registered queries on stores that keep what is written to them: edits, requests, uploads against a store of names."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltbed.functions.scalars import is_name
from siltbed.plans.queries import _query, _table
from siltbed.session import scratch_folder
from siltbed.sources import edits, ingest, names, pages

# ---------------------------------------------------------------- edits


@_query("""WITH d AS (SELECT doc_id, lang, source, n_chars FROM documents UNION ALL SELECT doc_id + 100000000, 'copy', source, NULL FROM documents WHERE lang = 'de')
SELECT doc_id, CASE WHEN lang = 'copy' AND source = 'src1' THEN 'again' ELSE lang END AS lang, CASE WHEN n_chars > 5000 THEN 'long' WHEN lang = 'fr' THEN 'moved' ELSE source END AS source,
CASE WHEN lang = 'es' THEN -1 ELSE n_chars END AS n_chars, CASE WHEN lang = 'es' THEN 'deleted' END AS status FROM d WHERE NOT coalesce(lang = 'en' AND n_chars < 500, false)""")
def documents_edited(spark, sf_dir):
    """Inserts, two updates of some of the same rows, soft deletions and deletions in batches, one of them repeated, with a compaction in between."""
    d = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").withColumn("status", F.lit(None).cast("string"))
    table = edits.EditedTable.create(d, scratch_folder(spark), "doc_id")
    table.insert(d.where("lang = 'de'").select((F.col("doc_id") + 100_000_000).alias("doc_id"), F.lit("copy").alias("lang"), "source"), 0)
    moved = d.where("lang = 'fr' OR n_chars > 5000").select("doc_id", F.when(F.col("n_chars") > 5000, "long").otherwise("moved").alias("source"))
    again = moved.select("doc_id", F.lit("overtaken").alias("source"), F.lit(0).alias("at")).unionByName(moved.withColumn("at", F.lit(1)))
    table.update(again, 1, "at")
    table.update(again, 1, "at")
    table.update(table.read().where("lang = 'copy' AND source = 'src1'").select("doc_id", F.lit("again").alias("lang")), 2)
    table.compact()
    table.delete(d.where("lang = 'es'"), 3, {"status": "deleted"})
    table.update(d.where("lang = 'es'").select("doc_id", F.lit(-1).alias("n_chars")), 4)
    table.delete(d.where("lang = 'en' AND n_chars < 500"), 5)
    return table.read()


@_query("""SELECT c_custkey, c_name, CASE WHEN c_nationkey IN (3, 7) THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT -1, 'nobody', NULL, 99""")
def requests_stored(spark, sf_dir):
    """An insert, an update by IN and a deletion, asked for as requests, with the table read back."""
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal")
    table = edits.EditedTable.create(c, scratch_folder(spark), "c_custkey")
    ask = lambda action, batch=0, **more: edits.serve(table, {"request_type": "db_opr", "action": action, **more}, batch)
    ask("insert", 0, resource_info=[{"c_custkey": -1, "c_name": "nobody", "c_nationkey": 99}])
    ask("update", 1, conditions=[("c_nationkey", "=", "3", "OR"), ("c_nationkey", "=", "7", "OR")], resource_info={"c_mktsegment": "MOVED"})
    ask("delete", 2, conditions=[("c_acctbal", "<", "0")])
    return ask("query", resource_info=["c_custkey", "c_name", "c_mktsegment", "c_nationkey"])


# ---------------------------------------------------------------- uploads

_UPLOAD = "u AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'hot' WHEN doc_id % 11 = 0 THEN 'no name!' ELSE 'name_' || (doc_id - doc_id % 2) END AS name FROM documents), k AS (SELECT 'name_' || doc_id AS name FROM documents WHERE lang = 'de')"
_OUTCOMES = f"""{_UPLOAD}, f AS (SELECT name, min(doc_id) AS doc_id FROM u WHERE name <> 'no name!' AND name NOT IN (SELECT name FROM k) GROUP BY name)
SELECT doc_id, CASE WHEN u.name = 'no name!' THEN 'error' WHEN f.doc_id IS NOT NULL THEN 'created' ELSE 'duplicate' END AS outcome FROM u LEFT JOIN f USING (doc_id)"""


@_query(f"WITH {_OUTCOMES}")
def upload_outcomes(spark, sf_dir):
    """An upload in which one name has a third of the rows, against a store of names in two batches."""
    d = _table(spark, sf_dir, "documents")
    own = F.concat(F.lit("name_"), F.col("doc_id").cast("string"))
    known = d.where("lang = 'de'").select(own.alias("name"), F.length("text").alias("n"))
    store = names.NameStore(spark, scratch_folder(spark), max(1, d.count()))
    store.add(known.where("n < 2000"), 0)
    store.add(known.where("n >= 2000"), 1)
    i = F.col("doc_id")
    name = F.when(i % 3 == 0, "hot").when(i % 11 == 0, "no name!").otherwise(F.concat(F.lit("name_"), (i - i % 2).cast("string")))
    return ingest.check(d.select("doc_id", name.alias("name")), {"name has other characters": is_name(F.col("name"))}, "name", "doc_id", store).select("doc_id", "outcome")


# ---------------------------------------------------------------- pages


@_query("SELECT doc_id, lang, source, n_chars, text IS NULL AS untold, sha256(coalesce(text, '')) AS digest, doc_id >= 100 AND doc_id < 140 AS wanted FROM documents")
def documents_paged(spark, sf_dir):
    """Whole documents written to pages of JSON and read back, with those of a range looked up by a filter that skips pages."""
    at, d = scratch_folder(spark), _table(spark, sf_dir, "documents")
    pages.export(d.select("doc_id", "lang", "source", "n_chars", "text"), at, "doc_id", 100)
    kinds = "doc_id long, lang string, source string, n_chars long, text string"
    some = pages.read_pages(spark, at, kinds).where("doc_id >= 100 AND doc_id < 140").select("doc_id", F.lit(True).alias("found"))
    rows = pages.read_pages(spark, at, kinds).join(some, "doc_id", "left")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest")
    return rows.select("doc_id", "lang", "source", "n_chars", F.col("text").isNull().alias("untold"), digest, F.coalesce("found", F.lit(False)).alias("wanted"))
