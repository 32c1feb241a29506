"""Registered queries that look rows up: incremental snapshots, as-of alignment, facets, rank directories, substrings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.operators import asof, charts, grid, ranks, substring
from siltbed.plans.queries import _query, _table
from siltbed.session import scratch_folder
from siltbed.streaming import changes

# ---------------------------------------------------------------- keyed incremental snapshots

_LATEST = "last AS (SELECT event_type, CASE WHEN value >= 20 THEN 'high' ELSE 'low' END AS band FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"


@_query(f"WITH {_LATEST} SELECT 'event_type' AS status_name, event_type AS status_value, count(*) AS rcd_count FROM last GROUP BY event_type UNION ALL SELECT 'band', band, count(*) FROM last GROUP BY band")
def snapshot_incremental(spark, sf_dir):
    """Users by the kind and band of their last event, kept by a stream of many batches out of order, stopped halfway and gone on with."""
    at = scratch_folder(spark)
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", F.when(F.col("value") >= 20, "high").otherwise("low").alias("band"))
    keys, n = e.agg(F.approx_count_distinct("user_id"), F.count("*")).first()
    parts = e.withColumn("half", F.xxhash64("event_id") > 0)
    for i, half in enumerate((True, False), 1):
        parts.where(F.col("half") == half).drop("half").repartition(3 * (1 + n // 500_000), "event_id").write.mode("append").parquet(f"{at}/in")
        files = len(spark.read.schema(e.schema).parquet(f"{at}/in").inputFiles())
        stream = changes.run_changes(spark, f"{at}/in", e.schema, "user_id", "ts", "event_id", ["event_type", "band"], f"{at}/out", f"{at}/checkpoint", files=-(-files // (3 * i)), partitions=8 + keys // 100_000)
        stream.awaitTermination()
    return changes.latest_counts(spark, f"{at}/out")


# ---------------------------------------------------------------- charts

_HOURLY = "h AS (SELECT event_type AS type, 's' || user_id % 7 AS status, date_trunc('hour', ts)::TIMESTAMP AS created_at, count(*) AS rcd_count FROM events GROUP BY ALL)"


@_query(f"""WITH {_HOURLY}, c AS (SELECT DISTINCT created_at FROM h), s AS (SELECT DISTINCT type, status FROM h), g AS (SELECT * FROM s, c)
SELECT g.type, g.status, g.created_at, h.rcd_count, h.created_at AS known_at FROM g ASOF LEFT JOIN h ON g.type = h.type AND g.status = h.status AND g.created_at >= h.created_at""")
def chart_asof(spark, sf_dir):
    """Every series at every time of any series, with the last value known, and since when, in place of 0."""
    e = _table(spark, sf_dir, "events")
    status = F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")).alias("status")
    h = e.groupBy(F.col("event_type").alias("type"), status, F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("created_at")).agg(F.count("*").alias("rcd_count"))
    return asof.asof(charts.every_time(h), h.withColumn("known_at", F.col("created_at")), ["type", "status"], "created_at", ["rcd_count", "known_at"])


@_query("SELECT p.event_id, p.user_id, v.event_id AS view_id, v.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts")
def events_asof(spark, sf_dir):
    """Each purchase with its user's last view before it."""
    e = _table(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return asof.asof(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", ["view_id", "view_value"]).drop("ts")


# ---------------------------------------------------------------- facets

_FACETS = {"o_orderstatus": "o_orderstatus = 'O'", "o_orderpriority": "o_orderpriority IN ('1-URGENT', '2-HIGH')", "year": "year >= 1995", "band": "band < 3", "customer": None}
_FACETS_SQL = "WITH o AS (SELECT *, date_part('year', o_orderdate) AS year, floor(o_totalprice / 100000)::BIGINT AS band, o_custkey % 10 AS customer FROM orders) " + " UNION ALL ".join(
    f"SELECT '{c}' AS facet, {c}::VARCHAR AS value, count(*) AS n FROM o WHERE {' AND '.join(f for k, f in _FACETS.items() if f and k != c)} GROUP BY 2" for c in _FACETS
)


@_query(_FACETS_SQL)
def facets_filtered(spark, sf_dir):
    """Five facets of orders, four of them filtered, each counted under the others' filters, in one scan."""
    band = F.floor(F.col("o_totalprice") / 100000).cast("long").alias("band")
    o = _table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("year"), band, (F.col("o_custkey") % 10).alias("customer"))
    return grid.cross_facets(o, {c: None if f is None else F.expr(f) for c, f in _FACETS.items()})


# ---------------------------------------------------------------- rank directories


@_query("SELECT doc_id, n_chars, number FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS number FROM documents) WHERE number BETWEEN 60 AND 89")
def page_seek(spark, sf_dir):
    """Page 2 of 30 of the longest documents, read from its ranges alone."""
    d = _table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return ranks.Directory.build(d, F.desc("n_chars"), "doc_id").page(2, 30)


@_query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM (SELECT *, percent_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS k FROM orders) WHERE k >= 0.25 AND k <= 0.75")
def percent_zoom(spark, sf_dir):
    """The middle half of each priority's orders by date, ties included."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate")
    return ranks.between_percents(o, "o_orderpriority", "o_orderdate", 25, 75).drop("o_orderdate")


# ---------------------------------------------------------------- substring search

_PATTERNS = (("ThAnd", True), ("ciónñ", False), ("er", True), ("%", False), ("n_", False), ("is erb", True), ("on the", False), ("É", True), ("qqxz", True))


@_query(" UNION ALL ".join(f"SELECT '{p}' AS pattern, doc_id, lang FROM documents WHERE " + (f"contains(lower(text), '{p.lower()}')" if ci else f"contains(text, '{p}')") for p, ci in _PATTERNS))
def search_indexed(spark, sf_dir):
    """Documents by several patterns, on an index of two segments."""
    index, d = substring.Index(spark, scratch_folder(spark)), _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    first = F.xxhash64("doc_id") > 0
    index.add(d.where(first), 0)
    index.add(d.where(~first), 1)
    found = [index.search(p, ci).select(F.lit(p).alias("pattern"), "doc_id", "lang") for p, ci in _PATTERNS]
    return reduce(DataFrame.unionByName, found)
