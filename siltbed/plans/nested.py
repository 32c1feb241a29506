"""Registered queries on nested and timed rows: JSON text as variants, sessions, pyramids of summaries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from siltbed.operators import pyramid, variants
from siltbed.plans.queries import _query, _table
from siltbed.session import scratch_folder
from siltbed.streaming import sessions

# ---------------------------------------------------------------- variants

_PROPS = """p AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '{"k": ' WHEN 2 THEN '{"k": "' || event_type || '"}' WHEN 3 THEN '{"k": {"of": "' || event_type || '", "ids": [' || user_id || ', "' || event_id || '"]}}'
WHEN 4 THEN '{"k": null, "on": ' || (user_id % 2 = 0)::VARCHAR || '}' WHEN 5 THEN '[' || user_id || ', ' || event_id || ']' ELSE props END AS props FROM events)"""


def _props(spark, sf_dir):
    """The events' JSON text, some of it of other shapes, broken or missing."""
    i, kind, user = F.col("event_id"), F.col("event_type"), F.col("user_id").cast("string")
    text = F.when(i % 8 == 0, None).when(i % 8 == 1, '{"k": ').when(i % 8 == 2, F.concat(F.lit('{"k": "'), kind, F.lit('"}')))
    text = text.when(i % 8 == 3, F.concat(F.lit('{"k": {"of": "'), kind, F.lit('", "ids": ['), user, F.lit(', "'), i.cast("string"), F.lit('"]}}')))
    text = text.when(i % 8 == 4, F.concat(F.lit('{"k": null, "on": '), (F.col("user_id") % 2 == 0).cast("string"), F.lit("}")))
    text = text.when(i % 8 == 5, F.concat(F.lit("["), user, F.lit(", "), i.cast("string"), F.lit("]"))).otherwise(F.col("props"))
    return variants.parsed(_table(spark, sf_dir, "events").select("event_id", text.alias("props")), "props")


def _paths_sql() -> str:
    kind = lambda j: f"CASE json_type({j}) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END"
    fields = {"$": "$", "$.k": "$.k", "$.on": "$.on", "$.k.of": "$.k.of", "$.k.ids": "$.k.ids"}
    lists = {"$[*]": "$[*]", "$.k.ids[*]": "$.k.ids[*]"}
    some = [f"SELECT '{p}' AS path, json_extract(props, '{q}') AS j FROM ok" for p, q in fields.items()] + [f"SELECT '{p}', unnest(json_extract(props, '{q}')) FROM ok" for p, q in lists.items()]
    return f"WITH {_PROPS}, ok AS (SELECT props::JSON AS props FROM p WHERE json_valid(props)), j AS ({' UNION ALL '.join(some)}) SELECT path, {kind('j')} AS kind, count(*) AS n FROM j WHERE j IS NOT NULL GROUP BY ALL"


@_query(_paths_sql())
def variant_paths(spark, sf_dir):
    return variants.paths(_props(spark, sf_dir), "v")


@_query(f"""WITH {_PROPS}, t AS (SELECT event_id, props IS NOT NULL AND NOT json_valid(props) AS broken, CASE WHEN json_valid(props) THEN props END AS j FROM p)
SELECT event_id, broken, TRY_CAST(json_extract_string(j, '$.k') AS BIGINT) AS k, json_extract_string(j, '$.k.of') AS kind, TRY_CAST(json_extract_string(j, '$.k.ids[1]') AS BIGINT) AS id,
TRY_CAST(json_extract_string(j, '$.on') AS BOOLEAN) AS "on", TRY_CAST(json_extract_string(j, '$[0]') AS BIGINT) AS first FROM t""")
def variant_values(spark, sf_dir):
    fields = {"k": ("$.k", "bigint"), "kind": ("$.k.of", "string"), "id": ("$.k.ids[1]", "bigint"), "on": ("$.on", "boolean"), "first": ("$[0]", "bigint")}
    return variants.extracted(_props(spark, sf_dir), "v", fields).select("event_id", F.col("v_broken").alias("broken"), *fields)


# ---------------------------------------------------------------- sessions


@_query("""WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, count(*) FILTER (WHERE new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS "start", strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS "end", count(*) AS n, sum(round(value * 100))::BIGINT AS cents FROM s GROUP BY user_id, session""")
def event_sessions(spark, sf_dir):
    """Users' sessions from a stream of batches in which rows come up to an hour late."""
    at = scratch_folder(spark)
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    keys = e.agg(F.approx_count_distinct("user_id")).first()[0]
    e = e.withColumn("arrives", F.timestamp_seconds(F.unix_micros("ts") / 1e6 + F.pmod(F.xxhash64("event_id"), F.lit(3600))))
    ends = e.agg(F.min("arrives").alias("a"), F.max("arrives").alias("b")).select(F.unix_micros("a").alias("a"), F.unix_micros("b").alias("b")).first()
    part = F.floor((F.unix_micros("arrives") - ends.a) * 4 / (ends.b - ends.a + 1))
    last = spark.createDataFrame([(-1, None, None, 0)], e.drop("arrives").schema)
    last = last.withColumn("ts", F.timestamp_micros(F.lit(ends.b + 24 * 3600 * 10**6)))  # moves the watermark past all sessions
    for i in range(5):
        rows = e.where(part == i).drop("arrives").repartition(2, "event_id") if i < 4 else last.repartition(2)
        rows.write.mode("append").parquet(f"{at}/in")
    measures = [F.count("*").alias("n"), F.sum("cents").alias("cents")]
    sessions.run_sessions(spark, f"{at}/in", last.schema, "user_id", "ts", "6 hours", "2 hours", measures, f"{at}/out", f"{at}/checkpoint", 2, 8 + keys // 100_000).awaitTermination()
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return spark.read.parquet(f"{at}/out").where("user_id IS NOT NULL").select("user_id", text("start"), text("end"), "n", "cents")


# ---------------------------------------------------------------- pyramids

_RANGES = (("2024-01-03 10:17:00", "2024-01-20 23:05:00"), ("2024-01-01 00:00:00", "2024-02-01 00:00:00"), ("2024-01-05 07:30:00", "2024-01-05 08:10:00"), ("2024-01-09 00:00:00", "2024-01-10 00:00:00"))


@_query(" UNION ALL ".join(f"SELECT '{a}' AS since, event_type, user_id % 3 AS band, count(*) AS n, true AS near FROM events WHERE ts >= TIMESTAMP '{a}' AND ts < TIMESTAMP '{b}' GROUP BY ALL" for a, b in _RANGES))
def pyramid_ranges(spark, sf_dir):
    """Counts of ranges from summaries added in two batches, exact; distinct users and medians lie within their sketches' bounds."""
    e = _table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 3).alias("band"), "ts", "user_id", "value")
    cells = pyramid.Pyramid(spark, scratch_folder(spark), ["event_type", "band"])
    early = F.col("value") < 20
    cells.add(e.where(early), 0, "ts", "user_id", "value")
    cells.add(e.where(~early), 1, "ts", "user_id", "value")
    out = None
    for a, b in _RANGES:
        told = cells.summary(datetime.fromisoformat(a), datetime.fromisoformat(b), [0.5])
        rows = e.where((F.col("ts") >= F.lit(a).cast("timestamp_ntz")) & (F.col("ts") < F.lit(b).cast("timestamp_ntz"))).join(F.broadcast(told), ["event_type", "band"])
        least = rows.groupBy("event_type", "band", "n", "keys", "q50").agg(F.countDistinct("user_id").alias("users"), F.count_if(F.col("value") <= F.col("q50")).alias("below"), F.count_if(F.col("value") < F.col("q50")).alias("under"))
        near = (F.abs(F.col("keys") - F.col("users")) <= 0.05 * F.col("users") + 1) & (F.col("below") >= 0.46 * F.col("n")) & (F.col("under") <= 0.54 * F.col("n") + 1)
        part = least.select(F.lit(a).alias("since"), "event_type", "band", "n", near.alias("near"))
        out = part if out is None else out.unionByName(part)
    return out
