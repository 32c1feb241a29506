"""Operator 2: URL rules by a sort-merge range join, in built-in functions only.

A host is written with its labels reversed and a closing dot (www.example.com: com.example.www.), so a rule host
and all its subdomains are one interval of keys; the rules of one host are intervals of paths. Urls and rules are
sorted together into ranges and swept twice: along hosts, for the rule hosts that a url's host lies in, and along
(rule host, path), for the longest path of each. When a rule is opened, the rules it is nested in are those whose keys
its own begins with, and they are stored with it: that is the stack. Entries whose key no longer begins the current
one are passed and count as popped. Of all rules that begin a key, the last one opened before it has all in its stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.llm.common import ascii_lower, cut, table

#: Fixed values of the contract: host, path, action.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def nested(rules: DataFrame) -> DataFrame:
    """rules (place, key, action) with stack: key and action of each rule of the place that the key begins with, itself too."""
    rules = cut(rules)
    begins = rules.select("place", "key", F.explode(F.sequence(F.lit(0), F.length("key"))).alias("n")).select("place", "key", F.substring("key", F.lit(1), F.col("n")).alias("outer"))
    outer = rules.select("place", F.col("key").alias("outer"), "action")
    return begins.join(outer, ["place", "outer"]).groupBy("place", "key").agg(F.collect_list(F.struct(F.col("outer").alias("key"), "action")).alias("stack"))


def sweep(points: DataFrame, rules: DataFrame) -> DataFrame:
    """points (place, key and others) with live: the entries (key, action) of nested rules (place, key, stack) that begin its key.

    Points are dealt out by (place, key, hash), so a key with a third of all rows spreads over many ranges. What is
    carried into a range is one row per range, and each range is swept by a window that spills.
    """
    point = F.struct(*[c for c in points.columns if c not in ("place", "key")])
    events = points.select("place", "key", F.lit(1).alias("kind"), F.xxhash64("key", point).alias("salt"), point.alias("point"))
    events = events.unionByName(rules.select("place", "key", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("salt"), "stack"), allowMissingColumns=True)
    order = ["place", "key", "kind", "salt"]
    ranges = cut(events.repartitionByRange(*order).withColumn("block", F.spark_partition_id()))
    opened = F.when(F.col("kind") == 0, F.struct("place", "stack"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.groupBy("block").agg(F.max_by(opened, F.when(F.col("kind") == 0, F.struct("place", "key"))).alias("last"))
    carried = carried.select("block", F.last("last", ignorenulls=True).over(before).alias("carried"))
    along = Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ranges.withColumn("last", F.last(opened, ignorenulls=True).over(along)).where("kind = 1")
    swept = swept.join(F.broadcast(carried), "block").withColumn("last", F.coalesce("last", "carried"))  # a row per range: as many as shuffle partitions
    stack = F.when(F.col("last.place") == F.col("place"), F.col("last.stack"))
    live = F.filter(F.coalesce(stack, F.array().cast(rules.schema["stack"].dataType)), lambda r: F.startswith(F.col("key"), r["key"]))
    return swept.select("place", "key", "point.*", live.alias("live"))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict for every row of pages; rules has host, path and action.

    The longest rule that fits wins; of equal rules block wins. Without a fitting rule the verdict is default. Rules
    with a null field or an empty host are ignored; a rule's host is lower-cased. A null url, or one without ://, has
    an empty host and path. Repeated rows are judged each on its own, null ids stay; other columns are dropped.
    Empty pages give an empty table; empty rules give default verdicts. A url is swept once for each rule host that
    its host lies in, as many as it has labels at most.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    known = rules.select(ascii_lower("host").alias("place"), F.col("path").alias("key"), "action")
    known = cut(known.where("place <> '' AND key IS NOT NULL AND action IS NOT NULL").groupBy("place", "key").agg(F.max("action").alias("action")))
    hosts = known.select("place").distinct().select(F.lit("").alias("place"), host_key(F.col("place")).alias("key"), F.col("place").alias("action"))

    found = sweep(urls.select(F.lit("").alias("place"), host_key(F.col("host")).alias("key"), "page_id", "host", "path", F.monotonically_increasing_id().alias("row")), nested(hosts))
    found = cut(found.select("page_id", "host", "path", "row", F.transform("live", lambda h: h["action"]).alias("places")))
    each = found.select("page_id", "host", F.col("path").alias("key"), "row", F.explode("places").alias("place"))
    rule = F.transform("live", lambda r: F.struct((F.length("place") + F.length(r["key"])).alias("n"), r["action"].alias("action"), F.concat("place", r["key"]).alias("rule")))
    judged = sweep(each, nested(known)).select("page_id", "host", F.col("key").alias("path"), "row", F.array_max(rule).alias("best"))
    rest = found.where("size(places) = 0").select("page_id", "host", "path", "row")
    # a page's rows agree in all but the rule
    out = judged.unionByName(rest, allowMissingColumns=True).groupBy("row").agg(*[F.first(c).alias(c) for c in ("page_id", "host", "path")], F.max("best").alias("best"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, action string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


_VALUES = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
OP2_SQL = f"""
WITH r(h, p, action) AS (VALUES {_VALUES}),
u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
      FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
"""
