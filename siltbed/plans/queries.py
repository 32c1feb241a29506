"""The registered queries, each with its SQL where SQL can express it.

Tables of the driver stand in for the pipeline's own: documents with labels for the process table, events per day for the
status history, orders for sales.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions import predicates, scalars
from siltbed.functions.predicates import Condition, Group
from siltbed.operators import charts, documents, grid, knowledge, ranks, records, snapshot
from siltbed.schemas import DOCUMENTS, PROCESS_FILE, PROCESS_STATUS, SCHEDULES, STATUS_COLUMNS
from siltbed.session import scratch_folder
from siltbed.sources import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- stand-ins


def process_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    known = {
        "id": F.col("doc_id"), "std_name": F.col("text"), "std_no": F.col("lang"), "rel_file_path": F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")),
        "status": F.col("source"), "data_proc_status": F.col("quality").cast("string"), "chunk_proc_status": F.col("toxic").cast("string"),
    }
    return d.select(*[known.get(c, F.lit(None).cast("string")).alias(c) for c in PROCESS_FILE])


_KNOWN = {"id": "doc_id", "std_name": "text", "std_no": "lang", "rel_file_path": "'/' || source || '/' || doc_id", "status": "source", "data_proc_status": "quality::VARCHAR", "chunk_proc_status": "toxic::VARCHAR"}
_FILES = "files AS (SELECT " + ", ".join(f"{_KNOWN.get(c, 'NULL::VARCHAR')} AS {c}" for c in PROCESS_FILE) + " FROM documents LEFT JOIN labels USING (doc_id))"
_GRID = ", ".join(f"id::VARCHAR AS {v}" if k == "id" else f"coalesce({k}::VARCHAR, '') AS {v}" for k, v in PROCESS_FILE.items())


def _grid_sql(where: str, limit: int = 100) -> str:
    return f"WITH {_FILES} SELECT {_GRID} FROM (SELECT * FROM files WHERE {where} ORDER BY id LIMIT {limit})"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """type, status, created_at, rcd_count: events of each kind per day, told apart by whether the user's number is even."""
    e = _table(spark, sf_dir, "events")
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("created_at")
    status = F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("status")
    return e.groupBy(F.col("event_type").alias("type"), status, day).agg(F.count("*").alias("rcd_count"))


_HISTORY = "h AS (SELECT event_type AS type, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS status, date_trunc('day', ts)::TIMESTAMP AS created_at, count(*) AS rcd_count FROM events GROUP BY ALL)"


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("order_datetime"), F.col("o_totalprice").alias("sales"), F.col("o_orderpriority").alias("category"))


_SALES = "s AS (SELECT o_orderdate AS order_datetime, o_totalprice AS sales, o_orderpriority AS category FROM orders)"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("title"), (F.col("doc_id") % 5).cast("int").alias("x"), (F.col("n_chars") % 4).cast("int").alias("y"), (F.floor(F.col("doc_id") / 4) % 4).cast("int").alias("z"))


_NODES = "n AS (SELECT doc_id AS id, text AS title, (doc_id % 5)::INT AS x, (n_chars % 4)::INT AS y, ((doc_id // 4) % 4)::INT AS z FROM documents)"


def levels(spark: SparkSession) -> DataFrame:
    return spark.range(12).select(
        F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (F.floor(F.col("id") / 4) + 1).cast("int")).alias("axis"), (F.col("id") % 4).cast("int").alias("idx"),
        F.concat(F.lit("level "), F.col("id").cast("string")).alias("name"),
    )


_LEVELS = "l AS (SELECT ['x', 'y', 'z'][(i // 4 + 1)::INT] AS axis, (i % 4)::INT AS idx, 'level ' || i AS name FROM range(12) t(i))"


# ---------------------------------------------------------------- snapshots


@_query(
    f"WITH {_FILES} SELECT status_name, coalesce(v, 'null') AS status_value, count(*) AS rcd_count, 'daily' AS tags FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS status_name, {c} AS v FROM files" for c in STATUS_COLUMNS)
    + ") GROUP BY 1, 2"
)
def snapshot_counts(spark, sf_dir):
    return snapshot.status_counts(process_files(spark, sf_dir), STATUS_COLUMNS, "daily")


@_query("SELECT 'l_returnflag' AS status_name, l_returnflag AS status_value, count(*) AS rcd_count, 'lines' AS tags FROM lineitem GROUP BY l_returnflag UNION ALL SELECT 'l_linestatus', l_linestatus, count(*), 'lines' FROM lineitem GROUP BY l_linestatus")
def snapshot_lineitem(spark, sf_dir):
    return snapshot.status_counts(_table(spark, sf_dir, "lineitem"), ("l_returnflag", "l_linestatus"), "lines")


@_query("SELECT o_orderstatus, count(*) AS rcd_count FROM orders GROUP BY o_orderstatus")
def status_histogram(spark, sf_dir):
    return _table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("rcd_count"))


@_query("SELECT status_name, CASE WHEN status_value = '' THEN 'empty' ELSE status_value END AS status_value, created_at, rcd_count FROM (SELECT event_type AS status_name, CASE WHEN user_id % 3 = 0 THEN '' ELSE 'u' || user_id % 3 END AS status_value, date_trunc('hour', ts)::TIMESTAMP AS created_at, count(*) AS rcd_count FROM events GROUP BY ALL) ORDER BY created_at DESC, status_name, status_value LIMIT 3000")
def topn_latest(spark, sf_dir):
    status = F.when(F.col("user_id") % 3 == 0, "").otherwise(F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")))
    h = _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status_name"), status.alias("status_value"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("created_at"))
    return snapshot.read_history(h.agg(F.count("*").alias("rcd_count"))).select("status_name", "status_value", "created_at", "rcd_count")


# ---------------------------------------------------------------- grid

_C = Condition
_GRIDS = {
    "grid_eq": ([_C("doc_num", "=", "fr")], "std_no = 'fr'"),
    "grid_ne": ([_C("data_proc_status", "<>", "1")], "data_proc_status <> '1'"),
    "grid_range": ([_C("record_uuid", ">=", "100"), _C("record_uuid", "<", " 180 ")], "id >= 100 AND id < 180"),
    "grid_contain": ([_C("doc_name", "contain", "the ")], "contains(std_name, 'the')"),
    "grid_prefix": ([_C("file_url", "prefix", "/src1/")], "starts_with(rel_file_path, '/src1/')"),
    "grid_and_or": (
        [_C("status", "=", "src0", "OR"), _C("doc_num", "=", "de", "OR"), _C("data_proc_status", "=", "1", "AND"), _C("status", "=", "  ", "AND")],
        "status = 'src0' OR (std_no = 'de' AND data_proc_status = '1')",
    ),
    "grid_alias_filter": ([_C("doc_name", ">", "T"), _C("doc_num", "!=", "en")], "std_name > 'T' AND std_no <> 'en'"),
    "grid_null_default": ([], "true"),
    "grid_quote": ([_C("doc_name", "<>", "it's 100%_")], "std_name <> 'it''s 100%_'"),
    "grid_uncastable": ([_C("record_uuid", "=", "abc", "AND"), _C("record_uuid", "=", "7", "OR")], "id = 7"),
    "grid_tree": (
        Group("AND", (_C("record_uuid", "between", "10", "AND", "400"), Group("OR", (_C("doc_num", "=", "es"), _C("chunk_proc_status", "=", "1"))))),
        "id BETWEEN 10 AND 400 AND (std_no = 'es' OR chunk_proc_status = '1')",
    ),
}


def _add_grid(name: str, conditions, where: str) -> None:
    def run(spark, sf_dir):
        return grid.grid(process_files(spark, sf_dir), conditions)

    QUERIES[name], SQL[name] = run, _grid_sql(where)


for _name, (_conditions, _where) in _GRIDS.items():
    _add_grid(_name, _conditions, _where)


@_query(_grid_sql("lower(std_name) LIKE '%the%'"))
def grid_ci(spark, sf_dir):
    return grid.grid(process_files(spark, sf_dir), [_C("doc_name", "contain", "THE")], ci=True)


@_query(_grid_sql("id >= 100 AND id < 120"))
def grid_ci_range(spark, sf_dir):
    return grid.grid(process_files(spark, sf_dir), [_C("record_uuid", ">=", "100"), _C("record_uuid", "<", "120")], ci=True)


@_query(_grid_sql("lower(std_name) BETWEEN 'b' AND 'td'"))
def grid_ci_between(spark, sf_dir):
    return grid.grid(process_files(spark, sf_dir), [_C("doc_name", "between", "B", "AND", "Td")], ci=True)


@_query(_grid_sql("std_name LIKE '%the%' AND NOT contains(std_name, '\\')"))
def grid_like(spark, sf_dir):
    files = process_files(spark, sf_dir)
    return grid.grid(files.where(~predicates.chain(files, [_C("std_name", "LIKE", "%\\")])), [_C("doc_name", "LIKE", "%the%")])


@_query(_grid_sql("std_no = 'es' AND status = 'src0'"))
def grid_tree_blanks(spark, sf_dir):
    blank = _C("doc_name", "=", "  ")
    return grid.grid(process_files(spark, sf_dir), Group("AND", (_C("doc_num", "=", " es "), blank, Group("OR", (_C("status", "=", "src0 "), blank)))))


@_query(_grid_sql("std_no = 'fr'"))
def grid_edited(spark, sf_dir):
    edited = predicates.Conditions().add(_C("status", "=", "src1")).reset().add(_C("doc_num", "=", "fr")).add(_C("doc_num", "=", "de")).remove(1)
    return grid.grid(process_files(spark, sf_dir), edited.items)


@_query("SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 10 OFFSET 30")
def page_n(spark, sf_dir):
    return grid.page(_table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), 3, 10, ["doc_id"])


@_query("SELECT count(*) AS row_count, ceil(count(*) / 20.0)::BIGINT AS pages FROM orders")
def page_count(spark, sf_dir):
    return grid.page_count(_table(spark, sf_dir, "orders"), 20)


@_query("SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def facet_counts(spark, sf_dir):
    return grid.facets(_table(spark, sf_dir, "documents"), "lang", "source")


@_query("SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'thand') AND lang = 'en' AND contains(doc_id::VARCHAR, '1')")
def search_ci(spark, sf_dir):
    return grid.search(_table(spark, sf_dir, "documents"), {"text": "ThAnd", "source": ""}, {"lang": "en"}, {"doc_id": "1"}).select("doc_id", "lang", "source")


@_query("SELECT event_id, event_type, ts FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' AND contains(ts::VARCHAR, '-01-2')")
def search_since(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return grid.search(e, within={"ts": "-01-2"}, since={"ts": "2024-01-20 00:00:00"})


@_query("SELECT count(*) AS total, count(*) FILTER (WHERE doc_id % 3 = 0) AS selected FROM documents")
def selected_count(spark, sf_dir):
    return _table(spark, sf_dir, "documents").agg(F.count("*").alias("total"), F.count_if(F.col("doc_id") % 3 == 0).alias("selected"))


@_query("SELECT doc_id, lang FROM documents WHERE doc_id IN (1, 5, 9) ORDER BY doc_id")
def select_rows(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where(F.col("doc_id").isin(1, 5, 9)).select("doc_id", "lang")


@_query("SELECT doc_id, lang FROM documents WHERE doc_id <> 5")
def remove_row(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where(F.col("doc_id") != 5).select("doc_id", "lang")


@_query("WITH d AS (SELECT doc_id, n_chars, text || CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE '' END AS doc_name FROM documents) SELECT *, doc_name IS DISTINCT FROM trim(doc_name) AS modified FROM d")
def detail_modified(spark, sf_dir):
    name = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " ").otherwise(""))
    return _table(spark, sf_dir, "documents").select("doc_id", "n_chars", name.alias("doc_name"), (~name.eqNullSafe(F.trim(name))).alias("modified"))


# ---------------------------------------------------------------- sales report


@_query(f"WITH {_SALES} SELECT category FROM s GROUP BY category")
def bi_categories(spark, sf_dir):
    return sales(spark, sf_dir).select("category").distinct()


@_query(f"WITH {_SALES} SELECT * FROM s")
def bi_orders(spark, sf_dir):
    return sales(spark, sf_dir)


@_query(f"WITH {_SALES} SELECT date_trunc('month', order_datetime)::TIMESTAMP AS month, round(sum(sales), 2) AS sales_usd, category FROM s WHERE category LIKE '%' AND date_part('year', order_datetime)::VARCHAR LIKE '199%' GROUP BY ALL ORDER BY sales_usd DESC")
def bi_monthly_sales(spark, sf_dir):
    return spark.sql(
        "SELECT CAST(date_trunc('month', order_datetime) AS TIMESTAMP_NTZ) AS month, round(sum(sales), 2) AS sales_usd, category FROM {s} "
        "WHERE category LIKE :category AND CAST(date_part('year', order_datetime) AS STRING) LIKE :year GROUP BY ALL ORDER BY sales_usd DESC",
        args={"category": "%", "year": "199%"}, s=sales(spark, sf_dir),
    )


# ---------------------------------------------------------------- charts


@_query(f"WITH {_HISTORY} SELECT type, status, list(rcd_count ORDER BY created_at DESC) AS data FROM h GROUP BY type, status")
def chart_series(spark, sf_dir):
    return charts.series(history(spark, sf_dir))


@_query(f"WITH {_HISTORY}, d AS (SELECT DISTINCT type, created_at FROM h) SELECT type, list(strftime(created_at, '%Y-%m-%d %H:%M:%S') ORDER BY created_at DESC) AS categories FROM d GROUP BY type")
def chart_categories(spark, sf_dir):
    return charts.categories(history(spark, sf_dir))


@_query(f"WITH {_HISTORY} SELECT type, created_at, coalesce(sum(rcd_count) FILTER (WHERE status = 'even'), 0)::BIGINT AS even, coalesce(sum(rcd_count) FILTER (WHERE status = 'odd'), 0)::BIGINT AS odd FROM h GROUP BY type, created_at")
def chart_aligned(spark, sf_dir):
    return charts.aligned(history(spark, sf_dir), ["even", "odd"])


@_query(f"WITH {_HISTORY} SELECT * FROM h WHERE created_at::DATE >= DATE '2024-01-30' - 7")
def chart_last_n_days(spark, sf_dir):
    return charts.last_days(history(spark, sf_dir), "created_at", 7, "2024-01-30")


@_query(f"WITH {_HISTORY}, p AS (SELECT created_at, type, sum(rcd_count)::BIGINT AS n FROM h GROUP BY ALL), t AS (SELECT *, (sum(n) OVER (PARTITION BY created_at ORDER BY type))::BIGINT AS top FROM p) SELECT created_at, type, n, top - n AS base, top FROM t")
def chart_stacked(spark, sf_dir):
    per = history(spark, sf_dir).groupBy("created_at", "type").agg(F.sum("rcd_count").alias("n"))
    return charts.stacked(per, "created_at", "type", "n")


@_query(f"WITH {_HISTORY}, p AS (SELECT type, created_at, sum(rcd_count)::BIGINT AS n FROM h GROUP BY ALL), r AS (SELECT *, percent_rank() OVER (PARTITION BY type ORDER BY created_at) AS k FROM p) SELECT type, created_at, n FROM r WHERE k <= 0.5")
def chart_zoom(spark, sf_dir):
    per = history(spark, sf_dir).groupBy("type", "created_at").agg(F.sum("rcd_count").alias("n"))
    return charts.zoom(per, "type", "created_at", 0, 50)


@_query(f"WITH {_HISTORY} SELECT count(*) AS num_records FROM h")
def chart_row_count(spark, sf_dir):
    return history(spark, sf_dir).agg(F.count("*").alias("num_records"))


@_query("""WITH RECURSIVE p AS (SELECT event_type, epoch_us(ts)::DOUBLE AS t, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, value) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS total FROM events),
b AS (SELECT *, CASE WHEN place = 0 THEN 0 WHEN place = total - 1 THEN 199 ELSE (place * 198 - 1) // (total - 2) + 1 END AS bucket FROM p WHERE total > 200),
m AS (SELECT event_type, bucket, avg(t) AS ct, avg(value) AS cv FROM b GROUP BY ALL),
walk AS (SELECT event_type, bucket, t, value FROM b WHERE bucket = 0 UNION ALL SELECT * FROM (SELECT b.event_type, b.bucket, b.t, b.value FROM walk w JOIN b ON b.event_type = w.event_type AND b.bucket = w.bucket + 1
LEFT JOIN m ON m.event_type = w.event_type AND m.bucket = w.bucket + 2 QUALIFY row_number() OVER (PARTITION BY b.event_type ORDER BY abs((w.t - m.ct) * (b.value - w.value) - (w.t - b.t) * (m.cv - w.value)) DESC, b.t, b.value) = 1))
SELECT event_type, t, value FROM walk UNION ALL SELECT event_type, t, value FROM p WHERE total <= 200""")
def chart_downsampled(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t"), "value")
    return charts.downsample(e, "event_type", "t", "value", 200)


@_query("WITH s AS (SELECT event_id, ts, ('0x' || left(md5('42:' || event_id), 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM events) SELECT event_id, DATE '1968-10-04' + event_id::INT AS day, (sum(CASE WHEN event_id = 0 THEN floor(u * 300) ELSE floor((u - 0.5) * 20 + 0.5) END) OVER (ORDER BY ts, event_id))::BIGINT AS v FROM s")
def random_walk(spark, sf_dir):
    """A step for each event, in their order."""
    return charts.random_walk(_table(spark, sf_dir, "events").select("event_id", "ts"), "event_id", 42, "ts", "event_id").select("event_id", "day", "v")


@_query("SELECT event_id, user_id, (sum(CASE WHEN event_type = 'purchase' THEN round(value * 100) ELSE 0 END) OVER (ORDER BY ts, event_id))::BIGINT AS total FROM events")
def running_total(spark, sf_dir):
    """Purchases so far, in cents, at each event."""
    cents = F.when(F.col("event_type") == "purchase", F.round(F.col("value") * 100)).otherwise(0).cast("long").alias("cents")
    return ranks.running_sum(_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", cents), "cents", "ts", "event_id").select("event_id", "user_id", "total")


# ---------------------------------------------------------------- catalogue


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values) -> str:
    return f"{_list(values)}[(i % {len(values)} + 1)::INT]"


_GENERATED = f"""g AS (SELECT i + 1 AS doc_id, {_pick(documents.NAMES)} || CASE WHEN i < 24 THEN '' ELSE ' v' || (i // 24 + 1) END AS doc_name,
(10000 + i * 137 % 90000) || '_' || (2020 + i % 5) || ':' || (1 + i % 5) AS doc_no, {_pick(documents.DESCRIPTIONS)} AS doc_desc,
'This document contains ' || {_pick(documents.NAMES)} || ' with detailed information and guidelines.' AS doc_summary, {_pick(documents.KEYWORDS)} AS doc_keywords,
{_pick(documents.TAGS)} AS doc_tags, 'https://storage.example.com/documents/' || (i + 1) || '.pdf' AS file_url, 'https://storage.example.com/thumbnails/' || (i + 1) || '.png' AS image_url,
{_pick(documents.TYPES)} AS doc_type, {_pick(documents.SOURCES)} AS doc_source, {_pick(documents.SCOPES)} AS doc_scope, {_pick(documents.STATUSES)} AS doc_status,
{_pick(documents.PROCESS)} AS process_status, NULL::TIMESTAMP AS created_at, NULL::TIMESTAMP AS updated_at FROM (SELECT doc_id AS i FROM documents))"""


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue row for each document."""
    return documents.generate(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))


@_query(f"WITH {_GENERATED} SELECT *, true AS user_id_ok FROM g")
def doc_generate(spark, sf_dir):
    form = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    return catalogue(spark, sf_dir).withColumn("user_id_ok", F.col("user_id").rlike(form)).drop("user_id")


@_query(f"WITH {_GENERATED} SELECT doc_id, doc_name, doc_type FROM g WHERE doc_type IN ('DOCX', 'PPTX') AND doc_name LIKE '%Guide%' AND doc_status <> 'deleted'")
def doc_query_in_like(spark, sf_dir):
    conditions = [_C("doc_type", "IN", ["DOCX", "PPTX"]), _C("doc_name", "LIKE", "%Guide%"), _C("doc_status", "!=", "deleted")]
    return documents.query(catalogue(spark, sf_dir), conditions).select("doc_id", "doc_name", "doc_type")


@_query(f"WITH {_GENERATED} SELECT * FROM (SELECT 25 AS most, doc_id, doc_name FROM g WHERE doc_id > 40 ORDER BY doc_id LIMIT 25) UNION ALL SELECT most, doc_id, doc_name FROM g, (VALUES (0), (-1)) v(most) WHERE doc_id > 40")
def doc_query_limit(spark, sf_dir):
    """With a limit, and with two that mean none."""
    some = [documents.query(catalogue(spark, sf_dir), [_C("doc_id", ">", "40")], n).select(F.lit(n).alias("most"), "doc_id", "doc_name") for n in (25, 0, -1)]
    return some[0].unionByName(some[1]).unionByName(some[2])


@_query(f"WITH {_GENERATED} SELECT doc_id, doc_name, doc_status, created_at IS NULL AS undated FROM (SELECT doc_id, doc_name, doc_status, created_at FROM g UNION ALL SELECT -1, 'New', 'active', TIMESTAMP '2024-01-01')")
def doc_insert(spark, sf_dir):
    row = spark.createDataFrame([(-1, "New", "active", "x", "PDF", "public", "uploaded")], "doc_id long, doc_name string, doc_status string, file_url string, doc_type string, doc_scope string, process_status string")
    out = documents.insert(catalogue(spark, sf_dir), row)
    return out.select("doc_id", "doc_name", "doc_status", F.col("created_at").isNull().alias("undated"))


@_query(f"WITH {_GENERATED} SELECT doc_id, CASE WHEN doc_id = 7 THEN 'deleted' ELSE doc_status END AS doc_status, doc_id = 7 AS stamped FROM g")
def doc_soft_delete(spark, sf_dir):
    out = documents.soft_delete(catalogue(spark, sf_dir), 7)
    return out.select("doc_id", "doc_status", F.col("updated_at").isNotNull().alias("stamped"))


@_query("SELECT i + 1 AS id, 'User ' || (i + 1) AS name, 'user' || (i + 1) || '@example.com' AS email, ['us', 'ca', 'uk', 'de', 'fr'][(i % 5 + 1)::INT] AS country, i % 3 <> 0 AS active FROM (SELECT c_custkey AS i FROM customer)")
def users_generate(spark, sf_dir):
    """A user for each customer."""
    i, n = F.col("c_custkey"), (F.col("c_custkey") + 1).cast("string")
    country = F.element_at(F.array(*[F.lit(c) for c in ("us", "ca", "uk", "de", "fr")]), (i % 5 + 1).cast("int"))
    return _table(spark, sf_dir, "customer").select((i + 1).alias("id"), F.concat(F.lit("User "), n).alias("name"), F.concat(F.lit("user"), n, F.lit("@example.com")).alias("email"), country.alias("country"), (i % 3 != 0).alias("active"))


# ---------------------------------------------------------------- cube


@_query(f"WITH {_NODES}, {_LEVELS}, c AS (SELECT x, y, count(*) AS n, arg_min(title, id) AS title FROM n GROUP BY x, y) SELECT a.idx AS x, b.idx AS y, a.name AS x_level, b.name AS y_level, coalesce(c.n, 0) AS n, c.title FROM l a JOIN l b ON a.axis = 'x' AND b.axis = 'y' LEFT JOIN c ON c.x = a.idx AND c.y = b.idx")
def cube_matrix(spark, sf_dir):
    return knowledge.matrix(nodes(spark, sf_dir), levels(spark))


@_query(f"WITH {_NODES}, {_LEVELS} SELECT id, title, x, y, z, a.name AS x_level, b.name AS y_level, c.name AS z_level FROM n LEFT JOIN l a ON a.axis = 'x' AND a.idx = x LEFT JOIN l b ON b.axis = 'y' AND b.idx = y LEFT JOIN l c ON c.axis = 'z' AND c.idx = z")
def cube_levels(spark, sf_dir):
    return knowledge.with_levels(nodes(spark, sf_dir), levels(spark))


@_query(f"WITH {_NODES} SELECT id, title FROM n WHERE x = 1 AND y = 2 AND z = 3")
def cube_cell(spark, sf_dir):
    return knowledge.cell(nodes(spark, sf_dir), 1, 2, 3).select("id", "title")


@_query(f"WITH {_NODES} SELECT id, coalesce({_list(knowledge.COLOURS)}[x + 1], '{knowledge.DEFAULT_COLOUR}') AS colour FROM n")
def cube_colours(spark, sf_dir):
    return nodes(spark, sf_dir).select("id", scalars.by_position(knowledge.COLOURS, F.col("x"), knowledge.DEFAULT_COLOUR).alias("colour"))


@_query("SELECT doc_id, lang FROM documents WHERE doc_id = 17 LIMIT 1")
def find_by_key(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where("doc_id = 17").limit(1).select("doc_id", "lang")


@_query(f"WITH {_GENERATED} SELECT doc_id, list_filter(list_transform(string_split(doc_tags || ', ,', ','), lambda x: trim(x)), lambda x: x <> '') AS tags, replace(doc_tags, ', ', ',') AS joined FROM g")
def tags_split(spark, sf_dir):
    tags = scalars.split_list(F.concat("doc_tags", F.lit(", ,")))
    return catalogue(spark, sf_dir).select("doc_id", tags.alias("tags"), F.array_join(tags, ",").alias("joined"))


@_query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ['de', 'fr'] ELSE ['de', 'fr', 'en'] END AS chosen FROM documents")
def selection_toggle(spark, sf_dir):
    start = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("de"), F.lit("en"), F.lit("fr"))).otherwise(F.array(F.lit("de"), F.lit("fr")))
    return _table(spark, sf_dir, "documents").select("doc_id", scalars.toggle(start, F.lit("en")).alias("chosen"))


# ---------------------------------------------------------------- rules and ingest

_PROMPTS = "p AS (SELECT doc_id, source AS prompt_name, CASE WHEN doc_id % 4 = 0 THEN text ELSE lang END AS prompt_desc, CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 9 < 5 THEN lang ELSE text END AS prompt_content, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN ' ' ELSE lang END AS creator FROM (SELECT doc_id, text, lang, CASE WHEN doc_id % 5 = 0 THEN source || '-x' ELSE source || '_' || doc_id // 300 END AS source FROM documents))"


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 5 == 0, F.concat("source", F.lit("-x"))).otherwise(F.concat("source", F.lit("_"), F.floor(F.col("doc_id") / 300).cast("string")))
    creator = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 11 == 0, " ").otherwise(F.col("lang"))
    content = F.when(F.col("doc_id") % 9 == 0, "").when(F.col("doc_id") % 9 < 5, F.col("lang")).otherwise(F.col("text"))
    return d.select("doc_id", name.alias("prompt_name"), F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(F.col("lang")).alias("prompt_desc"), content.alias("prompt_content"), creator.alias("creator"))


_RULES = """concat_ws('; ', CASE WHEN NOT regexp_full_match(prompt_name, '[a-zA-Z0-9_]+') THEN 'name has other characters' END,
CASE WHEN length(prompt_name) > 64 THEN 'name is too long' END, CASE WHEN length(coalesce(prompt_desc, '')) > 500 THEN 'description is too long' END,
CASE WHEN length(prompt_content) < 5 THEN 'content is too short' END, CASE WHEN creator IS NULL OR trim(creator) = '' THEN 'creator is required' END)"""
_CHECKED = f"""{_PROMPTS}, e AS (SELECT *, {_RULES} AS errors FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY prompt_name, errors <> '' ORDER BY doc_id) AS n FROM e),
c AS (SELECT doc_id, prompt_name, errors, CASE WHEN errors <> '' THEN 'error' WHEN n > 1 THEN 'duplicate' ELSE 'created' END AS outcome FROM k)"""


def _checked(spark, sf_dir):
    p = prompts(spark, sf_dir)
    rules = ingest.prompt_rules(*[F.col(c) for c in ("prompt_name", "prompt_desc", "prompt_content", "creator")])
    return ingest.check(p, rules, "prompt_name", "doc_id")


@_query(f"WITH {_CHECKED} SELECT doc_id, errors FROM c")
def rule_errors(spark, sf_dir):
    return _checked(spark, sf_dir).select("doc_id", "errors")


@_query(f"WITH {_CHECKED} SELECT doc_id, prompt_name, outcome FROM c")
def ingest_dedup(spark, sf_dir):
    return _checked(spark, sf_dir).select("doc_id", "prompt_name", "outcome")


@_query(f"WITH {_CHECKED} SELECT count(*) AS processed, count(*) FILTER (WHERE outcome = 'created') AS created, count(*) FILTER (WHERE outcome = 'error') AS errors, count(*) FILTER (WHERE outcome = 'duplicate') AS duplicates FROM c")
def ingest_counters(spark, sf_dir):
    return ingest.counters(_checked(spark, sf_dir))


@_query("SELECT user_id, length(event_type) >= 8 AS long_enough, event_type IS NOT DISTINCT FROM 'purchase' AS same FROM events")
def password_rules(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("user_id", (F.length("event_type") >= 8).alias("long_enough"), F.col("event_type").eqNullSafe("purchase").alias("same"))


@_query("SELECT day, strftime(t, '%H:%M') AS slot, ltrim(strftime(t, '%I:%M'), '0') || lower(strftime(t, ' %p')) AS label FROM (SELECT DISTINCT ts::DATE AS day FROM events), (SELECT unnest(range(TIMESTAMP '2024-01-01 08:30:00', TIMESTAMP '2024-01-01 11:30:00', INTERVAL 30 MINUTE)) AS t UNION ALL SELECT unnest(range(TIMESTAMP '2024-01-01 13:00:00', TIMESTAMP '2024-01-01 17:00:00', INTERVAL 30 MINUTE)))")
def slots(spark, sf_dir):
    """The slots of each day that has an event."""
    days = _table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()
    t = days.select("day", F.explode(scalars.day_slots(F.col("day"))).alias("t"))
    return t.select("day", F.date_format("t", "HH:mm").alias("slot"), F.lower(F.date_format("t", "h:mm a")).alias("label"))


@_query("WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS m FROM orders), d AS (SELECT m, unnest(range(m - (isodow(m) % 7)::INT, m - (isodow(m) % 7)::INT + 42, INTERVAL 1 DAY))::DATE AS day FROM m) SELECT m AS month, day, date_trunc('month', day)::DATE = m AS inside, isodow(day) IN (6, 7) AS weekend FROM d")
def month_grid(spark, sf_dir):
    m = _table(spark, sf_dir, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")).distinct()
    first = F.date_sub("month", F.dayofweek("month") - 1)
    d = m.select("month", F.explode(F.sequence(first, F.date_add(first, 41))).alias("day"))
    return d.select("month", "day", (F.trunc("day", "month") == F.col("month")).alias("inside"), F.dayofweek("day").isin(1, 7).alias("weekend"))


_SIZED = "(SELECT doc_id, times, n_chars * times AS size FROM documents, (VALUES (1), (1500), (1500000)) v(times))"


def _unit(power: int, name: str) -> str:
    return f"regexp_replace(round(size / {1024**power}.0, 2)::DOUBLE::VARCHAR, '\\.0$', '') || ' {name}'"


@_query(f"SELECT doc_id, times, CASE WHEN size = 0 THEN '0 Bytes' WHEN size < 1024 THEN size || ' Bytes' WHEN size < {1024**2} THEN {_unit(1, 'KB')} WHEN size < {1024**3} THEN {_unit(2, 'MB')} ELSE {_unit(3, 'GB')} END AS shown FROM {_SIZED}")
def file_size(spark, sf_dir):
    """The texts' lengths as sizes of bytes to gigabytes."""
    times = F.explode(F.array(*[F.lit(t) for t in (1, 1500, 1_500_000)])).alias("times")
    return _table(spark, sf_dir, "documents").select("doc_id", "n_chars", times).select("doc_id", "times", scalars.file_size(F.col("n_chars") * F.col("times")).alias("shown"))


@_query("SELECT doc_id, left(text, 100) || '...' AS shown, lower(string_split(source || '.' || lang, '.')[-1]) AS extension FROM documents")
def preview(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", scalars.preview(F.col("text")).alias("shown"), scalars.file_extension(F.concat("source", F.lit("."), "lang")).alias("extension"))


@_query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y/%-m/%-d') AS plain, strftime(ts, '%b %-d') AS short, strftime(ts, '%A, %b %-d, %Y') AS long FROM events")
def fmt_ts(spark, sf_dir):
    forms = {"stamp": "yyyy-MM-dd HH:mm:ss", "day": "yyyy-MM-dd", "plain": "yyyy/M/d", "short": "MMM d", "long": "EEEE, MMM d, yyyy"}
    return _table(spark, sf_dir, "events").select("event_id", *[F.date_format("ts", f).alias(c) for c, f in forms.items()])


@_query("SELECT o_orderkey, '£' || regexp_replace(format('{:,.3f}', o_totalprice), '\\.?0+$', '') AS price FROM orders")
def format_currency(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", scalars.currency(F.col("o_totalprice")).alias("price"))


@_query("SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS returned FROM lineitem")
def status_flag(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("returned"))


@_query("SELECT doc_id, lang FROM documents UNION ALL SELECT conv_id, role FROM conversations")
def append_records(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", "lang").unionByName(_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("lang")))


# ---------------------------------------------------------------- stores, requests and files


@_query("SELECT 'documents' AS table_name, 17 AS columns, count(*) AS row_count FROM documents UNION ALL SELECT 'process_status', 6, count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'schedules', 14, count(*) FROM orders")
def create_tables(spark, sf_dir):
    """Makes each table, fills it from a table of the driver, and makes it again, which changes nothing."""
    at, out, orders = scratch_folder(spark), None, _table(spark, sf_dir, "orders")
    counted = snapshot.status_counts(orders, ["o_orderstatus"], "daily").withColumn("id", F.monotonically_increasing_id())
    planned = orders.select(F.col("o_orderpriority").alias("event_name"), F.col("o_orderdate").cast("date").alias("schedule_date"), F.lit("a").alias("creator"), F.lit("a").alias("updater"))
    for name, schema, rows in (("documents", DOCUMENTS, catalogue(spark, sf_dir)), ("process_status", PROCESS_STATUS, counted), ("schedules", SCHEDULES, planned)):
        documents.create_if_absent(spark, f"{at}/{name}", schema)
        kinds = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        rows.select(*kinds).write.mode("append").parquet(f"{at}/{name}")
        documents.create_if_absent(spark, f"{at}/{name}", DOCUMENTS)
        made = spark.read.parquet(f"{at}/{name}")
        row = made.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), F.lit(len(made.columns)).alias("columns"), "row_count")
        out = row if out is None else out.unionByName(row)
    return out


@_query("SELECT o_orderstatus AS status_value, 2 * count(*) AS rcd_count, count(*) * 0 + 2 AS snapshots FROM orders GROUP BY o_orderstatus")
def snapshot_appended(spark, sf_dir):
    """Two snapshots of a table and one of an empty table, which adds nothing, read back from their history."""
    at, orders = scratch_folder(spark), _table(spark, sf_dir, "orders")
    for df in (orders, orders.limit(0), orders):
        snapshot.append_snapshot(df, ["o_orderstatus"], "daily", at)
    return spark.read.parquet(at).groupBy("status_value").agg(F.sum("rcd_count").alias("rcd_count"), F.count("*").alias("snapshots"))


@_query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def save_retrieve(spark, sf_dir):
    at, nation = scratch_folder(spark), _table(spark, sf_dir, "nation")
    records.save(nation, at)
    records.save(nation.where("n_regionkey = 1"), at)
    return records.retrieve(spark, at, ["n_nationkey", "n_name"])


@_query("SELECT '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"quality\":' || coalesce(quality::VARCHAR, 'null') || '}' AS row FROM documents LEFT JOIN labels USING (doc_id)")
def json_rows(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    return records.json_rows(d.select("doc_id", "lang", "quality"))


@_query(f"WITH {_GENERATED} SELECT doc_id, doc_name, doc_tags, doc_type FROM g ORDER BY doc_id LIMIT 1")
def json_template(spark, sf_dir):
    """The template of a catalogue record, written as a JSON file and read back."""
    at = scratch_folder(spark) + ".json"
    records.template(catalogue(spark, sf_dir).drop("user_id"), "doc_id").coalesce(1).write.text(at)
    return ingest.read(spark, at).select("doc_id", "doc_name", "doc_tags", "doc_type")


@_query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def ingest_json(spark, sf_dir):
    at = scratch_folder(spark) + ".json"
    whole = F.to_json(F.collect_list(F.struct("n_nationkey", "n_name")))  # an upload is one array of at most 10 MiB
    _table(spark, sf_dir, "nation").agg(whole).coalesce(1).write.text(at)
    return ingest.read(spark, at).select("n_nationkey", "n_name")


@_query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def ingest_csv(spark, sf_dir):
    at = scratch_folder(spark) + ".csv"
    _table(spark, sf_dir, "nation").write.option("header", True).csv(at)
    return ingest.read(spark, at).select("n_nationkey", "n_name")


@_query("SELECT n_name AS value FROM nation")
def ingest_txt(spark, sf_dir):
    at = scratch_folder(spark) + ".txt"
    _table(spark, sf_dir, "nation").select("n_name").write.text(at)
    return ingest.read(spark, at)


@_query("SELECT path, length, ext IN ('json', 'csv', 'txt') AND length <= 10485760 AS ok FROM (SELECT source || '.' || ['JSON', 'csv', 'exe'][(doc_id % 3 + 1)::INT] AS path, lower(['JSON', 'csv', 'exe'][(doc_id % 3 + 1)::INT]) AS ext, n_chars * 5000 AS length FROM documents)")
def upload_gate(spark, sf_dir):
    ext = F.element_at(F.array(F.lit("JSON"), F.lit("csv"), F.lit("exe")), (F.col("doc_id") % 3 + 1).cast("int"))
    return ingest.gate(_table(spark, sf_dir, "documents").select(F.concat("source", F.lit("."), ext).alias("path"), (F.col("n_chars") * 5000).alias("length")))


@_query("SELECT r_regionkey, r_name FROM region")
def read_by_name(spark, sf_dir):
    _table(spark, sf_dir, "region").createOrReplaceTempView("siltbed_region")
    return ingest.read_named(spark, "siltbed_region").select("r_regionkey", "r_name")


@_query("SELECT count(*) AS n FROM documents WHERE lang = 'de' OR source = 'src1'")
def request_count(spark, sf_dir):
    request = {"request_type": "db_opr", "action": "count", "resource_name": "documents", "conditions": [("lang", "=", "de"), ("source", "=", "src1", "OR")]}
    return records.respond(spark, request, {"documents": _table(spark, sf_dir, "documents")})


@_query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 99, 'NOWHERE', NULL")
def request_insert(spark, sf_dir):
    request = {"request_type": "db_opr", "action": "insert", "resource_name": "nation", "resource_info": [{"n_nationkey": 99, "n_name": "NOWHERE"}]}
    return records.respond(spark, request, {"nation": _table(spark, sf_dir, "nation")})


# ---------------------------------------------------------------- views of a grid


@_query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def visible_columns(spark, sf_dir):
    return records.visible(_table(spark, sf_dir, "customer"), ["c_custkey", "c_nationkey", "c_mktsegment"], always=["c_custkey"])


@_query("SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment DESC, c_nationkey, c_acctbal DESC, c_custkey) AS place FROM customer")
def sort_columns(spark, sf_dir):
    by = (("c_mktsegment", "desc"), ("c_nationkey", "asc"), ("c_acctbal", "desc"), ("c_custkey", "asc"))
    columns = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    rows = ranks.Directory.build(columns, *records.order_of(*by)).numbered()
    return rows.select("c_custkey", (F.col("number") + 1).alias("place"))


@_query("SELECT n_name, CASE WHEN n_nationkey = 3 THEN 9 WHEN n_nationkey BETWEEN 4 AND 9 THEN n_nationkey - 1 ELSE n_nationkey END AS n_nationkey FROM nation")
def moved_row(spark, sf_dir):
    return records.moved(_table(spark, sf_dir, "nation").select("n_name", "n_nationkey"), "n_nationkey", 3, 9)


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000")
def row_cap(spark, sf_dir):
    """The service's cap on the rows of an answer."""
    return grid.limited(_table(spark, sf_dir, "orders"), 1000, F.col("o_totalprice").desc(), "o_orderkey").select("o_orderkey", "o_totalprice")


@_query("SELECT lang, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang FROM documents) LEFT JOIN (SELECT lang, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND lang <> 'de' GROUP BY lang) USING (lang)")
def null_count_zero(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    n = d.where("lang <> 'de'").join(_table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"))
    return d.select("lang").distinct().join(n, "lang", "left").na.fill(0, ["n"])


@_query("""WITH p AS (SELECT list_sort(list(DISTINCT o_orderpriority)) AS c FROM orders), s AS (SELECT list_sort(list(DISTINCT o_orderstatus)) AS c FROM orders), n AS (SELECT count(*) FILTER (WHERE o_totalprice <= 200000) = count(*) AS c FROM orders)
SELECT 'o_orderkey' AS name, 'number' AS widget, true AS required, []::VARCHAR[] AS choices UNION ALL SELECT 'o_orderpriority', 'select', true, c FROM p UNION ALL SELECT 'o_orderstatus', 'select', true, c FROM s
UNION ALL SELECT 'o_orderdate', 'date', true, [] UNION ALL SELECT 'label', 'text', true, [] UNION ALL SELECT 'cheap', 'number', c, [] FROM n UNION ALL SELECT 'ok', 'checkbox', true, []""")
def form_fields(spark, sf_dir):
    """The form fields of orders, as the rows show them."""
    o = _table(spark, sf_dir, "orders")
    label, price = F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), F.col("o_totalprice")
    return records.form_fields(o.select("o_orderkey", "o_orderpriority", "o_orderstatus", F.col("o_orderdate").cast("date"), label.alias("label"), F.when(price <= 200000, price).alias("cheap"), (price > 0).alias("ok")))


@_query(f"WITH {_NODES} SELECT id, x - 1.5 AS px, (y - 1.5) * 2 AS py, z - 1.5 AS pz FROM (SELECT id, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM n)")
def cube_positions(spark, sf_dir):
    n = nodes(spark, sf_dir)
    at = lambda c, scale=1.0: records.shifted(F.col(c).cast("double"), 1.5, scale)
    return n.select("id", at("x").alias("px"), at("y", 2.0).alias("py"), at("z").alias("pz"))


@_query(f"WITH {_NODES} SELECT id, (x > 1)::INT + (y > 1)::INT + (z > 1)::INT AS axes, CASE (x > 1)::INT + (y > 1)::INT + (z > 1)::INT WHEN 3 THEN 'cube' WHEN 2 THEN 'matrix' ELSE 'none' END AS shape FROM n")
def active_axes(spark, sf_dir):
    return nodes(spark, sf_dir).select("id", *[c.alias(n) for n, c in zip(("axes", "shape"), knowledge.view_of(F.col("x") > 1, F.col("y") > 1, F.col("z") > 1), strict=True)])


#: The rows of the car table.
_CARS = (("Tesla", "Model Y", 64950, True), ("Ford", "F-Series", 33850, False), ("Toyota", "Corolla", 29600, False), ("Mercedes", "EQA", 48890, True), ("Fiat", "500", 15774, False), ("Nissan", "Juke", 20675, False))


@_query("SELECT make, electric, count(*) AS n, sum(price)::BIGINT AS price, min(p_partkey) AS first_part FROM part JOIN (VALUES (0, 'Tesla', 64950, true), (1, 'Ford', 33850, false), (2, 'Toyota', 29600, false), (3, 'Mercedes', 48890, true), (4, 'Fiat', 15774, false), (5, 'Nissan', 20675, false)) v(i, make, price, electric) ON p_partkey % 6 = i GROUP BY make, electric")
def inline_cars(spark, sf_dir):
    """The literal rows of cars, each with the parts that go into it."""
    cars = spark.createDataFrame([(i, *c) for i, c in enumerate(_CARS)], "i long, make string, model string, price long, electric boolean")
    parts = _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 6).alias("i"))
    return parts.join(F.broadcast(cars), "i").groupBy("make", "electric").agg(F.count("*").alias("n"), F.sum("price").alias("price"), F.min("p_partkey").alias("first_part"))


@_query(_grid_sql("std_no IN ('de', 'fr') AND status IN ('src0', 'src2') AND id NOT IN (1, 2)"))
def grid_in(spark, sf_dir):
    """IN on the process table, by strings and by numbers."""
    files = process_files(spark, sf_dir)
    return grid.grid(files.where(~predicates.chain(files, [_C("id", "IN", ["1", "2"])])), [_C("doc_num", "IN", ["de", "fr"]), _C("status", "IN", ["src0", "src2"], "AND")])


# ---------------------------------------------------------------- more rules


@_query("""SELECT doc_id, concat_ws('; ', CASE WHEN lang NOT IN ('active', 'suspended', 'deleted') THEN 'status is not known' END,
CASE WHEN source NOT IN ('user entered', 'uploaded', 'crawled') THEN 'source is not known' END, CASE WHEN length(place) <> 11 THEN 'place must have 11 characters' END) AS errors
FROM (SELECT doc_id, ['active', 'gone', 'deleted'][(doc_id % 3 + 1)::INT] AS lang, ['uploaded', 'crawled', ''][(doc_id % 5 % 3 + 1)::INT] AS source, repeat('x', 10 + (doc_id % 2)::INT) AS place FROM documents)""")
def enum_rules(spark, sf_dir):
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    i = F.col("doc_id")
    rules = ingest.enum_rules(pick(("active", "gone", "deleted"), i % 3), pick(("uploaded", "crawled", ""), i % 5 % 3), F.repeat(F.lit("x"), (i % 2 + 10).cast("int")))
    return _table(spark, sf_dir, "documents").select("doc_id", scalars.errors(rules).alias("errors"))


@_query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND (doc_id % 3 = 0 OR doc_id % 3 = 1) THEN 'email and cell phone cannot both be missing' ELSE '' END AS errors, doc_id % 4 = 1 AS chosen FROM documents")
def contact_rules(spark, sf_dir):
    i = F.col("doc_id")
    email, phone = F.when(i % 2 == 0, None).otherwise("a@example.com"), F.when(i % 3 == 0, None).when(i % 3 == 1, " ").otherwise("555")
    chosen = F.when(i % 4 == 1, F.array(F.lit("a"))).when(i % 4 == 2, F.array().cast("array<string>"))
    return _table(spark, sf_dir, "documents").select("doc_id", scalars.errors(ingest.contact_rules(email, phone)).alias("errors"), scalars.filled(chosen).alias("chosen"))
