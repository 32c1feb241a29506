"""Schemas of the tables that track documents through a processing pipeline."""

from pyspark.sql import types as T

_S, _L, _N = T.StringType(), T.LongType(), T.TimestampNTZType()


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


DOCUMENTS = _schema(
    ("doc_id", _L, False), ("user_id", _S), ("doc_name", _S), ("doc_no", _S), ("doc_desc", _S), ("doc_summary", _S), ("doc_keywords", _S), ("doc_tags", _S),
    ("file_url", _S, False), ("image_url", _S), ("doc_type", _S, False), ("doc_source", _S), ("doc_scope", _S, False), ("doc_status", _S, False),
    ("process_status", _S, False), ("created_at", _N), ("updated_at", _N),
)
PROCESS_STATUS = _schema(("id", _L, False), ("status_name", _S, False), ("status_value", _S, False), ("rcd_count", _L), ("tags", _S, False), ("created_at", _N))
SCHEDULES = _schema(
    *[(c, _S) for c in ("event_name", "urgency", "message", "user_email", "cell_phone", "sales_lead", "remarks")], ("schedule_date", T.DateType(), False),
    ("schedule_hour", T.IntegerType()), ("schedule_minute", T.IntegerType()), ("creator", _S, False), ("updater", _S, False), ("created_at", _N), ("updated_at", _N),
)
#: Exposed name of each column of the process table by its stored name.
PROCESS_FILE = {
    "id": "record_uuid", "md5": "md5", "std_name": "doc_name", "std_no": "doc_num", "rel_file_path": "file_url", "status": "status",
    **{c: c for c in (
        "data_proc_status", "data_proc_at", "chunk_proc_status", "chunk_proc_at", "embedding_proc_status", "embedding_proc_at", "es_proc_status", "es_proc_at",
        "parser_source_tname", "parser_content_proc_tname", "chunk_tablename", "error_msg", "knowledge_base_id", "create_at", "proc_status_json",
    )},
}
STATUS_COLUMNS = ("status", "data_proc_status", "chunk_proc_status", "embedding_proc_status", "es_proc_status")
