"""Named stores of records: create, save, retrieve, requests as data, and rows as JSON; grid views of columns and order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType, StringType

from siltbed.functions.predicates import Condition, chain


def save(records: DataFrame, store: str) -> None:
    """Appends records to a store (a folder), which is made if there is none."""
    records.write.mode("append").parquet(store)


def retrieve(spark: SparkSession, store: str, fields: Sequence[str] = ()) -> DataFrame:
    """The named fields of a store's records; all fields if none are named."""
    found = spark.read.parquet(store)
    return found.select(*fields) if fields else found


def respond(spark: SparkSession, request: Mapping[str, Any], tables: Mapping[str, DataFrame]) -> DataFrame:
    """What a request {request_type, action, resource_name, conditions, resource_info} asks of the named tables.

    A query returns the rows that meet all conditions, with the fields of resource_info, or all; a count their number.
    An insert returns the table with the rows of resource_info. Other actions and unknown tables raise ValueError.
    """
    name, action, info = request.get("resource_name"), request.get("action"), request.get("resource_info") or []
    if request.get("request_type") != "db_opr" or name not in tables:
        raise ValueError(f"cannot serve {request.get('request_type')!r} on {name!r}")
    df = tables[name]
    rows = df.where(chain(df, [Condition(*c) for c in request.get("conditions") or ()]))
    if action == "query":
        return rows.select(*info) if info else rows
    if action == "count":
        return rows.agg(F.count("*").alias("n"))
    if action == "insert":
        return df.unionByName(spark.createDataFrame([tuple(r.get(c) for c in df.columns) for r in info], df.schema))
    raise ValueError(f"unknown action {action!r}")


def json_rows(df: DataFrame) -> DataFrame:
    """A JSON object per row, nulls included; no rows give no rows."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))


def visible(df: DataFrame, hidden: Sequence[str], always: Sequence[str] = ()) -> DataFrame:
    """df without the hidden columns; those named by always cannot be hidden."""
    return df.select(*[c for c in df.columns if c not in hidden or c in always])


def order_of(*by: tuple[str, str]) -> list[Column]:
    """The sort order of (column, "asc" or "desc") pairs, nulls last."""
    return [F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_last() for c, way in by]


def ordered(df: DataFrame, *by: tuple[str, str]) -> DataFrame:
    return df.orderBy(*order_of(*by))


def moved(df: DataFrame, position: str, start: int, end: int) -> DataFrame:
    """df with the row at position start moved to end, and those between shifted by one towards start."""
    at = F.col(position)
    step = F.when(at == start, end).when((at > start) & (at <= end), at - 1).when((at < start) & (at >= end), at + 1).otherwise(at)
    return df.withColumn(position, step.cast(df.schema[position].dataType))


def widget(kind: DataType, choices: Sequence[str] = ()) -> str:
    """The kind of form field for a column: select for a closed list, number, checkbox or text."""
    if choices:
        return "select"
    if isinstance(kind, NumericType):
        return "number"
    if isinstance(kind, StringType):
        return "text"
    return {"boolean": "checkbox", "date": "date", "timestamp": "date", "timestamp_ntz": "date"}.get(kind.typeName(), "text")


def form_fields(df: DataFrame, most: int = 8) -> DataFrame:
    """name, widget, required and choices of a form field for every column of df, as its rows show them.

    A column of strings with at most `most` values is a closed list of them; one without a null is required. Two
    passes: sketches first, then the values of the columns that have few.
    """
    counts = [F.count(c).alias(f"n{i}") for i, c in enumerate(df.columns)]
    texts = [i for i, f in enumerate(df.schema) if isinstance(f.dataType, StringType)]
    seen = df.agg(F.count("*").alias("n"), *counts, *[F.approx_count_distinct(df.columns[i], 0.05).alias(f"d{i}") for i in texts]).first()
    few = [i for i in texts if seen[f"d{i}"] <= 2 * most]
    values = df.agg(F.lit(0), *[F.sort_array(F.collect_set(df.columns[i])).alias(f"v{i}") for i in few]).first()
    choices = {i: values[f"v{i}"] for i in few if 0 < len(values[f"v{i}"]) <= most}
    rows = [(f.name, widget(f.dataType, choices.get(i, ())), seen[f"n{i}"] == seen["n"], choices.get(i, [])) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "name string, widget string, required boolean, choices array<string>")


def template(df: DataFrame, order: str) -> DataFrame:
    """A JSON template for records like df's: its first row by order, pretty-printed, nulls included; one row, row."""
    first = df.agg(F.min_by(F.struct(*df.columns), order).alias("x"))
    return first.select(F.to_json("x", {"ignoreNullFields": "false", "pretty": "true"}).alias("row"))


def shifted(at: Column, origin: float, scale: float = 1.0) -> Column:
    """An affine transform of a coordinate."""
    return (at - origin) * scale
