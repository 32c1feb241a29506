"""Rows in numbered pages of JSON: an export, and a data source that reads pages in parallel and skips what a filter rules out."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import date, datetime
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from siltbed.operators.ranks import Directory

#: The column that a schema may have to get what is wrong with a page, in place of a failure.
ERROR = "page_error"


def export(df: DataFrame, path: str, key: str, size: int) -> None:
    """Writes df in order of a unique key as pages of `size` rows, page=<number>/, and an index of the pages' keys.

    key is a number that JSON has exactly. A page is one JSON object, {"page", "rows"}, with nulls.
    """
    rows = Directory.build(df, key).numbered().withColumn("page", F.floor(F.col("number") / size)).drop("number")
    rows_of = F.sort_array(F.collect_list(F.struct(F.col(key).alias("_key"), F.struct(*df.columns).alias("row"))))
    body = F.to_json(F.struct("page", F.transform("rows", lambda x: x["row"]).alias("rows")), {"ignoreNullFields": "false"})
    rows.groupBy("page").agg(rows_of.alias("rows")).select("page", body.alias("value")).write.partitionBy("page").text(f"{path}/pages")
    index = rows.groupBy("page").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n")).orderBy("page")
    index.select(F.lit(key).alias("key"), "page", "low", "high", "n").write.json(f"{path}/index")


def _listed(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    system, at = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    return system, [f for f in found if f.is_file and not f.base_name.startswith((".", "_"))]


class Pages(InputPartition):
    def __init__(self, files: list[tuple[int, str]]) -> None:
        self.files = files


class PageReader(DataSourceReader):
    """Reads pages, some in a task, and only those whose keys the pushed filters allow."""

    def __init__(self, path: str, schema: StructType, per_task: int) -> None:
        self.path, self.schema, self.per_task, self.bounds = path, schema, per_task, []
        system, files = _listed(f"{path}/index")
        lines = [json.loads(x) for f in files for x in system.open_input_stream(f.path).read().decode().splitlines()]
        self.index = {x["page"]: x for x in lines}
        self.key = lines[0]["key"] if lines else None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of the key skip pages; all filters are still tested on the rows."""
        for f in filters:
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.attribute == (self.key,):
                self.bounds.append((type(f).__name__, f.value))
            yield f

    def _allowed(self, x: dict) -> bool:
        tests = {"EqualTo": lambda v: x["low"] <= v <= x["high"], "GreaterThan": lambda v: x["high"] > v, "GreaterThanOrEqual": lambda v: x["high"] >= v, "LessThan": lambda v: x["low"] < v, "LessThanOrEqual": lambda v: x["low"] <= v}
        return all(tests[op](v) for op, v in self.bounds)

    def partitions(self) -> list[Pages]:
        files = sorted((int(f.path.rsplit("page=", 1)[1].split("/")[0]), f.path) for f in _listed(f"{self.path}/pages")[1]) if self.index else []
        lost = sorted(set(self.index) - {n for n, _ in files})
        kept = [(n, p) for n, p in [*files, *((n, "") for n in lost)] if n not in self.index or self._allowed(self.index[n])]
        return [Pages(kept[i : i + self.per_task]) for i in range(0, len(kept), self.per_task)] or [Pages([])]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        system = _listed(f"{self.path}/index")[0]
        for number, path in partition.files:
            try:
                if not path:
                    raise ValueError("there is no such page")
                body = json.loads(system.open_input_stream(path).read())
                if body.get("page") != number or len(body["rows"]) != self.index.get(number, {}).get("n"):
                    raise ValueError("it is not the page that the index has")
                rows = [{f.name: _typed(r.get(f.name), f.type) for f in schema} for r in body["rows"]]
                yield pa.RecordBatch.from_pylist(rows, schema)
            except (ValueError, KeyError, TypeError, AttributeError, pa.ArrowException) as e:
                if ERROR not in schema.names:
                    raise ValueError(f"page {number}: {e}") from e
                yield pa.RecordBatch.from_pylist([{ERROR: f"page {number}: {e}"}], schema)


def _typed(value: Any, kind: pa.DataType) -> Any:
    if value is None or not isinstance(value, str) or pa.types.is_string(kind):
        return value
    if pa.types.is_date(kind):
        return date.fromisoformat(value)
    if pa.types.is_timestamp(kind):
        return datetime.fromisoformat(value)
    return Decimal(value) if pa.types.is_decimal(kind) else value


class PagedJson(DataSource):
    """Format paged_json: load(path) of what export() has written; option pages, how many a task reads."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        raise ValueError("paged_json needs a schema")

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(self.options["path"], schema, int(self.options.get("pages", 8)))


def read_pages(spark: SparkSession, path: str, schema: StructType | str, pages: int = 8, errors: bool = False) -> DataFrame:
    """The pages at path as a table; a page that is missing or broken fails the query or, with errors, is a row of nulls with page_error."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedJson)
    kinds = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kinds = StructType([*kinds.fields]).add(ERROR, StringType()) if errors else kinds
    return spark.read.format("paged_json").schema(kinds).option("pages", pages).load(path)
