"""Uploads: readers behind a gate, row validation, duplicate names and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions.scalars import at_least_one, errors, file_extension, is_name, one_of, present
from siltbed.sources.names import NameStore

KINDS = ("json", "csv", "txt")
MOST_BYTES = 10 * 1024 * 1024


def gate(files: DataFrame) -> DataFrame:
    """files (path, length) with ok: a known extension and at most 10 MiB."""
    return files.withColumn("ok", file_extension(F.col("path")).isin(*KINDS) & (F.col("length") <= MOST_BYTES))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON array or object, a CSV file with a header, or a text file of a record per line."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "json":
        return spark.read.option("multiLine", True).json(path)
    if kind == "csv":
        return spark.read.option("header", True).csv(path)
    if kind == "txt":
        return spark.read.text(path)
    raise ValueError(f"no reader for {path!r}")


def read_named(spark: SparkSession, name: str) -> DataFrame:
    """A table or view of the session's catalogue."""
    return spark.table(name)


def read_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A database table; filters and columns are pushed to the database."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def read_table_parts(spark: SparkSession, url: str, name: str, column: str, parts: int, **options: str) -> DataFrame:
    """A database table read by several tasks, each a range of a numeric column; the bounds are asked of the database.

    Rows without the column's value are in the first range. An empty table is read by one task.
    """
    ends = read_table(spark, url, f"(SELECT MIN({column}) AS low_end, MAX({column}) AS high_end FROM {name}) ends", **options).first()
    if ends[0] is None:
        return read_table(spark, url, name, **options)
    bounds = {"partitionColumn": column, "lowerBound": str(ends[0]), "upperBound": str(ends[1] + 1), "numPartitions": str(parts)}
    return read_table(spark, url, name, **bounds, **options)


def prompt_rules(name: Column, description: Column, content: Column, creator: Column) -> dict[str, Column]:
    return {
        "name is required": present(name),
        "name has other characters": ~present(name) | is_name(name),
        "name is too long": F.length(F.coalesce(name, F.lit(""))) <= 64,
        "description is too long": F.length(F.coalesce(description, F.lit(""))) <= 500,
        "content is too short": F.length(content) >= 5,
        "creator is required": present(creator),
    }


#: Fixed values of a prompt record: its states, its sources, and the length of a place.
STATES = ("active", "suspended", "deleted")
SOURCES = ("user entered", "uploaded", "crawled")
PLACE = 11


def enum_rules(status: Column, source: Column, creator_loc: Column) -> dict[str, Column]:
    return {
        "status is not known": one_of(status, STATES),
        "source is not known": one_of(source, SOURCES),
        f"place must have {PLACE} characters": F.length(creator_loc) == PLACE,
    }


def contact_rules(email: Column, phone: Column) -> dict[str, Column]:
    return {"email and cell phone cannot both be missing": at_least_one(email, phone)}


def check(rows: DataFrame, rules: dict[str, Column], key: str, order: str, existing: DataFrame | NameStore | None = None) -> DataFrame:
    """rows with errors and outcome: 'error', 'duplicate' (an earlier valid row, or existing, has the key) or 'created'.

    order tells rows apart, as a row's number in a file does. The first valid row of a key comes from an aggregation,
    and rows are matched with it by key and order, so a key with a third of all rows makes no large group. existing
    is a table with the key or a store of names; a null key is in neither, and is a key of its own among the rows.
    """
    out = rows.withColumn("errors", errors(rules))
    first = out.where("errors = ''").groupBy(key).agg(F.min(order).alias(order))
    if existing is not None:
        names = first.select(F.col(key).alias("name")).where("name IS NOT NULL")
        known = existing.existing(names) if isinstance(existing, NameStore) else existing.select(F.col(key).alias("name")).distinct()
        first = first.join(known.withColumnRenamed("name", "_name"), F.col(key) == F.col("_name"), "left_anti")
    first = first.select(F.struct(key, order).alias("_at"), F.lit(True).alias("_first"))  # fields match null to null
    out = out.withColumn("_at", F.struct(key, order)).join(first, "_at", "left").drop("_at")
    outcome = F.when(F.col("errors") != "", "error").when(F.col("_first"), "created").otherwise("duplicate")
    return out.withColumn("outcome", outcome).drop("_first")


def counters(checked: DataFrame) -> DataFrame:
    of = lambda o: F.count_if(F.col("outcome") == o)
    return checked.agg(F.count("*").alias("processed"), of("created").alias("created"), of("error").alias("errors"), of("duplicate").alias("duplicates"))
