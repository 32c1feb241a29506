"""Semi-structured columns: JSON text as variants, the paths they have, and typed values of paths."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.session import written


def parsed(df: DataFrame, column: str, into: str = "v") -> DataFrame:
    """df with the column's JSON text as a variant, and `<into>_broken`, whether there is text that is no JSON."""
    v = F.try_parse_json(column)
    return df.withColumn(into, v).withColumn(f"{into}_broken", F.col(column).isNotNull() & F.col(into).isNull())


def _kind(schema):
    """object, array, string, number, boolean, null or other from what schema_of_variant() says."""
    starts = lambda *names: F.upper(schema).rlike("^(" + "|".join(names) + ")")
    kind = F.when(starts("OBJECT"), "object").when(starts("ARRAY"), "array").when(starts("STRING"), "string").when(starts("BOOLEAN"), "boolean").when(starts("VOID"), "null")
    return kind.when(starts("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT"), "number").otherwise("other")


def paths(df: DataFrame, column: str, deepest: int = 100) -> DataFrame:
    """path, kind and n: how many values of each kind every path of a variant column has, over all rows.

    '$' is the whole value, '.name' a field and '[*]' any element of an array. Levels are opened one after the other,
    each read from what the one before has left, until no object or array is left; deeper ones than `deepest` raise.
    """
    level, out = df.where(F.col(column).isNotNull()).select(F.lit("$").alias("path"), F.col(column).alias("v")), None
    for _ in range(deepest):
        level = level.withColumn("kind", _kind(F.schema_of_variant("v")))
        counted = level.groupBy("path", "kind").agg(F.count("*").alias("n"))
        out = counted if out is None else out.unionByName(counted)
        nested = level.where("kind IN ('object', 'array')")
        if nested.isEmpty():
            return out.groupBy("path", "kind").agg(F.sum("n").alias("n"))
        opened = df.sparkSession.sql("SELECT path, kind, e.key, e.value FROM {nested}, LATERAL variant_explode(v) AS e(pos, key, value)", nested=nested)
        step = F.when(F.col("kind") == "array", "[*]").otherwise(F.concat(F.lit("."), "key"))
        level = written(opened.select(F.concat("path", step).alias("path"), F.col("value").alias("v")))
    raise ValueError(f"values are nested more than {deepest} deep")


def extracted(df: DataFrame, column: str, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """df with a column per field, (path, type); a value that is missing or does not fit the type is null."""
    return df.withColumns({name: F.try_variant_get(column, path, kind) for name, (path, kind) in fields.items()})
