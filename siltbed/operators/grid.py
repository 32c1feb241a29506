"""The filtered grid: filter first, then rename and null-default, ordered before any limit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.functions.predicates import Condition, Group, chain, tree
from siltbed.schemas import PROCESS_FILE


def limited(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows by order; all rows if n is not positive."""
    return df.orderBy(*order).limit(n) if n > 0 else df


def grid(df: DataFrame, conditions: Sequence[Condition] | Group = (), limit: int = 100, ci: bool = False) -> DataFrame:
    """The process table under its exposed names, all strings, nulls as ''; filters see the stored nulls."""
    names = {v: k for k, v in PROCESS_FILE.items()} | {k: k for k in PROCESS_FILE}
    where = tree(df, conditions, names, ci) if isinstance(conditions, Group) else chain(df, conditions, names, ci)
    rows = limited(df.where(where), limit, "id")
    return rows.select(*[(F.col(k).cast("string") if k == "id" else F.coalesce(F.col(k).cast("string"), F.lit(""))).alias(v) for k, v in PROCESS_FILE.items()])


def page(df: DataFrame, number: int, size: int = 10, order: Sequence[Column | str] = ()) -> DataFrame:
    """Page `number` (from 0) of df in a total order."""
    return df.orderBy(*order).offset(number * size).limit(size)


def page_count(df: DataFrame, size: int = 10) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"), F.ceil(F.count("*") / size).cast("long").alias("pages"))


def facets(df: DataFrame, *columns: str) -> DataFrame:
    """Value counts of several columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def cross_facets(df: DataFrame, filters: Mapping[str, Column | None], also: Sequence[Column] = ()) -> DataFrame:
    """facet, value, n: the value counts of each column in filters among rows that meet all filters but its own.

    A filter is a predicate, or None for a column that is counted but not filtered; rows must meet also's predicates
    for every facet. A null predicate counts as not met. One pass: a row has a bit for each filter that it fails; with
    none set it counts for all facets, with one for that facet, else for none, and only then are its values unpivoted.
    Values without a row are left out; a null value is one of its own.
    """
    if len(filters) > 62:
        raise ValueError("62 facets at most")
    fails = [F.when(F.coalesce(p, F.lit(False)), 0).otherwise(1 << i) if p is not None else F.lit(0) for i, p in enumerate(filters.values())]
    rows = reduce(lambda d, p: d.where(p), also, df).withColumn("_failed", reduce(lambda a, b: a.bitwiseOR(b), [f.cast("long") for f in fails], F.lit(0).cast("long")))
    of = [F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value"), F.lit(1 << i).cast("long").alias("bit")) for i, c in enumerate(filters)]
    counted = F.filter(F.array(*of), lambda x: (F.col("_failed") == 0) | (F.col("_failed") == x["bit"]))
    return rows.select(F.explode(counted).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def search(df: DataFrame, text: dict[str, str] | None = None, exact: dict[str, str] | None = None, within: dict[str, str] | None = None, since: dict[str, str] | None = None) -> DataFrame:
    """Rows that meet all criteria; an empty one passes.

    text: case-insensitive substring; exact: equal; within: substring of the value as text; since: at or after a time.
    """
    out = df
    for c, v in (text or {}).items():
        out = out.where(F.contains(F.lower(c), F.lit(v.lower()))) if v else out
    for c, v in (exact or {}).items():
        out = out.where(F.col(c) == F.lit(v)) if v else out
    for c, v in (within or {}).items():
        out = out.where(F.contains(F.col(c).cast("string"), F.lit(v))) if v else out
    for c, v in (since or {}).items():
        out = out.where(F.col(c) >= F.lit(v).try_cast(df.schema[c].dataType)) if v else out
    return out
