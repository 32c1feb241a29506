"""A table that keeps its edits: a base, numbered batches of keyed changes, merged on read and compacted.

Rows are never changed in place. A batch of inserts, updates or deletions is a folder of its own, named by its number,
so one that is written again after a failure replaces itself. A batch counts once its mark is written, after its rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions.predicates import Condition, chain

#: Up to so many changed keys are sent to every worker when they are merged; more are joined by a shuffle.
MOST = 100_000
_MARK = "base long, upto long, n long"


class EditedTable:
    """A table in a folder with a key that no two of its rows share and that is never null."""

    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path, key

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str) -> EditedTable:
        made = cls(df.sparkSession, path, key)
        made._write_base(df, 0, -1)
        return made

    def _mark(self, kind: str, number: int, base: int, upto: int, n: int) -> None:
        self.spark.createDataFrame([(base, upto, n)], _MARK).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/kind={kind}/number={number}")

    def _write_base(self, df: DataFrame, base: int, upto: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/base/{base}")
        self._mark("base", base, base, upto, 0)

    def _state(self) -> tuple[int, int, list[int]]:
        """The base that holds most batches, the last batch in it, and the later batches."""
        marks = self.spark.read.schema(f"{_MARK}, kind string, number long").parquet(f"{self.path}/marks").collect()
        last = max((m for m in marks if m.kind == "base"), key=lambda m: m.number)
        return last.base, last.upto, sorted(m.number for m in marks if m.kind == "batch" and m.number > last.upto)

    def base(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/base/{self._state()[0]}")

    def _deltas(self, before: int | None = None) -> DataFrame | None:
        paths = [f"{self.path}/batch/{b}" for b in self._state()[2] if before is None or b < before]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self, before: int | None = None) -> DataFrame:
        """The table after all batches, or after those before a number that is not compacted yet.

        A column has the value of the last change, by batch and place in the batch, that sets it, else the base's.
        """
        base, deltas = self.base(), self._deltas(before)
        if deltas is None:
            return base
        rest = [c for c in base.columns if c != self.key]
        at, sets = F.struct("_batch", "_seq"), F.col("_sets")
        last = [F.max_by(F.when(F.array_contains(sets, c), F.struct(c)), F.when(F.array_contains(sets, c), at)).alias(f"_{c}") for c in rest]
        deltas = deltas.withColumn("_key", F.col(self.key)).drop(self.key)
        changed = deltas.groupBy("_key").agg(*last, F.max_by("_gone", at).alias("_is_gone"), F.max(F.col("_op") == "insert").alias("_new"))
        small = changed.limit(MOST + 1).count() <= MOST
        old = base.join(F.broadcast(changed) if small else changed, F.col(self.key) == F.col("_key"), "left")
        value = lambda c: F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.{c}")).otherwise(F.col(c)).alias(c)
        old = old.where("NOT coalesce(_is_gone, false)").select(*[F.col(c) if c == self.key else value(c) for c in base.columns])
        new = changed.where("_new AND NOT coalesce(_is_gone, false)")
        new = new.select(*[F.col("_key").alias(c) if c == self.key else F.col(f"_{c}.{c}").alias(c) for c in base.columns])
        return old.unionByName(new)

    def _apply(self, rows: DataFrame, batch: int, op: str, sets: Sequence[str], gone: bool, seq: str | None) -> int:
        if batch <= self._state()[1]:
            return 0  # it is in the base already
        base = self.base()
        extra = [c for c in rows.columns if c not in base.columns and c != seq]
        if extra or self.key not in rows.columns:
            raise ValueError(f"columns {extra or [self.key]} do not fit")
        columns = [(F.col(c) if c in rows.columns else F.lit(None)).cast(base.schema[c].dataType).alias(c) for c in base.columns]
        place = F.col(seq).cast("long") if seq else F.lit(0).cast("long")
        marks = [F.lit(batch).cast("long").alias("_batch"), place.alias("_seq"), F.lit(op).alias("_op"), F.array(*map(F.lit, sets)).cast("array<string>").alias("_sets"), F.lit(gone).alias("_gone")]
        at = f"{self.path}/batch/{batch}"
        rows.select(*columns, *marks).write.mode("overwrite").parquet(at)
        keys = self.spark.read.parquet(at).select(self.key)
        n, given, different = keys.agg(F.count("*"), F.count(self.key), F.countDistinct(self.key)).first()
        if given < n or (not seq and different < n):
            raise ValueError("keys must not be null, nor repeated without a place in the batch")
        missing = keys.distinct().join(self.read(batch).select(self.key), self.key, "left_anti").count()
        if op == "insert" and missing < n:
            raise ValueError("a key to insert is there already")
        if op == "update" and missing:
            raise LookupError("a key to change is not there")
        self._mark("batch", batch, 0, 0, n)
        return n

    def insert(self, rows: DataFrame, batch: int) -> int:
        """Adds rows with new keys; columns they have not are null. The number of rows; ValueError if a key is there."""
        return self._apply(rows, batch, "insert", [c for c in rows.columns if c != self.key], False, None)

    def update(self, rows: DataFrame, batch: int, seq: str | None = None) -> int:
        """Sets the columns of rows besides the key; LookupError if a key is not there. Of rows with one key the last by seq counts."""
        return self._apply(rows, batch, "update", [c for c in rows.columns if c not in (self.key, seq)], False, seq)

    def delete(self, keys: DataFrame, batch: int, flag: Mapping[str, str] | None = None) -> int:
        """Takes rows out; with flag, they stay and its columns get its values, a soft deletion. LookupError if a key is not there."""
        keys = keys.select(self.key)
        if flag:
            return self.update(keys.select(self.key, *[F.lit(v).alias(c) for c, v in flag.items()]), batch)
        return self._apply(keys, batch, "update", [], True, None)

    def compact(self) -> None:
        """Writes the merged table as the next base; what was read before stays readable."""
        base, _, batches = self._state()
        if batches:
            self._write_base(self.read(), base + 1, batches[-1])


def serve(table: EditedTable, request: Mapping, batch: int) -> DataFrame | int:
    """A stored request {request_type, action, conditions, resource_info}: rows, or how many rows it has changed.

    query and count read; insert stores the records of resource_info; update sets its values, and delete removes, in
    rows that meet all conditions. A change is the batch of that number, and one that meets no row raises LookupError.
    """
    action, info = request.get("action"), request.get("resource_info") or []
    if request.get("request_type") != "db_opr":
        raise ValueError(f"cannot serve {request.get('request_type')!r}")
    if action == "insert":
        kinds = table.base().schema
        return table.insert(table.spark.createDataFrame([tuple(r.get(c) for c in kinds.names) for r in info], kinds), batch)
    now = table.read(batch if action in ("update", "delete") else None)
    rows = now.where(chain(now, [Condition(*c) for c in request.get("conditions") or ()]))
    if action == "query":
        return rows.select(*info) if info else rows
    if action == "count":
        return rows.agg(F.count("*").alias("n"))
    if action == "update":
        values: list[Column] = [F.lit(v).alias(c) for c, v in dict(info).items()]
        changed = table.update(rows.select(table.key, *values), batch)
    elif action == "delete":
        changed = table.delete(rows, batch)
    else:
        raise ValueError(f"unknown action {action!r}")
    if not changed and batch > table._state()[1]:
        raise LookupError("no row meets the conditions")
    return changed
