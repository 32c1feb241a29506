"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the contracts: what separates words.
BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text between blanks, as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often body names it.

    Catalyst may copy a projected expression into a lambda, where it would run once per element.
    A lambda variable cannot be copied.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, UPPER, LOWER)


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the shared checkpoint folder and read from there.

    The folder is the session's spark.checkpoint.dir; only a session without one, as in tests, gets a folder of its own.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one of its own in local mode, an error on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="siltbed-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Like cut(), as a Parquet table: smaller on disk, but it stays until the folder is cleared."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/siltbed-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that stored() has written; nothing that is still to be computed may read them."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
